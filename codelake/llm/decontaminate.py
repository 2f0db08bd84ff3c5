"""Benchmark decontamination (operator 10): a distributed positional inverted index over the training documents.

Each index segment holds the postings of a few megabytes of documents: for every term of the test items, the sorted
positions at which it stands. A segment is written once to the shared folder and then searched: a window of a test item
takes its terms from the rarest (by count over the whole corpus) to the most frequent, shifts each posting list by the
term's place in the window and intersects the lists. What is left are the exact starts of the phrase. Shifted lists of
the rarest terms that come within a few words of each other are proximity matches.

Terms that no test item holds can't match and aren't stored. Documents are never shuffled, so a document or passage
of any frequency costs its own postings only. Test items are taken in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bound_batches, fingerprint, keep, offsets, utf8

# Lower-cases A-Z; every byte that is no word byte becomes a blank. Bytes from 0x80 on belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOW, SLOP = 10, 5
# Test items are searched in blocks of about so many bytes, each of which a worker can hold.
BLOCK_BYTES = 16 << 20

SEGMENT = ("segment string, doc_ids array<string>, lengths binary, terms binary, ends binary, positions binary")
HITS = "segment string, ordinal int, doc_id string, n_words long, runs array<int>, items array<string>, near array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class _Vocabulary(dict):
    def __missing__(self, key):
        return -1


def item_windows(items: list[tuple[str, bytes]], vocabulary: dict[bytes, int],
                 width: int) -> tuple[list[tuple[int, ...]], list[list[int]], list[str]]:
    """Distinct windows as term ids, the items of each window, and the item names."""
    windows, owners, names = {}, [], []
    for name, text in items:
        names.append(name)
        ids = [vocabulary[w] for w in words(text)]
        for start in range(max(1, len(ids) - width + 1) if ids else 0):
            window = tuple(ids[start:start + width])
            at = windows.setdefault(window, len(windows))
            if at == len(owners):
                owners.append([])
            if not owners[at] or owners[at][-1] != len(names) - 1:
                owners[at].append(len(names) - 1)
    return list(windows), owners, names


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text_column: str, gap: int) -> DataFrame:
    """Index segments of all documents for the terms of the vocabulary; one row per segment."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep("nothing", lambda: None)
        get = _Vocabulary(shared.value).__getitem__
        for batch in batches:
            if not len(batch):
                continue
            lengths = np.zeros(len(batch), np.int64)
            found, places, base = [], [], 0
            for i, text in enumerate(batch["text"]):
                ids = np.fromiter(map(get, words(text)), np.int32)
                lengths[i] = len(ids)
                at = np.flatnonzero(ids >= 0)
                found.append(ids[at])
                places.append(at + base)
                # A gap between documents keeps phrases and near matches inside one.
                base += len(ids) + gap
            ids, at = np.concatenate(found), np.concatenate(places)
            order = np.argsort(ids, kind="stable")
            ids, at = ids[order], at[order]
            last = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)) if len(ids) else np.zeros(0, np.int64)
            yield pd.DataFrame({"segment": [uuid.uuid4().hex], "doc_ids": [list(batch["doc_id"])],
                                "lengths": [lengths.tobytes()], "terms": [ids[last].tobytes()],
                                "ends": [(last + 1).astype(np.int64).tobytes()], "positions": [at.astype(np.int64).tobytes()]})

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), utf8(text_column).alias("text"))
    return rows.mapInPandas(run, SEGMENT)


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """How often each term of the vocabulary stands in the corpus."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, ends in zip(batch["terms"], batch["ends"]):
                total[np.frombuffer(terms, np.int32)] += np.diff(np.frombuffer(ends, np.int64), prepend=0)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    sums = index.select("terms", "ends").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in sums.toLocalIterator():  # at most one row per term of a bounded block
        counts[row.term] = row.n
    return counts


def _runs(starts: np.ndarray, stops: np.ndarray) -> list[int]:
    """Union of intervals as a flat list start, stop, start, stop..."""
    order = np.argsort(starts, kind="stable")
    out: list[int] = []
    for a, b in zip(starts[order].tolist(), stops[order].tolist()):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def search(index: DataFrame, windows: list[tuple[int, ...]], owners: list[list[int]], names: list[str],
           counts: np.ndarray, gap: int, slop: int, last: bool = False) -> DataFrame:
    """All documents of the index with the exact occurrences and near items of this block.

    With ``last`` as rows of RESULT, in the same pass: a second Python step behind this one would take a second worker for
    each task, and idle workers stay beside the executor with all they hold.
    """
    grid = np.full((len(windows), max(map(len, windows), default=1)), -1, np.int32)
    for i, window in enumerate(windows):
        grid[i, :len(window)] = window
    # Places of each window's terms from the rarest on; a term of no document sorts first and ends the search.
    weight = np.where(grid >= 0, np.append(counts, 0)[grid], np.iinfo(np.int64).max)
    ranked = np.argsort(weight, axis=1, kind="stable").astype(np.int8) if len(windows) else grid.astype(np.int8)
    shared = index.sparkSession.sparkContext.broadcast((grid, ranked, owners, names, len(counts)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid, ranked, owners, names, size = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = _search_segment(row, grid, ranked, owners, names, size, gap, slop)
                yield _result(found) if last else found

    return index.mapInPandas(run, RESULT if last else HITS)


def _search_segment(row, grid, ranked, owners, names, size, gap, slop) -> pd.DataFrame:
    lengths, terms = np.frombuffer(row.lengths, np.int64), np.frombuffer(row.terms, np.int32)
    ends, positions = np.frombuffer(row.ends, np.int64), np.frombuffer(row.positions, np.int64)
    bases = offsets(lengths + gap)
    begins = np.append(0, ends[:-1])
    place = np.full(size + 1, -1, np.int64)
    place[terms] = np.arange(len(terms))

    def postings(term: int) -> np.ndarray:
        at = place[term]
        return positions[begins[at]:ends[at]]

    exact: dict[int, list] = {}
    near: dict[int, set] = {}
    here = (place[np.where(grid >= 0, grid, size)] >= 0) | (grid < 0)
    rare = here[np.arange(len(grid))[:, None], ranked[:, :3]].all(axis=1)
    for w in np.flatnonzero(rare):
        window, order = grid[w], [k for k in ranked[w].tolist() if grid[w, k] >= 0]
        first = postings(window[order[0]]) - order[0]
        if len(order) > 2:
            close = first
            for k in order[1:3]:
                other = postings(window[k]) - k
                at = np.searchsorted(other, close - slop)
                close = close[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= close + slop)]
            for doc in np.unique(np.searchsorted(bases, np.maximum(close, 0), "right") - 1).tolist():
                near.setdefault(doc, set()).update(owners[w])
        if not here[w].all():
            continue
        starts = first
        for k in order[1:]:
            if not len(starts):
                break
            other = postings(window[k]) - k
            at = np.searchsorted(other, starts)
            starts = starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == starts)]
        docs = np.searchsorted(bases, starts, "right") - 1
        for doc, start in zip(docs.tolist(), starts.tolist()):
            exact.setdefault(doc, []).append((start - bases[doc], start - bases[doc] + len(order), w))
    n = len(lengths)
    runs, items = [[] for _ in range(n)], [[] for _ in range(n)]
    for doc, found in exact.items():
        spans = np.array([f[:2] for f in found], np.int64)
        runs[doc] = _runs(spans[:, 0], spans[:, 1])
        items[doc] = sorted({names[o] for f in found for o in owners[f[2]]})
    return pd.DataFrame({"segment": row.segment, "ordinal": np.arange(n, dtype=np.int32), "doc_id": list(row.doc_ids),
                         "n_words": lengths, "runs": runs, "items": items,
                         "near": [sorted({names[o] for o in near.get(d, ())}) for d in range(n)]})


RESULT = ("doc_id string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "n_near_items long, runs array<int>, items array<string>, near_items array<string>")


def _result(batch: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r in batch.itertuples(index=False):
        flat = np.asarray(r.runs, np.int64)
        runs = _runs(flat[::2], flat[1::2])
        items, near = sorted(set(r.items)), sorted(set(r.near))
        hit = sum(runs[1::2]) - sum(runs[::2])
        rows.append((r.doc_id, r.n_words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0,
                     len(near), runs, items, near))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
                                       "n_near_items", "runs", "items", "near_items"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       item_column: str = "item_id", item_text: str = "text", width: int = WINDOW,
                       slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document (``id_column``): its words, the words inside any occurrence of a test window, and the items concerned.

    A window is ``width`` consecutive words of an item; a shorter item that isn't empty is one window. ``runs`` holds
    the hit words as flat start, stop pairs. Near items are those of which the three rarest words of a window stand
    within ``slop`` words of their places (exact matches of three words or more included).

    Null or empty texts have no words and no hits; null ids stay null; repeated rows give a row each; an item id that
    repeats counts once; a null item id counts as an empty id. Other columns, whatever their names, are not read.
    An empty benchmark gives no hits, an empty corpus no rows.
    """
    bound_batches(docs.sparkSession)
    bench = staged(benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"),
                                    utf8(item_text).alias("text")), "test-items")
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    gap = width + slop + 1
    n_blocks = max(1, -(-size // block_bytes))
    def block_items(block: int) -> list[tuple[str, bytes]]:
        own = bench if n_blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        return [(r.item, bytes(r.text)) for r in own.collect()]  # about block_bytes

    vocabulary: dict[bytes, int] = {}
    for block in range(n_blocks):
        for _, text in block_items(block):
            for word in words(text):
                vocabulary.setdefault(word, len(vocabulary))
    index = staged(build_index(docs, vocabulary, id_column, text_column, gap), "index")
    counts = term_counts(index, len(vocabulary))
    hits = None
    for block in range(n_blocks):
        part = search(index, *item_windows(block_items(block), vocabulary, width), counts, gap, slop, n_blocks == 1)
        hits = part if hits is None else hits.unionByName(part)
    if n_blocks > 1:
        flat = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "items", "near")}
        hits = hits.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                                      *flat.values())
        hits = hits.mapInPandas(lambda batches: (_result(b) for b in batches if len(b)), RESULT)
    kind = docs.schema[id_column].dataType.simpleString()
    return hits.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", id_column)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the result, without spans and lists."""
    return find_contamination(docs, benchmark).drop("runs", "items", "near_items")


# Contaminated documents are few beside the corpus; up to so many (16 bytes each) they are broadcast, beyond that joined by shuffle.
BROADCAST_HITS = 1 << 20


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows and columns of the documents without a hit.

    A document is known by its id and its text's fingerprint, so rows that repeat an id are judged apart. Columns may have any names.
    """
    keyed = docs.select(F.struct(F.col(id_column).cast("string").alias("id"), fingerprint(text_column).cast("string").alias("fp")).alias("_key"),
                        F.col(text_column).alias("text")).select(F.to_json("_key").alias("_key"), "text")
    hit = find_contamination(keyed, benchmark, "_key", "text").where("contaminated").select(F.from_json("_key", "id string, fp string").alias("k"))
    hit = staged(hit.select(F.col("k.id").alias("_id"), F.col("k.fp").cast("long").alias("_fp")).distinct(), "contaminated")
    if hit.count() <= BROADCAST_HITS:
        hit = F.broadcast(hit)
    rows = docs.select(F.struct(F.col("*")).alias("_row"), F.col(id_column).cast("string").alias("_own_id"), fingerprint(text_column).alias("_own_fp"))
    return rows.join(hit, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_fp") == F.col("_fp")), "left_anti").select("_row.*")
