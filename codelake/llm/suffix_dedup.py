"""Removal of long repeated byte strings (operator 1) with a distributed sparse suffix array.

Every 400-byte window of a document has one anchor: the place of its least 64-byte hash (the leftmost if equal). Equal windows
have equal anchors, so only suffixes that start at anchors need sorting, about one in 170; neighbouring windows with one anchor
are a segment. All suffixes of all bytes would be some twenty times the input, far beyond the disk at hand.

1. Segments with an anchor that no other segment has are done: none of their windows repeats.
2. Segments equal in their whole text repeat as a whole; one of them stands for all from here on.
3. The remaining suffixes, each with the text of its segment, are range-partitioned by their leading bytes at splitters that Spark
   samples, and sorted. Inside a bucket the windows of suffixes with one anchor text are ordered token by token (multikey
   quicksort over 100-byte tokens, level by level), and those with an equal neighbour are repeats.
4. Anchor texts at the ends of a bucket may go on in the next one, and very large ones are cut by the splitters. They are compared
   across the boundaries in slices of windows, which meet by the hash of the core that a slice's windows share; slices that are
   still too many for a task go by window digests in a grouped aggregation, which no size of group overloads.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bound_batches, fingerprint, in_batches, utf8

LENGTH, GRAM, TOKEN = 400, 64, 100
# Texts are hashed in pieces of at most so many bytes (positions fit 21 bits), windows of several rows at once.
PIECE = 1 << 20
# Groups of one anchor text above this many bytes go to the digests, so a task holds no more.
GROUP_BYTES = 1 << 20
# Tables by document are broadcast up to so many rows (some 50 to 200 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 1 << 18

_MASK = np.uint64((1 << 21) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    base = _BASES[which]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << 21, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _sums(text: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(which)[0][:len(text)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the strings from start to stop; equal strings have equal hashes wherever they stand."""
    x = (sums[stop] - sums[start]) * _powers(which)[1][start]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of key[p:p + width] for each p (shorter at the end)."""
    n = len(key)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def segments(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of some pieces of text: piece, first and last window start in it, anchor, anchor hash and hash of the whole."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(text)
    if not (sizes >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums, at = _sums(text), np.arange(n - gram + 1)
    grams = _hashes(sums, at, at + gram)
    anchor = (_least_in_windows((grams & ~_MASK) | at.astype(np.uint64), length - gram + 1) & _MASK).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    starts = sizes >= length
    np.add.at(valid, begin[starts], 1)
    np.add.at(valid, (begin + sizes - length + 1)[starts], -1)
    window = np.flatnonzero(np.cumsum(valid[:n], dtype=np.int64) > 0)
    own = anchor[window]
    piece = np.searchsorted(begin, window, "right") - 1
    first = np.append(True, (own[1:] != own[:-1]) | (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1))
    a = np.flatnonzero(first)
    b = np.append(a[1:], len(window)) - 1
    lo, hi, mid, piece = window[a], window[b], own[a], piece[a]
    whole = _hashes(sums, lo, hi + length) ^ ((mid - lo).astype(np.uint64) * np.uint64(_BASES[1]))
    return piece, lo - begin[piece], hi - begin[piece], mid - begin[piece], grams[mid].astype(np.int64), whole.astype(np.int64)


def repeated(texts: list[bytes], length: int = LENGTH, token: int = TOKEN) -> list[np.ndarray]:
    """For each text whether the window at each start occurs at another place of any of the texts.

    Breadth-first multikey quicksort: on each level the windows that are still equal to others are ordered by their next
    token, and windows without an equal neighbour leave.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n_windows = np.maximum(sizes - length + 1, 0)
    begin = np.cumsum(sizes) - sizes
    total = int(n_windows.sum())
    at = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + np.repeat(begin, n_windows)
    sums = _sums(np.frombuffer(b"".join(texts), np.uint8))
    alive, group = np.arange(total), np.zeros(total, np.int64)
    for start in range(0, length, token):
        p = at[alive] + start
        key = _hashes(sums, p, np.minimum(p + token, at[alive] + length))
        order = np.lexsort((key, group))
        alive, group, key = alive[order], group[order], key[order]
        new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])) if len(order) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        keep = np.bincount(group, minlength=1)[group] > 1
        alive, group = alive[keep], group[keep]
    flags = np.zeros(total, bool)
    flags[alive] = True
    return np.split(flags, np.cumsum(n_windows)[:-1]) if len(texts) else []


def _flag_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _segment_rows(docs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    def run(batch: pd.DataFrame) -> pd.DataFrame | None:
        frames, held, size = [], [], 0

        def flush():
            nonlocal size
            piece, lo, hi, at, g, whole = segments([h[2] for h in held], length, gram)
            row, start = (np.array([h[k] for h in held], np.int64)[piece] for k in (0, 1))
            if len(piece):
                frames.append(batch[["id", "fp"]].iloc[row].assign(lo=lo + start, hi=hi + start, at=at - lo, gram=g, whole=whole))
            held.clear()
            size = 0

        for i, text in enumerate(batch["text"]):
            for start in range(0, max(len(text) - length + 1, 0), PIECE):
                held.append((i, start, text[start:start + PIECE + length - 1]))
                size += len(held[-1][2])
                if size >= PIECE - length:
                    flush()
        if held:
            flush()
        return pd.concat(frames) if frames else None

    return in_batches(docs, run, f"id {kind}, fp long, lo long, hi long, at int, gram long, whole long")


def _by_document(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Join of the documents with one row per document of interest, broadcast if small."""
    other = rows.withColumnsRenamed({"id": "other_id", "fp": "other_fp"})
    if rows.count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    return docs.join(other, docs["id"].eqNullSafe(other["other_id"]) & (docs["fp"] == other["other_fp"]), how).drop("other_id", "other_fp")


def _suffixes(docs: DataFrame, open_segments: DataFrame, kind: str, length: int) -> DataFrame:
    """The suffix at each anchor up to the end of its segment, and the segment's bytes before it."""
    own = staged(open_segments.groupBy("id", "fp").agg(F.collect_list(F.struct("lo", "hi", "at", "gram", "known")).alias("own")), "open-documents")

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, fp, text, own in zip(batch["id"], batch["fp"], batch["text"], batch["own"]):
            for s in own:
                mid = s["lo"] + s["at"]
                out.append((key, fp, s["lo"], s["gram"], s["known"], text[s["lo"]:mid], text[mid:s["hi"] + length]))
        return pd.DataFrame(out, columns=["id", "fp", "lo", "gram", "known", "left", "suffix"])

    joined = _by_document(docs, own, "inner").select("id", "fp", "text", "own")
    return in_batches(joined, cut, f"id {kind}, fp long, lo long, gram long, known boolean, left binary, suffix binary")


def _search_buckets(suffixes: DataFrame, kind: str, length: int, group_bytes: int) -> DataFrame:
    """Repeated windows found inside buckets (text null), and the rows whose anchor text may reach beyond (with text)."""
    fields = f"id {kind}, fp long, lo long, hi long, known boolean, at int, text binary"
    columns = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, ready, out = [], [], []
        state = {"gram": None, "first": True, "open": False, "group": 0, "ready": 0}

        def resolve():
            for row, flags in zip(ready, repeated([r.left + r.suffix for r in ready], length)):
                if not row.known:
                    out.extend((row.id, row.fp, row.lo + a, row.lo + b, False, 0, None) for a, b in _flag_runs(flags))
            ready.clear()
            state["ready"] = 0

        def close(at_end: bool):
            # The first and the last anchor text of a bucket may be shared with its neighbours.
            if state["first"] or at_end or state["open"]:
                out.extend((r.id, r.fp, r.lo, r.lo + len(r.left) + len(r.suffix) - length, r.known, len(r.left), r.left + r.suffix) for r in group)
            elif len(group) > 1:
                if state["ready"] + state["group"] > PIECE:
                    resolve()
                ready.extend(group)
                state["ready"] += state["group"]
            group.clear()
            state["group"] = 0

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.gram != state["gram"]:
                    if state["gram"] is not None:
                        close(False)
                        state["first"] = False
                    state["gram"], state["open"] = row.gram, False
                group.append(row)
                state["group"] += len(row.left) + len(row.suffix)
                if state["group"] >= group_bytes:
                    state["open"] = True
                    close(False)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        if state["gram"] is not None:
            close(True)
        if ready:
            resolve()
        if out:
            yield pd.DataFrame(out, columns=columns)

    ordered = suffixes.repartitionByRange("suffix").sortWithinPartitions("suffix")
    return ordered.mapInPandas(run, fields)


def _search_boundaries(rows: DataFrame, kind: str, length: int, group_bytes: int) -> DataFrame:
    """Repeated windows among rows of different buckets, as ranges of window starts.

    A row's windows are cut into slices at fixed distances from the anchor. All windows of a slice hold its core, so equal
    windows have equal cores, and rows meet by the hash of the core: far fewer than share an anchor text. What is still
    too large for a task (more than ``group_bytes`` of different texts with one core) goes on as window digests.
    """
    fields = f"id {kind}, fp long, known boolean, lo long, core long, text binary"
    columns, width = [f.split()[0] for f in fields.split(", ")], max(1, length // 6)

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples(index=False):
            sums = _sums(np.frombuffer(r.text, np.uint8))
            last = len(r.text) - length
            for first in range(r.at + -r.at // width * width, last + 1, width):
                a, b = max(first, 0), min(first + width - 1, last)
                core = _hashes(sums, np.array([first + width - 1]), np.array([first + length]))
                out.append((r.id, r.fp, r.known, r.lo + a, core.astype(np.int64)[0], r.text[a:b + length]))
        return pd.DataFrame(out, columns=columns)

    slices = staged(in_batches(rows, cut, fields), "boundary-slices")
    # Copies of a slice collapse before the shuffle: one is searched, and known to repeat.
    single = slices.groupBy("core", "text").agg(F.count("*").alias("n"), F.min(F.struct("lo", "fp", "id")).alias("first"), F.max("known").alias("known"))
    searched = staged(single.select("core", "text", "first.*", (F.col("known") | (F.col("n") > 1)).alias("known")), "boundary-search")
    sizes = searched.groupBy("core").agg(F.sum(F.length("text")).alias("size"), F.count("*").alias("n")).where("n > 1")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, size, core, out = [], 0, None, []

        def resolve():
            for row, flags in zip(ready, repeated([r.text for r in ready], length)):
                if not row.known:
                    out.extend((row.id, row.fp, row.lo + a, row.lo + b) for a, b in _flag_runs(flags))
            ready.clear()

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.core != core:
                    core = row.core
                    # Groups stay whole: each has at most group_bytes.
                    if size + row.size > PIECE:
                        resolve()
                        size = 0
                    size += row.size
                ready.append(row)
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=["id", "fp", "lo", "hi"])
                out.clear()
        resolve()
        if out:
            yield pd.DataFrame(out, columns=["id", "fp", "lo", "hi"])

    small = searched.join(sizes.where(F.col("size") <= group_bytes), "core").repartition("core").sortWithinPartitions("core")
    inside = small.mapInPandas(search, f"id {kind}, fp long, lo long, hi long")
    # Every copy of a slice that others have repeats as a whole.
    copies = slices.where(~F.col("known")).join(single.where("n > 1").select("core", "text"), ["core", "text"], "left_semi")
    whole = copies.select("id", "fp", "lo", (F.col("lo") + F.length("text") - length).alias("hi"))
    large = searched.join(sizes.where(F.col("size") > group_bytes), "core", "left_semi").select("id", "fp", "lo", "known", "text")
    return inside.unionByName(whole).unionByName(_search_digests(large, kind, length))


def _search_digests(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Repeated windows by digests in a grouped aggregation, which no size of group overloads."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for i, text in enumerate(batch["text"]):
            data, at = np.frombuffer(text, np.uint8), np.arange(len(text) - length + 1)
            digests = [_hashes(_sums(data, w), at, at + length, w).astype(np.int64) for w in (0, 1)]
            frames.append(batch[["id", "fp", "known"]].iloc[np.full(len(at), i)].assign(p=at + batch["lo"].iloc[i], d1=digests[0], d2=digests[1]))
        return pd.concat(frames)

    windows = staged(in_batches(rows, run, f"id {kind}, fp long, known boolean, p long, d1 long, d2 long"), "boundary-windows")
    twice = windows.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.where(~F.col("known")).join(twice, ["d1", "d2"], "left_semi").select("id", "fp", F.col("p").alias("lo"), F.col("p").alias("hi"))


def _merged(intervals: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM,
                   group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: ``id_column``, ``n_bytes``, ``runs`` (removed byte ranges as flat start, stop pairs) and ``kept`` (the
    remaining bytes).

    A byte goes if a string of ``length`` bytes that also starts anywhere else, in any document, covers it; every copy goes. Strings
    don't cross documents and are judged on the input. Texts are UTF-8 bytes, so ``kept`` may cut characters.

    Null and empty texts and texts shorter than ``length`` keep everything. Null ids are ids of their own. Repeated rows are copies
    of each other. Very long texts are read in overlapping pieces. Other columns aren't read. An empty table gives an empty table.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), fingerprint(text_column).alias("fp"), utf8(text_column).alias("text"))
    bound_batches(docs.sparkSession)
    every = staged(_segment_rows(rows, kind, length, gram), "segments")
    # Written first, so that the joins get exchanges of their own and the planner can split an anchor text with very many rows.
    shared = staged(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared-grams")
    candidates = staged(every.join(shared, "gram", "left_semi"), "shared-anchors")
    groups = staged(candidates.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("lo", "hi", "at", "id", "fp")).alias("first")), "segment-groups")
    copies = candidates.join(groups.where("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").select("id", "fp", "lo", "hi")
    mixed = staged(groups.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"), "mixed-grams")
    open_segments = groups.join(mixed, "gram", "left_semi").select("gram", "first.*", (F.col("n") > 1).alias("known"))
    found = staged(_search_buckets(_suffixes(rows, open_segments, kind, length), kind, length, group_bytes), "bucket-search")
    across = _search_boundaries(found.where("text IS NOT NULL").select("id", "fp", "lo", "known", "at", "text"), kind, length, group_bytes)
    inside = found.where("text IS NULL").select("id", "fp", "lo", "hi")

    def join_runs(batch: pd.DataFrame) -> pd.DataFrame:
        # Ranges of window starts become byte ranges; touching ones join.
        return batch[["id", "fp"]].assign(runs=[_merged([(s["lo"], s["hi"] + length) for s in own]) for own in batch["own"]])

    spans = copies.unionByName(inside).unionByName(across)
    # A document's ranges are bounded by its length.
    runs = staged(in_batches(spans.groupBy("id", "fp").agg(F.collect_list(F.struct("lo", "hi")).alias("own")), join_runs,
                             f"id {kind}, fp long, runs array<long>"), "removed-runs")

    def keep(batch: pd.DataFrame) -> pd.DataFrame:
        kept, spans = [], []
        for text, own in zip(batch["text"], batch["runs"]):
            own = [] if own is None else list(own)
            edges = [0, *own, len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append(own)
        return pd.DataFrame({"id": batch["id"], "n_bytes": list(map(len, batch["text"])), "runs": spans, "kept": kept})

    joined = _by_document(rows, runs, "left").select("id", "text", "runs")
    return in_batches(joined, keep, f"id {kind}, n_bytes long, runs array<long>, kept binary").withColumnRenamed("id", id_column)


def digest(result: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Figures of ``remove_repeats`` per document, and whether anything was removed."""
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return result.select(id_column, "n_bytes", removed.alias("n_removed"), (F.size("runs") / 2).cast("long").alias("n_spans"),
                         F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).alias("has_repeats"))
