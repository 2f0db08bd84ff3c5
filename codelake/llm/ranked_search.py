"""Ranked lexical search of many queries at once (operator 12), by evaluating what they share once.

Terms that stand in exactly the same items, equally often, form one class: a set of terms that items share. An item is the
list of its classes, the most shared first, and lists with a common beginning share the nodes of that beginning, so all
items make one graph in which sums run from the shared to the own. For a batch of documents each class's scores are summed
once per document, each node adds one class to its parent's sums, and an item's scores are those of its last node. A task
keeps the best documents per item only; nothing else of the scores is moved.

Documents are read once into a forward index of the terms that items hold, in segments of a few megabytes of text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import top_per_group
from ..session import staged
from .common import bound_batches, utf8

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Lower-cases A-Z; every byte outside terms becomes a blank. Bytes from 0x80 on belong to terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BEST = 10
# The forward index is made for items of about so many bytes at once, whose terms a worker can hold, and searched for items
# of about so many bytes at once, whose graph it can hold. More items take more passes.
INDEX_BYTES, GRAPH_BYTES = 16 << 20, 1 << 20
# Sums of a batch that a worker holds at once.
SUM_BYTES = 48 << 20
NO_ID = np.iinfo(np.int64).max

SEGMENT = "doc_ids binary, lengths binary, places binary, terms binary, counts binary, n_docs long, n_terms long"
SCORED = "item long, doc_id long, score long"


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Segments of (document, term, count) for the vocabulary's terms, with every document's length in terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        size = len(known) + 1
        for batch in batches:
            if not len(batch):
                continue
            lengths, found = np.zeros(len(batch), np.int64), []
            for i, text in enumerate(batch["text"]):
                words = text.translate(TERM_BYTES).split()
                lengths[i] = len(words)
                ids = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                found.append(ids[ids >= 0] + i * size)
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"doc_ids": [batch["doc_id"].to_numpy(np.int64).tobytes()], "lengths": [lengths.tobytes()],
                                "places": [(keys // size).astype(np.int32).tobytes()], "terms": [(keys % size).astype(np.int32).tobytes()],
                                "counts": [counts.astype(np.int64).tobytes()], "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())})

    return docs.mapInPandas(run, SEGMENT)


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the vocabulary's terms stands."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch["terms"]:
                total += np.bincount(np.frombuffer(terms, np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    sums = index.select("terms").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in sums.toLocalIterator():  # a row per term of the vocabulary at most
        counts[row.term] = row.n
    return counts


@dataclass
class Graph:
    """Items as paths over classes of terms. Levels hold the nodes of one depth: parent, class and times, and the items that end there."""

    class_of: np.ndarray
    n_classes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    ends: list[tuple[np.ndarray, np.ndarray]]
    items: np.ndarray
    steps: int = field(default=0)

    @property
    def nodes(self) -> int:
        return sum(len(level[0]) for level in self.levels)


def mine(classes: list[tuple[list[tuple[int, int]], list[int]]], vocabulary_size: int) -> Graph:
    """The graph of ([(item, times), ...], [term, ...]) classes: terms with equal lists of items."""
    classes = sorted(classes, key=lambda c: (-len(c[0]), min(c[1])))
    class_of = np.full(vocabulary_size, -1, np.int64)
    paths: dict[int, list[tuple[int, int]]] = {}
    for number, (holders, terms) in enumerate(classes):
        class_of[terms] = number
        for item, times in holders:
            paths.setdefault(item, []).append((number, times))
    items = sorted(paths)
    levels: list[dict[tuple[int, int, int], int]] = []
    ends: list[list[tuple[int, int]]] = []
    for place, item in enumerate(items):
        node = 0
        for depth, (number, times) in enumerate(paths[item]):
            if depth == len(levels):
                levels.append({})
                ends.append([])
            node = levels[depth].setdefault((node, number, times), len(levels[depth]))
        ends[len(paths[item]) - 1].append((place, node))
    as_arrays = lambda rows, width: tuple(np.array(list(rows), np.int64).reshape(-1, width).T)
    return Graph(class_of, len(classes), [as_arrays(level, 3) for level in levels], [as_arrays(end, 2) for end in ends],
                 np.array(items, np.int64), sum(map(len, paths.values())))


class Best:
    """Per item the documents with the highest scores above 0, of equal ones those with the lowest ids."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, found, score = (np.concatenate(pair) for pair in ((self.item, item), (self.id, ids[doc]), (self.score, scores[item, doc])))
        order = np.lexsort((found, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[rank < self.k], item[rank < self.k]
        self.item, self.id, self.score = item, found[order], score[order]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[item[last]] = self.score[last]


def score(graph: Graph, places: np.ndarray, classes: np.ndarray, parts: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of all items (rows) for a batch of documents (columns): classes are summed once, then nodes add them up."""
    own = np.zeros((graph.n_classes, n_docs), np.int64)
    np.add.at(own, (classes, places), parts)
    out = np.zeros((len(graph.items), n_docs), np.int64)
    above = np.zeros((1, n_docs), np.int64)
    for (parent, number, times), (item, node) in zip(graph.levels, graph.ends):
        above = above[parent] + own[number] * times[:, None]
        out[item] = above[node]
    return out


def best_documents(index: DataFrame, graph: Graph, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """Up to ``k`` rows per item and task; ``total`` documents have terms, ``length`` in all."""
    shared = index.sparkSession.sparkContext.broadcast((graph, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, weights = shared.value
        best = Best(len(graph.items), k)
        widest = max((len(level[0]) for level in graph.levels), default=0)
        at_once = max(1, SUM_BYTES // (8 * (graph.n_classes + len(graph.items) + 2 * widest + 1)))
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, lengths = np.frombuffer(row.doc_ids, np.int64), np.frombuffer(row.lengths, np.int64)
                places, terms, counts = (np.frombuffer(x, kind) for x, kind in ((row.places, np.int32), (row.terms, np.int32), (row.counts, np.int64)))
                classes = graph.class_of[terms]
                places, terms, counts, classes = (x[classes >= 0] for x in (places, terms, counts, classes))
                norm = 25 + (75 * lengths * total) // length
                parts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[places]))
                for a in range(0, len(ids), at_once):
                    low, high = np.searchsorted(places, [a, a + at_once])
                    some = slice(low, high)
                    n = min(at_once, len(ids) - a)
                    best.add(score(graph, places[some] - a, classes[some], parts[some], n), ids[a:a + n])
        if len(best.item):
            yield pd.DataFrame({"item": graph.items[best.item], "doc_id": best.id, "score": best.score})

    return index.mapInPandas(run, SCORED)


def _terms(text: str):
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
           item_text: str = "text", index_bytes: int = INDEX_BYTES, graph_bytes: int = GRAPH_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: ``item_column``, ``rank`` (from 1), ``id_column`` and ``score``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with only A-Z lower-cased. A term's
    weight w is floor(1000 ln((2N+2)/(2df+1))) over N documents with terms; a document of n terms, of L in all, has
    m = 25 + 75nN div L; the score sums w (10^9 tf div (1000 tf + 8m)) over an item's terms, repeats included.

    Document ids are whole numbers; equal scores go by ascending id, a null id last. Null or empty texts have no terms and
    are no result. Repeated documents are ranked each. Items with the same id and text count once; items with the same id
    and different texts are ranked apart. Other columns, whatever their names, aren't read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    asked = items.select(F.col(item_column).alias("_name"), F.col(item_text).alias("_text")).distinct()
    asked = staged(asked.select("_name", _terms("_text").alias("_terms"), F.octet_length(F.coalesce(F.col("_text").cast("string"), F.lit(""))).alias("_size"),
                                F.monotonically_increasing_id().alias("item")), "items")
    size = asked.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first().n
    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(int(NO_ID))).alias("doc_id"), utf8(text_column).alias("text"))
    found = spark.createDataFrame([], SCORED + ", rank int")
    n_outer = max(1, -(-size // index_bytes))
    n_inner = max(1, -(-size // (n_outer * graph_bytes)))
    block = F.pmod(F.xxhash64("item"), F.lit(n_outer * n_inner))
    terms = asked.select("item", block.alias("block"), F.explode("_terms").alias("term")).groupBy("block", "item", "term").agg(F.count("*").alias("times"))
    terms = staged(terms, "item-terms")
    for outer in range(n_outer):
        mine_of = terms.where(F.col("block") % n_outer == outer)
        vocabulary = {row.term.encode(): i for i, row in enumerate(mine_of.select("term").distinct().collect())}  # of about index_bytes
        if not vocabulary:
            continue
        index = staged(forward_index(texts, vocabulary), "forward-index")
        total, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not length:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(n) + 1))) for n in document_counts(index, len(vocabulary))], np.int64)
        for inner in range(n_inner):
            holders = F.array_sort(F.collect_list(F.struct("item", "times")))
            classes = (mine_of.where(F.col("block") == outer + n_outer * inner).groupBy("term").agg(holders.alias("holders"))
                       .groupBy("holders").agg(F.collect_list("term").alias("terms")).collect())  # of about graph_bytes
            if classes:
                graph = mine([([(h.item, h.times) for h in c.holders], [vocabulary[t.encode()] for t in c.terms]) for c in classes], len(vocabulary))
                best = best_documents(index, graph, weights, total, length, k)
                found = found.unionByName(staged(top_per_group(best, ["item"], [F.desc("score"), F.asc("doc_id")], k), "best"))
    kind = docs.schema[id_column].dataType
    return found.join(asked.select("item", "_name"), "item").select(
        F.col("_name").alias(item_column), "rank", F.expr(f"nullif(doc_id, {NO_ID})").cast(kind).alias(id_column), "score")
