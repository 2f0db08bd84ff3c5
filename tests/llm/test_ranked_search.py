"""Ranked search against a plain version that scores every item with every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import ranked_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ba", "de", "fi", "go", "é", "7")]


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    total, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for name, text in set(items):
        found = []
        for (doc, bag), n in zip(bags, sizes):
            norm = 25 + 75 * n * total // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * norm))
                        for t in terms(text) if bag[t])
            if score > 0:
                found.append((doc is None, doc or 0, doc, score))
        found.sort(key=lambda x: (-x[3], x[:2]))
        out += [(name, rank, x[2], x[3]) for rank, x in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(WORDS).title() if rng.random() < 0.2 else rng.choice(WORDS) for _ in range(n))
    docs = [(i, some(rng.randrange(1, 60))) for i in range(150)]
    docs += [(200 + i, docs[0][1]) for i in range(40)] + [(3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (None, None), (500, None), (501, ""), (502, " ,;"),
                                                           (503, some(30_000)), (504, "kaÉ ＡＢ naïve"), (505, "rare")]
    items = [(i, some(rng.randrange(1, 25))) for i in range(40)]
    items += [(100, items[0][1]), (101, "rare rare RARE"), (102, None), (103, ""), (104, "unknownterm"), (105, docs[7][1]), (105, docs[7][1]), (105, "kaba"),
              (None, "kaba lode"), (106, "kaÉ ＡＢ"), (107, " ".join(WORDS * 3))]
    return docs, items


@pytest.mark.parametrize("index_bytes, graph_bytes, sums", [(16 << 20, 1 << 20, 48 << 20), (600, 150, 4096)])
def test_search(spark, tables, monkeypatch, index_bytes, graph_bytes, sums):
    monkeypatch.setattr(ranked_search, "SUM_BYTES", sums)
    docs, items = tables
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).repartition(3)
    wide = rows.withColumns({c: F.lit("x") for c in ("item", "score", "rank", "_terms")})
    asked = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("x") for c in ("item", "block", "doc_id")})
    got = ranked_search.search(wide, asked, index_bytes=index_bytes, graph_bytes=graph_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, items = tables
    full = spark.createDataFrame([(i, t, None, None, None) for i, t in docs[:5]], DOCS)
    for d, q in ((full, spark.createDataFrame([], ITEMS)), (spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)),
                 (spark.createDataFrame([(1, None, None, None, None)], DOCS), spark.createDataFrame(items, ITEMS))):
        assert ranked_search.search(d, q).collect() == []


def test_graph_shares_what_items_share():
    """Terms of the same items are one class; items with the same beginning share its nodes; equal items share all."""
    holders = {"a": [0, 1, 2, 3], "b": [0, 1, 2, 3], "c": [0, 1], "d": [2, 3], "e": [0], "f": [1]}
    by_items = {}
    for number, (term, items) in enumerate(holders.items()):
        by_items.setdefault(tuple((i, 1) for i in items), []).append(number)
    graph = ranked_search.mine([(list(k), v) for k, v in by_items.items()], 6)
    # abc e, abc f, ab d, ab d: 10 steps of single items, 5 nodes.
    assert graph.n_classes == 5 and graph.nodes == 5 and graph.steps == 10
    parts = np.arange(1, 7) * 10
    scores = ranked_search.score(graph, np.zeros(6, np.int64), graph.class_of, parts, 1)[:, 0]
    assert dict(zip(graph.items.tolist(), scores.tolist())) == {0: 10 + 20 + 30 + 50, 1: 10 + 20 + 30 + 60, 2: 10 + 20 + 40, 3: 70}
