"""Exact dedup and the Merkle manifest against plain versions, on tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codelake.llm import exact_dedup, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [f"text  {i % 37}\n{'x' * (i % 5)}" for i in range(300)] + ["hot \t copy"] * 150 + ["hot copy"] * 50
    texts += [None, None, "", " ", "  \n", "long " * 40_000, "long\n" * 40_000, " ", "  ", "a\x0bb", "a b", "\U0001f600\nend"]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["hot", "hot", "b", None, "", "é", "z"]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7]] * 3 + [rows[320]] * 4 + [(7, "another text of the same id", "en", "hot", None), (None, "hot copy", None, "one", 1), (None, None, None, None, None)]
    rows.append((900, "alone", "en", "single", 5))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(x, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, x in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tracked", [4096, 2])
def test_exact_groups(docs, corpus, monkeypatch, tracked):
    monkeypatch.setattr(exact_dedup, "TRACKED", tracked)
    got = exact_dedup.exact_groups(docs.withColumns({c: F.lit("x") for c in ("_id", "_digest", "_row", "kept")}))
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(corpus)


def test_candidates_hold_the_frequent(spark):
    rows = spark.range(0, 200_000, 1, 40).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN 'warm' ELSE cast(id AS string) END AS _digest")
    found = [r._digest for r in exact_dedup.candidates(rows).collect()]
    assert {"hot", "warm"} <= set(found) and len(found) == len(set(found)) <= exact_dedup.TRACKED


def test_deduplicate(spark, docs, corpus):
    wide = docs.withColumns({c: F.lit("x") for c in ("_id", "_digest", "_first", "_keep_id", "_doc")})
    got = exact_dedup.deduplicate(wide)
    assert got.columns == wide.columns
    rows = [tuple(r)[:2] for r in got.collect()]
    assert sorted((x for x, _ in rows), key=str) == sorted((g[0] for g in brute_groups(corpus) if g[3]), key=str)
    assert all((i, t) in {r[:2] for r in corpus} for i, t in rows)


def test_exact_plan_has_no_python(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows):
    """Plain version: whole trees as lists, every proof read off them."""
    leaf_of = lambda r, text: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def proof(levels, place):
        out = []
        for nodes in levels[:-1]:
            start = place // 3 * 3
            out.append((nodes[start:place], nodes[place + 1:start + 3]))
            place //= 3
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for place, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = proof(trees[s], place) + proof(top, k)
            tampered = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            digest = leaf_of(r, r[1].replace("\n", "")) if tampered else own
            for left, right in path:
                digest = sha("".join([*left, digest, *right]))
            siblings = "".join(x for left, right in path for x in [*left, *right])
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(siblings), digest, siblings, digest == top[-1][0]))
    return sorted(out, key=str)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


@pytest.mark.parametrize("leaves, broadcast", [(50_000, 1 << 17), (40, 1 << 17), (7, 0)])
def test_manifest(docs, corpus, monkeypatch, leaves, broadcast):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "BROADCAST", broadcast)
    wide = docs.withColumns({c: F.lit("x") for c in ("leaf", "id", "part", "tree", "row", "idx")})
    got = merkle.manifest(wide, FIELDS, tampered(), with_proofs=True)
    want = brute_manifest(corpus)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 243, 244, 800])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"t{i}\n", None, "s", None) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), FIELDS, tampered(), with_proofs=True)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 30)
    rows = [(i, "t\n", None, f"s{i % 290}" if i % 290 else None, i) for i in range(700)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), FIELDS, tampered(), with_proofs=True)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_missing_is_the_least_union():
    """No node that follows from others is asked for, and the union serves all proofs."""
    for n in (1, 2, 5, 27, 100):
        for first in range(0, n, 3):
            for last in range(first, n, 7):
                want, known, level, size = set(), set(range(first, last + 1)), 0, n
                while size > 1:
                    runs = {k // 3 for k in known}
                    want |= {(level, c) for p in runs for c in range(3 * p, min(3 * p + 3, size)) if c not in known}
                    known, size, level = runs, -(-size // 3), level + 1
                got = list(merkle.missing(first, last, n))
                assert len(got) == len(set(got)) and set(got) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(none).collect() == [] and exact_dedup.deduplicate(none).collect() == []
    assert merkle.manifest(none, FIELDS, tampered()).collect() == []
