"""Every stage of the pipeline against a plain version of its decision, on its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from codelake.llm import near_dup, quality_rules
from codelake.session import staged
from test_operators import brute_leaks, brute_rules, near_dup_counts


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = corpus_pipeline.table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = staged(stage(spark, docs, sf_dir), "stage")
        out[name] = (docs.collect(), result.collect(), docs.columns, result.columns)
        docs = result
    return out


def test_stages(spark, sf_dir, stages):
    before, after, columns, kept = stages["quality rules"]
    assert kept == columns
    passed = {r.doc_id for r in before if not brute_rules(r.text)[-1]}
    assert {r.doc_id for r in after} <= passed and len(after) > 0.95 * len(passed) - 20

    before, after, columns, kept = stages["line dedup"]
    assert kept == columns
    pages, lines = Counter(r.source for r in before), Counter()
    for r in before:
        lines.update((r.source, x) for x in {x.strip(" \t\r\x0b\x0c") for x in r.text.split("\n")} if x)
    common = {k for k, n in lines.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" \t\r\x0b\x0c")) not in common) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)

    before, after, columns, kept = stages["near dedup"]
    assert kept == columns
    rows = [tuple(r) for r in before]
    factors = near_dup.cell_weights(near_dup_counts(rows))
    sets = {r.doc_id: s for r, (_, s) in zip(before, near_dup.shingles_of([r.text.encode() for r in before]))}
    share = defaultdict(set)
    for key, s in sets.items():
        for x in s.tolist():
            share[x].add(key)
    parent = {key: key for key in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for pair in {(a, b) for keys in share.values() for a in keys for b in keys if a < b}:
        if near_dup.similarity(sets[pair[0]], sets[pair[1]], factors) >= 0.8:
            a, b = sorted(map(find, pair))
            parent[b] = a
    assert {r.doc_id for r in after} == {find(key) for key in sets}

    before, after, columns, kept = stages["decontamination"]
    assert kept == columns
    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, sf_dir, "benchmark").collect()]
    assert {r.doc_id for r in after} == {w[0] for w in brute_leaks([(r.doc_id, r.text) for r in before], items) if not w[-1]}

    before, after, _, _ = stages["packing"]
    model = quality_rules.word_tokens(None).model
    total = sum(len(model.encode(w)) for r in before for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)) + len(before)
    assert sum(r.n_tokens for r in after) == total


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["packing"][1]))
