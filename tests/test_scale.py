"""Hot keys against brute force, and the shape of the plans."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.operators import consensus, dataset, explain, jobs, lsh, report, score, similarity
from codelake.operators.rank import hash_rank, top_per_group
from codelake.plans import QUERIES


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture(scope="module")
def hot(spark):
    """600 rows, a third of them in one group."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(50)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "id long, k string, v long").repartition(4)


def test_top_per_group(hot):
    rows, df = hot
    top = top_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 3)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    want = {r for g in groups.values() for r in sorted(g, key=lambda r: (-r[2], r[0]))[:3]}
    assert plan(top).count("WindowGroupLimit") == 2
    assert {(r.id, r.k, r.v) for r in top.collect()} == want


def _key(i, seed):
    return hashlib.sha256(f"{i}:{seed}".encode()).hexdigest()


def test_hash_rank(hot):
    rows, df = hot
    groups = defaultdict(list)
    for i, k, _ in rows:
        groups[k].append(i)
    want = {i: n for ids in groups.values() for n, i in enumerate(sorted(ids, key=lambda i: _key(i, 7)), 1)}
    assert {r.id: r["rank"] for r in hash_rank(df, "id", ["k"], 7).collect()} == want
    order = sorted((r[0] for r in rows), key=lambda i: _key(i, 42))
    assert {r.id: r["position"] for r in dataset.shuffle_rows(df, "id").collect()} == {i: n for n, i in enumerate(order, 1)}
    assert {r.id for r in dataset.row_cap(df, "id", 37).collect()} == set(order[:37])


def test_dedup_of_many_copies(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, code string").repartition(5)
    got = {r.code: r.id for r in dataset.dedup_keep_first(df, "code", [F.asc("id")]).collect()}
    assert got["same"] == 1 and len(got) == 101


def test_balanced_and_split(spark):
    rows = [(i, int(i % 5 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int")
    counts = dict(dataset.balanced_sample(df, "id", 120).groupBy("label").count().collect())
    assert counts == {0: 60, 1: 60}
    assert dataset.balanced_sample(df.where("label = 1"), "id", 120).count() == 0
    split = {(r.label, r.split): r["count"] for r in dataset.stratified_split(df, "id").groupBy("label", "split").count().collect()}
    assert split == {(0, "test"): 40, (0, "val"): 40, (0, "train"): 320, (1, "test"): 10, (1, "val"): 10, (1, "train"): 80}


@pytest.mark.parametrize("bucket", ["hour", "day", "year"])
def test_state_steps_with_a_hot_job(spark, bucket):
    rng = random.Random(2)
    states = ["PENDING", "IN_PROGRESS", "SANDBOXING", "VERIFIED", "FAILED"]
    rows = [(i, "hot" if i % 3 == 0 else f"j{i % 7}", 1_700_000_000 + rng.randrange(400_000), rng.choice(states)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, job_id string, s long, status string").withColumn("event_ts", F.timestamp_seconds("s"))
    want, last, tries = {}, {}, defaultdict(int)
    for i, job, _, status in sorted(rows, key=lambda r: (r[2], r[0])):
        tries[job] += status == "SANDBOXING"
        want[i] = (last.get(job), (last.get(job) or "", status) in jobs.STEPS, tries[job], tries[job] > 3)
        last[job] = status
    got = {r.event_id: (r.previous, r.legal, r.attempt, r.exhausted) for r in jobs.state_steps(df, bucket=bucket).collect()}
    assert got == want
    # Two parts in order give the same steps as one.
    cut = 1_700_200_000
    first, second = df.where(F.col("s") < cut), df.where(F.col("s") >= cut)
    carried = jobs.state_steps(second, jobs.states_after(first), bucket).collect()
    assert all(want[r.event_id] == (r.previous, r.legal, r.attempt, r.exhausted) for r in carried)


def test_nearest_rows_cross_labels_and_blocks(spark, monkeypatch):
    """Query rows meet all rows: neighbours under other labels, ties by id, zero vectors, several blocks and pieces."""
    for name, size in (("BLOCK", 3), ("QUERIES_AT_ONCE", 2), ("ROWS_AT_ONCE", 16)):
        monkeypatch.setattr(similarity, name, size)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 4) for i in range(200)]
    rows += [(200 + i, rows[20][1], 3) for i in range(30)] + [(300, [0.0] * 6, 1), (310, None, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {}
    for r in similarity.nearest_rows(df.where("vec_id % 20 = 0"), df, 12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.cosine_similarity))
    known = {r.vec_id: r.embedding for r in df.collect() if r.vec_id is not None and r.embedding is not None}
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in known.items()}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(known[a], known[b])) / (norm[a] * norm[b]), 6) + 0.0 if norm[a] * norm[b] else 0.0

    want = {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted((-cosine(q, i), i) for i in known if i != q)[:12])] for q in known if q % 20 == 0}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert [i for _, i, _ in sorted(got[20])] == list(range(200, 212))
    assert similarity.nearest_rows(df.limit(0), df, 3).count() == 0 == similarity.nearest_rows(df, df.limit(0), 3).count()


@pytest.mark.parametrize("structured", [False, True])
def test_index_search_recall(spark, monkeypatch, structured):
    """A third of the vectors in one place, blocks of a few rows: the recall target holds, and close neighbours need few buckets."""
    monkeypatch.setattr(lsh, "BLOCK_ROWS", 64)
    monkeypatch.setattr(lsh, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    points = [centres[i % 40] + rng.normal(size=24) * 0.15 if structured else rng.normal(size=24) for i in range(1500)]
    hot = rng.normal(size=24)
    points += [hot + rng.normal(size=24) * 0.05 for _ in range(700)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(5000, [0.0] * 24), (5001, None), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    index, asked = lsh.build_index(df, rows_per_bucket=16), df.where("vec_id % 20 = 0")
    found, exact = lsh.search(index, asked, 10), similarity.nearest_rows(asked, df, 10)
    assert index.count() == 2201 and index.first().bits == 8
    result = lsh.recall(found, exact).first()
    assert result.neighbours == 10 * result.queries and result.found >= 0.9 * result.neighbours
    # What is found has its exact similarity and rank order.
    both = found.join(exact.withColumnRenamed("cosine_similarity", "c").drop("rank"), ["query_id", "vec_id"])
    assert both.where("cosine_similarity <> c").count() == 0 and both.count() == result.found
    per_query = [r["rank"] for r in found.where("query_id = 20").orderBy(F.desc("cosine_similarity"), "vec_id").collect()]
    assert per_query == list(range(1, 11))


def test_index_reads_few_buckets_of_close_neighbours():
    plane = lsh.directions(32, 12)
    rng = np.random.default_rng(1)
    share = {}
    for c in (0.2, 0.99):
        sizes, hits = [], 0
        for _ in range(200):
            q = rng.normal(size=32)
            q /= np.linalg.norm(q)
            g = rng.normal(size=32)
            g -= q * (g @ q)
            near = c * q + np.sqrt(1 - c * c) * g / np.linalg.norm(g)
            found = lsh.likely_buckets(q @ plane, c, 32, 0.9)
            assert len(found) == len(set(found.tolist()))
            sizes.append(len(found))
            hits += int(lsh.buckets_of((near @ plane)[None, :])[0]) in set(found.tolist())
        share[c] = np.mean(sizes) / (1 << 12)
        assert 0.82 <= hits / 200 <= 0.97
    assert share[0.99] < 0.01 < 0.3 < share[0.2]


def test_index_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert lsh.nearest_by_index(df.limit(0), df, 2).count() == 0 == lsh.nearest_by_index(df, df.limit(0), 2).count()
    assert [(r.query_id, r.vec_id) for r in lsh.nearest_by_index(df, df.where("vec_id = 1"), 5).orderBy("rank").collect()] == [(1, 2), (1, 3)]


def test_similar_topk_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(8)], 0 if i % 3 else i % 4) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = similarity.similar_topk(df, similarity.centroids(df, "label"), 4, "label").collect()
    for label in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == label]
        mean = [sum(v[p] for _, v, _ in mine) / len(mine) for p in range(8)]
        cos = lambda v: sum(a * b for a, b in zip(v, mean)) / (sum(a * a for a in v) ** .5 * sum(b * b for b in mean) ** .5)
        want = sorted(mine, key=lambda r: (-round(cos(r[1]), 6), r[0]))[:4]
        assert {r.vec_id for r in got if r.label == label} == {r[0] for r in want}


def test_heatmap_and_line_scores(spark):
    att = spark.createDataFrame([(1, 0, 0, "<s>", 0, 0, 5.0), (1, 0, 1, "a", 0, 5, 1.0), (1, 0, 2, "b", 6, 11, 4.0), (1, 0, 3, "<pad>", 0, 0, 0.0)],
                                "snippet_id long, head int, token_idx int, token string, tok_start int, tok_end int, weight double")
    cls = explain.cls_attention(att)
    heat = {r.token: (r.weight, r.importance) for r in explain.heatmap(cls).collect()}
    assert heat == {"a": (0.1, 0.2), "b": (0.4, 0.8)}
    code = spark.createDataFrame([(1, "line1\nline2\nline3")], "snippet_id long, code string")
    assert {r.line_number: r.score for r in explain.line_attention(att, code).collect()} == {1: 0.6, 2: 0.4, 3: 0.0}
    sure = code.withColumn("confidence", F.lit(0.9))
    assert [r.line_number for r in explain.top_lines(att, sure).orderBy("line_number").collect()] == [1, 2]
    assert explain.top_lines(att, code.withColumn("confidence", F.lit(0.4))).count() == 0


def test_lines_of_tokens_against_a_plain_version(spark):
    """Every kind of line end, blank and null code, offsets on, at and beyond the ends, padding, snippets without tokens."""
    rng = random.Random(9)
    codes = ["".join(rng.choice(["ab", "c", " ", "\n", "\r\n", "\r", "\x0b", "\u2028"]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "\n", "x\n"]
    snippets = [(i, c, rng.choice([0.4, 0.5, 0.9])) for i, c in enumerate(codes)]
    rows = [(i, h, t, f"t{t}", start, start + 1, rng.randrange(5) / 4) for i, c, _ in snippets if i % 7 for t in range(rng.randrange(1, 9))
            for start in [rng.choice([0, -1, rng.randrange(60)])] for h in (0, 1)]
    rows += [(i, h, 99, "<pad>", 0, 0, 1.0) for i in range(1, 6) for h in (0, 1)]
    att = spark.createDataFrame(rows, "snippet_id long, head int, token_idx int, token string, tok_start int, tok_end int, weight double").repartition(3)
    frame = spark.createDataFrame(snippets, "snippet_id long, code string, confidence double").repartition(3)
    lines, top = {}, set()
    for i, code, confidence in snippets:
        own = (code or "").splitlines()
        text = "\n".join(own)
        tokens = {}
        for r in rows:
            if r[0] == i:
                tokens.setdefault((r[2], r[4], r[5]), []).append(r[6])
        means = {k: sum(v) / len(v) for k, v in tokens.items()}
        total = sum(means[k] for k in sorted(means))
        units = [0] * len(own)
        for (t, start, stop), m in means.items():
            if not (start == 0 and stop == 0 and t > 0) and own:
                at = 0 if start < 0 or start > len(text) else text[:start].count("\n")
                units[at] += math.floor((m / total if total > 0 else m) * 10 ** 10 + 0.5)
        lines |= {(i, n): u for n, u in enumerate(units, 1)}
        order = sorted(range(len(own)), key=lambda n: (-units[n], n))
        solid = [n for n in order if len(own[n].strip()) > 1]
        strong = [n for n in solid if units[n] > 1_500_000_000]
        if confidence >= 0.5:
            top |= {(i, n + 1) for n in strong or [n for n in order[:2] if n in solid]}
    assert {(r.snippet_id, r.line_number): r.units for r in explain.line_attention(att, frame).collect()} == lines
    assert {(r.snippet_id, r.line_number) for r in explain.top_lines(att, frame).collect()} == top
    text = plan(explain.with_top_lines(frame, explain.snippet_tokens(att)))
    assert text.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("key, most", [("finding_projection", 3), ("line_attention", 3), ("cls_attention", 1), ("heatmap_importance", 1)])
def test_code_and_tokens_are_dealt_once(spark, sf_dir, key, most):
    """Exchanges with broadcast by size off."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(QUERIES[key](spark, sf_dir)).count("Exchange hashpartitioning") <= most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_consensus(spark):
    df = spark.createDataFrame([(1, "pickle.loads(x)", 0.9), (2, "pickle.loads(x)", 0.2), (3, "x = 1", 0.8), (4, "x = 1", 0.2)],
                               "snippet_id int, code string, ml_prob double")
    got = {r.snippet_id: (r.vulnerable, r.consensus_score, r.final_cwe) for r in consensus.consensus(df).collect()}
    assert got == {1: (True, 0.9, "CWE-502"), 2: (True, 0.85, "CWE-502"), 3: (True, 0.8, "CWE-20"), 4: (False, 0.9, None)}
    issues = consensus.consensus_issues(consensus.consensus(df)).groupBy("snippet_id").count().collect()
    assert dict(issues) == {1: 2, 2: 2}


def test_report_of_a_clean_repository(spark):
    pred = spark.createDataFrame([("r", "a.py", False, "None", 0.1)], "repo_id string, file_path string, vulnerable boolean, severity string, confidence double")
    scores = score.repo_scores(pred)
    none = spark.createDataFrame([], "repo_id string, snippet_id long, rank int, type string, severity string, predicted_cwe string, owasp string, "
                                     "file string, function string, lines string, confidence double, reason string, recommendation string")
    text = report.report_markdown(scores, none, score.compliance_set(none), product="Acme").first().report
    assert text.startswith("# Acme Executive Security Report") and "Security Grade:** `A`" in text
    assert "No regulatory compliance violations" in text and "No vulnerabilities identified" in text and "Maintain system updates" in text


def test_code_is_moved_for_one_join(spark, sf_dir):
    """The fix history is joined from the commits' side: the code of the samples meets one join only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = QUERIES["select_distinct"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    code = next(i for i, line in enumerate(tree) if "int f" in line)
    above, at = 0, depth(tree[code])
    for line in reversed(tree[:code]):
        if depth(line) < at:
            at = depth(line)
            above += "Join" in line
    assert above == 1


def test_early_stop(spark):
    rows = spark.createDataFrame([("r", i, f) for i, f in enumerate([0.1, 0.3, 0.2, 0.25, 0.9], 1)], "run string, epoch int, val_f1 double")
    got = [(r.best_f1, r.no_improvement, r.after_stop) for r in jobs.early_stop(rows, "run").orderBy("epoch").collect()]
    assert got == [(0.1, 0, False), (0.3, 0, False), (0.3, 1, False), (0.3, 2, False), (0.9, 0, True)]


@pytest.mark.parametrize("key", ["predict_record", "finding_projection", "repo_risk_score", "training_set", "dashboard_kpis", "kg_related",
                                 "embedding_similarity", "similar_topk", "line_attention", "webhook_registry_join", "cvefixes_left_cwe"])
def test_no_cross_joins(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_rules_run_once_and_columns_are_pruned(spark, sf_dir):
    text = plan(QUERIES["vulnerable_only"](spark, sf_dir))
    assert text.count("pickle\\.loads|pickle\\.load") == 1
    assert "props" not in text


def test_tokens_are_not_broadcast_by_an_estimate(spark, sf_dir):
    """Tokens are made from narrow rows, so their estimated size says nothing; a join with them is no broadcast."""
    from codelake.operators import explain as explainer
    from codelake.sources.fixtures import view
    snippets = view(spark, sf_dir, "snippets").select("snippet_id", "code")
    joined = explainer.with_lines(snippets, explainer.snippet_tokens(view(spark, sf_dir, "attention")))
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_short_and_long_code_have_the_same_sums(spark, monkeypatch):
    """Lines of short code are summed directly, those of long code looked up."""
    from codelake.operators import explain as explainer
    code = spark.createDataFrame([(1, "a\nbb\n\nccc"), (2, ""), (3, None), (4, "\n" * 40 + "x")], "snippet_id long, code string")
    attention = spark.createDataFrame([(s, h, t, f"t{t}", 3 * t, 3 * t + 2, float(1 + (s * 7 + h + t * t) % 5)) for s in (1, 2, 4) for h in (0, 1) for t in range(9)],
                                      "snippet_id long, head int, token_idx int, token string, tok_start int, tok_end int, weight double")
    found = []
    for most in (0, 16, 100):
        monkeypatch.setattr(explainer, "SHORT", most)
        rows = explainer.with_line_units(code, explainer.snippet_tokens(attention)).select("snippet_id", "line_units").collect()
        found.append({r.snippet_id: r.line_units for r in rows})
    assert found[0] == found[1] == found[2] and len(found[0][4]) >= 41 and sum(found[0][1]) > 0
