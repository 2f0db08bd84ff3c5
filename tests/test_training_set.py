"""The training set joined by slices: brute force, and what stays on disk."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codelake import fixed
from codelake.operators import dataset
from codelake.operators.rank import hash_rank
from codelake.session import FREE_SHUFFLES, staged_in_turn

FIELDS = ("label", "programming_language", "before_change", "cwe_id", "cvss3_base_score", "cvss3_base_severity")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (blocks.apply(i).getName() for i in range(blocks.size())) if n.startswith("shuffle_") and n.endswith(".data")}


@pytest.fixture(scope="module")
def rows():
    """Null and repeated keys, files without methods, commits without files, many copies of one code under other files, labels and CWEs."""
    rng = random.Random(5)
    pick = lambda *values: rng.choice(values)
    return {
        "commits": [(pick(*[f"c{i}"] * 8, None, "c1"),) for i in range(60)],
        "fixes": [(pick(f"v{rng.randrange(20)}", None), f"c{rng.randrange(70)}") for _ in range(120)],
        "cve": [(f"v{i % 18}", pick(None, 1.5, 9.8), pick(None, "LOW", "HIGH")) for i in range(22)],
        "cwe_classification": [(f"v{rng.randrange(18)}", pick(None, "CWE-79", "CWE-89")) for _ in range(15)],
        "file_change": [(pick(f"f{i}", f"f{i}", f"f{i // 2}", None), f"c{rng.randrange(70)}", pick("Python", " C ", None, "Go")) for i in range(300)],
        "method_change": [(pick(f"f{rng.randrange(300)}", f"f{rng.randrange(300)}", None),
                           pick(None, "", "x=1", "int hot() { return 1; }", *(f"{a}int f{rng.randrange(300)}() {{ return 2; }}{b}" for a, b in (("", ""), ("", ""), ("  ", "\n")))),
                           pick(" True ", "1", "False", None)) for _ in range(900)],
    }


@pytest.fixture(scope="module")
def tables(spark, rows):
    schema = {"commits": "hash string", "fixes": "cve_id string, hash string", "cve": "cve_id string, cvss3_base_score double, cvss3_base_severity string",
              "cwe_classification": "cve_id string, cwe_id string", "file_change": "file_change_id string, hash string, programming_language string",
              "method_change": "file_change_id string, code string, before_change string"}
    return {t: spark.createDataFrame(rows[t], schema[t]).repartition(3) for t in schema}


def unique_rows(rows):
    """(code, *FIELDS) by brute force."""
    first = lambda r: [(v is not None, v if v is not None else 0) for v in r]
    commits, names = {c for c, in rows["commits"] if c}, dict(fixed.LANGUAGE_TOKENS)
    known = [(h, w[1], c[1], c[2]) for v, h in rows["fixes"] if h in commits for c in rows["cve"] if c[0] == v
             for w in [w for w in rows["cwe_classification"] if w[0] == v] or [(v, None)]]
    files = [(f, language, *k[1:]) for f, h, language in rows["file_change"] for k in known if k[0] == h and f]
    by_file = {}
    for f, *rest in files:
        by_file.setdefault(f, set()).add(tuple(rest))
    best = {}
    for f, code, before in rows["method_change"]:
        for language, *known_by in by_file.get(f, ()) if code else ():
            language = (language or "").strip()
            text = f"{names.get(language, fixed.UNKNOWN_TOKEN)} {code.strip()}"
            row = (int((before or "").strip().lower() in ("true", "1")), language, before, *known_by)
            if len(text) >= 20 and (text not in best or first(row) < first(best[text])):
                best[text] = row
    return {(text, *row) for text, row in best.items()}


@pytest.mark.parametrize("slice_rows", [1_000_000, 200])
def test_slices_give_the_rows_of_brute_force(spark, rows, tables, monkeypatch, slice_rows):
    monkeypatch.setattr(dataset, "SLICE_ROWS", slice_rows)
    want = unique_rows(rows)
    got = dataset.unique_samples(tables).collect()
    assert len(got) == len(want) > 60 and {tuple(r[c] for c in ("code", *FIELDS)) for r in got} == want
    assert all(r.code_hash == hashlib.sha256(r.code.encode()).hexdigest() for r in got)
    assert sum("hot" in r.code for r in got) == len({r[2] for r in want if "hot" in r[0]}) > 1
    n = min(20, *(sum(r[1] == label for r in want) for label in (0, 1)))
    key = lambda text: hashlib.sha256(f"{text}:42".encode()).hexdigest()
    hashes = {label: sorted((hashlib.sha256(r[0].encode()).hexdigest() for r in want if r[1] == label), key=key)[:n] for label in (0, 1)}
    kept = dataset.training_set(tables, 40).collect()
    assert n > 5 and {r.position: r.code_hash for r in kept} == dict(enumerate(sorted(hashes[0] + hashes[1], key=key), 1))


def test_no_slice_leaves_shuffle_files(spark, tables, monkeypatch):
    """Shuffle files of all steps at once were many times the input; the last step's few rows may keep theirs."""
    monkeypatch.setattr(dataset, "SLICE_ROWS", 400)
    before = shuffle_files(spark)
    samples = dataset.unique_samples(tables)
    assert not shuffle_files(spark) - before and samples.count() > 60


def test_slices_share_no_code(tables, monkeypatch):
    monkeypatch.setattr(dataset, "SLICE_ROWS", 1)
    parts = [{r.code for r in part.select("code").collect()} for part in dataset.sample_slices(tables)]
    assert len(parts) == dataset.SLICES and sum(map(len, parts)) == len(set().union(*parts)) > 60


def test_keys_of_two_types(rows, tables, monkeypatch):
    """Equal keys of two types have different hashes; no row is lost."""
    monkeypatch.setattr(dataset, "SLICE_ROWS", 100)
    number = lambda t, kind: tables | {t: tables[t].withColumn("file_change_id", F.expr(f"cast(substring(file_change_id, 2) as {kind})"))}
    both = number("method_change", "int") | {"file_change": number("file_change", "double")["file_change"]}
    assert {tuple(r[c] for c in ("code", *FIELDS)) for r in dataset.unique_samples(both).collect()} == unique_rows(rows)


def test_an_empty_history(tables, monkeypatch):
    monkeypatch.setattr(dataset, "SLICE_ROWS", 1)
    none = tables | {"fixes": tables["fixes"].where("false")}
    assert dataset.unique_samples(none).count() == 0 and dataset.training_set(none).count() == 0
    assert dataset.unique_samples(tables | {"method_change": tables["method_change"].where("false")}).count() == 0


def test_frames_in_turn(spark):
    """Rows of all frames, by folder or not; Spark's setting is as before, also after an error."""
    frames = [spark.range(i, 90, 3).selectExpr("id", "cast(id % 4 as int) as part").groupBy("id", "part").count() for i in range(3)]
    before = spark.conf.get(FREE_SHUFFLES)
    stored = staged_in_turn(iter(frames), "frames", by="part")
    assert sorted(r.id for r in stored.collect()) == list(range(90)) and sorted(r.id for r in stored.where("part = 3").collect()) == list(range(3, 90, 4))
    assert "PartitionFilters: [isnotnull(part" in plan(stored.where("part = 3"))
    assert staged_in_turn(frames, "frames").count() == 90
    with pytest.raises(Exception, match="no such"):
        staged_in_turn([spark.range(9).select(F.raise_error(F.lit("no such")))], "frames")
    assert spark.conf.get(FREE_SHUFFLES) == before


def test_no_hash_is_moved_beside_the_text(spark, tables):
    samples = dataset.cleaned(dataset.labelled_history(tables))
    text = plan(dataset.dedup_keep_first(samples, "code", [F.asc("label")], by_text=True))
    assert text.index("sha2(") < text.index("Window") and text.count("sha2(") == 1 and "hashpartitioning(code#" in text


def test_no_row_past_the_sample_is_moved(spark):
    """Rows meet broadcast offsets; only those within the limit reach a shuffle."""
    rows = spark.range(0, 4000, 1, 4).selectExpr("id", "cast(id % 2 as int) as label", "10 as n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, other = (hash_rank(rows, "id", ["label"], limit=F.col("n"), few=f) for f in (True, False))
        assert "SortMergeJoin" not in plan(few) and "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(other)
        assert sorted(few.collect()) == sorted(other.collect()) and few.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
