"""Dump splitting, file scans and sinks on small fixtures."""

import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from codelake import pipelines
from codelake.plans import ingest
from codelake.sources import dump, repo_files, sinks, tables
from codelake.sources.fixtures import view

NASTY = ["plain", "it's", "two\nlines;\n", "x');\nINSERT INTO \"cve\" VALUES('fake');\ny", "''", "", "tail,comma", "\n;\n'\n"]


@pytest.mark.parametrize("values,want", [
    ("7, 'c0ffee', 'lib/rate.go', 'say ''hi'' twice', NULL", ["7", "c0ffee", "lib/rate.go", "say 'hi' twice", "NULL"]),
    ("", []), ("'',  ,x", ["", "x"]), ("'a'b,c", ["a", "b", "c"]), ("abc'd'", ["d"]), ("'open ''end", ["open 'end"]), ("'abc''", ["abc'"])])
def test_parse_values(spark, values, want):
    rows = spark.createDataFrame([(values,)], "v string")
    assert rows.select(dump.parse_values(F.col("v"))).first()[0] == want


def test_parse_values_is_stack_safe(spark):
    text = "''" * 200_000
    rows = spark.createDataFrame([(f"1,'{text}',2",)], "v string")
    assert [len(t) for t in rows.select(dump.parse_values(F.col("v"))).first()[0]] == [1, 200_000, 1]


def _plain_fields(body):
    quoted = [t[1:-1].replace("''", "'") for t in re.findall(r"'[^']*+(?:''[^']*+)*+'|[^']++", body) if t.startswith("'")]
    parts = body.split(",")
    language = parts[-3].strip().strip("'") if len(parts) >= 3 else ""
    return (*quoted[:3], "" if language == "NULL" else language) if len(quoted) >= 3 else None


def test_file_change_fields_against_a_plain_version(spark):
    rng = random.Random(6)
    bits = ["'a'", "''", "'it''s'", "'x,y'", "NULL", " ", ",", ",", "'", "'$1'"]
    bodies = ["".join(rng.choice(bits) for _ in range(rng.randrange(16))) for _ in range(1000)]
    bodies += [",".join(rng.choice(bits[:6]) for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    rows = spark.createDataFrame([(i, f"INSERT INTO file_change VALUES({b});") for i, b in enumerate(bodies)], "i int, s string")
    got = {r.i: tuple(r.f) if r.f else None for r in rows.select("i", dump.file_change_fields(F.col("s")).alias("f")).collect()}
    assert got == {i: _plain_fields(b) for i, b in enumerate(bodies)}


@pytest.mark.parametrize("record,table", [
    ("cve VALUES('a;b','-- c');", "cve"), ("\"cve\" VALUES('a');", "cve"), ("cve(a) VALUES('a');", "cve"), ("INSERT INTO cve VALUES('a');", "cve"),
    ("cveVALUES ('a');", "cve"), ("cve VALUES('a'); -- it's", "cve"), ("cve VALUES('a') /* ; */;", "cve"), ("cve VALUES(-1);", "cve"), ("cve VALUES('a');x;", "cve")])
def test_records_give_one_command(spark, tmp_path, record, table):
    """Records that are one command as they stand and records that must be cut give the same kind of row."""
    (tmp_path / "d.sql").write_text(f"INSERT INTO fixes VALUES('x');\nINSERT INTO {record}\nINSERT INTO fixes VALUES('y');\n")
    got = [r for r in dump.read_statements(spark, str(tmp_path / "d.sql")).collect() if r.table != "fixes"]
    assert [r.table for r in got] == [table] and got[0].statement.startswith("INSERT INTO") and got[0].statement.endswith(";")


def test_written_dump_is_packed(spark, sf_dir, tmp_path):
    """Statements of a dump take far less room on disk than their text, and none is lost."""
    ingest.write_dump(spark, sf_dir, str(tmp_path / "dump"))
    size = sum(f.stat().st_size for f in (tmp_path / "dump").glob("part-*"))
    text = spark.read.text(str(tmp_path / "dump"))
    assert 3 * size < text.agg(F.sum(F.length("value") + 1)).first()[0]
    methods = dump.read_statements(spark, str(tmp_path / "dump")).where("table = 'method_change'").count()
    assert methods == view(spark, sf_dir, "cvefixes_method_change").count()


def test_each_command_is_read_once(spark, tmp_path):
    """The pattern of a command isn't copied into filters, and a file change's values are gathered once for all four fields."""
    (tmp_path / "d.sql").write_text("INSERT INTO cve VALUES('a');\n")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = dump.allowed_only(dump.read_statements(spark, str(tmp_path / "d.sql")))
    assert plan(rows).count("VALUES\\b") == 1
    field = F.lit("x") == dump.file_change_fields(F.col("s"))["hash"]
    assert plan(spark.createDataFrame([("x",)], "s string").select(field.alias("f"))).count("regexp_extract_all") == 1


def test_file_change_fields(spark):
    line = "INSERT INTO \"file_change\" VALUES('1','h','a''b,c.py','old','d','','','','','','','','','Python','','');"
    rows = spark.createDataFrame([(line,), (line.replace("'Python'", "NULL"),), ("INSERT INTO file_change VALUES(1,2,3);",), ("nothing",)], "s string")
    got = [r[0] for r in rows.select(dump.file_change_fields(F.col("s"))).collect()]
    assert tuple(got[0]) == ("1", "h", "a'b,c.py", "Python") and got[1].programming_language == "" and got[2:] == [None, None]


def _escape(v):
    return "'" + v.replace("'", "''") + "'"


@pytest.mark.parametrize("block", ["64", "200", "1000000"])
def test_statements_across_blocks(spark, tmp_path, block):
    """Code text with quotes, line ends, ``;`` and INSERT words survives any cut of the file into blocks."""
    lines = ["PRAGMA foreign_keys=OFF;", "CREATE TABLE cve (a TEXT,", "  b TEXT);"]
    for i, v in enumerate(NASTY * 5):
        lines.append(f'INSERT INTO "method_change" VALUES({i},{_escape(v)});')
        lines.append(f"INSERT INTO other VALUES({i});")
    lines.append("COMMIT;")
    path = tmp_path / "dump.sql"
    path.write_bytes("\n".join(lines).encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = dump.ingest(spark, str(path), {"method_change": 2}).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert all(r.good for r in rows)
    assert {int(r.tokens[0]): r.tokens[1] for r in rows} == dict(enumerate(NASTY * 5))


def test_quarantine(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO cve VALUES('a');\nINSERT INTO cve VALUES('a','b');\n")
    rows = dump.ingest(spark, str(tmp_path / "d.sql"), {"cve": 2}).collect()
    assert sorted((r.good, r.statement) for r in rows if not r.good) == [(False, "INSERT INTO cve VALUES('a');")]
    assert [r.tokens for r in rows if r.good] == [["a", "b"]]


@pytest.fixture
def tree(tmp_path):
    files = {"a.py": b"x = 1\xff\n", "src/B.PY": b"y", "src/c.tsx": b"t", "src/d.txt": b"no", "venv/e.py": b"v", ".git/f.py": b"g",
             "node_modules/g.js": b"n", "src/blank.py": b"  \n", "deep/.x/h.py": b"h", "deep/i.rs": b"r"}
    for name, data in files.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return str(tmp_path)


def test_repo_scan(spark, tree):
    rows = {r.file_path: (r.language, r.code) for r in repo_files.scan_repo_files(spark, tree).collect()}
    assert rows == {"a.py": ("Python", "x = 1\n"), "src/B.PY": ("Python", "y"), "src/c.tsx": ("TypeScript", "t"),
                    "src/blank.py": ("Python", "  \n"), "deep/i.rs": ("Rust", "r")}


def test_scan_of_encoded_and_repeated_roots(spark, tmp_path):
    """A root with a blank, a percent sign and a hidden name is no hidden folder; its name further down stays."""
    root = tmp_path / ".h d%41+"
    for name in ("a.py", ".h d%41+/b.py", "c d/e+f.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1")
    assert {r.file_path for r in repo_files.scan_py_files(spark, str(root)).collect()} == {"a.py", "c d/e+f.py"}


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from codelake.session import shared_root

    def session(master):
        held = {}
        return SimpleNamespace(conf=SimpleNamespace(get=held.get, set=held.__setitem__), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_root(session(master))
    assert shared_root(session("local[4]")) and shared_root(session("local"))


def test_py_scan(spark, tree):
    rows = {r.file_path: r.code for r in repo_files.scan_py_files(spark, tree).collect()}
    assert rows == {"a.py": "x = 1\ufffd\n", "venv/e.py": "v"}


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", line\nnext'), (2, None)], "id int, text string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(sinks.read_csv(spark, str(tmp_path / "csv"), "id int, text string").collect()) == sorted(rows.collect())


COMMENTED = ["-- dump of the project's history", "/* it's a\n   block */", "INSERT INTO cve VALUES('a','--no comment');", "-- don't; INSERT INTO cve VALUES('x','y');",
             "INSERT INTO cve VALUES('b','it''s\n-- ''quoted''\nINSERT INTO cve VALUES(''no'',''row'');'); -- it's done", "INSERT INTO cve VALUES('c','/* open');"]


@pytest.mark.parametrize("block", ["40", "100", "1000000"])
def test_apostrophes_in_comments(spark, tmp_path, block):
    """Quotes in comments open no value, comment marks in values open no comment, and a file that is cut off harms no other."""
    lines = COMMENTED + [f"INSERT INTO cve VALUES('n{i}','x');\n-- it's row {i}" for i in range(50)]
    (tmp_path / "a.sql").write_text("\n".join(lines) + "\n-- that's all")
    (tmp_path / "b.sql").write_text("INSERT INTO cve VALUES('d','x');\nINSERT INTO cve VALUES('e','cut off")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = dump.ingest(spark, str(tmp_path), {"cve": 2}).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {"a": "--no comment", "b": "it's\n-- 'quoted'\nINSERT INTO cve VALUES('no','row');", "c": "/* open", "d": "x"} | {f"n{i}": "x" for i in range(50)}
    assert {r.tokens[0]: r.tokens[1] for r in rows if r.good} == want
    assert [r.statement for r in rows if not r.good] == ["INSERT INTO cve VALUES('e','cut off"]


def test_typed_tables(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO repository VALUES('u',NULL,'3','x');\nINSERT INTO file_change VALUES('1','h','f.py','o','d',NULL,'Go','','');\n")
    rows = dump.ingest(spark, str(tmp_path / "d.sql"), {"repository": 4, "file_change": 9})
    assert dump.typed(rows, "repository", "url string, note string, stars int, n int").collect() == [("u", None, 3, None)]
    assert dump.typed(rows, "file_change", "id string, hash string, filename string, programming_language string").collect() == [("1", "h", "f.py", "Go")]


def test_source_files_keep_their_names(spark, tmp_path):
    """Files written with their own names and read back by extension, with repositories that have no function."""
    rows = [("repo_1/src/a.py", "def f():\n    import pickle\n    pickle.loads(x)"), ("repo_1/b.JS", "function g(a) {\n}"), ("repo_2/none.go", "// é"),
            ("repo_1/.git/c.py", "x"), ("repo_1/readme.md", "text")]
    written = repo_files.write_source_files(spark.createDataFrame(rows, "file_path string, content string").repartition(3), str(tmp_path))
    assert written.count() == 5
    files = repo_files.scan_repo_files(spark, str(tmp_path))
    assert {(r.file_path, r.code) for r in files.collect()} == set(rows[:3])
    pred = pipelines.scan(files, r"^repo_(\d+)/")
    scores = {r.repo_id: r for r in pipelines.repository_risk(pred, pipelines.scanned_files(files, r"^repo_(\d+)/")).collect()}
    assert (scores["1"].files_scanned, scores["1"].functions_scanned, scores["1"].total_vulnerabilities, scores["1"].critical_issues) == (2, 2, 1, 1)
    assert (scores["2"].files_scanned, scores["2"].functions_scanned, scores["2"].security_grade) == (1, 0, "A")
    texts = pipelines.executive_reports(pred, files=pipelines.scanned_files(files, r"^repo_(\d+)/"))
    assert {r.repo_id for r in texts.collect()} == {"1", "2"}
    found = pipelines.explained_findings(pred).first()
    assert found.remediation.priority_level.startswith("P0") and found.remediation.root_cause


def test_read_parts(spark, sf_dir):
    spark.conf.set(tables.READ_PARTS, "3")
    try:
        assert tables.read_table(spark, sf_dir, "events").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(tables.READ_PARTS)


def test_jobs_from_another_folder(tmp_path):
    """A session of ``build_session`` has the package on its workers, wherever it is started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from codelake.session import build_session
spark = build_session("other", master="local[1]")
from codelake.functions.code_parse import explode_functions
rows = spark.createDataFrame([("a.py", "Python", "def f(): pass")], "file_path string, language string, code string")
print("found", explode_functions(rows).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "found 1" in out.stdout, out.stderr[-2000:]


def test_small_files_share_tasks(spark, tmp_path):
    """A task reads a hundred small files and more, so that a million files don't need a task for each thirty."""
    for i in range(600):
        (tmp_path / f"f{i}.py").write_text("def f(): pass\n")
    files = repo_files.scan_repo_files(spark, str(tmp_path))
    assert files.count() == 600 and files.rdd.getNumPartitions() <= 6
