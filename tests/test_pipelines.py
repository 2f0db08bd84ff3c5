"""Whole jobs: files to reports, fix history to models."""

from pyspark.sql import functions as F

from codelake import pipelines
from codelake.plans.joins import fix_tables
from codelake.sources.repo_files import scan_repo_files


def test_files_to_report(spark, tmp_path):
    files = {"shop/app/db.py": 'def find(name):\n    return db.execute("SELECT * FROM t WHERE n = " + name + "")\n',
             "shop/app/util.py": "def one():\n    return 1\n",
             "shop/app/names.py": "A = 1\n", "bare/x.py": "B = 2\n",
             "clean/main.c": "int main() {\n  return 0;\n}\n"}
    for name, text in files.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    found = scan_repo_files(spark, str(tmp_path))
    pred = pipelines.scan(found)
    assert {(r.repo_id, r.function_name, r.vulnerable) for r in pred.collect()} == {
        ("shop", "find", True), ("shop", "one", False), ("clean", "main", False)}
    risk = {r.repo_id: r for r in pipelines.repository_risk(pred, pipelines.scanned_files(found)).collect()}
    # A repository and a file without any function are counted.
    assert (risk["bare"].security_grade, risk["bare"].repository_score, risk["bare"].files_scanned, risk["bare"].functions_scanned) == ("A", 100, 1, 0)
    assert (risk["clean"].security_grade, risk["clean"].repository_score) == ("A", 100)
    # One critical finding in two functions: 40 * 0.7 + 50 * 0.3.
    assert (risk["shop"].risk_score, risk["shop"].files_scanned, risk["shop"].functions_scanned) == (43.0, 3, 2)
    text = {r.repo_id: r.report for r in pipelines.executive_reports(pred).collect()}
    assert "`CWE-89`" in text["shop"] and "inside `find()` (Lines 1-1)" in text["shop"] and "No vulnerabilities identified" in text["clean"]


def test_history_to_models(spark, sf_dir):
    rows = pipelines.training_rows(fix_tables(spark, sf_dir), 400)
    counts = {(r.split, r.label): r["count"] for r in rows.groupBy("split", "label").count().collect()}
    assert counts["test", 1] == counts["test", 0] and rows.select("code_hash").distinct().count() == rows.count()
    model, cwe, metrics = pipelines.train(rows.withColumn("cwe_id", F.lit(None).cast("string")))
    assert cwe is None and 0.0 <= metrics.first().f1 <= 1.0 and model.stages
