"""Dump import, repository files and writers with their read-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code_parse, udtfs
from ..operators.settle import settle
from ..pipelines import repository_risk, scan, scanned_files
from ..session import scratch_path
from ..sources import dump, repo_files, sinks
from ..sources.fixtures import view
from . import oracle as O
from .functions import _AST_FIELDS, _AST_SQL, REPORT_SQL
from .registry import predictions, query, reports

q = dump.quote_literal


def _method_text(row):
    """Method code made harder to split: quotes and a line ending in ``;``."""
    return F.concat(row, F.lit("\n-- it's\nx = 'a';\n"))


_METHOD_SQL = "code || chr(10) || '-- it''s' || chr(10) || 'x = ''a'';' || chr(10)"
_COMMENT = "\n-- that's a note; /* it's not a value\n/* and one that isn't\n   over yet */"
# A severity text that holds a whole INSERT of its own.
_TRAP = "\n;\nINSERT INTO \"fixes\" VALUES('no','row');\n'"


DUMP_RECORDS = 100_000


def write_dump(spark, sf_dir, path):
    c = F.col
    t = {n: view(spark, sf_dir, f"cvefixes_{n}") for n in ("fixes", "commits", "cve", "cwe_classification", "method_change", "file_change")}
    empty = [F.lit("''")] * 10
    parts = [
        t["fixes"].select(dump.insert_text("fixes", q(c("cve_id")), q(c("hash"))).alias("value")),
        t["commits"].select(dump.insert_text("commits", q(c("hash")), q(c("repo_url"))).alias("value")),
        t["cve"].select(dump.insert_text("cve", q(c("cve_id")), c("cvss3_base_score").cast("string"), q(F.concat("cvss3_base_severity", F.lit(_TRAP)))).alias("value")),
        t["method_change"].select(dump.insert_text("method_change", q(c("file_change_id")), q(_method_text(c("code"))), q(c("before_change"))).alias("value")),
        t["file_change"].select(dump.insert_text("file_change", q(c("file_change_id")), q(c("hash")), F.lit("'a''b,c.py'"), *empty,
                                                 F.lit("''"), q(c("programming_language")), F.lit("''"), F.lit("''")).alias("value")),
        t["cwe_classification"].select(F.concat(dump.insert_text("cwe_classification", q(c("cve_id")), q(c("cwe_id"))), F.lit(_COMMENT)).alias("value")),
        t["cwe_classification"].select("cwe_id").distinct().select(dump.insert_text("cwe", q(c("cwe_id")), q(F.concat(F.lit("it's "), "cwe_id"))).alias("value")),
        t["commits"].select("repo_url").distinct().select(F.concat(F.lit(_COMMENT[1:] + "\n"), dump.insert_text("repository", q(c("repo_url")))).alias("value")),
        # A table outside the list, and a row with too few values.
        t["commits"].select(dump.insert_text("users", q(c("hash"))).alias("value")),
        t["cve"].select(dump.insert_text("cve", q(c("cve_id"))).alias("value")),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    # Packed text in files of so many statements: a packed file is one block.
    lines.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", DUMP_RECORDS).text(path)


WIDTHS = {"fixes": 2, "commits": 2, "cve": 3, "cwe_classification": 2, "cwe": 2, "repository": 1, "method_change": 3, "file_change": 17}
_TRAP_SQL = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in _TRAP.split("\n"))


def _loaded(table, *values, outcome="loaded", source=None):
    padded = [*values, *["NULL"] * (4 - len(values))]
    columns = ", ".join(f"CAST({v} AS VARCHAR) AS v{i}" for i, v in enumerate(padded, 1))
    return f"SELECT '{table}' AS source_table, '{outcome}' AS outcome, {columns} FROM {source or 'cvefixes_' + table}"


def _ingested(spark, sf_dir):
    path, tables = scratch_path(spark, "dump"), scratch_path(spark, "dump-tables")
    write_dump(spark, sf_dir, path)
    dump.ingest(spark, path, WIDTHS).write.mode("overwrite").partitionBy("good", "table").parquet(tables)
    return spark.read.schema("tokens array<string>, statement string, good boolean, table string").parquet(tables)


# Columns of the dump's tables as they are used.
TYPED = {
    "fixes": "cve_id string, hash string", "commits": "hash string, repo_url string",
    "cve": "cve_id string, cvss3_base_score double, cvss3_base_severity string", "cwe_classification": "cve_id string, cwe_id string",
    "cwe": "cwe_id string, cwe_name string", "repository": "repo_url string", "method_change": "file_change_id string, code string, before_change string",
    "file_change": "file_change_id string, hash string, filename string, programming_language string",
}


def _typed_sql(table, key, text="NULL", number="NULL", source=None):
    return f"SELECT '{table}' AS source_table, {key} AS row_key, CAST({text} AS VARCHAR) AS row_text, CAST({number} AS DOUBLE) AS row_number FROM {source or 'cvefixes_' + table}"


@query("dump_typed", " UNION ALL ".join([
    _typed_sql("fixes", "cve_id", "hash"), _typed_sql("commits", "hash", "repo_url"), _typed_sql("cve", "cve_id", f"cvss3_base_severity || {_TRAP_SQL}", "cvss3_base_score"),
    _typed_sql("cwe_classification", "cve_id", "cwe_id"), _typed_sql("cwe", "cwe_id", "'it''s ' || cwe_id", source="(SELECT DISTINCT cwe_id FROM cvefixes_cwe_classification)"),
    _typed_sql("repository", "repo_url", source="(SELECT DISTINCT repo_url FROM cvefixes_commits)"),
    _typed_sql("method_change", "file_change_id", _METHOD_SQL), _typed_sql("file_change", "file_change_id", "hash")]))
def dump_typed(spark, sf_dir):
    """Every table of the dump as a table with names and types."""
    stored, out = _ingested(spark, sf_dir), None
    for table, schema in TYPED.items():
        rows = dump.typed(stored, table, schema)
        key, *rest = rows.columns
        text = next((c for c in rest if c != "cvss3_base_score"), None)
        part = rows.select(F.lit(table).alias("source_table"), F.col(key).alias("row_key"), (F.col(text) if text else F.lit(None)).cast("string").alias("row_text"),
                           (F.col("cvss3_base_score") if table == "cve" else F.lit(None)).cast("double").alias("row_number"))
        out = part if out is None else out.unionByName(part)
    return out


@query("dump_ingest", " UNION ALL ".join([
    _loaded("fixes", "cve_id", "hash"), _loaded("commits", "hash", "repo_url"),
    _loaded("cve", "cve_id", "cvss3_base_score", f"cvss3_base_severity || {_TRAP_SQL}"),
    _loaded("cve", "'INSERT INTO \"cve\" VALUES(''' || cve_id || ''');'", outcome="quarantined"),
    _loaded("cwe_classification", "cve_id", "cwe_id"),
    _loaded("cwe", "cwe_id", "'it''s ' || cwe_id", source="(SELECT DISTINCT cwe_id FROM cvefixes_cwe_classification)"),
    _loaded("repository", "repo_url", source="(SELECT DISTINCT repo_url FROM cvefixes_commits)"),
    _loaded("method_change", "file_change_id", f"coalesce({_METHOD_SQL}, 'NULL')", "before_change"),
    _loaded("file_change", "file_change_id", "hash", "'a''b,c.py'", "coalesce(programming_language, '')")]))
def dump_ingest(spark, sf_dir):
    """All tables of a dump with their values, and the rows that are kept apart."""
    stored = _ingested(spark, sf_dir)
    outcome = F.when(F.col("good"), "loaded").otherwise("quarantined")
    first = F.when(F.col("good"), F.get("tokens", F.lit(0))).otherwise(F.col("statement"))
    return stored.select(F.col("table").alias("source_table"), outcome.alias("outcome"), first.alias("v1"),
                         *[F.get("tokens", F.lit(i - 1)).alias(f"v{i}") for i in (2, 3, 4)])


_ROUND_TRIP = f"""SELECT file_change_id, 3 AS n_tokens, coalesce({_METHOD_SQL}, 'NULL') AS code, before_change FROM cvefixes_method_change"""


def _parsed_methods(spark, sf_dir):
    path = scratch_path(spark, "dump")
    write_dump(spark, sf_dir, path)
    rows = dump.allowed_only(dump.read_statements(spark, path)).where(F.col("table") == "method_change")
    return rows.withColumn("tokens", dump.parse_values(dump.statement_values(F.col("statement"))))


@query("udtf_dump_rows", _ROUND_TRIP)
def udtf_dump_rows(spark, sf_dir):
    """Statements written to a dump file, split quote-aware and parsed back."""
    return _parsed_methods(spark, sf_dir).select(
        F.get("tokens", F.lit(0)).alias("file_change_id"), F.size("tokens").alias("n_tokens"),
        F.get("tokens", F.lit(1)).alias("code"), F.get("tokens", F.lit(2)).alias("before_change"))


@query("dump_values_parse", "SELECT doc_id, 4 AS n_tokens, text, 'NULL' AS missing, source FROM documents")
def dump_values_parse(spark, sf_dir):
    """Tuple text of every document parsed back into its values."""
    from ..sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents").withColumn("values", F.concat_ws(
        ", ", F.col("doc_id").cast("string"), q(F.col("text")), F.lit("NULL"), q(F.col("source"))))
    tokens = docs.select("doc_id", dump.parse_values(F.col("values")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.get("t", F.lit(1)).alias("text"),
                         F.get("t", F.lit(2)).alias("missing"), F.get("t", F.lit(3)).alias("source"))


@query("dump_file_change_prune", f"""SELECT file_change_id, hash, 'a''b,c.py' AS filename, coalesce({O.strip('programming_language')}, '') AS programming_language
 FROM cvefixes_file_change""")
def dump_file_change_prune(spark, sf_dir):
    c = F.col
    lines = view(spark, sf_dir, "cvefixes_file_change").select(dump.insert_text(
        "file_change", q(c("file_change_id")), q(c("hash")), F.lit("'a''b,c.py'"), *[F.lit("'x'")] * 11,
        q(F.btrim("programming_language")), F.lit("''"), F.lit("''")).alias("statement"))
    # Not copied into the filter.
    return settle(lines.select(dump.file_change_fields(c("statement")).alias("f")), ["f"]).where("f is not null").select("f.*")


@query("allowed_tables", """SELECT 'cve' AS source_table, 2 * count(*) AS n FROM cvefixes_cve UNION ALL SELECT 'commits', count(*) FROM cvefixes_commits
 UNION ALL SELECT 'fixes', count(*) FROM cvefixes_fixes UNION ALL SELECT 'method_change', count(*) FROM cvefixes_method_change UNION ALL SELECT 'file_change', count(*) FROM cvefixes_file_change
 UNION ALL SELECT 'cwe_classification', count(*) FROM cvefixes_cwe_classification UNION ALL SELECT 'cwe', count(DISTINCT cwe_id) FROM cvefixes_cwe_classification
 UNION ALL SELECT 'repository', count(DISTINCT repo_url) FROM cvefixes_commits""")
def allowed_tables(spark, sf_dir):
    path = scratch_path(spark, "dump")
    write_dump(spark, sf_dir, path)
    return dump.allowed_only(dump.read_statements(spark, path)).groupBy(F.col("table").alias("source_table")).agg(F.count("*").alias("n"))


# Snippets as functions of source files: a Python or a brace function around each, some hundred of a path in one file.
_FILE = "concat('repo_', cast(repo_id AS string), '/', replace(replace(file_path, '.py', concat('_', cast(snippet_id div 20000 AS string), '.py')), '.js', concat('_', cast(snippet_id div 20000 AS string), '.js')))"
_NAME = "concat(function_name, '_', cast(snippet_id AS string))"
_SOURCE = f"""CASE WHEN language = 'Python' THEN concat('def ', {_NAME}, '(uid, buf):', chr(10), '    ', replace(code, chr(10), concat(chr(10), '    ')))
 ELSE concat('function ', {_NAME}, '(uid) {{', chr(10), code, chr(10), '}}') END"""
_SQL = lambda text: text.replace(" AS string", " AS VARCHAR").replace(" div ", " // ")
# Files without functions: one in each repository, and a repository that has nothing else.
_EMPTY = "docs/none.js"


def source_files(spark, sf_dir):
    """Files of the repositories: path and content."""
    snippets = view(spark, sf_dir, "snippets").selectExpr("repo_id", "snippet_id", f"{_FILE} AS file_path", f"{_SOURCE} AS source")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("snippet_id", "source"))), lambda x: x["source"]), "\n\n")
    code = snippets.groupBy("file_path").agg(content.alias("content"))
    empty = snippets.select("repo_id").distinct().unionByName(spark.range(1000, 1001).toDF("repo_id"))
    return code.unionByName(empty.selectExpr(f"concat('repo_', repo_id, '/{_EMPTY}') AS file_path", "'// none' AS content"))


def _written(spark, sf_dir):
    root = scratch_path(spark, "repos")
    repo_files.write_source_files(source_files(spark, sf_dir), root)
    return root


_FILES_SQL = f"""SELECT {_SQL(_FILE)} AS file_path, any_value(language) AS language, sum(length({_SQL(_SOURCE)}) + 2) - 2 AS n_chars, any_value(repo_id) AS repo_id
 FROM snippets GROUP BY 1 UNION ALL SELECT 'repo_' || repo_id || '/{_EMPTY}', 'JavaScript', 7, repo_id FROM (SELECT DISTINCT repo_id FROM snippets UNION ALL SELECT 1000)"""


@query("repo_file_scan", f"SELECT file_path, language, CAST(n_chars AS BIGINT) AS n_chars FROM ({_FILES_SQL})")
def repo_file_scan(spark, sf_dir):
    """Files with their own names and extensions, read back."""
    return repo_files.scan_repo_files(spark, _written(spark, sf_dir)).select("file_path", "language", F.length("code").cast("bigint").alias("n_chars"))


@query("repo_py_scan", f"SELECT file_path, CAST(n_chars AS BIGINT) AS n_chars FROM ({_FILES_SQL}) WHERE ends_with(file_path, '.py')")
def repo_py_scan(spark, sf_dir):
    return repo_files.scan_py_files(spark, _written(spark, sf_dir)).select("file_path", F.length("code").cast("bigint").alias("n_chars"))


_PYTHON_SQL = """SELECT snippet_id, regexp_extract(code, 'def (\\w+)', 1) AS name, code AS source, 1 AS line_number FROM snippets WHERE starts_with(code, 'def ')"""


@query("udtf_python_functions", _PYTHON_SQL)
def udtf_python_functions(spark, sf_dir):
    rows = view(spark, sf_dir, "snippets").select("snippet_id", F.explode(code_parse.python_functions_udf("code")).alias("f"))
    return rows.select("snippet_id", "f.name", "f.source", "f.line_number")


_BRACE_SQL = """SELECT file_change_id, regexp_extract(code, 'int (\\w+)', 1) AS name, regexp_extract(code, '(?s)f\\d+\\(\\).*\\}') AS source, 1 AS line_number
 FROM cvefixes_method_change WHERE code LIKE 'int f%'"""


@query("udtf_brace_functions", _BRACE_SQL)
def udtf_brace_functions(spark, sf_dir):
    rows = view(spark, sf_dir, "cvefixes_method_change").select("file_change_id", F.explode(code_parse.brace_functions_udf("code")).alias("f"))
    return rows.select("file_change_id", "f.name", "f.source", "f.line_number")


@query("sql_python_functions", _PYTHON_SQL)
def sql_python_functions(spark, sf_dir):
    """The same by a table function in SQL."""
    udtfs.register(spark)
    return spark.sql("SELECT s.snippet_id, f.name, f.source, f.line_number FROM {snippets} s, LATERAL python_functions(s.code) f", snippets=view(spark, sf_dir, "snippets"))


@query("sql_brace_functions", _BRACE_SQL)
def sql_brace_functions(spark, sf_dir):
    udtfs.register(spark)
    return spark.sql("SELECT c.file_change_id, f.name, f.source, f.line_number FROM {changes} c, LATERAL brace_functions(c.code) f",
                     changes=view(spark, sf_dir, "cvefixes_method_change"))


@query("sql_ast_findings", _AST_SQL)
def sql_ast_findings(spark, sf_dir):
    udtfs.register(spark)
    fields = ", ".join(f"f.{c}" for c in _AST_FIELDS if c != "snippet_id")
    return spark.sql(f"SELECT s.snippet_id, {fields} FROM {{snippets}} s, LATERAL ast_findings(s.code) f", snippets=view(spark, sf_dir, "snippets")).select(*_AST_FIELDS)


@query("sql_dump_values", "SELECT doc_id, unnest([0, 1, 2, 3]) AS place, unnest([CAST(doc_id AS VARCHAR), text, 'NULL', source]) AS value FROM documents")
def sql_dump_values(spark, sf_dir):
    from ..sources.tables import read_table
    udtfs.register(spark)
    docs = read_table(spark, sf_dir, "documents").withColumn("values", F.concat_ws(
        ", ", F.col("doc_id").cast("string"), q(F.col("text")), F.lit("NULL"), q(F.col("source"))))
    return spark.sql("SELECT d.doc_id, v.place, v.value FROM {docs} d, LATERAL dump_values(d.values) v", docs=docs)


_FINDING_FIELDS = "repo_id bigint, snippet_id bigint, type string, severity string, confidence double, predicted_cwe string, owasp string"
_FINDING_SQL = "SELECT repo_id, snippet_id, cwe_name AS type, severity, confidence, predicted_cwe, owasp FROM vuln"


def _finding_rows(spark, sf_dir):
    return predictions(spark, sf_dir).where("vulnerable").select(
        "repo_id", "snippet_id", F.col("cwe_name").alias("type"), "severity", "confidence", "predicted_cwe", "owasp")


@query("sink_findings", _FINDING_SQL)
def sink_findings(spark, sf_dir):
    path = scratch_path(spark, "findings")
    sinks.write_findings(_finding_rows(spark, sf_dir), path)
    return sinks.read_findings(spark, path, _FINDING_FIELDS + ", repo_bucket int")


@query("sink_report", REPORT_SQL)
def sink_report(spark, sf_dir):
    path = scratch_path(spark, "reports")
    sinks.write_reports(reports(spark, sf_dir), path)
    return sinks.read_reports(spark, path)


@query("sink_report_formats", f"SELECT 'csv' AS format, * FROM ({_FINDING_SQL}) UNION ALL SELECT 'json', * FROM ({_FINDING_SQL})")
def sink_report_formats(spark, sf_dir):
    rows = _finding_rows(spark, sf_dir)
    csv, json = scratch_path(spark, "report-csv"), scratch_path(spark, "report-json")
    sinks.write_csv(rows, csv)
    sinks.write_json(rows, json)
    return (sinks.read_csv(spark, csv, _FINDING_FIELDS).select(F.lit("csv").alias("format"), "*")
            .unionByName(sinks.read_json(spark, json, _FINDING_FIELDS).select(F.lit("json").alias("format"), "*")))


# What the functions of the files hold: a tree's function ends at its last statement, a brace function starts at its name; a
# function inside another is one of its own.
_SCANNED = {"snippets": f"""SELECT repo_id, snippet_id, {_SQL(_FILE)} AS file_path, {_SQL(_NAME)} AS function_name, language, 0.25e0 AS ml_prob,
  CASE WHEN language = 'Python' THEN rtrim({_SQL(_SOURCE)}, ';') ELSE substring({_SQL(_SOURCE)}, 10) END AS code FROM given
 UNION ALL SELECT repo_id, -snippet_id, {_SQL(_FILE)}, '', language, 0.25e0, replace(code, chr(10), chr(10) || '    ') FROM given WHERE language = 'Python' AND starts_with(code, 'def ')"""}
_SCANNED = {"given": O.TABLES["snippets"], **_SCANNED}


@query("scan_repository", f"""SELECT repo_id, files_scanned, functions_scanned, total_vulnerabilities, critical_issues, high_issues, risk_score, security_grade FROM ({O.SCORES.format(summary=f'''(
  SELECT repo_id, count(DISTINCT file_path) AS files_scanned, count(code) AS functions_scanned, count(*) FILTER (WHERE vulnerable) AS total_vulnerabilities, {O.severity_counts('vulnerable')}, 0 AS confidence_units
  FROM (SELECT repo_id, file_path, code, vulnerable, severity FROM pred UNION ALL SELECT repo_id, file_path, NULL, false, 'None' FROM ({_FILES_SQL.replace("FROM snippets", "FROM given")}))
  GROUP BY 1)''')})""", _SCANNED)
def scan_repository(spark, sf_dir):
    """Files on storage to functions, findings and scores, end to end; files and repositories without functions count."""
    files = repo_files.scan_repo_files(spark, _written(spark, sf_dir))
    repo = r"^repo_(\d+)/"
    pred = scan(files, repo, lambda functions: functions.withColumn("ml_prob", F.lit(0.25)))
    scores = repository_risk(pred, scanned_files(files, repo))
    return scores.select(F.col("repo_id").cast("bigint").alias("repo_id"), "files_scanned", "functions_scanned", "total_vulnerabilities", "critical_issues",
                         "high_issues", "risk_score", "security_grade")
