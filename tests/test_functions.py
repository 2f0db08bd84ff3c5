"""Golden rows of the scalar functions and parsers."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelake import fixed
from codelake.functions import code_parse, explain, rules, text, udtfs, vectors
from codelake.operators import detect, jobs, score
from codelake.operators.explain import token_lines, with_reason
from codelake.plans.oracle import CMD_PATTERN, SQL_PATTERN
from codelake.sources import dump


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


ODD = ["", " ", None, "\u2003x\u00a0", "a\r\nb\rc\n", "a\n\n", "x\x0by\x1cz", "ends\r"]


def test_strip_and_lines_follow_python(spark):
    assert column(spark, ODD, text.strip) == [None if v is None else v.strip() for v in ODD]
    assert column(spark, ODD, text.code_lines) == [(v or "").splitlines() for v in ODD]


def test_clean_code(spark):
    assert column(spark, ["\n\t total = price * 2\n  print(total) \n\n", None, "ready"], text.clean_code) == ["total = price * 2\n  print(total)", "", "ready"]


def test_advanced_clean(spark):
    py = '# load rates\ndef rate(day):\n    """Rate of a day."""\n    return TABLE[day]  # may raise\n'
    c = "/* counter of\n   hits */\nlong hits(void) {\n  return total; // shared\n}\n"
    rows = spark.createDataFrame([(py, "Python"), (c, "C"), ("  ", "C"), (None, ""), ("a\r\n\r\n\r\n\r\nb", "C")], "code string, lang string")
    got = [r[0] for r in rows.select(text.advanced_clean(F.col("code"), F.col("lang"))).collect()]
    assert not any(x in got[0] for x in ("load", "Rate of", "raise")) and "def rate(day):" in got[0] and "TABLE[day]" in got[0]
    assert not any(x in got[1] for x in ("counter", "shared")) and "long hits(void)" in got[1]
    assert got[2:] == ["", "", "a\n\nb"]


def test_language_token(spark):
    assert column(spark, ["Python", "C++", "python", ""], lambda c: text.inject_language_token(F.lit("x"), c)) == [
        "<PYTHON> x", "<CPP> x", "<UNKNOWN> x", "<UNKNOWN> x"]


def test_path_rules(spark):
    paths = ["a/b.py", "a/.git/b.py", "venv/x.c", "src/node_modules/y.js", "Makefile", "a/b.TSX", ".hidden", "a.b/c"]
    assert column(spark, paths, text.path_extension) == ["py", "py", "c", "js", "", "tsx", "", ""]
    assert column(spark, paths, text.path_excluded) == [False, True, True, True, False, False, False, False]


PLAIN = {"sql_injection": SQL_PATTERN, "cmd_injection": CMD_PATTERN, "hardcoded_secret": "(?i)" + fixed.SECRET_RULE,
         "path_traversal": "(?i)" + fixed.PATH_RULE, "deserialization": "(?i)" + fixed.DESERIALIZATION_RULE}
PARTS = ["select ", "UPDATE", "+", "'", '"', ".format(", 'f"', "{", "system", "(", ")", "popen (", ",", "\n", "x", "api_key = ",
         "'aaaaaaaaaaaaaaaaaaaa'", "open(", "filename", "../", "pickle.loads", "f'"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=40, max_size=40))
def test_linear_patterns_equal_plain_ones(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, code string")
    hits = detect.with_rules(rows).orderBy("i").collect()
    for name, pattern in PLAIN.items():
        assert [r[f"hit_{name}"] for r in hits] == [re.search(pattern, t) is not None for t in texts], name


ADVERSARIAL = {
    "sql_injection": ["select update delete + ", 'f"select ', "select .format", "update\n+"],
    "cmd_injection": ["system(", "popen (subprocess.call(\n", "system(+", "system(x)", "system( + f\"", "system()+"],
    "hardcoded_secret": ["token = ", "api_key='aaaaaaaaaaaaaaaaaaaa", "secret =\t'token", "password = '" + "a" * 40 + "; "],
    "path_traversal": ["open(", "open(+", "open(filename ../", "open(+\n", "File (input)", "open(x) ", "../", "open(\n", "+ ../"],
    "deserialization": ["pickle.", "yaml.load", "marshal.\n"],
}
ENDS = {"sql_injection": " x + '", "cmd_injection": ") system(a + b)", "hardcoded_secret": " token = 'bbbbbbbbbbbbbbbbbbbb'",
        "path_traversal": ")\nopen(filename + '../x')", "deserialization": " pickle.loads"}


@pytest.mark.parametrize("name", sorted(ADVERSARIAL))
def test_rules_read_a_megabyte_in_linear_time(spark, name):
    """Texts made of a rule's beginnings: ten times the text takes about ten times as long, and the end still counts."""
    def took(size):
        texts = [piece * (size // len(piece)) + end for piece in ADVERSARIAL[name] for end in ("", ENDS[name])]
        rows = spark.createDataFrame([(t,) for t in texts], "code string").coalesce(1)
        start = time.time()
        found = [r.hit for r in rows.select(rules.RULES[name](F.col("code")).alias("hit")).collect()]
        assert all(found[1::2])
        return (time.time() - start) / len(texts)

    took(10_000)
    assert took(1_000_000) < 1.0


def test_heuristic_cwe(spark):
    low = ["sql = 'select price from goods where sku = ' + sku", "panel.innerhtml = note", "strcpy(target, line)", "os.system(job)",
           "yaml.load(stream)", "open(filename)", "token = 7", "count = 0", "a description", "strcat(line)", "strncpy(a); strcat(b)"]
    assert column(spark, low, rules.heuristic_cwe) == [
        "CWE-89", "CWE-79", "CWE-119", "CWE-78", "CWE-502", "CWE-22", "CWE-798", "CWE-20", "CWE-79", "CWE-119", "CWE-20"]


def test_hybrid_decision(spark):
    rows = spark.createDataFrame([
        (1, "import pickle\npickle.loads(x)", "a.py", 0.30), (2, "x = 1", "tests/a.py", 0.70), (3, "x = 1", "tests/a.py", 0.80),
        (4, "pickle.loads(x)", "tests/a.py", 0.70), (5, "pickle.loads(x)", "a.py", 0.95), (6, "  ", "a.py", 0.9), (7, None, None, None)],
        "id int, code string, file_path string, ml_prob double")
    got = {r.id: r for r in detect.predict(rows).collect()}
    assert (got[1].vulnerable, got[1].predicted_cwe, got[1].confidence) == (True, "CWE-502", 0.7)
    assert (got[2].vulnerable, got[2].confidence) == (False, 0.45)
    assert (got[3].vulnerable, got[3].confidence) == (True, 0.55)
    assert (got[4].vulnerable, got[4].confidence) == (True, 0.7)
    assert (got[5].confidence, got[5].severity) == (1.0, "Critical")
    for i in (6, 7):
        assert (got[i].vulnerable, got[i].confidence, got[i].severity, got[i].recommendation) == (False, 0.0, "None", "No code provided.")


def test_model_cwe_column_wins_and_unknown_cwe_is_generic(spark):
    rows = spark.createDataFrame([("x = 1", "a.py", 0.9, "CWE-9999")], "code string, file_path string, ml_prob double, model_cwe string")
    row = detect.predict(rows).first()
    assert (row.predicted_cwe, row.cwe_name, row.severity, row.cvss_score) == ("CWE-9999", "Vulnerability identified", "High", 9.0)


def test_remediation(spark):
    rows = spark.createDataFrame([("CWE-89", "Critical", " Python "), ("CWE-89", "Odd", "Rust"), ("CWE-1", "Low", None), (None, None, None)],
                                 "predicted_cwe string, severity string, language string")
    got = detect.remediation(rows).collect()
    by = {(r.predicted_cwe, r.language): r for r in got}
    assert "%s" in by["CWE-89", " Python "].example_secure_implementation and by["CWE-89", " Python "].priority_level.startswith("P0")
    assert by["CWE-89", "Rust"].example_secure_implementation.startswith("Always separate") and by["CWE-89", "Rust"].priority_level.startswith("P2")
    assert by["CWE-1", None].root_cause == "A potential CWE-1 pattern was detected in the code structure."
    assert "security vulnerability" in by[None, None].root_cause


def test_exploitability(spark):
    rows = spark.createDataFrame([("db.execute('SELECT * FROM users WHERE name = ' + name)",), ("db.execute('SELECT %s', (name,))",)], "code string")
    status, _ = rules.exploitability(F.col("code"), F.lit("CWE-89"))
    assert [r[0] for r in rows.select(status).collect()] == ["exploitable", "mitigated"]


def test_probabilities(spark):
    values = [-3.0, 7.5, float("nan"), float("-inf"), float("inf"), None, 0.125]
    bad, safe = explain.probability_distribution(F.col("v"))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(bad, safe).collect()
    assert [tuple(r) for r in rows] == [(0.0, 1.0), (1.0, 0.0), (0.5, 0.5), (0.5, 0.5), (0.5, 0.5), (0.5, 0.5), (0.125, 0.875)]


def test_certainty(spark):
    rows = spark.createDataFrame([(0.95, True), (0.10, False), (0.6, True), (0.2, True)], "p double, v boolean")
    label, sentence = explain.certainty_label(F.col("p"), F.col("v"))
    got = rows.select(label, sentence).collect()
    assert [r[0] for r in got] == ["Extremely Confident", "Extremely Confident", "Marginally Confident", "Low Confidence"]
    assert "vulnerable risk signatures" in got[0][1] and "(90.00%)" in got[1][1]


@pytest.mark.parametrize("code,cwe,part", [
    ("rows = run('SELECT total FROM bills WHERE nr = ' + nr)", "CWE-89", "SQL"), ("subprocess.run('tar xf ' + upload)", "CWE-78", "shell"),
    ("state = pickle.loads(blob)", "CWE-502", "deserializes"), ("open(base + filename)", "CWE-22", "traversal"), ("card.innerHTML = title", "CWE-79", "browser DOM"),
    ("eval(formula)", "CWE-94", "dynamic code"), ("log.info(password)", "CWE-312", "cleartext"), ("def rate(day):\n    return 1", "CWE-999", "signature rules"),
    ("os.popen(job)", None, "shell"), ("db.execute(text)", None, "unparameterized"), ("h = md5(blob)", None, "cryptographic")])
def test_reasons(spark, code, cwe, part):
    rows = spark.createDataFrame([(code, 1, cwe)], "code string, first_line int, predicted_cwe string")
    assert part in with_reason(rows).first().reason


def test_reason_without_lines(spark):
    rows = spark.createDataFrame([("x", None, "CWE-89"), ("x", 5, "CWE-89"), (None, 1, None)], "code string, first_line int, predicted_cwe string")
    got = {(r.code, r.first_line): r.reason for r in with_reason(rows).collect()}
    assert got["x", None] == fixed.REASON_NO_LINES and got["x", 5] == fixed.REASON_OUT_OF_RANGE and got[None, 1] == fixed.REASON_OUT_OF_RANGE


def test_line_of_offset(spark):
    code = spark.createDataFrame([(1, "line1\nline2\nline3\n")], "snippet_id long, code string")
    offsets = (-1, 0, 5, 6, 11, 12, 17, 18, 99)
    rows = spark.createDataFrame([(1, 0, n, "t", o, o + 1, 1.0) for n, o in enumerate(offsets)],
                                 "snippet_id long, head int, token_idx int, token string, tok_start int, tok_end int, weight double")
    got = token_lines(rows, code).orderBy("token_idx").collect()
    assert [r.line_number for r in got] == [1, 1, 1, 2, 2, 3, 3, 1, 1]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_function_extraction():
    c = '#include <stdio.h>\nvoid calculate_sum(int a) {\n if (a) { x(); }\n}\nint main() {\n return 0;\n}\nint broken() {\n'
    found = code_parse.brace_functions(c)
    assert [(n, l) for n, _, l in found] == [("calculate_sum", 2), ("main", 5)] and found[1][1] == "main() {\n return 0;\n}"
    py = "class A:\n    async def m(self):\n        def inner():\n            pass\n\ndef top():\n    pass\n"
    assert [n for n, _, _ in code_parse.python_functions(py)] == ["top", "m", "inner"]
    assert code_parse.python_functions("def (") == [] and code_parse.python_functions(None) == []


def test_source_functions_fall_back_to_braces(spark):
    files = spark.createDataFrame([("a.py", "Python", "void f(int x) { y(); }"), ("b.py", "Python", "def g():\n    pass")], "file_path string, language string, code string")
    assert sorted(r.function_name for r in code_parse.explode_functions(files).collect()) == ["f", "g"]


def test_ast_findings():
    secrets = 'api_key = "sk-live-XXXXXXXX"\ndb_pass = "SuperSecret123!"\nclean = "hello world"\nself.password = "longenough"\n'
    assert [(f[0], f[3]) for f in code_parse.ast_findings(secrets)] == [("RS002", 1), ("RS002", 2)]
    sql = 'def g(u):\n    q = "SELECT * FROM users WHERE id = " + u\n    r = f"delete {u}"\n    s = f"plain select"\n'
    assert [(f[0], f[3]) for f in code_parse.ast_findings(sql)] == [("RS001", 2), ("RS001", 3)]
    assert code_parse.ast_findings("import os\n\ndef c():\n    return os.environ.get('API_KEY')\n") == []
    assert code_parse.ast_findings("def (") == []


def test_unified_diff():
    diff = code_parse.unified_diff("a\nb\n", "a\nc\n")
    assert diff.splitlines()[:2] == ["--- vulnerable_function.py", "+++ secured_function.py"] and "-b" in diff and "+c" in diff


def test_risk_score_golden(spark):
    found = spark.createDataFrame([("r", "Critical", 0.95), ("r", "High", 0.85)], "repo_id string, severity string, risk_score double")
    summary = score.summary_of_findings(found).withColumn("functions_scanned", F.lit(50))
    row = score.with_scores(summary).first()
    assert (row.risk_score, row.security_grade, row.repository_score) == (46.7, "D", 53)
    assert (row.business_impact_score, row.business_impact, row.confidence) == (0.68, "High", 0.9)


def test_severity_defaults(spark):
    found = spark.createDataFrame([("r", None, None), ("r", "Odd", 0.5)], "repo_id string, severity string, risk_score double")
    row = score.summary_of_findings(found).first()
    assert (row.medium_issues, row.total_vulnerabilities, row.confidence_units) == (1, 2, 15000)


def test_registration_quality(spark):
    rows = spark.createDataFrame([("Al", "S3cur3P@ssw0rd!"), ("A", "S3cur3P@ssw0rd!"), ("Al", "short1!"), ("Al", "nouppercase1!"), ("Al", "NoDigits!!")],
                                 "full_name string, password string")
    assert [r.accepted for r in jobs.registration_quality(rows).collect()] == [True, False, False, False, False]


VALUES = st.text(st.sampled_from("ab',; \n()\"N"), max_size=14)


@settings(max_examples=10, deadline=None)
@given(st.lists(VALUES, min_size=20, max_size=20))
def test_dump_values_in_sql_equal_the_expression(spark, texts):
    udtfs.register(spark)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {r.i: r.v for r in rows.select("i", dump.parse_values(F.col("t")).alias("v")).collect()}
    got = {}
    for r in spark.sql("SELECT r.i, v.place, v.value FROM {rows} r, LATERAL dump_values(r.t) v", rows=rows).collect():
        got.setdefault(r.i, []).append((r.place, r.value))
    assert {i: [v for _, v in sorted(x)] for i, x in got.items()} == {i: v for i, v in want.items() if v}


def test_table_functions(spark):
    udtfs.register(spark)
    code = "def f(a):\n    def g():\n        return 1\n    return g\npassword = 'longsecret'\n"
    files = spark.createDataFrame([(code, "Python"), ("int h(int a) { return 1; }", "C"), (None, "C"), ("def broken(", "Python")], "code string, language string")
    found = spark.sql("SELECT f.name, f.line_number FROM {files} s, LATERAL source_functions(s.code, s.language) f", files=files).collect()
    assert sorted(map(tuple, found)) == [("f", 1), ("g", 2), ("h", 1)]
    assert spark.sql("SELECT f.rule_id FROM {files} s, LATERAL ast_findings(s.code) f", files=files).collect()[0].rule_id == "RS002"


def test_table_functions_give_no_batch_per_call(spark):
    """A call's few rows aren't made a batch of their own."""
    udtfs.register(spark)
    for call in ("python_functions('')", "brace_functions('')", "ast_findings('')", "dump_values('')"):
        steps = spark.sql(f"SELECT f.* FROM VALUES (1) t(a), LATERAL {call} f")._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in steps and "ArrowEvalPythonUDTF" not in steps


def test_functions_of_a_large_file_are_cut_once(monkeypatch):
    """Lines are split once per file, not once per function; sources are those of ``ast.get_source_segment``."""
    import ast
    code = "class C:\r\n  def m(self): return 'é\x0c'; y = 2\r\n\ntry:\n    def a(x=lambda: 1):\n        def b(): pass\n        return '''\u2028\n'''\nexcept E:\n    async def c(): pass\n"
    want = [(n.name, ast.get_source_segment(code, n), n.lineno) for n in ast.walk(ast.parse(code)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    monkeypatch.setattr(ast, "get_source_segment", lambda *_: 1 / 0)
    assert code_parse.python_functions(code) == want and len(want) == 4
