"""Scalar functions: cleaning, rules, decisions, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import code_parse, explain, rules, text
from ..functions.vectors import dot, norm
from ..operators import consensus, detect, report, score
from ..operators import explain as explainer
from ..sources.fixtures import view
from ..sources.tables import read_table
from . import oracle as O
from .explain import HEATMAP_SQL
from .registry import explained, predictions, query, reports


def _snippets(spark, sf_dir):
    return view(spark, sf_dir, "snippets")


@query("clean_code", f"SELECT file_change_id, coalesce({O.strip('code')}, '') AS code FROM cvefixes_method_change")
def clean_code(spark, sf_dir):
    return view(spark, sf_dir, "cvefixes_method_change").select(
        "file_change_id", text.clean_code(F.col("code")).alias("code"))


@query("advanced_clean_code", f"SELECT snippet_id, {O.clean_sql('code', 'language')} AS code FROM snippets")
def advanced_clean_code(spark, sf_dir):
    return _snippets(spark, sf_dir).select("snippet_id", text.advanced_clean(F.col("code"), F.col("language")).alias("code"))


@query("advanced_clean_documents", f"SELECT doc_id, {O.clean_sql('text', chr(39) * 2)} AS cleaned FROM documents")
def advanced_clean_documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", text.advanced_clean(F.col("text"), F.lit("")).alias("cleaned"))


@query("inject_language_token", f"""SELECT file_change_id, {O.token_sql('programming_language')} || ' ' || code AS code
 FROM cvefixes_method_change JOIN cvefixes_file_change USING (file_change_id)""")
def inject_language_token(spark, sf_dir):
    both = view(spark, sf_dir, "cvefixes_method_change").join(view(spark, sf_dir, "cvefixes_file_change"), "file_change_id")
    return both.select("file_change_id", text.inject_language_token(
        F.col("code"), F.col("programming_language")).alias("code"))


def _rule_query(name):
    @query(f"rule_{name}", f"""SELECT 'snippet' AS kind, snippet_id AS id, {O.rule(name)} AS hit FROM snippets
 UNION ALL SELECT 'document', doc_id, {O.rule(name, 'text')} FROM documents""")
    def rule(spark, sf_dir):
        code = _snippets(spark, sf_dir).select(F.lit("snippet").alias("kind"), F.col("snippet_id").alias("id"), "code")
        docs = read_table(spark, sf_dir, "documents").select(
            F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("code"))
        return code.unionByName(docs).select("kind", "id", rules.RULES[name](F.col("code")).alias("hit"))
    return rule


for _name in rules.RULES:
    _rule_query(_name)


def _joined(index, sep):
    return "concat_ws(" + O.lit(sep) + ", " + ", ".join(
        f"CASE WHEN hit_{r[0]} THEN {O.lit(r[index])} END" for r in fixed.STATIC_RULES) + ")"


@query("static_candidates", f"SELECT snippet_id, {_joined(3, ' | ')} AS messages, {_joined(1, ',')} AS cwes FROM pred_rules")
def static_candidates(spark, sf_dir):
    hits = detect.hit_columns()
    return detect.with_rules(_snippets(spark, sf_dir)).select(
        "snippet_id", F.array_join(rules.static_messages(hits), " | ").alias("messages"),
        F.array_join(rules.static_cwes(hits), ",").alias("cwes"))


@query("test_path_deescalate", "SELECT snippet_id, v1 AS vulnerable, round(c1, 4) AS confidence FROM pred_kept")
def test_path_deescalate(spark, sf_dir):
    voted = detect.ml_vote(_snippets(spark, sf_dir))
    kept, lowered = rules.deescalate(F.col("ml_vulnerable"), F.col("ml_prob"), F.col("file_path"))
    return voted.select("snippet_id", kept.alias("vulnerable"), F.round(lowered, 4).alias("confidence"))


@query("hybrid_decision", "SELECT snippet_id, vulnerable, confidence, hybrid_cwe FROM pred_hybrid")
def hybrid_decision(spark, sf_dir):
    return detect.hybrid(detect.with_rules(detect.ml_vote(_snippets(spark, sf_dir)))).select(
        "snippet_id", "vulnerable", "confidence", "hybrid_cwe")


@query("heuristic_cwe", f"""SELECT 'snippet' AS kind, snippet_id AS id, {O.heuristic()} AS cwe FROM snippets
 UNION ALL SELECT 'page', page_id, {O.heuristic('html')} FROM pages""")
def heuristic_cwe(spark, sf_dir):
    code = _snippets(spark, sf_dir).select(F.lit("snippet").alias("kind"), F.col("snippet_id").alias("id"), "code")
    pages = read_table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("code"))
    both = code.unionByName(pages).select("kind", "id", F.lower("code").alias("low"))
    return both.select("kind", "id", rules.heuristic_cwe(F.col("low")).alias("cwe"))


@query("ml_threshold", "SELECT snippet_id, ml_prob >= 0.5e0 AS ml_vulnerable FROM snippets")
def ml_threshold(spark, sf_dir):
    return detect.ml_vote(_snippets(spark, sf_dir)).select("snippet_id", "ml_vulnerable")


_RECORD = ["snippet_id", "vulnerable", "confidence", "predicted_cwe", "cwe_name", "severity", "recommendation", "cvss_score",
           "owasp", "description"]
PREDICT_SQL = f"SELECT {', '.join(_RECORD)} FROM pred"


@query("predict_record", PREDICT_SQL)
def predict_record(spark, sf_dir):
    return predictions(spark, sf_dir).select(*_RECORD)


_HUMAN = f"""'Vulnerability Alert: A ' || e.severity || '-severity risk corresponding to ' || e.predicted_cwe || ' (' || e.cwe_name || ') was detected. Explanation: '
 || e.reason || ' ' || {O.lit(fixed.HUMAN_IMPACT)} || ' ' || {O.lit(fixed.HUMAN_ACTION)}"""


@query("prediction_explanation", f"""SELECT p.snippet_id, p.vulnerable, coalesce(l.affected_lines, []) AS affected_lines,
  CASE WHEN p.vulnerable THEN e.reason ELSE {O.lit(fixed.SAFE_REASON)} END AS reason,
  CASE WHEN p.vulnerable THEN h.tokens ELSE [] END AS tokens, CASE WHEN p.vulnerable THEN h.importance ELSE [] END AS importance,
  CASE WHEN p.vulnerable THEN '1x2x6x6' END AS dimension, round(p.confidence, 4) AS p_vulnerable, round(1e0 - p.confidence, 4) AS p_safe,
  CASE WHEN p.vulnerable THEN {_HUMAN} END AS readable
 FROM pred p LEFT JOIN explained e USING (snippet_id) LEFT JOIN (SELECT snippet_id, list(line_number ORDER BY line_number) AS affected_lines FROM top_lines GROUP BY 1) l USING (snippet_id)
 LEFT JOIN (SELECT snippet_id, list(token ORDER BY weight DESC, token_idx) AS tokens, list(importance ORDER BY weight DESC, token_idx) AS importance FROM ({HEATMAP_SQL}) GROUP BY 1) h USING (snippet_id)""")
def prediction_explanation(spark, sf_dir):
    """The nested explanation of every prediction, with its parts as columns."""
    e = explainer.with_explanation(predictions(spark, sf_dir), view(spark, sf_dir, "attention")).select("snippet_id", "vulnerable", "explanation.*")
    return e.select("snippet_id", "vulnerable", "affected_lines", "reason", F.transform("highlighted_tokens", lambda t: t["token"]).alias("tokens"),
                    F.transform("highlighted_tokens", lambda t: t["importance"]).alias("importance"), "attention_shape.dimension",
                    F.col("probability_distribution.vulnerable").alias("p_vulnerable"), F.col("probability_distribution.safe").alias("p_safe"), "readable")


@query("reason_text", "SELECT snippet_id, reason FROM explained")
def reason_text(spark, sf_dir):
    return explained(spark, sf_dir).select("snippet_id", "reason")


@query("human_explanation", f"SELECT snippet_id, {_HUMAN} AS explanation FROM explained e")
def human_explanation(spark, sf_dir):
    return explained(spark, sf_dir).select("snippet_id", explain.human_explanation(
        F.col("predicted_cwe"), F.col("cwe_name"), F.col("severity"), F.col("reason")).alias("explanation"))


_ODD_PROB = ("CASE WHEN event_type = 'error' THEN cast('NaN' AS double) WHEN event_type = 'signup' THEN cast('Infinity' AS double) "
             "WHEN event_type = 'click' THEN -value WHEN event_type = 'view' THEN value / cast(997 AS double) WHEN event_type = 'purchase' THEN value END")


@query("probability_distribution", f"""SELECT event_id, round(b, 4) AS prob_vulnerable, round(1e0 - b, 4) AS prob_safe FROM (SELECT event_id,
  CASE WHEN p IS NULL OR isnan(p) OR isinf(p) THEN 0.5e0 ELSE least(greatest(p, 0e0), 1e0) END AS b FROM (SELECT event_id, {_ODD_PROB} AS p FROM events))""")
def probability_distribution(spark, sf_dir):
    raw = read_table(spark, sf_dir, "events").select("event_id", F.expr(_ODD_PROB).alias("p"))
    bad, safe = explain.probability_distribution(F.col("p"))
    return raw.select("event_id", bad.alias("prob_vulnerable"), safe.alias("prob_safe"))


_TARGET = "CASE WHEN vulnerable THEN round(ml_prob, 4) ELSE round(1e0 - ml_prob, 4) END"


@query("certainty_label", f"""SELECT snippet_id, label, 'Model is ' || label || ' (' || {O.pct('t')} || ') in its decision. The code demonstrates strong features correlating to '
  || CASE WHEN vulnerable THEN 'vulnerable risk signatures' ELSE 'safe logic structures' END || '.' AS sentence
 FROM (SELECT *, CASE WHEN t >= 0.9e0 THEN 'Extremely Confident' WHEN t >= 0.7e0 THEN 'Confident' WHEN t >= 0.5e0 THEN 'Marginally Confident' ELSE 'Low Confidence' END AS label
  FROM (SELECT snippet_id, vulnerable, {_TARGET} AS t FROM pred))""")
def certainty_label(spark, sf_dir):
    label, sentence = explain.certainty_label(F.col("ml_prob"), F.col("vulnerable"))
    return predictions(spark, sf_dir).select("snippet_id", label.alias("label"), sentence.alias("sentence"))


def _exploit_sql():
    low = "lower(code)"
    has = lambda *w: O.any_of(low, *w)
    formatted = f"({has('+', '.format(', chr(102) + chr(34), chr(102) + chr(39))} OR ({has('%')} AND NOT {has('%s')}))"
    sql_open = f"({has('execute(')} AND {formatted})"
    bound = f"(NOT {sql_open} AND {has('%s')} AND {has('execute')})"
    shell = has("shell=true", "system(")
    off = f"(NOT {shell} AND {has('subprocess')} AND {has('shell=false')})"
    checked = has("abspath", "realpath", "startswith")
    return f"""SELECT v.snippet_id, CASE WHEN (predicted_cwe = 'CWE-89' AND {bound}) OR (predicted_cwe = 'CWE-78' AND {off}) OR (predicted_cwe = 'CWE-22' AND {checked})
  THEN 'mitigated' ELSE 'exploitable' END AS status, CASE WHEN predicted_cwe = 'CWE-89' AND {sql_open} THEN {O.lit(fixed.EXPLOIT_SQL)}
  WHEN predicted_cwe = 'CWE-89' AND {bound} THEN {O.lit(fixed.MITIGATED_SQL)} WHEN predicted_cwe = 'CWE-78' AND {shell} THEN {O.lit(fixed.EXPLOIT_SHELL)}
  WHEN predicted_cwe = 'CWE-78' AND {off} THEN {O.lit(fixed.MITIGATED_SHELL)} WHEN predicted_cwe = 'CWE-22' AND {checked} THEN {O.lit(fixed.MITIGATED_PATH)}
  WHEN predicted_cwe = 'CWE-22' THEN {O.lit(fixed.EXPLOIT_PATH)} ELSE {O.lit(fixed.EXPLOIT_DEFAULT)} END AS bypass_details,
  coalesce(p.payload_1 || ' | ' || p.payload_2 || ' | ' || p.payload_3, {O.lit(fixed.DEFAULT_PAYLOAD)}) AS tested_payloads
 FROM vuln v LEFT JOIN dim_payloads p ON upper(predicted_cwe) = p.cwe"""


@query("exploitability_flag", _exploit_sql())
def exploitability_flag(spark, sf_dir):
    status, reason = rules.exploitability(F.col("code"), F.col("predicted_cwe"))
    return detect.payloads(predictions(spark, sf_dir).where("vulnerable")).select(
        "snippet_id", status.alias("status"), reason.alias("bypass_details"),
        F.array_join("tested_payloads", " | ").alias("tested_payloads"))


REMEDIATION_FROM = """FROM vuln v LEFT JOIN dim_remediation r ON v.predicted_cwe = r.cwe
 LEFT JOIN dim_fix_example e ON v.predicted_cwe = e.cwe AND lower(v.language) = e.lang
 LEFT JOIN dim_fix_example d ON v.predicted_cwe = d.cwe AND d.lang = 'default'"""
_H, _T, _DANGER, _ADVICE, _EXAMPLE = (O.lit(v) for v in fixed.GENERIC_REMEDIATION)
ADVICE = f"coalesce(r.secure_recommendation, {_ADVICE})"
EXAMPLE = f"CASE WHEN r.cwe IS NULL THEN {_EXAMPLE} ELSE coalesce(e.example, d.example, '') END"
PRIORITY = "CASE severity " + " ".join(f"WHEN {O.lit(a)} THEN {O.lit(b)}" for a, b in fixed.PRIORITY) + f" ELSE {O.lit(fixed.DEFAULT_PRIORITY)} END"
REMEDIATION_SQL = f"""SELECT v.snippet_id, coalesce(r.root_cause, {_H} || v.predicted_cwe || {_T}) AS root_cause,
  coalesce(r.why_dangerous, {_DANGER}) AS why_dangerous, {ADVICE} AS secure_coding_recommendation, {EXAMPLE} AS example_secure_implementation,
  {PRIORITY} AS priority_level {REMEDIATION_FROM}"""
_PATCHED = f"'# Suggested Secure Replacement for ' || v.predicted_cwe || chr(10) || '# Remediation Recommendation: ' || {ADVICE} || chr(10) || {EXAMPLE} || chr(10)"


def patched(pred):
    c = F.col
    return detect.remediation(pred).withColumn("patched_code", F.concat(
        F.lit("# Suggested Secure Replacement for "), c("predicted_cwe"), F.lit("\n# Remediation Recommendation: "),
        c("secure_coding_recommendation"), F.lit("\n"), c("example_secure_implementation"), F.lit("\n")))


@query("patch_text", f"SELECT v.snippet_id, {_PATCHED} AS patched_code {REMEDIATION_FROM}")
def patch_text(spark, sf_dir):
    return patched(predictions(spark, sf_dir).where("vulnerable")).select("snippet_id", "patched_code")


_MINUS = "list_reduce(list_transform(string_split(code, chr(10)), lambda x: '-' || x), lambda a, b: a || chr(10) || b)"
_PLUS = "list_reduce(list_transform(string_split(left(patched_code, length(patched_code) - 1), chr(10)), lambda x: '+' || x || chr(10)), lambda a, b: a || b)"


@query("patch_diff", f"""SELECT snippet_id, '--- vulnerable_function.py' || chr(10) || '+++ secured_function.py' || chr(10) || '@@ -1' ||
  CASE WHEN len(string_split(code, chr(10))) = 1 THEN '' ELSE ',' || len(string_split(code, chr(10))) END || ' +1,' || (len(string_split(patched_code, chr(10))) - 1) || ' @@' || chr(10)
  || {_MINUS} || {_PLUS} AS diff FROM (SELECT v.snippet_id, v.code, {_PATCHED} AS patched_code {REMEDIATION_FROM})""")
def patch_diff(spark, sf_dir):
    return patched(predictions(spark, sf_dir).where("vulnerable")).select(
        "snippet_id", code_parse.unified_diff_udf("code", "patched_code").alias("diff"))


@query("udf_unified_diff", """SELECT snippet_id, '--- vulnerable_function.py' || chr(10) || '+++ secured_function.py' || chr(10) || '@@ -0,0 +1'
  || CASE WHEN n = 1 THEN '' ELSE ',' || n END || ' @@' || chr(10) || list_reduce(list_transform(lines, lambda x: '+' || x || chr(10)), lambda a, b: a || b) AS diff
 FROM (SELECT snippet_id, string_split(code, chr(10)) AS lines, len(string_split(code, chr(10))) AS n FROM snippets)""")
def udf_unified_diff(spark, sf_dir):
    """Diff of every snippet against an empty file."""
    return _snippets(spark, sf_dir).select("snippet_id", code_parse.unified_diff_udf(
        F.lit(""), F.concat("code", F.lit("\n"))).alias("diff"))


_ML_OPINION = f"""SELECT *, CASE WHEN mlv THEN ml_prob ELSE 1e0 - ml_prob END AS ml_confidence,
  CASE WHEN mlv THEN 'CodeBERT ML detected semantic vulnerability signatures (Confidence: ' || {O.pct('ml_prob')} || ').'
  ELSE 'CodeBERT ML evaluated the code logic structure as safe (Confidence: ' || {O.pct('1e0 - ml_prob')} || ').' END AS ml_rationale,
  CASE WHEN hit THEN 0.9e0 ELSE 1e0 END AS static_confidence,
  CASE WHEN hit THEN 'Static rules triggered: ' || {_joined(3, '; ')} ELSE 'No static vulnerability patterns triggered.' END AS static_rationale FROM pred_vote"""
CONSENSUS = f"""SELECT *, CASE WHEN mlv = hit THEN mlv WHEN hit THEN true ELSE mlv END AS vulnerable,
  round(CASE WHEN mlv = hit THEN (ml_confidence + static_confidence) / 2 WHEN hit THEN 0.85e0 ELSE ml_confidence END, 4) AS consensus_score,
  CASE WHEN mlv = hit THEN coalesce(ml_cwe, static_cwe) WHEN hit THEN static_cwe ELSE ml_cwe END AS final_cwe FROM ({_ML_OPINION})"""


@query("ml_opinion", f"SELECT snippet_id, mlv AS ml_vulnerable, round(ml_confidence, 6) AS ml_confidence, ml_cwe, ml_rationale FROM ({_ML_OPINION})")
def ml_opinion(spark, sf_dir):
    return consensus.ml_opinion(_snippets(spark, sf_dir)).select(
        "snippet_id", "ml_vulnerable", F.round("ml_confidence", 6).alias("ml_confidence"), "ml_cwe", "ml_rationale")


@query("static_opinion", f"SELECT snippet_id, hit AS static_vulnerable, static_confidence, static_cwe, static_rationale FROM ({_ML_OPINION})")
def static_opinion(spark, sf_dir):
    return consensus.static_opinion(_snippets(spark, sf_dir)).select(
        "snippet_id", "static_vulnerable", "static_confidence", "static_cwe", "static_rationale")


@query("agent_consensus", f"""SELECT c.snippet_id, c.vulnerable, c.consensus_score, c.final_cwe,
  (SELECT count(*) FROM dim_compliance d WHERE c.vulnerable AND d.cwe = upper(c.final_cwe)) AS compliance_issues FROM ({CONSENSUS}) c""")
def agent_consensus(spark, sf_dir):
    agreed = consensus.consensus(_snippets(spark, sf_dir))
    per_cwe = {}
    for cwe, _ in fixed.COMPLIANCE:
        per_cwe[cwe] = per_cwe.get(cwe, 0) + 1
    issues = F.lit(0)
    for cwe, n in per_cwe.items():
        issues = F.when(F.upper("final_cwe") == cwe, n).otherwise(issues)
    return agreed.select("snippet_id", "vulnerable", "consensus_score", "final_cwe",
                         F.when(F.col("vulnerable"), issues).otherwise(0).cast("bigint").alias("compliance_issues"))


_AST_SQL = f"""SELECT snippet_id, CASE WHEN starts_with(code, 'q = ') THEN 'RS001' ELSE 'RS002' END AS rule_id, 1 AS line_number,
  CASE WHEN starts_with(code, 'q = ') THEN 4 ELSE 0 END AS column_start,
  CASE WHEN starts_with(code, 'q = ') THEN 44 ELSE 7 + length(regexp_extract(code, '"([^"]*)"', 1)) + 3 END AS column_end,
  substring({O.strip('string_split(code, chr(10))[1]')}, 1, 120) AS snippet,
  CASE WHEN starts_with(code, 'q = ') THEN 'CWE-89' ELSE 'CWE-798' END AS cwe
 FROM snippets WHERE starts_with(code, 'q = ') OR starts_with(code, 'api_key = ')"""
_AST_FIELDS = ["snippet_id", "rule_id", "line_number", "column_start", "column_end", "snippet", "cwe"]


def ast_rows(spark, sf_dir):
    return code_parse.explode_ast(_snippets(spark, sf_dir).select("repo_id", "snippet_id", "file_path", "code"))


@query("ast_secret_rule", f"SELECT * FROM ({_AST_SQL}) WHERE rule_id = 'RS002'")
def ast_secret_rule(spark, sf_dir):
    return ast_rows(spark, sf_dir).where("rule_id = 'RS002'").select(*_AST_FIELDS)


@query("ast_sql_rule", f"SELECT * FROM ({_AST_SQL}) WHERE rule_id = 'RS001'")
def ast_sql_rule(spark, sf_dir):
    return ast_rows(spark, sf_dir).where("rule_id = 'RS001'").select(*_AST_FIELDS)


@query("udtf_ast_findings", _AST_SQL)
def udtf_ast_findings(spark, sf_dir):
    return ast_rows(spark, sf_dir).select(*_AST_FIELDS)


@query("file_scan_record", f"""SELECT a.snippet_id, s.file_path, rule_id, 'CRITICAL' AS severity, line_number, column_start, column_end, a.snippet,
  'vulnerability_detected' AS status, 0.95e0 AS business_impact_score, false AS compliance_verified, 'semgrep --config=auto ' || s.file_path AS sandbox_command,
  'SCAN_FLAGGED' AS model_armor_status, CASE WHEN rule_id = 'RS001' THEN {O.lit(fixed.AST_SQL_CONCAT[6])} ELSE {O.lit(fixed.AST_SECRET[6])} END AS patch_instruction,
  s.file_path AS location_file, line_number AS location_line, a.snippet AS location_snippet
 FROM ({_AST_SQL}) a JOIN snippets s USING (snippet_id)""")
def file_scan_record(spark, sf_dir):
    location = F.struct(F.col("file_path").alias("file"), F.col("line_number").alias("line"), "snippet")
    payload = F.struct(
        F.lit("vulnerability_detected").alias("status"), F.col("business_impact").alias("business_impact_score"),
        F.lit(False).alias("compliance_verified"), F.concat(F.lit("semgrep --config=auto "), "file_path").alias("sandbox_command"),
        F.lit("SCAN_FLAGGED").alias("model_armor_status"), F.col("remediation").alias("patch_instruction"), location.alias("location"))
    record = ast_rows(spark, sf_dir).withColumn("agent_payload", payload)
    return record.select("snippet_id", "file_path", "rule_id", "severity", "line_number", "column_start", "column_end", "snippet",
                         "agent_payload.status", "agent_payload.business_impact_score", "agent_payload.compliance_verified",
                         "agent_payload.sandbox_command", "agent_payload.model_armor_status", "agent_payload.patch_instruction",
                         *[F.col(f"agent_payload.location.{c}").alias(f"location_{c}") for c in ("file", "line", "snippet")])


@query("snippet_trim", f"""SELECT doc_id, pos, substring({O.strip('line')}, 1, 120) AS trimmed FROM (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM (
   SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS lines
   FROM (SELECT doc_id, regexp_replace(text, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g') AS text FROM documents) WHERE text <> ''))""")
def snippet_trim(spark, sf_dir):
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.code_lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("pos"), F.substring(text.strip(F.col("line")), 1, 120).alias("trimmed"))


@query("vector_norm_dot", """SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
  round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS dot_reversed FROM embeddings""")
def vector_norm_dot(spark, sf_dir):
    v = F.col("embedding")
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(norm(v), 6).alias("norm"), F.round(dot(v, F.reverse(v)), 6).alias("dot_reversed"))


def _report_sql():
    line = lambda *p: " || ".join(O.lit(x) if i % 2 == 0 else f"CAST({x} AS VARCHAR)" for i, x in enumerate(p))
    block = " || chr(10) || ".join([
        line("\n### [", "rank", "] ", "type", " (", "severity", ")"), line("- **CWE Mapping:** `", "predicted_cwe", "`"),
        line("- **OWASP Category:** `", "owasp", "`"), line("- **Location:** `", "file", "` inside `", "function", "` (Lines ", "lines", ")"),
        line("- **Confidence:** `", O.pct("confidence"), "`"), line("- **Advisory Detail:** ", "reason"),
        line("- **Remediation Action:** ", "recommendation")])
    weight = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 2 END"
    table = [("Files Scanned", "files_scanned"), ("Functions Analyzed", "functions_scanned"), ("Total Vulnerabilities Identified", "total_vulnerabilities"),
             ("Critical Issues", "critical_issues"), ("High Issues", "high_issues"), ("Medium Issues", "medium_issues"), ("Low Issues", "low_issues")]
    parts = [O.lit(f"# {report.PRODUCT} Executive Security Report"), O.lit("\n## 1. Executive Summary"), O.lit(fixed.REPORT_INTRO.format(product=report.PRODUCT)),
             O.lit("\n### Security Scorecard"), line("- **Security Grade:** `", "security_grade", "`"),
             line("- **Security Score:** `", "repository_score", "/100` (Higher is better)"), line("- **Business Impact Severity:** `", "business_impact", "`"),
             line("- **Vulnerability Density:** `", "vulnerability_density", "%` of functions flagged."), O.lit("\n### Scan Scope & Coverage"),
             O.lit("| Metric | Count |"), O.lit("| :--- | :--- |"), *[line(f"| {a} | ", b, " |") for a, b in table],
             O.lit("\n## 2. Regulatory Compliance Posture"),
             f"CASE WHEN violated IS NULL THEN {O.lit(fixed.REPORT_COMPLIANT)} ELSE {O.lit(fixed.REPORT_VIOLATED)} || chr(10) || violated END",
             O.lit("\n## 3. High-Risk Vulnerability Details"), f"coalesce(blocks, {O.lit(fixed.REPORT_CLEAN)})",
             O.lit("\n## 4. Strategic Remediation Roadmap"), ROADMAP_SQL]
    text_sql = " || chr(10) || ".join(parts)
    return f"""SELECT s.repo_id, {text_sql} AS report FROM repo_score s
 LEFT JOIN (SELECT repo_id, string_agg('- **Non-compliance:** `' || violation || '`', chr(10) ORDER BY violation) AS violated FROM repo_violation GROUP BY 1) c ON s.repo_id = c.repo_id
 LEFT JOIN (SELECT repo_id, string_agg({block}, chr(10) ORDER BY rank) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {weight} DESC, snippet_id) AS rank FROM finding)
   WHERE rank <= 10 GROUP BY 1) b ON s.repo_id = b.repo_id"""


ROADMAP_SQL = f"""(CASE WHEN total_vulnerabilities > 0 THEN concat_ws(chr(10), {O.lit(fixed.ROADMAP_HEAD)},
  CASE WHEN critical_issues > 0 OR high_issues > 0 THEN {O.lit(fixed.ROADMAP_CRITICAL)} END, CASE WHEN medium_issues > 0 THEN {O.lit(fixed.ROADMAP_MEDIUM)} END,
  {O.lit(fixed.ROADMAP_MONITOR.format(product=report.PRODUCT))}) ELSE {O.lit(fixed.ROADMAP_NONE)} END)"""
REPORT_SQL = _report_sql()


@query("report_markdown", REPORT_SQL)
def report_markdown(spark, sf_dir):
    return reports(spark, sf_dir)


@query("roadmap_text", f"SELECT file_path, {ROADMAP_SQL} AS roadmap FROM (SELECT file_path, count(*) FILTER (WHERE vulnerable) AS total_vulnerabilities, {O.severity_counts('vulnerable')} FROM pred GROUP BY 1)")
def roadmap_text(spark, sf_dir):
    by_file = score.scan_summary(predictions(spark, sf_dir), key="file_path", file="repo_id")
    return by_file.select("file_path", report.roadmap().alias("roadmap"))
