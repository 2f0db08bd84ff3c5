"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import rules, text
from ..operators import dataset, detect, jobs, report, score
from ..sources.dims import dim
from ..sources.fixtures import view
from ..sources.tables import read_table
from . import oracle as O
from .functions import REMEDIATION_SQL
from .registry import explained, findings, predictions, query


@query("nonempty_code", "SELECT file_change_id, code FROM cvefixes_method_change WHERE code IS NOT NULL AND code <> ''")
def nonempty_code(spark, sf_dir):
    return dataset.nonempty_code(view(spark, sf_dir, "cvefixes_method_change")).select("file_change_id", "code")


@query("label_from_before_change", f"SELECT file_change_id, before_change, {O.LABEL} AS label FROM cvefixes_method_change")
def label_from_before_change(spark, sf_dir):
    return view(spark, sf_dir, "cvefixes_method_change").select(
        "file_change_id", "before_change", text.label_from_flag(F.col("before_change")).alias("label"))


@query("language_fill", f"SELECT file_change_id, {O.LANG} AS language FROM cvefixes_file_change")
def language_fill(spark, sf_dir):
    return view(spark, sf_dir, "cvefixes_file_change").select(
        "file_change_id", text.fill_language(F.col("programming_language")).alias("language"))


_TOKENED = f"SELECT snippet_id, {O.token_sql('language')} || ' ' || code AS code FROM snippets"


@query("min_length", f"SELECT snippet_id, length(code) AS n FROM ({_TOKENED}) WHERE length(code) >= 20")
def min_length(spark, sf_dir):
    tokened = view(spark, sf_dir, "snippets").select(
        "snippet_id", text.inject_language_token(F.col("code"), F.col("language")).alias("code"))
    return tokened.where(F.length("code") >= 20).select("snippet_id", F.length("code").alias("n"))


@query("ext_to_language", """SELECT snippet_id, e.language FROM snippets s
 JOIN dim_extension e ON lower(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1)) = e.ext""")
def ext_to_language(spark, sf_dir):
    paths = view(spark, sf_dir, "snippets").select("snippet_id", text.path_extension(F.col("file_path")).alias("ext"))
    return paths.join(dim(spark, "dim_extension"), "ext").select("snippet_id", "language")


_URL_PATH = "regexp_replace(url, '^[a-z]+://', '')"


@query("path_exclude", f"""SELECT page_id, url FROM pages WHERE NOT len(list_filter(
  string_split(regexp_replace({_URL_PATH}, '/?[^/]*$', ''), '/'),
  lambda d: starts_with(d, '.') OR d IN ('venv', '.git', '__pycache__', 'node_modules'))) > 0""")
def path_exclude(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(~text.path_excluded(F.regexp_replace("url", "^[a-z]+://", "")))


@query("vulnerable_only", "SELECT snippet_id, confidence, predicted_cwe FROM pred WHERE vulnerable")
def vulnerable_only(spark, sf_dir):
    return predictions(spark, sf_dir).where("vulnerable").select("snippet_id", "confidence", "predicted_cwe")


@query("blank_guard", f"""SELECT file_change_id, code IS NULL OR {O.strip('code')} = '' AS is_blank,
  CASE WHEN code IS NULL OR {O.strip('code')} = '' THEN 0e0 ELSE 0.25e0 END AS confidence, 'None' AS severity,
  CASE WHEN code IS NULL OR {O.strip('code')} = '' THEN {O.lit(fixed.BLANK_RECOMMENDATION)} ELSE {O.lit(fixed.SAFE_RECOMMENDATION)} END AS recommendation,
  CASE WHEN code IS NULL OR {O.strip('code')} = '' THEN {O.lit(fixed.BLANK_REASON)} ELSE {O.lit(fixed.SAFE_REASON)} END AS reason
 FROM cvefixes_method_change""")
def blank_guard(spark, sf_dir):
    codes = view(spark, sf_dir, "cvefixes_method_change").select(
        "file_change_id", "code", F.lit("").alias("file_path"), F.lit(0.25).alias("ml_prob"))
    return detect.predict(codes).select("file_change_id", "is_blank", "confidence", "severity", "recommendation",
                                        F.col("safe_reason").alias("reason"))


@query("finding_projection", """SELECT repo_id, f.snippet_id, type, f.severity, confidence, f.predicted_cwe, owasp, file, function, lines, reason, recommendation, risk_score,
  root_cause, why_dangerous, secure_coding_recommendation, example_secure_implementation, priority_level FROM finding f JOIN remediated r USING (snippet_id)""",
       {"remediated": REMEDIATION_SQL})
def finding_projection(spark, sf_dir):
    """Findings with the fields of their nested ``remediation`` record spread out."""
    return findings(spark, sf_dir).select("*", "remediation.*").drop("remediation")


_RISK_FIELDS = ["repo_id", "repository_score", "security_grade", "business_impact", "business_impact_score", "confidence",
                *score.ISSUE_COLUMNS]


@query("risk_summary_projection", f"SELECT {', '.join(_RISK_FIELDS)} FROM repo_score")
def risk_summary_projection(spark, sf_dir):
    return score.repo_scores(predictions(spark, sf_dir)).select(*_RISK_FIELDS)


@query("predict_projection", """SELECT snippet_id, 'success' AS status, vulnerable, confidence, severity, predicted_cwe, cwe_name,
  recommendation AS recommendations, CASE WHEN vulnerable THEN round(confidence * 0.9e0, 2) ELSE 0e0 END AS business_impact_score,
  owasp, description FROM pred""")
def predict_projection(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "snippet_id", F.lit("success").alias("status"), "vulnerable", "confidence", "severity", "predicted_cwe", "cwe_name",
        F.col("recommendation").alias("recommendations"),
        F.when(F.col("vulnerable"), F.round(F.col("confidence") * 0.9, 2)).otherwise(0.0).alias("business_impact_score"),
        "owasp", "description")


@query("lookup_by_key", """SELECT j.id AS job_id, u.full_name, u.id IS NOT NULL AS found FROM vulnerability_jobs j
 LEFT JOIN users u ON u.email = j.user_id || '@example.com'""")
def lookup_by_key(spark, sf_dir):
    asked = view(spark, sf_dir, "vulnerability_jobs").select(
        F.col("id").alias("job_id"), F.concat("user_id", F.lit("@example.com")).alias("email"))
    return asked.join(view(spark, sf_dir, "users"), "email", "left").select(
        "job_id", "full_name", F.col("id").isNotNull().alias("found"))


@query("scan_authorisation", """SELECT j.id AS job_id, CASE WHEN r.user_id IS NULL THEN 404 WHEN r.user_id <> j.user_id THEN 403 ELSE 200 END AS http_status
 FROM vulnerability_jobs j LEFT JOIN repositories r ON j.repository_id = r.id""")
def scan_authorisation(spark, sf_dir):
    requests = view(spark, sf_dir, "vulnerability_jobs").select(F.col("id").alias("job_id"), "user_id", "repository_id")
    return jobs.scan_authorisation(requests, view(spark, sf_dir, "repositories")).select("job_id", "http_status")


_SEVERITY = ("CASE WHEN business_risk_score >= 0.8e0 THEN 'Critical' WHEN business_risk_score >= 0.6e0 THEN 'High' "
             "WHEN business_risk_score >= 0.3e0 THEN 'Medium' ELSE 'Low' END")


@query("status_severity_filter", f"""SELECT id, repository_id, severity FROM (SELECT *, {_SEVERITY} AS severity FROM vulnerability_jobs)
 WHERE patch_status = 'FAILED' AND severity = 'Low' AND vulnerability_type = 'SQL Injection' AND branch = 'main' AND contains(lower(target_file_path), 'm1')""")
def status_severity_filter(spark, sf_dir):
    return jobs.filter_jobs(view(spark, sf_dir, "vulnerability_jobs"), status="FAILED", severity="Low", kind="SQL Injection", branch="main",
                            search="M1").select(
        "id", "repository_id", "severity")


@query("report_preview", f"SELECT doc_id, substring(text, 1, 1500) || {O.lit(fixed.PREVIEW_SUFFIX)} AS report_preview FROM documents")
def report_preview(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", report.preview(F.col("text")).alias("report_preview"))


_PASSWORD = "concat(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END, CASE WHEN c_nationkey < 20 THEN cast(c_custkey AS string) ELSE '' END)"
_SPECIAL_SQL = O.any_of("password", *fixed.PASSWORD_SPECIALS)


@query("registration_quality", f"""SELECT *, has_upper AND has_digit AND has_special AND name_length_ok AND password_length_ok AS accepted
 FROM (SELECT c_custkey, regexp_matches(password, '[A-Z]') AS has_upper, regexp_matches(password, '[0-9]') AS has_digit,
  {_SPECIAL_SQL} AS has_special, length(c_name) BETWEEN 2 AND 255 AS name_length_ok, length(password) BETWEEN 8 AND 128 AS password_length_ok
 FROM (SELECT *, {_PASSWORD} AS password FROM customer))""")
def registration_quality(spark, sf_dir):
    asked = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("full_name"), F.expr(_PASSWORD).alias("password"))
    return jobs.registration_quality(asked).drop("full_name", "password")


_COMMAND = ("CASE event_type WHEN 'error' THEN concat('rm -rf /tmp/', cast(user_id AS string)) "
            "WHEN 'click' THEN concat('run malicious-', cast(user_id AS string)) ELSE concat('pytest tests/', cast(user_id AS string)) END")


@query("command_guard", f"""SELECT event_id, CASE WHEN {O.any_of('command', *fixed.GUARD_WORDS)} THEN 'BLOCKED' ELSE 'SECURE' END AS verdict
 FROM (SELECT event_id, {_COMMAND} AS command FROM events)""")
def command_guard(spark, sf_dir):
    log = read_table(spark, sf_dir, "events").select("event_id", F.expr(_COMMAND).alias("command"))
    return log.select("event_id", rules.guard_verdict(F.col("command")).alias("verdict"))


@query("repo_name_from_url", "SELECT id, regexp_replace(replace(replace(github_repo_url || '.git/', 'https://github.com/', ''), '.git', ''), '/$', '') AS repo_name FROM repositories")
def repo_name_from_url(spark, sf_dir):
    return view(spark, sf_dir, "repositories").select(
        "id", text.repo_name_from_url(F.concat("github_repo_url", F.lit(".git/"))).alias("repo_name"))


@query("lines_text", "SELECT snippet_id, lines FROM finding")
def lines_text(spark, sf_dir):
    return explained(spark, sf_dir).select("snippet_id", detect.lines_text().alias("lines"))
