"""Aggregates, windows, limits and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dataset, detect, jobs, kpi, ml, report, score
from ..session import staged
from ..sources.fixtures import view
from ..sources.tables import read_table
from . import oracle as O
from .registry import predictions, query, vulnerable

_ISSUES = ", ".join(score.ISSUE_COLUMNS)


def _scores(spark, sf_dir):
    return score.repo_scores(predictions(spark, sf_dir))


@query("severity_counts", f"SELECT repo_id, {O.severity_counts()} FROM vuln GROUP BY 1")
def severity_counts(spark, sf_dir):
    return score.severity_counts(vulnerable(spark, sf_dir))


_SCORE_FIELDS = ["repo_id", "total_vulnerabilities", *score.ISSUE_COLUMNS, "risk_score", "repository_score", "security_grade",
                 "business_impact", "business_impact_score", "confidence"]


@query("repo_risk_score", f"SELECT {', '.join(_SCORE_FIELDS)} FROM repo_score")
def repo_risk_score(spark, sf_dir):
    return _scores(spark, sf_dir).select(*_SCORE_FIELDS)


_UDAF = O.SCORES.format(summary=f"""(SELECT repo_id, file_path, 1 AS files_scanned, count(*) AS functions_scanned, count(*) FILTER (WHERE vulnerable) AS total_vulnerabilities,
  {O.severity_counts('vulnerable')}, CAST(coalesce(sum(CAST(round(confidence * 10000) AS BIGINT)) FILTER (WHERE vulnerable), 0) AS BIGINT) AS confidence_units FROM pred GROUP BY 1, 2)""")


@query("udaf_risk", f"SELECT repo_id, file_path, risk_score, security_grade, business_impact_score, confidence FROM ({_UDAF})")
def udaf_risk(spark, sf_dir):
    """Scores per file, from built-in aggregates."""
    keyed = predictions(spark, sf_dir).withColumn("unit", F.struct("repo_id", "file_path"))
    return score.repo_scores(keyed, key="unit").select(
        "unit.repo_id", "unit.file_path", "risk_score", "security_grade", "business_impact_score", "confidence")


@query("security_grade", "SELECT repo_id, risk_score, security_grade FROM repo_score")
def security_grade(spark, sf_dir):
    return _scores(spark, sf_dir).select("repo_id", "risk_score", "security_grade")


@query("business_impact", "SELECT repo_id, business_impact, business_impact_score FROM repo_score")
def business_impact(spark, sf_dir):
    return _scores(spark, sf_dir).select("repo_id", "business_impact", "business_impact_score")


@query("avg_confidence", "SELECT repo_id, confidence FROM repo_score")
def avg_confidence(spark, sf_dir):
    return _scores(spark, sf_dir).select("repo_id", "confidence")


@query("scan_metrics", "SELECT repo_id, files_scanned, functions_scanned, total_vulnerabilities FROM repo_score")
def scan_metrics(spark, sf_dir):
    return _scores(spark, sf_dir).select("repo_id", "files_scanned", "functions_scanned", "total_vulnerabilities")


@query("compliance_set", "SELECT repo_id, string_agg(violation, ' | ' ORDER BY violation) AS violations FROM repo_violation GROUP BY 1")
def compliance_set(spark, sf_dir):
    return score.compliance_set(vulnerable(spark, sf_dir)).select("repo_id", F.array_join("violations", " | ").alias("violations"))


@query("sort_violations", """SELECT repo_id, violation, row_number() OVER (PARTITION BY repo_id ORDER BY violation) AS position FROM repo_violation""")
def sort_violations(spark, sf_dir):
    return score.compliance_set(vulnerable(spark, sf_dir)).select("repo_id", F.posexplode("violations").alias("pos", "violation")).select(
        "repo_id", "violation", (F.col("pos") + 1).alias("position"))


@query("violation_union", """SELECT violation, sum(n)::BIGINT AS repositories FROM (SELECT violation, 1 AS n FROM repo_violation) GROUP BY 1""")
def violation_union(spark, sf_dir):
    found = vulnerable(spark, sf_dir)
    test = found.where("file_path like 'tests/%'").select("repo_id", "predicted_cwe")
    rest = found.where("file_path not like 'tests/%'").select("repo_id", "predicted_cwe")
    sets = [detect.compliance(part.distinct()).select("repo_id", "violation") for part in (test, rest)]
    return sets[0].union(sets[1]).distinct().groupBy("violation").agg(F.count("*").alias("repositories"))


@query("vuln_density", "SELECT repo_id, vulnerability_density FROM repo_score")
def vuln_density(spark, sf_dir):
    return _scores(spark, sf_dir).select("repo_id", "vulnerability_density")


_LEVELS = ["critical", "high", "medium", "low", "info"]


@query("file_scan_summary", f"""SELECT file_path, count(*) FILTER (WHERE vulnerable) AS total_findings,
  count(*) FILTER (WHERE vulnerable AND severity = 'Critical') > 0 AS has_critical,
  {', '.join(f"count(*) FILTER (WHERE vulnerable AND lower(severity) = '{x}') AS {x}" for x in _LEVELS)} FROM pred GROUP BY 1""")
def file_scan_summary(spark, sf_dir):
    found = predictions(spark, sf_dir).select("file_path", F.when(F.col("vulnerable"), F.col("severity")).alias("severity"))
    return score.file_summary(found)


@query("class_counts_min", f"SELECT label, count(*) AS class_count, (SELECT n FROM class_size) AS sample_size FROM unique_rows GROUP BY 1")
def class_counts_min(spark, sf_dir):
    from .joins import fix_tables
    # The label may differ between copies of one text, so the kept copy matters.
    unique = dataset.unique_samples(fix_tables(spark, sf_dir))
    return dataset.sample_size(unique, 5000).select("label", "class_count", F.col("n").alias("sample_size"))


@query("dedup_sha256", """SELECT doc_id, code_hash FROM (SELECT doc_id, sha256(text) AS code_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn
 FROM documents) WHERE rn = 1""")
def dedup_sha256(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dataset.dedup_keep_first(docs, "text", [F.asc("doc_id")]).select("doc_id", "code_hash")


@query("dedup_keep_first", "SELECT min(snippet_id) AS snippet_id, sha256(code) AS code_hash, any_value(code) AS code FROM snippets GROUP BY 2")
def dedup_keep_first(spark, sf_dir):
    return dataset.dedup_keep_first(view(spark, sf_dir, "snippets").select("snippet_id", "code"), "code",
                                    [F.asc("snippet_id")]).select("snippet_id", "code_hash", "code")


@query("job_counters", "SELECT job_id, sum(blocked)::BIGINT AS model_armor_blocked, sum(healed)::BIGINT AS self_healing_count FROM job_events GROUP BY 1")
def job_counters(spark, sf_dir):
    return jobs.job_counters(view(spark, sf_dir, "job_events"))


@query("request_latency", "SELECT count(*) AS total_requests, round(sum(CAST(round(duration_sec * 1000000) AS BIGINT)) / count(*) / 100) / 10000 AS average_latency_sec FROM job_events")
def request_latency(spark, sf_dir):
    return jobs.request_latency(view(spark, sf_dir, "job_events"))


METRICS_SQL = """SELECT n, tp, fp, fn, (n - fp - fn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1
 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE l AND p) AS tp, count(*) FILTER (WHERE NOT l AND p) AS fp, count(*) FILTER (WHERE l AND NOT p) AS fn FROM {rows})"""


def vote_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).select(F.col("ml_vulnerable").cast("int").alias("label"), F.col("vulnerable").cast("int").alias("prediction"))


@query("binary_metrics", METRICS_SQL.format(rows="(SELECT mlv AS l, vulnerable AS p FROM pred)"))
def binary_metrics(spark, sf_dir):
    return ml.binary_metrics(vote_predictions(spark, sf_dir))


@query("first_finding_per_repo", """SELECT r.repo_id, f.snippet_id, f.file_path, f.predicted_cwe, CASE WHEN f.snippet_id IS NULL THEN 'secure' ELSE 'vulnerable' END AS status
 FROM (SELECT DISTINCT repo_id FROM snippets) r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, snippet_id) AS rn FROM vuln) f
 ON r.repo_id = f.repo_id AND f.rn = 1""")
def first_finding_per_repo(spark, sf_dir):
    found = vulnerable(spark, sf_dir).select("repo_id", "file_path", "snippet_id", "predicted_cwe", F.col("predicted_cwe").alias("rule_id"),
                                             "line_number", F.col("snippet_id").alias("column_start"))
    repos = view(spark, sf_dir, "snippets").select("repo_id").distinct()
    return jobs.first_finding(found, repos).select("repo_id", "snippet_id", "file_path", "predicted_cwe", "status")


@query("severity_share", "SELECT severity, count(*) AS findings, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM vuln GROUP BY 1")
def severity_share(spark, sf_dir):
    return kpi.severity_share(vulnerable(spark, sf_dir))


_CHECKS = """(SELECT *, CASE WHEN broken = 0 THEN 'Compliant' WHEN broken * 10 < functions_scanned THEN 'Partially Compliant' ELSE 'Non-Compliant' END AS status,
  CASE WHEN starts_with(violation, 'PCI-DSS') THEN 'PCI-DSS' WHEN starts_with(violation, 'OWASP') THEN 'OWASP' WHEN starts_with(violation, 'SOC2') THEN 'SOC2'
   WHEN starts_with(violation, 'HIPAA') THEN 'HIPAA' ELSE 'Other' END AS framework
 FROM (SELECT s.repo_id, s.functions_scanned, c.violation, count(v.snippet_id) AS broken FROM repo_summary s CROSS JOIN (SELECT DISTINCT violation FROM dim_compliance) c
  LEFT JOIN (SELECT repo_id, violation, snippet_id FROM vuln JOIN dim_compliance ON predicted_cwe = cwe) v ON v.repo_id = s.repo_id AND v.violation = c.violation GROUP BY 1, 2, 3))"""


def _counts(spark, sf_dir):
    """One scan of the predictions."""
    return staged(score.finding_counts(predictions(spark, sf_dir)), "finding-counts")


def _checks(spark, sf_dir, counts=None):
    counts = _counts(spark, sf_dir) if counts is None else counts
    return kpi.compliance_checks(score.summary_of_counts(counts), counts.where("vulnerable"))


@query("compliance_status", f"SELECT status, count(*) AS checks, CAST(round(count(*) * 100 / sum(count(*)) OVER ()) AS INTEGER) AS percent FROM {_CHECKS} GROUP BY 1")
def compliance_status(spark, sf_dir):
    return kpi.compliance_status(_checks(spark, sf_dir))


@query("framework_score", f"""SELECT *, CASE WHEN score >= 80 THEN 'Compliant' WHEN score >= 60 THEN 'Partially Compliant' ELSE 'Non-Compliant' END AS status
 FROM (SELECT framework, count(*) AS checks, CAST(round(count(*) FILTER (WHERE status = 'Compliant') * 100 / count(*)) AS INTEGER) AS score FROM {_CHECKS} GROUP BY 1)""")
def framework_score(spark, sf_dir):
    return kpi.framework_score(_checks(spark, sf_dir))


@query("top_noncompliant", "SELECT owasp, count(DISTINCT repo_id) AS failed_checks FROM vuln GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def top_noncompliant(spark, sf_dir):
    return kpi.top_noncompliant(vulnerable(spark, sf_dir))


@query("dashboard_kpis", f"""SELECT a.*, b.patches, c.compliance_percent FROM
 (SELECT count(*) AS repositories, sum(total_vulnerabilities)::BIGINT AS vulnerabilities, round(sum(CAST(round(risk_score * 10) AS BIGINT)) / count(*)) / 10 AS business_risk_score FROM repo_score) a,
 (SELECT count(*) FILTER (WHERE patch_status = 'VERIFIED') AS patches FROM vulnerability_jobs) b,
 (SELECT CAST(round(count(*) FILTER (WHERE status = 'Compliant') * 100 / count(*)) AS INTEGER) AS compliance_percent FROM {_CHECKS}) c""")
def dashboard_kpis(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return kpi.dashboard(score.with_scores(score.summary_of_counts(counts)), view(spark, sf_dir, "vulnerability_jobs"), _checks(spark, sf_dir, counts))


@query("recent_scans", """SELECT repository_id, epoch_us(max(created_ts)) AS last_scan_us, CASE WHEN max(business_risk_score) >= 0.8e0 THEN 'Critical' WHEN max(business_risk_score) >= 0.6e0 THEN 'High'
  WHEN max(business_risk_score) >= 0.3e0 THEN 'Medium' ELSE 'Low' END AS worst_severity FROM vulnerability_jobs WHERE repository_id IS NOT NULL GROUP BY 1""")
def recent_scans(spark, sf_dir):
    return kpi.recent_scans(view(spark, sf_dir, "vulnerability_jobs"))


@query("risk_trend_weekly", """SELECT CAST(CAST(date_trunc('week', created_ts) AS DATE) AS VARCHAR) AS week, count(*) AS jobs,
  round(sum(CAST(round(business_risk_score * 1000000) AS BIGINT)) / count(*) / 100) / 10000 AS mean_risk FROM vulnerability_jobs
 WHERE CAST(created_ts AS DATE) > (SELECT max(CAST(created_ts AS DATE)) - 30 FROM vulnerability_jobs) GROUP BY 1""")
def risk_trend_weekly(spark, sf_dir):
    return kpi.risk_trend(view(spark, sf_dir, "vulnerability_jobs"))


_WEIGHT = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 2 END"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_WEIGHT} DESC, snippet_id) AS rank FROM vuln"


@query("report_rank", f"SELECT repo_id, snippet_id, severity, rank FROM ({_RANKED}) WHERE rank <= 10")
def report_rank(spark, sf_dir):
    return report.top_findings(vulnerable(spark, sf_dir)).select("repo_id", "snippet_id", "severity", "rank")


@query("top10_by_severity", f"SELECT file_path, snippet_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {_WEIGHT} DESC, snippet_id) AS rank FROM vuln) WHERE rank <= 10")
def top10_by_severity(spark, sf_dir):
    return report.top_findings(vulnerable(spark, sf_dir), key="file_path").select("file_path", "snippet_id", "severity")


LATEST_SQL = """SELECT job_id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_ts DESC, event_id DESC) AS rn FROM job_events) WHERE rn = 1"""


@query("latest_job_status", LATEST_SQL)
def latest_job_status(spark, sf_dir):
    return jobs.latest_status(view(spark, sf_dir, "job_events"))


_EPOCHS = """(SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS epoch, l_quantity / 50 AS val_f1 FROM lineitem)"""


@query("early_stop_trace", f"""SELECT run, epoch, best_f1, no_improvement, coalesce(max(CASE WHEN no_improvement >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_stop
 FROM (SELECT *, CAST(epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0) AS INTEGER) AS no_improvement
  FROM (SELECT *, val_f1 > coalesce(max(val_f1) OVER w, 0e0) AS improved, greatest(coalesce(max(val_f1) OVER w, 0e0), val_f1) AS best_f1 FROM {_EPOCHS}
   WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""")
def early_stop_trace(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    epochs = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.row_number().over(order).alias("epoch"), (F.col("l_quantity") / 50).alias("val_f1"))
    return jobs.early_stop(epochs, "run").select("run", "epoch", "best_f1", "no_improvement", "after_stop")


@query("priority_repo", "SELECT repo_id, business_impact, business_impact_score, risk_score FROM repo_score ORDER BY business_impact_score DESC, risk_score DESC, repo_id LIMIT 1")
def priority_repo(spark, sf_dir):
    return kpi.priority_repo(_scores(spark, sf_dir))


@query("document_source_risk", f"""SELECT source, functions_scanned, total_vulnerabilities, risk_score, security_grade, repository_score FROM ({O.SCORES.format(
  summary=f'''(SELECT source, count(*) AS functions_scanned, count(*) FILTER (WHERE hit) AS total_vulnerabilities, 0 AS critical_issues, count(*) FILTER (WHERE hit) AS high_issues,
   0 AS medium_issues, 0 AS low_issues, count(*) FILTER (WHERE hit) * 9500 AS confidence_units FROM (SELECT source, {O.rule("hardcoded_secret", "text")} AS hit FROM documents) GROUP BY 1)''')})""")
def document_source_risk(spark, sf_dir):
    """Secret rule over all documents, enriched and scored per source; clean sources keep their row."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("code"))
    hit = detect.with_rules(docs).select("doc_id", "source", F.col("hit_hardcoded_secret").alias("vulnerable"))
    rated = detect.enrich(hit.withColumns({"predicted_cwe": F.when(F.col("vulnerable"), "CWE-798"), "confidence": F.lit(0.95)}))
    return score.repo_scores(rated, key="source", file="doc_id").select(
        "source", "functions_scanned", "total_vulnerabilities", "risk_score", "security_grade", "repository_score")


