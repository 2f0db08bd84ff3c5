"""Dashboard figures from findings, repository scores and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from .graph import framework_of
from .jobs import duration_units
from .score import impact_band

PARTIAL_SHARE = 10  # a rule broken by fewer than one in this many functions counts as partly met


def severity_share(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("severity").agg(F.count("*").alias("findings"))
    # Four named severities: the window runs over a handful of rows.
    total = F.sum("findings").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.round(F.col("findings") * 100 / total, 2))


def compliance_checks(scores: DataFrame, findings: DataFrame, key: str = "repo_id") -> DataFrame:
    """Every catalogue rule checked on every repository: passed, partial or failed.

    Findings are counted per (repository, CWE) before they meet the rules, so the join adds at most three
    rows per counted pair. ``findings`` may be rows or ``score.finding_counts`` of them.
    """
    rules = sorted({violation for _, violation in fixed.COMPLIANCE})
    by_cwe = findings.groupBy(key, "predicted_cwe").agg((F.sum("functions") if "functions" in findings.columns else F.count("*")).alias("_n"))
    from .detect import compliance
    broken = compliance(by_cwe).groupBy(key, "violation").agg(F.sum("_n").alias("broken"))
    every = scores.select(key, "functions_scanned", F.explode(F.array(*[F.lit(r) for r in rules])).alias("violation"))
    count = F.coalesce(F.col("broken"), F.lit(0))
    return (every.join(broken, [key, "violation"], "left")
            .withColumn("broken", count)
            .withColumn("status", F.when(F.col("broken") == 0, "Compliant")
                        .when(F.col("broken") * PARTIAL_SHARE < F.col("functions_scanned"), "Partially Compliant")
                        .otherwise("Non-Compliant"))
            .withColumn("framework", framework_of(F.col("violation"))))


def compliance_status(checks: DataFrame) -> DataFrame:
    counts = checks.groupBy("status").agg(F.count("*").alias("checks"))
    total = F.sum("checks").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.round(F.col("checks") * 100 / total).cast("int"))


def framework_score(checks: DataFrame) -> DataFrame:
    met = F.sum(F.when(F.col("status") == "Compliant", 1).otherwise(0))
    return (checks.groupBy("framework").agg(met.cast("bigint").alias("_met"), F.count("*").alias("checks"))
            .withColumn("score", F.round(F.col("_met") * 100 / F.col("checks")).cast("int"))
            .withColumn("status", F.when(F.col("score") >= 80, "Compliant").when(F.col("score") >= 60, "Partially Compliant")
                        .otherwise("Non-Compliant")).drop("_met"))


def top_noncompliant(findings: DataFrame, n: int = 4, key: str = "repo_id") -> DataFrame:
    """OWASP areas with the most failed (repository, area) checks."""
    failed = findings.select(key, "owasp").distinct().groupBy("owasp").agg(F.count("*").alias("failed_checks"))
    return failed.orderBy(F.desc("failed_checks"), F.asc("owasp")).limit(n)


def risk_trend(jobs: DataFrame, days: int = 30) -> DataFrame:
    """Mean risk per week over the last ``days`` days of the table."""
    dated = jobs.withColumn("_day", F.to_date("created_ts"))
    newest = dated.agg(F.max("_day")).scalar()
    recent = dated.where(F.col("_day") > F.date_sub(newest, days))
    units = recent.groupBy(F.date_trunc("week", F.col("_day")).cast("date").alias("week")).agg(
        F.count("*").alias("jobs"), F.sum(duration_units("business_risk_score")).alias("_units"))
    return units.select(F.col("week").cast("string").alias("week"), "jobs",
                        (F.round(F.col("_units") / F.col("jobs") / 100) / 10000).alias("mean_risk"))


def recent_scans(jobs: DataFrame) -> DataFrame:
    """Newest scan and worst severity per repository."""
    return (jobs.where("repository_id is not null").groupBy("repository_id")
            .agg(F.max("created_ts").alias("last_scan"), F.max("business_risk_score").alias("_worst"))
            .select("repository_id", F.unix_micros(F.col("last_scan").cast("timestamp")).alias("last_scan_us"),
                    impact_band(F.col("_worst")).alias("worst_severity"))
            .orderBy(F.desc("last_scan_us"), "repository_id"))


def dashboard(scores: DataFrame, jobs: DataFrame, checks: DataFrame) -> DataFrame:
    """One row of headline figures, put together from three one-row aggregates."""
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")
    parts = [scores.agg(F.count("*").alias("repositories"), F.sum("total_vulnerabilities").alias("vulnerabilities"),
                        F.sum(F.round(F.col("risk_score") * 10).cast("bigint")).alias("_tenths")),
             jobs.agg(count(F.col("patch_status") == "VERIFIED").alias("patches")),
             checks.agg(F.count("*").alias("_checks"), count(F.col("status") == "Compliant").alias("_met"))]
    stacked = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return one.select(
        "repositories", "vulnerabilities", (F.round(F.col("_tenths") / F.col("repositories")) / 10).alias("business_risk_score"),
        "patches", F.round(F.col("_met") * 100 / F.col("_checks")).cast("int").alias("compliance_percent"))


def priority_repo(scores: DataFrame, key: str = "repo_id") -> DataFrame:
    return scores.orderBy(F.desc("business_impact_score"), F.desc("risk_score"), F.asc(key)).limit(1).select(
        key, "business_impact", "business_impact_score", "risk_score")


