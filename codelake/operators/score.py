"""Severity counts, risk scores and grades per repository.

The per-repository work is one grouped aggregate with conditional sums, so a repository that holds a
third of all rows is combined on the map side first and costs one small row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .detect import compliance

SEVERITIES = ["Critical", "High", "Medium", "Low"]
ISSUE_COLUMNS = ["critical_issues", "high_issues", "medium_issues", "low_issues"]


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def severity_aggregates(flag: Column | None = None, severity: str = "severity") -> list[Column]:
    """Counts of the four named severities; a missing one is Medium, another name is not counted."""
    level = F.coalesce(F.col(severity), F.lit("Medium"))
    on = F.lit(True) if flag is None else flag
    return [_count(on & (level == name)).alias(column) for name, column in zip(SEVERITIES, ISSUE_COLUMNS)]


def severity_counts(findings: DataFrame, key: str = "repo_id") -> DataFrame:
    return findings.groupBy(key).agg(*severity_aggregates())


def mean_confidence(units: Column, n: Column) -> Column:
    """Mean of confidences given in ten-thousandths, so that the sum is exact; 1.0 without findings."""
    return F.when(n > 0, F.round(units / n) / 10000).otherwise(1.0)


def confidence_units(column: str = "risk_score") -> Column:
    return F.round(F.coalesce(F.col(column), F.lit(1.0)) * 10000).cast("bigint")


def finding_counts(pred: DataFrame, key: str = "repo_id", file: str = "file_path", cwe: bool = True) -> DataFrame:
    """One row per (repository, file, CWE, severity, verdict), or without the CWE, with ``functions`` and ``units``, the confidence sum of findings.

    A small table that one scan of the predictions gives, and from which all figures of a report or dashboard follow.
    """
    bad = F.col("vulnerable")
    return pred.groupBy(key, file, *(["predicted_cwe"] if cwe else []), "severity", "vulnerable").agg(
        F.count("*").alias("functions"), F.sum(F.when(bad, confidence_units("confidence")).otherwise(0)).alias("units"))


def summary_of_counts(counts: DataFrame, key: str = "repo_id", file: str = "file_path", files: DataFrame | None = None) -> DataFrame:
    """One row per repository: files, functions, findings, severities and the confidence sum.

    Files are counted over rows first grouped by (repository, file), which keeps the distinct count inside the same two-step
    aggregate. ``files`` has all scanned files; those without a function count too.
    """
    bad, level, n = F.col("vulnerable"), F.coalesce(F.col("severity"), F.lit("Medium")), F.col("functions")
    on = lambda c, alias: F.sum(F.when(c, n).otherwise(0)).cast("bigint").alias(alias)
    per_file = counts.groupBy(key, file).agg(
        F.sum(n).alias("_functions"), on(bad, "_findings"), *[on(bad & (level == name), column) for name, column in zip(SEVERITIES, ISSUE_COLUMNS)],
        F.sum("units").alias("_units"))
    if files is not None:
        sums = [c for c in per_file.columns if c not in (key, file)]
        empty = files.select(key, file, *[F.lit(0).cast("bigint").alias(c) for c in sums])
        per_file = per_file.unionByName(empty).groupBy(key, file).agg(*[F.sum(c).alias(c) for c in sums])
    return per_file.groupBy(key).agg(
        F.count("*").alias("files_scanned"), F.sum("_functions").alias("functions_scanned"),
        F.sum("_findings").alias("total_vulnerabilities"),
        *[F.sum(c).alias(c) for c in ISSUE_COLUMNS], F.sum("_units").alias("confidence_units"))


def scan_summary(pred: DataFrame, key: str = "repo_id", file: str = "file_path", files: DataFrame | None = None) -> DataFrame:
    return summary_of_counts(finding_counts(pred, key, file, cwe=False), key, file, files)


def summary_of_findings(findings: DataFrame, key: str = "repo_id") -> DataFrame:
    """Finding side of the summary, for callers that hold findings and codebase sizes apart."""
    return findings.groupBy(key).agg(
        F.count("*").alias("total_vulnerabilities"), *severity_aggregates(),
        F.sum(confidence_units()).alias("confidence_units"))


def grade(risk: Column) -> Column:
    return (F.when(risk <= 5.0, "A").when(risk <= 15.0, "B").when(risk <= 30.0, "C")
            .when(risk <= 50.0, "D").otherwise("F"))


def impact_band(score: Column) -> Column:
    return (F.when(score >= 0.8, "Critical").when(score >= 0.6, "High").when(score >= 0.3, "Medium")
            .otherwise("Low"))


def with_scores(summary: DataFrame) -> DataFrame:
    """Risk, grade and impact from the counts.

    Rounding is half-up on the decimal value.
    """
    n, functions = F.col("total_vulnerabilities"), F.col("functions_scanned")
    weight = (F.col("critical_issues") * 40 + F.col("high_issues") * 25
              + F.col("medium_issues") * 10 + F.col("low_issues") * 3)
    raw = F.when(functions > 0, weight * 0.7 + n / F.nullif(functions, F.lit(0)) * 100 * 0.3).otherwise(weight.cast("double"))
    top = (F.when(F.col("critical_issues") > 0, 4).when(F.col("high_issues") > 0, 3)
           .when(F.col("medium_issues") > 0, 2).otherwise(1))
    impact = F.least(F.round(0.6 * (top / 4.0) + 0.4 * F.least(n / 10.0, F.lit(1.0)), 2), F.lit(1.0))
    return (summary
            .withColumn("risk_score", F.least(F.round(raw, 1), F.lit(100.0)))
            .withColumn("security_grade", grade(F.col("risk_score")))
            .withColumn("repository_score", (100 - F.col("risk_score")).cast("int"))
            .withColumn("business_impact_score", F.when(n == 0, 0.0).otherwise(impact))
            .withColumn("business_impact", impact_band(F.col("business_impact_score")))
            .withColumn("confidence", mean_confidence(F.col("confidence_units"), n))
            .withColumn("vulnerability_density", F.when(
                functions > 0, F.round(n / F.nullif(functions, F.lit(0)) * 100, 2)).otherwise(0.0)))


def repo_scores(pred: DataFrame, key: str = "repo_id", file: str = "file_path", files: DataFrame | None = None) -> DataFrame:
    return with_scores(scan_summary(pred, key, file, files))


def compliance_set(findings: DataFrame, key: str = "repo_id") -> DataFrame:
    """Sorted distinct violations per repository; a set of at most the catalogue's thirteen rules."""
    distinct_cwes = findings.select(key, "predicted_cwe").distinct()
    return (compliance(distinct_cwes).groupBy(key)
            .agg(F.array_sort(F.collect_set("violation")).alias("violations")))


def severity_weight(severity: Column) -> Column:
    level = F.coalesce(severity, F.lit("Medium"))
    return (F.when(level == "Critical", 4).when(level == "High", 3).when(level == "Medium", 2)
            .when(level == "Low", 1).otherwise(2))


def file_summary(findings: DataFrame, file: str = "file_path") -> DataFrame:
    """Per scanned file: total, critical flag and the five upper-case severities with zeros."""
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    level = F.upper(F.col("severity"))
    return findings.groupBy(file).agg(
        F.count("severity").alias("total_findings"),
        (_count(level == "CRITICAL") > 0).alias("has_critical"),
        *[_count(level == name).alias(name.lower()) for name in levels])


