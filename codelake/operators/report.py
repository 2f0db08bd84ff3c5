"""Executive report: one Markdown text per repository.

Only ranked top-ten rows and rule names are gathered per repository, both bounded, so a repository with
very many findings never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import percent
from .rank import top_per_group
from .score import severity_weight

PRODUCT = "CodeLake"
TOP_FINDINGS = 10


def top_findings(findings: DataFrame, key: str = "repo_id", k: int = TOP_FINDINGS) -> DataFrame:
    """First findings of each repository by severity weight, then in scan order."""
    return top_per_group(findings.withColumn("severity_weight", severity_weight(F.col("severity"))),
                         [key], [F.desc("severity_weight"), F.asc("snippet_id")], k)


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def finding_block() -> Column:
    c = F.col
    return F.concat_ws(
        "\n",
        _line("\n### [", c("rank"), "] ", c("type"), " (", c("severity"), ")"),
        _line("- **CWE Mapping:** `", c("predicted_cwe"), "`"),
        _line("- **OWASP Category:** `", c("owasp"), "`"),
        _line("- **Location:** `", c("file"), "` inside `", c("function"), "` (Lines ", c("lines"), ")"),
        _line("- **Confidence:** `", percent(c("confidence")), "`"),
        _line("- **Advisory Detail:** ", c("reason")),
        _line("- **Remediation Action:** ", c("recommendation")))


def roadmap(product: str = PRODUCT) -> Column:
    """Roadmap lines from the severity counts."""
    lines = F.concat_ws(
        "\n", F.lit(fixed.ROADMAP_HEAD),
        F.when((F.col("critical_issues") > 0) | (F.col("high_issues") > 0), fixed.ROADMAP_CRITICAL),
        F.when(F.col("medium_issues") > 0, fixed.ROADMAP_MEDIUM),
        F.lit(fixed.ROADMAP_MONITOR.format(product=product)))
    return F.when(F.col("total_vulnerabilities") > 0, lines).otherwise(fixed.ROADMAP_NONE)


def report_markdown(scores: DataFrame, top: DataFrame, violations: DataFrame, key: str = "repo_id",
                    product: str = PRODUCT) -> DataFrame:
    """Report text per repository from its scores, its ranked first findings and its violated rules."""
    blocks = (top.withColumn("block", finding_block())
              .groupBy(key).agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n").alias("blocks")))
    c = F.col
    table = [("Files Scanned", "files_scanned"), ("Functions Analyzed", "functions_scanned"),
             ("Total Vulnerabilities Identified", "total_vulnerabilities"), ("Critical Issues", "critical_issues"),
             ("High Issues", "high_issues"), ("Medium Issues", "medium_issues"), ("Low Issues", "low_issues")]
    violated = F.concat_ws("\n", F.lit(fixed.REPORT_VIOLATED), F.array_join(F.transform(
        "violations", lambda v: F.concat(F.lit("- **Non-compliance:** `"), v, F.lit("`"))), "\n"))
    text = F.concat_ws(
        "\n",
        F.lit(f"# {product} Executive Security Report"),
        F.lit("\n## 1. Executive Summary"), F.lit(fixed.REPORT_INTRO.format(product=product)),
        F.lit("\n### Security Scorecard"),
        _line("- **Security Grade:** `", c("security_grade"), "`"),
        _line("- **Security Score:** `", c("repository_score"), "/100` (Higher is better)"),
        _line("- **Business Impact Severity:** `", c("business_impact"), "`"),
        _line("- **Vulnerability Density:** `", c("vulnerability_density"), "%` of functions flagged."),
        F.lit("\n### Scan Scope & Coverage"), F.lit("| Metric | Count |"), F.lit("| :--- | :--- |"),
        *[_line(f"| {label} | ", c(column), " |") for label, column in table],
        F.lit("\n## 2. Regulatory Compliance Posture"),
        F.when(c("violations").isNull(), fixed.REPORT_COMPLIANT).otherwise(violated),
        F.lit("\n## 3. High-Risk Vulnerability Details"),
        F.coalesce(c("blocks"), F.lit(fixed.REPORT_CLEAN)),
        F.lit("\n## 4. Strategic Remediation Roadmap"), roadmap(product))
    return scores.join(violations, key, "left").join(blocks, key, "left").select(key, text.alias("report"))


def preview(report: Column, length: int = 1500) -> Column:
    return F.concat(F.substring(report, 1, length), F.lit(fixed.PREVIEW_SUFFIX))
