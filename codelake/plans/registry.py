"""Query registration and inputs shared by the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, explain, report, score
from ..session import staged
from ..sources.fixtures import view
from .oracle import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, other: dict[str, str] | None = None):
    """Register a query; ``sql`` may use any base table, derived view or shared table of the oracle, or ``other`` ones."""
    def register(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_tables(sql, other)
        return fn
    return register


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored snippets; the view has one function per row, so all start at line 1."""
    return detect.predict(view(spark, sf_dir, "snippets")).withColumn("line_number", F.lit(1))


def vulnerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where("vulnerable").withColumn("risk_score", F.col("confidence"))


def explained(spark: SparkSession, sf_dir: str, pred: DataFrame | None = None) -> DataFrame:
    """Vulnerable predictions, or the ``pred`` rows chosen from them, with affected lines and the reason sentence.

    For chosen rows the attention table is first cut down to them.
    """
    attention = view(spark, sf_dir, "attention")
    if pred is not None:
        attention = attention.join(pred.select("snippet_id"), "snippet_id", "left_semi")
    else:
        pred = predictions(spark, sf_dir).where("vulnerable")
    return explain.with_reason(explain.with_top_lines(pred, explain.snippet_tokens(attention)))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.finding_projection(explained(spark, sf_dir))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all repositories.

    The predictions are scanned twice, for the counts that all figures follow from and for the listed findings; only these are
    explained.
    """
    pred = predictions(spark, sf_dir)
    counts = staged(score.finding_counts(pred), "finding-counts")
    ranked = staged(report.top_findings(pred.where("vulnerable")), "listed-findings")
    listed = detect.finding_projection(explained(spark, sf_dir, ranked.drop("language"))).join(ranked.select("snippet_id", "rank"), "snippet_id")
    return report.report_markdown(score.with_scores(score.summary_of_counts(counts)), listed, score.compliance_set(counts.where("vulnerable")))
