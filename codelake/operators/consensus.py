"""Two opinions per snippet and their consensus, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import percent
from .detect import RULE_COLUMNS, compliance, hit_columns, ml_vote, with_rules
from .settle import settle

MODEL = "CodeBERT"


def ml_opinion(df: DataFrame, model: str = MODEL) -> DataFrame:
    safe = 1.0 - F.col("ml_prob")
    return ml_vote(df).withColumns({
        "ml_confidence": F.when(F.col("ml_vulnerable"), F.col("ml_prob")).otherwise(safe),
        "ml_rationale": F.when(
            F.col("ml_vulnerable"),
            F.concat(F.lit(f"{model} ML detected semantic vulnerability signatures (Confidence: "),
                     percent(F.col("ml_prob")), F.lit(").")))
        .otherwise(F.concat(F.lit(f"{model} ML evaluated the code logic structure as safe (Confidence: "),
                            percent(safe), F.lit(").")))})


def static_opinion(df: DataFrame) -> DataFrame:
    hits = hit_columns()
    found = rules.static_any(hits)
    return with_rules(df).withColumns({
        "static_vulnerable": found,
        "static_confidence": F.when(found, 0.90).otherwise(1.0),
        "static_cwe": rules.first_static_cwe(hits),
        "static_rationale": F.when(found, F.concat(
            F.lit("Static rules triggered: "), F.array_join(rules.static_messages(hits), "; ")))
        .otherwise("No static vulnerability patterns triggered.")})


OPINION_COLUMNS = ["heuristic_cwe", "ml_vulnerable", "ml_cwe", "ml_confidence", "ml_rationale", *RULE_COLUMNS.values(),
                   "static_vulnerable", "static_confidence", "static_cwe", "static_rationale"]


def consensus(df: DataFrame) -> DataFrame:
    """Agreement averages; a static hit overrides a safe vote; otherwise the classifier decides."""
    both = settle(static_opinion(ml_opinion(df)), OPINION_COLUMNS)
    agree = F.col("ml_vulnerable") == F.col("static_vulnerable")
    override = ~agree & F.col("static_vulnerable") & (F.col("static_confidence") >= 0.90)
    return both.withColumns({
        "vulnerable": F.when(override, True).otherwise(F.col("ml_vulnerable")),
        "consensus_score": F.round(
            F.when(agree, (F.col("ml_confidence") + F.col("static_confidence")) / 2)
            .when(override, 0.85).otherwise(F.col("ml_confidence")), 4),
        "final_cwe": F.when(agree, F.coalesce("ml_cwe", "static_cwe")).when(override, F.col("static_cwe"))
        .otherwise(F.col("ml_cwe"))})


def consensus_issues(df: DataFrame) -> DataFrame:
    """Violated rules of the snippets that the consensus calls vulnerable."""
    return compliance(df.where("vulnerable and final_cwe is not null"), "final_cwe")
