"""From snippets with a classifier probability to prediction and finding rows.

Everything up to the catalogue lookup is a chain of column expressions without a shuffle, so the same
functions also score a streaming frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import rules
from ..functions.text import is_blank, strip
from ..sources.dims import dim
from .settle import settle

RULE_COLUMNS = {r[0]: f"hit_{r[0]}" for r in fixed.STATIC_RULES}


def with_rules(df: DataFrame, code: str = "code") -> DataFrame:
    """One boolean column per static rule, evaluated once and reused."""
    return df.withColumns({column: rules.RULES[name](F.col(code)) for name, column in RULE_COLUMNS.items()})


def hit_columns() -> dict:
    return {name: F.col(column) for name, column in RULE_COLUMNS.items()}


def ml_vote(df: DataFrame) -> DataFrame:
    """Classifier side: vulnerable flag at one half and the CWE guess.

    A trained CWE column ``model_cwe`` is used when the input has one, else the keyword heuristic.
    """
    df = df.withColumn("_low", F.lower("code")).withColumn("heuristic_cwe", rules.heuristic_cwe(F.col("_low"))).drop("_low")
    guess = F.col("heuristic_cwe")
    if "model_cwe" in df.columns:
        guess = F.coalesce("model_cwe", guess)
    return (df.withColumn("ml_vulnerable", F.coalesce(F.col("ml_prob") >= 0.5, F.lit(False)))
            .withColumn("ml_cwe", F.when(F.col("ml_vulnerable"), guess)))


def hybrid(df: DataFrame) -> DataFrame:
    """Combine the classifier vote with the static rules and the test-path rule."""
    hits = hit_columns()
    hit = rules.static_any(hits)
    kept, lowered = rules.deescalate(F.col("ml_vulnerable"), F.col("ml_prob"), F.col("file_path"))
    step = df.withColumns({"_vulnerable": kept, "_confidence": lowered, "_hit": hit,
                           "_static_cwe": rules.first_static_cwe(hits)})
    override = F.col("_hit") & ~F.col("_vulnerable") & (F.col("_confidence") < 0.65)
    agree = F.col("_hit") & F.col("_vulnerable")
    confidence = (F.when(override, F.greatest("_confidence", F.lit(0.70)))
                  .when(agree, F.least(F.col("_confidence") + 0.1, F.lit(1.0)))
                  .otherwise(F.col("_confidence")))
    no_cwe = F.coalesce(F.col("ml_cwe"), F.lit("")) == ""
    return step.withColumns({
        "vulnerable": F.col("_vulnerable") | override,
        "confidence": F.round(confidence, 4),
        "hybrid_cwe": F.when(override | (agree & no_cwe), F.col("_static_cwe")).otherwise(F.col("ml_cwe")),
    }).drop("_vulnerable", "_confidence", "_hit", "_static_cwe")


def enrich(df: DataFrame) -> DataFrame:
    """Catalogue fields of the CWE, a generic record for an unknown one, constants for a safe row."""
    spark = df.sparkSession
    name, owasp, description, recommendation = fixed.GENERIC_CWE
    cat = dim(spark, "dim_cwe").select(F.col("cwe").alias("_cwe"), *[
        F.col(c).alias(f"_{c}") for c in ("cwe_name", "severity", "score", "owasp", "description", "recommendation")])
    joined = df.join(cat, (F.col("predicted_cwe") == F.col("_cwe")) & F.col("vulnerable"), "left")
    known, bad = F.col("_cwe").isNotNull(), F.col("vulnerable")
    pick = lambda column, generic, safe: (
        F.when(bad & known, F.col(column)).when(bad, generic).otherwise(F.lit(safe)))
    return joined.withColumns({
        "cwe_name": pick("_cwe_name", F.lit(name), None),
        "severity": pick("_severity", F.when(F.col("confidence") > 0.8, "High").otherwise("Medium"), "None"),
        "recommendation": pick("_recommendation", F.lit(recommendation), fixed.SAFE_RECOMMENDATION),
        "cvss_score": pick("_score", F.round(F.col("confidence") * 10, 1), 0.0),
        "owasp": pick("_owasp", F.lit(owasp), None),
        "description": pick("_description", F.lit(description), fixed.SAFE_DESCRIPTION),
    }).drop(*[c for c in cat.columns])


def guard_blank(df: DataFrame) -> DataFrame:
    """Constant record for rows without code."""
    blank = F.col("is_blank")
    fill = lambda column, value: F.when(blank, F.lit(value)).otherwise(F.col(column))
    return df.withColumns({
        "vulnerable": fill("vulnerable", False), "confidence": fill("confidence", 0.0),
        "predicted_cwe": fill("predicted_cwe", None), "cwe_name": fill("cwe_name", None),
        "severity": fill("severity", "None"), "recommendation": fill("recommendation", fixed.BLANK_RECOMMENDATION),
        "cvss_score": fill("cvss_score", 0.0), "owasp": fill("owasp", None), "description": fill("description", None),
        "safe_reason": F.when(blank, fixed.BLANK_REASON).when(~F.col("vulnerable"), fixed.SAFE_REASON),
    })


TEXT_COLUMNS = ["is_blank", "heuristic_cwe", "ml_vulnerable", "ml_cwe", *RULE_COLUMNS.values()]


def predict(df: DataFrame) -> DataFrame:
    """Full prediction record for rows with ``code``, ``file_path`` and ``ml_prob``."""
    read = settle(with_rules(ml_vote(df.withColumn("is_blank", is_blank(F.col("code"))))), TEXT_COLUMNS)
    voted = hybrid(read)
    voted = voted.withColumn("predicted_cwe", F.when(
        F.col("vulnerable") & (F.coalesce(F.col("hybrid_cwe"), F.lit("")) == ""), F.col("heuristic_cwe"))
        .otherwise(F.col("hybrid_cwe")))
    return guard_blank(enrich(settle(voted, ["vulnerable", "confidence", "hybrid_cwe", "predicted_cwe"])))


REMEDIATION_FIELDS = ["root_cause", "why_dangerous", "secure_coding_recommendation", "example_secure_implementation", "priority_level"]


def remediation(df: DataFrame, cwe: str = "predicted_cwe", severity: str = "severity",
                language: str = "language") -> DataFrame:
    """Advice by CWE and language; the CWE's default example, then a generic record, as fallbacks."""
    spark = df.sparkSession
    head, tail, danger, advice, example = fixed.GENERIC_REMEDIATION
    base = dim(spark, "dim_remediation").withColumnsRenamed({
        "cwe": "_rcwe", "root_cause": "_root", "why_dangerous": "_danger", "secure_recommendation": "_advice"})
    examples = dim(spark, "dim_fix_example").withColumnsRenamed({"cwe": "_ecwe", "lang": "_elang", "example": "_example"})
    defaults = (dim(spark, "dim_fix_example").where("lang = 'default'")
                .select(F.col("cwe").alias("_dcwe"), F.col("example").alias("_default")))
    key = F.lower(strip(F.coalesce(F.col(language), F.lit(""))))
    priority = F.lit(fixed.DEFAULT_PRIORITY)
    for name, text in reversed(fixed.PRIORITY):
        priority = F.when(F.col(severity) == name, text).otherwise(priority)
    joined = (df.join(base, F.col(cwe) == F.col("_rcwe"), "left")
              .join(examples, (F.col(cwe) == F.col("_ecwe")) & (key == F.col("_elang")), "left")
              .join(defaults, F.col(cwe) == F.col("_dcwe"), "left"))
    known = F.col("_rcwe").isNotNull()
    named = F.when(F.coalesce(F.col(cwe), F.lit("")) == "", "security vulnerability").otherwise(F.col(cwe))
    return joined.withColumns({
        "root_cause": F.when(known, F.col("_root")).otherwise(F.concat(F.lit(head), named, F.lit(tail))),
        "why_dangerous": F.when(known, F.col("_danger")).otherwise(danger),
        "secure_coding_recommendation": F.when(known, F.col("_advice")).otherwise(advice),
        "example_secure_implementation": F.when(known, F.coalesce("_example", "_default", F.lit(""))).otherwise(example),
        "priority_level": priority,
    }).drop("_rcwe", "_root", "_danger", "_advice", "_ecwe", "_elang", "_example", "_dcwe", "_default")


def compliance(df: DataFrame, cwe: str = "predicted_cwe") -> DataFrame:
    """One row per violated rule of the row's CWE; rows without a rule drop out."""
    rules_dim = dim(df.sparkSession, "dim_compliance").withColumnRenamed("cwe", "_ccwe")
    return df.join(rules_dim, F.upper(F.col(cwe)) == F.col("_ccwe")).drop("_ccwe")


def payloads(df: DataFrame, cwe: str = "predicted_cwe") -> DataFrame:
    """Test payloads of the CWE; one default payload for any other."""
    pay = dim(df.sparkSession, "dim_payloads").select(
        F.col("cwe").alias("_pcwe"), F.array("payload_1", "payload_2", "payload_3").alias("_payloads"))
    return (df.join(pay, F.upper(F.col(cwe)) == F.col("_pcwe"), "left")
            .withColumn("tested_payloads", F.coalesce("_payloads", F.array(F.lit(fixed.DEFAULT_PAYLOAD))))
            .drop("_pcwe", "_payloads"))


def lines_text(start: str = "line_number", first: str = "first_line", last: str = "last_line"):
    """``"a-b"``: the start line and the same plus the span of affected lines."""
    span = F.coalesce(F.col(last) - F.col(first), F.lit(0))
    return F.concat(F.col(start).cast("string"), F.lit("-"), (F.col(start) + span).cast("string"))


def finding_projection(pred: DataFrame) -> DataFrame:
    """Vulnerable rows in finding form.

    Expects prediction rows with ``line_number``, ``first_line``, ``last_line`` and ``reason``. Rows that have a ``language`` get the
    record ``remediation`` too.
    """
    bad, advice = pred.where("vulnerable"), []
    if "language" in pred.columns:
        bad = remediation(bad)
        advice = [F.struct(*REMEDIATION_FIELDS).alias("remediation")]
    return bad.select(
        "repo_id", "snippet_id",
        F.coalesce(F.when(F.col("cwe_name") != "", F.col("cwe_name")), F.lit("Security Risk")).alias("type"),
        "severity", "confidence", "predicted_cwe",
        F.coalesce(F.when(F.col("owasp") != "", F.col("owasp")), F.lit("Unknown")).alias("owasp"),
        F.col("file_path").alias("file"), F.concat("function_name", F.lit("()")).alias("function"),
        lines_text().alias("lines"), "reason", "recommendation", F.col("confidence").alias("risk_score"), *advice)
