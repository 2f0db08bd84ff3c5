"""Exact dedup (operator 11), DataFrame functions only: frequent digests are settled map-side, the others by a shuffle.

A Misra-Gries summary of the digests (Spark's frequent-items sketch, merged in two steps) names candidates. Their rows are
counted exactly; those that do repeat are the winners, a table of at most ``TRACKED`` rows, which is broadcast, so that
their copies are removed where they lie. All other digests meet in a shuffle by digest, in which no group holds more than
a share of about 1 / TRACKED of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

# Counters of the summary: any digest with more than 3.5 / TRACKED of the rows is among the candidates.
TRACKED = 4096
# Summaries of tasks are merged in so many groups first, so that no task reads those of all.
MERGES = 256


def digest(text_column: str) -> Column:
    """SHA-256 of the text, in hex, with each run of white space as one space; null counts as empty."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), 256)


def candidates(rows: DataFrame, column: str = "_digest") -> DataFrame:
    """At most TRACKED values of a string column, all the frequent ones among them: one column, no value twice."""
    own = rows.select(column, F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("_merge"))
    parts = own.groupBy("_merge").agg(F.expr(f"approx_top_k_accumulate({column}, {TRACKED})").alias("_summary"))
    # Grouped by a constant: no summary, no group.
    whole = parts.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_combine(_summary, {TRACKED})").alias("_summary"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(_summary, {TRACKED})")).alias("_x")).select(F.col("_x.item").alias(column))


def _digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Ids and digests as a table; the place of a row in it tells repeated rows apart."""
    return staged(docs.select(F.col(id_column).alias("_id"), digest(text_column).alias("_digest"),
                              F.monotonically_increasing_id().alias("_row")), "digests")


def _place() -> Column:
    """Rows of one digest in the order in which they may stay: by id, those without id last."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))


def _winners(rows: DataFrame) -> DataFrame:
    """Candidates that do repeat, with their exact count and the row that stays: at most TRACKED rows."""
    counted = rows.join(F.broadcast(candidates(rows)), "_digest").groupBy("_digest").agg(F.min(_place()).alias("_first"), F.count("*").alias("_size"))
    return staged(counted.where("_size > 1"), "winners")


def _settled(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Each row with the first row and the size of its group; only rows whose digest isn't a winner are shuffled."""
    joined = rows.join(F.broadcast(winners), "_digest", "left")
    same = Window.partitionBy("_digest")
    rest = joined.where("_size IS NULL").withColumns({"_first": F.min(_place()).over(same), "_size": F.count("*").over(same)})
    return joined.where("_size IS NOT NULL").unionByName(rest).withColumn("kept", F.col("_row") == F.col("_first.row"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if they are after each run of blanks (space, tab to carriage return) has become one space; a null text
    is an empty one. Of equal texts the row with the smallest id stays; rows without id come after all others, and of rows
    with the same id and text exactly one stays. Very long texts are compared whole. Columns other than the two aren't
    read. An empty table gives an empty table.
    """
    rows = _digests(docs, id_column, text_column)
    return _settled(rows, _winners(rows)).select(
        F.col("_id").alias(id_column), F.col("_first.id").alias("keep_id"), F.col("_size").alias("group_size"), "kept",
        F.col("_digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns, whatever their names; the rules are those of ``exact_groups``.

    Copies of winners go before any text is shuffled. Of rows with the same id and text one stays, whichever other values
    it has.
    """
    rows = _digests(docs, id_column, text_column)
    winners = _winners(rows)
    keep = _settled(rows, winners).where("kept").select(F.col("_id").alias("_keep_id"), F.col("_digest").alias("_keep_digest"))
    full = docs.select(F.struct(F.col("*")).alias("_doc"), F.col(id_column).alias("_id"), digest(text_column).alias("_digest"))
    left = full.join(F.broadcast(winners), "_digest", "left").where(F.col("_first").isNull() | F.col("_id").eqNullSafe(F.col("_first.id")))
    kept = left.join(keep, (F.col("_digest") == F.col("_keep_digest")) & F.col("_id").eqNullSafe(F.col("_keep_id")), "left_semi")
    return kept.dropDuplicates(["_digest", "_id"]).select("_doc.*")
