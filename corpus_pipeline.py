"""The corpus pipeline: five stages over the documents, each by an operator of the corpus subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read back as
the next stage's docs. All stages but the last return the columns of documents, with rows or lines dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelake.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from codelake.llm.common import table
from codelake.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.judge(docs, COLUMNS).where("kept").select(COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many pages of a source share go; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs, counts=False)
    n_chars = "CASE WHEN text IS NULL THEN n_chars ELSE char_length(text) END AS n_chars"
    return out.selectExpr("doc_id", "text", "lang", "source", n_chars)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dup.deduplicate(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of what is left: one row per sequence."""
    # The stages share their workers, so this one keeps few words.
    return packing.pack_documents(docs, cache_bytes=16 << 20)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", drop_boilerplate_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Tokenizers and weighted sampling are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
