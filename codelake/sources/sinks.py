"""Writers and their read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", key: str = "repo_id") -> None:
    """Findings in ``BUCKETS`` folders by repository hash.

    The rebalance hint lets the adaptive planner split a folder that one repository dominates and merge
    small ones, so file sizes stay even without a salt.
    """
    bucketed = findings.withColumn("repo_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    bucketed.hint("rebalance", "repo_bucket").write.mode("overwrite").partitionBy("repo_bucket").format(fmt).save(path)


def read_findings(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path).drop("repo_bucket")


def write_reports(reports: DataFrame, path: str, key: str = "repo_id") -> None:
    """Reports as rows in ``BUCKETS`` folders, however many repositories there are."""
    write_findings(reports.select(key, "report"), path, key=key)


def read_reports(spark: SparkSession, path: str, schema: str = "repo_id bigint, report string") -> DataFrame:
    return read_findings(spark, path, schema + ", repo_bucket int")


def write_report_files(reports: DataFrame, path: str, repositories: list, key: str = "repo_id") -> None:
    """One text file for each of the requested repositories."""
    (reports.where(F.col(key).isin(repositories)).select(key, "report").write.mode("overwrite").partitionBy(key).text(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.option("header", "true").option("escape", '"').option("multiLine", "true")
            .schema(schema).csv(path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


STATUS = ("status string, epoch int, total_epochs int, loss double, val_loss double, val_acc double, val_f1 double, error string, "
          "test_metrics struct<test_accuracy: double, test_f1: double>")


def train_status(metrics: DataFrame, status: str, epoch: int, total_epochs: int, error: str | None = None) -> DataFrame:
    """Status row of a training run, four decimals, from one row of ``loss``, ``val_loss``, ``val_acc``, ``val_f1``,
    ``test_accuracy`` and ``test_f1``."""
    r = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c)
    return metrics.select(F.lit(status).alias("status"), F.lit(epoch).alias("epoch"), F.lit(total_epochs).alias("total_epochs"),
                          *map(r, ("loss", "val_loss", "val_acc", "val_f1")), F.lit(error).cast("string").alias("error"),
                          F.struct(r("test_accuracy"), r("test_f1")).alias("test_metrics"))


def write_status(status: DataFrame, path: str) -> None:
    """One JSON row that has all its fields, empty ones too."""
    status.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
