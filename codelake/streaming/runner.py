"""File-source streams run to the end of the available data, with an idempotent table as sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import top_per_group
from ..session import scratch_path
from ..sources.fixtures import view_on
from ..sources.tables import SCHEMAS


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet*")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(sf_dir)


def stream_view(spark: SparkSession, sf_dir: str, name: str, base: str = "events") -> DataFrame:
    return view_on(spark, name, stream_table(spark, sf_dir, base))


def run_available(stream: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Run until no input is left; rows with the number of the batch that wrote them.

    ``folder`` holds the rows (``rows``) and the stream's progress (``progress``). Called again with the same folder, the
    stream goes on where it stopped; without one, a new folder in the shared folder is used. Each batch overwrites its own
    part, so a replayed batch after a failure leaves no duplicates.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)
    out, schema = f"{folder}/rows", T.StructType([*stream.schema.fields, T.StructField("batch_number", T.IntegerType())])

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_number={number}")

    # An empty part, so that a stream without input has a readable result.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch_number=-1")
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress")
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def newest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last written row of each key (update mode)."""
    return top_per_group(rows, keys, [F.desc("batch_number")], 1).drop("rank", "batch_number")
