"""Late rows beside a watermark: every row of a stream is kept, marked as on time or late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows this far behind the newest event of earlier batches are late.
DELAY_SECONDS = 3600


def mark_late(stream: DataFrame, folder: str, ts: str = "event_ts", delay: int = DELAY_SECONDS) -> None:
    """Write all rows of ``stream`` that haven't come yet to ``folder``, with a column ``late``.

    A row is late if its time isn't after the newest time of all earlier batches, in milliseconds, less ``delay`` seconds. So a
    stream over the other rows, in the order of the batches, with a watermark of that delay never drops one. Each batch is
    a folder of its own and keeps the newest time so far, so it needs the one before only, and a replayed batch comes out
    the same.
    """
    spark = stream.sparkSession
    newest = "newest timestamp"
    spark.createDataFrame([], T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType())])).write.mode("overwrite").parquet(f"{folder}/rows/none")
    spark.createDataFrame([(None,)], newest).coalesce(1).write.mode("overwrite").parquet(f"{folder}/newest/{-1}")

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(newest).parquet(f"{folder}/newest/{number - 1}").first()[0]
        late = F.lit(False) if before is None else F.coalesce(F.col(ts) <= F.lit(before) - F.make_dt_interval(secs=F.lit(float(delay))), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{folder}/rows/batch-{number:09d}")
        latest = spark.read.schema(batch.schema).parquet(f"{folder}/rows/batch-{number:09d}").agg(F.date_trunc("millisecond", F.max(ts)).alias("newest"))
        (latest.select(F.greatest("newest", F.lit(before).cast("timestamp")).alias("newest")).coalesce(1)
         .write.mode("overwrite").parquet(f"{folder}/newest/{number}"))

    query = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()


def marked_rows(folder: str, schema: T.StructType, stream: bool, spark) -> DataFrame:
    """The rows that ``mark_late`` has written, as a table or as a stream of them in the order of the batches."""
    fields = T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])
    reader = spark.readStream if stream else spark.read
    return reader.schema(fields).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
