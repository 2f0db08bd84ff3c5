"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package expects; a cluster's own values win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "codelake", master: str | None = None, **conf) -> SparkSession:
    """A session with the package defaults; ``conf`` uses ``_`` for dots when given as keywords."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.host", "127.0.0.1").config(
                "spark.driver.bindAddress", "127.0.0.1").config("spark.ui.enabled", "false")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, named in ``spark.checkpoint.dir``.

    Only a session in one process (``local``) may go without the setting and gets a temp folder of its own. On a
    cluster each executor would write to its own disk and reading back would miss rows, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="codelake-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; a new one on each call, so reruns never collide."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back: computed once, and safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Session setting of Spark: shuffle files go when the statement that made them ends, not when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Statements inside leave no shuffle files behind."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def staged_in_turn(frames: Iterable[DataFrame], name: str, by: str | None = None) -> DataFrame:
    """Rows of all frames (of one schema), written one after the other to the shared folder and read back.

    Shuffle files of a frame are freed before the next is written, so disk holds those of one frame at a time. With ``by``
    (a column of few values) each value has a folder of its own, and a filter on it reads that folder only.
    """
    path = out = None
    for df in frames:
        path = path or scratch_path(df.sparkSession, name)
        writer = df.write.mode("append").option("compression", "zstd")
        with freed_shuffles(df.sparkSession):
            (writer.partitionBy(by) if by else writer).parquet(path)
        out = out or df
    return out.sparkSession.read.schema(out.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers anywhere can import it."""
    context = spark.sparkContext
    if getattr(context, "_codelake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="codelake-")
    context.addPyFile(shutil.make_archive(f"{folder}/codelake", "zip", os.path.dirname(here), os.path.basename(here)))
    context._codelake_shipped = True
