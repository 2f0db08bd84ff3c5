"""Logs of keys in the state store, evaluated in event-time order.

A key is a client or job and a bucket of time, so a busy one is spread over its buckets. The state holds the bucket's rows; a
batch reads and writes the states of its own keys only, whatever has come before. An event-time timer frees a bucket once
the watermark has passed its end. Rows behind the watermark don't come here (see ``late``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = "us long, event_id long, kind string"
STEP = "owner string, bucket_end long, event_id long, us long, kind string, before string, number long"
Steps = list[tuple[int, int, str, str | None, int]]


class BucketLog(StatefulProcessor):
    """Keeps a bucket's rows and emits the steps that are new or have changed."""

    def __init__(self, evaluate: Callable[[list[tuple[int, int, str]]], Steps]):
        self.evaluate = evaluate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", ROW)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = [tuple(r) for r in self.log.get()]
        fresh = {r for batch in rows for r in zip(batch["us"].tolist(), batch["event_id"].tolist(), batch["kind"].tolist())}
        if not known:
            self.handle.registerTimer(-(-int(key[1]) // 1000))
        new = fresh.difference(known)
        if new:
            self.log.appendList(sorted(new)) if known else self.log.put(sorted(new))
            seen = set(self.evaluate(sorted(known)))
            steps = [(key[0], key[1], *s) for s in self.evaluate(sorted([*known, *new])) if s not in seen]
            if steps:
                yield pd.DataFrame(steps, columns=["owner", "bucket_end", "event_id", "us", "kind", "before", "number"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.log.clear()
        yield from ()

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Timers and lists need the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keyed_steps(rows: DataFrame, evaluate: Callable[[list[tuple[int, int, str]]], Steps], ts: str, delay: int) -> DataFrame:
    """Stream of steps from a stream of (owner, bucket_end, event_id, us, kind) rows with the event time ``ts``."""
    use_state_store(rows.sparkSession)
    timed = rows.withWatermark(ts, f"{delay} seconds")
    return timed.groupBy("owner", "bucket_end").transformWithStateInPandas(BucketLog(evaluate), STEP, "Update", "EventTime")
