"""Job streams: current status, end of a job, counters, state machine, rate limit, webhooks, latency.

``folder`` of every stream holds its rows and progress; give the same one to go on after a stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators.detect import predict
from ..session import scratch_path
from .keyed import Steps, keyed_steps
from .late import DELAY_SECONDS, mark_late, marked_rows
from .runner import newest_per_key, run_available


def job_status(events: DataFrame, folder: str | None = None) -> DataFrame:
    """Current status per job, emitted when it changes (update mode)."""
    return newest_per_key(run_available(J.latest_status(events), "update", "status", folder), ["job_id"])


def job_counters(events: DataFrame, folder: str | None = None) -> DataFrame:
    return newest_per_key(run_available(J.job_counters(events), "update", "counters", folder), ["job_id"])


def rate_limit(requests: DataFrame, window: str = "1 minute", limit: int = 5, folder: str | None = None) -> DataFrame:
    """Requests per client and window. Update mode reports windows still open, and the watermark frees those long past; late
    requests are counted apart and added."""
    counted = _windowed(requests.select("client", "event_ts"), window, ["client"], {"requests": F.count("*")}, folder, "rate")
    return J.windows_limited(counted, limit)


def request_latency(requests: DataFrame, window: str = "1 day", folder: str | None = None) -> DataFrame:
    """Requests and their mean duration per window; late ones are summed apart and added."""
    sums = {"total_requests": F.count("*"), "_units": F.sum(J.duration_units())}
    found = _windowed(requests.select("event_ts", "duration_sec"), window, [], sums, folder, "latency")
    return found.select("window_start", "total_requests", J.mean_seconds(F.col("_units"), F.col("total_requests")).alias("average_latency_sec"))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def _windowed(rows: DataFrame, window: str, keys: list[str], sums: dict[str, Column], folder: str | None, name: str) -> DataFrame:
    """Sums per window and keys: a stream's running sums of rows on time, and one sum of the late rows, added up."""
    spark, rows = rows.sparkSession, _timed(rows)
    folder = folder or scratch_path(spark, name)
    mark_late(rows, f"{folder}/input")

    def summed(part: DataFrame) -> DataFrame:
        grouped = part.groupBy(F.window("event_ts", window).alias("w"), *keys).agg(*[c.alias(k) for k, c in sums.items()])
        return grouped.select(*keys, F.unix_seconds(F.col("w.start")).alias("window_start"), *sums)

    on_time = marked_rows(f"{folder}/input", rows.schema, True, spark).where("NOT late").withWatermark("event_ts", f"{DELAY_SECONDS} seconds")
    running = newest_per_key(run_available(summed(on_time), "update", name, f"{folder}/on-time"), [*keys, "window_start"])
    late = summed(marked_rows(f"{folder}/input", rows.schema, False, spark).where("late"))
    return running.unionByName(late).groupBy(*keys, "window_start").agg(*[F.sum(k).alias(k) for k in sums])


def rate_limit_log(requests: DataFrame, seconds: int = 60, limit: int = 5, folder: str | None = None) -> DataFrame:
    """One answer for each request, from a log per client in the state store (``operators.jobs.rate_limit_log``).

    ``event_id`` names a request: one that comes again with equal time is no new one.
    """
    spark, rows = requests.sparkSession, _timed(requests.select("client", "event_id", "event_ts"))
    folder = folder or scratch_path(spark, "requests")
    mark_late(rows, f"{folder}/input")
    width = seconds * 1_000_000

    def evaluate(log: list[tuple[int, int, str]]) -> Steps:
        out, first = [], 0
        for place, (us, event, kind) in enumerate(log):
            while log[first][0] <= us - width:
                first += 1
            if kind == "own":
                out.append((event, us, kind, None, place - first + 1))
        return out

    spread = lambda part: J.request_buckets(part, seconds)
    on_time = marked_rows(f"{folder}/input", rows.schema, True, spark).where("NOT late")
    keyed = spread(on_time).withColumnRenamed("client", "owner").withColumn("event_ts", F.timestamp_micros("us"))
    steps = run_available(keyed_steps(keyed, evaluate, "event_ts", DELAY_SECONDS), "update", "requests", f"{folder}/on-time")
    counted = newest_per_key(steps, ["owner", "event_id"]).select(F.col("owner").alias("client"), "bucket_end", "event_id", "us", F.col("number").alias("requests"))
    # Buckets with late rows are counted again as a whole, and no others.
    everything = spread(marked_rows(f"{folder}/input", rows.schema, False, spark).drop("late"))
    touched = spread(marked_rows(f"{folder}/input", rows.schema, False, spark).where("late")).select("client", "bucket_end").distinct()
    again = J.bucket_counts(everything.join(touched, ["client", "bucket_end"], "left_semi"), seconds)
    return J.request_statuses(counted.join(touched, ["client", "bucket_end"], "left_anti").unionByName(again), limit)


def webhook_route(payloads: DataFrame, repositories: DataFrame, folder: str | None = None) -> DataFrame:
    """Payloads against the registry: a stream-static join."""
    return run_available(J.webhook_route(payloads, repositories), "append", "webhook", folder).drop("batch_number")


def findings(snippets: DataFrame, folder: str | None = None) -> DataFrame:
    """Snippets scored as they arrive by the batch expressions."""
    return run_available(predict(snippets), "append", "findings", folder).drop("batch_number")


def raw_events(events: DataFrame, folder: str | None = None) -> DataFrame:
    return run_available(events, "append", "events", folder).drop("batch_number")


def terminal_events(events: DataFrame, folder: str | None = None) -> DataFrame:
    """The event that ends each job, its first terminal one; a job's later events change nothing."""
    return newest_per_key(run_available(J.first_terminal(events), "update", "terminal", folder), ["job_id"])


def retry_machine(events: DataFrame, bucket: str = "day", folder: str | None = None) -> DataFrame:
    """Checked state steps of every job (``operators.jobs.state_steps``), from a log per job and bucket in the state store.

    A batch reads and writes the states of its own jobs and buckets only, and a bucket's state goes once the watermark has
    passed its end. Buckets with rows behind the watermark are stepped again from the rows of these buckets. What the buckets
    leave is chained at the end, so the result doesn't depend on how events are dealt to batches. ``event_id`` names an event:
    one that comes again with equal time and status is no new one.
    """
    spark, rows = events.sparkSession, _timed(events.select("job_id", "event_id", "event_ts", "status"))
    folder = folder or scratch_path(spark, "retry")
    mark_late(rows, f"{folder}/input")

    def evaluate(log: list[tuple[int, int, str]]) -> Steps:
        out, before, attempts = [], None, 0
        for us, event, status in log:
            attempts += status == "SANDBOXING"
            out.append((event, us, status, before, attempts))
            before = status
        return out

    start = F.date_trunc(bucket, "event_ts")
    end = F.unix_micros(start + F.expr(f"INTERVAL 1 {bucket}"))
    on_time = marked_rows(f"{folder}/input", rows.schema, True, spark).where("NOT late")
    keyed = on_time.select(F.col("job_id").alias("owner"), end.alias("bucket_end"), "event_id", F.unix_micros("event_ts").alias("us"),
                           F.col("status").alias("kind"), "event_ts")
    steps = run_available(keyed_steps(keyed, evaluate, "event_ts", DELAY_SECONDS), "update", "retry", f"{folder}/on-time")
    found = newest_per_key(steps, ["owner", "event_id"]).select(
        F.col("owner").alias("job_id"), "event_id", F.timestamp_micros("us").alias("event_ts"), F.col("kind").alias("status"),
        F.date_trunc(bucket, F.timestamp_micros("us")).alias("bucket"), "before", F.col("number").alias("attempts_so_far"))
    place = ["job_id", "bucket"]
    everything = marked_rows(f"{folder}/input", rows.schema, False, spark).withColumn("bucket", start)
    touched = everything.where("late").select(*place).distinct()
    again = J.bucket_steps(everything.join(touched, place, "left_semi").select(*rows.columns), bucket)
    return J.chained_steps(found.join(touched, place, "left_anti").unionByName(again))
