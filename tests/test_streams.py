"""Streams over several micro batches equal their batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import jobs as J
from codelake.sources.fixtures import view, view_on
from codelake.sources.tables import SCHEMAS, read_table
from codelake.streaming import jobs as S


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The event table as five files in time order."""
    path = str(tmp_path_factory.mktemp("events"))
    events = read_table(spark, sf_dir, "events")
    bounds = events.agg(F.percentile_approx("event_id", [0.2, 0.4, 0.6, 0.8])).first()[0]
    lows, highs = [-1, *bounds], [*bounds, 1 << 60]
    for i, (lo, hi) in enumerate(zip(lows, highs)):
        events.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.parquet(f"{path}/{i}")
    return path


def stream(spark, path, name):
    raw = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path))
    return view_on(spark, name, raw)


def same(a, b):
    columns = sorted(b.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(a.columns) == columns
    assert sorted(map(tuple, a.select(columns).collect()), key=key) == sorted(map(tuple, b.select(columns).collect()), key=key)


def test_status_and_counters(spark, sf_dir, parts):
    log = view(spark, sf_dir, "job_events")
    same(S.job_status(stream(spark, parts, "job_events")), J.latest_status(log))
    same(S.job_counters(stream(spark, parts, "job_events")), J.job_counters(log))
    same(S.terminal_events(stream(spark, parts, "job_events")), J.first_terminal(log))


def test_rate_limit(spark, sf_dir, parts):
    log = view(spark, sf_dir, "job_events")
    same(S.rate_limit(stream(spark, parts, "job_events"), "1 day", 5), J.rate_limited(log, "1 day", 5))


def test_retry_machine(spark, sf_dir, parts):
    """Steps over several batches, with files that arrive in time order."""
    same(S.retry_machine(stream(spark, parts, "job_events")).drop("batch_number"), J.state_steps(view(spark, sf_dir, "job_events")))


EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write_part(spark, path, name, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [1, 0, 3, 2], [3, 2, 1, 0]])
def test_late_events_and_restart(spark, sf_dir, tmp_path, order):
    """The order of arrival doesn't matter, and a stopped stream goes on with the files that are new."""
    rows = [tuple(r) for r in read_table(spark, sf_dir, "events").orderBy("ts").limit(200).collect()]
    path, folders = str(tmp_path / "in"), [str(tmp_path / x) for x in ("a", "b", "c")]
    for at, k in enumerate(order):
        write_part(spark, path, f"p{at}", rows[k::4])
        log = view_on(spark, "job_events", spark.read.schema(SCHEMAS["events"]).option("recursiveFileLookup", "true").parquet(path))
        if at % 2:
            same(S.retry_machine(stream(spark, path, "job_events"), folder=folders[0]).drop("batch_number"), J.state_steps(log))
            same(S.job_counters(stream(spark, path, "job_events"), folder=folders[1]), J.job_counters(log))
            same(S.rate_limit(stream(spark, path, "job_events"), "1 day", 5, folder=folders[2]), J.rate_limited(log, "1 day", 5))


def request_rows(n=400):
    """A busy client, several quiet ones, equal times, and days in between."""
    rng = random.Random(4)
    start = 1_700_000_000_000_000
    rows = [(i, "busy" if i % 3 else f"c{rng.randrange(6)}", start + rng.choice([0, 86_400, 200_000]) * 1_000_000 + rng.randrange(200) * 1_500_000) for i in range(n)]
    return rows


def brute_statuses(rows, limit=5):
    out = set()
    for i, client, us in rows:
        n = sum(c == client and us - 60_000_000 < u and (u, j) <= (us, i) for j, c, u in rows)
        out.add((client, i, n, 429 if n > limit else 200))
    return out


def logged(df):
    return df.select("client", "event_id", F.timestamp_micros("us").alias("event_ts"))


LOG = "event_id long, client string, us long"


def test_rate_limit_log(spark):
    rows = request_rows()
    got = J.rate_limit_log(logged(spark.createDataFrame(rows, LOG)))
    assert {tuple(r) for r in got.select("client", "event_id", "requests", "http_status").collect()} == brute_statuses(rows)
    assert {r.http_status for r in got.collect()} == {200, 429}


@pytest.mark.parametrize("shuffled", [False, True])
def test_request_statuses_over_batches(spark, tmp_path, shuffled):
    """Each request is answered as in the batch, in whatever order files come, over days, and after a stop."""
    rows = sorted(request_rows(), key=lambda r: (r[2], r[0]))
    if shuffled:
        random.Random(1).shuffle(rows)
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    late = 0
    for part in range(4):
        spark.createDataFrame(rows[part * 100:part * 100 + 100], LOG).coalesce(1).write.parquet(f"{path}/p{part}")
        if part % 2:
            raw = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
            got = S.rate_limit_log(logged(raw), folder=folder)
            assert {tuple(r) for r in got.select("client", "event_id", "requests", "http_status").collect()} == brute_statuses(rows[:part * 100 + 100])
            late = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/input/rows").where("late").count()
    assert (late > 0) == shuffled


def test_state_of_past_buckets_is_freed(spark, tmp_path):
    """Once the watermark has passed a bucket its rows leave the state store; the result stays."""
    rows = [(i, "c", 1_700_000_000_000_000 + (i // 10) * 86_400_000_000 + i) for i in range(60)]
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(6):
        spark.createDataFrame(rows[part * 10:part * 10 + 10], LOG).coalesce(1).write.parquet(f"{path}/p{part}")
        raw = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(path)
        got = S.rate_limit_log(logged(raw), folder=folder)
    assert {tuple(r) for r in got.select("client", "event_id", "requests", "http_status").collect()} == brute_statuses(rows)
    kept = spark.read.format("statestore").option("stateVarName", "log").option("path", f"{folder}/on-time/progress").load()
    assert {r.key.bucket_end // 86_400_000_000 for r in kept.select("key").distinct().collect()} == {19675 + 5}


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 2, 0, 3, 1]])
def test_windows_count_late_rows(spark, tmp_path, order):
    """Files of several days in any order give the sums of the batch; rows behind the watermark are added, not dropped."""
    rows = [(f"c{i % 3}", i * 0.25, 1_700_000_000 + (i % 5) * 86_400 + i * 60) for i in range(200)]
    schema = "client string, duration_sec double, s long"
    for at, day in enumerate(order):
        part = [r for i, r in enumerate(rows) if i % 5 == day]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{at}")
    timed = lambda df: df.select("client", "duration_sec", F.timestamp_seconds("s").alias("event_ts"))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    log = timed(spark.createDataFrame(rows, schema))
    folder = str(tmp_path / "latency")
    days = log.groupBy(F.unix_seconds(F.date_trunc("day", "event_ts")).alias("window_start")).agg(F.count("*").alias("total_requests"),
                                                                                                F.sum(J.duration_units()).alias("u"))
    want = days.select("window_start", "total_requests", J.mean_seconds(F.col("u"), F.col("total_requests")).alias("average_latency_sec"))
    same(S.request_latency(timed(raw), folder=folder), want)
    same(S.rate_limit(timed(raw), "1 hour", 3), J.rate_limited(log, "1 hour", 3))
    marked = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/input/rows")
    assert marked.count() == 200 and (marked.where("late").count() > 0) == (order != sorted(order))


def test_no_input(spark, tmp_path):
    write_part(spark, str(tmp_path / "in"), "none", [])
    empty = stream(spark, str(tmp_path / "in"), "job_events")
    assert S.job_status(empty).count() == 0 and S.retry_machine(empty).count() == 0 and S.rate_limit(empty).count() == 0


def test_webhooks(spark, sf_dir, parts):
    registry = view(spark, sf_dir, "repositories")
    same(S.webhook_route(stream(spark, parts, "webhook_payloads"), registry), J.webhook_route(view(spark, sf_dir, "webhook_payloads"), registry))


def test_sixth_request_is_rejected(spark):
    rows = spark.createDataFrame([("c", 1_700_000_000 + i) for i in range(6)], "client string, s long").withColumn("event_ts", F.timestamp_seconds("s"))
    row = J.rate_limited(rows, "1 minute", 5).first()
    assert (row.requests, row.rejected, row.http_status) == (6, 1, 429)
