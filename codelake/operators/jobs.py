"""Users, repositories, jobs, webhooks and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from .rank import top_per_group


def left_by_key(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` in which rows without a key stay where they are instead of meeting in one task."""
    keyless = rows.where(F.col(key).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in other.schema if f.name != key})
    return rows.where(F.col(key).isNotNull()).join(other, key, "left").unionByName(keyless)


def user_repo_jobs(users: DataFrame, repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs with their user and, when they have one, their repository."""
    u = users.select(F.col("id").alias("user_id"), "email")
    r = repositories.select(F.col("id").alias("repository_id"), "repo_name", "github_repo_url",
                            F.col("user_id").alias("owner_id"))
    return left_by_key(jobs.join(u, "user_id"), r, "repository_id")


def after_deletes(users: DataFrame, repositories: DataFrame, jobs: DataFrame,
                  deleted_users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State after users are deleted: their repositories go too, jobs stay with an empty repository."""
    gone = deleted_users.select("id")
    users_left = users.join(gone, "id", "left_anti")
    repos_left = repositories.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_anti")
    repos_gone = repositories.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_semi")
    lost = repos_gone.select(F.col("id").alias("repository_id"), F.lit(True).alias("_lost"))
    jobs_left = (left_by_key(jobs, lost, "repository_id")
                 .withColumn("repository_id", F.when(F.col("_lost").isNull(), F.col("repository_id"))).drop("_lost"))
    return users_left, repos_left, jobs_left


def latest_status(events: DataFrame) -> DataFrame:
    """Newest state per job; a map-side combined aggregate, so a busy job does not collect on one task."""
    newest = F.max(F.struct("event_ts", "event_id", "status")).alias("_newest")
    return events.groupBy("job_id").agg(newest).select(
        "job_id", F.col("_newest.status").alias("status"), F.col("_newest.event_id").alias("event_id"))


def job_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(
        F.sum("blocked").cast("bigint").alias("model_armor_blocked"),
        F.sum("healed").cast("bigint").alias("self_healing_count"))


def until_terminal(events: DataFrame) -> DataFrame:
    """Events of each job up to and including its first terminal state."""
    place = F.struct("event_ts", "event_id")
    ends = events.where(F.col("status").isin(fixed.TERMINAL_STATES)).groupBy("job_id").agg(F.min(place).alias("_end"))
    return (events.join(ends, "job_id", "left")
            .where(F.col("_end").isNull() | (place <= F.col("_end"))).drop("_end"))


def first_terminal(events: DataFrame) -> DataFrame:
    """First terminal event per job."""
    first = F.min(F.struct("event_ts", "event_id", "status")).alias("_first")
    return (events.where(F.col("status").isin(fixed.TERMINAL_STATES)).groupBy("job_id").agg(first)
            .select("job_id", F.col("_first.event_id").alias("event_id"), F.col("_first.status").alias("status")))


# Allowed steps of a job; a job starts with PENDING.
STEPS = [("", "PENDING"), ("PENDING", "IN_PROGRESS"), ("PENDING", "FAILED"), ("IN_PROGRESS", "SANDBOXING"),
         ("IN_PROGRESS", "FAILED"), ("SANDBOXING", "SANDBOXING"), ("SANDBOXING", "VERIFIED"), ("SANDBOXING", "FAILED")]
STEP_SCHEMA = "job_id string, event_id bigint, previous string, status string, legal boolean, attempt bigint, exhausted boolean"


def _attempts() -> Column:
    return F.sum(F.when(F.col("status") == "SANDBOXING", 1).otherwise(0))


def bucket_steps(events: DataFrame, bucket: str = "day") -> DataFrame:
    """For each event of a job the state before it and the attempts so far, within its bucket of time."""
    cut = events.select("job_id", "event_id", "event_ts", "status", F.date_trunc(bucket, "event_ts").alias("bucket"))
    inside = Window.partitionBy("job_id", "bucket").orderBy("event_ts", "event_id")
    return cut.withColumn("before", F.lag("status").over(inside)).withColumn(
        "attempts_so_far", _attempts().over(inside.rowsBetween(Window.unboundedPreceding, 0)))


def chained_steps(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Steps of whole jobs from the steps inside their buckets: a small table of bucket ends carries states over.

    ``before`` holds the states left by earlier events (``job_id, last_status, attempts``).
    """
    ends = rows.groupBy("job_id", "bucket").agg(
        F.max(F.struct("event_ts", "event_id", "status"))["status"].alias("_last"), F.max("attempts_so_far").alias("_n"))
    chain = Window.partitionBy("job_id").orderBy("bucket")
    carried = ends.select(F.col("job_id").alias("_job"), F.col("bucket").alias("_bucket"),
                          F.lag("_last").over(chain).alias("_out_previous"),
                          F.coalesce(F.sum("_n").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_out_attempts"))
    out = rows.join(carried, (F.col("job_id") == F.col("_job")) & (F.col("bucket") == F.col("_bucket")))
    if before is None:
        out = out.withColumns({"last_status": F.lit(None).cast("string"), "attempts": F.lit(0).cast("bigint")})
    else:
        out = out.join(before, "job_id", "left")
    step = F.concat_ws(">", F.coalesce("previous", F.lit("")), "status")
    return (out.withColumn("previous", F.coalesce("before", "_out_previous", "last_status"))
            .withColumn("attempt", F.col("attempts_so_far") + F.col("_out_attempts") + F.coalesce("attempts", F.lit(0)))
            .select("job_id", "event_id", "previous", "status",
                    step.isin([f"{a}>{b}" for a, b in STEPS]).alias("legal"), "attempt",
                    (F.col("attempt") > fixed.MAX_ATTEMPTS).alias("exhausted")))


def state_steps(events: DataFrame, before: DataFrame | None = None, bucket: str = "day") -> DataFrame:
    """State before each event, whether the step is allowed, the attempt number, and if attempts are used up.

    A job's log is cut into time buckets, so a job with very many events is spread over tasks.
    """
    return chained_steps(bucket_steps(events, bucket), before)


def states_after(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Last state and attempts of every job after these events."""
    now = events.groupBy("job_id").agg(
        F.max(F.struct("event_ts", "event_id", "status"))["status"].alias("_last"), _attempts().alias("_n"))
    if before is None:
        return now.select("job_id", F.col("_last").alias("last_status"), F.col("_n").alias("attempts"))
    return before.join(now, "job_id", "full_outer").select(
        "job_id", F.coalesce("_last", "last_status").alias("last_status"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("attempts"))


def scan_authorisation(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """404 for an unknown repository, 403 for another owner's, else 200."""
    owners = repositories.select(F.col("id").alias("repository_id"), F.col("user_id").alias("owner_id"))
    return (left_by_key(requests, owners, "repository_id")
            .withColumn("http_status", F.when(F.col("owner_id").isNull(), 404)
                        .when(F.col("owner_id") != F.col("user_id"), 403).otherwise(200)))


def webhook_url(payload: Column) -> Column:
    return F.get_json_object(payload, "$.repository.html_url")


def webhook_route(payloads: DataFrame, repositories: DataFrame) -> DataFrame:
    """Registered repository of each payload; a missing or unknown URL is answered, not failed."""
    registry = repositories.select(F.col("github_repo_url").alias("html_url"), F.col("id").alias("repository_id"),
                                   F.col("user_id").alias("owner_id"))
    return (left_by_key(payloads.withColumn("html_url", webhook_url(F.col("payload"))), registry, "html_url")
            .withColumn("message", F.when(F.coalesce(F.col("html_url"), F.lit("")) == "", "No repository URL in payload")
                        .when(F.col("repository_id").isNull(), "Repository not registered").otherwise("Accepted")))


def registration_quality(df: DataFrame, name: str = "full_name", password: str = "password") -> DataFrame:
    special = "[" + "".join("\\" + c for c in fixed.PASSWORD_SPECIALS) + "]"
    flags = {
        "has_upper": F.col(password).rlike(r"\p{Lu}"), "has_digit": F.col(password).rlike(r"\p{Nd}"),
        "has_special": F.col(password).rlike(special),
        "name_length_ok": F.length(name).between(2, 255), "password_length_ok": F.length(password).between(8, 128)}
    out = df.withColumns(flags)
    accepted = F.lit(True)
    for flag in flags:
        accepted = accepted & F.col(flag)
    return out.withColumn("accepted", accepted)


def registration_conflict(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicting) registrations by e-mail."""
    taken = users.select("email")
    return requests.join(taken, "email", "left_anti"), requests.join(taken, "email", "left_semi")


def rate_limited(requests: DataFrame, window: str = "1 minute", limit: int = 5) -> DataFrame:
    """Requests per client and window, with the number answered 429."""
    counted = requests.groupBy(F.window(F.col("event_ts").cast("timestamp"), window).alias("w"), "client").agg(
        F.count("*").alias("requests"))
    return windows_limited(counted.select("client", F.unix_seconds(F.col("w.start")).alias("window_start"), "requests"), limit)


def windows_limited(counted: DataFrame, limit: int) -> DataFrame:
    return counted.select(
        "client", "window_start", "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"),
        F.when(F.col("requests") > limit, 429).otherwise(200).alias("http_status"))


def request_buckets(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests as rows of their client's bucket of time and, as context, of the next one.

    A request's last ``seconds`` lie in its own bucket and the one before, so a busy client is spread over its buckets.
    """
    width = seconds * 1_000_000
    us = F.unix_micros(F.col("event_ts").cast("timestamp"))
    start = (us - F.pmod(us, F.lit(width))).cast("bigint")
    both = F.explode(F.array(F.struct((start + width).alias("end"), F.lit("own").alias("kind")),
                             F.struct((start + 2 * width).alias("end"), F.lit("context").alias("kind"))))
    return requests.select("client", "event_id", us.alias("us"), both.alias("_b")).select(
        "client", F.col("_b.end").alias("bucket_end"), "event_id", "us", F.col("_b.kind").alias("kind"))


def bucket_counts(rows: DataFrame, seconds: int) -> DataFrame:
    """Requests of the client in the last ``seconds`` up to and with each own request of a bucket; equal times go by id."""
    place = ["client", "bucket_end"]
    last = Window.partitionBy(*place).orderBy("us").rangeBetween(1 - seconds * 1_000_000, 0)
    peers = Window.partitionBy(*place, "us")
    counted = rows.withColumn("requests", F.count("*").over(last) - F.count("*").over(peers) + F.row_number().over(peers.orderBy("event_id")))
    return counted.where("kind = 'own'").select(*place, "event_id", "us", "requests")


def request_statuses(counted: DataFrame, limit: int = 5) -> DataFrame:
    return counted.select("client", "event_id", "requests", F.when(F.col("requests") > limit, 429).otherwise(200).alias("http_status"))


def rate_limit_log(requests: DataFrame, seconds: int = 60, limit: int = 5) -> DataFrame:
    """One answer for each request: 429 if the client has sent more than ``limit`` in the last ``seconds``, this one included."""
    return request_statuses(bucket_counts(request_buckets(requests, seconds), seconds), limit)


def duration_units(column: str = "duration_sec") -> Column:
    """Durations in whole microseconds, so that sums do not depend on the order of addition."""
    return F.round(F.col(column) * 1000000).cast("bigint")


def request_latency(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("total_requests"), F.sum(duration_units()).alias("_units")).select(
        "total_requests", mean_seconds(F.col("_units"), F.col("total_requests")).alias("average_latency_sec"))


def mean_seconds(units: Column, n: Column) -> Column:
    """Mean in seconds to four decimals; 0.0 without requests."""
    return F.when(n > 0, F.round(units / F.nullif(n, F.lit(0)) / 100) / 10000).otherwise(0.0)


def filter_jobs(jobs: DataFrame, status: str | None = None, severity: str | None = None,
                repository: str | None = None, search: str | None = None, kind: str | None = None, branch: str | None = None) -> DataFrame:
    """Optional predicates of the vulnerability list."""
    from .score import impact_band
    out = jobs.withColumn("severity", impact_band(F.col("business_risk_score")))
    if status:
        out = out.where(F.col("patch_status") == status)
    if severity:
        out = out.where(F.col("severity") == severity)
    if repository:
        out = out.where(F.col("repository_id") == repository)
    if kind:
        out = out.where(F.col("vulnerability_type") == kind)
    if branch:
        out = out.where(F.col("branch") == branch)
    if search:
        out = out.where(F.contains(F.lower("target_file_path"), F.lit(search.lower())))
    return out


def first_finding(findings: DataFrame, repos: DataFrame, key: str = "repo_id") -> DataFrame:
    """First finding of each repository by path and position, or ``secure``."""
    first = top_per_group(findings, [key], [F.asc("file_path"), F.asc("line_number"), F.asc("column_start")], 1).drop("rank")
    return repos.join(first, key, "left").withColumn(
        "status", F.when(F.col("rule_id").isNull(), "secure").otherwise("vulnerable"))


def early_stop(epochs: DataFrame, key: str, patience: int = 2) -> DataFrame:
    """Best F1 so far and epochs without improvement; rows after the stop are marked.

    One run has as many rows as it has epochs, so the window per run is small.
    """
    order = Window.partitionBy(key).orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.coalesce(F.max("val_f1").over(before), F.lit(0.0))
    marked = epochs.withColumn("improved", F.col("val_f1") > best_before)
    marked = marked.withColumn("best_f1", F.greatest(best_before, F.col("val_f1")))
    last_gain = F.max(F.when(F.col("improved"), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("no_improvement", (F.col("epoch") - F.coalesce(last_gain, F.lit(0))).cast("int"))
    stopped = F.max(F.when(F.col("no_improvement") >= patience, 1).otherwise(0)).over(before)
    return marked.withColumn("after_stop", F.coalesce(stopped, F.lit(0)) == 1)
