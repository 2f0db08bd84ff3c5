"""Streams run over the whole event table and checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import jobs as J
from ..sources.fixtures import view
from ..streaming import jobs as S
from ..streaming.runner import stream_view
from .aggregates import LATEST_SQL
from .functions import _RECORD, PREDICT_SQL
from .joins import ROUTE_FIELDS, ROUTE_SQL
from .registry import query


@query("job_event_stream", "SELECT event_id, job_id, epoch_us(event_ts) AS event_us, status FROM job_events")
def job_event_stream(spark, sf_dir):
    rows = S.raw_events(stream_view(spark, sf_dir, "job_events"))
    return rows.select("event_id", "job_id", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("event_us"), "status")


@query("stream_job_status", LATEST_SQL)
def stream_job_status(spark, sf_dir):
    return S.job_status(stream_view(spark, sf_dir, "job_events"))


@query("stream_terminal", """SELECT job_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_ts, event_id) AS rn FROM job_events
 WHERE status IN ('VERIFIED', 'FAILED')) WHERE rn = 1""")
def stream_terminal(spark, sf_dir):
    return S.terminal_events(stream_view(spark, sf_dir, "job_events"))


@query("job_until_terminal", """SELECT e.event_id, e.job_id, e.status FROM job_events e LEFT JOIN (SELECT job_id, event_ts, event_id FROM (SELECT *, row_number() OVER
  (PARTITION BY job_id ORDER BY event_ts, event_id) AS rn FROM job_events WHERE status IN ('VERIFIED', 'FAILED')) WHERE rn = 1) t ON e.job_id = t.job_id
 WHERE t.job_id IS NULL OR e.event_ts < t.event_ts OR (e.event_ts = t.event_ts AND e.event_id <= t.event_id)""")
def job_until_terminal(spark, sf_dir):
    return J.until_terminal(view(spark, sf_dir, "job_events")).select("event_id", "job_id", "status")


@query("stream_job_counters", "SELECT job_id, sum(blocked)::BIGINT AS model_armor_blocked, sum(healed)::BIGINT AS self_healing_count FROM job_events GROUP BY 1")
def stream_job_counters(spark, sf_dir):
    return S.job_counters(stream_view(spark, sf_dir, "job_events"))


@query("stream_rate_limit", """SELECT client, w AS window_start, count(*) AS requests, greatest(count(*) - 5, 0) AS rejected, CASE WHEN count(*) > 5 THEN 429 ELSE 200 END AS http_status
 FROM (SELECT client, CAST(epoch(date_trunc('day', event_ts)) AS BIGINT) AS w FROM job_events) GROUP BY 1, 2""")
def stream_rate_limit(spark, sf_dir):
    return S.rate_limit(stream_view(spark, sf_dir, "job_events"), window="1 day", limit=5)


REQUEST_SQL = """SELECT client, event_id, requests, CASE WHEN requests > 5 THEN 429 ELSE 200 END AS http_status FROM (SELECT client, event_id,
  count(*) OVER (PARTITION BY client ORDER BY request_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY client, request_us)
  + row_number() OVER (PARTITION BY client, request_us ORDER BY event_id) AS requests FROM requests)"""


def _requests(rows):
    return rows.select("client", "event_id", F.timestamp_micros("request_us").alias("event_ts"))


@query("request_statuses", REQUEST_SQL)
def request_statuses(spark, sf_dir):
    return J.rate_limit_log(_requests(view(spark, sf_dir, "requests")))


@query("stream_request_statuses", REQUEST_SQL)
def stream_request_statuses(spark, sf_dir):
    return S.rate_limit_log(_requests(stream_view(spark, sf_dir, "requests")))


_STEPS = ", ".join(f"'{a}>{b}'" for a, b in J.STEPS)


@query("stream_retry_machine", f"""SELECT job_id, event_id, previous, status, coalesce(previous, '') || '>' || status IN ({_STEPS}) AS legal, attempt, attempt > {fixed.MAX_ATTEMPTS} AS exhausted
 FROM (SELECT job_id, event_id, status, lag(status) OVER w AS previous, CAST(sum(CASE WHEN status = 'SANDBOXING' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS attempt
  FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def stream_retry_machine(spark, sf_dir):
    return S.retry_machine(stream_view(spark, sf_dir, "job_events"), "month")


@query("stream_webhook_route", ROUTE_SQL)
def stream_webhook_route(spark, sf_dir):
    return S.webhook_route(stream_view(spark, sf_dir, "webhook_payloads"), view(spark, sf_dir, "repositories")).select(*ROUTE_FIELDS)


@query("stream_request_latency", """SELECT CAST(epoch(date_trunc('day', event_ts)) AS BIGINT) AS window_start, count(*) AS total_requests,
  round(sum(CAST(round(duration_sec * 1000000) AS BIGINT)) / count(*) / 100) / 10000 AS average_latency_sec FROM job_events GROUP BY 1""")
def stream_request_latency(spark, sf_dir):
    return S.request_latency(stream_view(spark, sf_dir, "job_events"))


@query("stream_findings", PREDICT_SQL)
def stream_findings(spark, sf_dir):
    return S.findings(stream_view(spark, sf_dir, "snippets")).select(*_RECORD)
