"""Security tables derived from the base tables by portable SQL.

Each text runs unchanged in Spark and in the oracle database, so both see the same rows (the attention
table is generated per row in Spark). ``{name}`` stands for a base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

_FILE_CHANGE_ID = ("concat_ws('-', cast(l_orderkey AS string), cast(l_partkey AS string), "
                   "cast(l_suppkey AS string), cast(l_linenumber AS string))")
_JOB_STATUS = ("CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'IN_PROGRESS' "
               "WHEN 'click' THEN 'SANDBOXING' WHEN 'purchase' THEN 'VERIFIED' ELSE 'FAILED' END")

VIEWS: dict[str, tuple[str, str]] = {
    "snippets": ("events", """
SELECT event_id AS snippet_id,
       user_id % 20 AS repo_id,
       CASE WHEN event_id % 7 = 0 THEN concat('tests/test_m', cast(user_id % 11 AS string), '.py')
            WHEN event_id % 3 = 0 THEN concat('src/m', cast(user_id % 11 AS string), '.js')
            ELSE concat('app/m', cast(user_id % 11 AS string), '.py') END AS file_path,
       concat('fn_', cast(event_id % 13 AS string)) AS function_name,
       CASE WHEN event_id % 7 = 0 THEN 'Python' WHEN event_id % 3 = 0 THEN 'JavaScript' ELSE 'Python' END AS language,
       CASE event_id % 10
         WHEN 0 THEN concat('q = ', chr(39), 'SELECT * FROM t', cast(user_id AS string), ' WHERE id = ', chr(39), ' + uid + ', chr(39), chr(39), chr(10), 'db.execute(q)')
         WHEN 1 THEN concat('import pickle', chr(10), 'o', cast(user_id AS string), ' = pickle.loads(buf)')
         WHEN 2 THEN concat('os.system(', chr(39), 'ping ', chr(39), ' + h', cast(user_id AS string), ')')
         WHEN 3 THEN concat('api_key = ', chr(34), 'abcdefghijklmnop', cast(user_id AS string), chr(34))
         WHEN 4 THEN concat('open(filename + ', chr(39), '../x', cast(user_id AS string), chr(39), ')')
         WHEN 5 THEN concat('el.innerHTML = v', cast(user_id AS string))
         WHEN 6 THEN concat('strcpy(dst, src', cast(user_id AS string), ');')
         WHEN 7 THEN concat('db.execute(', chr(39), 'select a from t where id = %s', chr(39), ', (u', cast(user_id AS string), ',))')
         WHEN 8 THEN concat('def f', cast(user_id AS string), '():', chr(10), '    return 42')
         ELSE concat('# note', chr(10), 'x = ', cast(user_id AS string), '  # c', chr(10), chr(10), chr(10), chr(10), 'y = 1') END AS code,
       cast((event_id * 37) % 1000 AS double) / 1000 AS ml_prob
FROM {events}"""),
    "cvefixes_commits": ("orders", """
SELECT concat('c', cast(o_orderkey AS string)) AS hash,
       concat('https://github.com/org/r', cast(o_custkey % 50 AS string)) AS repo_url
FROM {orders}"""),
    "cvefixes_fixes": ("orders", """
SELECT concat('CVE-', cast(o_custkey AS string)) AS cve_id,
       concat('c', cast(o_orderkey AS string)) AS hash
FROM {orders}"""),
    "cvefixes_cve": ("customer", """
SELECT concat('CVE-', cast(c_custkey AS string)) AS cve_id,
       cast(c_custkey % 100 AS double) / 10 AS cvss3_base_score,
       CASE WHEN c_custkey % 100 >= 90 THEN 'CRITICAL' WHEN c_custkey % 100 >= 70 THEN 'HIGH'
            WHEN c_custkey % 100 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS cvss3_base_severity
FROM {customer}"""),
    "cvefixes_cwe_classification": ("customer", """
SELECT concat('CVE-', cast(c_custkey AS string)) AS cve_id,
       CASE c_custkey % 5 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-78'
                          WHEN 3 THEN 'CWE-22' ELSE 'CWE-502' END AS cwe_id
FROM {customer} WHERE c_mktsegment <> 'MACHINERY'
UNION ALL
SELECT concat('CVE-', cast(c_custkey AS string)), 'CWE-20' FROM {customer} WHERE c_acctbal < 0"""),
    "cvefixes_file_change": ("lineitem", f"""
SELECT {_FILE_CHANGE_ID} AS file_change_id,
       concat('c', cast(l_orderkey AS string)) AS hash,
       CASE l_linenumber % 4 WHEN 0 THEN 'Python' WHEN 1 THEN ' C ' WHEN 2 THEN 'JavaScript' ELSE NULL END AS programming_language
FROM {{lineitem}}"""),
    "cvefixes_method_change": ("lineitem", f"""
SELECT {_FILE_CHANGE_ID} AS file_change_id,
       CASE WHEN l_partkey % 17 = 0 THEN NULL
            WHEN l_partkey % 19 = 0 THEN ''
            WHEN l_partkey % 23 = 0 THEN 'x=1'
            ELSE concat('int f', cast(l_partkey AS string), '() {{{{', chr(10), '  return ', cast(l_linenumber AS string), '; // n', chr(10), chr(10), chr(10), chr(10), '}}}} # k') END AS code,
       CASE l_returnflag WHEN 'R' THEN ' True ' WHEN 'A' THEN '1' ELSE 'False' END AS before_change
FROM {{lineitem}}"""),
    "users": ("customer", """
SELECT concat('u', cast(c_custkey AS string)) AS id,
       concat('u', cast(c_custkey AS string), '@example.com') AS email,
       c_name AS full_name, c_acctbal >= 0 AS is_active
FROM {customer}"""),
    "repositories": ("orders", """
SELECT concat('r', cast(o_orderkey AS string)) AS id,
       concat('u', cast(o_custkey AS string)) AS user_id,
       concat('org/repo', cast(o_orderkey AS string)) AS repo_name,
       concat('https://github.com/org/repo', cast(o_orderkey AS string)) AS github_repo_url,
       o_orderstatus = 'F' AS is_private
FROM {orders} WHERE o_orderstatus <> 'P'"""),
    "vulnerability_jobs": ("events", f"""
SELECT concat('job-', cast(event_id AS string)) AS id,
       concat('u', cast(user_id AS string)) AS user_id,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('r', cast((event_id * 7) % 400 * 30 AS string)) END AS repository_id,
       concat('app/m', cast(event_id % 11 AS string), '.py') AS target_file_path,
       value / 500 AS business_risk_score,
       {_JOB_STATUS} AS patch_status,
       CASE event_id % 4 WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'Command Injection' WHEN 2 THEN 'Path Traversal' ELSE 'Hardcoded Secret' END AS vulnerability_type,
       CASE WHEN user_id % 3 = 0 THEN 'main' ELSE 'develop' END AS branch,
       ts AS created_ts
FROM {{events}}"""),
    "job_events": ("events", f"""
SELECT event_id, concat('job-', cast(user_id AS string)) AS job_id, ts AS event_ts,
       {_JOB_STATUS} AS status,
       CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END AS blocked,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS healed,
       concat('10.0.0.', cast(user_id % 50 AS string)) AS client, value / 1000 AS duration_sec
FROM {{events}}"""),
    # The log's time runs a thousand times as fast, so that clients send more than one request a minute.
    "requests": ("events", """
SELECT event_id, concat('10.0.0.', cast(user_id % 50 AS string)) AS client,
       ((((cast(year(ts) AS bigint) * 366 + dayofyear(ts)) * 24 + hour(ts)) * 60 + minute(ts)) * 60 + second(ts)) * 1000 + event_id % 1000 AS request_us
FROM {events}"""),
    "webhook_payloads": ("events", """
SELECT event_id,
       CASE WHEN event_id % 13 = 0 THEN concat(chr(123), chr(125))
            ELSE concat(chr(123), chr(34), 'repository', chr(34), ':', chr(123), chr(34), 'html_url', chr(34), ':', chr(34),
                        'https://github.com/org/repo', cast((event_id * 7) % 500 * 30 AS string), chr(34), chr(125), chr(125)) END AS payload
FROM {events}"""),
    "attention": ("events", """
SELECT event_id AS snippet_id, h.head, t.token_idx,
       concat('t', cast(t.token_idx AS string)) AS token, t.token_idx * 4 AS tok_start, t.token_idx * 4 + 3 AS tok_end,
       cast((event_id * 31 + h.head * 7 + t.token_idx * 13) % 97 AS double) / 97 AS weight
FROM {events} CROSS JOIN (VALUES (0), (1)) AS h(head) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(token_idx)"""),
}

VIEW_NAMES = tuple(VIEWS)


def _attention(events: DataFrame) -> DataFrame:
    """Two heads and six tokens per event, generated per row instead of joined."""
    tokens = (events.select("event_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("head"))
              .select("event_id", "head", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("token_idx")))
    return tokens.selectExpr(
        "event_id AS snippet_id", "head", "token_idx", "concat('t', cast(token_idx AS string)) AS token",
        "token_idx * 4 AS tok_start", "token_idx * 4 + 3 AS tok_end",
        "cast((event_id * 31 + head * 7 + token_idx * 13) % 97 AS double) / 97 AS weight")


def view_on(spark: SparkSession, name: str, base: DataFrame) -> DataFrame:
    """The derived view over a given base frame (batch or streaming)."""
    if name == "attention":
        return _attention(base)
    base_name, text = VIEWS[name]
    return spark.sql(text, **{base_name: base})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view_on(spark, name, read_table(spark, sf_dir, VIEWS[name][0]))


def view_sql(name: str) -> str:
    """The same view as text over the oracle's own tables."""
    base_name, text = VIEWS[name]
    return text.format(**{base_name: base_name})
