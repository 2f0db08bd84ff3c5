"""Catalogues and input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.dims import dim
from ..sources.fixtures import view
from .registry import predictions, query


@query("security_dims", """SELECT v.snippet_id, v.predicted_cwe, c.severity AS catalogue_severity, r.cwe IS NOT NULL AS has_template, p.cwe IS NOT NULL AS has_payloads,
  coalesce(e.examples, 0) AS examples, coalesce(m.rules, 0) AS rules, coalesce(k.edges, 0) AS edges FROM vuln v LEFT JOIN dim_cwe c ON v.predicted_cwe = c.cwe
 LEFT JOIN dim_remediation r ON v.predicted_cwe = r.cwe LEFT JOIN dim_payloads p ON v.predicted_cwe = p.cwe
 LEFT JOIN (SELECT cwe, count(*) AS examples FROM dim_fix_example GROUP BY 1) e ON v.predicted_cwe = e.cwe
 LEFT JOIN (SELECT cwe, count(*) AS rules FROM dim_compliance GROUP BY 1) m ON v.predicted_cwe = m.cwe
 LEFT JOIN (SELECT src, count(*) AS edges FROM kg_edges GROUP BY 1) k ON v.predicted_cwe = k.src""")
def security_dims(spark, sf_dir):
    """Every catalogue joined to the findings: what each finding's CWE has."""
    count = lambda name, key, out: dim(spark, name).groupBy(F.col(key).alias("predicted_cwe")).agg(F.count("*").alias(out))
    flag = lambda name, out: dim(spark, name).select(F.col("cwe").alias("predicted_cwe"), F.lit(True).alias(out))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = predictions(spark, sf_dir).where("vulnerable").select("snippet_id", "predicted_cwe")
    for side in (dim(spark, "dim_cwe").select(F.col("cwe").alias("predicted_cwe"), F.col("severity").alias("catalogue_severity")),
                 flag("dim_remediation", "has_template"), flag("dim_payloads", "has_payloads"), count("dim_fix_example", "cwe", "examples"),
                 count("dim_compliance", "cwe", "rules"), count("kg_edges", "src", "edges")):
        out = out.join(F.broadcast(side), "predicted_cwe", "left")
    return out.select("snippet_id", "predicted_cwe", "catalogue_severity", F.coalesce("has_template", F.lit(False)).alias("has_template"),
                      F.coalesce("has_payloads", F.lit(False)).alias("has_payloads"), zero("examples"), zero("rules"), zero("edges"))


@query("snippet_table", "SELECT snippet_id, file_path, code AS source_code FROM snippets")
def snippet_table(spark, sf_dir):
    return view(spark, sf_dir, "snippets").select("snippet_id", "file_path", F.col("code").alias("source_code"))


@query("job_tables", """SELECT 'users' AS source_table, is_active::VARCHAR AS kind, count(*) AS n FROM users GROUP BY 2 UNION ALL
 SELECT 'repositories', is_private::VARCHAR, count(*) FROM repositories GROUP BY 2 UNION ALL SELECT 'jobs', patch_status, count(*) FROM vulnerability_jobs GROUP BY 2""")
def job_tables(spark, sf_dir):
    parts = [("users", "is_active"), ("repositories", "is_private"), ("vulnerability_jobs", "patch_status")]
    out = None
    for name, kind in parts:
        label = "jobs" if name == "vulnerability_jobs" else name
        part = view(spark, sf_dir, name).groupBy(F.col(kind).cast("string").alias("kind")).agg(F.count("*").alias("n")).select(
            F.lit(label).alias("source_table"), "kind", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("webhook_json_source", """SELECT event_id, json_extract_string(payload, '$.repository.html_url') AS html_url FROM webhook_payloads""")
def webhook_json_source(spark, sf_dir):
    from ..operators.jobs import webhook_url
    return view(spark, sf_dir, "webhook_payloads").select("event_id", webhook_url(F.col("payload")).alias("html_url"))
