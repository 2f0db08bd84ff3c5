"""Joins: fix history, catalogue lookups, graph, jobs, similarity, webhooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import dataset, detect, explain, graph, jobs, lsh, similarity
from ..sources.fixtures import view
from ..sources.tables import read_table
from . import oracle as O
from .functions import PRIORITY, REMEDIATION_SQL
from .registry import predictions, query


def fix_tables(spark, sf_dir):
    return {t: view(spark, sf_dir, f"cvefixes_{t}") for t in dataset.FIX_TABLES}


_HISTORY = """cvefixes_method_change m JOIN cvefixes_file_change f USING (file_change_id) JOIN cvefixes_commits c USING (hash)
 JOIN cvefixes_fixes x USING (hash) JOIN cvefixes_cve v USING (cve_id)"""


@query("cvefixes_join", f"SELECT file_change_id, hash, cve_id, code, before_change, programming_language, cvss3_base_score FROM {_HISTORY} WHERE code IS NOT NULL AND code <> ''")
def cvefixes_join(spark, sf_dir):
    t = fix_tables(spark, sf_dir)
    return dataset.fix_history(t["method_change"], t["file_change"], t["commits"], t["fixes"], t["cve"]).select(
        "file_change_id", "hash", "cve_id", "code", "before_change", "programming_language", "cvss3_base_score")


@query("cvefixes_left_cwe", f"""SELECT file_change_id, cve_id, cwe_id FROM {_HISTORY} LEFT JOIN cvefixes_cwe_classification USING (cve_id)
 WHERE code IS NOT NULL AND code <> ''""")
def cvefixes_left_cwe(spark, sf_dir):
    t = fix_tables(spark, sf_dir)
    history = dataset.fix_history(t["method_change"], t["file_change"], t["commits"], t["fixes"], t["cve"])
    return history.join(t["cwe_classification"], "cve_id", "left").select("file_change_id", "cve_id", "cwe_id")


@query("finding_cwe_enrich", f"""SELECT file_change_id, predicted_cwe, coalesce(d.cwe_name, {O._NAME}) AS cwe_name,
  coalesce(d.severity, CASE WHEN confidence > 0.8e0 THEN 'High' ELSE 'Medium' END) AS severity, coalesce(d.score, round(confidence * 10, 1)) AS cvss_score,
  coalesce(d.owasp, {O._OWASP}) AS owasp
 FROM (SELECT file_change_id, 'CWE-' || (l.n % 25 * 10 + 9) AS predicted_cwe, round(l.n % 100 / 100e0, 4) AS confidence
  FROM (SELECT file_change_id, length(hash) * 37 + length(file_change_id) * 11 AS n FROM cvefixes_file_change) l) x LEFT JOIN dim_cwe d ON x.predicted_cwe = d.cwe""")
def finding_cwe_enrich(spark, sf_dir):
    n = F.length("hash") * 37 + F.length("file_change_id") * 11
    rows = view(spark, sf_dir, "cvefixes_file_change").select(
        "file_change_id", F.concat(F.lit("CWE-"), (n % 25 * 10 + 9).cast("string")).alias("predicted_cwe"),
        F.round((n % 100) / 100, 4).alias("confidence"), F.lit(True).alias("vulnerable"))
    return detect.enrich(rows).select("file_change_id", "predicted_cwe", "cwe_name", "severity", "cvss_score", "owasp")


@query("finding_remediation", REMEDIATION_SQL)
def finding_remediation(spark, sf_dir):
    return detect.remediation(predictions(spark, sf_dir).where("vulnerable")).select("snippet_id", *detect.REMEDIATION_FIELDS)


@query("finding_priority", f"SELECT snippet_id, severity, {PRIORITY} AS priority_level FROM pred")
def finding_priority(spark, sf_dir):
    return detect.remediation(predictions(spark, sf_dir)).select("snippet_id", "severity", "priority_level")


@query("finding_compliance", "SELECT snippet_id, predicted_cwe, violation FROM vuln JOIN dim_compliance ON upper(predicted_cwe) = cwe")
def finding_compliance(spark, sf_dir):
    return detect.compliance(predictions(spark, sf_dir).where("vulnerable")).select("snippet_id", "predicted_cwe", "violation")


@query("kg_related", """SELECT v.snippet_id, e.dst, e.relation, n.node_type, n.label FROM vuln v JOIN kg_edges e ON v.predicted_cwe = e.src
 JOIN kg_nodes n ON e.dst = n.node_id""")
def kg_related(spark, sf_dir):
    return graph.related(predictions(spark, sf_dir).where("vulnerable")).select("snippet_id", "dst", "relation", "node_type", "label")


@query("kg_violations", """SELECT v.snippet_id, n.label AS violation FROM vuln v JOIN kg_edges e ON v.predicted_cwe = e.src AND e.relation = 'violates'
 JOIN kg_nodes n ON e.dst = n.node_id""")
def kg_violations(spark, sf_dir):
    return graph.violations(predictions(spark, sf_dir).where("vulnerable")).select("snippet_id", F.col("label").alias("violation"))


_FRAMEWORK = lambda c: "CASE " + " ".join(f"WHEN starts_with({c}, '{f}') THEN '{f}'" for f in graph.FRAMEWORKS) + " ELSE 'Other' END"


@query("graph_vs_agent_gap", f"""SELECT g.cwe, g.framework, g.side, count(v.snippet_id) AS findings FROM (
  SELECT coalesce(a.cwe, k.cwe) AS cwe, coalesce(a.framework, k.framework) AS framework,
   CASE WHEN k.cwe IS NULL THEN 'agent_only' WHEN a.cwe IS NULL THEN 'graph_only' ELSE 'both' END AS side
  FROM (SELECT DISTINCT cwe, {_FRAMEWORK('violation')} AS framework FROM dim_compliance WHERE NOT starts_with(violation, 'OWASP')) a
  FULL JOIN (SELECT DISTINCT src AS cwe, {_FRAMEWORK('dst')} AS framework FROM kg_edges WHERE relation = 'violates') k ON a.cwe = k.cwe AND a.framework = k.framework) g
 LEFT JOIN vuln v ON v.predicted_cwe = g.cwe GROUP BY 1, 2, 3""")
def graph_vs_agent_gap(spark, sf_dir):
    found = predictions(spark, sf_dir).where("vulnerable").groupBy(F.col("predicted_cwe").alias("cwe")).agg(F.count("*").alias("_n"))
    return graph.compliance_gap(spark).join(found, "cwe", "left").select(
        "cwe", "framework", "side", F.coalesce("_n", F.lit(0)).alias("findings"))


@query("user_repo_jobs", """SELECT j.id, u.email, r.repo_name, j.patch_status FROM vulnerability_jobs j JOIN users u ON j.user_id = u.id
 LEFT JOIN repositories r ON j.repository_id = r.id""")
def user_repo_jobs(spark, sf_dir):
    return jobs.user_repo_jobs(view(spark, sf_dir, "users"), view(spark, sf_dir, "repositories"),
                               view(spark, sf_dir, "vulnerability_jobs")).select("id", "email", "repo_name", "patch_status")


@query("fk_delete_effects", """SELECT 'job' AS kind, j.id, CASE WHEN u.id IS NULL OR u.is_active THEN j.repository_id END AS repository_id
  FROM vulnerability_jobs j LEFT JOIN repositories r ON j.repository_id = r.id LEFT JOIN users u ON r.user_id = u.id
 UNION ALL SELECT 'repository', r.id, NULL FROM repositories r WHERE r.user_id NOT IN (SELECT id FROM users WHERE NOT is_active)
 UNION ALL SELECT 'user', id, NULL FROM users WHERE is_active""")
def fk_delete_effects(spark, sf_dir):
    users = view(spark, sf_dir, "users")
    left, repos, kept = jobs.after_deletes(users, view(spark, sf_dir, "repositories"),
                                           view(spark, sf_dir, "vulnerability_jobs"), users.where("not is_active"))
    none = F.lit(None).cast("string").alias("repository_id")
    return (kept.select(F.lit("job").alias("kind"), "id", "repository_id")
            .unionByName(repos.select(F.lit("repository").alias("kind"), "id", none))
            .unionByName(left.select(F.lit("user").alias("kind"), "id", none)))


_COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


@query("embedding_similarity", f"""SELECT a.vec_id AS id_1, b.vec_id AS id_2, {_COS.format(a='a.embedding', b='b.embedding')} AS cosine_similarity
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_similarity(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("id_1"), (F.col("vec_id") + 1).alias("id_2"))
    return similarity.pair_similarity(asked, vectors).select("id_1", "id_2", "cosine_similarity")


@query("similar_topk", f"""SELECT label, vec_id, cosine_similarity, rank FROM (SELECT e.label, vec_id, {_COS.format(a='embedding', b='probe')} AS cosine_similarity,
  row_number() OVER (PARTITION BY e.label ORDER BY {_COS.format(a='embedding', b='probe')} DESC, vec_id) AS rank FROM embeddings e
  JOIN (SELECT label, list(m ORDER BY pos) AS probe FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos,
    unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1) p ON e.label = p.label) WHERE rank <= 10""")
def similar_topk(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return similarity.similar_topk(vectors, similarity.centroids(vectors, "label"), 10, "label")


@query("similar_rows_topk", f"""SELECT query_id, vec_id, cosine_similarity, rank FROM (SELECT query_id, vec_id, cosine_similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY cosine_similarity DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='q.embedding', b='e.embedding')} AS cosine_similarity
   FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def similar_rows_topk(spark, sf_dir):
    """Every row with an id divisible by 100 against all rows, whatever their labels."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return similarity.nearest_rows(vectors.where("vec_id % 100 = 0"), vectors, 10)


@query("similar_rows_lsh")
def similar_rows_lsh(spark, sf_dir):
    """The same search by an index of buckets; its recall is checked by ``lsh_recall``."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return lsh.nearest_by_index(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query("lsh_recall", """SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) FROM embeddings) - 1) AS neighbours, true AS enough
 FROM embeddings WHERE vec_id % 100 = 0""")
def lsh_recall(spark, sf_dir):
    """Whether the index finds at least nine tenths of the exact neighbours."""
    got = lsh.recall(similar_rows_lsh(spark, sf_dir), similar_rows_topk(spark, sf_dir))
    return got.select("queries", "neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("enough"))


@query("offset_to_line", "SELECT snippet_id, token_idx, line_number FROM token_lines")
def offset_to_line(spark, sf_dir):
    return explain.token_lines(view(spark, sf_dir, "attention"), view(spark, sf_dir, "snippets")).select("snippet_id", "token_idx", "line_number")


ROUTE_SQL = """SELECT event_id, html_url, r.id AS repository_id, CASE WHEN coalesce(html_url, '') = '' THEN 'No repository URL in payload'
  WHEN r.id IS NULL THEN 'Repository not registered' ELSE 'Accepted' END AS message
 FROM (SELECT event_id, json_extract_string(payload, '$.repository.html_url') AS html_url FROM webhook_payloads) w LEFT JOIN repositories r ON w.html_url = r.github_repo_url"""
ROUTE_FIELDS = ["event_id", "html_url", "repository_id", "message"]


@query("webhook_registry_join", ROUTE_SQL)
def webhook_registry_join(spark, sf_dir):
    return jobs.webhook_route(view(spark, sf_dir, "webhook_payloads"), view(spark, sf_dir, "repositories")).select(*ROUTE_FIELDS)


@query("registration_conflict", """SELECT o_orderkey, CASE WHEN u.id IS NULL THEN 'accepted' ELSE 'conflict' END AS outcome FROM
 (SELECT o_orderkey, 'u' || (o_orderkey * 3) || '@example.com' AS email FROM orders) q LEFT JOIN users u ON q.email = u.email""")
def registration_conflict(spark, sf_dir):
    asked = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("u"), (F.col("o_orderkey") * 3).cast("string"), F.lit("@example.com")).alias("email"))
    fresh, taken = jobs.registration_conflict(asked, view(spark, sf_dir, "users"))
    return (fresh.select("o_orderkey", F.lit("accepted").alias("outcome"))
            .unionByName(taken.select("o_orderkey", F.lit("conflict").alias("outcome"))))


@query("payload_join", f"""SELECT snippet_id, predicted_cwe, coalesce(p.payload_1 || ' | ' || p.payload_2 || ' | ' || p.payload_3, {O.lit(fixed.DEFAULT_PAYLOAD)}) AS payloads
 FROM vuln LEFT JOIN dim_payloads p ON upper(predicted_cwe) = p.cwe""")
def payload_join(spark, sf_dir):
    return detect.payloads(predictions(spark, sf_dir).where("vulnerable")).select(
        "snippet_id", "predicted_cwe", F.array_join("tested_payloads", " | ").alias("payloads"))
