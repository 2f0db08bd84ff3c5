"""Training-set build: distinct join, caps, samples, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset
from ..operators.rank import hash_rank
from ..sources.fixtures import view
from .joins import fix_tables
from .registry import query


@query("dataset_read", """SELECT 'method_change' AS source_table, count(*) AS n FROM cvefixes_method_change UNION ALL SELECT 'file_change', count(*) FROM cvefixes_file_change
 UNION ALL SELECT 'commits', count(*) FROM cvefixes_commits UNION ALL SELECT 'fixes', count(*) FROM cvefixes_fixes UNION ALL SELECT 'cve', count(*) FROM cvefixes_cve
 UNION ALL SELECT 'cwe_classification', count(*) FROM cvefixes_cwe_classification""")
def dataset_read(spark, sf_dir):
    out = None
    for name, table in fix_tables(spark, sf_dir).items():
        counted = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("source_table"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("select_distinct", "SELECT * FROM fix_rows")
def select_distinct(spark, sf_dir):
    return dataset.labelled_history(fix_tables(spark, sf_dir))


_KEYED = "SELECT snippet_id, row_number() OVER (ORDER BY sha256(CAST(snippet_id AS VARCHAR) || ':42'), snippet_id) AS position FROM snippets"


@query("row_cap", f"SELECT snippet_id, position FROM ({_KEYED}) WHERE position <= 20000")
def row_cap(spark, sf_dir):
    capped = dataset.row_cap(view(spark, sf_dir, "snippets").select("snippet_id"), "snippet_id", max(4 * 5000, 20000))
    return capped.withColumnRenamed("rank", "position")


@query("shuffle_rows", _KEYED)
def shuffle_rows(spark, sf_dir):
    return dataset.shuffle_rows(view(spark, sf_dir, "snippets").select("snippet_id"), "snippet_id")


@query("balanced_sample", "SELECT code_hash, label, rank FROM balanced_rows")
def balanced_sample(spark, sf_dir):
    unique = dataset.unique_samples(fix_tables(spark, sf_dir))
    return dataset.balanced_sample(unique, "code_hash", 5000).select("code_hash", "label", "rank")


@query("training_set", """SELECT code_hash, code, label, programming_language, cwe_id, row_number() OVER (ORDER BY sha256(code_hash || ':42'), code_hash) AS position FROM balanced_rows""")
def training_set(spark, sf_dir):
    return dataset.training_set(fix_tables(spark, sf_dir)).select(
        "code_hash", "code", "label", "programming_language", "cwe_id", "position")


@query("concat_classes", "SELECT snippet_id, CASE WHEN vulnerable THEN 1 ELSE 0 END AS label FROM pred")
def concat_classes(spark, sf_dir):
    from .registry import predictions
    pred = predictions(spark, sf_dir)
    part = lambda flag: pred.where(F.col("vulnerable") == bool(flag)).select("snippet_id", F.lit(flag).alias("label"))
    return part(1).unionByName(part(0))


@query("stratified_split", """SELECT snippet_id, label, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + ceil(round((n - t) * (0.1e0 / 0.9e0), 6)) THEN 'val' ELSE 'train' END AS split
 FROM (SELECT *, ceil(round(n * 0.1e0, 6)) AS t FROM (SELECT snippet_id, label, count(*) OVER (PARTITION BY label) AS n,
  row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(snippet_id AS VARCHAR) || ':42'), snippet_id) AS rk
  FROM (SELECT snippet_id, CASE WHEN ml_prob >= 0.5e0 THEN 1 ELSE 0 END AS label FROM snippets)))""")
def stratified_split(spark, sf_dir):
    rows = view(spark, sf_dir, "snippets").select("snippet_id", F.when(F.col("ml_prob") >= 0.5, 1).otherwise(0).alias("label"))
    return dataset.stratified_split(rows, "snippet_id").select("snippet_id", "label", "split")


@query("label_rank", """SELECT snippet_id, language, row_number() OVER (PARTITION BY language ORDER BY sha256(CAST(snippet_id AS VARCHAR) || ':7'), snippet_id) AS rank FROM snippets""")
def label_rank(spark, sf_dir):
    return hash_rank(view(spark, sf_dir, "snippets").select("snippet_id", "language"), "snippet_id", ["language"], seed=7)
