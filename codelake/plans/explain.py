"""Attention queries: token weights, lines, heat maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import explain
from ..sources.fixtures import view
from ..sources.tables import read_table
from .registry import predictions, query


def _cls(spark, sf_dir):
    return explain.cls_attention(view(spark, sf_dir, "attention"))


@query("cls_attention", "SELECT snippet_id, token_idx, token, weight FROM cls_attention")
def cls_attention(spark, sf_dir):
    return _cls(spark, sf_dir).select("snippet_id", "token_idx", "token", "weight")


@query("line_offsets", """SELECT snippet_id, line_number, line_start, line_start + length(line_text) AS line_end FROM (SELECT *,
  CAST(coalesce(sum(length(line_text) + 1) OVER (PARTITION BY snippet_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM snippet_lines)""")
def line_offsets(spark, sf_dir):
    return explain.line_offsets(view(spark, sf_dir, "snippets"))


@query("line_attention", "SELECT snippet_id, line_number, units / 10000000000e0 AS score FROM line_attention")
def line_attention(spark, sf_dir):
    return explain.line_attention(view(spark, sf_dir, "attention"), view(spark, sf_dir, "snippets")).select("snippet_id", "line_number", "score")


@query("sort_lines", "SELECT snippet_id, line_number, row_number() OVER (PARTITION BY snippet_id ORDER BY units DESC, line_number) AS position FROM line_attention")
def sort_lines(spark, sf_dir):
    lines = explain.line_attention(view(spark, sf_dir, "attention"), view(spark, sf_dir, "snippets"))
    order = Window.partitionBy("snippet_id").orderBy(F.desc("units"), F.asc("line_number"))
    return lines.select("snippet_id", "line_number", F.row_number().over(order).alias("position"))


@query("top_lines", "SELECT snippet_id, line_number, units / 10000000000e0 AS score FROM top_lines")
def top_lines(spark, sf_dir):
    return explain.top_lines(view(spark, sf_dir, "attention"), predictions(spark, sf_dir).where("vulnerable"))


HEATMAP_SQL = """SELECT snippet_id, token_idx, token, floor((units + 50000) / 100000) / 100000 AS weight,
  ((units * 20000 + peak) // (2 * peak)) / 10000 AS importance FROM (SELECT *, CASE WHEN max(units) OVER (PARTITION BY snippet_id) = 0 THEN 10000000000
   ELSE max(units) OVER (PARTITION BY snippet_id) END AS peak FROM cls_attention)"""


@query("heatmap_importance", HEATMAP_SQL)
def heatmap_importance(spark, sf_dir):
    return explain.heatmap(_cls(spark, sf_dir)).select("snippet_id", "token_idx", "token", "weight", "importance")


@query("top_tokens", f"""SELECT snippet_id, token, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY snippet_id ORDER BY weight DESC, token_idx) AS rank
 FROM ({HEATMAP_SQL})) WHERE rank <= 15""")
def top_tokens(spark, sf_dir):
    return explain.top_tokens(_cls(spark, sf_dir)).select("snippet_id", "token", "weight", "rank")


@query("attention_shape", """SELECT o_orderkey AS snippet_id, coalesce(n.num_layers, 0) AS num_layers, coalesce(heads, 0) AS num_heads, coalesce(seq, 0) AS sequence_length,
  coalesce('1x' || heads || 'x' || seq || 'x' || seq, '0x0x0x0') AS dimension FROM orders LEFT JOIN (SELECT snippet_id, 1 AS num_layers, max(head) + 1 AS heads, max(token_idx) + 1 AS seq
  FROM attention GROUP BY 1) n ON o_orderkey = snippet_id""")
def attention_shape(spark, sf_dir):
    ids = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snippet_id"))
    return explain.shape_or_zero(ids, view(spark, sf_dir, "attention"))
