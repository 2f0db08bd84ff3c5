"""Security knowledge graph of depth one: joins of requests with the edge and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dims import dim


def related(requests: DataFrame, entity: str = "predicted_cwe", relation: str | None = None) -> DataFrame:
    """Out-neighbours of each requested entity, with type and attributes."""
    spark = requests.sparkSession
    edges = dim(spark, "kg_edges")
    if relation:
        edges = edges.where(F.col("relation") == relation)
    nodes = dim(spark, "kg_nodes")
    targets = F.broadcast(edges.join(nodes, edges["dst"] == nodes["node_id"])
                          .select("src", "dst", "relation", "node_type", "label", F.col("severity").alias("node_severity")))
    return requests.join(targets, requests[entity] == targets["src"]).drop("src")


def violations(requests: DataFrame, entity: str = "predicted_cwe") -> DataFrame:
    return related(requests, entity, "violates")


FRAMEWORKS = ["PCI-DSS", "OWASP", "SOC2", "HIPAA"]


def framework_of(text):
    """Framework a rule text or node id belongs to."""
    out = F.lit("Other")
    for name in reversed(FRAMEWORKS):
        out = F.when(F.startswith(text, F.lit(name)), name).otherwise(out)
    return out


def compliance_maps(spark) -> tuple[DataFrame, DataFrame]:
    """(cwe, framework) pairs of the rule table and of the graph, without the classification edges."""
    agent = dim(spark, "dim_compliance").select("cwe", framework_of(F.col("violation")).alias("framework"))
    agent = agent.where("framework <> 'OWASP'").distinct()
    graph = dim(spark, "kg_edges").where("relation = 'violates'").select(
        F.col("src").alias("cwe"), framework_of(F.col("dst")).alias("framework")).distinct()
    return agent, graph


def compliance_gap(spark) -> DataFrame:
    agent, graph = compliance_maps(spark)
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return (side(agent.exceptAll(graph), "agent_only").unionByName(side(graph.exceptAll(agent), "graph_only"))
            .unionByName(side(agent.intersect(graph), "both")))
