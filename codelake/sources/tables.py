"""Base tables, read with explicit schemas so that no footer is opened for inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


# Session setting: base tables are dealt to so many tasks after the scan. Off unless set; for files of one row group, which
# one task reads, however many cores there are.
READ_PARTS = "spark.codelake.readParts"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, read as it lies; ``spark.sql.files.maxPartitionBytes`` sets the size of a task's share, ``READ_PARTS`` deals rows anew."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(READ_PARTS, None)
    return rows.repartition(int(parts)) if parts else rows


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int],
              partitions: int, **options) -> DataFrame:
    """A database table read in ``partitions`` ranges of ``key``, never through one connection."""
    return (spark.read.format("jdbc").options(**options)
            .option("url", url).option("dbtable", table).option("partitionColumn", key)
            .option("lowerBound", bounds[0]).option("upperBound", bounds[1])
            .option("numPartitions", partitions).load())
