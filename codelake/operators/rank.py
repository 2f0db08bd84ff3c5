"""Ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the hash that make a bucket: 65,536 buckets per group.
BUCKET_DIGITS = 4


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The limit on ``row_number`` is pushed below the shuffle by the optimizer (a group limit per
    partition), so a hot group sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def hash_order_key(id_column: str, seed: int) -> Column:
    return F.sha2(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")), 256)


def hash_rank(df: DataFrame, id_column: str, keys: list[str] = (), seed: int = 42,
              limit: Column | None = None, rank: str = "rank", few: bool = False) -> DataFrame:
    """Exact rank of every row in seeded hash order, within ``keys`` or over all rows.

    A window over the whole group would put a group on one task. Here the hash prefix splits each group
    into even buckets: bucket sizes give each bucket's offset, and a small window inside each bucket gives
    the rest. With ``limit`` (a column of the group, such as a sample size) buckets past it are dropped
    before anything is sorted.

    ``id_column`` must be unique. The input is read twice, so give a table or a staged frame. Without
    ``keys`` the offsets have one row per bucket and are broadcast; with keys the planner decides by size,
    unless there are ``few`` groups: then they are broadcast as well, and no row past the limit is moved.
    """
    keys = list(keys)
    hashed = df.withColumn("_hash", hash_order_key(id_column, seed))
    hashed = hashed.withColumn("_bucket", F.conv(F.substring("_hash", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    sizes = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    # At most one row per bucket and group.
    order = Window.partitionBy(*keys, F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(order), F.lit(0)))
               .select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                       F.col("_bucket").alias("_keyb"), "_offset"))
    if few or not keys:
        offsets = F.broadcast(offsets)
    condition = F.col("_bucket") == F.col("_keyb")
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = hashed.join(offsets, condition).drop("_keyb", *[f"_key{i}" for i in range(len(keys))])
    if limit is not None:
        joined = joined.where(F.col("_offset") < limit)
    inner = Window.partitionBy(*keys, "_bucket").orderBy("_hash", id_column)
    ranked = joined.withColumn(rank, F.col("_offset") + F.row_number().over(inner))
    if limit is not None:
        ranked = ranked.where(F.col(rank) <= limit)
    return ranked.drop("_hash", "_bucket", "_offset")
