"""Similarity search by an index of sign-random-projection buckets: approximate top k with a target for its recall.

A vector's bucket is the signs of its projections on a few random orthonormal directions. The index is the table of all
vectors with their buckets. A query is sent to the buckets most likely to hold its neighbours, and there meets the vectors in
an equi-join; similarities are exact. How likely a bucket is follows from the query's own projections: a neighbour at cosine c
lies on the other side of a direction with the normal probability of -c |p| / sqrt((1 - c^2)(1 - p^2) / (d - 1)). Since the
k-th best so far bounds c from below, a few rounds send a query to as many more buckets as its neighbours still need:
few if they are close, most if the vectors have no structure.

Buckets with many vectors or many queries are cut into blocks of both, so no task holds a whole large bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .rank import top_per_group
from .similarity import DIGITS, _best, _unit

# Vectors per bucket aimed at, and the most directions.
ROWS_PER_BUCKET, MAX_BITS = 64, 16
# Buckets of the first round, and the share of neighbours to be met after each further one.
FIRST, TARGETS = 8, (0.5, 0.96)
# A block of a bucket holds at most about so many vectors and so many queries.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
SEED = 7


def directions(width: int, bits: int) -> np.ndarray:
    """``bits`` orthonormal directions, the same on every call."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, bits)))[0]


def buckets_of(projections: np.ndarray) -> np.ndarray:
    return (projections > 0) @ (1 << np.arange(projections.shape[1], dtype=np.int64))


def build_index(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """All vectors as (id, v, bucket), written once. The number of directions follows from the number of rows.

    Ids are whole numbers and vectors of one width; rows without id or vector are left out. A zero vector lies in bucket 0.
    """
    known = vectors.select(F.col(key).cast("long").alias("id"), F.col(value).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    shape = known.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first()
    bits = max(1, min(MAX_BITS, shape.width, math.ceil(math.log2(max(shape.n, 2) / rows_per_bucket)) if shape.n > rows_per_bucket else 1))
    plane = directions(shape.width, bits)

    @F.pandas_udf("long")
    def bucket(batch: pd.Series) -> pd.Series:
        return pd.Series(buckets_of(_unit(batch) @ plane) if len(batch) else [], dtype=np.int64)

    return staged(known.withColumns({"bucket": bucket("v"), "bits": F.lit(bits), "width": F.lit(shape.width)}), "lsh-index")


def stay_odds(projections: np.ndarray, c: float, width: int) -> np.ndarray:
    """For each direction the probability that a neighbour at cosine ``c`` lies on the query's side."""
    c = min(max(c, 0.0), 1.0 - 1e-9)
    spread = np.sqrt((1 - c * c) * np.maximum(1 - projections ** 2, 1e-12) / max(width - 1, 1))
    return np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in c * np.abs(projections) / spread])


def likely_buckets(projections: np.ndarray, c: float, width: int, share: float) -> np.ndarray:
    """The fewest buckets that together hold a neighbour at cosine ``c`` with probability ``share``."""
    odds = np.ones(1)
    for stay in stay_odds(projections, c, width):
        odds = np.concatenate([odds * stay, odds * (1 - stay)])
    order = np.argsort(-odds, kind="stable")
    n = int(np.searchsorted(np.cumsum(odds[order]), min(share, 1 - 1e-9))) + 1
    own = int(buckets_of(projections[None, :])[0])
    return order[:n] ^ own


def first_buckets(projections: np.ndarray, n: int) -> np.ndarray:
    """The query's own bucket and those across the nearest directions."""
    near = np.argsort(np.abs(projections), kind="stable")[:max(n - 1, 0).bit_length()]
    flips = np.zeros(1, np.int64)
    for bit in near:
        flips = np.concatenate([flips, flips | (1 << int(bit))])
    return flips[:n] ^ int(buckets_of(projections[None, :])[0])


def probes(projections: np.ndarray, bounds: list[float], width: int) -> np.ndarray:
    """Buckets of the next round; ``bounds`` are the k-th best cosines after each round so far."""
    seen = [first_buckets(projections, FIRST)] + [likely_buckets(projections, c, width, share) for c, share in zip(bounds, TARGETS)]
    return np.setdiff1d(seen[-1], np.concatenate(seen[:-1])) if len(seen) > 1 else seen[0]


def search(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """About the ``k`` vectors most similar to each query: (query_id, ``key``, cosine_similarity, rank).

    Ranks, ties and rounding are those of ``similarity.nearest_rows``: a query doesn't meet rows of its own id, and of equal
    similarities the lowest id comes first. An empty index or no queries give no rows.
    """
    spark = index.sparkSession
    schema = "query_id long, id long, cosine_similarity double"
    shape = index.select("bits", "width").first()
    asked = staged(queries.select(F.col(key).cast("long").alias("query_id"), F.col(value).alias("v")).where("query_id IS NOT NULL AND v IS NOT NULL"), "queries")
    best = spark.createDataFrame([], schema + ", rank int")
    if shape is None:
        return best.withColumnRenamed("id", key)
    plane, width = directions(shape.width, shape.bits), shape.width
    size = index.groupBy("bucket").agg(F.count("*").alias("n"))  # at most 2 ** MAX_BITS rows
    bounds = asked.withColumn("bounds", F.array().cast("array<double>"))
    for step in range(len(TARGETS) + 1):
        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in filter(len, batches):
                found = [probes(p, list(c), width) for p, c in zip(_unit(batch["v"]) @ plane, batch["bounds"])]
                yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(), [len(x) for x in found]), "bucket": np.concatenate(found)})

        sent = staged(bounds.mapInPandas(spread, "query_id long, bucket long"), "probes")
        met = sent.groupBy("bucket").agg(F.count("*").alias("q"))
        blocks = F.broadcast(size.join(met, "bucket").select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("rows"),
                                                             F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("columns")))

        def dealt(df: DataFrame, own: str, other: str, by: str) -> DataFrame:
            """Each row in one block of its own side, and in all blocks of the other side."""
            across = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            return df.join(blocks, "bucket").withColumns({f"_{own}": F.pmod(F.xxhash64(by), F.col(own)).cast("int"), f"_{other}": across}).drop("rows", "columns")

        left = dealt(index.select("bucket", "id", "v"), "rows", "columns", "id")
        right = dealt(sent, "columns", "rows", "query_id").join(asked, "query_id")
        place = ["bucket", "_rows", "_columns"]
        met_rows = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(lambda rows, own: _meet(rows, own, k), schema)
        last = ["query_id"], [F.desc("cosine_similarity"), F.asc("id")], k
        best = staged(top_per_group(best.drop("rank").unionByName(top_per_group(met_rows, *last).drop("rank")), *last), "nearest")
        if step < len(TARGETS):
            kth = best.where(F.col("rank") == k).select("query_id", F.col("cosine_similarity").alias("_kth"))
            bounds = staged(bounds.join(kth, "query_id", "left").withColumn(
                "bounds", F.concat("bounds", F.array(F.coalesce("_kth", F.lit(0.0))))).drop("_kth"), "bounds")
    return best.withColumnRenamed("id", key)


def _meet(rows: pd.DataFrame, own: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a block for each of its queries."""
    if not len(rows) or not len(own):
        return pd.DataFrame({"query_id": [], "id": [], "cosine_similarity": []}).astype({"query_id": "int64", "id": "int64"})
    ids, names = rows["id"].to_numpy(np.int64), own["query_id"].to_numpy(np.int64)
    scores = _unit(own["v"]) @ _unit(rows["v"]).T
    scores = np.copysign(np.floor(np.abs(scores) * 10 ** DIGITS + 0.5), scores)
    scores[names[:, None] == ids] = -np.inf
    scores, found = _best(scores, np.broadcast_to(ids, scores.shape), k)
    ok = np.isfinite(scores.ravel())
    return pd.DataFrame({"query_id": np.repeat(names, scores.shape[1])[ok], "id": found.ravel()[ok], "cosine_similarity": scores.ravel()[ok] / 10 ** DIGITS + 0.0})


def nearest_by_index(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    return search(build_index(vectors, key, value), queries, k, key, value)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: queries, neighbours in the exact result, and how many of them ``found`` has."""
    both = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
