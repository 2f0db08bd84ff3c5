"""Cosine similarity of given pairs, the best matches of probe vectors inside their block, and of query rows among all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..session import staged
from .rank import top_per_group

DIGITS = 6
# Query rows that a pass over all rows takes along (16 MB of 64 floats), and queries and rows that are scored at once.
BLOCK, QUERIES_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 1 << 12, 1 << 10


def pair_similarity(pairs: DataFrame, vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """Similarity of requested (id_1, id_2) pairs: two equi joins, work linear in the requests."""
    side = lambda i: vectors.select(F.col(key).alias(f"id_{i}"), F.col(value).alias(f"_v{i}"))
    return (pairs.join(side(1), "id_1").join(side(2), "id_2")
            .withColumn("cosine_similarity", F.round(cosine(F.col("_v1"), F.col("_v2")), DIGITS)).drop("_v1", "_v2"))


def centroids(vectors: DataFrame, block: str, value: str = "embedding") -> DataFrame:
    """Mean vector per block; positions are averaged in parallel, then put together in order."""
    parts = vectors.select(block, F.posexplode(value).alias("_pos", "_x")).groupBy(block, "_pos").agg(
        F.avg(F.col("_x").cast("double")).alias("_mean"))
    return parts.groupBy(block).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "_mean"))), lambda s: s["_mean"]).alias("probe"))


def similar_topk(vectors: DataFrame, probes: DataFrame, k: int, block: str,
                 key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``k`` vectors most similar to their block's probe.

    Each vector meets exactly one probe, and the rank limit is applied in each task before the shuffle.
    """
    scored = vectors.join(probes, block).withColumn(
        "cosine_similarity", F.round(cosine(F.col(value), F.col("probe")), DIGITS))
    return top_per_group(scored.select(block, key, "cosine_similarity"), [block],
                         [F.desc("cosine_similarity"), F.asc(key)], k)


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; a vector without length stays zero, so its similarities are 0.0."""
    out = np.stack([np.asarray(v, np.float64) for v in vectors])
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length == 0.0, 1.0, length)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` highest scores and their ids; of equal scores the lowest ids."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def nearest_rows(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``k`` rows of ``vectors`` most similar to each row of ``queries``, whatever their labels: exact, by brute force.

    Queries go along in blocks of about ``BLOCK`` rows, each broadcast for one pass over all vectors. A task keeps the ``k``
    best per query, so only those are shuffled. A query doesn't meet rows of its own id. Ids are whole numbers; rows without
    id or vector are left out. Work is queries times rows.
    """
    def known(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.col(value).alias("v")).where("id is not null and v is not null")

    asked, rows = known(queries), known(vectors)
    spark = vectors.sparkSession
    asked = staged(asked, "queries")
    parts = -(-asked.count() // BLOCK)
    schema = "query_id long, id long, cosine_similarity double"

    def block(part: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toPandas()
        if not len(mine):
            return spark.createDataFrame([], schema + ", rank int")
        shared = spark.sparkContext.broadcast((mine["id"].to_numpy(np.int64), _unit(mine["v"])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, wanted = shared.value
            best = [(np.empty((len(own[a:a + QUERIES_AT_ONCE]), 0)), np.empty((len(own[a:a + QUERIES_AT_ONCE]), 0), np.int64))
                    for a in range(0, len(own), QUERIES_AT_ONCE)]
            for batch in filter(len, batches):
                for at in range(0, len(batch), ROWS_AT_ONCE):
                    piece = batch.iloc[at:at + ROWS_AT_ONCE].sort_values("id", ascending=False)
                    ids, unit = piece["id"].to_numpy(np.int64), _unit(piece["v"])
                    for b, a in enumerate(range(0, len(own), QUERIES_AT_ONCE)):
                        # Similarities in millionths, half up, and below them the place: of equal ones the lowest id is highest.
                        scores = wanted[a:a + QUERIES_AT_ONCE] @ unit.T
                        scores = np.copysign(np.floor(np.abs(scores) * 10 ** DIGITS + 0.5), scores)
                        scores[own[a:a + QUERIES_AT_ONCE, None] == ids] = -np.inf
                        found = np.broadcast_to(ids, scores.shape)
                        if k < len(ids):
                            place = np.argpartition(scores * len(ids) + np.arange(len(ids)), len(ids) - k, axis=1)[:, len(ids) - k:]
                            scores, found = np.take_along_axis(scores, place, 1), ids[place]
                        best[b] = _best(np.hstack([best[b][0], scores]), np.hstack([best[b][1], found]), k)
            for b, a in enumerate(range(0, len(own), QUERIES_AT_ONCE)):
                scores, ids = best[b]
                names = np.repeat(own[a:a + QUERIES_AT_ONCE], scores.shape[1])
                ok = np.isfinite(scores.ravel())
                if ok.any():
                    yield pd.DataFrame({"query_id": names[ok], "id": ids.ravel()[ok], "cosine_similarity": scores.ravel()[ok] / 10 ** DIGITS + 0.0})

        top = top_per_group(rows.mapInPandas(run, schema), ["query_id"], [F.desc("cosine_similarity"), F.asc("id")], k)
        out = staged(top, "nearest")
        shared.unpersist()
        return out

    blocks = [block(part) for part in range(parts)]
    found = reduce(DataFrame.unionByName, blocks) if blocks else spark.createDataFrame([], schema + ", rank int")
    return found.withColumnRenamed("id", key)
