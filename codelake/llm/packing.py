"""Packing (operator 2): length buckets with the least padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import bound_batches, fingerprint, numbered_words, offsets, utf8
from .quality_rules import word_tokens

# Longest sequence, number of buckets, and tokens of a batch with its padding.
MAX_LENGTH, BUCKETS, BATCH_TOKENS = 2048, 16, 65_536
# Sequences of a bucket are ranked in so many even parts.
PARTS = 4096
# Bytes of words that a worker keeps with their tokens.
CACHE_BYTES = 64 << 20


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that pad the fewest tokens, by dynamic programming.

    ``lengths`` are distinct and ascending. Cost of a bucket is (sequences in it) x (its longest), so that
    best[k][j] = min over i of best[k-1][i] + (sequences i..j) * lengths[j]. Of equal choices the first is taken.
    """
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        new, pick = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + (total[j] - total[:j]) * int(lengths[j - 1])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], pick[j] = cost[i], i
        choices.append(pick)
        best = new
    bounds, j = [], n
    for pick in reversed(choices):
        if j > 0 and pick[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(pick[j])
    return bounds[::-1]


def token_lengths(docs: DataFrame, id_column: str, text_column: str, model_path: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Tokens of each document by the public vocabulary, word by word, with one end token."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(model_path, cache_bytes)
        for batch in filter(len, batches):
            number, ends, words = numbered_words(list(batch["text"]))
            sizes = np.fromiter(map(len, tokens.of(words)), np.int64, len(words)) // 4
            total = offsets(sizes[number] if len(number) else [])
            yield pd.DataFrame({"id": batch["id"], "fp": batch["fp"], "length": np.diff(total[ends]) + 1})

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), fingerprint(text_column).alias("fp"), utf8(text_column).alias("text"))
    return rows.mapInPandas(run, f"id {docs.schema[id_column].dataType.simpleString()}, fp long, length long")


def pack(lengths: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Sequences of ``lengths`` (id, fp, length) with bucket, batch and slot.

    Documents longer than ``max_length`` are cut into sequences of that length and a rest. The histogram of all sequence
    lengths (``max_length`` numbers at most) decides the buckets. In hash order, the sequences of a bucket fill batches
    of floor(batch_tokens / bound) slots, at least one. Lengths below 1 or null count as 1. Repeated rows are sequences of
    their own; equal ones may swap slots. An empty table gives an empty table.
    """
    n = F.greatest(F.coalesce(F.col("length"), F.lit(1)), F.lit(1))
    last = F.floor((n - 1) / max_length).cast("int")
    rows = staged(lengths.select("id", "fp", F.explode(F.sequence(F.lit(0), last)).alias("piece"), n.alias("length"))
                  .withColumn("start", F.col("piece").cast("long") * max_length)
                  .withColumn("n_tokens", F.least(F.col("length") - F.col("start"), F.lit(max_length)))
                  .drop("length"), "sequences")
    # At most max_length rows.
    histogram = sorted((r.n_tokens, r.n) for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    bounds = best_bounds(np.array([h[0] for h in histogram]), np.array([h[1] for h in histogram]), buckets)
    bucket = F.lit(max_length)
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, bound).otherwise(bucket)
    order = F.xxhash64("id", "fp", "piece")
    placed = rows.withColumns({"bucket": bucket.cast("int"), "_order": order, "_part": F.pmod(order, F.lit(PARTS)).cast("int")})
    counts = placed.groupBy("bucket", "_part").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most buckets x PARTS rows of three numbers.
    offsets = F.broadcast(counts.select("bucket", "_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before")))
    inner = Window.partitionBy("bucket", "_part").orderBy("_order", "id", "fp", "piece")
    ranked = placed.withColumn("_rank", F.row_number().over(inner)).join(offsets, ["bucket", "_part"])
    rank = F.col("_before") + F.col("_rank") - 1
    slots = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket")), F.lit(1)).cast("long")
    return ranked.select("id", "piece", "start", "n_tokens", "bucket", F.floor(rank / slots).alias("batch"),
                         (rank % slots).alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_length: int = MAX_LENGTH,
                   buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, model_path: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Packing of the documents' tokens: one row per sequence. Null and empty texts have the end token only; null ids
    stay; columns other than the two aren't read. ``cache_bytes`` of words are kept by a worker; less costs time only."""
    return pack(token_lengths(docs, id_column, text_column, model_path, cache_bytes), max_length, buckets, batch_tokens).withColumnRenamed("id", id_column)
