"""Quality classifier (operator 9): document evidence combined with host and path priors by hierarchical empirical Bayes.

1. Evidence: a naive Bayes model on the words and shape of a document, fitted to labelled documents. Only features whose
   difference between the classes is beyond chance count. Part of the labelled documents calibrates the score to a
   log-likelihood ratio.
2. Priors: grouped sums of the documents' posteriors give each host's rate, shrunk to the global rate, and each path's
   rate, shrunk to its host's. How strongly is estimated from the spread of the rates themselves (method of moments).
3. Posterior: evidence plus the log-odds of the path's rate without the document's own share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bound_batches, utf8
from .decontaminate import words

TARGETS = ("quality", "toxic")
# The classifier is fitted to at most so many labelled documents, the first in hash order of their ids.
MAX_LABELS = 200_000
CELLS = 1 << 18
# A word or word beginning counts if its classes differ by so many standard errors, its log-odds are so large, and so many
# documents have it; a mark of the shape needs less. Every fourth labelled document calibrates.
WORD_LIMITS, SHAPE_LIMITS, FOLDS = (5.0, 1.5, 20), (3.0, 0.2, 10), 4
PREFIXES = (3, 4, 5, 6)
# Scores are calibrated on a grid of so many steps each way.
GRID = 40
# Sums of paths are broadcast up to so many rows (about 60 bytes each); larger tables are joined by shuffle.
BROADCAST_PATHS = 1 << 19
UPPER, SYMBOLS = bytes(range(65, 91)), b"#*$%&|<>"


def shape(text: bytes) -> list[bytes]:
    """Marks of the text's shape; each starts with a zero byte."""
    n, bare = max(len(text), 1), text.split()
    counts = {b"upper": len(text) - len(text.translate(None, UPPER)), b"symbol": len(text) - len(text.translate(None, SYMBOLS)),
              b"shout": text.count(b"!"), b"digit": len(text) - len(text.translate(None, b"0123456789"))}
    marks = [b"\0%s:%d" % (k, min(20, int(50 * v / n))) for k, v in counts.items()]
    return marks + [b"\0distinct:%d" % int(10 * len(set(bare)) / max(len(bare), 1)), b"\0words:%d" % len(bare).bit_length(),
                    b"\0long:%d" % min(20, n // max(len(bare), 1))]


def word_features(word: bytes) -> list[bytes]:
    """A word and its beginnings (which start with a byte of value one)."""
    return [word] + [b"\1" + word[:k] for k in PREFIXES if k < len(word)]


def cell_of(feature: bytes) -> int:
    """Words and beginnings share the lower half of the cells, marks have the upper."""
    return xxhash.xxh3_64_intdigest(feature) & (CELLS - 1) | (CELLS if feature[:1] == b"\0" else 0)


class _Chosen(dict):
    """Cells with weight among a word's features; nearly all words have none."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        value = self[word] = tuple(c for c in map(cell_of, word_features(word)) if self.table[:, c].any())
        return value


def _labelled(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """Rows id, text, fold, quality, toxic of the labelled documents used to fit; a bounded number, so broadcast."""
    # Of contradicting labels of one id the greatest values count.
    own = labels.groupBy(F.col("doc_id").alias("label_id")).agg(*[F.max(t).alias(t) for t in TARGETS])
    own = own.where("label_id IS NOT NULL").withColumn("_h", F.xxhash64("label_id"))
    n = own.count()
    if n > max_labels:
        bound = int(-2**63 + 2**64 * (max_labels / n))
        own = own.where(F.col("_h") < F.lit(min(bound, 2**63 - 1))).orderBy("_h", "label_id").limit(max_labels)
    own = own.select("label_id", *TARGETS, F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"))
    # Copies count once, so that a large group of them doesn't make its words marks of its class.
    return docs.join(F.broadcast(own), F.col("id") == F.col("label_id")).select("text", "fold", *TARGETS).dropDuplicates(["text"])


def fit_weights(labelled: DataFrame) -> np.ndarray:
    """Log-odds of each cell for each target, zero where the classes don't differ beyond chance."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Per target: documents of each class with the cell; the last column counts documents.
        total = np.zeros((2, 2, 2 * CELLS + 1), np.int64)
        for batch in batches:
            for text, q, t in zip(batch["text"], batch["quality"], batch["toxic"]):
                found = {f for w in set(words(text)) for f in word_features(w)}
                cells = np.unique(np.fromiter(map(cell_of, [*found, *shape(text)]), np.int64))
                for k, y in enumerate((q, t)):
                    if y == 0 or y == 1:
                        total[k, int(y), cells] += 1
                        total[k, int(y), -1] += 1
        k, y, cell = np.nonzero(total)
        yield pd.DataFrame({"k": k, "y": y, "cell": cell, "n": total[k, y, cell]})

    sums = (labelled.where("fold > 0").select("text", *TARGETS).mapInPandas(run, "k long, y long, cell long, n long")
            .groupBy("k", "y", "cell").agg(F.sum("n").alias("n")))
    total = np.zeros((2, 2, 2 * CELLS + 1))
    for r in sums.toLocalIterator():  # at most 4 x (2 x CELLS + 1) rows
        total[r.k, r.y, r.cell] = r.n
    n, counts = total[:, :, -1:], total[:, :, :-1]
    rate = (counts + 0.5) / (n + 1)
    error = np.sqrt(rate * (1 - rate) / (n + 1)).clip(1e-12)
    z, odds, seen = (rate[:, 1] - rate[:, 0]) / np.hypot(error[:, 0], error[:, 1]), np.log(rate[:, 1] / rate[:, 0]), counts.sum(axis=1)
    out = np.zeros_like(odds)
    for part, (least_z, least_odds, least_seen) in ((slice(0, CELLS), WORD_LIMITS), (slice(CELLS, None), SHAPE_LIMITS)):
        good = (np.abs(z) >= least_z) & (np.abs(odds) >= least_odds) & (seen >= least_seen)
        out[:, part] = np.where(good, odds, 0)[:, part]
    # Words speak for the rarer class only: those of the frequent class are everywhere and depend on each other.
    for k in range(2):
        rare = 1 if n[k, 1, 0] <= n[k, 0, 0] else -1
        out[k, :CELLS] = np.where(out[k, :CELLS] * rare > 0, out[k, :CELLS], 0)
    return out


def _scores(texts, chosen: _Chosen) -> np.ndarray:
    out = np.zeros((2, len(texts)))
    for i, text in enumerate(texts):
        cells = set(map(cell_of, shape(text)))
        for found in map(chosen.__getitem__, set(words(text))):
            if found:
                cells.update(found)
        out[:, i] = chosen.table[:, list(cells)].sum(axis=1)
    return out


def calibrate(labelled: DataFrame, table) -> list[tuple[float, float, float]]:
    """For each target slope and intercept of the log-odds in the score, and the log-odds of the class's share."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, chosen = np.zeros((2, 2, 2 * GRID + 1), np.int64), _Chosen(table.value)
        for batch in batches:
            step = np.clip(np.round(2 * _scores(batch["text"], chosen)), -GRID, GRID).astype(np.int64) + GRID
            for k, target in enumerate(TARGETS):
                y = batch[target].to_numpy(float, na_value=-1)
                for c in (0, 1):
                    total[k, c] += np.bincount(step[k][y == c], minlength=2 * GRID + 1)
        k, y, at = np.nonzero(total)
        yield pd.DataFrame({"k": k, "y": y, "at": at, "n": total[k, y, at]})

    sums = (labelled.where("fold = 0").select("text", *TARGETS).mapInPandas(run, "k long, y long, at long, n long")
            .groupBy("k", "y", "at").agg(F.sum("n").alias("n")))
    total = np.zeros((2, 2, 2 * GRID + 1))
    for r in sums.collect():  # at most 4 x (2 x GRID + 1) rows
        total[r.k, r.y, r.at] = r.n
    return [_logistic(total[k]) for k in range(2)]


def _logistic(counts: np.ndarray) -> tuple[float, float, float]:
    """Slope (0 to 1.5), intercept and prior log-odds of the best logistic curve through the counts."""
    x = (np.arange(counts.shape[1]) - GRID) / 2
    zeros, ones = counts
    prior = math.log((ones.sum() + 1) / (zeros.sum() + 1))
    if not counts.sum():
        return 1.0, 0.0, 0.0
    best = None
    for a in np.linspace(0, 1.5, 61):
        low, high = -60.0, 60.0
        for _ in range(60):
            b = (low + high) / 2
            # One pseudo-document at the prior keeps separable classes finite.
            surplus = ones.sum() + 1 - ((zeros + ones) / (1 + np.exp(-np.clip(a * x + b, -500, 500)))).sum() - 2 / (1 + math.exp(prior - b))
            low, high = (b, high) if surplus > 0 else (low, b)
        z = a * x + b
        fit = -(ones * np.logaddexp(0, -z) + zeros * np.logaddexp(0, z)).sum() - 0.1 * (a - 1) ** 2
        if best is None or fit > best[0]:
            best = (fit, float(a), float(b))
    return best[1], best[2], prior


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(rates: DataFrame, rate: str, mean: Column | float, n: str) -> float:
    """Pseudo-count of a Beta prior from the spread of groups' rates around their parent's (method of moments)."""
    mean = F.lit(mean) if isinstance(mean, float) else mean
    weight = F.col(n) - 1.0
    got = rates.where(F.col(n) > 1).agg(
        F.sum(weight * (F.col(rate) - mean) ** 2).alias("spread"), F.sum(weight * mean * (1 - mean)).alias("full"),
        F.sum(weight * mean * (1 - mean) / F.col(n)).alias("noise"), F.sum(weight).alias("w")).first()
    if not got.w or not got.full:
        return 10.0
    between = max(got.spread - got.noise, 1e-6 * got.full)
    return float(min(max(got.full / between - 1, 1.0), 10_000.0))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
             path_column: str = "lang", max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per document: evidence and posterior of both targets, the host's and path's rates, and ``kept``.

    A document is kept if its quality is at least 0.5 and its toxicity below. ``labels`` has doc_id, quality and toxic
    (0, 1 or null). ``host_column`` and ``path_column`` group documents; a null host or path is a group of its own.

    Null and empty texts have the shape features of an empty text only. Without labels, or with one class, evidence is flat
    and the priors decide. Labels of unknown or null documents do nothing. Repeated rows are judged each. Other columns
    aren't read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_column).alias("id"), F.col(host_column).cast("string").alias("host"),
                       F.col(path_column).cast("string").alias("path"), utf8(text_column).alias("text"))
    labelled = staged(_labelled(rows, labels, max_labels), "labelled")
    table = spark.sparkContext.broadcast(fit_weights(labelled).astype(np.float32))
    fits = calibrate(labelled, table)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = _Chosen(table.value)
        for batch in filter(len, batches):
            got = _scores(batch["text"], chosen)
            ratio = [a * got[k] + b - prior for k, (a, b, prior) in enumerate(fits)]
            yield batch.drop(columns="text").assign(quality_evidence=ratio[0], toxic_evidence=ratio[1])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = rows.mapInPandas(score, f"id {kind}, host string, path string, quality_evidence double, toxic_evidence double")
    own = {t: _expit(F.col(f"{t}_evidence") + F.lit(prior)) for t, (_, _, prior) in zip(TARGETS, fits)}
    scored = staged(scored.withColumns({f"{t}_own": own[t] for t in TARGETS}), "scored")
    sums = [F.sum(f"{t}_own").alias(f"{t}_sum") for t in TARGETS]
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"{t}_sum").alias(f"{t}_host_sum") for t in TARGETS])
    total = paths.agg(F.sum("n").alias("n"), *[F.sum(f"{t}_sum").alias(t) for t in TARGETS]).first()
    joined = staged(paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h"), "path-sums")
    n_all, rates = max(total.n or 0, 1), {}
    for t in TARGETS:
        everywhere = float((total[t] or 0.0) / n_all)
        host_rates = hosts.withColumn("r", F.col(f"{t}_host_sum") / F.col("host_n"))
        k = _strength(host_rates, "r", everywhere, "host_n")
        host_rate = (F.col(f"{t}_host_sum") + k * everywhere) / (F.col("host_n") + k)
        joined = joined.withColumn(f"{t}_host", host_rate)
        path_k = _strength(joined.withColumn("r", F.col(f"{t}_sum") / F.col("n")), "r", F.col(f"{t}_host"), "n")
        rates[t] = path_k
    joined = joined.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", *[c for t in TARGETS for c in (f"{t}_sum", f"{t}_host")])
    if joined.count() <= BROADCAST_PATHS:
        joined = F.broadcast(joined)
    out = scored.join(joined, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    for t in TARGETS:
        # The document's own share is left out of its path's rate.
        prior = (F.col(f"{t}_sum") - F.col(f"{t}_own") + rates[t] * F.col(f"{t}_host")) / (F.col("n") - 1 + rates[t])
        out = out.withColumn(f"{t}_path", prior)
        out = out.withColumn(t, _expit(F.col(f"{t}_evidence") + _logit(F.col(f"{t}_path"))))
    return out.select(F.col("id").alias(id_column), *[c for t in TARGETS for c in (f"{t}_evidence", f"{t}_host", f"{t}_path", t)],
                      ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("kept"))
