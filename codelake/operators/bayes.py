"""A text classifier in closed form: a multinomial model as a table of term weights.

Training is two grouped counts and a top-k, scoring a join with at most ``VOCABULARY`` rows and a sum. Weights are whole
millionths, so sums don't depend on the order of addition.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

# Words of at least two letters, digits or underscores; a text counts up to so many of them.
TERM = r"[\p{L}\p{N}_]{2,}"
MAX_TOKENS = 512
VOCABULARY = 8000
UNIT = 1_000_000
# Log-odds beyond these have probability 0 or 1 to six digits.
LIMIT = 30.0


def tokens(text: Column, max_tokens: int | None = MAX_TOKENS) -> Column:
    """Lower-cased terms of a text, cut to the input length of the classifier."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return found if max_tokens is None else F.slice(found, 1, max_tokens)


def top_terms(rows: DataFrame, terms: Column, size: int = VOCABULARY, **sums: Column) -> DataFrame:
    """The ``size`` terms in most rows, of equal ones the first by name: ``term``, ``df``, ``occurrences`` and the ``sums``.

    ``sums`` are columns of the rows that are added up over a term's occurrences. One grouped pass counts rows and occurrences;
    the limit is applied in each task first.
    """
    one = lambda first, again: lambda t: F.struct(t.alias("term"), F.lit(first).alias("first"), F.lit(again).alias("again"))
    own = rows.select(*[c.alias(k) for k, c in sums.items()], terms.alias("_terms"))
    marked = own.select(*sums, F.inline(F.concat(F.transform(F.array_distinct("_terms"), one(1, 0)), F.transform("_terms", one(0, 1)))))
    counted = marked.groupBy("term").agg(F.sum("first").alias("df"), F.sum("again").alias("occurrences"),
                                         *[F.sum(F.col(k) * F.col("again")).alias(k) for k in sums])
    return counted.orderBy(F.desc("df"), F.asc("term")).limit(size)


@dataclass
class TermModel:
    """Weights of terms (``term``, ``weight``) and the weight of a text without terms."""

    terms: DataFrame
    prior: int

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.terms.sparkSession.createDataFrame([(self.prior,)], "prior long").coalesce(1).write.mode("overwrite").parquet(f"{path}/prior")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TermModel:
        return TermModel(spark.read.schema("term string, weight long").parquet(f"{path}/terms"),
                         spark.read.schema("prior long").parquet(f"{path}/prior").first().prior)


def train(rows: DataFrame, text: str = "text", label: str = "label", size: int = VOCABULARY) -> TermModel:
    """A model of label 1 against label 0, with one added to every count. Rows without a label are left out."""
    known = rows.where(F.col(label).isin(0, 1))
    chosen = staged(top_terms(known, tokens(F.col(text)), size, bad=(F.col(label) == 1).cast("long")), "term-counts")
    n = chosen.agg(F.count("*").alias("terms"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
                   F.coalesce(F.sum(F.col("occurrences") - F.col("bad")), F.lit(0)).alias("good")).first()
    docs = known.agg(F.coalesce(F.sum(label), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    odds = (F.log((F.col("bad") + 1.0) / (n.bad + n.terms)) - F.log((F.col("occurrences") - F.col("bad") + 1.0) / (n.good + n.terms)))
    weights = staged(chosen.select("term", F.round(odds * UNIT).cast("long").alias("weight")), "term-weights")
    return TermModel(weights, round(math.log((docs.bad + 1) / (docs["all"] - docs.bad + 1)) * UNIT))


def probability(units: Column) -> Column:
    odds = F.greatest(F.least(units / UNIT, F.lit(LIMIT)), F.lit(-LIMIT))
    return F.round(1.0 / (1.0 + F.exp(-odds)), 6)


def score(model: TermModel, df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and ``ml_prob`` of every row, by a join of terms and weights; ``key`` must be unique."""
    # The model has at most VOCABULARY rows, or as many as it was trained with.
    found = df.select(key, F.explode(tokens(F.col(text))).alias("term")).join(F.broadcast(model.terms), "term")
    spine = df.select(key, F.lit(0).cast("long").alias("weight"))
    sums = found.select(key, "weight").unionByName(spine).groupBy(key).agg(F.sum("weight").alias("units"))
    return sums.select(key, probability(F.col("units") + model.prior).alias("ml_prob"))


def scorer(model: TermModel, max_tokens: int = MAX_TOKENS) -> Callable[[], Callable[[list[str]], list[float]]]:
    """The model as a loader for ``ml.score_batches``: a function on lists of texts, which cuts each to ``max_tokens``."""
    weights = {r.term: r.weight for r in model.terms.collect()}  # at most VOCABULARY rows
    prior = model.prior

    def load() -> Callable[[list[str]], list[float]]:
        import regex

        term = regex.compile(TERM)

        def run(texts: list[str]) -> list[float]:
            out = []
            for text in texts:
                found = (m.group() for _, m in zip(range(max_tokens), term.finditer(text.lower())))
                odds = max(min((prior + sum(weights.get(t, 0) for t in found)) / UNIT, LIMIT), -LIMIT)
                out.append(1 / (1 + math.exp(-odds)))
            return out

        return run

    return load
