"""Trainable classifiers and term statistics with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (IDF, CountVectorizerModel, ElementwiseProduct, HashingTF, NGram, RegexTokenizer, SQLTransformer,
                                StopWordsRemover, StringIndexerModel)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.code_parse import FILE_BATCH_BYTES
from ..functions.text import is_blank
from ..session import staged
from .bayes import TERM, tokens, top_terms
from .settle import settle

MIN_CWE_ROWS = 50
# The forest holds a number for each row and term of the vocabulary; so many copies of equal rows are kept apart.
FOREST_ROWS = 1 << 16
BROADCAST_KINDS = 1 << 16


def _terms(code: str) -> list:
    """Lower-cased words without stop words, as unigrams and bigrams in one column."""
    return [RegexTokenizer(inputCol=code, outputCol="words", pattern=TERM, gaps=False),
            StopWordsRemover(inputCol="words", outputCol="kept", stopWords=fixed.STOP_WORDS),
            NGram(n=2, inputCol="kept", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(kept, pairs) AS terms FROM __THIS__")]


def terms_and_pairs(code: Column) -> Column:
    """The same terms as a column expression."""
    kept = F.filter(tokens(code, None), lambda t: ~t.isin(fixed.STOP_WORDS))
    pairs = F.transform(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", t, F.get(kept, i + 1)))
    return F.concat(kept, pairs)


def vocabulary(rows: DataFrame, code: str = "code", size: int = 8000) -> DataFrame:
    """The terms of the CWE model by number of rows and name: ``position`` from 0, ``term``, ``df`` and smoothed ``idf``."""
    n = rows.agg(F.count("*")).scalar()
    top = top_terms(rows, terms_and_pairs(F.col(code)), size).select("term", "df")
    # At most ``size`` rows are numbered.
    place = F.row_number().over(Window.orderBy(F.desc("df"), F.asc("term"))) - 1
    return top.select(place.alias("position"), "term", "df", F.round(F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0, 6).alias("idf"))


def label_index(rows: DataFrame, label: str = "cwe_id") -> DataFrame:
    """Labels by falling number of rows, then by name: ``position`` from 0, ``label`` and ``rows``. There are as many rows as classes."""
    counted = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    return counted.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rows"), F.asc("label"))) - 1)


def cwe_features(vocabulary: list[tuple[str, int]], rows: int, code: str = "code") -> PipelineModel:
    """Counts of the vocabulary's terms (term, df in ``rows`` rows) times their idf, as ``features``."""
    idf = [math.log((rows + 1) / (df + 1)) for _, df in vocabulary]
    return PipelineModel([
        *_terms(code), CountVectorizerModel.from_vocabulary([t for t, _ in vocabulary], inputCol="terms", outputCol="counts"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="features")])


def weighted_rows(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """One row per distinct ``keys`` and as many copies as ``most`` leaves room for, with ``weight``; weights add up to the number of rows.

    Up to ``most`` rows each row stands for itself. Beyond, rows with equal keys share ever fewer copies of ever more weight, down to
    one copy of each.
    """
    kinds = staged(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "kinds-of-rows")
    sums = kinds.agg(*[F.sum(F.least("_n", F.lit(1 << k).cast("bigint"))).alias(f"k{k}") for k in range(1, 41)]).first()
    copies = F.least("_n", F.lit(1 << max((k for k in range(1, 41) if (sums[f"k{k}"] or 0) <= most), default=0)).cast("bigint"))
    return kinds.withColumn("weight", F.col("_n") / copies).withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).drop("_n", "_")


def cwe_samples(samples: DataFrame) -> DataFrame:
    return samples.where("label = 1 and cwe_id is not null and cwe_id <> ''").select("code", "cwe_id")


def train_cwe_classifier(samples: DataFrame, size: int = 8000, trees: int = 200, depth: int = 20, seed: int = 42) -> PipelineModel | None:
    """CWE model on vulnerable rows with a CWE; None when there are too few.

    A forest over the terms' counts. Its cost follows the number of rows times terms, so rows with equal counts and CWE are
    gathered with a weight: rows differ only by what the vocabulary knows of them.
    """
    rows = staged(cwe_samples(samples), "cwe-samples")
    if rows.limit(MIN_CWE_ROWS).count() < MIN_CWE_ROWS:
        return None
    terms = [(r.term, r.df) for r in vocabulary(rows, size=size).orderBy("position").collect()]  # at most ``size``
    labels = [r.label for r in label_index(rows).orderBy("position").collect()]  # classes
    read = [*cwe_features(terms, rows.count()).stages, StringIndexerModel.from_labels(labels, inputCol="cwe_id", outputCol="cwe_index")]
    parts = rows.sparkSession.sparkContext.defaultParallelism
    weighted = staged(weighted_rows(PipelineModel(read).transform(rows), ["features", "cwe_index"], FOREST_ROWS).repartition(parts), "weighted-rows")
    forest = RandomForestClassifier(featuresCol="features", labelCol="cwe_index", weightCol="weight", numTrees=trees, maxDepth=depth,
                                    seed=seed, subsamplingRate=1.0, maxMemoryInMB=1024)
    return PipelineModel([*read, forest.fit(weighted)])


def predict_cwe(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model_cwe`` column from the fitted model, which is asked once for all rows with the same counts."""
    *read, index, forest = model.stages
    labels = F.array(*[F.lit(x) for x in index.labels])
    rows = staged(PipelineModel(read).transform(df).select(*df.columns, "features"), "cwe-features")
    kinds = staged(forest.transform(rows.select("features").distinct())
                   .select("features", F.get(labels, F.col("prediction").cast("int")).alias("model_cwe")), "cwe-answers")
    kinds = F.broadcast(kinds) if kinds.limit(BROADCAST_KINDS + 1).count() <= BROADCAST_KINDS else kinds
    return rows.join(kinds, "features").select(*df.columns, "model_cwe")


def fit_text(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14) -> tuple[PipelineModel, DataFrame]:
    """Logistic regression on hashed terms: the model, and the given rows without their text, scored.

    Every step of the fit reads its input again, so texts are read once and their counts are kept.
    """
    read = PipelineModel([*_terms(text), HashingTF(inputCol="terms", outputCol="counts", numFeatures=features)])
    counts = staged(read.transform(rows).select(*[c for c in rows.columns if c != text], "counts"), "hashed-terms")
    model = Pipeline(stages=[
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, regParam=0.01)]).fit(counts)
    return PipelineModel([*read.stages, *model.stages]), model.transform(counts)


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("ml_prob", F.get(vector_to_array("probability"), F.lit(1)))


def score_batches(df: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], code: str = "code",
                  batch: int = 32) -> DataFrame:
    """``ml_prob`` from any scorer: ``load`` runs once per task and returns a function on lists of texts.

    Whole texts cross into Python, so the batches are bounded by bytes.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(FILE_BATCH_BYTES))
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for frame in frames:
            texts = frame[code].fillna("").tolist()
            scores = [p for i in range(0, len(texts), batch) for p in scorer(texts[i:i + batch])]
            yield frame.assign(ml_prob=scores)[[*names, "ml_prob"]]

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("ml_prob", T.DoubleType())]))


def binary_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 with zero for empty denominators."""
    l, p = F.col(label) == 1, F.col(prediction) == 1
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    share = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    c = F.col
    base = predictions.agg(F.count("*").alias("n"), n(l & p).alias("tp"), n(~l & p).alias("fp"),
                           n(l & ~p).alias("fn"), n((l & p) | (~l & ~p)).alias("correct"))
    return base.select(
        "n", "tp", "fp", "fn", share(c("correct"), c("n")).alias("accuracy"),
        share(c("tp"), c("tp") + c("fp")).alias("precision"), share(c("tp"), c("tp") + c("fn")).alias("recall"),
        share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"))


def split_metrics(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row for a training status: losses of the training and validation parts, accuracy and F1 of the others.

    ``scored`` has ``split`` (train, val, test), the label, ``ml_prob`` and ``prediction``. Losses are summed in whole millionths.
    """
    right = F.col(label) == F.col("prediction")
    own = F.greatest(F.when(F.col(label) == 1, F.col("ml_prob")).otherwise(1.0 - F.col("ml_prob")), F.lit(1e-6))
    units = F.round(-F.log(own) * 1_000_000).cast("bigint")
    columns = []
    for name in ("train", "val", "test"):
        on = lambda c, part=name: F.sum(F.when((F.col("split") == part) & c, 1).otherwise(0))
        both, any_of = (F.col(label) == 1) & (F.col("prediction") == 1), (F.col(label) + F.col("prediction")).cast("bigint")
        columns += [on(F.lit(True)).alias(f"{name}_n"), on(right).alias(f"{name}_right"), on(both).alias(f"{name}_both"),
                    F.sum(F.when(F.col("split") == name, any_of).otherwise(0)).alias(f"{name}_any"),
                    F.sum(F.when(F.col("split") == name, units).otherwise(0)).alias(f"{name}_units")]
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0))).otherwise(0.0)
    f1 = lambda name: F.when(F.col(f"{name}_any") > 0, 2 * F.col(f"{name}_both") / F.nullif(F.col(f"{name}_any"), F.lit(0))).otherwise(0.0)
    return scored.agg(*columns).select(
        (share("train_units", "train_n") / 1_000_000).alias("loss"), (share("val_units", "val_n") / 1_000_000).alias("val_loss"),
        share("val_right", "val_n").alias("val_acc"), f1("val").alias("val_f1"), share("test_right", "test_n").alias("test_accuracy"), f1("test").alias("test_f1"))


def term_idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """Document frequency and smoothed idf of every term."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)))
    n = docs.agg(F.count("*")).scalar()
    return (docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
            .withColumn("idf", F.round(F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0, 6)))


def embed(df: DataFrame, width: int = 64, code: str = "code", key: str = "snippet_id") -> DataFrame:
    """Unit vector of hashed terms per snippet; zeros for blank code. A term's place is its MD5's first four digits, modulo ``width``."""
    words = F.when(is_blank(F.col(code)), F.array().cast("array<string>")).otherwise(tokens(F.col(code), None))
    places = F.transform(words, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % width)
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size("_places") - F.size(F.array_remove("_places", i)))
    length = F.sqrt(F.aggregate("_counts", F.lit(0), lambda total, n: total + n * n).cast("double"))
    unit = F.transform("_counts", lambda n: F.when(n > 0, n / F.col("_length")).otherwise(0.0).cast("float"))
    # Settled, since the optimizer would copy places and length into the functions that run once per dimension.
    placed = settle(df.select(key, places.alias("_places")), ["_places"])
    counted = settle(placed.select(key, counts.alias("_counts")), ["_counts"])
    return settle(counted.withColumn("_length", length), ["_length"]).select(key, unit.alias("embedding"))
