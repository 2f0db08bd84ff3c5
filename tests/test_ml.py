"""Spark ML pipelines on small samples."""

import math
import random
import re
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from codelake.operators import bayes, ml


def samples(spark, n=60):
    rows = [(i, "db execute select query" if i % 2 else "pickle loads buffer object", 1, "CWE-89" if i % 2 else "CWE-502") for i in range(n)]
    return spark.createDataFrame(rows, "id int, code string, label int, cwe_id string")


def test_cwe_classifier_learns_and_skips(spark):
    rows = samples(spark)
    model = ml.train_cwe_classifier(rows, trees=3, depth=4)
    got = ml.predict_cwe(model, rows)
    assert got.where("model_cwe <> cwe_id").count() == 0 and "model_cwe" in got.columns
    assert ml.train_cwe_classifier(samples(spark, 40)) is None


def test_equal_rows_share_copies(spark):
    """The forest's rows are bounded by the kinds of rows, not by their number, and every row counts in the weights."""
    rows = spark.range(3000).select((F.col("id") % 3 % 2).alias("a"), (F.col("id") < 3).alias("b"))
    got = ml.weighted_rows(rows, ["a", "b"], most=100)
    sums = {(r.a, r.b): (r.n, r.w) for r in got.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert {k: w for k, (_, w) in sums.items()} == {(0, False): 1998, (1, False): 999, (0, True): 2, (1, True): 1}
    assert sum(n for n, _ in sums.values()) <= 100 and sums[(0, True)][0] == 2
    apart = ml.weighted_rows(rows, ["a", "b"], most=3000)
    assert apart.count() == 3000 and apart.where("weight <> 1").count() == 0
    assert ml.weighted_rows(rows, ["a", "b"], most=1).agg(F.sum("weight")).first()[0] == 3000


def test_cwe_forest_reads_equal_rows_once(spark, monkeypatch):
    """Training and prediction give the forest kinds of rows; the answers are those of every row."""
    seen = []
    fit, transform = ml.RandomForestClassifier.fit, RandomForestClassificationModel.transform
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    monkeypatch.setattr(RandomForestClassificationModel, "transform", lambda self, df: seen.append(df.count()) or transform(self, df))
    monkeypatch.setattr(ml, "FOREST_ROWS", 40)
    rows = samples(spark, 600)
    got = ml.predict_cwe(ml.train_cwe_classifier(rows, trees=3, depth=4), rows)
    assert got.count() == 600 and got.where("model_cwe <> cwe_id").count() == 0 and seen[0] <= 40 and seen[1] == 2


def test_metrics_guards(spark):
    empty = spark.createDataFrame([], "label int, prediction int")
    assert tuple(ml.binary_metrics(empty).select("accuracy", "precision", "recall", "f1").first()) == (0.0, 0.0, 0.0, 0.0)


def test_embedding_of_blank_code(spark):
    rows = spark.createDataFrame([(1, " "), (2, "a_b cd")], "snippet_id long, code string")
    got = {r.snippet_id: r.embedding for r in ml.embed(rows, width=16).collect()}
    assert set(got[1]) == {0.0} and abs(sum(x * x for x in got[2]) - 1) < 1e-6 and len(got[2]) == 16


def test_score_batches(spark):
    def load():
        return lambda texts: [float(len(t)) for t in texts]
    rows = spark.createDataFrame([("ab",), (None,), ("abc" * 50,)], "code string")
    assert sorted(r.ml_prob for r in ml.score_batches(rows, load).collect()) == [0.0, 2.0, 150.0]


def test_term_idf(spark):
    docs = spark.createDataFrame([("Aa bb aa",), ("bb c",)], "text string")
    got = {r.term: r.df for r in ml.term_idf(docs).collect()}
    assert got == {"aa": 1, "bb": 2}
    assert ml.term_idf(docs).where("term = 'bb'").select(F.col("idf")).first()[0] == 1.0


def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        own = "unsafe eval input" if i % 2 else "checked bound query"
        rows.append((i, " ".join(rng.choice(own.split() + ["alpha", "beta", "gamma_1", "x"]) for _ in range(12)), i % 2))
    return spark.createDataFrame(rows + [(900, None, 1), (901, "", 0), (902, "eval", None)], "doc_id long, text string, label int")


def test_term_model_against_a_plain_version(spark, tmp_path):
    """Weights and probabilities written out in plain Python; the model learns, and comes back from disk the same."""
    rows = labelled(spark)
    model = bayes.train(rows, size=8)
    docs = [(r.doc_id, re.findall(r"\w{2,}", (r.text or "").lower()), r.label) for r in rows.collect()]
    known = [d for d in docs if d[2] is not None]
    df, bad, all_ = Counter(t for _, w, _ in known for t in set(w)), Counter(t for _, w, y in known for t in w if y), Counter(t for _, w, _ in known for t in w)
    chosen = sorted(df, key=lambda t: (-df[t], t))[:8]
    b, g = sum(bad[t] for t in chosen), sum(all_[t] - bad[t] for t in chosen)
    weights = {t: round(1e6 * (math.log((bad[t] + 1) / (b + 8)) - math.log((all_[t] - bad[t] + 1) / (g + 8)))) for t in chosen}
    assert {r.term: r.weight for r in model.terms.collect()} == weights
    prior = round(1e6 * math.log((sum(y for *_, y in known) + 1) / (sum(1 - y for *_, y in known) + 1)))
    want = {i: round(1 / (1 + math.exp(-(prior + sum(weights.get(t, 0) for t in w)) / 1e6)), 6) for i, w, _ in docs}
    assert {r.doc_id: r.ml_prob for r in bayes.score(model, rows, "doc_id").collect()} == want
    model.save(str(tmp_path / "m"))
    loaded = bayes.TermModel.load(spark, str(tmp_path / "m"))
    assert {r.doc_id: r.ml_prob for r in bayes.score(loaded, rows, "doc_id").collect()} == want
    batched = ml.score_batches(rows, bayes.scorer(model), "text")
    assert {r.doc_id: round(r.ml_prob, 6) for r in batched.collect()} == want
    right = [(want[i] >= 0.5) == (y == 1) for i, w, y in known if w]
    assert sum(right) > 0.95 * len(right)


def test_scorer_cuts_texts(spark):
    model = bayes.TermModel(spark.createDataFrame([("aa", 5_000_000), ("bb", -9_000_000)], "term string, weight long"), 0)
    rows = spark.createDataFrame([(1, "aa " * 3 + "bb " * 9)], "doc_id long, text string")
    cut = ml.score_batches(rows, bayes.scorer(model, max_tokens=3), "text").first().ml_prob
    assert cut == 1 / (1 + math.exp(-15)) and ml.score_batches(rows, bayes.scorer(model), "text").first().ml_prob < 0.01


def test_model_without_rows(spark):
    rows = labelled(spark)
    model = bayes.train(rows.limit(0))
    assert model.terms.count() == 0 and {r.ml_prob for r in bayes.score(model, rows, "doc_id").collect()} == {0.5}


def test_vocabulary(spark):
    rows = spark.createDataFrame([("the cat_1 sat", "x"), ("cat_1 sat sat", "y"), ("Sat and ran", "x")], "code string, cwe_id string")
    got = [(r.position, r.term, r.df) for r in ml.vocabulary(rows, size=3).orderBy("position").collect()]
    assert got == [(0, "sat", 3), (1, "cat_1", 2), (2, "cat_1 sat", 2)]
    assert [(r.position, r.label, r.rows) for r in ml.label_index(rows).orderBy("position").collect()] == [(0, "x", 2), (1, "y", 1)]


def test_places_of_terms_are_computed_once(spark):
    """Terms are hashed once per snippet and its length is taken once, not again for each dimension."""
    rows = spark.createDataFrame([(1, "def f(): return f")], "snippet_id long, code string")
    steps = str(ml.embed(rows)._jdf.queryExecution().optimizedPlan().toString()).splitlines()
    own = {word: [line for line in steps if word in line] for word in ("md5", "array_remove", "SQRT")}
    assert all(len(lines) == 1 for lines in own.values()) and len({lines[0] for lines in own.values()}) == 3


def test_texts_are_scored_in_batches_bounded_by_bytes(spark):
    """A batch for Python holds some megabytes of text, however long the texts are."""
    def load():
        import sys
        return lambda texts: [float(len(sys._getframe(1).f_locals["frame"]))] * len(texts)

    rows = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("some words "), 2000).alias("code"))
    sizes = [r.ml_prob for r in ml.score_batches(rows, load).select("ml_prob").collect()]
    assert len(sizes) == 2000 and max(sizes) < 1500


def test_texts_are_read_once_for_the_regression(spark):
    """The fit and the scores use hashed counts; texts are tokenized once, and the model scores texts the same."""
    from pyspark.sql import types as T
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = labelled(spark).where("label is not null and text is not null").repartition(2)
    watched = rows.withColumn("text", F.udf(seen, T.StringType()).asNondeterministic()("text"))
    model, scored = ml.fit_text(watched, features=256)
    got = {r.doc_id: round(r.ml_prob, 9) for r in ml.positive_probability(scored).collect()}
    assert read.value == len(got) == rows.count()
    assert {r.doc_id: round(r.ml_prob, 9) for r in ml.positive_probability(model.transform(rows)).collect()} == got
