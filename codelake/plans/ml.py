"""Trainable models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes, dataset, ml
from ..session import scratch_path, staged
from ..sources import sinks
from ..sources.fixtures import view
from ..sources.tables import read_table
from . import oracle as O
from .aggregates import METRICS_SQL
from .registry import predictions, query


def _samples(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "snippet_id", "code", F.col("vulnerable").cast("int").alias("label"), F.col("predicted_cwe").alias("cwe_id"))


@query("cwe_classifier")
def cwe_classifier(spark, sf_dir):
    samples = staged(_samples(spark, sf_dir).where("label = 1"), "vulnerable-samples")
    model = ml.train_cwe_classifier(samples)
    if model is None:
        return samples.select("snippet_id", "cwe_id", F.lit(None).cast("string").alias("model_cwe"))
    return ml.predict_cwe(model, samples).select("snippet_id", "cwe_id", "model_cwe")


@query("cwe_vocabulary", """SELECT 'term' AS kind, row_number() OVER (ORDER BY df DESC, term) - 1 AS position, term AS name, df AS n,
  round(ln(((SELECT count(*) FROM cwe_rows) + 1e0) / (df + 1e0)) + 1e0, 6) AS idf FROM cwe_terms
 UNION ALL SELECT 'label', row_number() OVER (ORDER BY count(*) DESC, label) - 1, label, count(*), NULL FROM cwe_rows GROUP BY label""")
def cwe_vocabulary(spark, sf_dir):
    """The fitted part of the CWE model: its terms with their idf, and the index of its labels."""
    rows = ml.cwe_samples(_samples(spark, sf_dir))
    terms = ml.vocabulary(rows).select(F.lit("term").alias("kind"), "position", F.col("term").alias("name"), F.col("df").alias("n"), "idf")
    labels = ml.label_index(rows).select(F.lit("label").alias("kind"), "position", F.col("label").alias("name"), F.col("rows").alias("n"),
                                         F.lit(None).cast("double").alias("idf"))
    return terms.unionByName(labels)


def _labelled(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return read_table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def _parts(spark, sf_dir):
    """Labelled documents with their part, by the split of the training set."""
    rows = _labelled(spark, sf_dir)
    split = dataset.stratified_split(staged(rows.select("doc_id", "label"), "labels"), "doc_id").select("doc_id", "split")
    return rows.join(split, "doc_id")


def _model(spark, sf_dir):
    return bayes.train(_parts(spark, sf_dir).where("split = 'train'"))


def _held_out(spark, sf_dir):
    """The held-out part with the probabilities of the model trained on the training part."""
    test = staged(_parts(spark, sf_dir).where("split = 'test'"), "held-out")
    scored = bayes.score(_model(spark, sf_dir), test, "doc_id")
    return test.select("doc_id", "label").join(scored, "doc_id").withColumn("prediction", (F.col("ml_prob") >= 0.5).cast("int"))


_HELD_OUT = "SELECT doc_id, label, CASE WHEN ml_prob >= 0.5e0 THEN 1 ELSE 0 END AS prediction, ml_prob FROM nb_parts JOIN nb_scores USING (doc_id) WHERE split = 'test'"


@query("vuln_classifier", _HELD_OUT)
def vuln_classifier(spark, sf_dir):
    return _held_out(spark, sf_dir).select("doc_id", "label", "prediction", "ml_prob")


@query("classifier_eval", METRICS_SQL.format(rows=f"(SELECT label = 1 AS l, prediction = 1 AS p FROM ({_HELD_OUT}))"))
def classifier_eval(spark, sf_dir):
    """Metrics of the trained classifier on the held-out part."""
    return ml.binary_metrics(_held_out(spark, sf_dir))


@query("logistic_classifier")
def logistic_classifier(spark, sf_dir):
    """The same task by logistic regression on hashed terms, all labelled documents scored."""
    rows = _labelled(spark, sf_dir)
    _, scored = ml.fit_text(rows)
    return ml.positive_probability(scored).select("doc_id", "label", "prediction", "ml_prob")


@query("tfidf_terms", f"""SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1e0) / (count(*) + 1e0)) + 1e0, 6) AS idf
 FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), {O.lit(ml.TERM)}))) AS term FROM documents) GROUP BY 1""")
def tfidf_terms(spark, sf_dir):
    return ml.term_idf(read_table(spark, sf_dir, "documents"))


@query("embed_snippets", f"""SELECT snippet_id, list_transform(c, lambda n: CASE WHEN n > 0 THEN round(CAST(CAST(n / sqrt(list_sum(list_transform(c, lambda m: m * m))) AS FLOAT) AS DOUBLE), 6) ELSE 0e0 END) AS embedding
 FROM (SELECT snippet_id, list_transform(range(64), lambda i: len(list_filter(p, lambda x: x = i))) AS c
  FROM (SELECT snippet_id, list_transform(regexp_extract_all(lower(code), {O.lit(ml.TERM)}), lambda t: CAST('0x' || substring(md5(t), 1, 4) AS INTEGER) % 64) AS p FROM snippets))""")
def embed_snippets(spark, sf_dir):
    vectors = ml.embed(view(spark, sf_dir, "snippets"))
    return vectors.select("snippet_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@query("model_scorer", "SELECT doc_id, ml_prob FROM nb_scores")
def model_scorer(spark, sf_dir):
    """All documents scored in batches of 32 by the model trained on the training part."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ml.score_batches(docs, bayes.scorer(_model(spark, sf_dir)), "text")
    return scored.select("doc_id", F.round("ml_prob", 6).alias("ml_prob"))


@query("sink_model", "SELECT doc_id, ml_prob FROM nb_scores")
def sink_model(spark, sf_dir):
    """A model that was saved and loaded again."""
    path = scratch_path(spark, "model")
    _model(spark, sf_dir).save(path)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bayes.score(bayes.TermModel.load(spark, path), docs, "doc_id")


_SCORED = """(SELECT split, label, prediction, CAST(round(-ln(greatest(CASE WHEN label = 1 THEN ml_prob ELSE 1e0 - ml_prob END, 1e-6)) * 1000000) AS BIGINT) AS units
 FROM (SELECT *, CASE WHEN ml_prob >= 0.5e0 THEN 1 ELSE 0 END AS prediction FROM nb_parts JOIN nb_scores USING (doc_id)))"""
_LOSS = lambda part: f"round(coalesce(sum(units) FILTER (WHERE split = '{part}') / nullif(count(*) FILTER (WHERE split = '{part}'), 0) / 1000000e0, 0e0), 4)"
_ACC = lambda part: f"round(coalesce(count(*) FILTER (WHERE split = '{part}' AND label = prediction) / nullif(count(*) FILTER (WHERE split = '{part}'), 0), 0e0), 4)"
_F1 = lambda part: f"""round(coalesce(2 * count(*) FILTER (WHERE split = '{part}' AND label = 1 AND prediction = 1)
 / nullif(sum(label + prediction) FILTER (WHERE split = '{part}'), 0), 0e0), 4)"""


@query("sink_train_status", f"""SELECT 'completed' AS status, 1 AS epoch, 1 AS total_epochs, {_LOSS('train')} AS loss, {_LOSS('val')} AS val_loss, {_ACC('val')} AS val_acc,
  {_F1('val')} AS val_f1, CAST(NULL AS VARCHAR) AS error, {_ACC('test')} AS test_accuracy, {_F1('test')} AS test_f1 FROM {_SCORED}""")
def sink_train_status(spark, sf_dir):
    """Status file of a training run over all three parts, written and read back."""
    parts = staged(_parts(spark, sf_dir), "parts")
    scored = parts.drop("text").join(bayes.score(bayes.train(parts.where("split = 'train'")), parts, "doc_id"), "doc_id")
    path = scratch_path(spark, "train-status")
    sinks.write_status(sinks.train_status(ml.split_metrics(scored.withColumn("prediction", (F.col("ml_prob") >= 0.5).cast("int"))), "completed", 1, 1), path)
    return sinks.read_json(spark, path, sinks.STATUS).select("*", "test_metrics.*").drop("test_metrics")
