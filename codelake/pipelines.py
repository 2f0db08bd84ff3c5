"""End-to-end jobs: scan files, rate repositories, report, build training rows and train."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.code_parse import explode_functions
from .operators import dataset, detect, explain, ml, report, score
from .session import staged


REPO = r"^([^/]+)/"


def scanned_files(files: DataFrame, repo: str = REPO) -> DataFrame:
    """Repository and path of all files, with or without functions."""
    return files.select(F.regexp_extract("file_path", repo, 1).alias("repo_id"), "file_path")


def scan(files: DataFrame, repo: str = REPO, score_functions: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Predictions for every function of the given files (``file_path``, ``language``, ``code``).

    ``repo`` is a pattern whose first group names the repository in a path. ``score_functions`` adds ``ml_prob`` to a
    frame with ``code``; without it only the static rules decide. ``snippet_id`` orders functions as they stand: by path,
    line and place. Files without functions give no row; ``scanned_files`` has them for ``repository_risk``.
    """
    functions = explode_functions(files).withColumnRenamed("source", "code")
    functions = functions.withColumn("repo_id", F.regexp_extract("file_path", repo, 1)).withColumn(
        "snippet_id", F.format_string("%s:%09d:%06d:%s", "file_path", "line_number", "function_place", "function_name")).drop("function_place")
    scored = score_functions(functions) if score_functions else functions.withColumn("ml_prob", F.lit(0.0))
    return detect.predict(scored)


def explained_findings(pred: DataFrame, attention: DataFrame | None = None) -> DataFrame:
    """Finding rows; with an attention table they carry affected lines and the line sentence."""
    bad = pred.where("vulnerable")
    if attention is None:
        spanned = bad.withColumns({c: F.lit(None).cast("int") for c in ("first_line", "last_line")})
    else:
        spanned = explain.with_top_lines(bad, explain.snippet_tokens(attention))
    return detect.finding_projection(explain.with_reason(spanned))


def repository_risk(pred: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Scores, grade, impact and counts per repository; with ``scanned_files`` those without a function count as clean."""
    return score.repo_scores(pred, files=files)


def executive_reports(pred: DataFrame, attention: DataFrame | None = None, product: str = report.PRODUCT, files: DataFrame | None = None) -> DataFrame:
    """Report text per repository; with ``scanned_files`` those without a function get one too."""
    found = staged(explained_findings(pred, attention), "findings")
    return report.report_markdown(score.repo_scores(pred, files=files), report.top_findings(found), score.compliance_set(found), product=product)


def training_rows(tables: dict[str, DataFrame], max_samples: int = 5000) -> DataFrame:
    """Balanced training rows with their split."""
    rows = staged(dataset.training_set(tables, max_samples), "training-rows")
    return dataset.stratified_split(rows, "code_hash")


def train(rows: DataFrame) -> tuple[PipelineModel, PipelineModel | None, DataFrame]:
    """(vulnerability model, CWE model or None, test metrics) from split training rows."""
    part = rows.where("split = 'train'")
    model = ml.fit_text(part, "code")[0]
    metrics = ml.binary_metrics(model.transform(rows.where("split = 'test'")))
    return model, ml.train_cwe_classifier(part), metrics
