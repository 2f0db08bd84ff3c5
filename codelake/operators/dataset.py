"""Training rows from the fix history: join, label, clean, deduplicate, balance, split."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import advanced_clean, fill_language, inject_language_token, label_from_flag
from ..session import staged_in_turn
from .rank import hash_rank, top_per_group
from .settle import settle

FIX_TABLES = ["fixes", "commits", "cve", "cwe_classification", "method_change", "file_change"]
# Rows of the fix history that are joined at a time, and the most slices a history is cut into.
SLICE_ROWS, SLICES = 1_000_000, 8
SAMPLE_COLUMNS = ["code", "before_change", "programming_language", "cwe_id", "cvss3_base_score", "cvss3_base_severity"]


def nonempty_code(method_change: DataFrame) -> DataFrame:
    return method_change.where(F.col("code").isNotNull() & (F.col("code") != ""))


def fix_history(method_change, file_change, commits, fixes, cve) -> DataFrame:
    """Method versions with the file, commit, fix and CVE they belong to (all inner)."""
    return (nonempty_code(method_change).join(file_change, "file_change_id").join(commits, "hash")
            .join(fixes, "hash").join(cve, "cve_id"))


def known_commits(tables: dict[str, DataFrame]) -> DataFrame:
    """What is known of a commit: CWE and score of the CVEs it fixes; the CWE join is one-to-many and may miss."""
    return (tables["fixes"].join(tables["commits"], "hash", "left_semi").join(tables["cve"], "cve_id")
            .join(tables["cwe_classification"], "cve_id", "left").select("hash", "cwe_id", "cvss3_base_score", "cvss3_base_severity"))


def known_files(file_change: DataFrame, known: DataFrame) -> DataFrame:
    """The files of known commits."""
    return file_change.join(known, "hash").drop("hash")


def labelled_files(method_change: DataFrame, files: DataFrame) -> DataFrame:
    """The distinct six-column sample set of these files."""
    return nonempty_code(method_change).join(files, "file_change_id").select(*SAMPLE_COLUMNS).distinct()


def labelled_history(tables: dict[str, DataFrame]) -> DataFrame:
    """The distinct six-column sample set.

    The rows of ``fix_history``, joined from the commits' side: what is known of a commit goes to its files first, and code is moved
    for the last join only.
    """
    return labelled_files(tables["method_change"], known_files(tables["file_change"], known_commits(tables)))


def stored_slices(frames: Iterable[DataFrame], name: str, column: str, n: int) -> list[DataFrame]:
    """All rows of the frames, stored in ``n`` folders by a hash of the column; equal values lie in one. A frame for each folder."""
    number = F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    stored = staged_in_turn((df.withColumn("_slice", number) for df in frames), name, by="_slice")
    return [stored.where(F.col("_slice") == i).drop("_slice") for i in range(n)]


def cleaned(samples: DataFrame, min_length: int = 20) -> DataFrame:
    """Label, language fill, cleaning and language token; short rows dropped afterwards."""
    language = fill_language(F.col("programming_language"))
    tidy = (samples.withColumn("label", label_from_flag(F.col("before_change")))
            .withColumn("programming_language", language)
            .withColumn("code", inject_language_token(
                advanced_clean(F.col("code"), F.col("programming_language")), F.col("programming_language"))))
    return settle(tidy, ["code", "programming_language", "label"]).where(F.length("code") >= min_length)


def dedup_keep_first(df: DataFrame, code: str, order: list[Column], by_text: bool = False) -> DataFrame:
    """One row per SHA-256 of the code, the first in ``order``; ``code_hash`` is kept.

    The group limit runs before the shuffle, so many copies of one text shrink to one row per task. ``by_text`` is for rows that
    keep the text: they meet by the text itself, and only those kept are hashed, so no hash is moved beside the text.
    """
    code_hash = F.sha2(F.col(code), 256)
    if by_text:
        return top_per_group(df, [code], order, 1).drop("rank").withColumn("code_hash", code_hash)
    return top_per_group(df.withColumn("code_hash", code_hash), ["code_hash"], order, 1).drop("rank")


def sample_size(labelled: DataFrame, max_samples: int) -> DataFrame:
    """(label, n, class_count) for both labels: n is the smaller class, at most half the maximum."""
    positive = F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("bigint")
    negative = F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("bigint")
    counts = labelled.agg(F.coalesce(positive, F.lit(0)).alias("p"), F.coalesce(negative, F.lit(0)).alias("q"))
    n = F.least("p", "q", F.lit(max_samples // 2).cast("bigint"))
    return counts.select(F.explode(F.array(
        F.struct(F.lit(1).alias("label"), n.alias("n"), F.col("p").alias("class_count")),
        F.struct(F.lit(0).alias("label"), n.alias("n"), F.col("q").alias("class_count")))).alias("s")).select("s.*")


def balanced_sample(labelled: DataFrame, id_column: str, max_samples: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each label in seeded hash order."""
    # Two rows, one per label.
    sizes = F.broadcast(sample_size(labelled, max_samples).select(F.col("label").alias("_label"), "n"))
    sized = labelled.join(sizes, F.col("label") == F.col("_label")).drop("_label")
    return hash_rank(sized, id_column, ["label"], seed, limit=F.col("n"), few=True).drop("n")


def shuffle_rows(df: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """Position of every row in a seeded random order."""
    return hash_rank(df, id_column, [], seed, rank="position")


def row_cap(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded hash order; a repeatable form of an unordered limit."""
    return hash_rank(df, id_column, [], seed, limit=F.lit(n))


def stratified_split(df: DataFrame, id_column: str, test_size: float = 0.1, val_size: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """Test, validation and training part per label; rows without a label form a group of their own."""
    totals = df.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("_n"))
    ranked = hash_rank(df, id_column, ["label"], seed).join(totals, F.col("label").eqNullSafe(F.col("_label")))
    # Digits beyond the sixth only hold representation error of the fractions.
    test = F.ceil(F.round(F.col("_n") * test_size, 6))
    validation = F.ceil(F.round((F.col("_n") - F.col("_test")) * (val_size / (1.0 - test_size)), 6))
    return (ranked.withColumn("_test", test).withColumn("_val", validation)
            .withColumn("split", F.when(F.col("rank") <= F.col("_test"), "test")
                        .when(F.col("rank") <= F.col("_test") + F.col("_val"), "val").otherwise("train"))
            .drop("_label", "_n", "_test", "_val"))


def sample_slices(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Cleaned samples of the whole history in frames that share no code.

    The shuffles of all joins together take many times the tables' size on disk. So a large history is stored as compressed columns
    and joined by slices of its files, each slice's shuffle files freed before the next. Copies within a slice are dropped with it;
    those in different slices have one code and so meet in one of the frames. Keys of two types may be equal with different hashes,
    so such a history is joined as a whole.
    """
    n = min(SLICES, -(-tables["method_change"].count() // SLICE_ROWS))
    if n < 2 or len({tables[t].schema["file_change_id"].dataType for t in ("method_change", "file_change")}) > 1:
        return [cleaned(labelled_history(tables))]
    known = staged_in_turn([known_commits(tables)], "known-commits")
    parts = known_files(tables["file_change"], known), nonempty_code(tables["method_change"])
    files, methods = (stored_slices([df.select(*[c for c in df.columns if c in ("file_change_id", *SAMPLE_COLUMNS)])], name, "file_change_id", n)
                      for df, name in zip(parts, ("known-files", "methods")))
    return stored_slices((cleaned(labelled_files(m, f)) for m, f in zip(methods, files)), "clean-samples", "code", n)


def unique_samples(tables: dict[str, DataFrame]) -> DataFrame:
    """Joined, cleaned and deduplicated samples, unique by ``code_hash``; staged."""
    order = [F.col(c) for c in ("label", "programming_language", "before_change", "cwe_id", "cvss3_base_score", "cvss3_base_severity")]
    return staged_in_turn((dedup_keep_first(rows, "code", order, by_text=True) for rows in sample_slices(tables)), "unique-samples")


def training_set(tables: dict[str, DataFrame], max_samples: int = 5000, seed: int = 42) -> DataFrame:
    """Unique samples, balanced and shuffled.

    Sizes, ranks and rows each read their input again, so the costly join and the sample are staged.
    """
    sample = staged_in_turn([balanced_sample(unique_samples(tables), "code_hash", max_samples, seed).drop("rank")], "balanced-samples")
    return shuffle_rows(sample, "code_hash", seed)
