"""Source files of many repositories, read with the binary file source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import is_blank, path_excluded, path_extension
from ..session import staged


def _relative(path: Column, root: str) -> Column:
    """Path below the scanned root; only this part decides about hidden folders.

    Both are compared decoded and without scheme and host, and the root is cut off in front only.
    """
    clean = F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:(//[^/]*)?", ""), "^/+", "/")
    bare = "/" + re.sub("^[a-z0-9]+:(//[^/]*)?", "", root).strip("/") + "/"
    return F.when(F.startswith(clean, F.lit(bare)), F.substring(clean, F.lit(len(bare) + 1), F.length(clean))).otherwise(clean)


def _decoded(path: Column) -> Column:
    """File metadata has percent-encoded paths; a plus sign is no blank there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _any_case(ext: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)


def decode_ignore(content: Column) -> Column:
    """UTF-8 text without the undecodable bytes."""
    return F.replace(decode_replace(content), F.lit("�"), F.lit(""))


def decode_replace(content: Column) -> Column:
    """UTF-8 text with undecodable bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


# Source files are small: a task takes so many that their starts don't outweigh them. Spark counts 4 MB for each by default, so
# that a task has some 30 files of a few kilobytes.
OPEN_COST_BYTES = 512 << 10


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST_BYTES))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def scan_repo_files(spark: SparkSession, root: str, extensions: list[tuple[str, str]] = fixed.EXTENSIONS) -> DataFrame:
    """Files with a supported extension outside hidden and environment folders: path, language, code.

    Extensions are cut at listing time and folders by file metadata, before any content is read.
    Names starting with ``_`` are not listed by Spark; give such folders as explicit roots.
    """
    names = ",".join(_any_case(ext) for ext, _ in extensions)
    files = _files(spark, root, "*.{" + names + "}").where(~path_excluded(_relative(_decoded(F.col("_metadata.file_path")), root)))
    ext = path_extension(F.col("file_path"))
    language = F.coalesce(*[F.when(ext == e, name) for e, name in extensions])
    return (files.withColumn("file_path", _relative(F.col("path"), root))
            .select("file_path", language.alias("language"), decode_ignore(F.col("content")).alias("code")))


def scan_py_files(spark: SparkSession, root: str, suffix: str = "py") -> DataFrame:
    """Non-blank ``.py`` files outside dot folders; undecodable bytes stay visible as replacements."""
    folders = lambda p: F.split(F.regexp_replace(p, "/?[^/]*$", ""), "/")
    hidden = F.exists(folders(_relative(_decoded(F.col("_metadata.file_path")), root)), lambda d: F.startswith(d, F.lit(".")))
    files = _files(spark, root, f"*.{suffix}").where(~hidden)
    return (files.select(_relative(F.col("path"), root).alias("file_path"), decode_replace(F.col("content")).alias("code"))
            .where(~is_blank(F.col("code"))))


def write_source_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row (``file_path`` below ``root``, ``content``) as a file of its own, with its own name and extension.

    Tasks write the files themselves, one row at a time; a task that runs again writes the same files. Gives the paths.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = (FileSystem.from_uri(root) if re.match("^[a-z0-9]+:/", root) else (LocalFileSystem(), root))
        for batch in batches:
            for path, content in zip(batch["file_path"], batch["content"]):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.encode())
            yield batch[["file_path"]]

    return staged(files.select("file_path", "content").mapInPandas(run, "file_path string"), "written-files")


FILE_RECORDS = 10000
LANGUAGES = sorted({name for _, name in fixed.EXTENSIONS})


def write_repo_files(snippets: DataFrame, root: str, languages: list[str] | None = None) -> None:
    """Snippets as text files, one folder per language and repository bucket of a language.

    Files are cut after ``FILE_RECORDS`` snippets, so a large repository gets many files, not a large one. ``languages``
    (all supported ones if not given) are the folders that ``scan_written`` looks for; others go to ``Other``.
    """
    names = languages or LANGUAGES
    language = F.when(F.col("language").isin(names), F.col("language")).otherwise(F.lit("Other"))
    (snippets.select("repo_id", "code", F.regexp_replace(language, "[^A-Za-z0-9]", "-").alias("language")).write.mode("overwrite")
     .option("maxRecordsPerFile", FILE_RECORDS).partitionBy("language", "repo_id").text(root))


def scan_written(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """Read back what ``write_repo_files`` wrote; Spark names text files ``.txt``, so the folder gives the language."""
    names = {re.sub("[^A-Za-z0-9]", "-", name): name for name in (languages or LANGUAGES)}
    folder = F.regexp_extract("file_path", "(?:^|/)language=([^/]+)/", 1)
    language = F.coalesce(*[F.when(folder == f, name) for f, name in names.items()], folder)
    return scan_repo_files(spark, root, [("txt", "Other")]).withColumn("language", language)
