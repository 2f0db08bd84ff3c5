"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Whole texts cross into Python in batches of at most so many bytes and rows.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Python workers get rows in batches bounded by bytes, so long texts can't exhaust them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def utf8(column: str) -> Column:
    """The text's bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def fingerprint(column: str) -> Column:
    """64-bit fingerprint of a text; with the document's id it names a document even if ids repeat."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


_kept: dict[str, object] = {}


def keep(name: str, make: Callable[[], object]):
    """What a worker keeps from task to task, such as a vocabulary with a cache of words.

    It keeps one thing at a time: the operators of a pipeline share the workers, and what another one kept is let go.
    """
    if name not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can give memory back
            ctypes.CDLL(None).malloc_trim(0)
        _kept[name] = make()
    return _kept[name]


def in_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``fn`` over batches of rows; a batch may give no rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep("nothing", lambda: None)
        for batch in batches:
            if len(batch):
                out = fn(batch)
                if out is not None and len(out):
                    yield out

    return df.mapInPandas(run, schema)


def offsets(sizes: Iterable[int]) -> np.ndarray:
    """Start of each item and the total, from the items' sizes."""
    sizes = np.fromiter(sizes, np.int64)
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def numbered_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words (runs without ASCII white space) of all texts as numbers, the ends of the texts' runs of numbers, and the distinct words.

    Bytes that are no UTF-8 are replaced. With ``lower``, A-Z are lower-cased but in texts with ``<|``.
    """
    column = pa.array(texts, pa.large_binary())
    try:
        column = column.cast(pa.large_string())
    except pa.ArrowInvalid:
        column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string())
    if lower:
        column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
    words = pc.ascii_split_whitespace(column)
    ends = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.dictionary_encode()
    number, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if "" in distinct:  # at the ends of texts
        empty = distinct.index("")
        kept = number != empty
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        number = number[kept]
        number -= number > empty
        del distinct[empty]
    return number, ends, distinct


def gather(pieces: list[bytes], number: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers of the pieces in the order of ``number``, all in one row, and the ends of the texts in it."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    begin, store = offsets(sizes)[:-1], np.frombuffer(b"".join(pieces), "<u4")
    n = sizes[number] if len(number) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(total[-1]) + np.repeat((begin[number] if len(number) else n) - total[:-1], n)
    return store[at], total[ends]


class Index(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value
