"""Quality rules (operator 7): counts of words, symbols and repeats, and how well a public vocabulary fits the text.

Fertility is measured word by word: characters per token, share of byte-fallback tokens, and entropy of the tokens in
bits. Each language has a band for each measure, spread around the quartiles of all its documents; languages with few
documents borrow from the bands of all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bound_batches, gather, keep, numbered_words, utf8

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MEASURES = ("chars_per_token", "byte_share", "entropy")
# Bands reach so many interquartile ranges beyond the quartiles, and at least so far from the median.
SPREAD, SLACK = 3.0, {"chars_per_token": 0.12, "byte_share": 0.05, "entropy": 1.5}
# A language's quartiles count as those of so many documents of the whole corpus besides its own.
PRIOR_DOCS = 50
# Bytes of words that a worker keeps with their tokens; a full cache is emptied but for the last batch's words.
# A word takes about so many bytes.
CACHE_BYTES, WORD_BYTES = 24 << 20, 180
# The table of bands is broadcast up to so many languages (100 bytes each); a larger one is joined by shuffle, and the
# documents of a language are dealt to so many tasks then.
BROADCAST_BANDS, SALTS = 1 << 17, 64

BASE = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "n_tokens long, chars_per_token double, byte_share double, entropy double")


class _Tokens(dict):
    """Token ids of a word by the public vocabulary, as bytes; keeps about so many bytes of words."""

    def __init__(self, model_path: str | None, cache_bytes: int = CACHE_BYTES):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(self.model.get_piece_size())), bool)
        self.held, self.most = 0, cache_bytes

    def of(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self]
        if new:
            found = {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in zip(new, self.model.encode(new, num_threads=1))}
            size = WORD_BYTES * len(found)
            if self.held + size > self.most:
                last = {w: self[w] for w in words if w in self}
                self.clear()
                self.update(last)
                self.held = WORD_BYTES * len(last)
            self.update(found)
            self.held += size
        return [self[w] for w in words]


def word_tokens(model_path: str | None, cache_bytes: int = CACHE_BYTES) -> _Tokens:
    """One cache for all tasks of a worker."""
    return keep(f"tokens {cache_bytes} {model_path}", lambda: _Tokens(model_path, cache_bytes))


def repeat_words(ids: np.ndarray) -> int:
    """Words inside any 3-word window that the text has twice or more."""
    if len(ids) < 4:
        return 0
    _, ids = np.unique(ids, return_inverse=True)
    if len(ids) < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pair = np.unique(ids[:-1].astype(np.int64) * len(ids) + ids[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * len(ids) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _entropies(tokens: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Entropy in bits of each document's tokens."""
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(n)), n)
    key, count = np.unique(doc * size + tokens, return_counts=True)
    share = count / np.maximum(n, 1)[key // size]
    return np.bincount(key // size, -share * np.log2(share), minlength=len(n))


def measure(texts: list[bytes], tokens: _Tokens) -> dict[str, np.ndarray]:
    """All columns of BASE for a batch of texts."""
    number, ends, words = numbered_words(texts)
    n_words = np.diff(ends)
    word_ids = [number[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    # Token numbers of all words of all texts in order.
    token, ends = gather(tokens.of(words), number, ends)
    token = token.astype(np.int64)
    n_tokens = np.diff(ends)
    is_byte = np.concatenate([[0], np.cumsum(tokens.is_byte[token])])[ends]
    word_chars = np.fromiter((len(x.translate(None, BLANKS).decode("utf-8", "replace")) for x in texts), np.int64, len(texts))
    repeats = np.fromiter(map(repeat_words, word_ids), np.int64, len(texts))
    some = np.maximum(n_tokens, 1)
    return {"n_words": n_words, "word_chars": word_chars,
            "n_symbols": np.fromiter((len(x) - len(x.translate(None, SYMBOLS)) for x in texts), np.int64, len(texts)),
            "n_dup_lines": np.fromiter(map(dup_lines, texts), np.int64, len(texts)), "n_repeat_words": repeats,
            "base_failed": (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words),
            "n_tokens": n_tokens, "chars_per_token": word_chars / some, "byte_share": np.diff(is_byte) / some,
            "entropy": _entropies(token, ends, len(tokens.is_byte))}


def measured(docs: DataFrame, text_column: str = "text", model_path: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the columns of BASE. Only the text goes through Python; the rest of a row stays where it is."""
    @F.pandas_udf(BASE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(model_path)
        for batch in batches:
            yield pd.DataFrame(measure(list(batch), tokens))

    return docs.withColumn("_measures", run(utf8(text_column))).select(*docs.columns, "_measures.*")


def bands(rows: DataFrame, language: str) -> DataFrame:
    """Low and high limit of each measure for each language, one row per language."""
    fit = rows.where(~F.col("base_failed"))
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES]
    own = fit.groupBy(F.col(language).alias("_language")).agg(F.count("*").alias("_n"), *quartiles)
    overall = fit.agg(*quartiles).first()  # one row of nine numbers
    share = F.col("_n") / (F.col("_n") + PRIOR_DOCS)
    out = [F.col("_language")]
    for m in MEASURES:
        q1, q2, q3 = (share * F.col(m)[i] + (1 - share) * F.lit((overall[m] or [0.0] * 3)[i]) for i in range(3))
        reach = SPREAD * (q3 - q1)
        out += [F.least(q1 - reach, q2 - SLACK[m]).alias(f"_{m}_low"), F.greatest(q3 + reach, q2 + SLACK[m]).alias(f"_{m}_high")]
    return own.select(out)


def judge(docs: DataFrame, keep_columns: list[str], language: str = "lang", text_column: str = "text",
          model_path: str | None = None) -> DataFrame:
    """``keep_columns`` of every row with the counts, the measures and ``kept``.

    Words are runs of characters that aren't ASCII white space; lines end at ``\\n``. ``base_failed`` is true under 50
    words, or if more than half of the words stand in repeated 3-word windows. A document is kept if it passes that and
    its three measures lie in the bands of its language (``language`` may be any column, null being one language).

    Null and empty texts have no words, measures of 0, and fail. Very long texts are measured whole. Repeated rows are
    judged each. Columns named like the result's are replaced. An empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    own = {x.split()[0] for x in BASE.split(", ")} | {"kept"}
    # The columns to keep go along in a struct, so that no name of theirs meets one of ours.
    names = [c for c in dict.fromkeys(keep_columns) if c not in own]
    chosen = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(language).cast("string").alias("_lang"), F.col(text_column).alias("_text"))
    rows = staged(measured(chosen, "_text", model_path).drop("_text"), "measures")
    limits = staged(bands(rows, "_lang"), "bands")
    same = F.col("_lang").eqNullSafe(F.col("_language"))
    if limits.count() <= BROADCAST_BANDS:
        joined = rows.join(F.broadcast(limits), same, "left")
    else:
        dealt = limits.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt_r"))
        salted = rows.withColumn("_salt_l", F.pmod(F.xxhash64(*MEASURES, "n_tokens", "word_chars"), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, same & (F.col("_salt_l") == F.col("_salt_r")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"_{m}_low"), F.col(f"_{m}_high")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select(
        *[F.col("_row").getField(c).alias(c) for c in names], *[x.split()[0] for x in BASE.split(", ")], "kept")
