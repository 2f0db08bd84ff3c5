"""URL filters (operator 8): rules by host and path; elsewhere segmented host and path words scored by naive Bayes.

The unigram model counts the words of all pages, the naive Bayes model those of all URLs; neither leaves out rare ones. Of a
large unigram model only the words that occur inside URLs are looked up. Tokens of at least a fixed share of all occurrences
are broadcast with their log-odds, the others are joined by shuffle; none of these is frequent, so no key is hot.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bound_batches, utf8

# Rules (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Words that mark a URL as unwanted in the fit. Labels of URLs may be given instead.
UNWANTED = ["ads", "adserver", "bet", "bets", "betting", "casino", "cialis", "clickbait", "gambling", "hacked", "jackpot", "lottery",
            "malware", "payday", "phishing", "pills", "poker", "porn", "replica", "scam", "slots", "spam", "torrent", "tracker",
            "viagra", "warez", "xxx"]
# Frequent words of such and other hosts that a corpus may lack.
COMMON = ["blog", "book", "buy", "cheap", "click", "deal", "deals", "example", "farm", "free", "game", "games", "get", "home", "loan",
          "loans", "mail", "mobile", "news", "now", "online", "page", "shop", "site", "store", "the", "top", "track", "web", "win", "www"]
# The least share of all occurrences that given words count with, and the share from which tokens are broadcast (at most 1,000,000).
WORD_SHARE, TOKEN_SHARE = 1e-5, 1e-6
# A unigram model of so many words is broadcast whole.
WORDS_WHOLE = 1 << 17
LONGEST = 24
LETTERS = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
TAGS = re.compile(rb"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to a query or fragment; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


def rule_for(host: str, path: str, rules=None) -> tuple[str | None, str | None]:
    """Longest rule that fits (as host and path in one) and its verdict."""
    best = None
    for rule_host, rule_path, verdict in rules or RULES:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[0]):
                best = (rule_host + rule_path, verdict)
    return best or (None, None)


class Segmenter:
    """Most likely split of a run of letters into words of a unigram model (Viterbi)."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(sum(counts.values()) if total is None else total, 1)
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items() if len(w) > 1}
        self.known: dict[str, list[str]] = {}

    def word_cost(self, word: str) -> float:
        # An unknown word gets less likely by a factor of ten with each letter.
        return self.cost.get(word) or math.log(self.total) + math.log(10) * len(word)

    def split(self, run: str) -> list[str]:
        if run in self.known:
            return self.known[run]
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            cost, start = min((best[s] + self.word_cost(run[s:end]), s) for s in range(max(0, end - LONGEST), end))
            best.append(cost)
            back.append(start)
        out, end = [], len(run)
        while end:
            out.append(run[back[end]:end])
            end = back[end]
        if len(self.known) < 200_000:
            self.known[run] = out[::-1]
        return out[::-1]


def url_tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Words of the host (``h:``) and the path (``p:``); numbers are one token."""
    out = []
    for place, text in (("h:", host), ("p:", path.lower())):
        for run in LETTERS.findall(text):
            out += [place + "0"] if run[0].isdigit() else [place + w for w in (segmenter.split(run) if run.isascii() else [run])]
    return out


def inside_urls(pages: DataFrame, url_column: str) -> DataFrame:
    """Distinct strings of 2 to ``LONGEST`` letters inside the runs of letters of all URLs: what a segmenter can ask for."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            runs = {r for url in batch["url"] for text in split_url(url) for r in LETTERS.findall(text.lower()) if r.isascii() and r.isalpha()}
            for r in runs:
                seen.update(r[a:b] for a in range(len(r)) for b in range(a + 2, min(len(r), a + LONGEST) + 1))
                if len(seen) > 200_000:
                    yield pd.DataFrame({"word": list(seen)})
                    seen = set()
        if seen:  # a frame without rows has no types
            yield pd.DataFrame({"word": list(seen)})

    return pages.select(F.col(url_column).cast("string").alias("url")).mapInPandas(run, "word string").distinct()


def page_words(pages: DataFrame, html_column: str, url_column: str, share: float | None = None) -> tuple[dict[str, int], int]:
    """Counts of the words (a-z) in all pages' texts, of a large table those that occur inside URLs, and the sum of all."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch["html"]:
                total.update(TAGS.sub(b" ", html).translate(TO_WORDS).split())
            if len(total) > 200_000:
                yield _frame(total)
                total = Counter()
        if total:  # a frame without rows has no types
            yield _frame(total)

    def _frame(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [w.decode() for w in total], "n": list(total.values())})

    counts = staged(pages.select(utf8(html_column).alias("html")).mapInPandas(run, "word string, n long")
                    .groupBy("word").agg(F.sum("n").alias("n")), "words")
    all_words = counts.agg(F.sum("n").alias("n")).first().n or 0
    share = WORD_SHARE if share is None else share
    short = counts.where(F.length("word") <= LONGEST)
    size = short.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    kept = short if size.rows <= WORDS_WHOLE else short.join(inside_urls(pages, url_column), "word", "left_semi")
    kept = kept.select("word", "n").toPandas()
    out, total = dict(zip(kept["word"], kept["n"].tolist())), size.n or 0
    # Given words count at least as much as a word at the share.
    least = max(1, int(share * all_words))
    given = sorted({*COMMON, *UNWANTED})
    known = {r.word: r.n for r in short.where(F.col("word").isin(given)).collect()}
    for word in given:
        out[word] = max(known.get(word, 0), least)
        total += out[word] - known.get(word, 0)
    return out, total


def fit(pages: DataFrame, url_column: str, words: tuple[dict[str, int], int], unwanted: list[str], label: str | None = None,
        share: float | None = None) -> tuple[float, dict[str, float], DataFrame | None]:
    """Log-odds of ``block``, of each token of at least the share of all, and a table of the other tokens' (None: no others).

    A URL's class is its label (1: block), or an unwanted word in its host.
    """
    shared = pages.sparkSession.sparkContext.broadcast((words, frozenset("h:" + w for w in unwanted)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter, marks = Segmenter(*shared.value[0]), shared.value[1]
        total: Counter = Counter()
        for batch in batches:
            for url, given in zip(batch["url"], batch["label"]):
                tokens = url_tokens(*split_url(url), segmenter)
                block = given == 1 if label else not marks.isdisjoint(tokens)
                total.update((t, block) for t in tokens)
                total["", block] += 1
            if len(total) > 200_000:
                yield _frame(total)
                total = Counter()
        if total:  # a frame without rows has no types
            yield _frame(total)

    def _frame(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"token": [t for t, _ in total], "block": [n if b else 0 for (_, b), n in total.items()],
                             "allow": [0 if b else n for (_, b), n in total.items()]})

    rows = pages.select(F.col(url_column).cast("string").alias("url"), (F.col(label).cast("int") if label else F.lit(0)).alias("label"))
    counts = staged(rows.mapInPandas(run, "token string, block long, allow long")
                    .groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-words")
    sums = counts.where("token <> ''").agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.count("*").alias("v")).first()
    docs = counts.where("token = ''").first()
    b, a, size = sums.b or 0, sums.a or 0, (sums.v or 0) + 1
    share = TOKEN_SHARE if share is None else share
    often = F.col("block") + F.col("allow") >= share * (a + b)
    kept = counts.where((F.col("token") != "") & often).collect()  # at most 1 / share rows
    odds = {r.token: math.log((r.block + 1) / (b + size)) - math.log((r.allow + 1) / (a + size)) for r in kept}
    prior = math.log((docs.block + 1) / (docs.allow + 1)) if docs else 0.0
    rest = counts.where((F.col("token") != "") & ~often).select("token", (
        F.log((F.col("block") + 1) / F.lit(b + size)) - F.log((F.col("allow") + 1) / F.lit(a + size))).alias("odds"))
    return prior, odds, rest if (sums.v or 0) > len(odds) else None


def judge_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", rules=None,
               unwanted: list[str] | None = None, label: str | None = None) -> DataFrame:
    """One row per page: host, path, the longest fitting rule (or null), score (log-odds of block), verdict.

    The rule's verdict counts, else ``block`` for a score above 0. Null URLs and those without ``://`` have empty host and
    path, no rule and no tokens, so the prior decides. Very long URLs are read whole. Repeated rows are judged each. Of equal
    rules the first counts. Other columns aren't read. An empty table gives an empty table.
    """
    bound_batches(pages.sparkSession)
    words = page_words(pages, html_column, url_column)
    prior, odds, rest = fit(pages, url_column, words, unwanted if unwanted is not None else UNWANTED, label)
    shared = pages.sparkSession.sparkContext.broadcast((words, odds))
    whole = rest is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter, odds = Segmenter(*shared.value[0]), shared.value[1]
        for batch in filter(len, batches):
            out = []
            for url in batch["url"]:
                host, path = split_url(url)
                rule, verdict = rule_for(host, path, rules)
                tokens = url_tokens(host, path, segmenter)
                score = prior + sum(odds.get(t, 0.0) for t in tokens)
                row = (host, path, rule, verdict or ("block" if score > 0 else "allow"), score)
                out.append(row if whole else (*row, url, [t for t in tokens if t not in odds]))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "score", "url", "rare"][:5 if whole else 7]).assign(id=batch["id"].to_numpy())

    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"))
    schema = f"id {kind}, host string, path string, rule string, verdict string, score double"
    if whole:
        return rows.mapInPandas(run, schema).withColumnRenamed("id", id_column)
    judged = staged(rows.mapInPandas(run, schema + ", url string, rare array<string>"), "judged")
    # A URL on many pages has frequent tokens only, so neither join has a hot key. Sums in a fixed order.
    rare = judged.where(F.size("rare") > 0)
    more = (rare.select("url", "rare").distinct().select(F.col("url").alias("u"), F.explode("rare").alias("token")).join(rest, "token")
            .groupBy("u").agg(F.aggregate(F.array_sort(F.collect_list("odds")), F.lit(0.0), lambda s, x: s + x).alias("more")))
    summed = rare.join(more, F.col("url") == F.col("u")).withColumn("score", F.col("score") + F.col("more")).withColumn(
        "verdict", F.when(F.col("rule").isNotNull(), F.col("verdict")).when(F.col("score") > 0, "block").otherwise("allow"))
    names = ["id", "host", "path", "rule", "verdict", "score"]
    got = judged.where(F.size("rare") == 0).select(names).unionByName(summed.select(names))
    return got.withColumnRenamed("id", id_column)
