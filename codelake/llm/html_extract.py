"""Main text of pages (operator 5) by template deduction: equivalence classes of tokens across the pages of a host.

1. A page is read as structure tokens (paths of elements) and blocks of text. Pages of a host whose longest blocks are the same
   (to nine tenths of the text) have one content and count once, so copies don't look like a template. For each host, a token's
   occurrence vector (how often each content has it) is kept as two sums of content-dependent numbers, so that vectors of any
   length combine in a grouped aggregation; tokens with equal sums share a vector and form an equivalence class.
2. Classes of tokens that stand on most pages of the host are valid if they nest: their paths lie within each other. The class
   with one occurrence on each page is the host's template, the others repeat inside its slots.
3. The slot that holds most of the text that varies from page to page, menus and the like left out, is the main one. Its text
   blocks, without those that belong to the template themselves, are the result. Text in article and main elements is never
   the template's, nor is what makes up most of a page's slot: such passages are shared by articles.

Hosts with few contents have no template of their own; their pages are read by their elements alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bound_batches, utf8

# Elements that don't hold main text, and those that don't end a block.
EXCLUDED = frozenset("nav header footer aside form script style noscript template iframe svg math canvas object button select option "
                     "textarea input label dialog head title menu fieldset audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                            "menu nav ol p pre section table ul li td th tr".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]),
             "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
# Words in class, id or role that mark an element without main text.
MARKS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion banner comment comments commentlist reply replies disqus "
                  "discussion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice "
                  "notices notification alert popup modal overlay newsletter subscribe subscription share sharing social related widget toolbar "
                  "login signup pagination pager skip complementary contentinfo search dialog".split())
CONTAINERS = frozenset(["html", "body", "article", "main"])
# Contents a host needs for a template, share of them that have a template token, share of the varying text that the main
# slot holds, and the share at which a block of text belongs to the template.
MIN_PAGES, ON_PAGES, MAIN_SHARE, FIXED_SHARE = 4, 0.8, 0.6, 0.5
# Share of a page's text that tells its content (the rest may be a date or a counter), and the most of a slot that is template.
CONTENT_SHARE, MOST_FIXED = 0.9, 0.5
# Templates are broadcast up to so many hosts (a few hundred bytes each); beyond, pages are joined by host and part.
BROADCAST_HOSTS, SALTS = 1 << 15, 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_ARTICLE = "/(?:article|main)(?:[./]|$)"
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _name(tag: str, attributes: str) -> tuple[str, bool]:
    """Name of an element in paths (tag and first class) and whether its marks exclude it."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, tag in EXCLUDED
    first, out = "", tag in EXCLUDED
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if key.lower() == "class" and value.split():
            first = "." + re.sub(r"\d+", "0", value.split()[0])
        if tag not in CONTAINERS and key.lower() in ("class", "id", "role"):
            out = out or not MARKS.isdisjoint(_WORDS.findall(_CAMEL.sub(" ", value).lower()))
        elif tag not in CONTAINERS and (key.lower() == "hidden" and not value or key.lower() == "aria-hidden" and value == "true"):
            out = out or key.lower() == "hidden"
        elif tag == "article" and key.lower() == "class" and not {"comment", "reply"}.isdisjoint(_WORDS.findall(value.lower())):
            out = True
    return tag + first, out


def blocks(html: str) -> tuple[Counter, list[tuple[str, str, bool, int]]]:
    """Structure tokens with their counts, and text blocks (path, text, excluded, characters in links) in page order."""
    stack: list[tuple[str, str, bool]] = []  # tag, path, excluded
    tokens: Counter = Counter()
    out, parts, links, in_link, at = [], [], 0, 0, 0

    def flush():
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                path, excluded = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                out.append((path, text, excluded, min(links, len(text))))
        links = 0

    while at < len(html):
        token = _TOKEN.match(html, at)  # always matches, at least one character
        at = token.end()
        cdata, slash, tag, attributes, text = token.groups("")
        if text or cdata:
            parts.append(text or entities.escape(cdata))
            links += len(text) if in_link else 0
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = max(0, in_link + (-1 if slash else 1))
            continue
        flush()
        if slash:
            opened = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if opened is not None:
                del stack[opened:]
                in_link = 0
            continue
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        name, excluded = _name(tag, attributes)
        path = f"{stack[-1][1] if stack else ''}/{name}"
        tokens[path] += 1
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            # Inside a script or the like only its own end tag counts, whatever looks like a tag before it.
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            in_link = 0
            continue
        stack.append((tag, path, excluded or bool(stack) and stack[-1][2]))
    flush()
    return tokens, out


def text_key(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


def content_key(found: list[tuple[str, str, bool, int]]) -> int:
    """Hash of the longest blocks that hold most of a page's text outside links; pages with equal keys have one content."""
    sizes = sorted(((len(text) - links, text) for _, text, excluded, links in found if not excluded), reverse=True)
    total, seen, chosen = sum(n for n, _ in sizes), 0, []
    for n, text in sizes:
        if total and seen >= CONTENT_SHARE * total:
            break
        seen += n
        chosen.append(text)
    return xxhash.xxh3_64_intdigest("\0".join(chosen)) - (1 << 63)


PARTIAL = "host string, kind int, token string, hash long, content long, most long, chars long"


def token_vectors(pages: DataFrame) -> DataFrame:
    """Per host and token: contents, sums for the occurrence vector, most in one, and for blocks the characters outside links.

    Kind 0 is the host itself, 1 a structure token, 2 a block of text (by hash), 3 the text under a path. What pages of one
    content have is put together by the most that any has.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            total: dict = {}

            def add(key, n, chars=0):
                old = total.get(key, (0, 0))
                total[key] = (max(old[0], n), max(old[1], chars))

            for host, html in zip(batch["host"], batch["html"]):
                tokens, found = blocks(html)
                content = content_key(found)
                add((host, 0, "", 0, content), 1)
                for path, n in tokens.items():
                    add((host, 1, path, 0, content), n)
                texts, sizes = Counter(), Counter()
                for path, text, excluded, links in found:
                    if not excluded:
                        texts[path, text] += 1
                        sizes[path] += len(text) - links
                for (path, text), n in texts.items():
                    add((host, 2, path, text_key(path, text), content), n, n * len(text))
                for path, n in sizes.items():
                    add((host, 3, path, 0, content), 1, n)
            yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=[x.split()[0] for x in PARTIAL.split(", ")])

    key = ["host", "kind", "token", "hash"]
    once = pages.mapInPandas(run, PARTIAL).groupBy(*key, "content").agg(F.max("most").alias("most"), F.max("chars").alias("chars"))
    # Two 30-bit numbers of a content; sums over up to 2^33 occurrences fit.
    first, second = F.shiftrightunsigned("content", 34) + 1, F.col("content").bitwiseAND(F.lit(0x3FFFFFFF)) + 1
    return once.groupBy(*key).agg(F.count("*").alias("pages"), F.sum(F.col("most") * first).alias("first"), F.sum(F.col("most") * second).alias("second"),
                                  F.max("most").alias("most"), F.sum("chars").alias("chars"))


def templates(vectors: DataFrame) -> DataFrame:
    """One row per host with enough contents: the main slot's path and the hashes of text blocks of the template.

    Tokens of a host's template are few: each stands in at least half of its contents.
    """
    hosts = vectors.where("kind = 0").select(F.col("host").alias("h"), F.col("pages").alias("n")).where(F.col("n") >= MIN_PAGES)
    known = vectors.where("kind > 0").join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    template_text = (F.col("kind") == 2) & ~F.col("token").rlike(_ARTICLE)
    often = known.where(((F.col("kind") == 1) & (F.col("pages") >= ON_PAGES * F.col("n")))
                        | (template_text & (F.col("pages") >= FIXED_SHARE * F.col("n")) & (F.col("pages") >= 3)))
    # An equivalence class: tokens of one host with equal vectors.
    classes = (often.where("kind = 1").groupBy("host", "first", "second", "n")
               .agg(F.max("most").alias("most"), F.min("pages").alias("pages"), F.collect_list("token").alias("tokens")))
    frames = classes.groupBy("host").agg(F.collect_list(F.struct("most", "pages", "n", "tokens")).alias("classes"))
    fixed = often.where("kind = 2").groupBy("host").agg(F.collect_list("hash").alias("fixed"), F.collect_list(F.struct("token", "chars")).alias("fixed_chars"))
    # Text under each path that is on a fair share of the pages; rare paths can't decide the main slot.
    places = (known.where((F.col("kind") == 3) & (F.col("pages") >= 0.05 * F.col("n"))).groupBy("host")
              .agg(F.collect_list(F.struct("token", "chars")).alias("places")))

    def choose(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples(index=False):
            sizes = Counter({p["token"]: p["chars"] for p in (r.places if r.places is not None else [])})
            for f in r.fixed_chars if r.fixed_chars is not None else []:
                sizes[f["token"]] -= f["chars"]
            slot = main_slot(r.classes, sizes)
            # An article is taken whole, with passages that many of them share; so are pages without a slot.
            out.append((r.host, slot, [] if r.fixed is None or not slot or is_article(slot) else list(r.fixed)))
        return pd.DataFrame(out, columns=["host", "slot", "fixed"])

    def by_host(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("host", "h")

    joined = frames.join(by_host(fixed), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    joined = joined.join(by_host(places), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return joined.mapInPandas(lambda batches: (choose(b) for b in batches if len(b)), "host string, slot string, fixed array<long>")


def _inside(path: str, outer: str) -> bool:
    return path == outer or path.startswith(outer + "/")


def is_article(path: str) -> bool:
    return re.split(r"[./]", path.rsplit("/", 1)[-1])[0] in ("article", "main")


def main_slot(classes, sizes: Counter) -> str:
    """Path of the main slot: the innermost template element that holds most of the varying text; empty if there is none."""
    # Valid classes nest: each token's parent is in a class with at least as many pages.
    ranked = sorted(classes, key=lambda c: (c["most"] > 1, -c["pages"], min(map(len, c["tokens"]))))
    accepted: set[str] = {""}
    single: list[str] = []
    for c in ranked:
        tokens = sorted(c["tokens"], key=len)
        if all(t.rsplit("/", 1)[0] in accepted or t.rsplit("/", 1)[0] in tokens for t in tokens):
            accepted.update(tokens)
            if c["most"] == 1:
                single += tokens
    total = sum(max(n, 0) for n in sizes.values())
    if not total:
        return ""
    within = {t: sum(max(n, 0) for p, n in sizes.items() if _inside(p, t)) for t in single}
    named = [t for t in single if is_article(t) and within[t] >= 0.2 * total]
    good = named or [t for t in single if within[t] >= MAIN_SHARE * total]
    return max(good, key=lambda t: (within[t] if named else 0, len(t), t), default="")


def main_text(html: str, slot: str | None, fixed: frozenset) -> str:
    """Text blocks of the slot, or if the page hasn't that of its article or main element, or of the whole page.

    Only blocks of the slot can be the template's, and if they were most of the slot's text none is.
    """
    found = [b for b in blocks(html)[1] if not b[2]]
    chosen = [b for b in found if slot and _inside(b[0], slot)]
    if not chosen:
        chosen = [b for b in found if re.search(_ARTICLE, b[0])] or found
    elif fixed:
        kept = [b for b in chosen if re.search(_ARTICLE, b[0]) or text_key(b[0], b[1]) not in fixed]
        if sum(len(b[1]) for b in kept) >= (1 - MOST_FIXED) * sum(len(b[1]) for b in chosen):
            chosen = kept
    return " ".join(b[1] for b in chosen)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: ``id_column``, ``url``, ``text`` (empty if none) and ``n_chars``, its code points.

    Null html is empty and gives an empty text. Null URLs share an empty host, as do those without ``://``. Broken markup is
    read as far as it goes: unclosed elements end with their parents, text in unclosed comments and scripts is dropped. Very
    long pages are read whole. Repeated rows give a row each and change no text. Other columns aren't read. An empty table gives an empty one.
    """
    kind, url_kind = pages.schema[id_column].dataType.simpleString(), pages.schema[url_column].dataType.simpleString()
    bound_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), host.alias("host"), html.alias("html"))
    found = staged(templates(staged(token_vectors(rows.select("host", "html")), "token-vectors")), "templates")
    if found.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(found.withColumnRenamed("host", "h")), F.col("host") == F.col("h"), "left")
    else:
        dealt = found.withColumnRenamed("host", "h").withColumn("salt_h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("salt_h")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            sets: dict = {}
            texts = []
            for host, html, slot, fixed in zip(batch["host"], batch["html"], batch["slot"], batch["fixed"]):
                if host not in sets:
                    sets[host] = frozenset(fixed.tolist()) if fixed is not None else frozenset()
                texts.append(main_text(html, slot, sets[host]))
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))})

    got = joined.select("id", "url", "host", "html", "slot", "fixed").mapInPandas(run, f"id {kind}, url {url_kind}, text string, n_chars long")
    return got.withColumnRenamed("id", id_column)
