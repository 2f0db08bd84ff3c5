"""The corpus queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, line_dedup, merkle, near_dup, packing, quality_classifier, quality_rules, ranked_search, suffix_dedup, token_files, url_filter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query("op4_near_dup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keep")


@query("op5_html_extract")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs})),
pages AS (SELECT source, count(*) AS pages FROM {docs} GROUP BY source),
common AS (
  SELECT source, bare FROM (SELECT DISTINCT doc_id, source, bare FROM lines WHERE bare <> '')
  JOIN pages USING (source) GROUP BY source, bare HAVING count(*) >= 5 AND count(*) > 0.1 * any_value(pages)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.bare) AS n_dropped,
         string_agg(CASE WHEN c.bare IS NULL THEN line END, chr(10) ORDER BY pos) AS text
  FROM lines l LEFT JOIN common c ON l.source = c.source AND l.bare = c.bare GROUP BY l.doc_id)
"""


@query("op6_line_dedup", LINE_SQL.format(docs="documents") + """
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs)
    return out.select("doc_id", out["_n_lines"].cast("long").alias("n_lines"), out["_n_dropped"].cast("long").alias("n_dropped"), "text")


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LEAK_SQL = r"""
WITH words_of AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM {docs}
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') FROM benchmark),
items AS (
  SELECT id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM words_of WHERE kind = 'b' AND len(w) > 0)),
places AS (
  SELECT id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM words_of CROSS JOIN (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(w) >= n)),
found AS (SELECT p.id, p.p, p.n, i.id AS item FROM places p JOIN items i ON p.win = i.win AND p.n = i.n),
hits AS (SELECT id, count(DISTINCT w) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS w FROM found) GROUP BY id),
leaks AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM found) GROUP BY id)
"""


@query("op10_decontamination", LEAK_SQL.format(docs="documents") + """
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words_of w LEFT JOIN hits h ON w.id = h.id LEFT JOIN leaks l ON w.id = l.id WHERE w.kind = 'd'""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op11_exact_dedup", """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"""
RANK_SQL = f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
lengths AS (SELECT doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM lengths),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(t.docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total t GROUP BY term),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * t.docs) // t.length))) AS part
          FROM postings JOIN weights USING (term) JOIN lengths USING (doc_id), total t),
scores AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""


@query("op12_ranked_search", RANK_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(fields: list[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in fields) + ")"


# Unsigned crc32 of a number's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
MERKLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_leaf_sql(_FIELDS)} AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
         CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql([*_FIELDS[:-1], "plain"])} END AS changed
  FROM (SELECT *, replace(text, chr(10), '') AS plain FROM documents)),
low AS (
  SELECT source, 0 AS lvl, idx, leaf AS h, n FROM docs UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY source, lvl, idx // 3),
subroots AS (SELECT source, h, lvl, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM low WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos AS idx, h, m AS n FROM subroots UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3),
climb AS (
  SELECT doc_id, source, leaf, 0 AS lvl, idx, coalesce(changed, leaf) AS h, '' AS proof FROM docs UNION ALL
  SELECT c.doc_id, any_value(c.source), any_value(c.leaf), c.lvl + 1, any_value(c.idx) // 3,
         sha256(string_agg(CASE WHEN l.idx = c.idx THEN c.h ELSE l.h END, '' ORDER BY l.idx)),
         any_value(c.proof) || coalesce(string_agg(CASE WHEN l.idx <> c.idx THEN l.h END, '' ORDER BY l.idx), '')
  FROM climb c JOIN low l ON l.source IS NOT DISTINCT FROM c.source AND l.lvl = c.lvl AND l.idx // 3 = c.idx // 3 WHERE l.n > 1 GROUP BY c.doc_id, c.lvl),
middle AS (
  SELECT c.doc_id, c.leaf, s.h AS subroot, s.pos, c.h, c.proof
  FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source AND s.lvl = c.lvl),
over AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, pos AS idx, h, proof FROM middle UNION ALL
  SELECT c.doc_id, any_value(c.leaf), any_value(c.subroot), c.lvl + 1, any_value(c.idx) // 3,
         sha256(string_agg(CASE WHEN l.idx = c.idx THEN c.h ELSE l.h END, '' ORDER BY l.idx)),
         any_value(c.proof) || coalesce(string_agg(CASE WHEN l.idx <> c.idx THEN l.h END, '' ORDER BY l.idx), '')
  FROM over c JOIN top l ON l.lvl = c.lvl AND l.idx // 3 = c.idx // 3 WHERE l.n > 1 GROUP BY c.doc_id, c.lvl)
SELECT o.doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM over o, (SELECT h, lvl FROM top WHERE n = 1) r WHERE o.lvl = r.lvl"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the crc32 of the id, a text has lost its line ends."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return merkle.manifest(table(spark, sf_dir, "documents"), _FIELDS, tampered)
