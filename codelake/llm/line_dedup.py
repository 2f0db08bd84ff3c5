"""Line dedup (operator 6), DataFrame functions only: lines that stand on a large share of a site's pages are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

# A line is boilerplate if more than this share of the site's pages has it, and at least so many pages.
RATIO, MIN_PAGES = 0.1, 5
# The table of boilerplate lines is broadcast up to so many lines (24 bytes each); beyond, it is joined by site.
BROADCAST_LINES = 1 << 20
# Pages of one site are dealt to so many joins if the table isn't broadcast.
SALTS = 64


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """Compared form of a line (outer blanks don't count) as 64-bit hash; null for blank lines."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, host: Column, text_column: str, ratio: float, min_pages: int) -> DataFrame:
    """Sites with the hashes of their boilerplate lines: at most (mean lines per page / ratio) for each site."""
    pages = docs.select(host.alias("_host"), F.array_compact(F.array_distinct(F.transform(_lines(text_column), _key))).alias("_keys"))
    # The page itself counts as the line 'null', so one grouped pass gives pages and lines; counts combine before the shuffle.
    marked = F.explode(F.concat(F.array(F.lit(None).cast("long")), "_keys"))
    counts = staged(pages.select("_host", marked.alias("_key")).groupBy("_host", "_key").agg(F.count("*").alias("_n"))
                    .where((F.col("_n") >= min_pages) | F.col("_key").isNull()), "line-counts")
    totals = counts.where("_key IS NULL").select(F.col("_host").alias("_site"), F.col("_n").alias("_pages"))
    lines = counts.where("_key IS NOT NULL").join(totals, F.col("_host").eqNullSafe(F.col("_site")))
    return (lines.where(F.col("_n") > ratio * F.col("_pages")).groupBy("_site").agg(F.collect_list("_key").alias("_drop")))


def drop_boilerplate(docs: DataFrame, host_column: str = "source", text_column: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """All rows and columns, with the text rid of lines that more than ``ratio`` of the site's pages have.

    Lines end at ``\\n`` and are compared without outer blanks; a line counts once for each page. Blank lines are kept.
    Lines of fewer than ``min_pages`` pages are kept, so a site of one or two pages loses nothing. ``_n_lines`` and
    ``_n_dropped`` are added if ``counts``.

    A null text stays null and counts as a page without lines; a text whose every line goes becomes empty. Null hosts
    form one site. Repeated rows are pages of their own. Other columns, whatever their names, pass through unless they are
    ``_site``, ``_drop``, ``_n_lines`` or ``_n_dropped``. An empty table gives an empty table.
    """
    site = F.col(host_column)
    found = staged(boilerplate(docs, site, text_column, ratio, min_pages), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("_drop") + 1), F.lit(0)).alias("n")).first().n
    if size <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(found), site.eqNullSafe(F.col("_site")), "left")
    else:
        # A site with a third of the pages is dealt to SALTS tasks at least.
        dealt = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt_r"))
        salted = docs.withColumn("_salt_l", F.pmod(F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, site.eqNullSafe(F.col("_site")) & (F.col("_salt_l") == F.col("_salt_r")), "left").drop("_salt_l", "_salt_r")
    lines = _lines(text_column)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("_drop", _key(x)), F.lit(False)))
    text = F.when(F.col(text_column).isNull() | F.col("_drop").isNull(), F.col(text_column)).otherwise(F.array_join(kept, "\n"))
    if counts:
        joined = joined.withColumns({"_n_lines": F.when(F.col(text_column).isNull(), 0).otherwise(F.size(lines)),
                                     "_n_dropped": F.when(F.col(text_column).isNull() | F.col("_drop").isNull(), 0)
                                     .otherwise(F.size(lines) - F.size(kept))})
    return joined.withColumn(text_column, text).drop("_site", "_drop")
