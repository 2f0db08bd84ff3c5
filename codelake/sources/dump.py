"""SQL dumps: statements split quote-aware over many tasks, VALUES tuples parsed in the JVM.

A dump is read in records that begin at a line-leading ``INSERT INTO``. Values hold code, so such a line (or a
``;``) may also stand inside a quoted value; then an odd number of quotes precedes it. The parity at the start of
each file block comes from a running sum over one small row per block. Blocks that start outside a value and hold
no odd record, which is nearly all of them, need no shuffle: their records are complete. Only the others are
ordered and glued. No task reads a whole file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import strip
from ..session import staged

# Quoted value, unterminated quoted rest, or unquoted run up to a comma. Possessive, so long values need no stack.
_TOKEN = r"'[^']*+(?:''[^']*+)*+'|'[^']*+(?:''[^']*+)*+\z|[^',]++(?=,|\z)"


def _quotes(col: Column) -> Column:
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit("'"), F.lit("")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_values(values: Column) -> Column:
    """Tokens of a VALUES tuple: quoted ones unescaped, others trimmed, empty unquoted ones left out, NULL as text."""
    def token(raw: Column) -> Column:
        inner = F.replace(F.substring(raw, F.lit(2), F.length(raw)), F.lit("''"), F.lit("'"))
        whole = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
        return (F.when(F.startswith(raw, F.lit("'")) & (_quotes(raw) % 2 == 0), whole)
                .when(F.startswith(raw, F.lit("'")), F.nullif(strip(inner), F.lit("")))
                .otherwise(F.nullif(strip(raw), F.lit(""))))
    raw = F.regexp_extract_all(values, F.lit(_TOKEN), F.lit(0))
    return F.filter(F.transform(raw, token), lambda t: t.isNotNull())


def file_change_fields(statement: Column) -> Column:
    """First three quoted values and the third-last value of a file-change INSERT.

    Null when the statement has no tuple or fewer than three quoted values. A ``NULL`` language is ''.
    """
    def fields(body: Column) -> Column:
        quoted = F.transform(F.slice(F.filter(
            F.regexp_extract_all(body, F.lit(r"'[^']*+(?:''[^']*+)*+'|[^']++"), F.lit(0)),
            lambda t: F.startswith(t, F.lit("'"))), 1, 3),
            lambda t: F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'")))
        tail = F.substring_index(F.substring_index(body, ",", -3), ",", 1)
        enough = F.length(body) - F.length(F.replace(body, F.lit(","), F.lit(""))) >= 2
        language = F.when(enough, F.nullif(F.btrim(strip(tail), F.lit("'")), F.lit("NULL")))
        return _let(quoted, lambda t: F.when(F.size(t) == 3, F.struct(
            F.get(t, F.lit(0)).alias("file_change_id"), F.get(t, F.lit(1)).alias("hash"), F.get(t, F.lit(2)).alias("filename"),
            F.coalesce(language, F.lit("")).alias("programming_language"))))
    return _let(F.regexp_extract(statement, r"(?s)VALUES[^(]*+\((.*)\)", 1), fields)


_START = "INSERT INTO "
# Whole comments and quoted values to the end of the text; it doesn't match if a value is still open. Read in place, nothing is copied.
_CLOSED = r"(?:[^'/\-]++|'[^']*+'|--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|[/\-])*+\z"
# A command up to the first ``;`` outside quotes and comments.
_COMMAND = r"(?:--[^\n]*+|(?s:/\*.*?(?:\*/|\z))|'[^']*+(?:'|\z)|[^';/\-]++|[/\-])++(?:;|\z)"
# The rest of a record that is one command without comments.
_SINGLE = r"\A[^\s'/;\-][^'/;\-]*+(?:(?:'[^']*+'|-(?!-)|/(?!\*))[^'/;\-]*+)*+;\z"
_COMMENTS = r"^(?:\s++|--[^\n]*+|(?s:/\*.*?(?:\*/|\z)))++"
_FILE_BLOCK = ["file", "block"]


def _open_after(text: Column, inside: bool = False) -> Column:
    """1 if a quoted value is open at the end of a text that starts outside of one, or ``inside`` one.

    Quotes in comments don't count. Most texts hold no comment mark at all: then the number of quotes decides.
    """
    # A text that starts inside a value goes up to a quote first.
    read = (~F.rlike(text, F.lit(r"\A" + ("[^']*+'" if inside else "") + _CLOSED))).cast("int")
    return F.when(F.contains(text, F.lit("--")) | F.contains(text, F.lit("/*")), read).otherwise((_quotes(text) + int(inside)) % 2)


def _state_before(keys: list[str], order: str, start: Column) -> tuple[Column, Column]:
    """Whether a value is open before each row, from what the rows before do to the state.

    A row keeps the state, swaps it (out 1, in 0) or sets it (out = in). So the state is that of the last row that sets it
    (else ``start``), swapped as often as rows have swapped it since.
    """
    to_here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum(F.when((F.col("out") == 1) & (F.col("in") == 0), 1).otherwise(0)).over(to_here)
    # Swaps up to the current row, and what a setting row adds: its own count and value.
    sets = F.col("out") == F.col("in")
    last = F.last(F.when(sets, F.col("out")), ignorenulls=True).over(before)
    at_last = F.last(F.when(sets, F.col("_swaps")), ignorenulls=True).over(before)
    since = F.coalesce(F.last("_swaps").over(before), F.lit(0)) - F.coalesce(at_last, F.lit(0))
    return swaps, (F.coalesce(last, start) + since) % 2


def _with_state(rows: DataFrame, keys: list[str], order: str, start: Column, name: str) -> DataFrame:
    swaps, state = _state_before(keys, order, start)
    return rows.withColumn("_swaps", swaps).withColumn(name, state).drop("_swaps")


def _block_states(records: DataFrame) -> DataFrame:
    """Blocks that start inside a value or hold a record that ends inside one, with ``carry``, the state at their start."""
    # What a block does as a whole: its few records that don't keep the state, folded in order.
    odd = F.sort_array(F.collect_list(F.when((F.col("out") != 0) | (F.col("in") != 1), F.struct("pos", "out", "in"))))
    fold = F.aggregate(odd, F.struct(F.lit(0).alias("out"), F.lit(1).alias("in")), lambda acc, r: F.struct(
        F.when(acc["out"] == 0, r["out"]).otherwise(r["in"]).alias("out"), F.when(acc["in"] == 0, r["out"]).otherwise(r["in"]).alias("in")))
    blocks = records.groupBy(*_FILE_BLOCK).agg(F.max("out").alias("opens"), fold.alias("f"))
    placed = _with_state(blocks.select(*_FILE_BLOCK, "opens", "f.*"), ["file"], "block", F.lit(0), "carry")
    return placed.where("carry = 1 OR opens = 1").select(*_FILE_BLOCK, "carry")


def _glued(records: DataFrame, broken: DataFrame) -> DataFrame:
    """Records of the blocks where a value crosses a record start, put together again.

    Windows run inside one block; what earlier blocks contribute comes from one row per block.
    """
    inside = Window.partitionBy(*_FILE_BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_state(records.join(broken, _FILE_BLOCK), _FILE_BLOCK, "pos", F.col("carry"), "open")
    # Read twice below: once for the blocks' counts.
    marked = staged(placed.withColumn("seq", F.sum(1 - F.col("open")).over(inside)).select(*_FILE_BLOCK, "pos", "seq", "value"), "dump-records")
    # Records before the first start of a block continue the last command of an earlier block.
    bases = marked.groupBy(*_FILE_BLOCK).agg(F.max("seq").alias("_n")).select(
        *_FILE_BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("base"))
    numbered = marked.join(bases, _FILE_BLOCK).withColumn("command", F.col("base") + F.col("seq"))
    # One command per group, never an open-ended one.
    return numbered.groupBy("file", "command").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "pos", "value"))), lambda r: r["value"]), "\n" + _START).alias("value"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(table, statement) for every INSERT of the dump, whatever its values and comments contain.

    A file that ends inside a value (cut off, say) gives the rest from there as one statement, which an import then finds
    bad and keeps; other files aren't concerned. A compressed file is one block.
    """
    value = F.col("value")
    records = spark.read.option("lineSep", "\n" + _START).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value", _open_after(value).alias("out"),
        _open_after(value, inside=True).alias("in"))
    broken = staged(_block_states(records), "dump-broken-blocks")
    whole = records.join(broken, _FILE_BLOCK, "left_anti").select("value")
    chunks = whole.unionByName(_glued(records, broken).select("value"))
    # The start of a file is a preamble or keeps its own INSERT; a preamble gives a table name that is not listed.
    bare = F.regexp_replace("value", _COMMENTS, "")
    text = F.when(F.startswith(bare, F.lit(_START)), bare).otherwise(F.concat(F.lit(_START), "value"))
    table = lambda s: F.replace(F.regexp_extract(s, r"^INSERT INTO\s+(\S+?)\s*(?:VALUES\b|\(|\s)", 1), F.lit('"'), F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(_COMMAND), F.lit(0)), lambda s: strip(F.regexp_replace(s, _COMMENTS, "")))
    commands = F.transform(F.filter(found, lambda s: F.startswith(s, F.lit("INSERT INTO"))), lambda s: F.struct(s.alias("statement"), table(s).alias("table")))
    # Nearly all records are one command of a plainly named table. Each is read once: generated columns aren't copied into filters.
    name = F.substring_index("value", " ", 1)
    named = F.rlike(name, F.lit(r'\A"?\w++"?\z')) & (name != "INSERT") & ~F.contains(name, F.lit("VALUES"))
    marks = F.contains(value, F.lit("--")) | F.contains(value, F.lit("/*"))
    one = F.array(F.struct(F.concat(F.lit(_START), "value").alias("statement"), F.replace(name, F.lit('"'), F.lit("")).alias("table")))
    lone = ~marks & (F.octet_length(F.substring_index("value", ";", 1)) == F.octet_length(value) - 1)
    return chunks.select(F.inline(F.when(named & (lone | F.rlike(value, F.lit(_SINGLE))), one).otherwise(commands)))


def allowed_only(statements: DataFrame, tables: list[str] = fixed.DUMP_TABLES) -> DataFrame:
    return statements.where(F.col("table").isin(tables))


def statement_values(statement: Column) -> Column:
    """Text inside the outer parentheses of the VALUES clause."""
    return F.regexp_extract(statement, r"(?s)VALUES\s*\((.*)\)\s*;?\s*\z", 1)


def ingest(spark: SparkSession, path: str, widths: dict[str, int]) -> DataFrame:
    """Rows of a dump: ``table``, ``good``, ``tokens`` and, for bad rows only, the ``statement`` text.

    A row is bad when its number of values differs from the table's ``widths`` entry; of a table without entry any number
    is good. ``file_change`` rows are cut to the four fields that are used while they are read. Written partitioned by
    ``good`` and ``table``, one pass gives all tables and the quarantine.
    """
    width = F.coalesce(*[F.when(F.col("table") == t, n) for t, n in widths.items()], F.size("tokens"))
    kept = _let(file_change_fields(F.col("statement")), lambda change: F.array(
        *[change[c] for c in ("file_change_id", "hash", "filename", "programming_language")]))
    parsed = (allowed_only(read_statements(spark, path))
              .withColumn("tokens", parse_values(statement_values(F.col("statement"))))
              .withColumn("good", F.coalesce(F.size("tokens") == width, F.lit(False)) & (F.size("tokens") > 0))
              .withColumn("tokens", F.when(F.col("table") == "file_change", kept).otherwise(F.col("tokens"))))
    return parsed.select("table", "good", F.when(F.col("good"), F.col("tokens")).alias("tokens"),
                         F.when(~F.col("good"), F.col("statement")).alias("statement"))


def typed(rows: DataFrame, table: str, schema: str) -> DataFrame:
    """Good rows of one table with named and typed columns (``name type, ...`` in the order of the values).

    The text ``NULL`` is null, and so is what doesn't read as its type.
    """
    fields = [f.split() for f in schema.split(", ")]
    tokens = rows.where(F.col("good") & (F.col("table") == table))
    return tokens.select(*[F.nullif(F.get("tokens", F.lit(i)), F.lit("NULL")).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])


def quote_literal(col: Column) -> Column:
    """A value as SQL text; null becomes NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(col.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def insert_text(table: str, *values: Column) -> Column:
    return F.concat(F.lit(f'INSERT INTO "{table}" VALUES('), F.concat_ws(",", *values), F.lit(");"))
