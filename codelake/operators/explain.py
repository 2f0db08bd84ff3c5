"""Attention weights mapped to source lines, heat maps and affected lines.

``attention`` has one row per snippet, head and token with character offsets and a weight. A snippet's tokens are bounded by
the model's input length, so they are gathered once, as one array per snippet; lines, sums and ranks are then looked up inside
the row, and the code is neither joined to tokens nor moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.explain import human_explanation, probability_distribution, reason_sentence
from ..functions.text import code_lines, strip
from .rank import top_per_group
from .settle import settle

TOKEN_KEYS = ["token_idx", "token", "tok_start", "tok_end"]
# Weights are kept as whole ten-billionths, so sums, ranks and rounding do not depend on the order of addition.
UNIT = 10 ** 10
# Lines of code that is short.
SHORT = 16


def snippet_tokens(attention: DataFrame, shape: bool = False) -> DataFrame:
    """One row per snippet with its ``tokens`` in order: the keys and ``units``, the share of the mean over heads.

    Rows are dealt by snippet once; means and lists are made where they then lie. ``shape`` adds ``heads`` and ``length``.
    """
    mean = attention.repartition("snippet_id").groupBy("snippet_id", *TOKEN_KEYS).agg(F.avg("weight").alias("_mean"), F.max("head").alias("_head"))
    sizes = [(F.max("_head") + 1).alias("heads"), (F.max("token_idx") + 1).alias("length")] if shape else []
    lists = mean.groupBy("snippet_id").agg(F.array_sort(F.collect_list(F.struct(*TOKEN_KEYS, "_mean"))).alias("_tokens"), *sizes)
    total = F.aggregate("_tokens", F.lit(0.0), lambda acc, t: acc + t["_mean"])
    share = lambda t: F.when(F.col("_total") > 0, t["_mean"] / F.col("_total")).otherwise(t["_mean"])
    tokens = F.transform("_tokens", lambda t: F.struct(*[t[k].alias(k) for k in TOKEN_KEYS], F.round(share(t) * UNIT).cast("bigint").alias("units")))
    return settle(lists.withColumn("_total", total), ["_total"]).select(
        "snippet_id", tokens.alias("tokens"), *(["heads", "length"] if shape else []))


def cls_attention(attention: DataFrame) -> DataFrame:
    """One row per token: the mean over heads, scaled so that a snippet's weights add up to one."""
    return snippet_tokens(attention).select("snippet_id", F.inline("tokens")).withColumn("weight", F.col("units") / UNIT)


def with_lines(df: DataFrame, tokens: DataFrame, code: str = "code") -> DataFrame:
    """``df`` (one row per snippet) with ``lines``, the texts, and ``placed``: tokens with the line that holds their start.

    A line owns its line end. Tokens that start outside the text count to line 1; padding (offsets 0, 0 after the first token) is
    left out.
    """
    real = F.filter("tokens", lambda t: ~((t["tok_start"] == 0) & (t["tok_end"] == 0) & (t["token_idx"] > 0)))
    none = F.array().cast(tokens.schema["tokens"].dataType)
    # Its size is estimated from what is read, which holds neither heads nor tokens; it must not be broadcast for that.
    cut = df.join(tokens.hint("merge"), "snippet_id", "left").withColumns({"lines": code_lines(F.col(code)), "_real": F.coalesce(real, none)}).drop("tokens")
    cut = settle(cut, ["lines", "_real"])
    # Line starts up to the last token: a line takes one character at least.
    reach = F.coalesce(F.array_max(F.transform("_real", lambda t: t["tok_start"].cast("int"))), F.lit(-1)) + 1
    some = F.slice("lines", F.lit(1), F.least(F.size("lines"), F.greatest(reach, F.lit(0))))
    starts = F.aggregate(some, F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at")), lambda acc, line: F.struct(
        F.concat(acc["starts"], F.array(acc["at"])).alias("starts"), (acc["at"] + F.length(line) + 1).alias("at")))["starts"]
    end = F.aggregate("lines", F.lit(-1), lambda acc, line: acc + F.length(line) + 1)
    cut = settle(cut.withColumns({"_starts": starts, "_end": end}), ["_starts", "_end"])

    def line(t: Column) -> Column:
        at = t["tok_start"]
        return F.when((at < 0) | (at > F.col("_end")), 1).otherwise(F.size(F.filter("_starts", lambda s: s <= at)))

    placed = F.transform("_real", lambda t: F.struct(t["token_idx"].alias("token_idx"), line(t).alias("line_number"), t["units"].alias("units")))
    return settle(cut.withColumn("placed", placed), ["placed"]).drop("_real", "_starts", "_end")


def with_line_units(df: DataFrame, tokens: DataFrame, code: str = "code") -> DataFrame:
    """``df`` with ``lines`` and ``line_units``, the weight of each line, zero for lines without tokens."""
    placed = with_lines(df, tokens, code)
    zero = F.lit(0).cast("bigint")
    # Short code is summed line by line; for long code lines and tokens would multiply, so the sums of lines with tokens are looked up.
    short = F.size("lines") <= SHORT
    own = F.transform("lines", lambda _, i: F.aggregate("placed", zero, lambda acc, p: F.when(p["line_number"] == i + 1, acc + p["units"]).otherwise(acc)))
    held = F.array_distinct(F.transform("placed", lambda p: p["line_number"]))
    total = lambda n: F.aggregate(F.filter("placed", lambda p: p["line_number"] == n), zero, lambda acc, p: acc + p["units"])
    sums = F.when(~short, F.map_from_entries(F.transform(held, lambda n: F.struct(n, total(n)))))
    summed = settle(placed.withColumn("_sums", sums), ["_sums"])
    units = F.when(short, own).otherwise(F.transform("lines", lambda _, i: F.coalesce(F.try_element_at("_sums", i + 1), zero)))
    return settle(summed.withColumn("line_units", units), ["line_units"]).drop("placed", "_sums")


def line_offsets(snippets: DataFrame, key: str = "snippet_id", code: str = "code") -> DataFrame:
    """Start and end offset of every line."""
    lines = snippets.select(key, F.posexplode(code_lines(F.col(code))).alias("pos", "line_text"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line_text") + 1).over(before), F.lit(0))
    return (lines.withColumn("line_start", start)
            .select(key, (F.col("pos") + 1).alias("line_number"), "line_start",
                    (F.col("line_start") + F.length("line_text")).alias("line_end")))


def token_lines(attention: DataFrame, snippets: DataFrame) -> DataFrame:
    """Line of each token; padding tokens are left out."""
    return with_lines(snippets.select("snippet_id", "code"), snippet_tokens(attention)).select("snippet_id", F.inline("placed"))


def line_attention(attention: DataFrame, snippets: DataFrame) -> DataFrame:
    """Weight per line, with a zero for lines without tokens."""
    scored = with_line_units(snippets.select("snippet_id", "code"), snippet_tokens(attention))
    return (scored.select("snippet_id", F.posexplode("line_units").alias("_pos", "units"))
            .select("snippet_id", (F.col("_pos") + 1).alias("line_number"), "units", (F.col("units") / UNIT).alias("score")))


def with_top_lines(pred: DataFrame, tokens: DataFrame, threshold: float = 0.15) -> DataFrame:
    """``pred`` with ``top_lines``, numbers and units of its affected lines, and ``first_line`` and ``last_line``.

    Affected are the lines above the threshold that aren't trivial, else the best two; none below confidence 0.5.
    """
    scored = with_line_units(pred, tokens)
    ranked = F.transform(F.array_sort(F.transform("line_units", lambda u, i: F.struct((-u).alias("low"), (i + 1).alias("line_number")))),
                         lambda x: F.struct(x["line_number"].alias("line_number"), (-x["low"]).alias("units")))
    scored = settle(scored.withColumn("_ranked", F.when(F.col("confidence") >= 0.5, ranked)), ["_ranked"])
    solid = lambda x: F.length(strip(F.get("lines", x["line_number"] - 1))) > 1
    strong = F.filter("_ranked", lambda x: (x["units"] > round(threshold * UNIT)) & solid(x))
    scored = settle(scored.withColumns({"_strong": strong, "_best": F.filter(F.slice("_ranked", 1, 2), solid)}), ["_strong", "_best"])
    top = F.coalesce(F.when(F.size("_strong") > 0, F.col("_strong")).otherwise(F.col("_best")), F.array().cast("array<struct<line_number:int,units:bigint>>"))
    scored = settle(scored.withColumn("top_lines", top), ["top_lines"]).drop("_ranked", "_strong", "_best", "lines", "line_units")
    numbers = F.transform("top_lines", lambda x: x["line_number"])
    return scored.withColumns({"first_line": F.array_min(numbers), "last_line": F.array_max(numbers)})


def top_lines(attention: DataFrame, pred: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Affected lines of each snippet, one row each."""
    found = with_top_lines(pred.select("snippet_id", "code", "confidence"), snippet_tokens(attention), threshold)
    return found.select("snippet_id", F.inline("top_lines")).select("snippet_id", "line_number", (F.col("units") / UNIT).alias("score"))


def with_reason(df: DataFrame, code: str = "code", line: str = "first_line", cwe: str = "predicted_cwe") -> DataFrame:
    """``reason`` sentence of each row; the lines of the code are split once."""
    lines = code_lines(F.col(code))
    cut = df.withColumn("_lines", lines).withColumns({
        "_line_text": strip(F.get("_lines", F.col(line) - 1)), "_line_count": F.size("_lines")}).drop("_lines")
    read = settle(cut, ["_line_text", "_line_count"])
    return read.withColumn("reason", reason_sentence(
        F.col(code), F.col(line), F.col(cwe), F.col("_line_text"), F.col("_line_count"))).drop("_line_text", "_line_count")


def highlighted(k: int = 15) -> tuple[Column, Column]:
    """The largest weight of a row's ``tokens``, to be named ``_peak``, and the ``k`` heaviest tokens without special ones, as in
    ``heatmap``: (token, weight, importance)."""
    most = F.array_max(F.transform("tokens", lambda t: t["units"]))
    peak = F.when(most == 0, F.lit(UNIT).cast("bigint")).otherwise(most)
    half_up = lambda t: (t["units"] * 20000 + F.col("_peak") - F.pmod(t["units"] * 20000 + F.col("_peak"), 2 * F.col("_peak"))) / (2 * F.col("_peak"))
    plain = F.filter("tokens", lambda t: ~t["token"].isin(fixed.SPECIAL_TOKENS))
    rows = F.transform(plain, lambda t: F.struct(
        (-F.floor((t["units"] + UNIT // 200000) / (UNIT // 100000))).alias("low"), t["token_idx"].alias("at"), t["token"].alias("token"),
        (half_up(t) / 10000).alias("importance")))
    return peak, F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: F.struct(
        x["token"].alias("token"), (-x["low"] / 100000).alias("weight"), x["importance"].alias("importance")))


def with_explanation(pred: DataFrame, attention: DataFrame) -> DataFrame:
    """Predictions with the nested record ``explanation``.

    Vulnerable rows have affected lines, the reason, the heaviest tokens, the attention's shape, a readable text and the
    probabilities. Safe rows and rows without code have the reason and empty lists.
    """
    peak, top = highlighted()
    tokens = snippet_tokens(attention, shape=True).withColumn("_peak", peak).withColumn("_tokens", top).drop("_peak")
    found = with_reason(with_top_lines(pred, tokens))
    bad, safe = probability_distribution(F.col("confidence"))
    on = lambda value: F.when(F.col("vulnerable"), value)
    lines = F.coalesce(on(F.array_sort(F.transform("top_lines", lambda x: x["line_number"]))), F.array().cast("array<int>"))
    weights = F.map_from_entries(F.transform("top_lines", lambda x: F.struct(x["line_number"].cast("string"), x["units"] / UNIT)))
    shape = F.struct(F.when(F.col("heads").isNull(), 0).otherwise(1).alias("num_layers"), F.coalesce("heads", F.lit(0)).alias("num_heads"),
                     F.coalesce("length", F.lit(0)).alias("sequence_length"),
                     F.coalesce(F.concat_ws("x", F.when(F.col("heads").isNotNull(), "1"), "heads", "length", "length"), F.lit("")).alias("dimension"))
    record = F.struct(
        F.col("confidence"), F.col("file_path").alias("affected_file"), F.col("function_name").alias("affected_function"), lines.alias("affected_lines"),
        on(weights).alias("attention_weights"), F.when(F.col("vulnerable"), F.col("reason")).otherwise(F.col("safe_reason")).alias("reason"),
        F.coalesce(on(F.col("_tokens")), F.array().cast("array<struct<token:string,weight:double,importance:double>>")).alias("highlighted_tokens"),
        on(shape).alias("attention_shape"), on(human_explanation(F.col("predicted_cwe"), F.col("cwe_name"), F.col("severity"), F.col("reason"))).alias("readable"),
        F.struct(bad.alias("vulnerable"), safe.alias("safe")).alias("probability_distribution"))
    return found.withColumn("explanation", record).drop("heads", "length", "_tokens", "top_lines", "first_line", "last_line", "reason")


def heatmap(cls: DataFrame) -> DataFrame:
    """Weights relative to the snippet's largest; special tokens leave after the maximum is taken."""
    peak = F.max("units").over(Window.partitionBy("snippet_id"))
    return (cls.withColumn("_peak", peak)
            .withColumn("_peak", F.when(F.col("_peak") == 0, UNIT).otherwise(F.col("_peak")))
            .where(~F.col("token").isin(fixed.SPECIAL_TOKENS))
            .select("snippet_id", "token_idx", "token",
                    (F.floor((F.col("units") + UNIT // 200000) / (UNIT // 100000)) / 100000).alias("weight"),
                    (F.expr("(units * 20000 + _peak) div (2 * _peak)") / 10000).alias("importance"),
                    "tok_start", "tok_end"))


def top_tokens(cls: DataFrame, k: int = 15) -> DataFrame:
    return top_per_group(heatmap(cls), ["snippet_id"], [F.desc("weight"), F.asc("token_idx")], k)


def attention_shape(attention: DataFrame) -> DataFrame:
    """Layers x heads x length x length per snippet; one layer unless the table has a ``layer`` column."""
    layers = F.count_distinct("layer") if "layer" in attention.columns else F.lit(1).cast("bigint")
    return (attention.groupBy("snippet_id")
            .agg(layers.alias("num_layers"), (F.max("head") + 1).cast("bigint").alias("num_heads"),
                 (F.max("token_idx") + 1).cast("bigint").alias("sequence_length"))
            .withColumn("dimension", F.concat_ws("x", "num_layers", "num_heads", "sequence_length", "sequence_length")))


def shape_or_zero(snippets: DataFrame, attention: DataFrame) -> DataFrame:
    """Shape of every snippet, zeros when it has no attention rows."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (snippets.select("snippet_id").join(attention_shape(attention), "snippet_id", "left")
            .select("snippet_id", zero("num_layers"), zero("num_heads"), zero("sequence_length"),
                    F.coalesce("dimension", F.lit("0x0x0x0")).alias("dimension")))
