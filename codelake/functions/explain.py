"""Sentences, labels and distributions that explain a decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import contains_any, percent, strip


def _sentence(template: str, line: Column, text: Column) -> Column:
    """A fixed sentence with the line number and the quoted line start filled in."""
    head, rest = template.split("{n}")
    parts = [F.lit(head), line.cast("string")]
    if "{text}" in rest:
        before, after = rest.split("{text}")
        parts += [F.lit(before), F.substring(text, 1, 60), F.lit(after)]
    else:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def reason_sentence(code: Column, primary_line: Column, cwe: Column, text: Column, line_count: Column) -> Column:
    """One sentence: by CWE, else by keywords of the primary line, else generic.

    ``primary_line`` is the first affected line, null when there is none; ``text`` is that line, stripped.
    """
    low = F.lower(text)
    code_cwe = strip(F.upper(F.coalesce(cwe, F.lit(""))))
    by_cwe = dict(fixed.REASON_BY_CWE)
    say = lambda template: _sentence(template, primary_line, text)
    out = (F.when(code.isNull(), fixed.REASON_OUT_OF_RANGE)
           .when(primary_line.isNull(), fixed.REASON_NO_LINES)
           .when((primary_line > line_count) | (primary_line < 1), fixed.REASON_OUT_OF_RANGE))
    for name, template in fixed.REASON_BY_CWE:
        out = out.when(code_cwe == name, say(template))
    out = (out.when(contains_any(text, ["system(", "popen(", "subprocess"]), say(by_cwe["CWE-78"]))
           .when(contains_any(low, ["select", "execute("]),
                 F.when(contains_any(text, ["+", "%", "format(", 'f"']), say(by_cwe["CWE-89"]))
                 .otherwise(say(fixed.REASON_UNPARAMETERISED)))
           .when(contains_any(text, ["pickle.load", "yaml.load", "marshal.loads"]), say(fixed.REASON_DESERIALIZE_LINE))
           .when(contains_any(text, ["open(", "File("]), say(by_cwe["CWE-22"]))
           .when(contains_any(text, ["api_key", "secret", "password"]), say(by_cwe["CWE-798"]))
           .when(contains_any(low, ["innerhtml", "document.write"]), say(by_cwe["CWE-79"]))
           .when(contains_any(text, ["eval(", "exec("]), say(by_cwe["CWE-94"]))
           .when(contains_any(low, ["md5", "sha1"]) | F.contains(text, F.lit("random.random")), say(by_cwe["CWE-327"])))
    head, tail = fixed.REASON_GENERIC
    before, after = head.split("{n}")
    return out.otherwise(F.concat(F.lit(before), primary_line.cast("string"), F.lit(after),
                                  F.substring(text, 1, 50), F.lit(tail)))


def human_explanation(cwe: Column, cwe_name: Column, severity: Column, reason: Column) -> Column:
    has_cwe = F.coalesce(cwe, F.lit("")) != ""
    has_name = F.coalesce(cwe_name, F.lit("")) != ""
    label = (F.when(has_cwe & has_name, F.concat(cwe, F.lit(" ("), cwe_name, F.lit(")")))
             .when(has_cwe, cwe).otherwise("Security Issue"))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Vulnerability Alert: A "), severity, F.lit("-severity risk corresponding to "), label,
                 F.lit(" was detected.")),
        F.concat(F.lit("Explanation: "), reason), F.lit(fixed.HUMAN_IMPACT), F.lit(fixed.HUMAN_ACTION))


def bounded_probability(p: Column) -> Column:
    """A usable probability: null, NaN and infinities become one half, the rest is clamped to 0..1."""
    bad = p.isNull() | F.isnan(p) | p.isin(float("inf"), float("-inf"))
    return F.when(bad, 0.5).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def probability_distribution(p: Column) -> tuple[Column, Column]:
    """(vulnerable, safe), four decimals."""
    value = bounded_probability(p)
    return F.round(value, 4), F.round(1.0 - value, 4)


def certainty_label(p: Column, vulnerable: Column) -> tuple[Column, Column]:
    """(label, sentence) for the probability of the class that was decided."""
    prob_vulnerable, prob_safe = probability_distribution(p)
    target = F.when(vulnerable, prob_vulnerable).otherwise(prob_safe)
    label = (F.when(target >= 0.90, "Extremely Confident").when(target >= 0.70, "Confident")
             .when(target >= 0.50, "Marginally Confident").otherwise("Low Confidence"))
    action = F.when(vulnerable, "vulnerable risk signatures").otherwise("safe logic structures")
    sentence = F.concat(F.lit("Model is "), label, F.lit(" ("), percent(target), F.lit(") in its decision. "),
                        F.lit("The code demonstrates strong features correlating to "), action, F.lit("."))
    return label, sentence
