"""Text expressions with Python string semantics, all evaluated in the JVM.

``\\s``, ``\\w`` and ``\\b`` in regular expressions are ASCII here and Unicode in Python; results differ
only for such characters outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

# The characters Python's str.strip() removes.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
_LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def contains_any(col: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(col, F.lit(word))
    return hit


def code_lines(code: Column) -> Column:
    """Lines of a text as ``splitlines`` gives them: every line end counts, no empty last line."""
    unified = F.regexp_replace(code, _LINE_ENDS, "\n")
    parts = F.split(unified, "\n", -1)
    return (F.when(code.isNull() | (code == ""), F.array().cast("array<string>"))
            .when(F.endswith(unified, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


def clean_code(code: Column) -> Column:
    return F.coalesce(strip(code), F.lit(""))


def fill_language(language: Column) -> Column:
    return strip(F.coalesce(language, F.lit("")))


def advanced_clean(code: Column, language: Column) -> Column:
    """Docstrings and comments removed by language, newlines unified, blank runs collapsed, stripped."""
    lang = F.lower(language)
    no_py = F.regexp_replace(F.regexp_replace(code, "(?s)\"\"\".*?\"\"\"|'''.*?'''", ""), "(?d)#.*", "")
    after_py = F.when(lang.isin("python", ""), no_py).otherwise(code)
    no_c = F.regexp_replace(F.regexp_replace(after_py, r"(?s)/\*.*?\*/", ""), "(?d)//.*", "")
    after_c = F.when(lang != "python", no_c).otherwise(after_py)
    unified = F.regexp_replace(after_c, "\r\n?", "\n")
    collapsed = F.regexp_replace(unified, "\n{3,}", "\n\n")
    return F.when(is_blank(code), "").otherwise(strip(collapsed))


def language_token(language: Column) -> Column:
    token = F.lit(fixed.UNKNOWN_TOKEN)
    for name, text in reversed(fixed.LANGUAGE_TOKENS):
        token = F.when(language == name, text).otherwise(token)
    return token


def inject_language_token(code: Column, language: Column) -> Column:
    return F.concat(language_token(language), F.lit(" "), code)


def label_from_flag(flag: Column) -> Column:
    return F.when(F.lower(strip(flag.cast("string"))).isin("true", "1"), 1).otherwise(0)


def path_extension(path: Column) -> Column:
    """Lower-cased suffix of the file name without the dot; '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def path_excluded(path: Column) -> Column:
    """True when a directory of the path is hidden or an environment directory."""
    folders = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    return F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(fixed.SKIPPED_DIRS))


def repo_name_from_url(url: Column) -> Column:
    bare = F.replace(F.replace(url, F.lit("https://github.com/"), F.lit("")), F.lit(".git"), F.lit(""))
    return F.regexp_replace(bare, "/$", "")


def percent(col: Column) -> Column:
    """A fraction as ``12.34%``."""
    return F.format_string("%.2f%%", F.round(col * 100, 2))
