"""Per-row Python helpers for text that needs a real parser: syntax trees, brace matching, diffs.

They run in Arrow batches inside tasks; one call sees one text.
"""

from __future__ import annotations

import ast
import difflib
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

_HEADER = re.compile(fixed.BRACE_HEADER)
_BRACES = re.compile(r"[{}]")
# Lines with their ends, as Python's parser counts them.
_LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def _segment(lines: list[str], node: ast.AST) -> str:
    """``ast.get_source_segment`` on lines that are split once for a text, not again for each node."""
    own = lines[node.lineno - 1:node.end_lineno]
    own[-1] = own[-1].encode()[:node.end_col_offset].decode()
    own[0] = own[0].encode()[node.col_offset:].decode()
    return "".join(own)


def _statements(tree: ast.Module):
    """Statements and their clauses in the order of ``ast.walk``; expressions, which hold no definition, are left out."""
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        yield node
        for name in ("body", "handlers", "orelse", "finalbody", "cases"):
            todo.extend(getattr(node, name, ()))


def python_functions(code: str | None) -> list[tuple[str, str, int]]:
    """(name, source, line) of every function, outer levels first; [] when the text does not parse."""
    try:
        tree = ast.parse(code or "")
        lines = _LINES.findall(code or "")
        found = [(n.name, _segment(lines, n), n.lineno)
                 for n in _statements(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    except Exception:
        return []
    return [f for f in found if f[1]]


def brace_functions(code: str | None) -> list[tuple[str, str, int]]:
    """(name, source, line) of functions found by header and matching braces; unbalanced ones drop out.

    Matching ends come from one pass with a stack, so deeply nested code stays linear.
    """
    code = code or ""
    closing, stack = {}, []
    for m in _BRACES.finditer(code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            closing[stack.pop()] = m.end()
    out, line, seen = [], 1, 0
    for m in _HEADER.finditer(code):
        line += code.count("\n", seen, m.start())
        seen = m.start()
        end = closing.get(m.end() - 1)
        if m.group(1) not in fixed.BRACE_KEYWORDS and end is not None:
            out.append((m.group(1), code[m.start():end], line))
    return out


def _text_of(node: ast.AST) -> str:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""


def _has_word(text: str, words: list[str]) -> bool:
    low = text.lower()
    return any(w in low for w in words)


def _node_findings(node: ast.AST):
    """(record, column width) pairs a single syntax node gives rise to."""
    match node:
        case ast.Assign(targets=targets, value=value):
            secret = _text_of(value)
            names = [t.id for t in targets if isinstance(t, ast.Name) and _has_word(t.id, fixed.SECRET_NAMES)]
            if len(secret) >= 8:
                yield from ((fixed.AST_SECRET, len(name) + len(secret) + 3) for name in names)
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            if _has_word(_text_of(left), fixed.SQL_KEYWORDS) or _has_word(_text_of(right), fixed.SQL_KEYWORDS):
                yield fixed.AST_SQL_CONCAT, 40
        case ast.JoinedStr(values=values):
            if (any(isinstance(v, ast.FormattedValue) for v in values)
                    and any(_has_word(_text_of(v), fixed.SQL_KEYWORDS) for v in values)):
                yield fixed.AST_SQL_FSTRING, 50


def ast_findings(code: str | None) -> list[tuple]:
    """Syntax-tree findings in depth-first order; [] when the text does not parse."""
    try:
        tree = ast.parse(code or "")
    except Exception:
        return []
    lines, out, todo = (code or "").splitlines(), [], [tree]
    while todo:
        node = todo.pop()
        for (rule, category, severity, message, cwe, owasp, advice, impact), width in _node_findings(node):
            text = lines[node.lineno - 1] if node.lineno <= len(lines) else ""
            out.append((rule, category, severity, node.lineno, node.col_offset, node.col_offset + width,
                        text.strip()[:120], message, cwe, owasp, advice, impact))
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return out


def unified_diff(original: str | None, patched: str | None) -> str:
    return "".join(difflib.unified_diff(
        (original or "").splitlines(keepends=True), (patched or "").splitlines(keepends=True),
        fromfile="vulnerable_function.py", tofile="secured_function.py", n=3))


def _rows(**fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in fields.items()]))


# Bytes of file text in one batch for Python.
FILE_BATCH_BYTES = 16 << 20
_S, _I = T.StringType(), T.IntegerType()
FUNCTION_TYPE = _rows(name=_S, source=_S, line_number=_I)
AST_TYPE = _rows(rule_id=_S, category=_S, severity=_S, line_number=_I, column_start=_I, column_end=_I, snippet=_S, message=_S,
                 cwe=_S, owasp=_S, remediation=_S, business_impact=T.DoubleType())


@F.pandas_udf(FUNCTION_TYPE)
def python_functions_udf(code: pd.Series) -> pd.Series:
    return code.map(python_functions)


@F.pandas_udf(FUNCTION_TYPE)
def brace_functions_udf(code: pd.Series) -> pd.Series:
    return code.map(brace_functions)


@F.pandas_udf(FUNCTION_TYPE)
def source_functions_udf(code: pd.Series, language: pd.Series) -> pd.Series:
    """Syntax tree for Python with the brace form as fallback, brace form for the rest."""
    return pd.Series([(python_functions(c) if lang == "Python" else []) or brace_functions(c)
                      for c, lang in zip(code, language)])


@F.pandas_udf(AST_TYPE)
def ast_findings_udf(code: pd.Series) -> pd.Series:
    return code.map(ast_findings)


@F.pandas_udf(_S)
def unified_diff_udf(original: pd.Series, patched: pd.Series) -> pd.Series:
    return pd.Series([unified_diff(a, b) for a, b in zip(original, patched)])


def explode_functions(files: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """One row per function of each file with its place in it; the file text itself is dropped.

    Whole files cross into Python, so the batches are bounded by bytes.
    """
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(FILE_BATCH_BYTES))
    return (files.select("*", F.posexplode(source_functions_udf(F.col(code), F.col(language))).alias("function_place", "_f"))
            .withColumns({"function_name": F.col("_f.name"), "source": F.col("_f.source"),
                          "line_number": F.col("_f.line_number")}).drop("_f", code))


def explode_ast(files: DataFrame, code: str = "code") -> DataFrame:
    """One row per syntax-tree finding."""
    return files.withColumn("_f", F.explode(ast_findings_udf(F.col(code)))).select(
        *[c for c in files.columns if c != code], "_f.*")
