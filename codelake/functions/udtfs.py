"""Table functions for SQL: functions of a file, syntax-tree findings, and values of a dump's tuple.

``register(spark)`` makes them callable in lateral joins: ``SELECT f.* FROM files, LATERAL python_functions(files.code) f``.
They see one text at a time. Rows go to Python without Arrow: with it each call's rows become a batch of their own, which costs
three to five times as much for a few short rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .code_parse import AST_TYPE, FUNCTION_TYPE, ast_findings, brace_functions, python_functions

_FUNCTIONS, _FINDINGS = FUNCTION_TYPE.elementType, AST_TYPE.elementType
# Quoted value, quoted rest without an end, or an unquoted run up to a comma.
_VALUE = re.compile(r"'(?P<whole>[^']*+(?:''[^']*+)*+)'|'(?P<rest>[^']*+(?:''[^']*+)*+)\Z|(?P<bare>[^',]++)(?=,|\Z)")


def dump_values(values: str | None) -> Iterator[tuple[int, str]]:
    """Place and text of each value of a tuple, as ``sources.dump.parse_values`` gives them."""
    place = 0
    for m in _VALUE.finditer(values or ""):
        if m.lastgroup == "whole":
            value = m["whole"].replace("''", "'")
        else:
            value = (m["rest"] or "").replace("''", "'").strip() or (m["bare"] or "").strip()
            if not value:
                continue
        yield place, value
        place += 1


class PythonFunctions:
    def eval(self, code: str) -> Iterator[tuple]:
        yield from python_functions(code)


class BraceFunctions:
    def eval(self, code: str) -> Iterator[tuple]:
        yield from brace_functions(code)


class SourceFunctions:
    """Syntax tree for Python with the brace form as fallback, brace form for the rest."""

    def eval(self, code: str, language: str) -> Iterator[tuple]:
        yield from (python_functions(code) if language == "Python" else []) or brace_functions(code)


class AstFindings:
    def eval(self, code: str) -> Iterator[tuple]:
        yield from ast_findings(code)


class DumpValues:
    def eval(self, values: str) -> Iterator[tuple]:
        yield from dump_values(values)


TABLE_FUNCTIONS = {
    "python_functions": (PythonFunctions, _FUNCTIONS), "brace_functions": (BraceFunctions, _FUNCTIONS), "source_functions": (SourceFunctions, _FUNCTIONS),
    "ast_findings": (AstFindings, _FINDINGS), "dump_values": (DumpValues, "place int, value string"),
}


def register(spark: SparkSession) -> None:
    for name, (handler, returns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=returns, useArrow=False))
