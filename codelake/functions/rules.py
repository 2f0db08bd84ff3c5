"""Static rules, CWE heuristics, the hybrid decision and exploitability, as column expressions.

Patterns with several gaps cost time linear in the text. Where the first keyword decides, one atomic prefix from the start
of the text leaves no other start to try. Where a call's arguments matter, a first pass marks the arguments of each call up
to the closing bracket, so that stretches don't overlap, and a second pass looks into each stretch once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import contains_any, is_blank

_ANY = r"(?isu)\A(?>.*?"
SQL_CONCAT = rf"""{_ANY}(?:{fixed.SQL_WORDS}))(?>.*?\+).*?['"]"""
SQL_FORMAT = rf"""{_ANY}(?:{fixed.SQL_WORDS})).*?\.format\("""
SQL_FSTRING = rf"""{_ANY}f"(?:{fixed.SQL_WORDS})).*?\{{"""
MARK = "\ue000"
# Arguments of shell calls up to a bracket; a stretch with a built part must end at a bracket.
COMMAND_ARGUMENTS = rf"(?iu)((?:{fixed.COMMAND_CALLS})\s*+\()([^)]*+)"
COMMAND = rf"(?iu){MARK}(?>[^)]*?(?:{fixed.COMMAND_PARTS}))[^)]*+\)"
SECRET = "(?iu)" + fixed.SECRET_RULE
# The same for file calls, line by line: a stretch that goes on in the next line is marked there again. Of a line's stretches
# the first with an outer value decides, and after it the first step upwards.
PATH_ARGUMENTS = rf"(?idu)((?:{fixed.PATH_CALLS})\s*+\(|\G(?!\A)\n)([^)\n]*+)"
PATH = rf"(?idmu)^(?>.*?{MARK}[^)\n{MARK}]*?(?:{fixed.PATH_INPUTS}))(?>.*?(?:{fixed.PATH_STEPS}))[^)\n]*+\)"
DESERIALIZATION = "(?iu)" + fixed.DESERIALIZATION_RULE


def _marked(code: Column, arguments: str) -> Column:
    return F.regexp_replace(F.replace(code, F.lit(MARK), F.lit("")), arguments, f"$1{MARK}$2")


def rule_deserialization(code: Column) -> Column:
    return code.rlike(DESERIALIZATION)


def rule_sql_injection(code: Column) -> Column:
    return code.rlike(SQL_CONCAT) | code.rlike(SQL_FORMAT) | code.rlike(SQL_FSTRING)


def rule_cmd_injection(code: Column) -> Column:
    found = _marked(code, COMMAND_ARGUMENTS).rlike(COMMAND)
    return F.when(code.rlike(f"(?iu){fixed.COMMAND_CALLS}"), found).otherwise(F.when(code.isNotNull(), False))


def rule_hardcoded_secret(code: Column) -> Column:
    return code.rlike(SECRET)


def rule_path_traversal(code: Column) -> Column:
    found = _marked(code, PATH_ARGUMENTS).rlike(PATH)
    return F.when(code.rlike(fixed.PATH_STEPS), found).otherwise(F.when(code.isNotNull(), False))


RULES = {
    "deserialization": rule_deserialization,
    "sql_injection": rule_sql_injection,
    "cmd_injection": rule_cmd_injection,
    "hardcoded_secret": rule_hardcoded_secret,
    "path_traversal": rule_path_traversal,
}


def _hits(value_index: int, hits: dict[str, Column]) -> Column:
    found = [F.when(hits[r[0]], F.lit(r[value_index])) for r in fixed.STATIC_RULES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def static_messages(hits: dict[str, Column]) -> Column:
    return _hits(3, hits)


def static_cwes(hits: dict[str, Column]) -> Column:
    return _hits(1, hits)


def static_any(hits: dict[str, Column]) -> Column:
    out = F.lit(False)
    for rule in fixed.STATIC_RULES:
        out = out | hits[rule[0]]
    return out


def first_static_cwe(hits: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(hits[r[0]], F.lit(r[1])) for r in fixed.STATIC_RULES])


def heuristic_cwe(low: Column) -> Column:
    """Keyword rules on lower-cased code in fixed order; the first that applies gives the CWE."""
    has = lambda *words: contains_any(low, list(words))
    return (F.when(has("select ") & has("where", "join", "%s", "format", "like"), "CWE-89")
            .when(has("script", "html", "render", "innerhtml"), "CWE-79")
            .when((has("strcpy", "memcpy", "malloc", "buffer") | ~has("strncpy")) & has("strcpy", "strcat"), "CWE-119")
            .when(has("exec(", "system(", "subprocess.run(", "subprocess.popen("), "CWE-78")
            .when(has("pickle.load", "pickle.loads", "marshal.loads", "yaml.load"), "CWE-502")
            .when(has("path", "open(", "file", "directory") & has("..", "filename", "path"), "CWE-22")
            .when(has("api_key", "secret", "password", "token"), "CWE-798")
            .otherwise("CWE-20"))


def is_test_path(path: Column) -> Column:
    return contains_any(F.lower(F.coalesce(path, F.lit(""))), fixed.TEST_PATH_WORDS)


def deescalate(vulnerable: Column, confidence: Column, path: Column) -> tuple[Column, Column]:
    """Lower the confidence of findings in test files; below one half they become safe."""
    lowered = is_test_path(path) & vulnerable
    new_confidence = F.when(lowered, F.greatest(confidence - 0.25, F.lit(0.4))).otherwise(confidence)
    return vulnerable & ~(lowered & (new_confidence < 0.5)), new_confidence


def exploitability(code: Column, cwe: Column) -> tuple[Column, Column]:
    """(status, reason) from keyword tests for SQL, shell and path weaknesses."""
    low = F.lower(code)
    has = lambda *words: contains_any(low, list(words))
    formatted = has("+", ".format(", 'f"', "f'") | (has("%") & ~has("%s"))
    sql_open = has("execute(") & formatted
    sql_bound = ~sql_open & has("%s") & has("execute")
    shell_open = has("shell=true", "system(")
    shell_off = ~shell_open & has("subprocess") & has("shell=false")
    checked = has("abspath", "realpath", "startswith")
    mitigated = (((cwe == "CWE-89") & sql_bound) | ((cwe == "CWE-78") & shell_off) | ((cwe == "CWE-22") & checked))
    reason = (F.when((cwe == "CWE-89") & sql_open, fixed.EXPLOIT_SQL)
              .when((cwe == "CWE-89") & sql_bound, fixed.MITIGATED_SQL)
              .when((cwe == "CWE-78") & shell_open, fixed.EXPLOIT_SHELL)
              .when((cwe == "CWE-78") & shell_off, fixed.MITIGATED_SHELL)
              .when((cwe == "CWE-22") & checked, fixed.MITIGATED_PATH)
              .when(cwe == "CWE-22", fixed.EXPLOIT_PATH)
              .otherwise(fixed.EXPLOIT_DEFAULT))
    return F.when(mitigated, "mitigated").otherwise("exploitable"), reason


def guard_verdict(command: Column) -> Column:
    return F.when(contains_any(command, fixed.GUARD_WORDS), "BLOCKED").otherwise("SECURE")
