"""Shared tables of the SQL checks: derived views, catalogues and the scoring chain, inlined on demand."""

from __future__ import annotations

import re

from .. import fixed
from ..functions.text import WHITESPACE
from ..sources.dims import DIM_ROWS
from ..sources.fixtures import VIEW_NAMES, view_sql


def lit(value) -> str:
    """A Python constant as SQL text; floating point numbers stay doubles."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}e0"
    if isinstance(value, int):
        return str(value)
    parts = ["'" + p.replace("'", "''") + "'" for p in str(value).split("\n")]
    return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"


def values_table(columns, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(columns)})"


def strip(expr: str) -> str:
    codes = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    return f"trim({expr}, {codes})"


def any_of(expr: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def pct(expr: str) -> str:
    return f"printf('%.2f%%', round(({expr}) * 100, 2))"


SQL_PATTERN = (rf"""(?is)({fixed.SQL_WORDS}).*?\+.*?(?:'|")|({fixed.SQL_WORDS}).*?\.format\(|f"(?:{fixed.SQL_WORDS}).*?\{{""")
CMD_PATTERN = rf"(?is)(?:{fixed.COMMAND_CALLS})\s*\([^)]*?(?:{fixed.COMMAND_PARTS}).*?\)"
RULE_PATTERNS = {
    "deserialization": "(?i)" + fixed.DESERIALIZATION_RULE, "sql_injection": SQL_PATTERN, "cmd_injection": CMD_PATTERN,
    "hardcoded_secret": "(?i)" + fixed.SECRET_RULE, "path_traversal": "(?i)" + fixed.PATH_RULE,
}


def rule(name: str, code: str = "code") -> str:
    return f"regexp_matches({code}, {lit(RULE_PATTERNS[name])})"


def heuristic(code: str = "code") -> str:
    low = f"lower({code})"
    has = lambda *w: any_of(low, *w)
    return f"""CASE WHEN {has('select ')} AND {has('where', 'join', '%s', 'format', 'like')} THEN 'CWE-89'
 WHEN {has('script', 'html', 'render', 'innerhtml')} THEN 'CWE-79'
 WHEN ({has('strcpy', 'memcpy', 'malloc', 'buffer')} OR NOT {has('strncpy')}) AND {has('strcpy', 'strcat')} THEN 'CWE-119'
 WHEN {has('exec(', 'system(', 'subprocess.run(', 'subprocess.popen(')} THEN 'CWE-78'
 WHEN {has('pickle.load', 'marshal.loads', 'yaml.load')} THEN 'CWE-502'
 WHEN {has('path', 'open(', 'file', 'directory')} AND {has('..', 'filename', 'path')} THEN 'CWE-22'
 WHEN {has('api_key', 'secret', 'password', 'token')} THEN 'CWE-798' ELSE 'CWE-20' END"""


_ANY_HIT = " OR ".join(f"hit_{r[0]}" for r in fixed.STATIC_RULES)
_FIRST_CWE = "CASE " + " ".join(f"WHEN hit_{r[0]} THEN {lit(r[1])}" for r in fixed.STATIC_RULES) + " END"
_OVERRIDE = "hit AND NOT v1 AND c1 < 0.65e0"
_NAME, _OWASP, _DESC, _REC = (lit(v) for v in fixed.GENERIC_CWE)


def _pick(column: str, generic: str, safe: str) -> str:
    return f"CASE WHEN vulnerable AND d.cwe IS NOT NULL THEN d.{column} WHEN vulnerable THEN {generic} ELSE {safe} END"


def reason_sql() -> str:
    """Reason sentence over columns code, first_line, predicted_cwe."""
    line = strip("string_split(code, chr(10))[first_line]")

    def say(template: str) -> str:
        text = lit(template).replace("{n}", "' || first_line || '").replace("{text}", f"' || substring({line}, 1, 60) || '")
        return text
    by_cwe = dict(fixed.REASON_BY_CWE)
    low = f"lower({line})"
    cases = [f"WHEN first_line IS NULL THEN {lit(fixed.REASON_NO_LINES)}",
             f"WHEN first_line > len(string_split(code, chr(10))) THEN {lit(fixed.REASON_OUT_OF_RANGE)}"]
    cases += [f"WHEN predicted_cwe = {lit(c)} THEN {say(t)}" for c, t in fixed.REASON_BY_CWE]
    cases += [
        f"WHEN {any_of(line, 'system(', 'popen(', 'subprocess')} THEN {say(by_cwe['CWE-78'])}",
        f"WHEN {any_of(low, 'select', 'execute(')} AND {any_of(line, '+', '%', 'format(', chr(102) + chr(34))} THEN {say(by_cwe['CWE-89'])}",
        f"WHEN {any_of(low, 'select', 'execute(')} THEN {say(fixed.REASON_UNPARAMETERISED)}",
        f"WHEN {any_of(line, 'pickle.load', 'yaml.load', 'marshal.loads')} THEN {say(fixed.REASON_DESERIALIZE_LINE)}",
        f"WHEN {any_of(line, 'open(', 'File(')} THEN {say(by_cwe['CWE-22'])}",
        f"WHEN {any_of(line, 'api_key', 'secret', 'password')} THEN {say(by_cwe['CWE-798'])}",
        f"WHEN {any_of(low, 'innerhtml', 'document.write')} THEN {say(by_cwe['CWE-79'])}",
        f"WHEN {any_of(line, 'eval(', 'exec(')} THEN {say(by_cwe['CWE-94'])}",
        f"WHEN {any_of(low, 'md5', 'sha1')} OR contains({line}, 'random.random') THEN {say(by_cwe['CWE-327'])}"]
    head, tail = fixed.REASON_GENERIC
    other = lit(head).replace("{n}", "' || first_line || '") + f" || substring({line}, 1, 50) || " + lit(tail)
    return "CASE " + "\n ".join(cases) + f"\n ELSE {other} END"


SEV = ["Critical", "High", "Medium", "Low"]
ISSUES = ["critical_issues", "high_issues", "medium_issues", "low_issues"]


def severity_counts(extra: str = "true") -> str:
    return ", ".join(f"CAST(count(*) FILTER (WHERE {extra} AND coalesce(severity, 'Medium') = '{s}') AS BIGINT) AS {c}"
                     for s, c in zip(SEV, ISSUES))


SCORES = """SELECT *, CAST(trunc(100 - risk_score) AS INTEGER) AS repository_score,
  CASE WHEN risk_score <= 5 THEN 'A' WHEN risk_score <= 15 THEN 'B' WHEN risk_score <= 30 THEN 'C' WHEN risk_score <= 50 THEN 'D' ELSE 'F' END AS security_grade,
  CASE WHEN business_impact_score >= 0.8e0 THEN 'Critical' WHEN business_impact_score >= 0.6e0 THEN 'High' WHEN business_impact_score >= 0.3e0 THEN 'Medium' ELSE 'Low' END AS business_impact
FROM (SELECT *,
  least(round(CASE WHEN functions_scanned > 0 THEN w * 0.7e0 + total_vulnerabilities / functions_scanned * 100 * 0.3e0 ELSE w::DOUBLE END, 1), 100e0) AS risk_score,
  CASE WHEN total_vulnerabilities = 0 THEN 0e0 ELSE least(round(0.6e0 * (CASE WHEN critical_issues > 0 THEN 4 WHEN high_issues > 0 THEN 3 WHEN medium_issues > 0 THEN 2 ELSE 1 END / 4e0) + 0.4e0 * least(total_vulnerabilities / 10e0, 1e0), 2), 1e0) END AS business_impact_score,
  CASE WHEN total_vulnerabilities > 0 THEN round(confidence_units / total_vulnerabilities) / 10000 ELSE 1e0 END AS confidence,
  CASE WHEN functions_scanned > 0 THEN round(total_vulnerabilities / functions_scanned * 100, 2) ELSE 0e0 END AS vulnerability_density
 FROM (SELECT *, critical_issues * 40 + high_issues * 25 + medium_issues * 10 + low_issues * 3 AS w FROM {summary}))"""

_SPACE = "CAST(tok_start AS INTEGER)"
TABLES: dict[str, str] = {name: view_sql(name) for name in VIEW_NAMES}
TABLES |= {name: values_table(*spec) for name, spec in DIM_ROWS.items()}
TABLES |= {
    "pred_rules": f"""SELECT *, coalesce(ml_prob >= 0.5e0, false) AS mlv, {heuristic()} AS heur,
  {', '.join(f"{rule(r[0])} AS hit_{r[0]}" for r in fixed.STATIC_RULES)},
  {any_of('lower(file_path)', *fixed.TEST_PATH_WORDS)} AS is_test FROM snippets""",
    "pred_vote": f"""SELECT *, CASE WHEN mlv THEN heur END AS ml_cwe, ({_ANY_HIT}) AS hit, {_FIRST_CWE} AS static_cwe,
  CASE WHEN mlv AND is_test THEN greatest(ml_prob - 0.25e0, 0.4e0) ELSE ml_prob END AS c1 FROM pred_rules""",
    "pred_kept": "SELECT *, mlv AND NOT (is_test AND c1 < 0.5e0) AS v1 FROM pred_vote",
    "pred_hybrid": f"""SELECT *, v1 OR ({_OVERRIDE}) AS vulnerable,
  round(CASE WHEN {_OVERRIDE} THEN greatest(c1, 0.7e0) WHEN hit AND v1 THEN least(c1 + 0.1e0, 1e0) ELSE c1 END, 4) AS confidence,
  CASE WHEN {_OVERRIDE} THEN static_cwe WHEN hit AND v1 AND ml_cwe IS NULL THEN static_cwe ELSE ml_cwe END AS hybrid_cwe FROM pred_kept""",
    "pred_cwe": "SELECT *, CASE WHEN vulnerable AND hybrid_cwe IS NULL THEN heur ELSE hybrid_cwe END AS predicted_cwe FROM pred_hybrid",
    "pred": f"""SELECT p.*, {_pick('cwe_name', _NAME, 'NULL')} AS cwe_name,
  {_pick('severity', "CASE WHEN confidence > 0.8e0 THEN 'High' ELSE 'Medium' END", "'None'")} AS severity,
  {_pick('recommendation', _REC, lit(fixed.SAFE_RECOMMENDATION))} AS recommendation,
  {_pick('score', 'round(confidence * 10, 1)', '0e0')} AS cvss_score,
  {_pick('owasp', _OWASP, 'NULL')} AS owasp, {_pick('description', _DESC, lit(fixed.SAFE_DESCRIPTION))} AS description
 FROM pred_cwe p LEFT JOIN dim_cwe d ON p.predicted_cwe = d.cwe AND p.vulnerable""",
    "vuln": "SELECT * FROM pred WHERE vulnerable",
    "mean_attention": "SELECT snippet_id, token_idx, token, tok_start, tok_end, avg(weight) AS m FROM attention GROUP BY 1, 2, 3, 4, 5",
    "cls_attention": """SELECT *, units / 10000000000e0 AS weight FROM (SELECT snippet_id, token_idx, token, tok_start, tok_end,
  CAST(round(CASE WHEN sum(m) OVER (PARTITION BY snippet_id) > 0 THEN m / sum(m) OVER (PARTITION BY snippet_id) ELSE m END * 10000000000) AS BIGINT) AS units FROM mean_attention)""",
    "snippet_lines": """SELECT snippet_id, generate_subscripts(string_split(code, chr(10)), 1) AS line_number, unnest(string_split(code, chr(10))) AS line_text FROM snippets""",
    "token_lines": f"""SELECT c.*, CASE WHEN tok_start > length(code) THEN 1 ELSE length(left(code, {_SPACE})) - length(replace(left(code, {_SPACE}), chr(10), '')) + 1 END AS line_number
 FROM cls_attention c JOIN snippets s USING (snippet_id) WHERE NOT (tok_start = 0 AND tok_end = 0 AND token_idx > 0)""",
    "line_attention": """SELECT l.snippet_id, l.line_number, l.line_text, CAST(coalesce(sum(t.units), 0) AS BIGINT) AS units
 FROM snippet_lines l LEFT JOIN token_lines t ON l.snippet_id = t.snippet_id AND l.line_number = t.line_number GROUP BY 1, 2, 3""",
    "line_ranked": f"""SELECT *, solid AND units > 1500000000 AS strong, max(CASE WHEN solid AND units > 1500000000 THEN 1 ELSE 0 END) OVER (PARTITION BY snippet_id) AS any_strong
 FROM (SELECT a.*, length({strip('line_text')}) > 1 AS solid, row_number() OVER (PARTITION BY a.snippet_id ORDER BY units DESC, line_number) AS rk
   FROM line_attention a JOIN vuln v USING (snippet_id) WHERE v.confidence >= 0.5e0)""",
    "top_lines": "SELECT snippet_id, line_number, units FROM line_ranked WHERE CASE WHEN any_strong = 1 THEN strong ELSE solid AND rk <= 2 END",
    "line_span": "SELECT snippet_id, min(line_number) AS first_line, max(line_number) AS last_line FROM top_lines GROUP BY 1",
    "explained": f"SELECT *, {reason_sql()} AS reason FROM vuln LEFT JOIN line_span USING (snippet_id)",
    "finding": """SELECT repo_id, snippet_id, cwe_name AS type, severity, confidence, predicted_cwe, coalesce(owasp, 'Unknown') AS owasp,
  file_path AS file, function_name || '()' AS function, '1-' || (1 + coalesce(last_line - first_line, 0)) AS lines, reason, recommendation, confidence AS risk_score FROM explained""",
    "repo_summary": f"""SELECT repo_id, count(DISTINCT file_path) AS files_scanned, count(*) AS functions_scanned,
  count(*) FILTER (WHERE vulnerable) AS total_vulnerabilities, {severity_counts('vulnerable')},
  CAST(coalesce(sum(CAST(round(confidence * 10000) AS BIGINT)) FILTER (WHERE vulnerable), 0) AS BIGINT) AS confidence_units FROM pred GROUP BY 1""",
    "repo_score": SCORES.format(summary="repo_summary"),
    "repo_violation": "SELECT DISTINCT repo_id, violation FROM vuln JOIN dim_compliance ON upper(predicted_cwe) = cwe",
    "fix_rows": """SELECT DISTINCT m.code, m.before_change, f.programming_language, cc.cwe_id, cv.cvss3_base_score, cv.cvss3_base_severity
 FROM cvefixes_method_change m JOIN cvefixes_file_change f ON m.file_change_id = f.file_change_id JOIN cvefixes_commits c ON f.hash = c.hash
 JOIN cvefixes_fixes fx ON c.hash = fx.hash JOIN cvefixes_cve cv ON fx.cve_id = cv.cve_id
 LEFT JOIN cvefixes_cwe_classification cc ON cv.cve_id = cc.cve_id WHERE m.code IS NOT NULL AND m.code <> ''""",
}


def clean_sql(code: str, language: str) -> str:
    """Comment removal by language, newline unification and strip."""
    low = f"lower({language})"
    g = lambda e, p, r="''": f"regexp_replace({e}, {lit(p)}, {r}, 'g')"
    py = g(g(code, "(?s)\"\"\".*?\"\"\"|'''.*?'''"), "#.*")
    after_py = f"(CASE WHEN {low} IN ('python', '') THEN {py} ELSE {code} END)"
    after_c = f"(CASE WHEN {low} <> 'python' THEN {g(g(after_py, r'(?s)/\*.*?\*/'), '//.*')} ELSE {after_py} END)"
    unified = g(after_c, "\\r\\n?", "chr(10)")
    return f"(CASE WHEN {code} IS NULL OR {strip(code)} = '' THEN '' ELSE {strip(g(unified, '\\n{3,}', 'chr(10) || chr(10)'))} END)"


def token_sql(language: str) -> str:
    cases = " ".join(f"WHEN {lit(n)} THEN {lit(t)}" for n, t in fixed.LANGUAGE_TOKENS)
    return f"(CASE {language} {cases} ELSE {lit(fixed.UNKNOWN_TOKEN)} END)"


LABEL = f"CASE WHEN lower({strip('before_change')}) IN ('true', '1') THEN 1 ELSE 0 END"
LANG = strip("coalesce(programming_language, '')")
TABLES |= {
    "clean_rows": f"""SELECT {token_sql('lang')} || ' ' || {clean_sql('code', 'lang')} AS code, before_change, lang AS programming_language, cwe_id,
  cvss3_base_score, cvss3_base_severity, {LABEL} AS label FROM (SELECT *, {LANG} AS lang FROM fix_rows)""",
    "unique_rows": """SELECT * FROM (SELECT *, sha256(code) AS code_hash, row_number() OVER (PARTITION BY sha256(code)
  ORDER BY label NULLS FIRST, programming_language NULLS FIRST, before_change NULLS FIRST, cwe_id NULLS FIRST, cvss3_base_score NULLS FIRST, cvss3_base_severity NULLS FIRST) AS rn
 FROM clean_rows WHERE length(code) >= 20) WHERE rn = 1""",
    "class_size": "SELECT least(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0), 2500) AS n FROM unique_rows",
    "balanced_rows": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(code_hash || ':42'), code_hash) AS rank FROM unique_rows), class_size WHERE rank <= n""",
}

# The classifier in closed form: labelled documents in three parts, its terms, their weights, and the scores of all documents.
TERM = r"[\p{L}\p{N}_]{2,}"
_WORDS = f"regexp_extract_all(lower(coalesce(text, '')), {lit(TERM)})"
TABLES |= {
    "nb_parts": """SELECT *, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + ceil(round((n - t) * (0.1e0 / 0.9e0), 6)) THEN 'val' ELSE 'train' END AS split
 FROM (SELECT *, ceil(round(n * 0.1e0, 6)) AS t FROM (SELECT doc_id, quality AS label, count(*) OVER (PARTITION BY quality) AS n,
  row_number() OVER (PARTITION BY quality ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS rk FROM labels JOIN documents USING (doc_id)))""",
    "nb_words": f"SELECT doc_id, list_slice({_WORDS}, 1, 512) AS w FROM documents",
    "nb_tokens": "SELECT doc_id, unnest(w) AS term FROM nb_words",
    "nb_terms": """SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences, count(*) FILTER (WHERE label = 1) AS bad
 FROM nb_tokens JOIN nb_parts USING (doc_id) WHERE split = 'train' GROUP BY term ORDER BY df DESC, term LIMIT 8000""",
    "nb_weights": """SELECT term, CAST(round((ln((bad + 1e0) / (sum(bad) OVER () + count(*) OVER ()))
  - ln((occurrences - bad + 1e0) / (sum(occurrences - bad) OVER () + count(*) OVER ()))) * 1000000) AS BIGINT) AS weight FROM nb_terms""",
    "nb_prior": """SELECT CAST(round(ln((count(*) FILTER (WHERE label = 1) + 1e0) / (count(*) FILTER (WHERE label = 0) + 1e0)) * 1000000) AS BIGINT) AS prior
 FROM nb_parts WHERE split = 'train'""",
    "nb_scores": """SELECT doc_id, round(1e0 / (1e0 + exp(-greatest(least((coalesce(units, 0) + prior) / 1000000e0, 30e0), -30e0))), 6) AS ml_prob
 FROM documents LEFT JOIN (SELECT doc_id, sum(weight) AS units FROM nb_tokens JOIN nb_weights USING (term) GROUP BY doc_id) USING (doc_id), nb_prior""",
    "cwe_rows": "SELECT snippet_id, predicted_cwe AS label, code AS text FROM vuln WHERE coalesce(predicted_cwe, '') <> ''",
    "cwe_words": f"SELECT snippet_id, list_filter({_WORDS}, lambda t: t NOT IN ({', '.join(map(lit, fixed.STOP_WORDS))})) AS w FROM cwe_rows",
    "cwe_terms": """SELECT term, count(DISTINCT snippet_id) AS df FROM (SELECT snippet_id, unnest(w) AS term FROM cwe_words
  UNION ALL SELECT snippet_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cwe_words) GROUP BY term ORDER BY df DESC, term LIMIT 8000""",
}


def with_tables(body: str, other: dict[str, str] | None = None) -> str:
    """The query preceded by every shared table it needs, in dependency order; ``other`` stands in for shared tables."""
    tables = TABLES | (other or {})

    def used(text: str) -> set[str]:
        return set(re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", text))) & set(tables)
    parts: dict[str, str] = {}

    def add(names: set[str]) -> None:
        for name in sorted(names, key=list(tables).index):
            if name not in parts:
                add(used(tables[name]) - {name})
                parts[name] = f"{name} AS ({tables[name]})"

    add(used(body))
    return ("WITH " + ",\n".join(parts.values()) + "\n" if parts else "") + body
