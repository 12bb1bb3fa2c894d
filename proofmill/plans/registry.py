"""The rule registry, compiled into one projection per corpus, and into SQL of the same meaning."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.plans import rules_doc, rules_math, rules_setup, rules_text
from proofmill.session import spread

MATH_ENVIRONMENTS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math", "flalign", "alignat")
_ENVS = "|".join(MATH_ENVIRONMENTS)
#: Comments up to the end of their lines; the character before the sign stays.
COMMENT = "(^|[^\\\\])%[^\\n]*"
VERBATIM = "(?s)\\\\begin\\{(verbatim|lstlisting|minted)\\*?\\}.*?\\\\end\\{(verbatim|lstlisting|minted)\\*?\\}|\\\\verb[|][^|\\n]*[|]|\\\\verb[+][^+\\n]*[+]|\\\\verb![^!\\n]*!"
MATH = f"(?s)\\\\begin\\{{({_ENVS})\\*?\\}}.*?\\\\end\\{{({_ENVS})\\*?\\}}|\\$\\$[^$]*\\$\\$|\\$[^$\\n]*\\$|\\\\\\(.*?\\\\\\)|\\\\\\[.*?\\\\\\]"
#: Begin and end of a block itself, which are no part of its body.
BEGIN_END = r"^\\begin\{[^}]*\}|\\end\{[^}]*\}$"
SCOPES = ("raw", "nocomment", "nomath", "prose", "math", "preamble", "body")
SEVERITY_RANK = {"Error": 2, "Warning": 1, "Info": 0}


class Rule(NamedTuple):
    rule_id: str
    severity: str
    scope: str
    kind: str
    pattern: object
    languages: tuple[str, ...]
    message: str

    @property
    def family(self) -> str:
        return self.rule_id.split("-")[0]


def all_rules() -> list[Rule]:
    """Every rule of the registry, by id."""
    return sorted(Rule(*r) for m in (rules_text, rules_math, rules_doc, rules_setup) for r in m.RULES)


def scopes(text: Column) -> dict[str, Column]:
    """The stretches of a text that detectors may see, each a column."""
    no_comment = F.regexp_replace(text, COMMENT, "$1")
    no_verbatim = F.regexp_replace(no_comment, VERBATIM, "")
    start = F.instr(text, "\\begin{document}")
    return {
        "raw": text,
        "nocomment": no_comment,
        "nomath": F.regexp_replace(text, MATH, ""),
        "prose": F.regexp_replace(no_verbatim, MATH, ""),
        "math": F.array_join(F.regexp_extract_all(no_verbatim, F.lit(MATH), F.lit(0)), "\n"),
        "preamble": F.when(start > 0, F.substr(text, F.lit(1), start - 1)).otherwise(F.lit("")),
        "body": F.when(start > 0, F.substr(text, start)).otherwise(text),
    }


def sql_scopes(text: str = "text") -> dict[str, str]:
    """As ``scopes``, as DuckDB expressions."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    no_comment = f"regexp_replace({text}, {q(COMMENT)}, '\\1', 'g')"
    no_verbatim = f"regexp_replace({no_comment}, {q(VERBATIM)}, '', 'g')"
    start = f"instr({text}, '\\begin{{document}}')"
    return {
        "raw": text,
        "nocomment": no_comment,
        "nomath": f"regexp_replace({text}, {q(MATH)}, '', 'g')",
        "prose": f"regexp_replace({no_verbatim}, {q(MATH)}, '', 'g')",
        "math": f"array_to_string(regexp_extract_all({no_verbatim}, {q(MATH)}), chr(10))",
        "preamble": f"CASE WHEN {start} > 0 THEN substr({text}, 1, {start} - 1) ELSE '' END",
        "body": f"CASE WHEN {start} > 0 THEN substr({text}, {start}) ELSE {text} END",
    }


def required_literal(pattern: str) -> str:
    """The longest plain text that every match of a pattern holds, or '' if none can be told."""
    best, run, i, depth = "", "", 0, 0
    if re.search(r"(?<!\\)\|", re.sub(r"\[[^\]]*\]|\([^()]*\)", "", pattern)) or pattern.startswith("(?"):
        return ""
    while i < len(pattern):
        c, size, literal = pattern[i], 1, None
        if c == "\\":
            nxt = pattern[i + 1]
            size = 2
            if nxt == "x":
                size = pattern.index("}", i) - i + 1
                literal = chr(int(pattern[i + 3 : i + size - 1], 16))
            elif not nxt.isalnum():
                literal = nxt
            else:
                literal = {"n": "\n", "t": "\t", "r": "\r"}.get(nxt)
        elif c == "[":
            j = i + 1
            while pattern[j] != "]" or j == i + 1 or pattern[j - 1] == "^" and j == i + 2:
                j += 2 if pattern[j] == "\\" else 1
            size = j - i + 1
        elif c == "{":
            size = pattern.index("}", i) - i + 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c not in ".^$|*+?{}":
            literal = c
        following = pattern[i + size : i + size + 1]
        if depth or literal is None or c in "()":
            run = ""
        elif following in ("?", "*", "{") and following:
            run = ""
        else:
            run += literal
            best = max(best, run, key=len)
            if following == "+":
                run = ""
        i += size
    return best


def block_pattern(names: tuple[str, ...]) -> str:
    """The blocks of environments, each up to the first end of its name."""
    return "(?s)" + "|".join(f"\\\\begin\\{{{n}\\}}.*?\\\\end\\{{{n}\\}}" for n in names)


def detector(rule: Rule) -> Column:
    """How often a rule finds something in a row that holds the scope columns."""
    c = F.col(f"s_{rule.scope}")
    if rule.kind == "re":
        n = F.regexp_count(c, F.lit(rule.pattern))
        if literal := required_literal(rule.pattern):  # a plain search spares most texts the pattern
            n = F.when(F.contains(c, F.lit(literal)), n).otherwise(0)
    elif rule.kind == "needle":
        mark, k = rule.pattern
        n = F.regexp_count(c, F.lit(f"(?={re.escape(mark) if mark != chr(10) else chr(92) + 'n'}{{{k}}})"))
    elif rule.kind in ("all", "but"):
        with_, without = rule.pattern if rule.kind == "but" else (rule.pattern, [])
        n = _holds(c, with_, without).cast("int")
    elif rule.kind in ("block", "in_block"):
        names = rule.pattern[0]
        blocks = F.regexp_extract_all(c, F.lit(block_pattern(names)), F.lit(0))
        body = lambda b: F.regexp_replace(b, BEGIN_END, "")
        if rule.kind == "block":
            n = F.size(F.filter(blocks, lambda b: _holds(body(b), *rule.pattern[1:])))
        else:
            n = F.aggregate(F.transform(blocks, lambda b: F.regexp_count(body(b), F.lit(rule.pattern[1]))), F.lit(0), lambda a, k: a + k)
        begun = F.lit(False)
        for name in dict.fromkeys(x.removesuffix("\\*") for x in names):
            begun = begun | F.contains(c, F.lit("\\begin{" + name))
        n = F.when(begun, n).otherwise(0)
    else:
        n = F.size(F.filter(F.split(c, "\n"), lambda line: F.octet_length(line) > rule.pattern))
    n = n.cast("bigint")
    return F.when(F.col("lang2").isin(*rule.languages), n).otherwise(F.lit(0).cast("bigint")) if rule.languages else n


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_holds(c: str, with_: list, without: list[str]) -> str:
    """As ``_holds``, as a DuckDB expression."""
    return "(" + " AND ".join(["TRUE", *(f"regexp_matches({c}, {quoted(p)})" if isinstance(p, str) else f"len(regexp_extract_all({c}, {quoted(p[0])})) >= {p[1]}" for p in with_), *(f"NOT regexp_matches({c}, {quoted(p)})" for p in without)]) + ")"


def _holds(c: Column, with_: list, without: list[str]) -> Column:
    ok = F.lit(True)
    for literal in dict.fromkeys(x for p in with_ if isinstance(p, str) and (x := required_literal(p))):
        ok = ok & F.contains(c, F.lit(literal))  # a plain search spares most texts the patterns
    for p in with_:
        ok = ok & (F.regexp_like(c, F.lit(p)) if isinstance(p, str) else F.regexp_count(c, F.lit(p[0])) >= p[1])
    for p in without:
        ok = ok & ~F.regexp_like(c, F.lit(p))
    return ok


def sql_detector(rule: Rule) -> str:
    """As ``detector``, as a DuckDB expression; overlapping occurrences are counted by the lengths of runs."""
    q, c = quoted, f"s_{rule.scope}"
    if rule.kind == "re":
        n = f"len(regexp_extract_all({c}, {q(rule.pattern)}))"
    elif rule.kind == "needle":
        mark, k = rule.pattern
        m = "\\n" if mark == "\n" else re.escape(mark)
        n = f"coalesce(list_sum(list_transform(regexp_extract_all({c}, {q(f'{m}{{{k},}}')}), lambda x: length(x) - {k - 1})), 0)"
    elif rule.kind in ("all", "but"):
        n = f"CAST({sql_holds(c, *(rule.pattern if rule.kind == 'but' else (rule.pattern, [])))} AS INT)"
    elif rule.kind in ("block", "in_block"):
        bodies = f"list_transform(regexp_extract_all({c}, {q(block_pattern(rule.pattern[0]))}), lambda b: regexp_replace(b, {q(BEGIN_END)}, '', 'g'))"
        n = f"len(list_filter({bodies}, lambda b: {sql_holds('b', *rule.pattern[1:])}))" if rule.kind == "block" else f"coalesce(list_sum(list_transform({bodies}, lambda b: len(regexp_extract_all(b, {q(rule.pattern[1])})))), 0)"
    else:
        n = f"len(list_filter(string_split({c}, chr(10)), lambda x: strlen(x) > {rule.pattern}))"
    n = f"CAST({n} AS BIGINT)"
    return f"CASE WHEN lang2 IN ({', '.join(map(q, rule.languages))}) THEN {n} ELSE 0 END" if rule.languages else n


def registry_frame(spark: SparkSession) -> DataFrame:
    """(rule_id, family, severity, severity_rank, scope, message), one row a rule."""
    rows = [(r.rule_id, r.family, r.severity, SEVERITY_RANK[r.severity], r.scope, r.message) for r in all_rules()]
    return spark.createDataFrame(rows, "rule_id string, family string, severity string, severity_rank int, scope string, message string")


def findings(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, rule_id, severity, n): every rule that finds something in a document, with how often.

    One pass: scopes are columns, all detectors one projection, rules that find nothing are dropped before the
    rows fan out; no shuffle, but for a scan of fewer partitions than cores, which is spread. The outer form of
    explode keeps the optimizer from inferring a filter on the array, which would run every detector twice and
    every scope once a detector. Null texts have no findings.
    """
    rules = all_rules() if rules is None else rules
    lang = F.lower(F.substring(F.col(lang_col), 1, 2)) if lang_col else F.lit(None).cast("string")
    used = {r.scope for r in rules}
    columns = [v.alias(f"s_{k}") for k, v in scopes(F.col(text_col)).items() if k in used]
    base = spread(docs).where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), lang.alias("lang2"), *columns)
    hits = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), detector(r).alias("n")) for r in rules))
    return base.select("doc_id", F.explode_outer(F.filter(hits, lambda h: h.n > 0)).alias("h")).where("h is not null").select("doc_id", "h.rule_id", "h.severity", "h.n")


def sql_findings(rules: list[Rule] | None = None, docs: str = "documents", lang: str = "lang") -> str:
    """As ``findings``, as a DuckDB query."""
    rules = all_rules() if rules is None else rules
    used = {r.scope for r in rules}
    columns = ", ".join(f"{v} AS s_{k}" for k, v in sql_scopes().items() if k in used)
    hits = ", ".join(f"{{'rule_id': '{r.rule_id}', 'severity': '{r.severity}', 'n': {sql_detector(r)}}}" for r in rules)
    return f"SELECT doc_id, h.rule_id AS rule_id, h.severity AS severity, h.n AS n FROM (SELECT doc_id, unnest([{hits}]) AS h FROM (SELECT doc_id, lower(substr({lang}, 1, 2)) AS lang2, {columns} FROM {docs} WHERE text IS NOT NULL)) WHERE h.n > 0"
