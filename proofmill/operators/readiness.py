"""Whether a document can be compiled: features, structural faults, and the reasons against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.operators.parsing import parse_errors
from proofmill.operators.projects import include_cycles, resolved_includes
from proofmill.operators.structure import duplicate_labels

#: Features by pattern: foreign ones reach beyond the document, extended ones program. Fixed values.
FEATURES = (
    ("shell-escape", "foreign", r"\\(immediate)?\\?write18"), ("shell-escape-macro", "foreign", r"\\ShellEscape"), ("catcode", "foreign", r"\\catcode"), ("scantokens", "foreign", r"\\scantokens"), ("detokenize", "foreign", r"\\detokenize"), ("csstring", "foreign", r"\\csstring"), ("file-output", "foreign", r"\\openout[0-9\\]"), ("lua", "foreign", r"\\(directlua|latelua|luaexec)"),
    ("def", "extended", r"\\def[^A-Za-z]"), ("edef", "extended", r"\\(edef|gdef|xdef)[^A-Za-z]"), ("let", "extended", r"\\(let|futurelet)[^A-Za-z]"), ("at-letter", "extended", r"\\makeatletter"), ("csname", "extended", r"\\csname"), ("ifnum", "extended", r"\\ifnum"), ("ifdim", "extended", r"\\ifdim"), ("ifx", "extended", r"\\ifx"), ("ifodd", "extended", r"\\ifodd"),
    ("primitive-if", "extended", r"\\if(case|cat|vmode|hmode|mmode|inner|void|hbox|vbox|eof|true|false|defined|csname|fontchar)[^A-Za-z]"), ("bare-if", "extended", r"\\if[^A-Za-z]"), ("expandafter-chain", "extended", r"\\expandafter[ \t]*\\expandafter"),
)
#: What engines can't do: a feature and the engines that lack it. Fixed values.
INCOMPATIBLE = (("fontspec", ("PDFLaTeX", "LaTeX")), ("unicode-math", ("PDFLaTeX", "LaTeX")), ("polyglossia", ("PDFLaTeX", "LaTeX")), ("inputenc", ("XeLaTeX", "LuaLaTeX")), ("luacode", ("PDFLaTeX", "XeLaTeX", "LaTeX")))
#: Bytes beyond which a document isn't looked at.
MOST_BYTES = 10 * 1024 * 1024


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, feature, tier, n): features used, comments left out, with how often; null texts have none."""
    plain = F.regexp_replace("text", r"(^|[^\\])%[^\n]*", "$1")
    hits = F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(t).alias("tier"), F.regexp_count(F.col("t"), F.lit(p)).cast("bigint").alias("n")) for k, t, p in FEATURES))
    base = docs.where("text is not null").select("doc_id", plain.alias("t"))
    return base.select("doc_id", F.explode_outer(F.filter(hits, lambda h: h.n > 0)).alias("h")).where("h is not null").select("doc_id", "h.feature", "h.tier", "h.n")


def _structural() -> list[tuple[str, Column]]:
    c = F.col("t")
    begin = F.instr(c, "\\begin{document}")
    # fixed values: faults that stop a run whatever the engine
    return [
        ("no document class", ~F.contains(c, F.lit("\\documentclass"))), ("no begin of the document", begin == 0), ("no live end of the document", ~F.contains(c, F.lit("\\end{document}"))),
        ("package loaded in the body", (begin > 0) & F.substr(c, F.greatest(begin, F.lit(1))).contains("\\usepackage")), ("null byte", F.contains(c, F.lit("\0"))), ("document begun twice", F.regexp_count(c, F.lit(r"\\begin\{document\}")) > 1),
        ("script upon script", F.regexp_like(c, F.lit(r"[A-Za-z0-9}](\^[A-Za-z0-9]\^|_[A-Za-z0-9]_|\^\{[^{}]*\}\^|_\{[^{}]*\}_)"))), ("verbatim broken at a line's end", F.regexp_like(c, F.lit(r"(?m)\\verb\|[^|\n]*$"))),
        ("too large", F.octet_length(c) > MOST_BYTES),
    ]


def structural_faults(docs: DataFrame) -> DataFrame:
    """(doc_id, reason): faults that stop any run, comments left out."""
    base = docs.where("text is not null").select("doc_id", F.regexp_replace("text", r"(^|[^\\])%[^\n]*", "$1").alias("t"))
    hits = F.array(*(F.when(w, F.lit(k)) for k, w in _structural()))
    return base.select("doc_id", F.explode_outer(F.filter(hits, lambda h: h.isNotNull())).alias("reason")).where("reason is not null")


def incompatible_packages(docs: DataFrame, engine_col: str = "engine") -> DataFrame:
    """(doc_id, package): packages that the document's engine lacks."""
    names = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\\usepackage(?:\[[^\]]*\])?\{([^}]*)\}"), F.lit(1)), lambda x: F.split(x, r"\s*,\s*")))
    used = docs.where("text is not null").select("doc_id", F.col(engine_col).alias("engine"), F.explode(F.array_distinct(names)).alias("package"))
    bad = F.lit(False)
    for package, engines in INCOMPATIBLE:
        bad = bad | ((F.col("package") == package) & F.col("engine").isin(*engines))
    return used.where(bad).select("doc_id", "package")


def reasons(docs: DataFrame, severe: DataFrame | None = None) -> DataFrame:
    """(doc_id, step, reason): everything that speaks against compiling a document (doc_id, path, text).

    Steps: tier, parse, includes, labels, rules (``severe``: doc_id, rule_id of findings of error severity), structure.
    """
    doc = docs.select("doc_id", F.col("path").alias("p"))
    parts = [
        features(docs).where("tier = 'foreign'").select("doc_id", F.lit("tier").alias("step"), F.concat(F.lit("foreign feature "), "feature").alias("reason")),
        parse_errors(docs).select("doc_id", F.lit("parse"), "error"),
        resolved_includes(docs).where("file is null").join(doc, F.col("path") == F.col("p")).select("doc_id", F.lit("includes"), F.concat(F.lit("nothing found for "), "target")),
        include_cycles(docs).join(doc, F.col("node") == F.col("p")).select("doc_id", F.lit("includes"), F.lit("includes itself")),
        duplicate_labels(docs).select("doc_id", F.lit("labels"), F.concat(F.lit("label set twice: "), "key")),
        structural_faults(docs).select("doc_id", F.lit("structure"), "reason"),
    ]
    if severe is not None:
        parts.append(severe.select("doc_id", F.lit("rules"), F.col("rule_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def ready(docs: DataFrame, severe: DataFrame | None = None) -> DataFrame:
    """(doc_id): documents that nothing speaks against."""
    return docs.where("text is not null").select("doc_id").join(reasons(docs, severe).select("doc_id").distinct(), "doc_id", "left_anti")


def compile_verdicts(evidence: DataFrame) -> DataFrame:
    """(doc_id, holds, n_failed): the conjunction of the evidence (doc_id, claim, holds); an unknown claim counts as failed."""
    return evidence.groupBy("doc_id").agg(F.bool_and(F.coalesce("holds", F.lit(False))).alias("holds"), F.count_if(~F.coalesce(F.col("holds"), F.lit(False))).alias("n_failed"))
