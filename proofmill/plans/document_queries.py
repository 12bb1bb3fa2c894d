"""Queries of the parser, edits, projects, incremental work, readers, governance and streams, with SQL where it can state them.

Some features stand in no table (macros, includes, raw log lines, pictures); their queries derive such input from whole
tables by an expression that the SQL repeats.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.paths import file_name
from proofmill.operators import edits, governance, graphs, incremental, learning, macros, parsing, projects, readiness
from proofmill.operators import findings as fo
from proofmill.operators import structure as st
from proofmill.plans.corpus import CORPUS, corpus
from proofmill.plans.registry import all_rules, findings, sql_findings
from proofmill.plans.relations import _FOLD_NAME, ORACLES as RELATION_ORACLES
from proofmill.session import shared_dir
from proofmill.sources import binary, files
from proofmill.sources.tables import table
from proofmill.streaming import documents as sd

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


q = lambda s: "'" + s.replace("'", "''") + "'"

# ---- parser
_add("region_lengths", lambda s, d: parsing.regions(corpus(s, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("n_chars")))
_add("parse_nodes", lambda s, d: parsing.nodes(corpus(s, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("max_depth")))
_add("parse_errors", lambda s, d: parsing.parse_errors(corpus(s, d)))
_add("cst_roundtrip", lambda s, d: parsing.round_trip(corpus(s, d)).select("doc_id", "same"), f"SELECT doc_id, TRUE AS same FROM {CORPUS} WHERE text IS NOT NULL")
_add("trust_zones", lambda s, d: parsing.trust_zones(corpus(s, d)))
_add("recovery_points", lambda s, d: parsing.recovery_points(corpus(s, d)))
_add("label_environments", lambda s, d: parsing.labels_by_environment(corpus(s, d)))

# ---- macros: every document gets the same definitions and calls that depend on its number
_MACROS = r"\newcommand{\proof}[2]{(#1: \mark{#2})}\newcommand{\mark}[1]{*#1*}\newcommand{\loopa}{\loopb}\newcommand{\loopb}{\loopa}"


def _with_macros(spark: SparkSession, d: str) -> DataFrame:
    call = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(r"\proof{"), F.abs("doc_id"), F.lit("}{x}"))).otherwise(F.lit(r"\mark{\alpha}"))
    return corpus(spark, d).where("text is not null").select("doc_id", F.concat(F.lit(_MACROS), call).alias("text"))


_CALLS = f"(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '(' || abs(doc_id) || ': *x*)' ELSE '*α*' END AS expanded FROM {CORPUS} WHERE text IS NOT NULL)"
_add("expand_macros", lambda s, d: macros.expand(_with_macros(s, d)).select("doc_id", "expanded", "settled"), f"SELECT doc_id, expanded, TRUE AS settled FROM {_CALLS}")
_add("expand_documents", lambda s, d: macros.expand(corpus(s, d)).select("doc_id", F.length("expanded").alias("n_chars"), "passes", "settled"))
_add("macro_cycles", lambda s, d: macros.macro_cycles(macros.definitions(_with_macros(s, d))), f"SELECT doc_id, unnest(['loopa', 'loopb']) AS name FROM {CORPUS} WHERE text IS NOT NULL")

# ---- edits
_add("fix_edits", lambda s, d: edits.fix_edits(corpus(s, d)).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("n_chars")))
_add("fix_converge", lambda s, d: edits.fix_all(corpus(s, d)).select("doc_id", F.length("fixed").alias("n_chars"), "passes", "n_edits", "ended"))


def _refixed(spark: SparkSession, d: str) -> DataFrame:
    once = edits.fix_all(corpus(spark, d)).where("ended = 'clean'").select("doc_id", F.col("fixed").alias("text"))
    return edits.fix_all(once).groupBy("passes", "ended").agg(F.count(F.lit(1)).alias("n"))


_add("fix_idempotent", _refixed)


def _span_edits(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labeled_documents").select(F.col("labeled_id").alias("doc_id"), F.posexplode("spans").alias("no", "s"))
    return s.select("doc_id", "no", F.col("s.span_start").alias("start"), F.col("s.span_end").alias("end"), F.concat(F.lit("<"), "s.rule_id").alias("replacement"))


_SPANS = "(SELECT labeled_id AS doc_id, unnest(range(len(spans))) AS no, unnest(spans) AS s FROM labeled_documents)"
_add(
    "edit_conflicts",
    lambda s, d: edits.conflicts(_span_edits(s, d)),
    f"WITH e AS (SELECT doc_id, CAST(no AS INT) AS no, s.span_start AS a, s.span_end AS b, '<' || s.rule_id AS r FROM {_SPANS} WHERE s.span_end >= s.span_start) SELECT x.doc_id, x.no AS a, y.no AS b FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.no < y.no WHERE (CASE WHEN x.a = x.b AND y.a = y.b THEN FALSE WHEN x.a = x.b THEN y.a < x.a AND x.a < y.b WHEN y.a = y.b THEN x.a < y.a AND y.a < x.b ELSE x.a < y.b AND y.a < x.b END) AND NOT (x.a = y.a AND x.b = y.b AND x.r IS NOT DISTINCT FROM y.r)",
)
_add("applied_edits", lambda s, d: edits.apply_edits(table(s, d, "labeled_documents").select(F.col("labeled_id").alias("doc_id"), "text"), _span_edits(s, d)).select("doc_id", F.length("edited").alias("n_chars"), "n_made"))
_add(
    "dirty_regions",
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", edits.dirty_region(F.col("text"), F.concat(F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")), F.lit("\x01"), F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1))).alias("x")).select("doc_id", "x.*"),
    "SELECT doc_id, CAST(length(text) // 2 AS INT) AS start, CAST(length(text) // 2 AS INT) AS old_end, CAST(length(text) // 2 + 1 AS INT) AS new_end FROM documents WHERE text IS NOT NULL",
)


# ---- projects: file i takes in file i // 2, every fifth also 2 i + 1, and one file in 40 one that isn't there
def _project(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = lambda c: F.concat(F.lit("p/f"), c.cast("bigint").cast("string"))
    text = F.concat(F.lit(r"\input{"), F.regexp_replace(name(F.floor(i / 2)), "^p/", ""), F.lit("}"), F.when(i % 5 == 0, F.concat(F.lit("\n% \\input{x}\n\\include{"), name(2 * i + 1), F.lit("}"))).otherwise(""), F.when(i % 40 == 0, F.lit(r"\input gone")).otherwise(""))
    return table(spark, d, "documents").select(F.concat(name(i), F.lit(".tex")).alias("path"), text.alias("text")).distinct()


_EDGES = "n AS (SELECT DISTINCT doc_id AS i FROM documents), e AS (SELECT i AS a, i // 2 AS b FROM n WHERE i // 2 IN (SELECT i FROM n) UNION SELECT i, 2 * i + 1 FROM n WHERE i % 5 = 0 AND 2 * i + 1 IN (SELECT i FROM n))"
_WALK = f"WITH RECURSIVE {_EDGES}, w AS (SELECT a AS s, b AS t FROM e UNION SELECT w.s, e.b FROM w JOIN e ON e.a = w.t)"
_NAME = "'p/f' || {} || '.tex'"
_add("include_closure", lambda s, d: projects.include_closure(_project(s, d)), f"{_WALK} SELECT {_NAME.format('s')} AS start, {_NAME.format('t')} AS node FROM w")
_add("include_cycles", lambda s, d: projects.include_cycles(_project(s, d)), f"{_WALK} SELECT DISTINCT {_NAME.format('s')} AS node FROM w WHERE s = t")
_add("unresolved_includes", lambda s, d: projects.resolved_includes(_project(s, d)).where("file is null").select("path", "target"), f"WITH {_EDGES} SELECT {_NAME.format('i')} AS path, 'gone' AS target FROM n WHERE i % 40 = 0 UNION ALL SELECT {_NAME.format('i')}, 'f' || i // 2 FROM n WHERE i // 2 NOT IN (SELECT i FROM n) UNION ALL SELECT {_NAME.format('i')}, 'p/f' || (2 * i + 1) FROM n WHERE i % 5 = 0 AND 2 * i + 1 NOT IN (SELECT i FROM n)")
_add("build_order", lambda s, d: projects.build_order(_project(s, d)))

# ---- readiness
_C = "regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g')"
_add(
    "features_used",
    lambda s, d: readiness.features(corpus(s, d)),
    "SELECT doc_id, h.feature AS feature, h.tier AS tier, h.n AS n FROM (SELECT doc_id, unnest([" + ", ".join(f"{{'feature': {q(k)}, 'tier': {q(t)}, 'n': CAST(len(regexp_extract_all(t, {q(p)})) AS BIGINT)}}" for k, t, p in readiness.FEATURES) + f"]) AS h FROM (SELECT doc_id, {_C} AS t FROM {CORPUS} WHERE text IS NOT NULL)) WHERE h.n > 0",
)
_B = "instr(t, '\\begin{document}')"
_FAULTS = {
    "no document class": "NOT contains(t, '\\documentclass')", "no begin of the document": f"{_B} = 0", "no live end of the document": "NOT contains(t, '\\end{document}')", "package loaded in the body": f"{_B} > 0 AND contains(substr(t, {_B}), '\\usepackage')", "document begun twice": "len(regexp_extract_all(t, '\\\\begin\\{document\\}')) > 1",
    "script upon script": r"regexp_matches(t, '[A-Za-z0-9}](\^[A-Za-z0-9]\^|_[A-Za-z0-9]_|\^\{[^{}]*\}\^|_\{[^{}]*\}_)')", "verbatim broken at a line''s end": r"regexp_matches(t, '(?m)\\verb\|[^|\n]*$')",
}
_add("structural_faults", lambda s, d: readiness.structural_faults(corpus(s, d)), "SELECT doc_id, reason FROM (SELECT doc_id, unnest([" + ", ".join(f"CASE WHEN {w} THEN '{k}' END" for k, w in _FAULTS.items()) + f"]) AS reason FROM (SELECT doc_id, {_C} AS t FROM {CORPUS} WHERE text IS NOT NULL)) WHERE reason IS NOT NULL")


def _ready(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return readiness.ready(docs, findings(docs, [r for r in all_rules() if r.severity == "Error" and r.family in ("DELIM", "ENC", "PRT")]))


_add("not_ready", lambda s, d: readiness.reasons(corpus(s, d)).groupBy("step", "reason").agg(F.count(F.lit(1)).alias("n_docs")))
_add("compile_ready", _ready)

# ---- incremental
_CHUNKS = (
    f"c AS (SELECT doc_id, CAST(unnest(range(len(cs))) AS INT) AS chunk_no, unnest(cs) AS content FROM (SELECT doc_id, list_reduce([[x] FOR x IN string_split(text, chr(10) || chr(10))], lambda a, p: CASE WHEN strlen(a[-1]) < {incremental.LEAST_CHUNK} THEN list_append(a[:-2], a[-1] || chr(10) || chr(10) || p[1]) ELSE list_concat(a, p) END) AS cs FROM documents WHERE length(text) > 0))"
)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return incremental.merged_chunks(table(spark, d, "documents"))


_add("merged_chunks", lambda s, d: _chunks(s, d).select("doc_id", "chunk_no", "start", "length", F.md5("content").alias("digest")), f"WITH {_CHUNKS} SELECT doc_id, chunk_no, CAST(coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start, CAST(length(content) AS INT) AS length, md5(content) AS digest FROM c")
_DEP = (
    _CHUNKS + r", l AS (SELECT DISTINCT doc_id, chunk_no, unnest(regexp_extract_all(content, '\\label\{([^{}]*)\}', 1)) AS k FROM c), r AS (SELECT DISTINCT doc_id, chunk_no, unnest(regexp_extract_all(content, '\\(?:ref|eqref|autoref|cref|Cref)\{([^{}]*)\}', 1)) AS k FROM c), "
    "dep AS (SELECT DISTINCT l.doc_id, l.s AS src, r.chunk_no AS dst FROM (SELECT doc_id, k, max(chunk_no) AS s FROM l GROUP BY ALL) l JOIN r ON r.doc_id = l.doc_id AND r.k = l.k WHERE l.s <> r.chunk_no)"
)
_add("chunk_edges", lambda s, d: incremental.chunk_edges(_chunks(s, d)).where("kind = 'label'").drop("kind"), f"WITH {_DEP} SELECT * FROM dep")
_add(
    "affected_chunks",
    lambda s, d: incremental.affected_chunks(incremental.chunk_edges(_chunks(s, d)).where("kind = 'label'"), _chunks(s, d).where("contains(content, '\\\\label')").select("doc_id", "chunk_no")),
    f"WITH RECURSIVE {_DEP}, a AS (SELECT doc_id, chunk_no FROM c WHERE contains(content, '\\label') UNION SELECT dep.doc_id, dep.dst FROM a JOIN dep ON dep.doc_id = a.doc_id AND dep.src = a.chunk_no) SELECT * FROM a",
)


def _changed_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("A new one. "), "text")).otherwise(F.regexp_replace("text", "^[^.!?]+[.!?]", "")).alias("text"))
    return incremental.sentence_changes(st.simple_sentences(docs), st.simple_sentences(new)).select("doc_id", F.md5("sentence").alias("digest"), "change")


_SENT = "SELECT DISTINCT doc_id, md5(trim(unnest(regexp_extract_all(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[^.!?]+[.!?]')), ' ')) AS digest FROM (SELECT doc_id, {t} AS t FROM documents)"
_add("sentence_changes", _changed_sentences, f"WITH a AS ({_SENT.format(t='text')}), b AS ({_SENT.format(t=chr(67) + 'ASE WHEN doc_id % 4 = 0 THEN ' + q('A new one. ') + ' || text ELSE regexp_replace(text, ' + q('^[^.!?]+[.!?]') + ', ' + q('') + ') END')}) SELECT doc_id, digest, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT doc_id, digest, 'removed' FROM (FROM a EXCEPT FROM b)")


# ---- readers
def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "log_events").withColumn("kind", F.lower(F.trim("kind")))
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    line = (
        F.when(F.col("kind") == "overfull", F.concat(F.lit("Overfull \\"), F.lower("box"), F.lit(" ("), F.format_string("%.2f", "amount_pt"), F.lit("pt too wide) in paragraph at lines "), t("line_start"), F.lit("--"), t("line_end")))
        .when(F.col("kind") == "underfull", F.concat(F.lit("Underfull \\"), F.lower("box"), F.lit(" (badness "), t("badness"), F.lit(") in paragraph at lines "), t("line_start"), F.lit("--"), t("line_end")))
        .when(F.col("kind") == "pagenumber", F.concat(F.lit("["), t("page"), F.lit("]")))
        .when(F.col("kind") == "citationundefined", F.concat(F.lit("LaTeX Warning: Citation `"), F.coalesce("event_key", F.lit("")), F.lit("' on page 1 undefined on input line "), t("line_no")))
        .when(F.col("kind") == "rerunneeded", F.lit("LaTeX Warning: Rerun to get cross-references right."))
    )
    return e.select(F.col("log_file").alias("file"), F.col("seq").alias("line_no"), line.alias("line")).where("line is not null")


_add(
    "parsed_log_lines",
    lambda s, d: files.log_events(_log_lines(s, d)).groupBy("kind", "box").agg(F.count(F.lit(1)).alias("n"), F.sum("page").alias("pages"), F.sum("badness").alias("badness"), F.count_if(F.col("amount_pt") > 10).alias("n_wide")),
    "SELECT CASE k WHEN 'overfull' THEN 'Overfull' WHEN 'underfull' THEN 'Underfull' WHEN 'pagenumber' THEN 'PageNumber' WHEN 'citationundefined' THEN 'CitationUndefined' ELSE 'RerunNeeded' END AS kind, CASE WHEN k IN ('overfull', 'underfull') THEN lower(box) END AS box, count(*) AS n, CAST(sum(CASE WHEN k = 'pagenumber' THEN coalesce(page, 0) END) AS BIGINT) AS pages, CAST(sum(CASE WHEN k = 'underfull' THEN coalesce(badness, 0) END) AS BIGINT) AS badness, count(*) FILTER (k = 'overfull' AND round(amount_pt, 2) > 10) AS n_wide FROM (SELECT *, lower(trim(kind)) AS k FROM log_events) WHERE k IN ('overfull', 'underfull', 'pagenumber', 'citationundefined', 'rerunneeded') AND NOT (k IN ('overfull', 'underfull') AND (box IS NULL OR k = 'overfull' AND amount_pt IS NULL)) GROUP BY ALL",
)


def _aux(spark: SparkSession, d: str) -> DataFrame:
    lab = st.label_events(corpus(spark, d)).where("kind = 'label' and key <> ''")
    return files.aux_labels(lab.select(F.col("doc_id").alias("file"), F.concat(F.lit(r"\newlabel{"), "key", F.lit("}{{"), "pos", F.lit("}{3}{A {b}}{x}{}}")).alias("line")))


_add("aux_labels", lambda s, d: _aux(s, d).select("file", "name", "ref_number", "page_number"), rf"SELECT doc_id AS file, k AS name, CAST(pos AS VARCHAR) AS ref_number, '3' AS page_number FROM (SELECT doc_id, pos, regexp_extract(m, '\{{([^}}]*)\}}', 1) AS k, m FROM (SELECT doc_id, unnest(range(len(ms))) AS pos, unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all(text, '\\(?:label|ref|eqref|autoref|cref|Cref)\{{[^}}]*\}}') AS ms FROM {CORPUS} WHERE text IS NOT NULL))) WHERE starts_with(m, '\label') AND k <> '' AND NOT contains(k, '{{')")


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    h = lambda c, k: F.lpad(F.hex(c.cast("bigint")), k, "0")
    ihdr = F.concat(F.lit("0000000D49484452"), h(F.col("p_partkey"), 8), h(F.col("p_size"), 8), F.lit("08"), F.when(F.col("p_partkey") % 3 == 0, "06").otherwise("02"), F.lit("00000000000000"))
    phys = F.concat(F.lit("0000000970485973"), h(F.col("p_size") * 400, 8), h(F.col("p_size") * 400, 8), F.lit("0100000000"))
    return p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), F.unhex(F.concat(F.lit("89504E470D0A1A0A"), ihdr, phys, F.lit("0000000049454E4400000000"))).alias("content"))


_add("picture_metadata", lambda s, d: binary.file_metadata(_pictures(s, d)).select("path", "format", "width", "height", "transparent", F.round("dpi_x").alias("dpi_x")), "SELECT p_partkey || '.png' AS path, 'png' AS format, CAST(p_partkey AS INT) AS width, p_size AS height, p_partkey % 3 = 0 AS transparent, round(p_size * 400 * 0.0254::DOUBLE) AS dpi_x FROM part")
_add("metadata_findings", lambda s, d: binary.metadata_findings(binary.file_metadata(_pictures(s, d))).groupBy("rule_id").agg(F.sum("n").alias("n")), "SELECT rule_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([{'rule_id': 'FIG-004', 'n': (p_size * 400 * 0.0254::DOUBLE > 300)::INT}, {'rule_id': 'FIG-006', 'n': (p_partkey % 3 = 0)::INT}, {'rule_id': 'COL-002', 'n': 1}], recursive := true) FROM part) GROUP BY rule_id HAVING sum(n) > 0")


# ---- governance
_POLICY = ("profile house", "disable TYPO-018", "severity TYPO-001 Error", "waive TYPO-005 file=*/en/* reason=quoted", "waive TYPO-005 file=*")
_REVIEWS = ("review TYPO-001 acknowledged owner=ann file=*/de/*", "review TYPO-001 resolved owner=bob file=*/en/*")


def _typo(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return findings(docs, [r for r in all_rules() if r.family == "TYPO"]).join(docs.select("doc_id", "path"), "doc_id")


def _lines(spark: SparkSession, rows: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([("-", i, x) for i, x in enumerate(rows, 1)], "file string, line_no int, line string")


_TYPO = f"(SELECT f.*, path FROM ({sql_findings([r for r in all_rules() if r.family == 'TYPO'], CORPUS)}) f JOIN (SELECT doc_id, path FROM {CORPUS}) USING (doc_id))"
_add("policy_findings", lambda s, d: governance.apply_policy(_typo(s, d), governance.policy_lines(_lines(s, _POLICY))).drop("path"), rf"SELECT doc_id, rule_id, CASE WHEN rule_id = 'TYPO-001' THEN 'Error' ELSE severity END AS severity, n, CASE WHEN rule_id = 'TYPO-005' THEN CASE WHEN regexp_matches(coalesce(path, ''), '^.*/en/.*$') THEN 4 ELSE 5 END END AS waived_by FROM {_TYPO} WHERE rule_id <> 'TYPO-018'")
_add("reviewed_findings", lambda s, d: governance.annotate_reviews(_typo(s, d), governance.review_lines(_lines(s, _REVIEWS))).drop("path"), rf"SELECT * FROM (SELECT doc_id, rule_id, severity, n, CASE WHEN rule_id = 'TYPO-001' AND coalesce(path, '') LIKE '%/de/%' THEN 'acknowledged' WHEN rule_id = 'TYPO-001' AND coalesce(path, '') LIKE '%/en/%' THEN 'resolved' ELSE 'new' END AS state, CASE WHEN rule_id = 'TYPO-001' AND coalesce(path, '') LIKE '%/de/%' THEN 'ann' WHEN rule_id = 'TYPO-001' AND coalesce(path, '') LIKE '%/en/%' THEN 'bob' ELSE '-' END AS owner FROM {_TYPO}) WHERE state <> 'resolved'")


def _golden(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "golden_cases").withColumn("f", file_name(F.col("file")))
    seen = table(spark, d, "labeled_documents").select(file_name(F.col("file")).alias("f"), F.explode("rule_ids").alias("rule_id")).distinct()
    return governance.golden_results(cases, cases.select("case_id", "f").join(seen, "f").select("case_id", "rule_id"))


_add(
    "golden_results",
    _golden,
    f"WITH g AS (SELECT case_id, {_FOLD_NAME} AS f, coalesce(expect, []) AS expect, coalesce(forbid, []) AS forbid FROM golden_cases), l AS (SELECT DISTINCT {_FOLD_NAME} AS f, unnest(rule_ids) AS r FROM labeled_documents), got AS (SELECT case_id, list(DISTINCT r) AS got FROM g JOIN l USING (f) GROUP BY case_id), j AS (SELECT g.*, coalesce(got, []) AS got FROM g LEFT JOIN got USING (case_id)) "
    "SELECT case_id, CAST(len(list_distinct(expect)) AS INT) AS n_expected, CAST(len(list_intersect(expect, got)) AS INT) AS n_found, CAST(len(list_intersect(forbid, got)) AS INT) AS n_forbidden, len(list_intersect(expect, got)) = len(list_distinct(expect)) AND len(list_intersect(forbid, got)) = 0 AS passed FROM j",
)

# ---- learning
_add("averaged_metrics", lambda s, d: learning.averaged_metrics(fo.span_metrics(table(s, d, "labeled_documents"))), f"SELECT round(sum(tp) / sum(tp + fp), 4) AS micro_precision, round(sum(tp) / sum(tp + fn), 4) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 4) AS micro_f1, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 4) AS macro_f1 FROM ({RELATION_ORACLES['span_metrics']})")
_add("text_windows", lambda s, d: learning.text_windows(corpus(s, d)).select("doc_id", "window_no", "start", F.md5("window").alias("digest")), f"SELECT doc_id, CAST(w AS INT) AS window_no, CAST(w * 150 AS INT) AS start, md5(substr(text, w * 150 + 1, 300)) AS digest FROM (SELECT doc_id, text, unnest(range(greatest(0, length(text) - 151) // 150 + 1)) AS w FROM {CORPUS} WHERE length(text) > 0)")
_add("candidate_splits", lambda s, d: learning.stratified_split(table(s, d, "candidates").select("candidate_id", "rule_id"), "rule_id", "candidate_id").groupBy("rule_id", "split").agg(F.count(F.lit(1)).alias("n")))
_add("event_percentiles", lambda s, d: learning.latency_percentiles(table(s, d, "events"), "event_type", "value").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "p999"))), "SELECT event_type, count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {x}), 6) AS {c}" for c, x in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))) + " FROM events GROUP BY event_type")


def _rebuilt_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labeled_documents").where("text is not null and bio_tags is not null and spans is not null")
    tagged = rows.select("labeled_id", "bio_tags", learning.bio_tags(F.length("text"), F.col("spans")).alias("again"))
    return learning.tag_confusion(tagged.withColumns({c: F.transform(c, lambda t: F.substr(t, F.lit(1), F.lit(1))) for c in ("bio_tags", "again")}), "bio_tags", "again")


_add("tag_confusion", _rebuilt_tags)


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = learning.stratified_split(learning.candidate_vectors(table(spark, d, "candidates")), "rule_id", "candidate_id", (("train", 0.8), ("test", 0.2)))
    model = learning.baseline(rows.where("split = 'train'"))
    hits = learning.judged(model, rows.where("split = 'test'"))
    tp, fp, fn = (F.count_if(c).alias(k) for k, c in (("tp", (F.col("label") == 1) & (F.col("predicted") == 1)), ("fp", (F.col("label") == 0) & (F.col("predicted") == 1)), ("fn", (F.col("label") == 1) & (F.col("predicted") == 0))))
    return learning.averaged_metrics(hits.groupBy("rule_id").agg(tp, fp, fn))


_add("candidate_baseline", _baseline)

# ---- streams
_add("event_sliding", lambda s, d: sd.event_counts(table(s, d, "events"), "1 hour", "30 minutes").select(F.unix_timestamp("start").alias("start"), "event_type", "n"), "SELECT CAST(s AS BIGINT) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800]) AS s FROM events) GROUP BY ALL")
_add("event_sessions", lambda s, d: sd.sessions(table(s, d, "events")).select("user_id", *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("start", "end")), "n"), "WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS new FROM e)) SELECT user_id, min(t) AS start, max(t) + 1800000000 AS \"end\", count(*) AS n FROM g GROUP BY user_id, s")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The documents read as a stream of files, linted as they come, and the findings read back."""
    path, out = f"{d.rstrip('/')}/documents.parquet", f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        docs = reader.option("pathGlobFilter", "documents.parquet").parquet(d)
    else:
        docs = reader.parquet(path)
    found = sd.streamed_findings(docs.select("doc_id", "text", "lang"), [r for r in all_rules() if r.family == "TYPO"])
    found.writeStream.format("parquet").option("checkpointLocation", f"{out}/at").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


_add("streamed_lint", _streamed, sql_findings([r for r in all_rules() if r.family == "TYPO"], "documents"))


# ---- relations of packages, labels and commands
def _repeated_packages(spark: SparkSession, d: str) -> DataFrame:
    return st.packages(corpus(spark, d)).groupBy("doc_id", "package").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_PK = f"SELECT doc_id, CAST(pos AS INT) AS pos, trim(unnest(string_split(regexp_extract(m, '\\{{([^}}]*)\\}}', 1), ','))) AS package FROM (SELECT doc_id, unnest(range(len(ms))) AS pos, unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all(text, '\\\\usepackage(?:\\[[^\\]]*\\])?\\{{[^}}]*\\}}') AS ms FROM {CORPUS} WHERE text IS NOT NULL))"
_add("repeated_packages", _repeated_packages, f"SELECT doc_id, package, count(*) AS n FROM ({_PK}) GROUP BY ALL HAVING count(*) > 1")


def _package_order(spark: SparkSession, d: str) -> DataFrame:
    p = st.packages(corpus(spark, d))
    first = lambda name, c: p.where(F.col("package") == name).groupBy("doc_id").agg(F.min("pos").alias(c))
    return first("hyperref", "a").join(p.select("doc_id", "pos", "package"), "doc_id").where("pos > a and package <> 'cleveref'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_after"))


_add("packages_after_hyperref", _package_order, f"WITH p AS ({_PK}), h AS (SELECT doc_id, min(pos) AS a FROM p WHERE package = 'hyperref' GROUP BY doc_id) SELECT p.doc_id, count(*) AS n_after FROM p JOIN h USING (doc_id) WHERE pos > a AND package <> 'cleveref' GROUP BY p.doc_id")
#: Older commands with what replaces them. Fixed values.
_PAIRS = (("bf", "textbf"), ("it", "textit"), ("tt", "texttt"), ("em", "emph"), ("sc", "textsc"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).where("text is not null")
    has = lambda c: F.regexp_like("text", F.lit(rf"\\{c}([^A-Za-z]|$)"))
    pairs = F.array(*(F.when(has(a) & has(b), F.lit(a)) for a, b in _PAIRS))
    return docs.select("doc_id", F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("older"))


_add("mixed_commands", _mixed, "SELECT doc_id, older FROM (SELECT doc_id, unnest([" + ", ".join(rf"CASE WHEN regexp_matches(text, '\\{a}([^A-Za-z]|$)') AND regexp_matches(text, '\\{b}([^A-Za-z]|$)') THEN '{a}' END" for a, b in _PAIRS) + f"]) AS older FROM {CORPUS} WHERE text IS NOT NULL) WHERE older IS NOT NULL")
_add("label_prefixes", lambda s, d: st.label_events(corpus(s, d)).where("kind = 'label'").groupBy(F.regexp_extract("key", "^[^:]*:", 0).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("key").rlike("[A-Z]")).alias("n_upper"), F.count_if(F.col("key").contains(" ")).alias("n_blank")), rf"SELECT regexp_extract(k, '^[^:]*:') AS prefix, count(*) AS n, count(*) FILTER (regexp_matches(k, '[A-Z]')) AS n_upper, count(*) FILTER (contains(k, ' ')) AS n_blank FROM (SELECT unnest(regexp_extract_all(text, '\\label\{{([^}}]*)\}}', 1)) AS k FROM {CORPUS} WHERE text IS NOT NULL) GROUP BY ALL")
_add("repeated_citations", lambda s, d: corpus(s, d).where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\\cite[tp]?(?:\[[^\]]*\])?\{([^}]*)\}"), F.lit(1))).alias("l")).select("doc_id", F.explode(F.split("l", ",")).alias("k")).groupBy("doc_id", F.trim("k").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rf"SELECT doc_id, trim(k) AS key, count(*) AS n FROM (SELECT doc_id, unnest(string_split(l, ',')) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\cite[tp]?(?:\[[^\]]*\])?\{{([^}}]*)\}}', 1)) AS l FROM {CORPUS} WHERE text IS NOT NULL)) GROUP BY ALL HAVING count(*) > 1")
