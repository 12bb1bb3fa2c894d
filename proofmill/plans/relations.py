"""Queries on the structure of documents and on findings, each with SQL that states it independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators import findings as fo
from proofmill.operators import structure as st
from proofmill.plans.corpus import CORPUS, corpus
from proofmill.plans.registry import findings, sql_findings
from proofmill.sources.tables import table

#: ``functions.paths.file_name`` of a column named file, in SQL.
_FOLD_NAME = r"(CASE WHEN replace(file, '\', '/') LIKE '/%' THEN '/' ELSE '' END) || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split(regexp_replace(replace(file, '\', '/'), '@[0-9]+-[0-9]+$', ''), '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x])), lambda a, b: CASE WHEN b[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:-2] WHEN b[1] = '..' AND replace(file, '\', '/') LIKE '/%' THEN a ELSE list_concat(a, b) END), '/')"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str) -> None:
    QUERIES[name] = build
    ORACLES[name] = sql


def _ev(pattern: str, text: str = "text") -> str:
    return f"SELECT doc_id, unnest(range(len(ms))) AS pos, unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS ms FROM {CORPUS} WHERE text IS NOT NULL)"


_KEY = r"regexp_extract(m, '\{([^}]*)\}', 1)"
_LABELS = rf"ev AS (SELECT doc_id, pos, CASE WHEN starts_with(m, '\label') THEN 'label' ELSE 'ref' END AS kind, {_KEY} AS k FROM (" + _ev(r"\\(?:label|ref|eqref|autoref|cref|Cref)\{[^}]*\}") + "))"

_add("undefined_refs", lambda s, d: st.undefined_references(corpus(s, d)), f"WITH {_LABELS} SELECT DISTINCT doc_id, k AS key FROM ev r WHERE kind = 'ref' AND NOT EXISTS (SELECT 1 FROM ev l WHERE l.kind = 'label' AND l.doc_id = r.doc_id AND l.k = r.k)")
_add("duplicate_labels", lambda s, d: st.duplicate_labels(corpus(s, d)), f"WITH {_LABELS} SELECT doc_id, k AS key, count(*) AS n FROM ev WHERE kind = 'label' GROUP BY ALL HAVING count(*) > 1")
_add("forward_refs", lambda s, d: st.forward_references(corpus(s, d)), f"WITH {_LABELS}, l AS (SELECT doc_id, k, max(pos) AS p FROM ev WHERE kind = 'label' GROUP BY ALL) SELECT DISTINCT ev.doc_id, ev.k AS key FROM ev JOIN l USING (doc_id, k) WHERE kind = 'ref' AND pos < p")
_add("shared_labels", lambda s, d: st.shared_labels(corpus(s, d)), f"WITH {_LABELS} SELECT k AS key, count(DISTINCT doc_id) AS n_docs FROM ev WHERE kind = 'label' GROUP BY k HAVING count(DISTINCT doc_id) > 1")

_PER = f"WITH {_LABELS}, per AS (SELECT doc_id, k, count(*) FILTER (kind = 'label') AS nl, count(*) FILTER (kind = 'ref') AS nr, max(CASE WHEN kind = 'label' THEN pos END) AS lp, min(CASE WHEN kind = 'ref' THEN pos END) AS rp FROM ev GROUP BY ALL)"
_LABEL_RULES = {
    "REF-001": "(nr > 0 AND nl = 0)::INT", "REF-002": "greatest(nl - 1, 0)", "REF-003": "(nl > 0 AND contains(k, ' '))::INT", "REF-004": "(nl > 0 AND regexp_matches(k, '[A-Z]'))::INT", "REF-005": "(nl > 0 AND NOT regexp_matches(k, '^(" + "|".join(st.PREFIXES) + ")'))::INT", "REF-009": "coalesce(nl > 0 AND rp < lp, FALSE)::INT",
    "MATH-023": "(nr > 0 AND nl = 0 AND starts_with(k, 'eq:'))::INT", "MATH-024": "(nl > 0 AND nr = 0 AND starts_with(k, 'eq:'))::INT", "FIG-012": "(nl > 0 AND nr = 0 AND starts_with(k, 'fig:'))::INT",
}
_add("label_rules", lambda s, d: st.label_rules(corpus(s, d)), _PER + ", u AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, {c} AS n FROM per" for r, c in _LABEL_RULES.items()) + ") SELECT doc_id, rule_id, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL HAVING sum(n) > 0")

_BE = _ev(r"\\(?:begin|end)\{[^}]*\}")
_add(
    "environment_depth",
    lambda s, d: st.environment_depth(corpus(s, d)),
    rf"WITH e AS (SELECT doc_id, pos, CASE WHEN starts_with(m, '\begin') THEN 1 ELSE -1 END AS step FROM ({_BE})), r AS (SELECT doc_id, step, sum(step) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM e) SELECT doc_id, count(*) FILTER (step = 1) AS n_environments, CAST(max(depth) AS BIGINT) AS max_depth, CAST(min(depth) AS BIGINT) AS min_depth, CAST(sum(step) AS BIGINT) AS final_depth FROM r GROUP BY doc_id",
)
_add("environments", lambda s, d: st.environments(corpus(s, d)), rf"SELECT {_KEY} AS environment, count(*) FILTER (starts_with(m, '\begin')) AS n_begin, count(*) FILTER (starts_with(m, '\end')) AS n_end, count(DISTINCT doc_id) AS n_docs FROM ({_BE}) GROUP BY ALL")
_add("packages", lambda s, d: st.packages(corpus(s, d)), f"SELECT doc_id, CAST(pos AS INT) AS pos, trim(unnest(string_split({_KEY}, ','))) AS package FROM (" + _ev(r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\}") + ")")
_add("command_counts", lambda s, d: st.command_counts(corpus(s, d)), "SELECT m AS command, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (" + _ev(r"\\[A-Za-z]+") + ") GROUP BY m")
_add(
    "brace_balance",
    lambda s, d: st.brace_balance(corpus(s, d)),
    "WITH e AS (" + _ev("[{}]", r"regexp_replace(text, '\\[{}\\]', '', 'g')") + "), r AS (SELECT doc_id, m, sum(CASE WHEN m = '{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM e) SELECT doc_id, count(*) FILTER (m = '{') AS n_open, count(*) FILTER (m = '}') AS n_close, CAST(min(depth) AS BIGINT) AS lowest FROM r GROUP BY doc_id HAVING count(*) FILTER (m = '{') <> count(*) FILTER (m = '}') OR min(depth) < 0",
)
_add(
    "token_kinds",
    lambda s, d: st.tokens(corpus(s, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")),
    r"""SELECT doc_id, CASE WHEN starts_with(m, '\') THEN 'command' WHEN regexp_matches(m, '^[A-Za-z0-9]') THEN 'word' WHEN regexp_matches(m, '^[ \t]') THEN 'space' WHEN m IN (chr(10), chr(13) || chr(10)) THEN 'newline' WHEN m IN ('{', '[', '(') THEN 'open' WHEN m IN ('}', ']', ')') THEN 'close' WHEN m IN ('''', '"', '`') THEN 'quote' ELSE 'symbol' END AS kind, count(*) AS n FROM ("""
    + _ev(r"\\[A-Za-z0-9]+|\\.|[A-Za-z0-9]+|[ \t]+|\r?\n|[^A-Za-z0-9 \t\n\\]")
    + ") GROUP BY ALL",
)
_add(
    "headings",
    lambda s, d: st.headings(corpus(s, d)),
    r"WITH h AS (SELECT doc_id, pos, CASE regexp_extract(m, '^\\([a-z]+)', 1) WHEN 'chapter' THEN 0 WHEN 'section' THEN 1 WHEN 'subsection' THEN 2 WHEN 'subsubsection' THEN 3 ELSE 4 END AS level, " + _KEY + " AS title FROM (" + _ev(r"\\(?:chapter|section|subsection|subsubsection|paragraph)\*?\{[^}]*\}") + ")), p AS (SELECT *, CASE WHEN level <= 1 THEN -1 ELSE coalesce(max(CASE WHEN level <= 1 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS parent, coalesce(level > lag(level) OVER (PARTITION BY doc_id ORDER BY pos) + 1, false) AS skip FROM h) SELECT doc_id, CAST(pos AS INT) AS pos, level, title, CAST(row_number() OVER (PARTITION BY doc_id, parent, level ORDER BY pos) AS INT) AS number, skip FROM p",
)
_add(
    "repeated_openings",
    lambda s, d: st.repeated_openings(corpus(s, d)),
    "WITH s AS (" + _ev("[^.!?]+[.!?]", r"regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')") + "), w AS (SELECT doc_id, pos, lower(regexp_extract(trim(m, ' '), '^([A-Za-z]+)', 1)) AS w FROM s), l AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w) SELECT doc_id, count(*) AS n FROM l WHERE w <> '' AND w = b GROUP BY doc_id",
)
_add(
    "paragraphs",
    lambda s, d: st.paragraphs(corpus(s, d)),
    rf"WITH p AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS p FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM {CORPUS} WHERE text IS NOT NULL)) SELECT * FROM (SELECT doc_id, CAST(pos AS INT) AS pos, CAST(length(p) AS INT) AS n_chars, CAST(len(list_filter(regexp_split_to_array(p, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS INT) AS n_words, CAST(coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p) WHERE n_words > 0",
)
_add(
    "tiers",
    lambda s, d: st.tier(corpus(s, d)),
    rf"SELECT doc_id, CASE WHEN regexp_matches(text, '\\(immediate)?\\?write18|\\ShellEscape|\\catcode|\\scantokens|\\detokenize|\\csstring|\\openout[0-9\\]|\\(directlua|latelua|luaexec)') THEN 'Foreign' WHEN regexp_matches(text, '\\(def|edef|gdef|xdef|let|futurelet|makeatletter|csname|ifnum|ifdim|ifx|ifodd|if|expandafter)[^A-Za-z]') THEN 'Extended' ELSE 'Core' END AS tier FROM {CORPUS} WHERE text IS NOT NULL",
)
_add(
    "script_languages",
    lambda s, d: st.script_language(corpus(s, d)),
    r"SELECT doc_id, CASE WHEN b <> '' THEN b WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\x{AC00}-\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'zh' WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'ar' WHEN regexp_matches(text, '[\x{0590}-\x{05FF}]') THEN 'he' WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') THEN 'hi' WHEN regexp_matches(text, '[\x{0E00}-\x{0E7F}]') THEN 'th' WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') THEN 'ru' ELSE 'en' END AS detected FROM (SELECT *, trim(string_split(regexp_extract(text, '\\usepackage\[([^\]]*)\]\{babel\}', 1), ',')[-1]) AS b FROM " + CORPUS + " WHERE text IS NOT NULL)",
)

_FIND = f"({sql_findings(None, CORPUS)})"
_RANK = "CASE {c} WHEN 'Error' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END"
_RESOLVED = (
    f"f AS MATERIALIZED {_FIND}, p(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in fo.CONFLICTS) + "), g AS MATERIALIZED (SELECT * FROM f WHERE rule_id IN (SELECT a FROM p UNION SELECT b FROM p)), m AS (SELECT x.doc_id, p.a, p.b, " + _RANK.format(c="x.severity") + " AS ra, " + _RANK.format(c="y.severity") + " AS rb, x.n AS na, y.n AS nb FROM g x JOIN g y ON y.doc_id = x.doc_id JOIN p ON x.rule_id = p.a AND y.rule_id = p.b), "
    "lost AS (SELECT DISTINCT doc_id, CASE WHEN ra > rb OR ra = rb AND (na < nb OR na = nb AND a < b) THEN b ELSE a END AS rule_id FROM m), res AS (SELECT f.* FROM f ANTI JOIN lost ON f.doc_id = lost.doc_id AND f.rule_id = lost.rule_id)"
)
_CONF = "CASE WHEN split_part(rule_id, '-', 1) IN ('TYPO', 'ENC', 'CHAR', 'SPC', 'STRUCT', 'SYS') THEN 'High' WHEN split_part(rule_id, '-', 1) IN ('STYLE', 'LANG') THEN 'Low' ELSE 'Medium' END"
_add("resolved_findings", lambda s, d: fo.resolve_conflicts(findings(corpus(s, d))), f"WITH {_RESOLVED} SELECT doc_id, rule_id, severity, n FROM res")
_add("scored_findings", lambda s, d: fo.score(fo.resolve_conflicts(findings(corpus(s, d))), 0.5), f"WITH {_RESOLVED} SELECT doc_id, rule_id, severity, n, {_CONF} AS confidence, CASE {_CONF} WHEN 'High' THEN 1.0::DOUBLE WHEN 'Medium' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM res WHERE {_CONF} <> 'Low'")
_add(
    "report_grouping_sets",
    lambda s, d: fo.report(findings(corpus(s, d)).join(corpus(s, d).select("doc_id", "source"), "doc_id")),
    f"SELECT rule_id, severity, source, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT f.doc_id) AS n_docs FROM {_FIND} f JOIN {CORPUS} USING (doc_id) GROUP BY GROUPING SETS ((rule_id), (severity), (source), ())",
)
WAIVERS = [(1, "TYPO-018", "slides_src/*"), (2, "TYPO-018", "00000?0.tex"), (3, "SPC-001", "*/en/*")]
_add(
    "waived_findings",
    lambda s, d: fo.waive(findings(corpus(s, d)).join(corpus(s, d).select("doc_id", "path"), "doc_id"), fo.waiver_frame(s, WAIVERS)).drop("path"),
    rf"WITH w(no, r, g) AS (VALUES (1, 'TYPO-018', '^slides_src/.*$'), (2, 'TYPO-018', '^00000.0\.tex$'), (3, 'SPC-001', '^.*/en/.*$')), f AS (SELECT * FROM {_FIND} JOIN (SELECT doc_id, path FROM {CORPUS}) USING (doc_id)) SELECT f.doc_id, f.rule_id, f.severity, f.n, CAST(min(w.no) AS INT) AS waiver FROM f LEFT JOIN w ON w.r = f.rule_id AND (regexp_matches(coalesce(path, ''), w.g) OR regexp_matches(regexp_extract(coalesce(path, ''), '([^/]*)$', 1), w.g)) GROUP BY ALL",
)

_LOG = "WITH e AS (SELECT DISTINCT log_file, seq, lower(trim(kind)) AS kind, box, amount_pt, badness, line_start, line_end, page, line_no, event_key, message FROM log_events) SELECT log_file, count(*) FILTER (kind = 'overfull' AND lower(box) = 'hbox') AS n_overfull_hbox, count(*) FILTER (kind = 'overfull' AND lower(box) = 'vbox') AS n_overfull_vbox, count(*) FILTER (kind = 'underfull' AND lower(box) = 'vbox') AS n_underfull_vbox, greatest(coalesce(max(amount_pt) FILTER (kind = 'overfull'), 0), 0) AS max_overfull_pt, coalesce(bool_or(kind = 'widowpenalty'), false) AS has_widows, coalesce(bool_or(kind = 'clubpenalty'), false) AS has_orphans, coalesce(bool_or(kind = 'rerunneeded'), false) AS has_rerun, count(DISTINCT event_key) FILTER (kind = 'citationundefined') AS n_undefined_citations, count(*) FILTER (kind = 'fontsubstitution') AS n_font_substitutions, count(*) FILTER (kind = 'floatwarning') AS n_float_warnings FROM e GROUP BY log_file"
_LOG_RULES = {
    "LAY-001": "CASE WHEN max_overfull_pt > 2 THEN n_overfull_hbox ELSE 0 END", "LAY-002": "has_widows::BIGINT + has_orphans::BIGINT", "LAY-004": "(max_overfull_pt > 10)::BIGINT", "LAY-006": "n_float_warnings", "LAY-009": "n_underfull_vbox", "LAY-017": "has_widows::BIGINT", "LAY-018": "n_underfull_vbox",
    "LAY-021": "n_overfull_vbox", "LAY-025": "has_rerun::BIGINT", "LAY-026": "n_undefined_citations", "LAY-027": "n_font_substitutions", "FIG-020": "(max_overfull_pt > 0)::BIGINT", "MATH-026": "(max_overfull_pt > 0)::BIGINT", "MATH-027": "(max_overfull_pt > 5)::BIGINT",
}
_add("log_summary", lambda s, d: fo.log_summary(table(s, d, "log_events")), _LOG)
_add("log_findings", lambda s, d: fo.log_findings(fo.log_summary(table(s, d, "log_events"))), "SELECT log_file, h.rule_id AS rule_id, h.n AS n FROM (SELECT log_file, unnest([" + ", ".join(f"{{'rule_id': '{k}', 'n': {v}}}" for k, v in _LOG_RULES.items()) + f"]) AS h FROM ({_LOG})) WHERE h.n > 0")
_add(
    "span_metrics",
    lambda s, d: fo.span_metrics(table(s, d, "labeled_documents")),
    "WITH g AS (SELECT DISTINCT labeled_id, s.rule_id AS rule_id, s.span_start AS a, s.span_end AS b FROM (SELECT labeled_id, unnest(spans) AS s FROM labeled_documents)), t AS (SELECT labeled_id, unnest(range(len(bio_tags))) AS pos, unnest(bio_tags) AS tag FROM labeled_documents), o AS (SELECT labeled_id, pos, tag[1] AS b, tag[3:] AS rule_id FROM t WHERE tag <> 'O'), "
    "n AS (SELECT *, coalesce(b = 'B' OR lag(pos) OVER w <> pos - 1 OR lag(rule_id) OVER w <> rule_id, true) AS new FROM o WINDOW w AS (PARTITION BY labeled_id ORDER BY pos)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY labeled_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM n), sp AS (SELECT DISTINCT labeled_id, rule_id, a, b FROM (SELECT labeled_id, grp, rule_id, min(pos) AS a, max(pos) + 1 AS b FROM r GROUP BY ALL)), "
    "m AS (SELECT coalesce(g.rule_id, sp.rule_id) AS rule_id, count(*) FILTER (g.rule_id IS NOT NULL AND sp.rule_id IS NOT NULL) AS tp, count(*) FILTER (g.rule_id IS NULL) AS fp, count(*) FILTER (sp.rule_id IS NULL) AS fn FROM g FULL JOIN sp ON g.labeled_id = sp.labeled_id AND g.rule_id = sp.rule_id AND g.a = sp.a AND g.b = sp.b GROUP BY 1) "
    "SELECT rule_id, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM m",
)


def _edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents after an edit: every fifth gains a sentence at its end, every seventh of the others a paragraph."""
    t, i = F.col("text"), F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(i % 5 == 0, F.concat(t, F.lit(" One more."))).when(i % 7 == 0, F.concat(t, F.lit("\n\nOne more."))).otherwise(t).alias("text"))


_CH = "SELECT doc_id, unnest(range(len(cs))) AS chunk_no, md5(unnest(cs)) AS h FROM (SELECT doc_id, string_split({t}, chr(10) || chr(10)) AS cs FROM documents WHERE text IS NOT NULL)"
_NEW = "CASE WHEN doc_id % 5 = 0 THEN text || ' One more.' WHEN doc_id % 7 = 0 THEN text || chr(10) || chr(10) || 'One more.' ELSE text END"
_add(
    "dirty_chunks",
    lambda s, d: fo.dirty_chunks(fo.chunks(table(s, d, "documents")), fo.chunks(_edited(s, d))),
    f"WITH a AS ({_CH.format(t='text')}), b AS ({_CH.format(t=_NEW)}), na AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1) SELECT b.doc_id, CAST(b.chunk_no AS INT) AS chunk_no FROM b LEFT JOIN a ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no JOIN nb ON nb.doc_id = b.doc_id LEFT JOIN na ON na.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h OR na.n IS DISTINCT FROM nb.n",
)


def _candidate_report(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").withColumn("rule_id", F.upper(F.trim("rule_id")))
    per = c.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if("in_math").alias("n_math"), F.max("env_depth").alias("max_depth"))
    return per.join(table(spark, d, "rules").select("rule_id", "default_severity", "rule_layer"), "rule_id", "left")


_add(
    "candidate_report",
    _candidate_report,
    "SELECT c.rule_id, n, n_positive, n_math, max_depth, default_severity, rule_layer FROM (SELECT upper(trim(rule_id)) AS rule_id, count(*) AS n, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (in_math) AS n_math, max(env_depth) AS max_depth FROM candidates GROUP BY 1) c LEFT JOIN rules r ON r.rule_id = c.rule_id",
)
_add(
    "event_windows",
    lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("hour", F.unix_timestamp("hour")),
    "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
)
