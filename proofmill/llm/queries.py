"""Queries of the training-text operators, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.paths import file_name
from proofmill.llm import encoding, frequency, leakage, neardup, overlap, packing, pieces, sentences, splits
from proofmill.session import staged
from proofmill.sources.tables import table

LABELED, CANDIDATES, DOCUMENTS, EVAL = "labeled_documents", "candidates", "documents", "eval_items"


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    labeled, cand = table(spark, d, LABELED), table(spark, d, CANDIDATES)
    model = encoding.train(labeled.select("text"))
    a = encoding.garbled_texts(labeled, "labeled_id", "text", model).select(F.lit(LABELED).alias("table_name"), "record_id", "restored", "chains")
    return a.union(encoding.garbled_bytes(cand, "candidate_id", "bytes", model).select(F.lit(CANDIDATES), "record_id", "restored", "chains"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("table_name", "record_id").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(table(spark, d, LABELED), "labeled_id", "text", threshold=0.7, width=3)
    return pairs.select(F.col("id_a").alias("labeled_id_a"), F.col("id_b").alias("labeled_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, LABELED), "labeled_id", "text", threshold=0.7, width=3).withColumnRenamed("id", "labeled_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(table(spark, d, LABELED))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_pieces(table(spark, d, LABELED)).drop("longest_run")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_overlaps(table(spark, d, LABELED), "labeled_id", "text", "split_name")
    return pairs.select(F.least("held_id", "train_id").alias("labeled_id_a"), F.greatest("held_id", "train_id").alias("labeled_id_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, LABELED), "labeled_id", "text", "split_name", "file")


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    terms = {"rule_id": F.upper(F.trim(F.col("rule_id"))), "label": F.col("label").cast("string")}
    return frequency.term_frequencies(table(spark, d, CANDIDATES), terms, file_name(F.col("file")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_terms(_frequencies(spark, d))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).drop("share_of_files")


def _groups(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return splits.file_and_rule_groups(table(spark, d, LABELED), table(spark, d, CANDIDATES), file_name(F.col("file")))


def _splits(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    # staged, as every group is to be placed whatever a query takes of it
    return {k: staged(splits.grouped_splits(v), f"{k}-splits") for k, v in _groups(spark, d).items()}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    one = {k: splits.broken_groups(v).select(F.lit(k).alias("entity_kind"), "entity_key") for k, v in _splits(spark, d).items()}
    return one["file"].union(one["rule"])


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    one = {k: v.select(F.lit(k).alias("entity_kind"), "entity_key", "n_rows", "split_name") for k, v in _splits(spark, d).items()}
    return one["file"].union(one["rule"])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, DOCUMENTS))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, DOCUMENTS), table(spark, d, EVAL))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, DOCUMENTS), table(spark, d, EVAL))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, DOCUMENTS)
    return sentences.split_sentences(docs, sentences.train(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_groups, p3_found, p3_pieces, p4_found, p4_report, p5_found, p5_terms, p6_found, p6_splits, p7_containers, p8_found, p8_spans, p9_found)}

_PARTS = r"list_filter(string_split(regexp_replace(replace({c}, '\', '/'), '@[0-9]+-[0-9]+$', ''), '/'), lambda x: x <> '' AND x <> '.')"
_FOLD = r"(CASE WHEN replace({c}, '\', '/') LIKE '/%' THEN '/' ELSE '' END) || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({p}, lambda x: [x])), lambda a, b: CASE WHEN b[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:-2] WHEN b[1] = '..' AND replace({c}, '\', '/') LIKE '/%' THEN a ELSE list_concat(a, b) END), '/')"


def _sql_name(column: str) -> str:
    return _FOLD.format(c=column, p=_PARTS.format(c=column))


_RUNS = r"""words AS (SELECT labeled_id, split_name, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM labeled_documents WHERE length(text) > 0),
runs AS (SELECT DISTINCT labeled_id, split_name, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS r FROM words, LATERAL unnest(range(1, len(w) - 1)) AS u(k)),
sizes AS (SELECT labeled_id, count(*) AS n FROM runs GROUP BY labeled_id)"""

ORACLES = {
    "p2_found": f"""WITH {_RUNS}
SELECT x.labeled_id AS labeled_id_a, y.labeled_id AS labeled_id_b FROM runs x JOIN runs y ON x.r = y.r AND x.labeled_id < y.labeled_id
JOIN sizes s ON s.labeled_id = x.labeled_id JOIN sizes t ON t.labeled_id = y.labeled_id
GROUP BY x.labeled_id, y.labeled_id, s.n, t.n HAVING count(*) / (s.n + t.n - count(*)) >= 0.7""",
    "p3_found": r"""SELECT DISTINCT labeled_id, unnest(list_filter([CASE WHEN length(text) > 2400 THEN 'oversized' END, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: length(x))) > 2400 THEN 'long_run' END], lambda k: k IS NOT NULL)) AS kind FROM labeled_documents WHERE text IS NOT NULL""",
    "p4_found": f"""WITH {_RUNS}
SELECT DISTINCT least(x.labeled_id, y.labeled_id) AS labeled_id_a, greatest(x.labeled_id, y.labeled_id) AS labeled_id_b FROM runs x JOIN runs y ON x.r = y.r AND x.split_name IN ('dev', 'test') AND y.split_name = 'train'
JOIN sizes s ON s.labeled_id = x.labeled_id GROUP BY x.labeled_id, y.labeled_id, s.n HAVING count(*) / s.n >= 0.8""",
    "p5_found": f"""WITH c AS (SELECT upper(trim(rule_id)) AS rule_id, CAST(label AS VARCHAR) AS label, {_sql_name("file")} AS f FROM candidates),
long AS (SELECT 'rule_id' AS field_name, rule_id AS term, f FROM c UNION ALL SELECT 'label', label, f FROM c),
t AS (SELECT field_name, term, count(DISTINCT f) AS n FROM long WHERE term IS NOT NULL GROUP BY ALL)
SELECT field_name, term, 'rare' AS mark FROM t WHERE n < 4 UNION ALL SELECT field_name, term, 'common' FROM t WHERE n > 0.25 * (SELECT count(DISTINCT f) FROM c)""",
    "p5_terms": f"""WITH c AS (SELECT upper(trim(rule_id)) AS rule_id, CAST(label AS VARCHAR) AS label, {_sql_name("file")} AS f FROM candidates),
long AS (SELECT 'rule_id' AS field_name, rule_id AS term, f FROM c UNION ALL SELECT 'label', label, f FROM c)
SELECT field_name, term, count(*) AS n_rows, count(DISTINCT f) AS n_files, count(DISTINCT f) < 4 AS is_rare, count(DISTINCT f) > 0.25 * (SELECT count(DISTINCT f) FROM c) AS is_common FROM long WHERE term IS NOT NULL GROUP BY field_name, term""",
    "p6_found": f"""SELECT 'file' AS entity_kind, f AS entity_key FROM (SELECT {_sql_name("file")} AS f, split_name FROM labeled_documents) WHERE f IS NOT NULL GROUP BY f HAVING count(DISTINCT split_name) > 1
UNION ALL SELECT 'rule', r FROM (SELECT upper(trim(rule_id)) AS r, rule_fold FROM candidates) WHERE r IS NOT NULL GROUP BY r HAVING count(DISTINCT rule_fold) > 1""",
    "p8_found": r"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dp AS (SELECT id, array_to_string(w[k:k + 11], ' ') AS p FROM d, LATERAL unnest(range(1, len(w) - 10)) AS u(k)),
ep AS (SELECT id, array_to_string(w[k:k + 11], ' ') AS p FROM e, LATERAL unnest(range(1, len(w) - 10)) AS u(k))
SELECT DISTINCT dp.id AS doc_id, ep.id AS item_id FROM dp JOIN ep ON dp.p = ep.p""",
}
