"""What happens to findings: conflicts, scores, waivers, reports, metrics, incremental chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.session import staged

#: Pairs of rules that exclude each other, and confidence by family. Fixed values.
CONFLICTS = (("TYPO-001", "TYPO-004"), ("TYPO-002", "TYPO-003"), ("TYPO-002", "TYPO-030"), ("TYPO-003", "TYPO-030"), ("TYPO-004", "TYPO-013"))
HIGH, MEDIUM, LOW = ("TYPO", "ENC", "CHAR", "SPC", "STRUCT", "SYS"), ("MATH", "DELIM", "SCRIPT", "CHEM"), ("STYLE", "LANG")
RANK = {"Error": 2, "Warning": 1, "Info": 0}


def severity_rank(c):
    return F.coalesce(*[F.when(c == k, v) for k, v in RANK.items()])


def resolve_conflicts(found: DataFrame) -> DataFrame:
    """Findings without those that lose a conflict in their document.

    Of a pair in one document the more severe rule stays, then the one with the lower count, then the lower id.
    Losers are taken from all findings, not from what other conflicts leave.
    """
    found = staged(found, "findings")  # used three times below; the detectors run once
    spark = found.sparkSession
    pairs = spark.createDataFrame([*CONFLICTS], "a string, b string")
    x = found.select("doc_id", F.col("rule_id").alias("a"), severity_rank(F.col("severity")).alias("ra"), F.col("n").alias("na"))
    y = found.select("doc_id", F.col("rule_id").alias("b"), severity_rank(F.col("severity")).alias("rb"), F.col("n").alias("nb"))
    met = x.join(F.broadcast(pairs), "a").join(y, ["doc_id", "b"])
    first = (F.col("ra") > F.col("rb")) | ((F.col("ra") == F.col("rb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))))
    losers = met.select("doc_id", F.when(first, F.col("b")).otherwise(F.col("a")).alias("rule_id")).distinct()
    return found.join(losers, ["doc_id", "rule_id"], "left_anti")


def score(found: DataFrame, least: float = 0.0) -> DataFrame:
    """Findings with confidence and evidence weight, of at least the weight ``least``."""
    family = F.split_part("rule_id", F.lit("-"), F.lit(1))
    confidence = F.when(family.isin(*HIGH), "High").when(family.isin(*LOW), "Low").otherwise("Medium")
    weight = F.when(F.col("confidence") == "High", 1.0).when(F.col("confidence") == "Medium", 0.7).otherwise(0.4)
    return found.withColumn("confidence", confidence).withColumn("weight", weight).where(F.col("weight") >= least)


def waive(found: DataFrame, waivers: DataFrame) -> DataFrame:
    """Findings with the number of the first waiver that covers them, or null.

    ``waivers``: (no, rule_id, file_glob); a glob matches the whole path or its last part, ``*`` and ``?`` stand
    for any characters and any one.
    """
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("file_glob", r"([.+^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    w = F.broadcast(waivers.select("no", F.col("rule_id").alias("w_rule"), regex.alias("regex")))
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    hit = (F.col("rule_id") == F.col("w_rule")) & (F.regexp_like(F.coalesce("path", F.lit("")), F.col("regex")) | F.regexp_like(F.coalesce(base, F.lit("")), F.col("regex")))
    first = found.join(w, hit).groupBy("doc_id", "rule_id").agg(F.min("no").alias("waiver"))
    return found.join(first, ["doc_id", "rule_id"], "left")


def report(found: DataFrame) -> DataFrame:
    """(rule_id, severity, source, total, n_docs): sums by rule, by severity, by source and over all, in one pass."""
    found.createOrReplaceTempView("_report_input")
    return found.sparkSession.sql(
        "SELECT rule_id, severity, source, sum(n) AS total, count(DISTINCT doc_id) AS n_docs FROM _report_input GROUP BY GROUPING SETS ((rule_id), (severity), (source), ())"
    )


def log_summary(events: DataFrame) -> DataFrame:
    """One row a compile log: what the layout rules ask for. Lines read twice count once; kinds are folded in case."""
    e = events.withColumn("kind", F.lower(F.trim("kind"))).select("log_file", "seq", "kind", "box", "amount_pt", "badness", "line_start", "line_end", "page", "line_no", "event_key", "message").distinct()
    k, box = F.col("kind"), F.lower(F.col("box"))
    over, under = k == "overfull", k == "underfull"
    return e.groupBy("log_file").agg(
        F.count_if(over & (box == "hbox")).alias("n_overfull_hbox"),
        F.count_if(over & (box == "vbox")).alias("n_overfull_vbox"),
        F.count_if(under & (box == "vbox")).alias("n_underfull_vbox"),
        F.greatest(F.coalesce(F.max(F.when(over, F.col("amount_pt"))), F.lit(0.0)), F.lit(0.0)).alias("max_overfull_pt"),
        F.coalesce(F.bool_or(k == "widowpenalty"), F.lit(False)).alias("has_widows"),
        F.coalesce(F.bool_or(k == "clubpenalty"), F.lit(False)).alias("has_orphans"),
        F.coalesce(F.bool_or(k == "rerunneeded"), F.lit(False)).alias("has_rerun"),
        F.countDistinct(F.when(k == "citationundefined", F.col("event_key"))).alias("n_undefined_citations"),
        F.count_if(k == "fontsubstitution").alias("n_font_substitutions"),
        F.count_if(k == "floatwarning").alias("n_float_warnings"),
    )


def log_findings(summary: DataFrame) -> DataFrame:
    """(log_file, rule_id, n): the rules that need a compile log."""
    c = F.col
    # fixed values: which figure of the log each rule reads, and its threshold
    rules = [
        ("LAY-001", F.when(c("max_overfull_pt") > 2, c("n_overfull_hbox"))), ("LAY-002", c("has_widows").cast("bigint") + c("has_orphans").cast("bigint")), ("LAY-004", (c("max_overfull_pt") > 10).cast("bigint")),
        ("LAY-006", c("n_float_warnings")), ("LAY-009", c("n_underfull_vbox")), ("LAY-017", c("has_widows").cast("bigint")), ("LAY-018", c("n_underfull_vbox")), ("LAY-021", c("n_overfull_vbox")),
        ("LAY-025", c("has_rerun").cast("bigint")), ("LAY-026", c("n_undefined_citations")), ("LAY-027", c("n_font_substitutions")),
        ("FIG-020", (c("max_overfull_pt") > 0).cast("bigint")), ("MATH-026", (c("max_overfull_pt") > 0).cast("bigint")), ("MATH-027", (c("max_overfull_pt") > 5).cast("bigint")),
    ]
    hits = F.array(*(F.struct(F.lit(k).alias("rule_id"), F.coalesce(v, F.lit(0)).cast("bigint").alias("n")) for k, v in rules))
    return summary.select("log_file", F.explode(F.filter(hits, lambda h: h.n > 0)).alias("h")).select("log_file", "h.rule_id", "h.n")


def tag_spans(labeled: DataFrame) -> DataFrame:
    """(labeled_id, rule_id, span_start, span_end): spans that the tags spell, a B- and the I- of its rule that follow."""
    t = labeled.where("bio_tags is not null").select("labeled_id", F.posexplode("bio_tags").alias("pos", "tag")).where("tag <> 'O'")
    t = t.select("labeled_id", "pos", F.substr("tag", F.lit(1), F.lit(1)).alias("b"), F.substr("tag", F.lit(3)).alias("rule_id"))
    by = Window.partitionBy("labeled_id").orderBy("pos")
    new = (F.col("b") == "B") | (F.lag("pos").over(by) != F.col("pos") - 1) | (F.lag("rule_id").over(by) != F.col("rule_id"))
    t = t.withColumn("g", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("labeled_id", "g", "rule_id").agg(F.min("pos").cast("int").alias("span_start"), (F.max("pos") + 1).cast("int").alias("span_end")).drop("g")


def span_metrics(labeled: DataFrame) -> DataFrame:
    """(rule_id, tp, fp, fn, precision, recall, f1): spans of the tags against the listed ones, exact bounds."""
    key = ["labeled_id", "rule_id", "span_start", "span_end"]
    gold = labeled.where("spans is not null").select("labeled_id", F.inline("spans")).select(*key).distinct().withColumn("g", F.lit(1))
    seen = tag_spans(labeled).select(*key).distinct().withColumn("s", F.lit(1))
    both = gold.join(seen, key, "full")
    m = both.groupBy("rule_id").agg(F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("s").isNull()).alias("fn"))
    p, r = F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4)
    return m.select("rule_id", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4).alias("f1"))


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, hash): paragraphs with a content hash."""
    return docs.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(F.split(F.col(text), "\n\n")).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.md5("c").alias("hash"))


def dirty_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, chunk_no): chunks of ``new`` to be looked at again: those of another hash than in ``old``, or all where the number of chunks differs."""
    a = old.select("doc_id", "chunk_no", F.col("hash").alias("old_hash"))
    na = old.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_old"))
    nb = new.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_new"))
    counts = nb.join(na, "doc_id", "left")
    both = new.join(a, ["doc_id", "chunk_no"], "left").join(counts, "doc_id")
    return both.where(~(F.col("old_hash").eqNullSafe(F.col("hash"))) | ~(F.col("n_old").eqNullSafe(F.col("n_new")))).select("doc_id", "chunk_no")


def waiver_frame(spark: SparkSession, rows: list[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "no int, rule_id string, file_glob string")
