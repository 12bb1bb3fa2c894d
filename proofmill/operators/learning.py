"""Records, features, splits, metrics and baselines for models that judge candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a candidate's window, and length and stride of the windows of long texts.
WINDOW, LENGTH, STRIDE = 128, 300, 150


def byte_window(source: Column, at: Column, width: int = WINDOW) -> Column:
    """``width`` bytes of a binary around a byte offset, moved inwards at the edges and padded with zeros behind."""
    start = F.greatest(F.lit(0), F.least(at - width // 2, F.octet_length(source) - width))
    return F.rpad(F.substring(source, start + 1, F.lit(width)), F.lit(width), F.lit(b"\0"))


def text_windows(docs: DataFrame, length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """(doc_id, window_no, start, window): overlapping windows of texts; the last one reaches the end, empty texts have none."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - length + stride - 1) - F.pmod(F.greatest(F.lit(0), n - length + stride - 1), F.lit(stride)), F.lit(stride))
    return docs.where("length(text) > 0").select("doc_id", "text", F.posexplode(starts).alias("window_no", "start")).select("doc_id", "window_no", "start", F.substr("text", F.col("start") + 1, F.lit(length)).alias("window"))


def parser_state(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions (doc_id, at) with in_math, in_verbatim, in_comment and env_depth from the parser's regions and nodes."""
    from proofmill.operators.parsing import nodes, regions

    r = regions(docs)
    env = nodes(docs).where("kind = 'environment'").select("doc_id", F.lit("environment").alias("kind"), "start", "end")
    per = r.select("doc_id", "kind", "start", "end").union(env).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("rs"))
    here = lambda *kinds: F.filter("rs", lambda x: x.kind.isin(*kinds) & (x.start <= F.col("at")) & (F.col("at") < x.end))
    size = lambda *kinds: F.coalesce(F.greatest(F.size(here(*kinds)), F.lit(0)), F.lit(0))
    return positions.join(per, "doc_id", "left").select(*positions.columns, (size("inline", "display") > 0).alias("in_math"), (size("verbatim") > 0).alias("in_verbatim"), (size("comment") > 0).alias("in_comment"), size("environment").alias("env_depth"))


def character_features(windows: DataFrame, text_col: str = "window") -> DataFrame:
    """A window's shares of letters, digits, capitals, blanks, marks and backslashes, its length and its number of lines."""
    c, n = F.col(text_col), F.greatest(F.length(text_col), F.lit(1))
    share = lambda p: (F.regexp_count(c, F.lit(p)) / n).alias
    return windows.select("*", share(r"\p{L}")("letters"), share(r"\p{N}")("digits"), share(r"\p{Lu}")("capitals"), share(r"\s")("blanks"), share(r"\p{P}")("marks"), share(r"\\")("commands"), F.length(text_col).alias("n_chars"), (F.regexp_count(c, F.lit("\n")) + 1).alias("n_lines"))


def around(text: Column, at: Column, k: int = 5) -> Column:
    """The ``k`` characters before and behind an offset, each its own string."""
    return F.struct(F.substr(text, F.greatest(at - k, F.lit(0)) + 1, F.least(at, F.lit(k))).alias("before"), F.substr(text, at + 1, F.lit(k)).alias("behind"))


def bio_tags(text_length: Column, spans: Column) -> Column:
    """One tag a character from (span_start, span_end, rule_id): B- and I- of the first span that holds it, else O."""
    first = lambda i: F.element_at(F.filter(spans, lambda s: (s.span_start <= i) & (i < s.span_end)), 1)
    tag = lambda i: F.when(F.exists(spans, lambda s: s.span_start == i), F.concat(F.lit("B-"), F.element_at(F.filter(spans, lambda s: s.span_start == i), 1).rule_id)).when(F.exists(spans, lambda s: (s.span_start <= i) & (i < s.span_end)), F.concat(F.lit("I-"), first(i).rule_id)).otherwise("O")
    return F.when(text_length > 0, F.transform(F.sequence(F.lit(0), text_length - 1), tag)).otherwise(F.array().cast("array<string>"))


def stratified_split(rows: DataFrame, by: str, id_col: str, shares: tuple[tuple[str, float], ...] = (("train", 0.7), ("dev", 0.15), ("test", 0.15)), seed: int = 42, buckets: int = 64) -> DataFrame:
    """Rows with ``split``: of every value of ``by`` the given shares, in the order of a seeded hash of the id.

    Ranks come from counts of ``buckets`` hash parts and ranks inside one, so no task holds all rows of a value.
    """
    h = rows.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    per = h.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy("_b")
    per = per.select(by, "_b", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("_all"))
    ranked = h.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h", id_col)))
    m = per.withColumnRenamed(by, "_by").withColumnRenamed("_b", "_bucket")
    part = (F.col("_r") + F.col("_before") - 0.5) / F.col("_all")
    split, upto = F.lit(shares[-1][0]), 1.0
    for name, share in reversed(shares[:-1]):
        upto = sum(s for n, s in shares[: [x for x, _ in shares].index(name) + 1])
        split = F.when(part < upto, name).otherwise(split)
    joined = ranked.join(m, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_bucket")))
    return joined.withColumn("split", split).select(*rows.columns, "split")


def split_statistics(rows: DataFrame, split_col: str, rule_col: str) -> DataFrame:
    """(split, n_rows, n_rules, missing): per split its rows, its distinct rules and how many rules of all it lacks."""
    every = rows.select(rule_col).where(F.col(rule_col).isNotNull()).distinct().count()
    s = rows.groupBy(F.col(split_col).alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(rule_col).alias("n_rules"))
    return s.withColumn("missing", F.lit(every) - F.col("n_rules"))


def averaged_metrics(per_rule: DataFrame) -> DataFrame:
    """(micro_precision, micro_recall, micro_f1, macro_f1) of counts a rule (tp, fp, fn), to four places."""
    s = per_rule.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).alias("macro"))
    d = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(d(tp, tp + fp).alias("micro_precision"), d(tp, tp + fn).alias("micro_recall"), d(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.round("macro", 4).alias("macro_f1"))


def tag_confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(tag, seen, n): how often each tag of ``truth`` meets each of ``guess`` at the same place; the shorter one ends a row."""
    pairs = F.slice(F.arrays_zip(F.col(truth).alias("tag"), F.col(guess).alias("seen")), 1, F.least(F.size(truth), F.size(guess)))
    return rows.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).select(F.explode(pairs).alias("p")).groupBy(F.col("p.tag").alias("tag"), F.col("p.seen").alias("seen")).agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, p50, p95, p99, p999): exact percentiles of a measure by group; nulls don't count."""
    p = lambda q: F.expr(f"percentile({value}, {q})")
    return rows.groupBy(group).agg(F.count(value).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), p(0.999).alias("p999"))


def candidate_vectors(candidates: DataFrame) -> DataFrame:
    """Candidates (candidate_id, label 0 or 1) with a vector of context flags, depth and byte classes of the window."""
    from pyspark.ml.feature import VectorAssembler

    count = lambda a, b: F.size(F.filter("bytes", lambda x: (x >= a) & (x <= b))).cast("double")
    flag = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    at = lambda k: F.coalesce(F.try_element_at("bytes", F.coalesce("anchor_start", F.lit(0)) + 1 + k).cast("double"), F.lit(0.0)) / 255
    cols = {"c_math": flag("in_math"), "c_verbatim": flag("in_verbatim"), "c_comment": flag("in_comment"), "c_depth": flag("env_depth"), "c_digits": count(48, 57) / WINDOW, "c_upper": count(65, 90) / WINDOW, "c_lower": count(97, 122) / WINDOW, "c_high": count(128, 255) / WINDOW, "c_backslash": count(92, 92) / WINDOW, **{f"c_at{k}": at(k) for k in range(4)}}
    x = candidates.where("label in (0, 1) and bytes is not null").select("candidate_id", "rule_id", F.col("label").cast("double").alias("label"), *(v.alias(k) for k, v in cols.items()))
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(x).select("candidate_id", "rule_id", "label", "features")


def baseline(train: DataFrame, kind: str = "logistic"):
    """A logistic regression or gradient-boosted trees fitted to ``candidate_vectors``."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    return (LogisticRegression(maxIter=20, regParam=0.01) if kind == "logistic" else GBTClassifier(maxIter=10, maxDepth=4, seed=42)).fit(train)


def judged(model, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(candidate_id, rule_id, label, score, predicted) of a fitted baseline."""
    from pyspark.ml.functions import vector_to_array

    score = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).select("candidate_id", "rule_id", F.col("label").cast("int").alias("label"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
