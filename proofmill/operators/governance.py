"""Policies, reviews, extensions and evidence: parsed from text, joined to findings, audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a review, and support levels of extensions from the weakest. Fixed values.
STATES = ("new", "acknowledged", "in-progress", "resolved", "wontfix")
SUPPORT = ("unsupported", "experimental", "partial", "supported", "proven")


def glob_pattern(glob: Column) -> Column:
    """A glob of ``*`` and ``?`` as a regular expression for whole strings."""
    return F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def glob_matches(path: Column, glob: Column) -> Column:
    """Whether a glob fits a whole path or its last part; a null glob fits all."""
    p = glob_pattern(glob)
    return glob.isNull() | F.regexp_like(F.coalesce(path, F.lit("")), p) | F.regexp_like(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1), p)


def _option(name: str) -> Column:
    return F.nullif(F.regexp_extract("line", rf"(?:^|\s){name}=(\"[^\"]*\"|\S+)", 1), F.lit(""))


def policy_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, directive, rule_id, value, file_glob, lines, reason, error) of the lines (file, line_no, line) of policies.

    Directives: profile NAME, disable RULE, enable RULE, severity RULE LEVEL, waive RULE [file=GLOB] [lines=A-B] [reason=...].
    Comments and blank lines are none; what can't be read keeps its place with an ``error``.
    """
    c = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    words = F.split(F.col("line"), r"\s+")
    d = lines.withColumn("line", c).where("line <> ''").withColumn("w", words).withColumn("directive", F.lower(F.col("w")[0]))
    known = F.col("directive").isin("profile", "disable", "enable", "severity", "waive")
    second, third = F.try_element_at("w", F.lit(2)), F.try_element_at("w", F.lit(3))
    severity = F.initcap(third)
    error = F.when(~known, "unknown directive").when(second.isNull(), "argument missing").when((F.col("directive") == "severity") & ~F.coalesce(severity.isin("Error", "Warning", "Info"), F.lit(False)), "unknown severity")
    rule = F.when(F.col("directive") != "profile", F.upper(second))
    value = F.when(F.col("directive") == "profile", second).when(F.col("directive") == "severity", severity)
    return d.select("file", "line_no", "directive", rule.alias("rule_id"), value.alias("value"), F.trim(_option("file"), F.lit('"')).alias("file_glob"), _option("lines").alias("lines"), F.trim(_option("reason"), F.lit('"')).alias("reason"), error.alias("error"))


def apply_policy(found: DataFrame, policy: DataFrame) -> DataFrame:
    """Findings (.., rule_id, severity, path) under one policy: disabled ones go unless enabled, severities change, waivers are noted.

    The last directive on a rule counts. ``waived_by`` is the line of the first waiver that fits, or null.
    """
    p = policy.where("error is null")
    last = Window.partitionBy("rule_id", "kind").orderBy(F.desc("line_no"))
    on = F.when(F.col("directive").isin("enable", "disable"), "state").when(F.col("directive") == "severity", "severity")
    s = p.withColumn("kind", on).where("kind is not null").withColumn("k", F.row_number().over(last)).where("k = 1")
    s = s.groupBy("rule_id").agg(F.max(F.when(F.col("kind") == "state", F.col("directive"))).alias("_state"), F.max(F.when(F.col("kind") == "severity", F.col("value"))).alias("_severity"))
    kept = found.join(s, "rule_id", "left").where("_state is null or _state <> 'disable'").withColumn("severity", F.coalesce("_severity", "severity")).drop("_state", "_severity")
    w = p.where("directive = 'waive'").select("rule_id", "line_no", "file_glob")
    hit = kept.select("doc_id", "rule_id", "path").join(w, "rule_id").where(glob_matches(F.col("path"), F.col("file_glob"))).groupBy("doc_id", "rule_id").agg(F.min("line_no").alias("waived_by"))
    return kept.join(hit, ["doc_id", "rule_id"], "left")


def unused_directives(found: DataFrame, policy: DataFrame) -> DataFrame:
    """(line_no, directive, rule_id): directives that no finding meets, for the audit."""
    p = policy.where("error is null and directive <> 'profile'").select("line_no", "directive", "rule_id", "file_glob")
    met = found.select("rule_id", "path").distinct().join(p, "rule_id").where(glob_matches(F.col("path"), F.col("file_glob"))).select("line_no").distinct()
    return p.join(met, "line_no", "left_anti").select("line_no", "directive", "rule_id")


def review_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, rule_id, state, owner, file_glob, note, error) of lines ``review RULE STATE owner=.. [file=..] [reason=..]``."""
    c = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    d = lines.withColumn("line", c).where("line <> ''").withColumn("w", F.split("line", r"\s+"))
    state = F.lower(F.try_element_at("w", F.lit(3)))
    error = F.when(F.lower(F.col("w")[0]) != "review", "unknown directive").when(F.try_element_at("w", F.lit(2)).isNull(), "rule missing").when(~F.coalesce(state.isin(*STATES), F.lit(False)), "unknown state").when(_option("owner").isNull(), "owner missing")
    return d.select("file", "line_no", F.upper(F.try_element_at("w", F.lit(2))).alias("rule_id"), state.alias("state"), _option("owner").alias("owner"), F.trim(_option("file"), F.lit('"')).alias("file_glob"), F.trim(_option("reason"), F.lit('"')).alias("note"), error.alias("error"))


def annotate_reviews(found: DataFrame, reviews: DataFrame, hidden: tuple[str, ...] = ("resolved",)) -> DataFrame:
    """Findings with state and owner of the first review that fits them, ``new`` and ``-`` without one; hidden states go."""
    r = reviews.where("error is null").select("rule_id", "line_no", "state", "owner", "file_glob")
    hit = found.select("doc_id", "rule_id", "path").distinct().join(r, "rule_id").where(glob_matches(F.col("path"), F.col("file_glob"))).groupBy("doc_id", "rule_id").agg(F.min(F.struct("line_no", "state", "owner")).alias("r"))
    out = found.join(hit, ["doc_id", "rule_id"], "left").withColumn("state", F.coalesce("r.state", F.lit("new"))).withColumn("owner", F.coalesce("r.owner", F.lit("-"))).drop("r")
    return out.where(~F.col("state").isin(*hidden)) if hidden else out


def extension_manifests(texts: DataFrame) -> DataFrame:
    """(file, name, provides, requires, risk, support, error) of JSON manifests (file, text)."""
    m = texts.select("file", F.from_json("text", "name string, provides array<string>, requires array<string>, risk string, support string").alias("m"))
    level = F.array_position(F.array(*map(F.lit, SUPPORT)), F.col("m.support"))
    error = F.when(F.col("m").isNull() | F.col("m.name").isNull(), "name missing").when(F.coalesce(level, F.lit(0)) == 0, "unknown support")
    return m.select("file", "m.*", error.alias("error"))


def evaluate_extensions(manifests: DataFrame, used: DataFrame) -> DataFrame:
    """(doc_id, support): the weakest support of the features that a document uses; ``used``: doc_id, feature.

    A feature that no manifest provides is unsupported; where several do, the strongest counts.
    """
    rank = F.array_position(F.array(*map(F.lit, SUPPORT)), F.col("support"))
    best = manifests.where("error is null").select(F.explode("provides").alias("feature"), rank.alias("r")).groupBy("feature").agg(F.max("r").alias("r"))
    weakest = used.join(best, "feature", "left").groupBy("doc_id").agg(F.min(F.coalesce("r", F.lit(1))).cast("int").alias("r"))
    return weakest.select("doc_id", F.element_at(F.array(*map(F.lit, SUPPORT)), F.col("r")).alias("support"))


def over_claims(manifests: DataFrame) -> DataFrame:
    """(name, feature): features that an extension provides without having what it requires from any other."""
    m = manifests.where("error is null")
    have = m.select(F.explode("provides").alias("need")).distinct()
    missing = m.select("name", F.explode("requires").alias("need")).join(have, "need", "left_anti").select("name").distinct()
    return m.select("name", F.explode("provides").alias("feature")).join(missing, "name").distinct()


def weigh_by_evidence(scored: DataFrame, evidence: DataFrame) -> DataFrame:
    """Scored findings with their weight times the learned one (rule_id, ml_weight, suppress); suppressed ones go."""
    both = scored.join(F.broadcast(evidence.select("rule_id", F.col("weight").alias("_w"), "suppress")), "rule_id", "left")
    return both.where("suppress is null or not suppress").withColumn("weight", F.col("weight") * F.coalesce("_w", F.lit(1.0))).drop("_w", "suppress")


def golden_results(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, n_expected, n_found, n_forbidden, passed): golden cases (case_id, expect, forbid) against the rules found in their files.

    ``found``: case_id, rule_id. A null list expects or forbids nothing.
    """
    got = found.groupBy("case_id").agg(F.collect_set("rule_id").alias("got"))
    none = F.array().cast("array<string>")
    c = cases.select("case_id", F.coalesce("expect", none).alias("expect"), F.coalesce("forbid", none).alias("forbid")).join(got, "case_id", "left").withColumn("got", F.coalesce("got", none))
    hits, bad = F.size(F.array_intersect("expect", "got")), F.size(F.array_intersect("forbid", "got"))
    wanted = F.size(F.array_distinct("expect"))
    return c.select("case_id", wanted.alias("n_expected"), hits.alias("n_found"), bad.alias("n_forbidden"), ((hits == wanted) & (bad == 0)).alias("passed"))
