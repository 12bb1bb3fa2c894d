"""Readers of text files: sources, manifests, compile logs, auxiliary files, rule and policy files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Banners of engines, in the order they are asked. Fixed values.
ENGINES = (("LuaLaTeX", r"This is Lua(HB)?TeX"), ("XeLaTeX", r"This is XeTeX"), ("PDFLaTeX", r"This is pdfTeX"), ("LaTeX", r"This is (e-)?TeX|LaTeX2e"))


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text, modified): whole files."""
    df = spark.read.format("text").option("wholetext", True).load(list(paths))
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line_no, line): lines of whole files, any line end."""
    return text_files(spark, *paths).select(F.col("path").alias("file"), F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file): paths listed in a file, one a line; blank lines and those that begin with # are none."""
    return spark.read.text(path).select(F.trim("value").alias("file")).where("file <> '' and not startswith(file, '#')").distinct()


def log_events(lines: DataFrame) -> DataFrame:
    """(file, line_no, kind, box, amount_pt, badness, line_start, line_end, page, at_line, event_key, message) of compile-log lines.

    ``lines``: file, line_no, line. One line may give several events, as every page number in brackets is one. A
    warning that is about a citation, a font or a rerun isn't a plain one besides.
    """
    c = F.col("line")
    number = lambda p, k=1: F.try_to_number(F.regexp_extract(c, p, k), F.lit("999999.99999")).cast("double")
    whole = lambda p, k=1: F.nullif(F.regexp_extract(c, p, k), F.lit("")).cast("int")
    over, under = r"^Overfull \\([hv]box) \((\d+(?:\.\d+)?)pt", r"^Underfull \\([hv]box) \(badness (\d+)\)"
    lines_at = r"lines? (\d+)(?:--(\d+))?"
    cite, rerun, font = r"Citation [`']([^']*)'.*undefined", r"Rerun to get|Label\(s\) may have changed|rerun", r"Font shape [`']([^']*)'"
    none = F.lit(None)

    def event(kind: str, when: Column, box=none, amount=none, badness=none, a=none, b=none, page=none, at=none, key=none) -> Column:
        fields = (("kind", F.lit(kind), "string"), ("box", box, "string"), ("amount_pt", amount, "double"), ("badness", badness, "int"), ("line_start", a, "int"), ("line_end", b, "int"), ("page", page, "int"), ("at_line", at, "int"), ("event_key", key, "string"), ("message", c, "string"))
        return F.when(when, F.struct(*(v.cast(t).alias(k) for k, v, t in fields)))

    ends = F.coalesce(whole(lines_at, 2), whole(lines_at))
    special = c.rlike(cite) | c.rlike(rerun) | c.rlike(font)
    one = F.array(
        event("Overfull", c.rlike(over), F.regexp_extract(c, over, 1), number(over, 2), none, whole(lines_at), ends),
        event("Underfull", c.rlike(under), F.regexp_extract(c, under, 1), none, whole(under, 2), whole(lines_at), ends),
        event("WidowPenalty", c.rlike(r"(?i)widow")), event("ClubPenalty", c.rlike(r"(?i)club penalty|orphan")),
        event("FloatWarning", c.rlike(r"[Ff]loat")),
        event("CitationUndefined", c.rlike(cite), key=F.regexp_extract(c, cite, 1), at=whole(r"input line (\d+)")),
        event("RerunNeeded", c.rlike(rerun)),
        event("FontSubstitution", c.rlike(font), key=F.regexp_extract(c, font, 1)),
        event("LatexWarning", c.rlike(r"LaTeX( \w+)? Warning:") & ~special, at=whole(r"input line (\d+)")),
        event("CompileTime", c.rlike(r"compile time.*?(\d+(?:\.\d+)?) ?s"), amount=number(r"compile time.*?(\d+(?:\.\d+)?) ?s")),
    )
    pages = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)"), F.lit(1)), lambda p: F.struct(*((p.cast("int") if k == "page" else F.lit("PageNumber") if k == "kind" else F.lit(None)).cast(t).alias(k) for k, t in (("kind", "string"), ("box", "string"), ("amount_pt", "double"), ("badness", "int"), ("line_start", "int"), ("line_end", "int"), ("page", "int"), ("at_line", "int"), ("event_key", "string"), ("message", "string")))))
    every = F.concat(F.filter(one, lambda e: e.isNotNull()), pages)
    return lines.where("line is not null").select("file", "line_no", F.explode(every).alias("e")).select("file", "line_no", "e.*")


def engines(logs: DataFrame) -> DataFrame:
    """(file, engine): the engine whose banner a log (file, text) begins with, or Unknown."""
    head = F.substr("text", F.lit(1), F.lit(2000))
    kind = F.coalesce(*(F.when(head.rlike(p), name) for name, p in ENGINES), F.lit("Unknown"))
    return logs.select("file", kind.alias("engine"))


def stale_logs(sources: DataFrame, logs: DataFrame) -> DataFrame:
    """(path): sources (path, modified) newer than their log (path, modified), names without suffix alike."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    a, b = sources.select("path", "modified", stem(F.col("path")).alias("stem")), logs.select(F.col("modified").alias("logged"), stem(F.col("path")).alias("stem"))
    return a.join(b, "stem").where("modified > logged").select("path").distinct()


_GROUP = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def aux_labels(lines: DataFrame) -> DataFrame:
    """(file, name, ref_number, page_number, raw) of the labels in lines (file, line) of auxiliary files."""
    p = r"^\\newlabel\{([^{}]*)\}\{" + _GROUP + _GROUP
    return lines.where(F.col("line").rlike(p)).select("file", F.regexp_extract("line", p, 1).alias("name"), F.regexp_extract("line", p, 2).alias("ref_number"), F.regexp_extract("line", p, 3).alias("page_number"), F.col("line").alias("raw"))


def aux_citations(lines: DataFrame) -> DataFrame:
    """(file, key, number) of the bibliography entries in lines of auxiliary files."""
    p = r"^\\bibcite\{([^{}]*)\}" + _GROUP
    return lines.where(F.col("line").rlike(p)).select("file", F.regexp_extract("line", p, 1).alias("key"), F.regexp_extract("line", p, 2).alias("number"))


def aux_settings(lines: DataFrame) -> DataFrame:
    """(file, style, databases): bibliography style and databases of each auxiliary file."""
    style, data = r"^\\bibstyle\{([^{}]*)\}", r"^\\bibdata\{([^{}]*)\}"
    return lines.groupBy("file").agg(
        F.max(F.nullif(F.regexp_extract("line", style, 1), F.lit(""))).alias("style"),
        F.flatten(F.collect_list(F.when(F.col("line").rlike(data), F.transform(F.split(F.regexp_extract("line", data, 1), ","), lambda x: F.trim(x))))).alias("databases"),
    )


def aux_warnings(lines: DataFrame) -> DataFrame:
    """(file, line_no, line): lines that begin like a label or citation but can't be read as one."""
    label, cite = r"^\\newlabel\{([^{}]*)\}\{" + _GROUP + _GROUP, r"^\\bibcite\{([^{}]*)\}" + _GROUP
    c = F.col("line")
    return lines.where((c.startswith("\\newlabel") & ~c.rlike(label)) | (c.startswith("\\bibcite") & ~c.rlike(cite))).select("file", "line_no", "line")


def json_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a catalogue or list of contracts in one JSON document; rows that don't fit keep their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """(file, lang, expect, forbid, expect_msgs) of JSON lines of golden cases."""
    return spark.read.schema("file string, lang string, expect array<string>, forbid array<string>, expect_msgs array<string>").json(path)
