"""Projects of several files: includes, their resolution, closure, cycles and build order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions.paths import file_name
from proofmill.operators.graphs import cycles, peeled, reachable

#: Suffixes tried for graphics, in order. Fixed values.
IMAGES = (".pdf", ".png", ".jpg", ".jpeg", ".eps", ".svg", ".gif")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)(^|[^\\])%[^\n]*", "$1")


def includes(docs: DataFrame) -> DataFrame:
    """(path, pos, command, target): what a file takes in, in order, comments left out; ``docs``: path, text."""
    found = F.regexp_extract_all(_plain(F.col("text")), F.lit(r"\\(?:input|include|subfile)(?![A-Za-z])[ \t]*(?:\{[^{}\n]*\}|[^\s{}\\%]+)"), F.lit(0))
    ev = docs.where("text is not null").select("path", F.posexplode(found).alias("pos", "m"))
    target = F.trim(F.regexp_extract("m", r"^\\[A-Za-z]+[ \t]*\{?([^{}]*)\}?$", 1))
    return ev.select("path", "pos", F.regexp_extract("m", r"^\\([A-Za-z]+)", 1).alias("command"), target.alias("target")).where("target <> ''")


def include_only(docs: DataFrame) -> DataFrame:
    """(path, target): what ``includeonly`` restricts a file's includes to."""
    lists = F.regexp_extract_all(_plain(F.col("text")), F.lit(r"\\includeonly\{([^{}]*)\}"), F.lit(1))
    return docs.where("text is not null").select("path", F.explode(lists).alias("l")).select("path", F.explode(F.split("l", ",")).alias("t")).select("path", F.trim("t").alias("target")).where("target <> ''").distinct()


def resolved_includes(docs: DataFrame) -> DataFrame:
    """(path, pos, command, target, file): includes with the file they name, from the including file's folder or the root, as it stands or with ``.tex``; null where there is none.

    Where ``includeonly`` is given, includes that it doesn't list are left out.
    """
    inc = includes(docs)
    only = include_only(docs).withColumn("_listed", F.lit(True))
    some = only.select("path").distinct().withColumn("_some", F.lit(True))
    inc = inc.join(some, "path", "left").join(only, ["path", "target"], "left").where("command <> 'include' or _some is null or _listed").drop("_some", "_listed")
    folder = F.regexp_replace(F.col("path"), r"[^/]*$", "")
    tries = F.array(*(file_name(F.concat(base, F.col("target"), F.lit(ext))) for base in (folder, F.lit("")) for ext in ("", ".tex")))
    at = inc.select("path", "pos", "command", "target", F.posexplode(tries).alias("k", "file"))
    files = docs.select(file_name(F.col("path")).alias("file")).where("file is not null").distinct()
    best = at.join(files, "file").groupBy("path", "pos").agg(F.min_by("file", "k").alias("file"))
    return inc.join(best, ["path", "pos"], "left").select("path", "pos", "command", "target", "file")


def include_edges(docs: DataFrame) -> DataFrame:
    """(src, dst): files and the files they take in."""
    return resolved_includes(docs).where("file is not null").select(file_name(F.col("path")).alias("src"), F.col("file").alias("dst")).distinct()


def include_closure(docs: DataFrame) -> DataFrame:
    """(start, node): every file that a file takes in, directly or not."""
    e = include_edges(docs)
    return reachable(e, e.select("src"))


def include_cycles(docs: DataFrame) -> DataFrame:
    """(node): files that take themselves in, directly or not."""
    return cycles(include_edges(docs))


def build_order(docs: DataFrame) -> DataFrame:
    """(node, level): files that lead into no cycle, each above all that it takes in; files outside any include at level 0."""
    levels, _ = peeled(include_edges(docs))
    alone = docs.select(file_name(F.col("path")).alias("node")).where("node is not null").distinct()
    return alone.join(levels, "node", "left").join(include_edges(docs).select(F.col("src").alias("node")).distinct().withColumn("_open", F.lit(True)), "node", "left").where("level is not null or _open is null").select("node", F.coalesce("level", F.lit(0)).alias("level"))


def build_artefacts(docs: DataFrame) -> DataFrame:
    """(src, dst): what is made from what: source, auxiliary file, bibliography and result of every main file."""
    main = docs.where(F.col("text").contains("\\documentclass")).select(file_name(F.col("path")).alias("p"), F.regexp_replace(file_name(F.col("path")), r"\.tex$", "").alias("b"), F.regexp_like("text", F.lit(r"\\(bibliography|addbibresource)\{")).alias("bib"))
    made = lambda a, b: F.struct(F.concat("b", F.lit(a)).alias("src"), F.concat("b", F.lit(b)).alias("dst"))
    pairs = F.array(F.struct(F.col("p").alias("src"), F.concat("b", F.lit(".aux")).alias("dst")), made(".aux", ".pdf"))
    return main.select(F.explode(F.when(F.col("bib"), F.concat(pairs, F.array(made(".aux", ".bbl"), made(".bbl", ".pdf")))).otherwise(pairs)).alias("e")).select("e.src", "e.dst").distinct()


def graphics(docs: DataFrame) -> DataFrame:
    """(path, pos, target): pictures that a file refers to."""
    found = F.regexp_extract_all(_plain(F.col("text")), F.lit(r"\\includegraphics(?:\[[^\]]*\])?\{([^{}]*)\}"), F.lit(1))
    return docs.where("text is not null").select("path", F.posexplode(found).alias("pos", "target"))


def resolved_graphics(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, pos, target, file): pictures with the file of ``files`` (file) that they name, with or without a suffix."""
    g = graphics(docs)
    folder = F.regexp_replace(F.col("path"), r"[^/]*$", "")
    tries = F.array(*(file_name(F.concat(base, F.col("target"), F.lit(ext))) for base in (folder, F.lit("")) for ext in ("", *IMAGES)))
    best = g.select("path", "pos", F.posexplode(tries).alias("k", "file")).join(files.select("file").distinct(), "file").groupBy("path", "pos").agg(F.min_by("file", "k").alias("file"))
    return g.join(best, ["path", "pos"], "left")


def shared_across_files(docs: DataFrame, pattern: str = r"\\label\{([^{}]*)\}") -> DataFrame:
    """(key, n_files): keys that more than one file of a project sets."""
    found = docs.where("text is not null").select("path", F.explode(F.regexp_extract_all(_plain(F.col("text")), F.lit(pattern), F.lit(1))).alias("key"))
    return found.groupBy("key").agg(F.countDistinct("path").alias("n_files")).where("n_files > 1")
