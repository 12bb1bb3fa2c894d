"""Structure of documents as relations: labels, references, headings, environments, packages, commands, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Commands that refer to a label. Fixed values.
REF_COMMANDS = ("ref", "eqref", "autoref", "cref", "Cref")
#: Heading commands by level. Fixed values.
LEVELS = {"chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def matches(docs: DataFrame, pattern: str, text: Column | None = None) -> DataFrame:
    """(doc_id, pos, m): every match of a pattern, numbered within its document; null texts have none."""
    t = F.col("text") if text is None else text
    return docs.where(t.isNotNull()).select("doc_id", F.posexplode(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias("pos", "m"))


def label_events(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, key): labels and references in their order; ``kind`` is label or ref."""
    names = "|".join(("label", *REF_COMMANDS))
    ev = matches(docs, rf"\\({names})\{{[^}}]*\}}")
    return ev.select("doc_id", "pos", F.when(F.col("m").startswith("\\label"), "label").otherwise("ref").alias("kind"), F.regexp_extract("m", r"\{([^}]*)\}", 1).alias("key"))


def undefined_references(docs: DataFrame) -> DataFrame:
    """(doc_id, key): keys referred to in a document without a label there."""
    ev = label_events(docs)
    return ev.where("kind = 'ref'").select("doc_id", "key").join(ev.where("kind = 'label'"), ["doc_id", "key"], "left_anti").distinct()


def duplicate_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n): labels set more than once in a document."""
    return label_events(docs).where("kind = 'label'").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def forward_references(docs: DataFrame) -> DataFrame:
    """(doc_id, key): keys referred to before the last label of that name."""
    ev = label_events(docs)
    last = ev.where("kind = 'label'").groupBy("doc_id", "key").agg(F.max("pos").alias("label_pos"))
    return ev.where("kind = 'ref'").join(last, ["doc_id", "key"]).where("pos < label_pos").select("doc_id", "key").distinct()


def shared_labels(docs: DataFrame) -> DataFrame:
    """(key, n_docs): labels that more than one document sets."""
    return label_events(docs).where("kind = 'label'").groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs > 1")


#: Prefixes that tell what a label is of. Fixed values.
PREFIXES = ("fig:", "tab:", "eq:", "sec:", "ch:", "app:", "lst:", "thm:", "lem:", "def:", "prop:", "cor:", "rem:", "ex:", "alg:")


def label_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, rule_id, n): the rules on labels and references, from one row a key of a document.

    Undefined keys (REF-001), repeated definitions (REF-002), blanks, capitals and missing prefixes of labels (REF-003 to
    REF-005), references before the last definition (REF-009), equations and figures never referred to (MATH-024,
    FIG-012) and equations referred to without a label (MATH-023).
    """
    k = F.col("key")
    per = label_events(docs).groupBy("doc_id", "key").agg(F.count_if(F.col("kind") == "label").alias("n_labels"), F.count_if(F.col("kind") == "ref").alias("n_refs"), F.max(F.when(F.col("kind") == "label", F.col("pos"))).alias("label_pos"), F.min(F.when(F.col("kind") == "ref", F.col("pos"))).alias("ref_pos"))
    set_, used = F.col("n_labels") > 0, F.col("n_refs") > 0
    prefixed = F.regexp_like(k, F.lit("^(" + "|".join(PREFIXES) + ")"))
    # fixed values: which figure of a key each rule counts
    rules = {
        "REF-001": used & ~set_, "REF-003": set_ & F.contains(k, F.lit(" ")), "REF-004": set_ & F.regexp_like(k, F.lit("[A-Z]")), "REF-005": set_ & ~prefixed, "REF-009": set_ & used & (F.col("ref_pos") < F.col("label_pos")),
        "MATH-023": used & ~set_ & k.startswith("eq:"), "MATH-024": set_ & ~used & k.startswith("eq:"), "FIG-012": set_ & ~used & k.startswith("fig:"),
    }
    sums = [F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()]
    doc = per.groupBy("doc_id").agg(*sums, F.sum(F.greatest(F.col("n_labels") - 1, F.lit(0))).alias("REF-002"))
    hits = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.col(f"`{r}`").cast("bigint").alias("n")) for r in (*rules, "REF-002")))
    return doc.select("doc_id", F.explode(F.filter(hits, lambda h: h.n > 0)).alias("h")).select("doc_id", "h.rule_id", "h.n")


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, number, skip): headings with their number below the parent and whether a level is skipped."""
    names = "|".join(LEVELS)
    ev = matches(docs, rf"\\({names})\*?\{{[^}}]*\}}")
    name = F.regexp_extract("m", r"^\\([a-z]+)", 1)
    level = F.coalesce(*[F.when(name == k, v) for k, v in LEVELS.items()])
    h = ev.select("doc_id", "pos", level.alias("level"), F.regexp_extract("m", r"\{([^}]*)\}", 1).alias("title"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = F.lag("level").over(order)
    # a new group of siblings begins whenever a higher heading comes
    parent = F.coalesce(F.max(F.when(F.col("level") <= 1, F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    h = h.withColumn("parent", F.when(F.col("level") <= 1, F.lit(-1)).otherwise(parent)).withColumn("skip", F.coalesce(F.col("level") > before + 1, F.lit(False)))
    number = F.row_number().over(Window.partitionBy("doc_id", "parent", "level").orderBy("pos"))
    return h.withColumn("number", number).select("doc_id", "pos", "level", "title", "number", "skip")


def environment_depth(docs: DataFrame) -> DataFrame:
    """(doc_id, n_environments, max_depth, min_depth, final_depth): nesting of environments, a running sum of begins and ends."""
    ev = matches(docs, r"\\(begin|end)\{[^}]*\}").withColumn("step", F.when(F.col("m").startswith("\\begin"), 1).otherwise(-1))
    depth = F.sum("step").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    run = ev.withColumn("depth", depth)
    return run.groupBy("doc_id").agg(F.count_if(F.col("step") == 1).alias("n_environments"), F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"), F.sum("step").alias("final_depth"))


def environments(docs: DataFrame) -> DataFrame:
    """(environment, n_begin, n_end, n_docs): how often each environment begins and ends."""
    ev = matches(docs, r"\\(begin|end)\{[^}]*\}")
    ev = ev.select("doc_id", F.regexp_extract("m", r"\{([^}]*)\}", 1).alias("environment"), F.col("m").startswith("\\begin").alias("b"))
    return ev.groupBy("environment").agg(F.count_if("b").alias("n_begin"), F.count_if(~F.col("b")).alias("n_end"), F.countDistinct("doc_id").alias("n_docs"))


def brace_balance(docs: DataFrame) -> DataFrame:
    """(doc_id, n_open, n_close, lowest): unescaped braces and the lowest running depth, for documents out of balance."""
    ev = matches(docs.withColumn("plain", F.regexp_replace("text", r"\\[{}\\]", "")), r"[{}]", F.col("plain")).withColumn("step", F.when(F.col("m") == "{", 1).otherwise(-1))
    depth = F.sum("step").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    out = ev.withColumn("depth", depth).groupBy("doc_id").agg(F.count_if(F.col("step") == 1).alias("n_open"), F.count_if(F.col("step") == -1).alias("n_close"), F.min("depth").alias("lowest"))
    return out.where("n_open <> n_close or lowest < 0")


def packages(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, package): packages in loading order, lists split."""
    ev = matches(docs, r"\\usepackage(\[[^\]]*\])?\{[^}]*\}")
    names = F.split(F.regexp_extract("m", r"\{([^}]*)\}", 1), ",")
    return ev.select("doc_id", "pos", F.explode(names).alias("package")).select("doc_id", "pos", F.trim("package").alias("package"))


def command_counts(docs: DataFrame) -> DataFrame:
    """(command, n, n_docs): how often each command is used."""
    per_doc = matches(docs, r"\\[A-Za-z]+").groupBy("doc_id", "m").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy(F.col("m").alias("command")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, token): words, blanks, line ends, commands, brackets, quotes and symbols, in order."""
    ev = matches(docs, r"\\[A-Za-z0-9]+|\\.|[A-Za-z0-9]+|[ \t]+|\r?\n|[^A-Za-z0-9 \t\n\\]")
    m = F.col("m")
    kind = (
        F.when(m.startswith("\\"), "command").when(m.rlike(r"^[A-Za-z0-9]"), "word").when(m.rlike(r"^[ \t]"), "space").when(m.rlike(r"\n$"), "newline")
        .when(m.isin("{", "[", "("), "open").when(m.isin("}", "]", ")"), "close").when(m.isin("'", '"', "`"), "quote").otherwise("symbol")
    )
    return ev.select("doc_id", "pos", kind.alias("kind"), m.alias("token"))


def simple_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence): stretches that end in a period, exclamation or question mark, for the style rules."""
    plain = F.regexp_replace("text", r"\s+", " ")
    return docs.where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all(plain, F.lit(r"[^.!?]+[.!?]"), F.lit(0))).alias("pos", "s")).select("doc_id", "pos", F.trim("s").alias("sentence"))


def repeated_openings(docs: DataFrame) -> DataFrame:
    """(doc_id, n): consecutive sentences that begin with the same word, case folded."""
    word = F.lower(F.regexp_extract("sentence", r"^([A-Za-z]+)", 1))
    s = simple_sentences(docs).withColumn("w", word)
    same = s.withColumn("before", F.lag("w").over(Window.partitionBy("doc_id").orderBy("pos"))).where("w <> '' and w = before")
    return same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, n_chars, n_words, start): non-blank paragraphs with their running offset in code points."""
    parts = F.split(F.col("text"), "\n\n")
    p = docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("pos", "p"))
    start = F.sum(F.length("p") + 2).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    words = F.size(F.filter(F.split("p", r"\s+"), lambda w: w != ""))
    return p.withColumn("start", F.coalesce(start, F.lit(0)).cast("bigint")).select("doc_id", "pos", F.length("p").alias("n_chars"), words.alias("n_words"), "start").where("n_words > 0")


def tier(docs: DataFrame) -> DataFrame:
    """(doc_id, tier): Foreign, Extended or Core, by the most demanding primitive used."""
    # fixed values: primitives that put a document beyond the core
    foreign = r"\\(immediate)?\\?write18|\\ShellEscape|\\catcode|\\scantokens|\\detokenize|\\csstring|\\openout[0-9\\]|\\(directlua|latelua|luaexec)"
    extended = r"\\(def|edef|gdef|xdef|let|futurelet|makeatletter|csname|ifnum|ifdim|ifx|ifodd|if|expandafter)[^A-Za-z]"
    t = F.col("text")
    return docs.where(t.isNotNull()).select("doc_id", F.when(t.rlike(foreign), "Foreign").when(t.rlike(extended), "Extended").otherwise("Core").alias("tier"))


def script_language(docs: DataFrame) -> DataFrame:
    """(doc_id, detected): language from the options of babel, else from the script."""
    t = F.col("text")
    named = F.regexp_extract(t, r"\\usepackage\[([^\]]*)\]\{babel\}", 1)
    last = F.trim(F.element_at(F.split(named, ","), -1))
    script = (
        F.when(t.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(t.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko").when(t.rlike(r"[\x{4E00}-\x{9FFF}]"), "zh").when(t.rlike(r"[\x{0600}-\x{06FF}]"), "ar")
        .when(t.rlike(r"[\x{0590}-\x{05FF}]"), "he").when(t.rlike(r"[\x{0900}-\x{097F}]"), "hi").when(t.rlike(r"[\x{0E00}-\x{0E7F}]"), "th").when(t.rlike(r"[\x{0400}-\x{04FF}]"), "ru").otherwise("en")
    )
    return docs.where(t.isNotNull()).select("doc_id", F.when(last != "", last).otherwise(script).alias("detected"))
