"""What an edit makes dirty: chunks, their dependencies, the order of work, sentences and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.operators.graphs import reachable

#: A paragraph joins the chunk before it while that is shorter than so many bytes.
LEAST_CHUNK = 64


def merged_chunks(docs: DataFrame, least: int = LEAST_CHUNK) -> DataFrame:
    """(doc_id, chunk_no, start, length, hash, content): paragraphs, each joined to the chunk before while that has under ``least`` bytes.

    Null and empty texts have no chunk. The fold is over an array within its row, so it needs no shuffle.
    """
    parts = F.split(F.col("text"), "\n\n")
    first = F.slice(parts, 1, 1)

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit("\n\n"), p)))
        return F.when(F.octet_length(last) < least, joined).otherwise(F.array_append(done, p))

    chunks = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first, step)
    with_start = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,content:string>>").alias("out")),
        lambda s, c: F.struct((s.at + F.length(c) + 2).alias("at"), F.array_append(s.out, F.struct(s.at.alias("start"), c.alias("content"))).alias("out")),
        lambda s: s.out,
    )
    c = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(with_start).alias("chunk_no", "c"))
    return c.select("doc_id", "chunk_no", "c.start", F.length("c.content").alias("length"), F.xxhash64("c.content").alias("hash"), "c.content")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """(doc_id, src, dst, kind): chunks that others depend on: labels and their references, macros and their uses.

    The last chunk that defines a name counts; a chunk doesn't depend on itself.
    """
    def pairs(define: str, use: str, kind: str) -> DataFrame:
        d = chunks.select("doc_id", "chunk_no", F.explode(F.regexp_extract_all("content", F.lit(define), F.lit(1))).alias("key")).groupBy("doc_id", "key").agg(F.max("chunk_no").alias("src"))
        u = chunks.select("doc_id", F.col("chunk_no").alias("dst"), F.explode(F.regexp_extract_all("content", F.lit(use), F.lit(1))).alias("key")).distinct()
        return d.join(u, ["doc_id", "key"]).where("src <> dst").select("doc_id", "src", "dst", F.lit(kind).alias("kind"))

    labels = pairs(r"\\label\{([^{}]*)\}", r"\\(?:ref|eqref|autoref|cref|Cref)\{([^{}]*)\}", "label")
    return labels.union(pairs(r"\\(?:newcommand|renewcommand|providecommand)\*?\{?\\([A-Za-z@]+)", r"\\([A-Za-z@]+)", "macro")).distinct()


def affected_chunks(edges: DataFrame, dirty: DataFrame) -> DataFrame:
    """(doc_id, chunk_no): the dirty chunks and all that depend on them, directly or not."""
    key = lambda c: F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col(c).cast("string"))
    reached = reachable(edges.select(key("src").alias("src"), key("dst").alias("dst")), dirty.select(key("chunk_no"))).select(F.split("node", "\x1f").alias("p"))
    return dirty.select("doc_id", "chunk_no").union(reached.select(F.col("p")[0].cast("bigint"), F.col("p")[1].cast("int"))).distinct()


def work_order(tasks: DataFrame, edit_pos: int) -> DataFrame:
    """Tasks (execution_class, chunk_start, layer) with ``priority`` and their place ``rank``: class A to D, then distance from the edit plus 1000 a layer."""
    p = F.abs(F.col("chunk_start") - edit_pos) + 1000 * F.col("layer")
    offset = F.ascii(F.col("execution_class")) - ord("A")
    return tasks.withColumn("priority", p + 1_000_000 * offset)


def sentence_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, sentence, change): sentences added and removed, by their text; ``old``, ``new``: doc_id, sentence."""
    a, b = (x.select("doc_id", "sentence").distinct() for x in (old, new))
    return b.join(a, ["doc_id", "sentence"], "left_anti").withColumn("change", F.lit("added")).union(a.join(b, ["doc_id", "sentence"], "left_anti").withColumn("change", F.lit("removed")))


def consistent_layers(layers: DataFrame) -> DataFrame:
    """(doc_id, layer, gen, consistent): a layer stands if the generation it was built from is the one below it has now."""
    below = layers.select("doc_id", (F.col("layer") + 1).alias("layer"), F.col("gen").alias("below"))
    return layers.join(below, ["doc_id", "layer"], "left").select("doc_id", "layer", "gen", (F.col("below").isNull() | F.col("parent_gen").eqNullSafe(F.col("below"))).alias("consistent"))


def cached_findings(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of chunks whose hash the cache (hash, rule_id, n) holds, and the chunks that must be looked at."""
    known = cache.select("hash").distinct()
    hit = chunks.join(known, "hash", "left_semi")
    return hit.join(cache, "hash").select("doc_id", "chunk_no", "rule_id", "n"), chunks.join(known, "hash", "left_anti")
