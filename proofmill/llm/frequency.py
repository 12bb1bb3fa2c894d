"""Rows and files of every distinct value: recursive radix partitions, each aggregated out of core."""

from __future__ import annotations

import os
import shutil
import tempfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.session import map_arrow, shared_dir, staged

#: Bits of a value's hash in the first division, and those added whenever a partition is too large.
FIRST_BITS, MORE_BITS = 4, 3
#: Bits of hash there are; partitions still too large then hold one value and are divided by the file's hash.
MOST_BITS = 28
#: Memory of one DuckDB instance; beyond it partitions spill to the shared folder.
DUCKDB_MEMORY = "200MB"


def _divide(counted: DataFrame, most: int) -> list[tuple[int, int, int, int]]:
    """(bits, prefix, file bits, partition): the leaves of the recursive division of (h, g) by hash prefix.

    Only sizes of partitions reach the driver: at every level those of the partitions that were too large.
    """
    leaves, open_, bits, ids = [], None, FIRST_BITS, 0
    while True:
        prefix = F.shiftrightunsigned("h", 64 - bits)
        rows = counted if open_ is None else counted.where(reduce(lambda x, y: x | y, [F.shiftrightunsigned("h", 64 - b) == p for b, p in open_]))
        sizes = rows.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"), (F.min("h") == F.max("h")).alias("one")).collect()
        open_ = []
        for r in sorted(sizes, key=lambda r: r.p):
            if r.n <= most or r.one or bits + MORE_BITS > MOST_BITS:
                file_bits = 0 if r.n <= most else max(1, (int(r.n) // most).bit_length())
                leaves.append((bits, r.p, file_bits, ids))
                ids += 1 << file_bits
            else:
                open_.append((bits, r.p))
        if not open_:
            return leaves
        bits += MORE_BITS


def _duckdb(folder: str):
    def run(batches):
        import duckdb

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        # spilled parts go to the folder that the executors share; elsewhere there may be no room
        spill = tempfile.mkdtemp(prefix="radix-", dir=folder) if folder else None
        try:
            con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, **({"temp_directory": spill} if spill else {})})
            con.execute("SET preserve_insertion_order = false")
            con.execute("CREATE TEMP TABLE part (field VARCHAR, term VARCHAR, f VARCHAR, n BIGINT)")
            while first is not None:
                arrow = pa.Table.from_batches([first])  # noqa: F841
                con.execute("INSERT INTO part SELECT field, term, f, n FROM arrow")
                first = next(batches, None)
            # a partition holds every row of its (term, file) pairs, so files of parts of a term add up
            reader = con.sql("SELECT field, term, sum(n)::BIGINT AS n_rows, count(DISTINCT f)::BIGINT AS n_files FROM part GROUP BY ALL").to_arrow_reader(65536)
            yield from reader
        finally:
            if spill:
                shutil.rmtree(spill, ignore_errors=True)

    return run


def term_frequencies(df: DataFrame, terms: dict[str, Column], file: Column, rare_below: int = 4, common_above: float = 0.25, most: int = 2_000_000) -> DataFrame:
    """(field_name, term, n_rows, n_files, share_of_files, is_rare, is_common) for every distinct term of every field.

    ``terms`` gives the fields' term expressions (strings), ``file`` that of the file. Rows are first counted
    per (field, term, file) where they lie, so a hot term shrinks to its files. Those counts are divided by the
    leading bits of the term's hash; a partition of more than ``most`` counts is divided again by further bits,
    one that holds a single term by its files' hash. Each partition is one shuffle partition, streamed to
    DuckDB, which aggregates it out of core; parts of a divided term are added at the end.

    Null terms don't count. A null file adds rows but no file, so a term without any file is rare. An empty
    term is a term. ``is_rare``: fewer than ``rare_below`` files; ``is_common``: more than ``common_above`` of all
    distinct files of ``df``. An empty table gives no rows.
    """
    spark = df.sparkSession
    named = [F.struct(F.lit(k).alias("field"), v.alias("term")) for k, v in terms.items()]
    long = df.select(F.explode(F.array(*named)).alias("t"), file.alias("f")).select("t.field", "t.term", "f").where("term is not null")
    counted = long.groupBy("field", "term", "f").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": F.xxhash64("field", "term"), "g": F.xxhash64("f")})
    counted = staged(counted, "radix")
    leaves = _divide(counted, most)
    if not leaves:
        leaves = [(FIRST_BITS, 0, 0, 0)]
    part = F.lit(0)
    for bits, p, file_bits, start in leaves:
        inner = F.lit(start) if not file_bits else F.lit(start) + F.shiftrightunsigned("g", 64 - file_bits).cast("int")
        part = F.when(F.shiftrightunsigned("h", 64 - bits) == p, inner).otherwise(part)
    n = max(1, leaves[-1][3] + (1 << leaves[-1][2]))
    folder = shared_dir(spark)
    local = folder.removeprefix("file://").removeprefix("file:")
    spill = local if "://" not in local and os.path.isdir(local) else ""
    parts = counted.select(F.col("field"), "term", "f", "n", part.alias("part")).repartitionById(n, F.col("part")).drop("part")
    found = map_arrow(parts, _duckdb(spill), "field_name string, term string, n_rows bigint, n_files bigint", spread=False)
    whole = found.groupBy("field_name", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_files").alias("n_files"))
    all_files = df.select(file.alias("f")).where("f is not null").agg(F.countDistinct("f")).scalar()
    share = F.when(F.col("all_files") > 0, F.col("n_files") / F.col("all_files"))
    return whole.withColumn("all_files", all_files).select("field_name", "term", "n_rows", "n_files", share.alias("share_of_files"), (F.col("n_files") < rare_below).alias("is_rare"), F.coalesce(share > common_above, F.lit(False)).alias("is_common"))


def marked_terms(frequencies: DataFrame) -> DataFrame:
    """(field_name, term, mark): a row for each mark of each term."""
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")))
    return frequencies.select("field_name", "term", F.explode(marks).alias("mark"))
