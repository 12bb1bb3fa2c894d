"""Equi-joins that stay spread when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: Column, most: int = 2000, how_many: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key`` in which a key with more than ``most`` left rows is cut into blocks.

    Left rows of such a key fall into ``ceil(rows / most)`` blocks by the hash of ``salt_by``; its right rows
    are copied to every block. So a task handles at most about ``most`` left rows of a key at once and
    every pair still meets exactly once. ``how_many`` may give the left rows per key as (key, n).
    """
    n = how_many if how_many is not None else left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = n.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_blocks"))
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    a = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), blocks).cast("int")).drop("_blocks")
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    return a.join(b, [key, "_salt"]).drop("_salt")
