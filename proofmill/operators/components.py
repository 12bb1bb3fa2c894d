"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable from each node that has an edge.

    Alternates the two star operations (every larger neighbour is linked to the smallest one, then every
    smaller neighbour), so the number of rounds grows with the logarithm of the longest chain. Each round is
    a shuffle of the edges; the smallest neighbour is a partial aggregate, so hot nodes stay cheap. Lineage
    is cut by a checkpoint per round. Self loops and nulls in ``edges`` are ignored.
    """
    from proofmill.session import shared_dir

    shared_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()

    def star(x: DataFrame, large: bool) -> DataFrame:
        both = x.union(x.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.join(low, "u")
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    last = None
    for _ in range(rounds):
        e = star(star(e, True), False).checkpoint()
        sign = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))).distinct()
