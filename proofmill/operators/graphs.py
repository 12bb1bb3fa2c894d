"""Reachability, cycles and orders of directed graphs given as edge tables; no graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.session import shared_dir


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def reachable(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 1000) -> DataFrame:
    """(start, node): nodes that a walk of at least one edge from each start reaches; ``starts`` has one column.

    One join of the newest front a round, cut by checkpoints; it ends when nothing new comes. Pairs grow with the
    result only. Nulls are ignored, cycles are no trouble, an empty table reaches nothing.
    """
    shared_dir(edges.sparkSession)
    e = _edges(edges, src, dst).checkpoint()
    front = starts.select(F.col(starts.columns[0]).alias("start")).where("start is not null").distinct().join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().checkpoint()
    seen = front
    for _ in range(rounds):
        if front.isEmpty():
            return seen
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = step.join(seen, ["start", "node"], "left_anti").checkpoint()
        seen = seen.union(front).checkpoint()
    raise RuntimeError(f"the walk did not end in {rounds} rounds")


def peeled(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Levels of the nodes that lead into no cycle, as (node, level), and the edges that are left.

    A node whose edges all lead to settled nodes settles one level above the highest of them; leaves are level 0.
    """
    shared_dir(edges.sparkSession)
    e = _edges(edges, src, dst).checkpoint()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    left, levels = e, None
    for k in range(rounds):
        open_nodes = left.select(F.col("src").alias("node")).distinct()
        free = nodes.join(open_nodes, "node", "left_anti").withColumn("level", F.lit(k)).checkpoint()
        if free.isEmpty():
            break
        levels = free if levels is None else levels.union(free)
        nodes = nodes.join(free, "node", "left_anti").checkpoint()
        left = left.join(free.select(F.col("node").alias("dst")), "dst", "left_anti").checkpoint()
    else:
        raise RuntimeError(f"the levels did not settle in {rounds} rounds")
    none = nodes.limit(0).withColumn("level", F.lit(0))
    return (none if levels is None else levels), left


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node): nodes that lie on a cycle, loops included.

    Peeled from both ends, what is left is cycles and what lies between them; only that is walked.
    """
    _, left = peeled(edges, src, dst)
    _, core = peeled(left, "dst", "src")
    core = _edges(core, "dst", "src")  # turned back
    return reachable(core, core.select("src")).where("start = node").select("node").distinct()
