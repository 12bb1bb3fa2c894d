"""Near-duplicate records: MinHash banding, then the exact Jaccard index of all word runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.words import mix, run_hashes, set_key, word_hashes
from proofmill.operators.components import connected_components
from proofmill.operators.skew import salted_join
from proofmill.session import map_arrow, staged

_U = np.uint64


def bands_for(threshold: float, recall: float = 0.9998, rows: int = 4) -> int:
    """The number of bands of ``rows`` values at which a pair at the threshold meets with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def minhash_bands(runs: list[np.ndarray], bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """A hash for each set and band of ``rows`` minima. Sets must not be empty."""
    starts = np.cumsum([0, *(len(r) for r in runs)])[:-1]
    every = np.concatenate(runs)
    rng = np.random.default_rng(seed)
    out = np.empty((len(runs), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            band = np.full(len(runs), b, np.uint64)
            for _ in range(rows):
                mul, add = (rng.integers(1, 1 << 63, dtype=np.uint64) | _U(1) for _ in range(2))
                x = every * mul + add
                x ^= x >> _U(32)  # the high bits decide the order of values; bring in the rest
                x *= mul
                band = mix(band * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, starts))
            out[:, b] = band
    return out


def _features(rows_of: int, bands: int, width: int):
    def run(batches):
        for batch in batches:
            hashes, bounds = word_hashes(batch.column(1).to_pylist())
            sets = run_hashes(hashes, bounds, width)
            keep = [i for i, r in enumerate(sets) if len(r)]
            if not keep:
                continue
            sets = [sets[i] for i in keep]
            sig = minhash_bands(sets, bands, rows_of)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)),
                    pa.array([set_key(r) for r in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64))),
                    pa.ListArray.from_arrays(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32), pa.array(sig.ravel().view(np.int64))),
                ],
                names=["id", "set_key", "runs", "bands"],
            )

    return run


def _classes(df: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) and representatives (rep, runs, bands) of the classes of equal run sets."""
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0")
    feats = staged(map_arrow(slim, _features(rows, bands, width), "id bigint, set_key binary, runs array<bigint>, bands array<bigint>"), "minhash")
    reps = feats.groupBy("set_key").agg(F.min("id").alias("rep"))
    members = feats.select("id", "set_key").distinct().join(reps, "set_key").select("id", "rep")
    first = feats.join(reps.select(F.col("rep").alias("id"), "set_key"), ["id", "set_key"]).dropDuplicates(["id"]).select(F.col("id").alias("rep"), "runs", "bands")
    return staged(members, "members"), staged(first, "representatives")


def similar_links(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: representatives whose run sets reach the threshold, each compared exactly."""
    keyed = reps.select("rep", F.explode("bands").alias("band"))
    left = keyed.withColumnRenamed("rep", "a")
    pairs = salted_join(left, keyed.withColumnRenamed("rep", "b"), "band", F.col("a")).where("a < b").select("a", "b").distinct()
    size = reps.select("rep", "runs")
    met = pairs.join(size.select(F.col("rep").alias("a"), F.col("runs").alias("ra")), "a").join(size.select(F.col("rep").alias("b"), F.col("runs").alias("rb")), "b")
    # sets whose sizes alone rule the threshold out need no intersection
    met = met.where(F.least(F.size("ra"), F.size("rb")) >= threshold * F.greatest(F.size("ra"), F.size("rb")))
    common = F.size(F.array_intersect("ra", "rb"))
    return met.select("a", "b", (common / (F.size("ra") + F.size("rb") - common)).alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, rows: int = 4, recall: float = 0.9998) -> DataFrame:
    """(id_a, id_b), a < b: all pairs of records whose sets of ``width``-word runs have a Jaccard index of ``threshold`` or more.

    Records with equal run sets form a class; one representative of each is banded (``rows`` minima a band, as
    many bands as give ``recall`` at the threshold), representatives that share a band meet once and are
    compared on their full sets; pairs of classes are expanded to pairs of records at the end.

    Null and empty texts and texts of fewer than ``width`` words have no runs and are in no pair; rows with a
    null id are ignored; a repeated id counts once; ties (equal texts) are pairs of similarity 1; an empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    members, reps = _classes(df, id_col, text_col, width, bands_for(threshold, recall, rows), rows)
    links = staged(similar_links(reps, threshold), "links").select("a", "b")
    m = members.select("rep", "id")
    same = salted_join(m.withColumnRenamed("id", "x"), m.withColumnRenamed("id", "y"), "rep", F.col("x")).where("x < y").select("x", "y")
    one = salted_join(m.withColumnsRenamed({"rep": "a", "id": "x"}), links, "a", F.col("x")).select("x", "b")
    both = salted_join(one, m.withColumnsRenamed({"rep": "b", "id": "y"}), "b", F.col("x")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return same.union(both).where("x < y").distinct().select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, rows: int = 4, recall: float = 0.9998) -> DataFrame:
    """(id, group_id, n_links, n_copies): every record with its group, linked through similar records.

    ``group_id`` is the smallest id of the group, ``n_links`` the number of other run sets that the record's
    own reaches the threshold with, ``n_copies`` the number of other records with the same run set. Records
    without runs (null, empty or short texts) form groups of their own. Same method and edge cases as
    ``near_duplicate_pairs``; copies are not expanded into pairs.
    """
    members, reps = _classes(df, id_col, text_col, width, bands_for(threshold, recall, rows), rows)
    links = staged(similar_links(reps, threshold), "links").select("a", "b")
    groups = connected_components(links, "a", "b").withColumnsRenamed({"node": "rep", "component": "g"})
    degree = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    copies = members.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("n_copies"))
    per_class = copies.join(groups, "rep", "left").join(degree, "rep", "left").select("rep", "n_copies", F.coalesce("g", "rep").alias("g"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    placed = members.join(per_class, "rep").select("id", F.col("g").alias("group_id"), "n_links", "n_copies")
    ids = df.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    none = F.lit(0).cast("bigint")
    return ids.join(placed, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_copies", none).alias("n_copies"))
