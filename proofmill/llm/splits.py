"""Train, dev and test splits that keep groups of records together, allocated by min-cost flow over bundles of groups."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.session import staged

SHARES = (("train", 0.70), ("dev", 0.15), ("test", 0.15))
#: Steps of the share of positive rows that make up a group's label profile.
LABEL_STEPS = 4
#: Cost of a row beyond its split's quota, and of one beyond its bundle's even part.
QUOTA_COST, BUNDLE_COST = 8.0, 1.0


def group_profiles(df: DataFrame, key: Column, split: Column, positive: Column) -> DataFrame:
    """(entity_key, n_rows, n_splits, profile): every group with its size, its number of present splits and its label profile.

    Null keys form no group; null splits don't count; a null label counts as not positive.
    """
    rows = df.select(key.alias("entity_key"), split.alias("s"), F.coalesce(positive.cast("int"), F.lit(0)).alias("p")).where("entity_key is not null")
    part = rows.groupBy("entity_key", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"))
    whole = part.groupBy("entity_key").agg(F.sum("n").alias("n_rows"), F.count("s").alias("n_splits"), F.sum("p").alias("p"))
    return whole.select("entity_key", "n_rows", "n_splits", F.round(F.col("p") * LABEL_STEPS / F.col("n_rows")).cast("int").alias("profile"))


class Network:
    """A directed network with capacities and costs; ``send`` finds a min-cost flow by successive shortest paths."""

    def __init__(self, nodes: int):
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, u: int, v: int, capacity: int, cost: float) -> int:
        """Adds an arc and its reverse; the number by which ``sent`` knows it."""
        k = len(self.head)
        for node, to, cap, price in ((u, v, capacity, cost), (v, u, 0, -cost)):
            self.out[node].append(len(self.head))
            self.head.append(to)
            self.room.append(cap)
            self.cost.append(price)
        return k

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def send(self, source: int, sink: int) -> float:
        """Sends all that fits from source to sink, each time along a path of least cost; the total cost."""
        total = 0.0
        while True:
            dist, via = [math.inf] * len(self.out), [-1] * len(self.out)
            dist[source] = 0.0
            changed = True
            while changed:  # reverse arcs have negative costs, cycles of them none
                changed = False
                for u, arcs in enumerate(self.out):
                    for e in arcs:
                        if self.room[e] > 0 and dist[u] + self.cost[e] < dist[self.head[e]] - 1e-9:
                            dist[self.head[e]], via[self.head[e]], changed = dist[u] + self.cost[e], e, True
            if via[sink] < 0:
                return total
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.head[via[v] ^ 1]
            most = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= most
                self.room[e ^ 1] += most
            total += most * dist[sink]


def place_class(size: int, numbers: list[int], shares: list[float], room: list[float]) -> list[list[int]]:
    """The min-cost placement of bundles of groups of one ``size``, ``numbers`` of them each, in splits with ``room`` rows left.

    Groups flow from their bundle to a split and on to the sink. Convex costs are parallel arcs: from a bundle, groups
    up to a split's share are free, the one that passes it costs ``BUNDLE_COST`` for the rows beyond, further ones
    for all their rows; into the sink likewise with the room and ``QUOTA_COST``. All units are alike, so the flow is whole.
    """
    n, m = len(numbers), len(shares)
    net, source, sink = Network(n + m + 2), n + m, n + m + 1
    arcs = [[[] for _ in shares] for _ in numbers]

    def convex(u: int, v: int, free: float, most: int, price: float) -> list[int]:
        whole = max(0, math.floor(free + 1e-9))
        part = size * price * (1 - max(0.0, free - whole)) if free > 0 else size * price
        return [net.arc(u, v, whole, 0.0), net.arc(u, v, 1, part), net.arc(u, v, most, size * price)]

    for b, k in enumerate(numbers):
        net.arc(source, b, k, 0.0)
        for j, x in enumerate(shares):
            arcs[b][j] = convex(b, n + j, k * x, k, BUNDLE_COST)
    for j in range(m):
        convex(n + j, sink, room[j] / size, sum(numbers), QUOTA_COST)
    net.send(source, sink)
    return [[sum(map(net.sent, arcs[b][j])) for j in range(m)] for b in range(n)]


def allocate(bundles: list[tuple[int, int]], shares: list[float]) -> list[list[int]]:
    """Groups of each bundle (size, number) for each split.

    A row beyond a split's share of a bundle costs ``BUNDLE_COST``, one beyond a split's quota ``QUOTA_COST``. The
    bundles of one size are placed together by a min-cost flow, the largest size first, so that smaller groups even
    out what larger ones leave (``place_class``). Sizes differ, so the whole isn't one flow with a whole optimum: after it,
    groups move or change places between splits as long as a quota is exceeded and that lowers the cost.
    """
    m = len(shares)
    total = sum(s * k for s, k in bundles)
    room = [total * x for x in shares]
    flow = [[0] * m for _ in bundles]
    classes: dict[int, list[int]] = {}
    for b, (s, _) in enumerate(bundles):
        classes.setdefault(s, []).append(b)
    for s in sorted(classes, reverse=True):
        for b, f in zip(classes[s], place_class(s, [bundles[b][1] for b in classes[s]], shares, room)):
            flow[b] = f
            for j in range(m):
                room[j] -= s * f[j]
    while _exchange(bundles, shares, flow, room):
        pass
    return flow


def _exchange(bundles: list[tuple[int, int]], shares: list[float], flow: list[list[int]], room: list[float]) -> bool:
    """While a quota is exceeded, makes the best move of a group or swap of two; whether one lowers the cost."""
    if min(room, default=0.0) >= -1e-6:
        return False
    size = np.array([s for s, _ in bundles], dtype=np.int64)
    has = np.array(flow)

    def step(j: int, by: int) -> np.ndarray:
        """Cost of one group more or less of each bundle in a split."""
        x = np.array([k for _, k in bundles]) * shares[j]
        return BUNDLE_COST * size * (np.maximum(0, has[:, j] + by - x) - np.maximum(0, has[:, j] - x))

    best = (-1e-6, None)
    for over, to in itertools.permutations(range(len(room)), 2):
        held = [np.flatnonzero(has[:, j] > 0) for j in (over, to)]
        give, back = (x[np.argsort(size[x], kind="stable")] for x in held)
        if not len(give):
            continue
        # what d rows that go from one to the other change beyond the quotas
        beyond = lambda d: QUOTA_COST * (np.maximum(0, -room[over] - d) - max(0.0, -room[over]) + np.maximum(0, d - room[to]) - max(0.0, -room[to]))
        leave, enter = step(over, -1), step(to, 1)
        c = beyond(size[give]) + leave[give] + enter[give]
        k = int(np.argmin(c))
        if c[k] < best[0]:
            best = (float(c[k]), (over, to, int(give[k]), -1))
        if not len(back):
            continue
        back_leave, back_enter = step(to, -1), step(over, 1)
        # for each group given, the one taken back that leaves just the excess or just the room, and its neighbours
        for wish in {max(0.0, -room[over]), max(0.0, room[to])}:
            at = np.searchsorted(size[back], size[give] - wish)
            for shift in (-1, 0, 1):
                other = back[np.clip(at + shift, 0, len(back) - 1)]
                d = size[give] - size[other]
                c = np.where(d > 0, beyond(d) + leave[give] + enter[give] + back_leave[other] + back_enter[other], np.inf)
                k = int(np.argmin(c))
                if c[k] < best[0]:
                    best = (float(c[k]), (over, to, int(give[k]), int(other[k])))
    if best[1] is None:
        return False
    over, to, b, c = best[1]
    for bundle, a, z in ((b, over, to), (c, to, over)):
        if bundle >= 0:
            flow[bundle][a] -= 1
            flow[bundle][z] += 1
            room[a] += int(size[bundle])
            room[z] -= int(size[bundle])
    return True


def grouped_splits(groups: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, buckets: int = 64) -> DataFrame:
    """(entity_key, n_rows, n_splits, split_name): every group's split; ``groups`` as of ``group_profiles``.

    Groups of equal size and profile form a bundle; only bundles reach the driver. Distinct sizes number at most
    the root of twice the rows, times ``LABEL_STEPS + 1`` profiles. ``allocate`` sets how many groups of a bundle
    go to each split; its members are taken in the order of their keys' hashes, ranked in ``buckets`` parts of the
    hash range so that no task holds a whole bundle. Ties of the hash fall back to the key. A table without groups
    gives no rows. A single group of more rows than a split's quota goes where it exceeds it least.
    """
    g = groups.select("entity_key", "n_rows", "n_splits", "profile", F.xxhash64("entity_key").alias("h")).withColumn("bucket", F.shiftrightunsigned("h", 64 - int(math.log2(buckets))))
    bundle = ["n_rows", "profile"]
    sizes = g.groupBy(*bundle).agg(F.count(F.lit(1)).alias("k")).collect()
    sizes.sort(key=lambda r: (-r.n_rows, r.profile))
    flows = allocate([(r.n_rows, r.k) for r in sizes], [x for _, x in shares]) if sizes else []
    spark = groups.sparkSession
    names = [n for n, _ in shares]
    rows = [(r.n_rows, r.profile, [sum(f[: j + 1]) for j in range(len(names))]) for r, f in zip(sizes, flows)]
    plan = spark.createDataFrame(rows, "n_rows bigint, profile int, upto array<bigint>")
    per_bucket = g.groupBy(*bundle, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*bundle).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = g.withColumn("r", F.row_number().over(Window.partitionBy(*bundle, "bucket").orderBy("h", "entity_key")))
    placed = ranked.join(before, [*bundle, "bucket"]).join(plan, bundle).withColumn("r", F.col("r") + F.col("before"))
    first = F.size(F.filter("upto", lambda u: u < F.col("r"))) + 1
    return placed.select("entity_key", "n_rows", "n_splits", F.element_at(F.array(*map(F.lit, names)), first).alias("split_name"))


def broken_groups(groups: DataFrame) -> DataFrame:
    """(entity_key): groups whose rows are in more than one split at present."""
    return groups.where("n_splits > 1").select("entity_key")


def file_and_rule_groups(labeled: DataFrame, candidates: DataFrame, file_of: Column) -> dict[str, DataFrame]:
    """The two kinds of groups of this project: files of labelled documents and rules of candidates."""
    files = group_profiles(labeled, file_of, F.col("split_name"), F.size(F.coalesce("rule_ids", F.array())) > 0)
    rules = group_profiles(candidates, F.upper(F.trim(F.col("rule_id"))), F.col("rule_fold"), F.col("label") == 1)
    return {"file": staged(files, "files"), "rule": staged(rules, "rules")}
