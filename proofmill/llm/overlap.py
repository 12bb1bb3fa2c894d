"""Records that occur, wholly or almost, in two splits: content-defined chunks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions.paths import file_source
from proofmill.llm.words import _ODD, mix, run_hashes, set_key, word_hashes
from proofmill.operators.skew import salted_join
from proofmill.session import dropped, map_arrow, staged

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Mean chunk length in words. Short enough that an edit every fifteen words leaves most chunks whole.
MEAN = 4
#: Records of a block at most; a record's key is its block's number times this and its place.
BLOCK = 2048


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]).cumprod(dtype=np.uint64)[:n]


def cut_chunks(hashes: np.ndarray, bounds: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, length in words and text number of every chunk.

    A chunk ends after a word when the rolling hash of that word and the one before is 0 modulo ``mean``, so
    equal passages are cut alike wherever they stand; a text's end also ends one. The digest is a polynomial
    over the chunk's words.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        roll = hashes.copy()
        roll[1:] += hashes[:-1] * _ODD[1]
        first = bounds[:-1][np.diff(bounds) > 0]
        roll[first] = hashes[first]
        last = mix(roll) % _U(mean) == 0
        last[bounds[1:][np.diff(bounds) > 0] - 1] = True
        ends = np.flatnonzero(last) + 1
        starts = np.concatenate([[0], ends[:-1]])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * _powers(_BASE, n), dtype=np.uint64)])
        digest = mix((total[ends] - total[starts]) * _powers(_BACK, n)[starts] + (ends - starts).astype(np.uint64))
    return digest, ends - starts, np.searchsorted(bounds, starts, side="right") - 1


def _taken(hashes: np.ndarray, bounds: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The words and bounds of some of the texts."""
    parts = [hashes[bounds[i] : bounds[i + 1]] for i in at]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _packed(hashes: np.ndarray, bounds: np.ndarray) -> dict[str, bytes]:
    """Texts' words as their distinct hashes and numbers of these, a quarter of the hashes' size or less."""
    vocabulary, codes = np.unique(hashes, return_inverse=True)
    kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
    return {"lengths": np.diff(bounds).astype(np.uint32).tobytes(), "vocabulary": vocabulary.tobytes(), "codes": codes.astype(kind).tobytes()}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records' keys, words and bounds of a block."""
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    codes = np.frombuffer(row["codes"], np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32)
    bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.uint32), dtype=np.int64)])
    return np.frombuffer(row["records"], np.int64), vocabulary[codes], bounds


_TEXTS = "block bigint, held_out boolean, records binary, lengths binary, vocabulary binary, codes binary"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c, _ARROW[t]) for c, t in (x.split() for x in schema.split(", "))])


def _blocks(width: int):
    schema = _arrow(_TEXTS + ", ids binary, set_keys binary")

    def run(batches):
        block = TaskContext.get().partitionId() << 28
        for whole in batches:
            for batch in (whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK)):
                ids, held = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                hashes, bounds = word_hashes(batch.column(2).to_pylist())
                sets = run_hashes(hashes, bounds, width)
                for side in (True, False):
                    at = [i for i, r in enumerate(sets) if len(r) and held[i] == side]
                    if at:
                        keys = b"".join(set_key(sets[i]) for i in at)
                        row = {"block": block, "held_out": side, "records": np.arange(block * BLOCK, block * BLOCK + len(at)).tobytes(), **_packed(*_taken(hashes, bounds, at)), "ids": ids[at].tobytes(), "set_keys": keys}
                        yield pa.RecordBatch.from_pylist([row], schema)
                        block += 1

    return run


def _keys(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, records = (np.frombuffer(row[c], np.int64) for c in ("ids", "records"))
            keys = [row["set_keys"][k : k + 16] for k in range(0, 16 * len(ids), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([row["held_out"]] * len(ids)), pa.array(keys, pa.binary()), pa.array(records)], names=["id", "held_out", "set_key", "rep"])


def _kept(batches):
    """Of every block only the records named in ``kept``."""
    schema = _arrow(_TEXTS)
    for batch in batches:
        for row in batch.to_pylist():
            records, hashes, bounds = _unpacked(row)
            at = np.flatnonzero(np.isin(records, row["kept"])).tolist()
            yield pa.RecordBatch.from_pylist([row | {"records": records[at].tobytes(), **_packed(*_taken(hashes, bounds, at))}], schema)


def _run_sets(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The run sets of texts one after another, and their bounds."""
    sets = run_hashes(hashes, bounds, width)
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def _chunk_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct chunk digests of texts one after another, the words each makes up, and the texts' bounds in them."""
    digest, length, doc = cut_chunks(hashes, bounds, MEAN)
    order = np.lexsort((digest, doc))
    digest, length, doc = digest[order], length[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])
    return digest[new], np.add.reduceat(length, np.flatnonzero(new)), np.searchsorted(doc[new], np.arange(len(bounds)))


def _by_bucket(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings values together by bucket, theirs in it kept, and the buckets' bounds."""
    bucket = (values >> _U(32)) % _U(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


_ASKED = "bucket int, block bigint, vals binary, counts binary"


def _to_buckets(width: int, buckets: int, most: int = 2_000_000):
    """Runs (buckets from 0) and chunk digests (from ``buckets``), 32 bits each: the held-out ones as they stand, those of training with their numbers."""
    schema = _arrow(_ASKED)

    def rows(kind, values, block=None, counts=None):
        order, at = _by_bucket(values, buckets)
        low = (values & _U(0xFFFFFFFF)).astype(np.uint32)[order]
        full = np.flatnonzero(np.diff(at)).tolist()
        number = [counts[order[at[b] : at[b + 1]]].astype(np.uint32).tobytes() for b in full] if counts is not None else [None] * len(full)
        columns = ([kind * buckets + b for b in full], [block] * len(full), [low[at[b] : at[b + 1]].tobytes() for b in full], number)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    def run(batches):
        kept, size = ([], []), 0
        flushed = lambda: [rows(k, *(lambda v, n: (v, None, n))(*np.unique(np.concatenate(x), return_counts=True))) for k, x in enumerate(kept) if x]
        for batch in batches:
            for row in batch.to_pylist():
                _, hashes, bounds = _unpacked(row)
                for kind, values in enumerate((_run_sets(hashes, bounds, width)[0], _chunk_sets(hashes, bounds)[0])):
                    if row["held_out"]:
                        yield rows(kind, values, row["block"])
                    else:
                        kept[kind].append(values)
                        size += len(values)
                if size > most:
                    yield from flushed()
                    kept, size = ([], []), 0
        yield from flushed()

    return run


_COUNTED = "bucket int, block bigint, counts binary"


def _counted(table: pa.Table) -> pa.Table:
    """For a bucket's held-out values, in their order, the numbers of training records that have them."""
    rows = table.to_pylist()
    of_train = [(np.frombuffer(r["vals"], np.uint32), np.frombuffer(r["counts"], np.uint32)) for r in rows if r["block"] is None]
    values, at = np.unique(np.concatenate([np.empty(0, np.uint32), *(v for v, _ in of_train)]), return_inverse=True)
    numbers = np.bincount(at, np.concatenate([np.empty(0), *(n for _, n in of_train)]), len(values)).astype(np.int64)
    out = []
    for r in rows:
        if r["block"] is not None:
            asked = np.frombuffer(r["vals"], np.uint32)
            k = np.searchsorted(values, asked)
            n = np.where(np.append(values, 0)[k] == asked, np.append(numbers, 0)[k], 0) * (k < len(values))
            out.append({"bucket": r["bucket"], "block": r["block"], "counts": n.astype(np.min_scalar_type(n.max())).tobytes()})
    return pa.Table.from_pylist(out, _arrow(_COUNTED))


_LOOKED_UP = "val bigint, h bigint, n bigint, words int, all_words int, n_runs int"


def _rarest(width: int, buckets: int, contained: float, looked_up: float, at_least: int):
    """Rows of the runs (words 0) and chunks of a block's held-out records to look up in training; see ``cross_split_overlaps``."""
    schema = _arrow(_LOOKED_UP)

    def run(texts: pa.Table, counted: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        records, hashes, bounds = _unpacked(texts.to_pylist()[0])
        (runs, of_runs), (digests, words, of_chunks) = _run_sets(hashes, bounds, width), _chunk_sets(hashes, bounds)
        n_runs, n_digests = np.zeros(len(runs), np.int64), np.zeros(len(digests), np.int64)
        places = [_by_bucket(v, buckets) for v in (runs, digests)]
        for r in counted.to_pylist():
            kind, b = divmod(r["bucket"], buckets)
            order, at = places[kind]
            here = order[at[b] : at[b + 1]]
            (n_digests if kind else n_runs)[here] = np.frombuffer(r["counts"], f"u{len(r['counts']) // len(here)}")
        out = []
        for i, h in enumerate(records.tolist()):
            a, b = of_runs[i : i + 2]
            # a little less than the product, whose rounding must not cost a run
            first = b - a - math.ceil(contained * (b - a) - 1e-9) + 1
            k = a + np.lexsort((runs[a:b], n_runs[a:b]))[:first]
            k = k[n_runs[k] > 0]
            if not len(k):
                continue  # training lacks so many of its runs that no record has the rest
            same = (h, int(bounds[i + 1] - bounds[i]), int(b - a))
            out.append((runs[k], n_runs[k], np.zeros(len(k), np.int64), same))
            c, d = of_chunks[i : i + 2]
            k = c + np.lexsort((words[c:d], digests[c:d].view(np.int64), n_digests[c:d]))
            so_far = np.cumsum(words[k]) - words[k]
            k = k[((so_far <= looked_up * same[1]) | (np.arange(len(k)) < at_least)) & (n_digests[k] > 0)]
            out.append((digests[k], n_digests[k], words[k], same))
        if not out:
            return schema.empty_table()
        values, n, w = (np.concatenate(x) for x in list(zip(*out))[:3])
        h, every, size = (np.repeat([x[3][j] for x in out], [len(x[0]) for x in out]) for j in range(3))
        return pa.Table.from_arrays([pa.array(x.view(np.int64) if f.name == "val" else x, f.type) for x, f in zip((values, h, n, w, every, size), schema)], schema=schema)

    return run


def _bitmap(values: DataFrame, column: str) -> tuple[bytes, int]:
    """A bitmap that holds every value of a column by its highest bits, and their number; 16 bits a value, 2**28 at most."""
    bits = min(28, max(16, (16 * values.count()).bit_length()))
    top = F.shiftrightunsigned(column, 64 - bits)
    found = values.select((F.shiftright(top, 6)).alias("k"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("b")).groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("k").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out.tobytes(), bits


def _met(width: int, shared):
    """(val, t, t_runs): the runs and chunk digests of training records that are in the bitmap."""

    def run(batches):
        held, bits = shared.value
        held = np.frombuffer(held, np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                records, hashes, bounds = _unpacked(row)
                runs, of_runs = _run_sets(hashes, bounds, width)
                digests, _, of_chunks = _chunk_sets(hashes, bounds)
                for values, at in ((runs, of_runs), (digests, of_chunks)):
                    top = values >> _U(64 - bits)
                    k = np.flatnonzero((held[(top >> _U(6)).astype(np.int64)] >> (top & _U(63))) & _U(1))
                    doc = np.searchsorted(at, k, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(values[k].view(np.int64)), pa.array(records[doc]), pa.array(np.diff(of_runs)[doc].astype(np.int32))], names=["val", "t", "t_runs"])

    return run


_SENT = _TEXTS + ", h binary, t binary"


def _sent(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The held-out records of pairs, one row for each block of their training records."""
    if not texts.num_rows or not pairs.num_rows:
        return _arrow(_SENT).empty_table()
    row, h, t = texts.to_pylist()[0], pairs.column("h").to_numpy(), pairs.column("t").to_numpy()
    records, hashes, bounds = _unpacked(row)
    out = []
    for b in np.unique(t // BLOCK).tolist():
        here = t // BLOCK == b
        at = np.flatnonzero(np.isin(records, h[here])).tolist()
        out.append({"block": b, "held_out": True, "records": records[at].tobytes(), **_packed(*_taken(hashes, bounds, at)), "h": h[here].tobytes(), "t": t[here].tobytes()})
    return pa.Table.from_pylist(out, _arrow(_SENT))


_NEAR = "h bigint, t bigint, overlap double, shared double"


def _compared(width: int, contained: float):
    """Pairs whose run sets meet as asked, with the share of the held-out words in chunks that training has too."""

    def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.searchsorted(b, a)
        k[k == len(b)] = 0
        return b[k] == a

    def sets(row: dict, only: np.ndarray | None = None) -> dict[int, tuple]:
        records, hashes, bounds = _unpacked(row)
        if only is not None:
            at = np.flatnonzero(np.isin(records, only)).tolist()
            records, (hashes, bounds) = records[at], _taken(hashes, bounds, at)
        (runs, r), (digests, words, c) = _run_sets(hashes, bounds, width), _chunk_sets(hashes, bounds)
        return {x: (runs[r[i] : r[i + 1]], digests[c[i] : c[i + 1]], words[c[i] : c[i + 1]]) for i, x in enumerate(records.tolist())}

    def run(texts: pa.Table, sent: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and sent.num_rows:
            of_train = sets(texts.to_pylist()[0], np.concatenate([np.frombuffer(x, np.int64) for x in sent.column("t").to_pylist()]))
            for row in sent.to_pylist():
                of_held = sets(row)
                for h, t in zip(np.frombuffer(row["h"], np.int64).tolist(), np.frombuffer(row["t"], np.int64).tolist()):
                    (hr, hd, hw), (tr, td, _) = of_held[h], of_train[t]
                    if len(tr) >= contained * len(hr) - 1e-9 and (shared := int(within(hr, tr).sum()) / len(hr)) >= contained:
                        out.append({"h": h, "t": t, "overlap": float(hw[within(hd, td)].sum() / hw.sum()), "shared": shared})
        return pa.Table.from_pylist(out, _arrow(_NEAR))

    return run


def cross_split_overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, held_out: tuple[str, ...] = ("dev", "test"), train: tuple[str, ...] = ("train",), contained: float = 0.8, width: int = 3, looked_up: float = 0.7, at_least: int = 8, least_met: float = 0.06) -> DataFrame:
    """(held_id, train_id, overlap, shared): pairs of a held-out and a training record where at least
    ``contained`` of the distinct ``width``-word runs of the held-out text occur in the training text.

    Records of a side with equal run sets form a class and are compared once. Every record is cut into
    content-defined chunks; chunk digests are joined across the splits and the lengths of shared chunks summed
    to ``overlap``, their share of the held-out record. Of a record's chunks the rarest are looked up, to
    ``looked_up`` of its length and ``at_least`` so many, and pairs that share ``least_met`` of the length in
    these are candidates. No pair hangs on these bounds: a pair may lack n - ceil(contained n) of a held-out
    record's n runs, so of any one more it shares at least one; the rarest are looked up too, those that training
    lacks first, and every pair that they meet is a candidate. A record of which training lacks them all is in no
    pair. All candidates are checked on their full run sets (``shared``).

    Only texts' words are kept, a block of records a row and packed; runs and chunks are made of them anew in each
    step. Rarity is counted by bucket of their hashes: blocks send 32 bits a value there, and get numbers back. Equal
    bits make a value seem more frequent, which costs candidates only.

    A split is compared in lower case without outer blanks; rows of other or null splits, null or empty texts
    and texts without a run are in no pair; rows with a null id are ignored; repeated rows count once; an empty
    table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    split = F.lower(F.trim(F.col(split_col)))
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), split.isin(*held_out).alias("held_out"), F.col(text_col).alias("text"), split.alias("s")).where(F.col("s").isin(*held_out, *train) & F.col("id").isNotNull() & (F.length("text") > 0)).drop("s")
    blocks = staged(map_arrow(slim, _blocks(width), _TEXTS + ", ids binary, set_keys binary"), "blocks", "zstd")
    keys = map_arrow(blocks.select("ids", "held_out", "set_keys", "records"), _keys, "id bigint, held_out boolean, set_key binary, rep bigint", spread=False)
    reps = keys.groupBy("held_out", "set_key").agg(F.min("rep").alias("rep"))
    members = staged(keys.drop("rep").distinct().join(reps, ["held_out", "set_key"]).select("id", "held_out", "rep"), "members")
    kept = members.select("rep").distinct().groupBy(F.floor(F.col("rep") / BLOCK).alias("block")).agg(F.collect_list("rep").alias("kept"))
    columns = [x.split()[0] for x in _TEXTS.split(", ")]
    first = staged(map_arrow(blocks.select(*columns).join(kept, "block").select(*columns, "kept"), _kept, _TEXTS, spread=False), "classes", "zstd")
    dropped(blocks)
    of_held, of_train = first.where("held_out"), first.where("not held_out")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = map_arrow(first, _to_buckets(width, buckets), _ASKED).groupBy("bucket").applyInArrow(_counted, _COUNTED)
    rare = of_held.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_rarest(width, buckets, contained, looked_up, at_least), _LOOKED_UP)
    rare = staged(rare, "looked-up")
    shared = spark.sparkContext.broadcast(_bitmap(rare.select("val"), "val"))
    index = map_arrow(of_train, _met(width, shared), "val bigint, t bigint, t_runs int")
    met = salted_join(index, rare, "val", F.col("t"), how_many=rare.groupBy("val").agg(F.max("n").alias("n")))
    met = met.where(F.col("t_runs") >= contained * F.col("n_runs") - 1e-9).groupBy("h", "t").agg(F.sum("words").alias("met"), F.min("words").alias("least"), F.first("all_words").alias("all_words"))
    pairs = met.where((F.col("least") == 0) | (F.col("met") >= least_met * F.col("all_words"))).select(F.floor(F.col("h") / BLOCK).alias("block"), "h", "t")
    sent = of_held.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(_sent, _SENT)
    near = staged(of_train.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_compared(width, contained), _NEAR), "overlaps")
    held = members.where("held_out").select(F.col("rep").alias("h"), F.col("id").alias("held_id"))
    of_train = members.where("not held_out").select(F.col("rep").alias("t"), F.col("id").alias("train_id"))
    one = salted_join(held, near, "h", F.col("held_id"))
    return salted_join(one, of_train, "t", F.col("held_id")).where("held_id <> train_id").select("held_id", "train_id", "overlap", "shared").distinct()


def overlap_report(df: DataFrame, id_col: str, text_col: str, split_col: str, file_col: str, **how) -> DataFrame:
    """(split_name, source, n_pairs, n_records): overlapping pairs and held-out records per split and source.

    The source is the first two parts of the path that the held-out record's file resolves to; null stays null.
    """
    pairs = cross_split_overlaps(df, id_col, text_col, split_col, **how).select("held_id", "train_id")
    what = df.select(F.col(id_col).cast("bigint").alias("held_id"), F.lower(F.trim(F.col(split_col))).alias("split_name"), file_source(F.col(file_col)).alias("source")).dropDuplicates(["held_id"])
    return pairs.join(what, "held_id").groupBy("split_name", "source").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("held_id").alias("n_records"))
