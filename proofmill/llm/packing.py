"""Documents packed into containers of fixed token capacity: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.session import map_arrow, ship, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split before merges that the public rank files were made for; a fixed value.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank before a visible character always begins a token, so texts may be counted in parts cut there.
_PARTS = re.compile(r" (?=\S)")
_COMMENT = re.compile(r"^[ \t]*%.*$", re.M)
#: Parts longer than this aren't kept; the cache of a worker starts afresh beyond so many.
LONGEST_KEPT, MOST_KEPT = 48, 400_000


class _Counter(dict):
    """Tokens of a part of text that follows a blank."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(os.path.basename(path), pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> int:
        n = len(self.encode(" " + part))
        if len(part) <= LONGEST_KEPT:
            if len(self) > MOST_KEPT:
                self.clear()
            self[part] = n
        return n

    def tokens(self, text: str) -> int:
        first, *rest = _PARTS.split(text)
        return (len(self.encode(first)) if first else 0) + sum(map(self.__getitem__, rest))


_counters: dict[str, _Counter] = {}


def counter(path: str = TOKENIZER) -> _Counter:
    """The worker's token counter for a rank file."""
    if path not in _counters:
        _counters[path] = _Counter(path)
    return _counters[path]


def _sizes(path: str):
    def run(batches):
        count = counter(path).tokens
        for batch in batches:
            tokens, bearing = [], []
            for text in batch.column(1).to_pylist():
                n = count(text) if text else 0
                rest = sum(map(count, _COMMENT.findall(text))) if text and "%" in text else 0
                tokens.append(n)
                bearing.append(max(0, n - rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(bearing, pa.int64())], names=["doc_id", "tokens", "bearing"])

    return run


def pack_vectors(sizes: np.ndarray, capacity: tuple[int, ...]) -> np.ndarray:
    """The container of every item: items are rows of ``sizes``, none beyond ``capacity`` in any dimension.

    One container is open at a time. It takes, of all kinds of items that still fit in every dimension, one
    whose size has the largest dot product with the room that is left (both as shares of the capacity), until
    none fits. Items of equal size are one kind, so a step costs a pass over kinds, not items.
    """
    cap = np.asarray(capacity, np.float64)
    kinds, kind_of, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    kind_of = kind_of.ravel()
    share = kinds / cap
    items = np.argsort(kind_of, kind="stable")
    at = np.concatenate([[0], np.cumsum(left)])[:-1].tolist()
    left = left.tolist()
    out = np.empty(len(sizes), np.int64)
    alive = np.arange(len(kinds))
    box = -1
    while len(alive):
        box += 1
        room = cap.copy()
        fit = alive
        while True:
            fit = fit[(kinds[fit] <= room).all(axis=1)]
            if not len(fit):
                break
            k = int(fit[np.argmax(share[fit] @ (room / cap))])
            out[items[at[k]]] = box
            at[k] += 1
            left[k] -= 1
            room -= kinds[k]
            if not left[k]:
                fit = fit[fit != k]
                alive = alive[alive != k]
    return out


def _pack(capacity: tuple[int, int, int]):
    def run(key, table):
        tokens, bearing = (table.column(c).to_numpy() for c in ("n_tokens", "bearing"))
        boxes = pack_vectors(np.stack([tokens, np.ones_like(tokens), bearing], axis=1), capacity)
        ids = (int(key[0].as_py()) << 32) + boxes
        return table.select(["doc_id", "piece_no", "token_start", "token_end", "n_tokens", "bearing"]).append_column("container_id", pa.array(ids, pa.int64()))

    return run


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, segments: int = 64, bearing: int | None = None, tokenizer: str = TOKENIZER, per_shard: int = 25_000) -> DataFrame:
    """(id, piece_no, token_start, token_end, n_tokens, loss_tokens, container_id): the container of every document.

    A container holds at most ``capacity`` tokens, ``segments`` documents or pieces and ``bearing``
    loss-bearing tokens (all tokens but those of comment lines; by default as many as ``capacity``). A document of
    more than ``capacity`` tokens is cut into full pieces and a rest, which is packed like any other; its
    pieces count as loss-bearing throughout. No other document is cut. One whose loss-bearing tokens alone
    exceed ``bearing`` is cut into pieces of ``bearing`` tokens.

    Items are spread by hash over shards of about ``per_shard``, each packed by one task (``pack_vectors``); at
    most the last container of a shard is left part empty for want of items. Null and empty texts have no
    tokens and a null container. Repeated rows are packed each; null ids are kept; an empty table gives no
    rows; other columns aren't read.
    """
    bearing = capacity if bearing is None else bearing
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counted = staged(map_arrow(slim, _sizes(tokenizer), "doc_id bigint, tokens bigint, bearing bigint"), "tokens")
    whole = (F.col("tokens") <= capacity) & (F.col("bearing") <= bearing)
    unit = min(capacity, bearing)
    starts = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.lit(unit).cast("bigint")))
    cut = counted.select("*", whole.alias("whole"), F.posexplode(starts).alias("piece_no", "token_start"))
    end = F.when(F.col("whole"), F.col("tokens")).otherwise(F.least(F.col("tokens"), F.col("token_start") + unit))
    cut = cut.withColumn("token_end", end).withColumn("n_tokens", F.col("token_end") - F.col("token_start")).withColumn("bearing", F.when(F.col("whole"), F.col("bearing")).otherwise(F.col("n_tokens")))
    cut = cut.select("doc_id", "piece_no", "token_start", "token_end", "n_tokens", "bearing", F.xxhash64("doc_id", "piece_no", "token_end").alias("h"))
    n = counted.where("tokens > 0").agg(F.sum(F.ceil(F.col("tokens") / unit))).first()[0] or 0
    shards = max(1, -(-int(n) // per_shard))
    ship(df.sparkSession)
    schema = "doc_id bigint, piece_no int, token_start bigint, token_end bigint, n_tokens bigint, bearing bigint, container_id bigint"
    packed = cut.where("n_tokens > 0").withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(_pack((capacity, segments, bearing)), schema)
    empty = cut.where("n_tokens = 0").drop("h").withColumn("container_id", F.lit(None).cast("bigint"))
    return packed.unionByName(empty).withColumnsRenamed({"doc_id": id_col, "bearing": "loss_tokens"})


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(container_id, n_segments, n_tokens, n_loss_tokens, unused): what every container holds."""
    filled = packed.where("container_id is not null").groupBy("container_id")
    return filled.agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n_tokens").alias("n_tokens"), F.sum("loss_tokens").alias("n_loss_tokens"), (F.lit(capacity) - F.sum("n_tokens")).alias("unused"))
