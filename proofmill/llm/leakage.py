"""Held-out passages inside a corpus: an FM-index over the words of every shard, searched backwards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.words import WORD, words
from proofmill.session import map_arrow

#: Words of a shard; its index takes about 100 bytes a word.
SHARD_WORDS = 1 << 20
#: Every so many text positions, the suffix array keeps its entry.
SAMPLE = 16
#: Words of held-out text searched in one pass over the corpus, so that what is broadcast stays under some 50 MB.
BLOCK_WORDS = 1_000_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling that sorts only what is still tied."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    h = 1
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        # groups of equal rank, as stretches of the order
        edge = np.append(np.flatnonzero(first), n)
        size = np.diff(edge)
        tied = np.repeat(size > 1, size)
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        pos = order[slots]
        nxt = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        group = rank[pos]
        by = np.argsort(group * (n + 1) + nxt, kind="stable")
        order[slots] = pos[by]
        g, x = group[by], nxt[by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
        first[slots] = new
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector with running counts for every bit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, s = bits, [], sequence
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            zeros = np.concatenate([np.zeros(1, np.int32), np.cumsum(1 - bit, dtype=np.int32)])
            self.levels.append(zeros)
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        a = np.zeros_like(i)
        for k, zeros in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            za, zi, all_zeros = zeros[a], zeros[i], zeros[-1]
            a = np.where(one, all_zeros + a - za, za)
            i = np.where(one, all_zeros + i - zi, zi)
        return i - a

    def symbol(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions i."""
        out = np.zeros_like(i)
        for zeros in self.levels:
            one = zeros[i + 1] == zeros[i]
            i = np.where(one, zeros[-1] + i - zeros[i], zeros[i])
            out = out * 2 + one
        return out


class FMIndex:
    """Backward search and location of phrases in a sequence of small non-negative integers."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text + 1, 0)  # 0 ends the text and is smaller than all else
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.wavelet = WaveletMatrix(bwt, int(symbols + 1).bit_length())
        kept = sa % SAMPLE == 0
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.samples = sa[kept]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``phrases`` that occur, and their suffix intervals."""
        live = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k].astype(np.int64) + 1
            lo, hi = (self.before[c] + self.wavelet.rank(c, x) for x in (lo, hi))
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, todo = rows.astype(np.int64), np.arange(len(rows))
        while len(todo):
            hit = self.kept_rank[at + 1] > self.kept_rank[at]
            out[todo[hit]] = self.samples[self.kept_rank[at[hit]]] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            steps[todo] += 1
            c = self.wavelet.symbol(at)
            at = self.before[c] + self.wavelet.rank(c, at)
        return out


def item_phrases(items: list[tuple[int, str]], width: int) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the items' words (1 up), their distinct ``width``-word phrases, and which items hold which phrase."""
    symbols: dict[str, int] = {}
    rows, owners = [], []
    for item, text in items:
        w = [symbols.setdefault(x, len(symbols) + 1) for x in words(text)]
        for k in range(len(w) - width + 1):
            rows.append(w[k : k + width])
            owners.append(item)
    if not rows:
        return symbols, np.empty((0, width), np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    phrases, which = np.unique(np.array(rows, np.int32), axis=0, return_inverse=True)
    held = np.unique(np.stack([which.ravel(), np.array(owners, np.int64)], axis=1), axis=0)
    return symbols, phrases, held[:, 0], held[:, 1]


def _search(symbols: dict[str, int], phrases: np.ndarray, held_by: np.ndarray, items: np.ndarray, width: int):
    first = np.searchsorted(held_by, np.arange(len(phrases) + 1))

    def shard(texts: list[str], ids: list, parts: list[np.ndarray]):
        """Matches of the shard's texts: row of ``texts``, first word, phrase."""
        lengths = np.array([len(p) for p in parts])
        doc = np.repeat(np.arange(len(parts)), lengths + 1)
        word = np.concatenate([np.append(np.arange(k), -1) for k in lengths]) if len(lengths) else np.empty(0, np.int64)
        sym = np.concatenate([np.append(p, 0) for p in parts])
        # words that no item has separate; only stretches of at least ``width`` known words can hold a phrase
        known = sym > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        long = end - start >= width
        start, end = start[long], end[long]
        if not len(start):
            return
        keep = np.zeros(len(sym) + 1, np.int64)
        np.add.at(keep, start, 1)
        np.add.at(keep, np.minimum(end + 1, len(sym)), -1)  # with the separator behind
        at = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        index = FMIndex(sym[at], len(symbols) + 1)
        which, lo, hi = index.search(phrases)
        if not len(which):
            return
        n = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pos = at[index.locate(rows)]
        yield from _spans(texts, ids, doc[pos], word[pos], np.repeat(which, n))

    def _spans(texts, ids, doc, word, which):
        order = np.lexsort((word, doc))
        doc, word, which = doc[order], word[order], which[order]
        out = {"doc_id": [], "span_start": [], "span_end": [], "n_words": [], "items": []}
        bounds = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            d, w = int(doc[a]), word[a:b]
            text = texts[d]
            at = [m.span() for m in WORD.finditer(text if "İ" in text else text.lower())]
            cut = np.concatenate([[0], np.flatnonzero(w[1:] > w[:-1] + width) + 1, [b - a]])
            for x, y in zip(cut[:-1], cut[1:]):
                found = sorted({int(i) for p in set(which[a + x : a + y].tolist()) for i in items[first[p] : first[p + 1]]})
                last = int(w[y - 1]) + width
                for k, v in zip(out, (ids[d], at[int(w[x])][0], at[last - 1][1], last - int(w[x]), found)):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("n_words", pa.int32()), ("items", pa.list_(pa.int64()))]))

    def run(batches):
        get = symbols.get
        texts, ids, parts, size = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(t)
                if len(found) < width:
                    continue
                texts.append(t)
                ids.append(i)
                parts.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
                size += len(found)
                if size >= SHARD_WORDS:
                    yield from shard(texts, ids, parts)
                    texts, ids, parts, size = [], [], [], 0
        if parts:
            yield from shard(texts, ids, parts)

    return run


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", width: int = 12) -> DataFrame:
    """(doc_id, span_start, span_end, n_words, items): the stretches of every document that items' texts cover.

    A document and an item match where they share ``width`` consecutive words or more; overlapping matches of
    any items merge into one span of code points, with all items that have a part in it. Each task indexes
    the words of its documents in shards of ``SHARD_WORDS`` and searches every ``width``-word phrase of the items
    in each. The items are taken in blocks of at most ``BLOCK_WORDS`` words, a pass over the documents each
    (spans of different blocks aren't merged), so what goes to a task is bounded however many items there are.

    Null and empty texts, and those of fewer than ``width`` words, match nothing; so do rows of a null id. A
    repeated document gives repeated spans; equal items all come out. Empty tables give no rows. Other columns
    aren't read.
    """
    held = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("i is not null and length(t) > 0")
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and length(text) > 0")
    schema = "doc_id bigint, span_start int, span_end int, n_words int, items array<bigint>"
    out, block, size = None, [], 0

    def add(out: DataFrame | None, block: list) -> DataFrame:
        found = map_arrow(slim, _search(*item_phrases(block, width), width), schema)
        return found if out is None else out.union(found)

    for r in held.toLocalIterator():
        block.append((r.i, r.t))
        size += 1 + len(r.t) // 4
        if size >= BLOCK_WORDS:
            out, block, size = add(out, block), [], 0
    if block or out is None:
        out = add(out, block)
    return out


def leaked_items(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id): every document with every item of which it holds a passage."""
    spans = leaked_spans(docs, items, **how)
    return spans.select("doc_id", F.explode("items").alias("item_id")).distinct()
