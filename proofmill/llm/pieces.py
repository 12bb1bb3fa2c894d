"""Texts cut into overlapping pieces at natural boundaries, with their tags and spans."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.session import map_arrow

#: Cost of a cut after a blank line, a sentence, a word; anywhere else; and inside a span.
PENALTY = {"paragraph": 0.0, "sentence": 1.0, "word": 4.0, "none": 40.0, "span": 60.0}
#: Weight of the squared relative deviation of a piece from the even size.
IMBALANCE = 2.0

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_SENTENCE = re.compile(r"[.!?…][\"'»”)\]]*\s+|[。！？।॥؟][」』”）]*\s*")
_WORD = re.compile(r"\s+")
_BREAK = re.compile(r"[^ \t\r\n]+")

SCHEMA = "id bigint, piece_no int, n_pieces int, piece_start int, piece_end int, cut_at string, text string, bio_tags array<string>, spans array<struct<span_start int, span_end int, rule_id string>>, longest_run int"


def cut_points(text: str, limit: int, overlap: int, spans: list[tuple[int, int]] = ()) -> tuple[list[int], list[str]]:
    """Ends of the pieces of a text longer than ``limit``, and the kind of boundary at each.

    Piece k runs from ``overlap`` before the end of piece k - 1 to its own end, so a step between ends is at
    most ``limit - overlap``. Among all admissible sequences of ends the one of least total cost is taken: the
    penalty of each cut plus the imbalance of each step, by dynamic programming over the boundary positions.
    Positions without a boundary take part only where a stretch holds no other.
    """
    n, step = len(text), limit - overlap
    kinds: dict[int, str] = {}
    for name, pattern in (("word", _WORD), ("sentence", _SENTENCE), ("paragraph", _PARAGRAPH)):
        for m in pattern.finditer(text):
            kinds[m.end()] = name
    kinds.pop(0, None)
    kinds.pop(n, None)
    known = sorted(kinds)
    # where boundaries lie too far apart, admit bare positions at even distances of at most a sixteenth of a step
    gaps = max(1, step // 16)
    for a, b in zip([0, *known], [*known, n]):
        if b - a > step // 2:
            for p in range(a + gaps, b, gaps):
                kinds[p] = "none"
    pos = np.array([0, *sorted(kinds), n])
    cost = np.array([0.0, *(PENALTY[kinds[p]] for p in pos[1:-1].tolist()), 0.0])
    if len(spans):
        s = np.array(spans)
        # a position lies inside a span if more spans start before it than end at or before it
        inside = np.searchsorted(np.sort(s[:, 0]), pos, "left") - np.searchsorted(np.sort(s[:, 1]), pos, "right") > 0
        cost[1:-1] += PENALTY["span"] * inside[1:-1]
    even = (n - overlap) / max(1, -(-(n - overlap) // step))
    best, back = np.full(len(pos), np.inf), np.zeros(len(pos), np.int64)
    best[0] = 0.0
    low = np.searchsorted(pos, pos - step, "left")
    low[pos <= limit] = 0
    for j in range(1, len(pos)):
        i = np.arange(low[j], j)
        size = pos[j] - pos[i] - np.where(i == 0, overlap, 0)
        total = best[i] + IMBALANCE * ((size - even) / even) ** 2
        k = int(np.argmin(total))
        best[j], back[j] = total[k] + cost[j], i[k]
    ends, j = [], len(pos) - 1
    while j:
        ends.append(int(pos[j]))
        j = int(back[j])
    ends.reverse()
    return ends, [kinds.get(e, "end") for e in ends]


def _tags(tags: list | None, a: int, b: int) -> list | None:
    """Tags of a piece; an inside tag that lost its begin tag becomes one."""
    if tags is None:
        return None
    part = list(tags[a:b])
    if part and part[0] and part[0].startswith("I-"):
        part[0] = "B-" + part[0][2:]
    return part


def _spans(spans: list | None, a: int, b: int, n: int) -> list | None:
    """Spans of a piece, clipped to it and counted from its start; those of no length in it are left to others."""
    if spans is None:
        return None
    out = []
    for s in spans:
        if s is None or s["span_start"] is None or s["span_end"] is None:
            continue
        x, y = max(s["span_start"], a), min(s["span_end"], b, n)
        if x < y:
            out.append({"span_start": x - a, "span_end": y - a, "rule_id": s["rule_id"]})
    return out


#: Rows whose tags are Python objects at once.
SLICE = 256


def _cut(limit: int, overlap: int):
    schema = pa.schema([("id", pa.int64()), *((k, pa.int32()) for k in ("piece_no", "n_pieces", "piece_start", "piece_end")), ("cut_at", pa.string()), ("text", pa.string()), ("bio_tags", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("span_start", pa.int32()), ("span_end", pa.int32()), ("rule_id", pa.string())]))), ("longest_run", pa.int32())])

    def whole(part, rows: list[int], texts: list) -> pa.RecordBatch:
        """Rows that stay as they are; tags and spans pass through untouched."""
        at = pa.array(rows, pa.int64())
        sizes = [None if texts[i] is None else len(texts[i]) for i in rows]
        longest = [None if texts[i] is None else max(map(len, _BREAK.findall(texts[i])), default=0) for i in rows]
        n = len(rows)
        given = [part.column(k).take(at) for k in range(4)]
        ends = ["end" if x is not None else None for x in sizes]
        starts = [0 if x is not None else None for x in sizes]
        columns = [given[0], [0] * n, [1] * n, starts, sizes, ends, given[1], given[2], given[3], longest]
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def cut(part, rows: list[int], texts: list) -> pa.RecordBatch:
        out = {k: [] for k in schema.names}
        for i in rows:
            key, text, n = part.column(0)[i].as_py(), texts[i], len(texts[i])
            tags, spans = part.column(2)[i].as_py(), part.column(3)[i].as_py()
            longest = max(map(len, _BREAK.findall(text)), default=0)
            inside = [(s["span_start"], s["span_end"]) for s in spans or () if s and s["span_start"] is not None and s["span_end"] is not None and s["span_start"] < s["span_end"]]
            ends, kinds = cut_points(text, limit, overlap, inside)
            for k, (e, kind) in enumerate(zip(ends, kinds)):
                a = ends[k - 1] - overlap if k else 0
                row = (key, k, len(ends), a, e, kind, text[a:e], _tags(tags, a, e), _spans(spans, a, e, n), longest)
                for name, v in zip(schema.names, row):
                    out[name].append(v)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = part.column(1).to_pylist()
                long = [i for i, t in enumerate(texts) if t is not None and len(t) > limit]
                short = [i for i, t in enumerate(texts) if t is None or len(t) <= limit]
                if short:
                    yield whole(part, short, texts)
                for k in range(0, len(long), 16):
                    yield cut(part, long[k : k + 16], texts)

    return run


def cut_pieces(df: DataFrame, id_col: str = "labeled_id", text_col: str = "text", tags_col: str | None = "bio_tags", spans_col: str | None = "spans", limit: int = 2400, overlap: int = 200) -> DataFrame:
    """Every record as pieces of at most ``limit`` code points; consecutive ones overlap by exactly ``overlap``.

    Ends of pieces fall after blank lines, sentences or words where they can and outside spans where that is
    avoidable (``cut_points``); a stretch without any boundary is cut anyway. Tags are cut alike, a leading
    ``I-`` becomes ``B-``; spans are clipped to each piece they reach into and re-based. ``longest_run`` is the
    record's longest stretch without space, tab, CR or LF.

    A record within the limit is one piece as it stands, with tags and spans unchanged (short, null,
    overlapping or beyond the end). A null text gives one piece with null text and bounds, an empty one a piece
    of length 0. In cut records spans with null bounds or beyond the end are left out. Repeated rows give
    repeated pieces; null ids are kept; an empty table gives none; other columns aren't read. Without
    ``tags_col`` or ``spans_col`` these are null.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    span = "array<struct<span_start:int,span_end:int,rule_id:string>>"
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), (F.col(tags_col) if tags_col else F.lit(None).cast("array<string>")).alias("tags"), (F.col(spans_col) if spans_col else F.lit(None)).cast(span).alias("spans"))
    return map_arrow(slim, _cut(limit, overlap), SCHEMA).withColumnRenamed("id", id_col)


def oversized(df: DataFrame, limit: int = 2400, **how) -> DataFrame:
    """(id, kind): 'oversized' for records that had to be cut, 'long_run' for those with a stretch longer than the limit.

    Every record is cut whole, with its tags and spans.
    """
    pieces = cut_pieces(df, limit=limit, **how)
    key = pieces.columns[0]
    kinds = F.array_compact(F.array(F.when(F.col("n_pieces") > 1, "oversized"), F.when(F.col("longest_run") > limit, "long_run")))
    return pieces.where("piece_no = 0").select(key, F.explode(kinds).alias("kind")).distinct()
