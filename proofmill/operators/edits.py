"""Edits of texts: conflicts, application, automatic fixes repeated until nothing changes."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.operators.parsing import all_regions
from proofmill.session import map_arrow

#: Passes of the fix loop.
MOST_PASSES = 64
#: Automatic fixes: rule, pattern, replacement, whether protected regions are spared. Fixed values.
FIXES = (
    ("SPC-002", r"[ \t]+(?=\n|$)", "", False),
    ("SPC-005", r"[ \t]+\r(?=\n)", "\r", False),
    ("SPC-003", r"\t", "    ", True),
    ("TYPO-005", r"(?<!\.)\.\.\.(?!\.)", r"\\dots{}", True),
    ("TYPO-018", r"(?<=[^ \n]) {2,}(?=[^ \n])", " ", True),
    ("TYPO-006", r"\u200b", "", False),
    ("ENC-002", r"(?<!^)\ufeff", "", False),
    ("TYPO-001", r'(?<![\\\w])"(?=\w)', "``", True),
    ("SPC-010", r"\n{4,}", "\n\n\n", True),
)
_FIXES = tuple((rule, re.compile(p), by, spared) for rule, p, by, spared in FIXES)


def conflicts(edits: DataFrame) -> DataFrame:
    """(doc_id, a, b): pairs of edits, by their ``no``, that can't both be made; ``edits``: doc_id, no, start, end, replacement.

    Ranges are half open. Two edits conflict where they overlap; two insertions never do, an insertion and another edit
    only strictly inside it, and equal edits are one. The pairs meet in blocks of 256 characters that both touch.
    """
    e = edits.where("start is not null and end is not null and end >= start").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / 256), F.floor(F.col("end") / 256))))
    x, y = e.alias("x"), e.alias("y")
    met = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x._block") == F.col("y._block")) & (F.col("x.no") < F.col("y.no")))
    a, b, c, d = (F.col(k) for k in ("x.start", "x.end", "y.start", "y.end"))
    point = lambda s, t: s == t
    clash = F.when(point(a, b) & point(c, d), F.lit(False)).when(point(a, b), (c < a) & (a < d)).when(point(c, d), (a < c) & (c < b)).otherwise((a < d) & (c < b))
    same = (a == c) & (b == d) & F.col("x.replacement").eqNullSafe(F.col("y.replacement"))
    return met.where(clash & ~same).select(F.col("x.doc_id"), F.col("x.no").alias("a"), F.col("y.no").alias("b")).distinct()


def chosen(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of the edits, in their order of preference, each that conflicts with none before it; by place."""
    out: list[tuple[int, int, str]] = []
    for e in dict.fromkeys(edits):
        a, b, _ = e
        if not any((a < d and c < b) if a < b and c < d else (c < a < d) if a == b and c < d else (a < c < b) if a < b and c == d else False for c, d, _ in out):
            out.append(e)
    return sorted(out, key=lambda e: (e[0], e[1]))


def applied(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with edits made that don't conflict, given by place."""
    out, at = [], 0
    for a, b, by in edits:
        out += (text[at:a], by)
        at = b
    return "".join(out) + text[at:]


_APPLIED = pa.schema([("doc_id", pa.int64()), ("edited", pa.string()), ("n_made", pa.int32())])


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, edited, n_made): documents with as many edits made as go together, lower ``no`` first.

    Edits beyond the text or with null bounds are left out; documents without edits come out as they are; null texts are left out.
    """
    per = edits.where("start is not null and end is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "start", "end", F.coalesce("replacement", F.lit("")).alias("by")))).alias("edits"))
    both = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(per, "doc_id", "left").select("doc_id", "text", "edits")

    def run(batches):
        for b in batches:
            rows = []
            for i, text, es in zip(*(c.to_pylist() for c in b.columns)):
                made = chosen([(e["start"], e["end"], e["by"]) for e in es or () if 0 <= e["start"] <= e["end"] <= len(text)])
                rows.append((i, applied(text, made), len(made)))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows) if rows else ((), (), ()), _APPLIED)], schema=_APPLIED)

    return map_arrow(both, run, "doc_id bigint, edited string, n_made int", spread=False)


def fix_edits_of(text: str) -> list[tuple[str, int, int, str]]:
    """(rule, start, end, replacement) of the automatic fixes, protected regions spared where the fix says so."""
    keep, out = all_regions(text), []
    for rule, pattern, by, spared in _FIXES:
        k = 0
        for m in pattern.finditer(text):
            a, b = m.span()
            if spared:
                while k < len(keep) and keep[k][2] <= a:
                    k += 1
                if k < len(keep) and keep[k][1] < b:
                    continue
            out.append((rule, a, b, m.expand(by) if "\\" in by else by))
    return out


def fixed(text: str, most_passes: int = MOST_PASSES) -> tuple[str, int, int, str]:
    """The text fixed again and again, the passes, the edits made, and how it ended: clean, cycle or limit."""
    seen, made = {hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()}, 0
    for k in range(most_passes):
        edits = chosen([e[1:] for e in fix_edits_of(text)])
        new = applied(text, edits)
        if new == text:
            return text, k, made, "clean"
        made += len(edits)
        digest = hashlib.md5(new.encode("utf-8", "surrogatepass")).digest()
        if digest in seen:
            return new, k + 1, made, "cycle"
        seen.add(digest)
        text = new
    return text, most_passes, made, "limit"


_FIXED = pa.schema([("doc_id", pa.int64()), ("fixed", pa.string()), ("passes", pa.int32()), ("n_edits", pa.int32()), ("ended", pa.string())])
_EDITS = pa.schema([("doc_id", pa.int64()), ("no", pa.int32()), ("rule_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())])


def fix_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, no, rule_id, start, end, replacement): the edits that the automatic fixes propose in one pass."""

    def run(batches):
        for b in batches:
            rows = [(i, k, *e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, e in enumerate(fix_edits_of(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), _EDITS)], schema=_EDITS)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null"), run, "doc_id bigint, no int, rule_id string, start int, end int, replacement string")


def fix_all(docs: DataFrame) -> DataFrame:
    """(doc_id, fixed, passes, n_edits, ended): every document fixed until nothing changes; null texts are left out."""

    def run(batches):
        for b in batches:
            rows = [(i, *fixed(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows) if rows else ((),) * 5, _FIXED)], schema=_FIXED)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null"), run, "doc_id bigint, fixed string, passes int, n_edits int, ended string")


def shifted(start: Column, end: Column, edit_start: Column, edit_end: Column, replacement: Column) -> Column:
    """A span after an edit, as (start, end, damaged): moved if the edit lies before it, kept if behind, else damaged."""
    by = F.length(replacement) - (edit_end - edit_start)
    before, behind = edit_end <= start, edit_start >= end
    return F.struct(F.when(before, start + by).otherwise(start).alias("start"), F.when(before, end + by).otherwise(end).alias("end"), (~before & ~behind).alias("damaged"))


def dirty_region(old: Column, new: Column) -> Column:
    """(start, old_end, new_end): what lies between the longest common beginning and end of two texts, by halving."""

    def longest(holds) -> Column:
        most = F.least(F.length(old), F.length(new))
        bits = F.sequence(F.lit(30), F.lit(0), F.lit(-1))
        return F.aggregate(bits, F.lit(0), lambda k, b: F.when((k + F.call_function("shiftleft", F.lit(1), b) <= most) & holds(k + F.call_function("shiftleft", F.lit(1), b)), k + F.call_function("shiftleft", F.lit(1), b)).otherwise(k))

    head = longest(lambda k: F.substr(old, F.lit(1), k) == F.substr(new, F.lit(1), k))
    tail = longest(lambda k: F.right(old, k) == F.right(new, k))
    rest = F.least(F.length(old), F.length(new)) - head
    tail = F.least(tail, rest)
    return F.struct(head.alias("start"), (F.length(old) - tail).alias("old_end"), (F.length(new) - tail).alias("new_end"))
