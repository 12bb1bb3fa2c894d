"""Exact regions and an error-recovering parser of marked-up text, as flat tables; a document a row, Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.session import map_arrow

#: Environments of mathematics, of literal text, and commands whose first argument is an address. Fixed values.
MATH_ENVS = frozenset("math displaymath equation eqnarray align alignat flalign gather multline subequations split aligned gathered cases array xalignat xxalignat".split())
VERBATIM_ENVS = frozenset("verbatim Verbatim lstlisting minted alltt comment filecontents BVerbatim LVerbatim SaveVerbatim verbatimtab".split())
ADDRESS = frozenset(("url", "nolinkurl", "path", "href"))
#: Depth beyond which groups and environments are no longer opened.
MOST_DEPTH = 500
#: Characters of documents whose rows a worker gathers before it hands them on.
MOST_CHARS = 250_000

_NAME = re.compile(r"\\([A-Za-z@]+)\*?")
_ENV = re.compile(r"\\(begin|end)[ \t]*\{([^{}\n]*)\}")
_TEXT = re.compile(r"[^\s\\%${}]+")
_BLANK = re.compile(r"[ \t]+|\r\n|\n|\r")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")


def _argument(text: str, at: int) -> tuple[int, int] | None:
    """Bounds of the braced argument at ``at``, braces included, or None if none is closed there."""
    if text[at : at + 1] != "{":
        return None
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if not depth:
                return at, m.end()
    return None


def _line_end(text: str, at: int) -> int:
    m = re.compile(r"[\r\n]").search(text, at)
    return m.start() if m else len(text)


def literal_regions(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of comments, literal text and addresses, left to right; whatever opens first wins."""
    out = []
    for_next = re.compile(r"\\.|%", re.S)
    at = 0
    while m := for_next.search(text, at):
        a = m.start()
        if m.group() == "%":
            at = _line_end(text, a)
            out.append(("comment", a, at))
            continue
        at = m.end()
        name = _NAME.match(text, a)
        if not name:
            continue
        word, end = name.group(1), name.end()
        if word in ("verb", "lstinline") and end < len(text) and not text[end].isspace():
            if word == "lstinline" and text[end] == "[":
                end = text.find("]", end) + 1 or end
            close = text.find(text[end], end + 1, _line_end(text, end)) if end < len(text) else -1
            at = close + 1 if close >= 0 else _line_end(text, end)
            out.append(("verbatim", a, at))
        elif word == "begin" and (env := _ENV.match(text, a)) and env.group(2).rstrip("*") in VERBATIM_ENVS:
            close = text.find("\\end{" + env.group(2) + "}", env.end())
            at = close + len(env.group(2)) + 6 if close >= 0 else len(text)
            out.append(("verbatim", a, at))
        elif word in ADDRESS and (arg := _argument(text, end)):
            at = arg[1]
            out.append(("address", a, at))
        else:
            at = end if word not in ("begin",) else a + 6
    return out


def blanked(text: str, ranges: list[tuple[str, int, int]]) -> str:
    """``text`` with the regions turned into blanks, so that offsets stay."""
    out, at = [], 0
    for _, a, b in ranges:
        out += (text[at:a], " " * (b - a))
        at = b
    return "".join(out) + text[at:]


_MATH = re.compile(r"\\\\|\\\(|\\\)|\\\[|\\\]|\\[$%]|\$\$|\$|\\(?:begin|end)\{([A-Za-z]+)\*?\}")


def math_regions(text: str, literal: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(inline or display, start, end) of mathematics outside literal regions; nested openers belong to the outermost.

    An opener without its closer is none; inline mathematics doesn't cross a blank line. ``literal``: the text's
    literal regions, where they are known.
    """
    plain = blanked(text, literal_regions(text) if literal is None else literal)
    out, at = [], 0
    while m := _MATH.search(plain, at):
        a, opener, at = m.start(), m.group(), m.end()
        if opener in ("$", "$$", "\\(", "\\["):
            closer = {"\\(": "\\)", "\\[": "\\]"}.get(opener, opener)
            limit = p.start() if opener in ("$", "\\(") and (p := _PARAGRAPH.search(plain, at)) else len(plain)
            end = next((n.end() for n in _MATH.finditer(plain, at, limit) if n.group() == closer), None)
        elif opener.startswith("\\begin") and m.group(1) in MATH_ENVS:
            depth, end = 1, None
            for n in _MATH.finditer(plain, at):
                if n.group(1) == m.group(1):
                    depth += 1 if n.group().startswith("\\begin") else -1
                    if not depth:
                        end = n.end()
                        break
        else:
            continue
        if end is not None:
            out.append(("inline" if opener in ("$", "\\(") or m.group(1) == "math" else "display", a, end))
            at = end
    return out


def all_regions(text: str) -> list[tuple[str, int, int]]:
    literal = literal_regions(text)
    return sorted(literal + math_regions(text, literal), key=lambda r: r[1:])


class _Nodes:
    """Nodes of one document in the order of their starts: (parent, kind, name, start, end, depth)."""

    def __init__(self):
        self.rows: list[list] = []
        self.errors: list[tuple[str, int]] = []

    def add(self, parent: int, kind: str, name: str | None, a: int, b: int, depth: int) -> int:
        self.rows.append([parent, kind, name, a, b, depth])
        return len(self.rows) - 1


def parse(text: str) -> _Nodes:
    """Flat nodes that together hold every character, and errors with their offsets.

    Kinds: word, command, group, environment, math, comment, verbatim, blank, error. Leaves lie side by side without
    gaps; groups and environments span theirs. What isn't closed ends with the text and gives an error; a closer
    without its opener is an error leaf. Groups beyond ``MOST_DEPTH`` stay flat.
    """
    out = _Nodes()
    opaque = {a: (kind, b) for kind, a, b in all_regions(text)}
    stack: list[tuple[int, str]] = []  # open groups and environments: node, what closes it
    top = lambda: stack[-1][0] if stack else -1
    at, n = 0, len(text)
    while at < n:
        depth = len(stack)
        c = text[at]
        if at in opaque:
            kind, end = opaque[at]
            out.add(top(), {"inline": "math", "display": "math", "address": "command"}.get(kind, kind), kind, at, end, depth)
        elif c.isspace():
            m = _BLANK.match(text, at)
            end = m.end() if m else at + 1
            out.add(top(), "blank", None, at, end, depth)
        elif c == "\\":
            env = _ENV.match(text, at)
            if env and env.group(1) == "begin" and depth < MOST_DEPTH:
                node = out.add(top(), "environment", env.group(2), at, n, depth)
                stack.append((node, env.group(2)))
                end = env.end()
                out.add(node, "command", "begin", at, end, depth + 1)
            elif env and env.group(1) == "end":
                end = env.end()
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == env.group(2)), None)
                if k is None:
                    out.add(top(), "error", "end", at, end, depth)
                    out.errors.append(("end without begin", at))
                else:
                    for node, closer in stack[k + 1 :]:
                        out.rows[node][4] = at
                        out.errors.append(("group not closed" if closer == "}" else "environment not closed", out.rows[node][3]))
                    node = stack[k][0]
                    out.add(node, "command", "end", at, end, k + 1)
                    out.rows[node][4] = end
                    del stack[k:]
            else:
                m = _NAME.match(text, at)
                end = m.end() if m else min(n, at + 2)
                out.add(top(), "command", m.group(1) if m else text[at + 1 : end], at, end, depth)
        elif c == "{" and depth < MOST_DEPTH:
            end = at + 1
            node = out.add(top(), "group", None, at, n, depth)
            stack.append((node, "}"))
            out.add(node, "word", None, at, end, depth + 1)
        elif c == "}":
            end = at + 1
            if stack and stack[-1][1] == "}":
                node = stack.pop()[0]
                out.add(node, "word", None, at, end, depth)
                out.rows[node][4] = end
            else:
                out.add(top(), "error", "}", at, end, depth)
                out.errors.append(("brace without opener", at))
        elif c == "$":
            end = at + 1
            out.add(top(), "error", "$", at, end, depth)
            out.errors.append(("mathematics not closed", at))
        else:
            end = m.end() if (m := _TEXT.match(text, at)) else at + 1
            out.add(top(), "word", None, at, end, depth)
        at = end
    for node, closer in stack:
        out.errors.append(("group not closed" if closer == "}" else "environment not closed", out.rows[node][3]))
    return out


def _mapped(docs: DataFrame, rows_of: Callable[[str], Iterator[tuple]], columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """One row of ``columns`` a tuple that ``rows_of`` makes of a text, with its doc_id; a worker holds those of ``MOST_CHARS`` at once."""
    names = [c for c, _, _ in columns]
    schema = pa.schema([("doc_id", pa.int64()), *((c, t) for c, t, _ in columns)])

    def run(batches):
        for b in batches:
            ids, out, chars = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                rows = list(rows_of(text))
                ids += [i] * len(rows)
                out += rows
                chars += len(text)
                if chars > MOST_CHARS and out:
                    yield made(ids, out)
                    ids, out, chars = [], [], 0
            if out:
                yield made(ids, out)

    def made(ids, out):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(v), t) for v, (_, t, _) in zip(zip(*out), columns))], schema=schema)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    return map_arrow(slim, run, "doc_id bigint, " + ", ".join(f"{c} {s}" for c, (_, _, s) in zip(names, columns)))


_INT, _STR = pa.int32(), pa.string()


def regions(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end): comments, literal text, addresses and mathematics; null texts have none."""
    return _mapped(docs, all_regions, [("kind", _STR, "string"), ("start", _INT, "int"), ("end", _INT, "int")])


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, parent, kind, name, start, end, depth): the parser's nodes; a parent of -1 is the document."""

    def rows(text: str):
        return ((k, *r) for k, r in enumerate(parse(text).rows))

    return _mapped(docs, rows, [("node", _INT, "int"), ("parent", _INT, "int"), ("kind", _STR, "string"), ("name", _STR, "string"), ("start", _INT, "int"), ("end", _INT, "int"), ("depth", _INT, "int")])


def parse_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, error, at): what the parser recovered from."""
    return _mapped(docs, lambda t: parse(t).errors, [("error", _STR, "string"), ("at", _INT, "int")])


def _leaves(text: str) -> Iterator[tuple[int, int]]:
    return ((a, b) for _, kind, _, a, b, _ in parse(text).rows if kind not in ("group", "environment"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, start, end, text): the lossless sequence of leaves; joined in order they give the document."""

    def rows(text: str):
        return ((k, a, b, text[a:b]) for k, (a, b) in enumerate(_leaves(text)))

    return _mapped(docs, rows, [("seq", _INT, "int"), ("start", _INT, "int"), ("end", _INT, "int"), ("text", _STR, "string")])


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_leaves, same): whether a document's leaves, put together again, are its text.

    A document's leaves stay together, in one row beside its text, so nothing is shuffled.
    """

    def rows(text: str):
        yield [text[a:b] for a, b in _leaves(text)], text

    every = _mapped(docs, rows, [("parts", pa.list_(_STR), "array<string>"), ("whole", _STR, "string")])
    return every.select("doc_id", F.size("parts").cast("bigint").alias("n_leaves"), (F.array_join("parts", "") == F.col("whole")).alias("same"))


def paragraphs_at(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, start, end): paragraphs between blank lines, with their bounds; blank ones left out."""

    def rows(text: str):
        at, k = 0, 0
        for b, nxt in [*((m.start(), m.end()) for m in _PARAGRAPH.finditer(text)), (len(text), len(text))]:
            if text[at:b].strip():
                yield k, at, b
                k += 1
            at = nxt

    return _mapped(docs, rows, [("pos", _INT, "int"), ("start", _INT, "int"), ("end", _INT, "int")])


def _nearest(docs: DataFrame, points: DataFrame) -> DataFrame:
    """Errors (doc_id, error, at) with the last point (point, ...) at or before them and the first one behind; one sort a document."""
    what = F.struct("point", *[c for c in points.columns if c not in ("doc_id", "point")])
    p = points.select("doc_id", F.col("point").alias("o"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("error"), what.alias("p"))
    e = parse_errors(docs).select("doc_id", F.col("at").alias("o"), F.lit(1).alias("k"), "error", F.lit(None).cast(p.schema["p"].dataType).alias("p"))
    w = Window.partitionBy("doc_id").orderBy("o", "k")
    both = p.union(e).select("*", F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("before"), F.first("p", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("behind"))
    return both.where("k = 1").select("doc_id", "error", F.col("o").alias("at"), "before", "behind")


def trust_zones(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, zone): broken paragraphs hold an error, partial ones lie beside one, the rest are complete."""
    p = paragraphs_at(docs)
    held = _nearest(docs, p.select("doc_id", F.col("start").alias("point"), "pos", "end")).where("at < before.end").select("doc_id", "before.pos").distinct().withColumn("bad", F.lit(True))
    hit = p.join(held, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("bad", F.lit(False)).alias("bad"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    beside = F.coalesce(F.lag("bad").over(w), F.lit(False)) | F.coalesce(F.lead("bad").over(w), F.lit(False))
    return hit.withColumn("beside", beside).select("doc_id", "pos", F.when(F.col("bad"), "broken").when(F.col("beside"), "partial").otherwise("complete").alias("zone"))


def recovery_points(docs: DataFrame) -> DataFrame:
    """(doc_id, error, at, point, kind): for every error the nearest place to resume at, the earlier one at a tie.

    Places are the ends of paragraphs, the starts of sections and the ends of environments; a document has at least
    the end of its last paragraph.
    """
    n = nodes(docs).where("kind = 'command' and name in ('section', 'subsection', 'chapter', 'end')").select("doc_id", F.when(F.col("name") == "end", F.col("end")).otherwise(F.col("start")).alias("point"), F.when(F.col("name") == "end", "environment").otherwise("section").alias("kind"))
    points = n.union(paragraphs_at(docs).select("doc_id", F.col("end"), F.lit("paragraph"))).groupBy("doc_id", "point").agg(F.min("kind").alias("kind"))
    near = F.when(F.col("behind").isNull() | (F.col("at") - F.col("before.point") <= F.col("behind.point") - F.col("at")), F.col("before")).otherwise(F.col("behind"))
    return _nearest(docs, points).withColumn("m", near).select("doc_id", "error", "at", "m.point", "m.kind")


_KEY = re.compile(r"\{([^{}]*)\}")


def labels_by_environment(docs: DataFrame) -> DataFrame:
    """(doc_id, key, at, environment): labels with the innermost environment around them, or null."""

    def rows(text: str):
        every = parse(text).rows
        for parent, kind, name, _, end, _ in every:
            if kind == "command" and name == "label" and (m := _KEY.match(text, end)) and m.group(1):
                while parent >= 0 and every[parent][1] != "environment":
                    parent = every[parent][0]
                yield m.group(1), end, every[parent][2] if parent >= 0 else None

    return _mapped(docs, rows, [("key", _STR, "string"), ("at", _INT, "int"), ("environment", _STR, "string")])


def in_ranges(position: Column, ranges: Column) -> Column:
    """Whether a position lies in one of an array of (start, end)."""
    return F.exists(ranges, lambda r: (r.start <= position) & (position < r.end))
