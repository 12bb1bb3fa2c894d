"""Sentences of marked-up documents in many scripts: a linear-chain model over characters, decoded by Viterbi.

Every character of running prose is tagged as a boundary (the last of its sentence) or as inside. Only
characters at which a sentence can end carry weights of their own: terminators, closing quotation marks and
brackets behind one, blanks in a script written without punctuation. All others are inside in every
admissible path, so the chain is decoded over the former, which gives the same best path.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.session import map_arrow, ship, staged

#: Keys of either side of a mark that keep a weight of their own; the rest share that of their shape.
MOST_KEYS = 20_000
#: Passes of expectation maximisation; keys seen less often than this share the weight of their shape.
PASSES, RARE = 12, 4
#: What an open context adds to the words known to end and to begin sentences, against a sure one.
OPEN = 0.05
#: Log weight of two boundaries within three characters of each other.
TOO_CLOSE = -4.0
#: Environments whose content is no prose, and commands that stand in running text. Fixed values.
NO_PROSE = ("equation", "align", "verbatim", "eqnarray", "gather", "multline", "lstlisting", "displaymath", "tikzpicture", "tabular")
INLINE = ("cite", "citep", "citet", "ref", "eqref", "pageref", "autoref", "cref", "Cref", "emph", "textbf", "textit", "texttt", "textsc", "verb", "url", "href", "footnote", "nolinkurl", "path", "ldots", "dots", "LaTeX", "TeX")

_OPEN = re.compile(r"[ \t﻿]*\\begin\{(" + "|".join(NO_PROSE) + r")\*?\}")
_STRUCTURE = re.compile(r"[ \t﻿]*(?:\\(?!(?:" + "|".join(INLINE) + r")(?![A-Za-z]))[A-Za-z@]+\*?(?:\[[^\]\n]*\]|\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})*[ \t\r]*)+$")
_ITEM = re.compile(r"[ \t]*\\item(?![A-Za-z])[ \t]*(?:\[[^\]\n]*\][ \t]*)?")
_COMMENT = re.compile(r"[ \t﻿]*%")
_OPAQUE = re.compile(r"\\verb\*?([^\sA-Za-z*]).*?\1|\\(?:texttt|cite[pt]?|ref|eqref|url|path|label)\{[^{}]*\}|\$[^$\n]*\$")
#: What may open and close; a mark that does either is an opener unless one of its closers is awaited.
CLOSES = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "``": "''", "‘": "’", "‹": "›", "《": "》"}
_ENDERS = ".!?…。！？।॥؟۔｡"
_EVENT = re.compile(r"``|''|[“”„«»「」『』（）()\[\]‹›《》]|[" + _ENDERS + r"]+")
_BEFORE = re.compile(r"(?:[^\W_]|[\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e4e])+(?:\.[^\W\d_]+)*$")
_AFTER = re.compile(r"[\s\"“„«»「『（(\[¿¡`‘‹]*([A-ZА-ЯŁŚŹŻ]\.|\\[A-Za-z]+|\$|[^\W_]+(?:[’'][^\W_]+)*|\S)?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")

NONE, SPACE = 0, 1


def prose_blocks(text: str) -> list[tuple[int, int]]:
    """Stretches of running prose, which no sentence leaves: bounds of each."""
    blocks: list[tuple[int, int]] = []
    at, start, until = 0, None, None
    for line in text.split("\n"):
        end = at + len(line)
        body, first = True, at
        if until:
            if until in line:
                until = None
            body = False
        elif not line or line.isspace() or line[0] == "﻿" and not line[1:].strip():
            body = False
        elif "%" in line and _COMMENT.match(line):
            body = False
        elif "\\" in line:
            if m := _OPEN.match(line):
                until = f"\\end{{{line[line.index('{') + 1 : line.index('}')]}}}"
                if until in line[m.end() :]:
                    until = None
                body = False
            elif m := _ITEM.match(line):
                if start is not None:
                    blocks.append((start, at))
                    start = None
                first = m.end() + at
            elif _STRUCTURE.match(line):
                body = False
        if body:
            if start is None:
                start = first
        elif start is not None:
            blocks.append((start, at))
            start = None
        at = end + 1
    if start is not None:
        blocks.append((start, len(text)))
    out = []
    for a, b in blocks:
        part = text[a:b]
        lead = len(part) - len(part.lstrip(" \t\r\n﻿ "))
        tail = len(part.rstrip(" \t\r\n﻿ "))
        if lead < tail:
            out.append((a + lead, a + tail))
    return out


def _shape(key: str) -> str:
    c = key[0]
    if c.isdigit():
        return "<0>"
    if c == "\\" or c == "$":
        return "<\\>"
    if not c.isalpha():
        return "<.>"
    if _CJK.match(c):
        return "<cjk>"
    if c.isupper():
        return "<A>" if len(key) == 1 else "<AA>" if key.isupper() else "<Aa>"
    return "<a>" if c.islower() else "<x>"


def before_key(part: str, at: int) -> str:
    """What stands before position ``at``: the last word, or the character."""
    low = max(0, at - 24)
    low = max(low, part.rfind(" ", low, at) + 1, part.rfind("\n", low, at) + 1)  # no word holds a blank
    m = _BEFORE.search(part, low, at)
    if not m:
        return part[at - 1] if at else "^"
    w = m.group()
    return "0" if w[0].isdigit() else w[-2:] if _CJK.match(w[-1]) else w


def after_key(part: str, at: int) -> str:
    """What stands behind position ``at``: the first word behind opening marks, two characters of a script without blanks."""
    m = _AFTER.match(part, at)
    w = m.group(1) if m else None
    if not w:
        return "$$"
    return "0" if w[0].isdigit() else w[:2] if _CJK.match(w) else w


def chances(part: str) -> list[tuple[int, int, str, str, str]]:
    """(end, next start, kind, key before, key behind) of every place in a block where a sentence may end.

    Marks within quotations or brackets are none; a closing mark with a terminator before it is one, if the
    bracket it closes holds a whole sentence or the mark closes a quotation. Marks in opaque markup are none.
    """
    out: list[tuple[int, int, str, str, str]] = []
    n = len(part)
    plain = _OPAQUE.sub(lambda m: "\x01" * len(m.group()), part) if "\\" in part or "$" in part else part
    events = [(m.start(), m.end(), m.group()) for m in _EVENT.finditer(plain)]
    # pair openers with closers first: a mark without its partner encloses nothing
    stack, close_of, opened_at = [], {}, {}
    for i, (a, b, s) in enumerate(events):
        if s[0] in _ENDERS:
            continue
        hit = next((j for j in range(len(stack) - 1, -1, -1) if s in CLOSES[events[stack[j]][2]] or s == CLOSES[events[stack[j]][2]]), None)
        if hit is not None:
            o = stack[hit]
            del stack[hit:]
            close_of[o], opened_at[i] = i, o
        elif s in CLOSES:
            stack.append(i)
    depth = 0
    start_at = 0  # where the present sentence would start, taking every chance
    for i, (a, b, s) in enumerate(events):
        if i in close_of:
            depth += 1
            continue
        if i in opened_at:
            depth -= 1
            inner = part[events[i - 1][0] : events[i - 1][1]] if i and events[i - 1][1] <= a and not part[events[i - 1][1] : a].strip() else ""
            if depth or not inner or inner[-1] not in _ENDERS:
                continue
            o = events[opened_at[i]]
            bracket = o[2] in "([（"
            if bracket and part[start_at : o[0]].strip():
                continue
            kind = "bracket" if bracket else "quote"
            end = b
        elif s[0] in _ENDERS:
            if depth:
                continue
            end, kind = b, s[0]
            if s[0] == "." and len(s) > 1:
                kind = "…" if set(s) == {"."} else "!"
            elif len(s) > 1 and ("!" in s or "?" in s):
                kind = "!"
        else:
            continue
        nxt = end
        while nxt < n and part[nxt].isspace():
            nxt += 1
        if nxt >= n:
            continue
        if nxt == end and kind in ".…!?؟":
            # no blank behind: only between a word and a word that begins a sentence
            p, q = part[a - 1] if a else " ", part[end]
            if kind == "." and not (p.isalpha() and (q.isupper() and (p.islower() or not p.isupper()) or not q.isupper() and not q.islower() and q.isalpha() and not p.islower())):
                continue
            if kind != "." and not (q.isalpha() and not q.islower() or q in CLOSES and q not in "”’"):
                continue
        out.append((end, nxt, kind, before_key(part, a if s[0] in _ENDERS else events[i - 1][0]), after_key(part, nxt)))
        start_at = nxt
    if _THAI.search(part):
        taken = {x[0] for x in out}
        out += [(m.start(), m.end(), "blank", part[m.start() - 1], after_key(part, m.end())) for m in _THAI_GAP.finditer(part) if m.start() not in taken]
        out.sort()
    return out


class SentenceModel:
    """Weights of the chain: log odds of a boundary by kind of mark, by what stands before and behind."""

    def __init__(self, kinds: dict[str, float], before: dict[str, float], behind: dict[str, float]):
        self.kinds, self.before, self.behind = kinds, before, behind

    def weight(self, kind: str, before: str, behind: str) -> float:
        x = self.kinds.get(kind, 0.0)
        b, c = self.before, self.behind
        y = c.get(behind)
        x += c.get(_shape(behind), 0.0) if y is None else y
        if kind in ".quote":
            y = b.get(before)
            x += b.get(_shape(before), 0.0) if y is None else y
        return x

    def ends(self, part: str) -> list[tuple[int, int]]:
        """(end, next start) of the boundaries in a block, on the likeliest path of tags."""
        found = chances(part)
        if not found:
            return []
        weights = [self.weight(k, x, y) for _, _, k, x, y in found]
        inside, bound = 0.0, -math.inf
        back: list[tuple[bool, bool]] = []
        last = -10
        for (end, _, _, _, _), w in zip(found, weights):
            close = TOO_CLOSE if end - last <= 3 else 0.0
            from_bound = bound + close > inside
            stay = bound > inside
            back.append((stay, from_bound))
            inside, bound = max(inside, bound), w + (bound + close if from_bound else inside)
            last = end
        tag, out = bound > inside, []
        for i in range(len(found) - 1, -1, -1):
            if tag:
                out.append(found[i][:2])
            tag = back[i][1] if tag else back[i][0]
        return out[::-1]

    def sentences(self, text: str) -> list[tuple[int, int]]:
        """Bounds of all sentences of a text."""
        out = []
        for a, b in prose_blocks(text):
            part, at = text[a:b], 0
            for end, nxt in self.ends(part):
                out.append((a + at, a + end))
                at = nxt
            out.append((a + at, b))
        return out


def _contexts(batches):
    """Counted contexts: of marks with a follower, and of the marks that end a block with the block behind it."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            blocks = prose_blocks(text)
            for k, (a, b) in enumerate(blocks):
                part = text[a:b]
                for _, _, kind, x, y in chances(part):
                    counts[0, kind, x, y] += 1
                core = part.rstrip("”’»“)]）」』'")
                tail = len(core.rstrip(_ENDERS))
                if tail < len(core):
                    kind = ("…" if core[tail:] == "..." or core[-1] == "…" else "!" if len(core) - tail > 1 else core[tail]) if len(core) == len(part) else "bracket" if part[-1] in ")]）" else "quote"
                else:
                    kind = "blank" if _THAI.search(part) else ""
                if kind:
                    # the stripped end of the block is a sure boundary; any block's start is a sure start
                    counts[1, kind, before_key(part, tail), after_key(text, blocks[(k + 1) % len(blocks)][0])] += 1
    if counts:
        sure, kind, x, y = zip(*counts)
        yield pa.RecordBatch.from_pydict({"sure": pa.array(sure, pa.int32()), "kind": list(kind), "before": list(x), "behind": list(y), "n": list(counts.values())})


def _folded(batches):
    """Contexts with every rare key in place of its shape, and whether it may begin a sentence at all."""
    for batch in batches:
        counts: Counter = Counter()
        for sure, kind, x, y, n, rare_x, rare_y, begun in zip(*(c.to_pylist() for c in batch.columns)):
            lower = y[0].islower() and not begun or y[0].isdigit()
            counts[sure, kind, _shape(x) if rare_x else x, _shape(y) if rare_y else y, lower, begun] += n
        if counts:
            yield pa.RecordBatch.from_pydict(dict(zip(("sure", "kind", "before", "behind", "lower", "begun", "n"), [*map(list, zip(*counts)), list(counts.values())])), schema=_FOLDED)


_FOLDED = pa.schema([("sure", pa.int32()), ("kind", pa.string()), ("before", pa.string()), ("behind", pa.string()), ("lower", pa.bool_()), ("begun", pa.bool_()), ("n", pa.int64())])


_SUMS = pa.schema([("side", pa.int32()), ("key", pa.string()), ("b", pa.float64()), ("i", pa.float64())])


def _expected(shared):
    """Partial sums by key of a pass: of the contexts' numbers, the parts that are boundaries and that are inside.

    Ends of blocks are sure boundaries. A mark before a lower-case word that begins no block, or before a digit
    (``lower``), is taken to be inside at first and never more likely a boundary than not; everything else is open.
    """

    def run(batches):
        weights = shared.value
        model = weights and SentenceModel(*weights)
        sums: dict[tuple[int, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
        for batch in batches:
            for sure, kind, x, y, lower, begun, n in zip(*(c.to_pylist() for c in batch.columns)):
                if sure:
                    p = 1.0
                elif model:
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.weight(kind, x, y)))))
                    p = min(p, 0.5) if lower else p
                else:
                    # where nothing is known, a follower that begins some block speaks for a boundary, and so does any mark but a period
                    p = 0.02 if lower else 0.9 if begun or kind not in (".", "quote") else 0.1
                b, i = n * p, n * (1 - p)
                if not sure:  # how often a mark is a boundary within a block
                    of = sums[0, kind]
                    of[0] += b
                    of[1] += i
                b *= 1.0 if sure else OPEN
                for key in ((1, x), (2, y)):
                    of = sums[key]
                    of[0] += b
                    of[1] += i
        if sums:
            yield pa.RecordBatch.from_pydict({"side": [k[0] for k in sums], "key": [k[1] for k in sums], "b": [v[0] for v in sums.values()], "i": [v[1] for v in sums.values()]}, schema=_SUMS)

    return run


def fit(contexts: DataFrame) -> SentenceModel:
    """The chain's weights by expectation maximisation over folded contexts (sure, kind, before, behind, lower, begun, n).

    What stands before and what stands behind are independent given the tag. Every pass runs over the contexts where
    they are; the driver gets two sums a key.
    """
    spark = contexts.sparkSession
    weights: tuple[dict, dict, dict] | None = None
    for _ in range(PASSES):
        sums = map_arrow(contexts, _expected(spark.sparkContext.broadcast(weights)), "side int, key string, b double, i double", spread=False)
        sides: list[dict[str, tuple[float, float]]] = [{}, {}, {}]
        for r in sums.groupBy("side", "key").agg(F.sum("b").alias("b"), F.sum("i").alias("i")).collect():
            sides[r.side][r.key] = (r.b, r.i)
        kinds = {k: math.log((b + 0.5) / (i + 0.5)) for k, (b, i) in sides[0].items()}
        weights = (kinds, *(_ratios(s) for s in sides[1:]))
    model = SentenceModel(*weights)
    for s in ("<0>", "<\\>", "<.>", "<cjk>", "<A>", "<AA>", "<Aa>", "<a>", "<x>"):
        model.before.setdefault(s, 0.0)
        model.behind.setdefault(s, -3.0 if s == "<a>" else 0.0)
    return model


def _ratios(sums: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log of how much likelier each key is beside a boundary than elsewhere."""
    b, i, v = sum(x for x, _ in sums.values()), sum(x for _, x in sums.values()), 0.3 * len(sums)
    return {k: math.log((x + 0.3) / (b + v)) - math.log((y + 0.3) / (i + v)) for k, (x, y) in sums.items()}


def train(df: DataFrame, text_col: str = "text", most_keys: int = MOST_KEYS) -> SentenceModel:
    """The model of a corpus, fitted on the counted contexts of all its documents.

    Keys seen fewer than ``RARE`` times in the whole corpus, and those beyond about the ``most_keys`` commonest on a
    side, are folded into their shape. The contexts stay distributed; the driver holds the weights of the keys only.
    """
    counted = map_arrow(df.select(F.col(text_col).alias("text")).where(F.length("text") > 0), _contexts, "sure int, kind string, before string, behind string, n bigint")
    whole = staged(counted.groupBy("sure", "kind", "before", "behind").agg(F.sum("n").alias("n")), "contexts")
    joined = whole
    for side, rare in (("before", "rare_x"), ("behind", "rare_y")):
        keys = staged(whole.groupBy(side).agg(F.sum("n").alias("of_key"), (F.max("sure") > 0).alias("begun")), side)
        top = keys.orderBy(F.desc("of_key")).limit(most_keys + 1).agg(F.count(F.lit(1)).alias("k"), F.min("of_key").alias("n")).first()
        least = max(RARE, top.n + 1) if top.k > most_keys else RARE
        joined = joined.join(keys.select(side, (F.col("of_key") < least).alias(rare), *(["begun"] if side == "behind" else [])), side)
    rows = joined.select("sure", "kind", "before", "behind", "n", "rare_x", "rare_y", "begun")
    folded = map_arrow(rows, _folded, "sure int, kind string, before string, behind string, lower boolean, begun boolean, n bigint", spread=False)
    return fit(staged(folded.groupBy("sure", "kind", "before", "behind", "lower", "begun").agg(F.sum("n").alias("n")), "folded"))


def split_sentences(df: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_start, sent_end): one row per sentence of running prose, in code points, the end exclusive.

    A sentence runs from its first to its last visible character. Comment lines, lines of structural commands
    only, the content of ``NO_PROSE`` environments and the item command are no prose, and no sentence crosses
    them or a blank line. Null, empty and blank texts have no sentence; rows with a null id give rows with a null
    id; repeated rows repeat; an empty table gives none; other columns aren't read.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.kinds, model.before, model.behind))

    def run(batches):
        m = SentenceModel(*shared.value)
        for b in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = m.sentences(text)
                ids += [i] * len(found)
                starts += [s for s, _ in found]
                ends += [e for _, e in found]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "sent_start": pa.array(starts, pa.int32()), "sent_end": pa.array(ends, pa.int32())})

    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return map_arrow(slim, run, "id bigint, sent_start int, sent_end int").withColumnRenamed("id", id_col)
