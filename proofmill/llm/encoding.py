"""Text decoded with a wrong encoding: found and restored with a smoothed character n-gram model."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.session import map_arrow, ship, staged

#: Encodings in which bytes may have been read, and those they may have been written in. Fixed values.
READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-2", "koi8-r", "cp866")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp866", "mac_roman", "gbk", "shift_jis", "euc_jp", "big5")
#: Those of more than one byte a character.
MANY_BYTES = ("gbk", "shift_jis", "euc_jp", "big5")
#: Longest n-grams of the model, n-grams kept (the most frequent; about 100 bytes each where it is used), and alphabet.
ORDER, MOST_NGRAMS, ALPHABET = 4, 300_000, 20_000
#: Natural-log odds by which a repair must be likelier; raised where clean words call for it (``validated_margin``).
MARGIN = 5.0
#: Distinct words whose verdicts a worker keeps before it starts afresh.
MOST_KEPT = 300_000
#: Log odds beyond which a word's repair counts as support for its chain.
SURE = 15.0

#: Reading encodings whose own letters often look like UTF-8 sequences; no evidence by themselves.
WEAK = {"koi8-r", "cp866"}

WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
#: Replacement characters and C1 controls stand in no text of a right encoding.
CERTAIN = re.compile("[�\x80-\x9f]")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_LETTER = re.compile(r"[^\W\d_]")


def _byte_tables() -> dict[str, dict[int, int]]:
    """For each reading encoding, characters to the bytes they were read from; bytes it lacks stand for themselves."""
    out = {}
    for name in READ_AS:
        table = {}
        for b in range(128, 256):
            try:
                table[ord(bytes([b]).decode(name))] = b
            except UnicodeDecodeError:
                pass
        for b in range(128, 160):
            table.setdefault(b, b)
        out[name] = table
    return out


BYTES = _byte_tables()
_NOT = 0x110000 - 1


class _Translate(dict):
    """For str.translate: known characters to bytes, other non-ASCII ones to a character beyond bytes."""

    def __missing__(self, c: int) -> int:
        self[c] = v = c if c < 128 else _NOT
        return v


_TRANSLATE = {k: _Translate(v) for k, v in BYTES.items()}


def _utf8_put_right(word: str, plain: str) -> str | None:
    """``word`` with the UTF-8 sequences among its bytes ``plain`` put right, or None if there are none."""
    out, at = [], 0
    for m in _UTF8.finditer(plain):
        try:
            fixed = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += (word[at : m.start()], fixed)
        at = m.end()
    return "".join(out) + word[at:] if out else None


def as_utf8(word: str, read_as: str) -> str | None:
    """``word`` with every UTF-8 sequence that was read in ``read_as`` put right, or None if it has none."""
    return _utf8_put_right(word, word.translate(_TRANSLATE[read_as]))


def as_written(word: str, read_as: str, written: str) -> str | None:
    """``word`` as bytes of ``read_as`` decoded in ``written``, or None if that isn't possible or changes nothing."""
    try:
        fixed = word.translate(_TRANSLATE[read_as]).encode("latin-1").decode(written)
    except (UnicodeDecodeError, UnicodeEncodeError):
        return None
    return fixed if fixed != word and not CERTAIN.search(fixed) else None


_STRETCH = re.compile("[\\x00-\xff]*[\x80-\xff][\\x00-\xff]*")


def _stretches(word: str, plain: str, written: str) -> str | None:
    """``word`` with the stretches of bytes in ``plain`` decoded in ``written`` where that is possible, or None if nowhere."""
    out, at = [], 0
    for m in _STRETCH.finditer(plain):
        try:
            fixed = m.group().encode("latin-1").decode(written)
        except UnicodeDecodeError:
            continue
        if not CERTAIN.search(fixed):
            out += (word[at : m.start()], fixed)
            at = m.end()
    return "".join(out) + word[at:] if out else None


def candidates(word: str, written_in: tuple[str, ...] = WRITTEN_IN) -> list[tuple[str, str]]:
    """Every (chain, text) that undoes one wrong reading of ``word``."""
    out, seen = [], {word}
    for r in READ_AS:
        plain = word.translate(_TRANSLATE[r])
        try:
            raw = plain.encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        for w in written_in:
            if w == "utf-8":
                fixed = _utf8_put_right(word, plain)
            elif raw is None:
                # text without spaces: only stretches of it were read wrongly
                fixed = _stretches(word, plain, w) if w in MANY_BYTES else None
            else:
                try:
                    fixed = raw.decode(w)
                except UnicodeDecodeError:
                    continue
                if CERTAIN.search(fixed):
                    continue
            if fixed is not None and fixed not in seen:
                seen.add(fixed)
                out.append((f"{r}>{w}", fixed))
    return out


#: Beginnings of UTF-8 sequences at the end of a string, and their endings at its start.
_BEGUN = re.compile("(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})$")
_ENDED = re.compile("^[\x80-\xbf]{1,3}")


class CharModel:
    """Interpolated character n-gram model over words that hold a character beyond ASCII.

    ``costs``: for each chain the log odds against it, from how many words it surely repaired; others cost the most.
    Where a word is ``cut`` on the left or right, the text goes on beyond it: no edge of a word is scored there.
    """

    def __init__(self, counts: dict[str, int], margin: float = MARGIN, floor: float = -6.0, costs: dict[str, float] | None = None):
        self.counts, self.margin, self.floor, self.costs = counts, margin, floor, costs or {}
        self.most = max(self.costs.values(), default=0.0)
        self.total = max(1, sum(v for k, v in counts.items() if len(k) == 1 and k != "\x02"))
        self.log: dict[str, float] = {}
        self._ends: dict[tuple[bytes, bool], list[str]] | None = None

    def log_p(self, gram: str) -> float:
        """Log probability of the last character after those before."""
        p = self.log.get(gram)
        if p is None:
            if len(self.log) > MOST_KEPT:
                self.log.clear()
            x = (self.counts.get(gram[-1], 0) + 0.5) / (self.total + 0.5 * ALPHABET)
            for k in range(2, len(gram) + 1):
                seen = self.counts.get(gram[-k:-1], 0)
                # the longer context is trusted as far as it was seen
                x = (self.counts.get(gram[-k:], 0) + 4 * x) / (seen + 4)
            p = self.log[gram] = math.log(min(x, 1.0))
        return p

    def steps(self, word: str, left: bool = False, right: bool = False) -> list[float]:
        s = ("" if left else "\x02" * (ORDER - 1)) + word + ("" if right else "\x03")
        return [self.log_p(s[max(0, k - ORDER + 1) : k + 1]) for k in range(0 if left else ORDER - 1, len(s))]

    def score(self, word: str, left: bool = False, right: bool = False) -> float:
        return sum(self.steps(word, left, right))

    def cost(self, chain: str) -> float:
        return sum(self.costs.get(c, self.most) for c in chain.split("+"))

    def known(self, part: bytes, at_start: bool) -> list[str]:
        """Characters of the model whose UTF-8 bytes begin (or end) with ``part`` and have more, the most frequent first."""
        if self._ends is None:
            self._ends = {}
            for c in sorted((k for k in self.counts if len(k) == 1 and ord(k) > 127), key=lambda c: (-self.counts[c], c)):
                b = c.encode("utf-8", "surrogatepass")
                for k in range(1, len(b)):
                    self._ends.setdefault((b[:k], True), []).append(c)
                    self._ends.setdefault((b[-k:], False), []).append(c)
        return self._ends.get((part, at_start), [])

    def _cut(self, word: str, left: bool, right: bool) -> list[tuple[float, str, str]]:
        """(score, text, chain) of a word that begins or ends within a sequence of bytes read wrongly.

        A cut UTF-8 sequence is completed by a known character for the score, the likeliest beside its neighbour; of the
        encodings of two bytes a character, the odd one at the edge is left out and counts as the margin. The text keeps both as they are.
        """
        out = []
        for a, b in ((1, 0), (0, 1), (1, 1)):
            if a <= left and b <= right and len(word) > 2:
                for chain, fixed in candidates(word[a : len(word) - b], MANY_BYTES):
                    x = self.score(fixed, left, right)
                    if x / (len(fixed) + 1) >= self.floor:
                        out.append((x - (a + b) * self.margin - self.cost(chain), word[:a] + fixed + word[len(word) - b :], chain))
        for r in READ_AS:
            plain = word.translate(_TRANSLATE[r])
            for m, at_start in ((right and _BEGUN.search(plain), True), (left and _ENDED.search(plain), False)):
                if not m:
                    continue
                rest = (word[: m.start()], plain[: m.start()]) if at_start else (word[m.end() :], plain[m.end() :])
                fitting = self.known(m.group().encode("latin-1"), at_start)
                if not fitting:
                    continue
                inner = _utf8_put_right(*rest) or rest[0]
                beside = (lambda c: self.counts.get(inner[-1:] + c, 0)) if at_start else (lambda c: self.counts.get(c + inner[:1], 0))
                c = max(fitting[:1] + [x for x in fitting if beside(x)], key=lambda c: (beside(c), self.counts[c]))
                kept = word[m.start() :] if at_start else word[: m.end()]
                x = self.score(inner + c if at_start else c + inner, left, right)
                out.append((x - self.cost(f"{r}>utf-8"), inner + kept if at_start else kept + inner, f"{r}>utf-8"))
        return out

    def options(self, word: str, left: bool = False, right: bool = False, written_in: tuple[str, ...] = WRITTEN_IN) -> list[tuple[float, str, str]]:
        """(score, reading, chain) of the readings that look like known text: none below the floor a character."""
        out = []
        for chain, fixed in candidates(word, written_in):
            x = self.score(fixed, left, right)
            out.append((x - self.cost(chain) if x / (len(fixed) + 1) >= self.floor else -math.inf, fixed, chain))
        return out

    def best(self, word: str, depth: int = 3, left: bool = False, right: bool = False) -> tuple[str, list[str], float]:
        """The likeliest reading of ``word``, the chains that lead there and the log odds gained, the chains' cost off."""
        text, chains, gained = word, [], 0.0
        for k in range(depth):
            old, found = self.score(text, left, right), self.options(text, left, right)
            # wrong readings on top of each other may only gain once all are undone, or gain less on a wrong way
            found += [
                (y - self.cost(c), g, f"{c}+{c2}") for _, f, c in found if c.endswith("utf-8") for y, g, c2 in self.options(f, left, right, ("utf-8",))
            ]
            if not found and not (left or right):
                break
            x, fixed, chain = max(found, default=(-math.inf, text, ""))
            if x - old <= self.margin and k == 0 and (left or right):
                # nothing in whole sequences; one may be cut by the edge
                x, fixed, chain = max(self._cut(text, left, right), default=(-math.inf, text, ""))
                if x - old > self.margin:
                    return fixed, [chain], x - old
            if x - old <= self.margin:
                break
            text, gained = fixed, gained + x - old
            chains.append(chain)
        return text, chains, gained


class Judge:
    """Verdicts on words, kept by worker."""

    def __init__(self, model: CharModel):
        self.model, self.kept = model, {}

    def word(self, word: str, left: bool = False, right: bool = False) -> tuple[str, str] | None:
        """The restored word and its chains, or None for a right one."""
        key = (word, left, right) if left or right else word
        if key not in self.kept:
            if len(self.kept) > MOST_KEPT:
                self.kept.clear()
            fixed, chains, _ = self.model.best(word, left=left, right=right)
            self.kept[key] = (fixed, ",".join(chains)) if chains else None
        return self.kept[key]

    def text(self, text: str, left: bool = True, right: bool = True) -> tuple[bool, str, str]:
        """Whether a text holds wrongly decoded characters, the text restored where possible, and the chains.

        ``left``, ``right``: whether the text may be cut there, so that a word at that edge may be a part of one.
        """
        every = WORD.findall(text)
        if not every:
            return bool(CERTAIN.search(text)), text, ""
        size, at_edge = len(text), {}
        if left and (m := WORD.match(text)):
            at_edge[0] = self.word(m.group(), True, right and m.end() == size)
        if right and text.endswith(every[-1]):
            a = size - len(every[-1])
            if a not in at_edge:
                at_edge[a] = self.word(every[-1], False, True)
        inner = every[0 in at_edge : len(every) - (len(at_edge) > (0 in at_edge))]
        found = {w: v for w in set(inner) if (v := self.word(w))}
        verdict = lambda m: at_edge[m.start()] if m.start() in at_edge else found.get(m.group())
        if not found and not any(at_edge.values()):
            return bool(CERTAIN.search(text)), text, ""
        fixed = WORD.sub(lambda m: v[0] if (v := verdict(m)) else m.group(), text)
        return True, fixed, " ".join(sorted({v[1] for v in (*found.values(), *at_edge.values()) if v}))


def _trimmed(window: bytes) -> tuple[int, int, bytes]:
    """Cut characters' bytes at either edge of a window without its padding: how many there are, and the rest."""
    b = window.rstrip(b"\0")
    a = 0
    while a < min(3, len(b)) and 0x80 <= b[a] < 0xC0:
        a += 1
    for back in range(1, min(3, len(b)) + 1):
        c = b[-back]
        if c >= 0xC0:
            need = 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            if need > back and all(0x80 <= x < 0xC0 for x in b[len(b) - back + 1 :]):
                return a, back, b[a : len(b) - back]
            break
        if c < 0x80:
            break
    return a, 0, b[a:]


_CJK = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uff00-\uffef]")
_ONE_BYTE = tuple(w for w in WRITTEN_IN[1:] if w not in MANY_BYTES)


def _edge_is_foreign(model: CharModel, part: bytes, text: str, at_start: bool) -> bool:
    """Whether bytes at a window's edge that could be part of a UTF-8 character are likelier letters of a one-byte encoding.

    ``at_start``: ``part`` begins a character after ``text``; else it ends one before it. Both readings are scored
    beside their neighbours. In a text without ideographs none is expected at its edge.
    """
    near = re.search(r"[A-Za-z\x80-\U0010ffff]{0,3}$" if at_start else r"^[A-Za-z\x80-\U0010ffff]{0,3}", text).group()
    whole = len(near) == len(text)
    if at_start:
        score = lambda x: model.score(near + x, left=len(near) == 3 or whole, right=True) - model.score(near, left=len(near) == 3 or whole, right=True)
    else:
        score = lambda x: model.score(x + near, left=True, right=len(near) == 3 or whole)
    fitting = [c for c in model.known(part, at_start) if _CJK.search(text) or not _CJK.match(c)]
    cut = math.log(sum(math.exp(score(c)) for c in fitting) + 1e-12) if fitting else -27.0
    other = -math.inf
    for w in _ONE_BYTE:
        try:
            x = part.decode(w)
        except UnicodeDecodeError:
            continue
        if not CERTAIN.search(x):
            other = max(other, score(x) - model.costs.get(f"latin-1>{w}", 0.0))
    return other - cut > model.margin


def judge_bytes(judge: Judge, window: bytes) -> tuple[bool, str, str]:
    """As ``Judge.text`` for a window of bytes, whose edges may cut a character."""
    head, tail, inner = _trimmed(window)
    kept = window.rstrip(b"\0")
    try:
        text = inner.decode("utf-8")
    except UnicodeDecodeError:
        return True, *_decode_mixed(judge, kept)
    if tail and _edge_is_foreign(judge.model, kept[-tail:], text, True) or head and _edge_is_foreign(judge.model, kept[:head], text, False):
        return True, *_decode_mixed(judge, kept)
    return judge.text(text, True, len(kept) == len(window))


_HIGH = re.compile(rb"[A-Za-z]*[\x80-\xff]+[A-Za-z\x80-\xff]*")


def _decode_mixed(judge: Judge, b: bytes) -> tuple[str, str]:
    """Text of bytes that are UTF-8 only in part: each other stretch in its likeliest encoding."""
    used = set()

    def one(m: re.Match) -> bytes:
        x = m.group()
        try:
            return x.decode("utf-8").encode("utf-8")
        except UnicodeDecodeError:
            pass
        options = []
        for w in WRITTEN_IN[1:]:
            try:
                t = x.decode(w)
            except UnicodeDecodeError:
                continue
            options.append((judge.model.score(t), w, t))
        if not options:
            return x.decode("utf-8", "replace").encode("utf-8")
        _, w, t = max(options)
        used.add(w)
        return t.encode("utf-8")

    text = _HIGH.sub(one, b).decode("utf-8", "replace")
    return judge.text(text)[1], " ".join(sorted(f"bytes>{w}" for w in used))


def _suspect(word: str) -> bool:
    return any(as_utf8(word, r) is not None for r in READ_AS if r not in WEAK)


def _clean_words(batches):
    """Words with characters beyond ASCII, and their numbers in records that show no wrong decoding."""
    kept: dict[str, bool] = {}
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = WORD.findall(text)
            bad = bool(CERTAIN.search(text))
            for w in () if bad else set(found):
                if w not in kept:
                    if len(kept) > MOST_KEPT:
                        kept.clear()
                    kept[w] = _suspect(w)
                if kept[w]:
                    bad = True
                    break
            if bad:
                for w in found:
                    counts.setdefault(w, 0)
            else:
                counts.update(found)
        if len(counts) > MOST_KEPT:
            yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
            counts = Counter()
    if counts:
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})


def _ngrams(words: DataFrame, slice_of: int = 400) -> DataFrame:
    """(gram, n) of all lengths up to the order, with marks for the word's edges, from words and their numbers.

    Long words are taken in slices of ``slice_of`` starts, which overlap so that every n-gram lies in one.
    """
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), "word", F.lit("\x03"))
    starts = F.sequence(F.lit(1), F.length(padded), F.lit(slice_of))
    parts = words.select(F.explode(F.transform(starts, lambda i: F.substr(padded, i, F.lit(slice_of + ORDER - 1)))).alias("part"), "n")
    # a part has the n-grams that start in its first ``slice_of`` characters; the rest belong to the next one
    size = F.length("part")
    last = lambda k: F.least(size - k + 1, F.lit(slice_of))
    of_length = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), last(k)), lambda i: F.substr("part", i, k))).otherwise(F.array().cast("array<string>"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(ORDER)), of_length))
    return parts.select(F.explode(grams).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def _collected(grams: DataFrame) -> dict[str, int]:
    top = grams.orderBy(F.desc("n"), "gram").limit(MOST_NGRAMS).toArrow()
    return dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))


def train(texts: DataFrame, rounds: int = 2) -> CharModel:
    """The model of a table's only column of texts.

    Words are counted over all clean records. A model of them scores every distinct word; those that a chain of
    wrong readings makes likelier are left out, and the next model comes from the rest: ``rounds`` times, as each
    finds garbled words that the one before had learned. The distinct words that a chain surely repairs are its
    support; a chain costs the log of the best supported one's number over its own, so that rare words aren't taken
    for garbled by chains that nothing else speaks for. The driver gets at most ``MOST_NGRAMS`` n-grams and a number
    per encoding pair, whatever the corpus.
    """
    slim = texts.select(F.col(texts.columns[0]).alias("text")).where(F.length("text") > 0)
    found = map_arrow(slim, _clean_words, "word string, n bigint")
    words = staged(found.groupBy("word").agg(F.sum("n").alias("n")), "words")
    spark = texts.sparkSession
    ship(spark)
    rest, costs = words.where("n > 0"), {}
    for _ in range(rounds):
        seen = staged(map_arrow(words, _scored(spark.sparkContext.broadcast((_collected(_ngrams(rest)), costs))), "word string, n bigint, chain string, gain double"), "scored-words")
        steps = F.split("chain", r"\+")
        sure = seen.where((F.col("gain") > SURE) & F.col("chain").isNotNull()).select(F.explode(F.array_distinct(steps)).alias("c"))
        support = {r.c: r.k for r in sure.groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}
        top = max(support.values(), default=0)
        costs = {f"{r}>{w}": math.log((top + 1) / (support.get(f"{r}>{w}", 0) + 1)) for r in READ_AS for w in WRITTEN_IN}
        rest = seen.where((F.col("n") > 0) & F.col("chain").isNull()).select("word", "n")
    return validated(CharModel(_collected(_ngrams(rest)), costs=costs), rest)


def _scored(shared):
    def run(batches):
        counts, costs = shared.value
        model = CharModel(counts, costs=costs)
        for b in batches:
            best = [model.best(w) for w in b.column(0).to_pylist()]
            chains = pa.array([c[0] if c else None for _, c, _ in best], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), chains, pa.array([g for _, _, g in best], pa.float64())], names=["word", "n", "chain", "gain"])

    return run


def _from_end(values: DataFrame, column: str, share: float, lowest: bool) -> float | None:
    """The value that ``share`` of a column lies below (or above, unless ``lowest``), between two neighbours in proportion; None of an empty one."""
    n = values.count()
    at = share * (n - 1)
    two = values.select(column).orderBy(F.col(column).asc() if lowest else F.col(column).desc()).offset(int(at)).limit(2).collect() if n else []
    return two[0][0] + (two[-1][0] - two[0][0]) * (at - int(at)) if two else None


def _log_odds(shared, gains: bool):
    """For every word its log probability a character, or what its likeliest other reading gains."""

    def run(batches):
        counts, floor, costs = shared.value
        model = CharModel(counts, floor=floor, costs=costs)
        for b in batches:
            words = b.column(0).to_pylist()
            if gains:
                out = [max(-1e9, max((x for x, _, _ in model.options(w)), default=-math.inf) - model.score(w)) for w in words]
            else:
                out = [model.score(w) / (len(w) + 1) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["x"])

    return run


def validated(model: CharModel, words: DataFrame, quantile: float = 0.999) -> CharModel:
    """The model with its floor and margin set on all distinct clean words.

    The floor is the log probability a character that ``quantile`` of them exceed; the margin is what that share of
    them doesn't gain by its likeliest other reading, ``MARGIN`` at least. The driver gets two numbers for each.
    """
    spark = words.sparkSession

    def found(gains: bool) -> float | None:
        shared = spark.sparkContext.broadcast((model.counts, model.floor, model.costs))
        return _from_end(staged(map_arrow(words.select("word"), _log_odds(shared, gains), "x double"), "log-odds"), "x", 1 - quantile, lowest=not gains)

    if (low := found(False)) is not None:
        model.floor = min(model.floor, low)
        model.margin = max(MARGIN, found(True))
    return model


_RESULT = "record_id bigint, is_garbled boolean, restored string, chains string"
_ARROW = pa.schema([("record_id", pa.int64()), ("is_garbled", pa.bool_()), ("restored", pa.string()), ("chains", pa.string())])


def _batch(ids: list, verdicts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"record_id": ids, "is_garbled": [True] * len(ids), "restored": [v[1] for v in verdicts], "chains": [v[2] for v in verdicts]}, schema=_ARROW)


def garbled_texts(df: DataFrame, id_col: str, text_col: str, model: CharModel) -> DataFrame:
    """(record_id, is_garbled, restored, chains): records of a text column with wrongly decoded passages.

    ``restored`` is the text with every passage put right for which a chain of encodings gives a reading
    likelier by more than the model's margin; replacement characters and other passages stay as they are.
    Null and empty texts are never garbled; null ids are kept; repeated rows come out each; an empty table
    gives no rows; other columns aren't read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.counts, model.margin, model.floor, model.costs))

    def run(batches):
        judge = Judge(CharModel(*shared.value))
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t.isascii() and (v := judge.text(t))[0]:
                    ids.append(i)
                    out.append(v)
            yield _batch(ids, out)

    slim = df.select(F.col(id_col).cast("bigint"), F.col(text_col)).where(F.length(F.col(text_col)) > 0)
    return map_arrow(slim, run, _RESULT)


def garbled_bytes(df: DataFrame, id_col: str, bytes_col: str, model: CharModel) -> DataFrame:
    """As ``garbled_texts`` for windows of byte values, zero padded, that may cut a character at either edge.

    A window whose bytes aren't UTF-8, cut edges aside, is garbled too; each of its stretches is decoded in the
    likeliest encoding. Values outside 0-255 and null values make no byte and are skipped. Null and empty windows
    are never garbled.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.counts, model.margin, model.floor, model.costs))

    def run(batches):
        judge = Judge(CharModel(*shared.value))
        for b in batches:
            column, keys = b.column(1), b.column(0).to_pylist()
            values, offsets = column.values, column.offsets.to_numpy()
            flat = values.fill_null(-1).to_numpy(zero_copy_only=False)
            high = np.concatenate([[0], np.cumsum((flat >= 128) & (flat <= 255))])
            ids, out = [], []
            for k in np.flatnonzero(high[offsets[1:]] > high[offsets[:-1]]).tolist():
                part = flat[offsets[k] : offsets[k + 1]]
                if part.min() < 0 or part.max() > 255:
                    part = part[(part >= 0) & (part <= 255)]
                if (v := judge_bytes(judge, part.astype(np.uint8).tobytes()))[0]:
                    ids.append(keys[k])
                    out.append(v)
            yield _batch(ids, out)

    slim = df.select(F.col(id_col).cast("bigint"), F.col(bytes_col).cast("array<int>")).where(F.size(F.col(bytes_col)) > 0)
    return map_arrow(slim, run, _RESULT)
