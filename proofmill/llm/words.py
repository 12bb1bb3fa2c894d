"""Words of texts as 64-bit hashes, and their runs, a batch at a time.

A word is a maximal run of letters and digits (Unicode L and N) in lower case.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Distinct words whose hashes a Python worker keeps; then it starts afresh. About 100 bytes each.
CACHED_WORDS = 1_000_000

_U = np.uint64
_ODD = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def words(text: str) -> list[str]:
    """The words of a text, in order."""
    if "İ" in text:  # the one letter whose lower case holds a mark, which would cut the word
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes one after another, and the bounds of each text in them (one more than texts)."""
    at, parts, bounds = _hashes.__getitem__, [], [0]
    for t in texts:
        found = words(t) if t else []
        parts.append(np.fromiter(map(at, found), dtype=np.uint64, count=len(found)))
        bounds.append(bounds[-1] + len(found))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(bounds, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def run_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its sequences of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return [np.empty(0, np.uint64)] * (len(bounds) - 1)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for k in range(width):
            mixed = mix(mixed * _ODD[0] + hashes[k : k + n] + _U(k + 1))
    return [np.unique(mixed[s : max(s, e - width + 1)]) for s, e in zip(bounds[:-1], bounds[1:])]


def set_key(values: np.ndarray) -> bytes:
    """16 bytes that stand for a set of values, given sorted."""
    return xxhash.xxh3_128_digest(values.tobytes())
