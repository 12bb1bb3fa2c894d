"""Macros that documents define, and their expansion to a fixed point."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.operators.graphs import cycles
from proofmill.operators.parsing import _argument, blanked, literal_regions
from proofmill.session import map_arrow

#: Commands that no document may redefine. Fixed values.
PROTECTED = frozenset("begin end documentclass usepackage input include newcommand renewcommand providecommand def let if else fi catcode csname endcsname expandafter write openout closeout read immediate special shipout output".split())
#: Symbols by command, and commands that take arguments, as templates. Fixed values.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω", "infty": "∞", "times": "×", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "pm": "±", "to": "→", "sum": "∑", "prod": "∏", "int": "∫", "partial": "∂", "nabla": "∇",
    "ldots": "…", "dots": "…", "textendash": "–", "textemdash": "—", "S": "§", "copyright": "©", "ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å",
}
TEMPLATES = {"frac": (2, "#1/#2"), "binom": (2, "(#1, #2)"), "textbf": (1, "#1"), "emph": (1, "#1"), "textit": (1, "#1"), "section": (1, "#1"), "phantom": (1, ""), "mbox": (1, "#1"), "text": (1, "#1")}
#: Passes of expansion, and the length beyond which a text is given back as it stands.
MOST_PASSES, MOST_LENGTH = 256, 4_000_000

_DEFINE = re.compile(r"\\(newcommand|renewcommand|providecommand)\*?\s*(?:\{\\([A-Za-z@]+)\}|\\([A-Za-z@]+))\s*(?:\[(\d)\])?\s*(?:\[([^\]]*)\])?\s*(?=\{)")
_DEF = re.compile(r"\\(def)\s*\\([A-Za-z@]+)((?:#\d)*)\s*(?=\{)")
_CALL = re.compile(r"\\([A-Za-z@]+)")


def definitions_of(text: str) -> list[tuple[str, str, int, str | None, str, int, int]]:
    """(how, name, arity, default, body, start, end) of each definition outside comments and literal text, in order."""
    plain, out = blanked(text, literal_regions(text)), []
    for pattern in (_DEFINE, _DEF):
        for m in pattern.finditer(plain):
            if not (arg := _argument(plain, m.end())):
                continue
            name = m.group(2) or (m.group(3) if pattern is _DEFINE else "")
            arity = int(m.group(4) or 0) if pattern is _DEFINE else len(m.group(3)) // 2
            out.append((m.group(1), name, arity, m.group(5) if pattern is _DEFINE else None, text[arg[0] + 1 : arg[1] - 1], m.start(), arg[1]))
    return sorted(out, key=lambda d: d[5])


def registry_of(text: str) -> dict[str, tuple[int, str | None, str]]:
    """Macros in force at the end: ``newcommand`` and ``providecommand`` keep an earlier one, the others replace it."""
    out: dict[str, tuple[int, str | None, str]] = {}
    for how, name, arity, default, body, _, _ in definitions_of(text):
        if name not in PROTECTED and (how in ("renewcommand", "def") or name not in out):
            out[name] = (arity, default, body)
    return out


def expand_text(text: str, most_passes: int = MOST_PASSES) -> tuple[str, int, bool]:
    """The text with its macros, symbols and templates put in, the passes it took, and whether it settled.

    Definitions leave the text first. Each pass replaces the calls outside comments and literal text, from the left;
    a call that lacks an argument stays. A macro that calls itself never settles: the text after the last pass, or at
    ``MOST_LENGTH``, is given back.
    """
    macros = registry_of(text)
    table = {**{k: (0, None, v) for k, v in SYMBOLS.items()}, **{k: (n, None, v) for k, (n, v) in TEMPLATES.items()}, **macros}
    drop = [("", a, b) for *_, a, b in definitions_of(text)]
    out, at = [], 0
    for _, a, b in drop:
        if a >= at:
            out.append(text[at:a])
            at = b
    text = "".join(out) + text[at:]
    for k in range(most_passes):
        plain, parts, at, changed = blanked(text, literal_regions(text)), [], 0, False
        for m in _CALL.finditer(plain):
            if m.start() < at or m.group(1) not in table:
                continue
            arity, default, body = table[m.group(1)]
            end, given = m.end(), []
            if arity and default is not None:
                opt = re.compile(r"\[([^\]]*)\]").match(plain, end)
                given.append(text[opt.start(1) : opt.end(1)] if opt else default)
                end = opt.end() if opt else end
            while len(given) < arity and (arg := _argument(plain, end)):
                given.append(text[arg[0] + 1 : arg[1] - 1])
                end = arg[1]
            if len(given) < arity:
                continue
            put = re.sub(r"#(\d)", lambda x, g=given: g[int(x.group(1)) - 1] if 0 < int(x.group(1)) <= len(g) else x.group(), body)
            if not arity and put[-1:].isalpha() and put.startswith("\\") and plain[end : end + 1].isalpha():
                put += " "
            parts += (text[at : m.start()], put)
            at, changed = end, True
        if not changed:
            return text, k, True
        text = "".join(parts) + text[at:]
        if len(text) > MOST_LENGTH:
            break
    return text, most_passes, False


_DEFS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("how", pa.string()), ("name", pa.string()), ("arity", pa.int32()), ("body", pa.string()), ("allowed", pa.bool_())])


def definitions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, how, name, arity, body, allowed): macro definitions in order; protected names aren't allowed."""

    def run(batches):
        for b in batches:
            rows = [(i, k, d[0], d[1], d[2], d[4], d[1] not in PROTECTED) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, d in enumerate(definitions_of(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), _DEFS)], schema=_DEFS)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null"), run, "doc_id bigint, pos int, how string, name string, arity int, body string, allowed boolean")


def dependencies(defs: DataFrame) -> DataFrame:
    """(doc_id, name, uses): macros of a document that call another one of it."""
    calls = defs.select("doc_id", "name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\\([A-Za-z@]+)"), F.lit(1)))).alias("uses"))
    known = defs.select("doc_id", F.col("name").alias("uses")).distinct()
    return calls.join(known, ["doc_id", "uses"]).select("doc_id", "name", "uses").distinct()


def macro_cycles(defs: DataFrame) -> DataFrame:
    """(doc_id, name): macros that call themselves, directly or through others."""
    d = dependencies(defs)
    key = lambda c: F.concat_ws("\x1f", "doc_id", c)
    found = cycles(d.select(key("name").alias("src"), key("uses").alias("dst")), "src", "dst")
    parts = F.split("node", "\x1f")
    return found.select(parts[0].cast("bigint").alias("doc_id"), parts[1].alias("name"))


_EXPANDED = pa.schema([("doc_id", pa.int64()), ("expanded", pa.string()), ("passes", pa.int32()), ("settled", pa.bool_())])


def expand(docs: DataFrame) -> DataFrame:
    """(doc_id, expanded, passes, settled): every document with its macros expanded; null texts are left out."""

    def run(batches):
        for b in batches:
            done = [expand_text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(list(v), f.type) for v, f in zip(zip(*done) if done else ((), (), ()), list(_EXPANDED)[1:]))], schema=_EXPANDED)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null"), run, "doc_id bigint, expanded string, passes int, settled boolean")
