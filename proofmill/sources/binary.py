"""Metadata of pictures, PDF files and fonts, read from their bytes in Arrow batches."""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.session import map_arrow

#: Code points by which a font's coverage of ideographs is told, and the share it must have. Fixed values.
SAMPLES, COVERED = (0x4E00, 0x4E2D, 0x56FD, 0x65E5, 0x672C, 0x8A9E, 0x5B57, 0x6587, 0x3042, 0x30A2), 0.80
_PNG = b"\x89PNG\r\n\x1a\n"
_COLORS = {0: "gray", 2: "rgb", 3: "palette", 4: "gray+alpha", 6: "rgb+alpha"}


def png_info(b: bytes) -> dict | None:
    """Size, colours, resolution, transparency and profiles of a PNG file; None for bytes that aren't one."""
    if not b.startswith(_PNG):
        return None
    out: dict = {"format": "png", "transparent": False, "profile": None, "palette": None}
    at = 8
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        data = b[at + 8 : at + 8 + n]
        if kind == b"IHDR" and len(data) >= 13:
            w, h, depth, color = struct.unpack_from(">IIBB", data)
            out |= {"width": w, "height": h, "bits": depth, "colors": _COLORS.get(color, "?"), "transparent": color in (4, 6)}
        elif kind == b"pHYs" and len(data) >= 9 and data[8] == 1:
            x, y = struct.unpack_from(">II", data)
            out |= {"dpi_x": x * 0.0254, "dpi_y": y * 0.0254}
        elif kind == b"tRNS":
            out["transparent"] = True
        elif kind == b"iCCP":
            out["profile"] = data.split(b"\0", 1)[0].decode("latin-1")
        elif kind == b"sRGB":
            out["profile"] = "sRGB"
        elif kind == b"PLTE":
            out["palette"] = n // 3
        elif kind == b"IEND":
            break
        at += 12 + n
    return out if "width" in out else None


def jpeg_info(b: bytes) -> dict | None:
    """Size, colours, resolution and profile of a JPEG file."""
    if not b.startswith(b"\xff\xd8"):
        return None
    out: dict = {"format": "jpeg", "transparent": False, "profile": None}
    at, adobe = 2, None
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        (n,) = struct.unpack_from(">H", b, at + 2)
        data = b[at + 4 : at + 2 + n]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(data) >= 6:
            bits, h, w, k = struct.unpack_from(">BHHB", data)
            out |= {"width": w, "height": h, "bits": bits, "colors": {1: "gray", 3: "rgb", 4: "cmyk"}.get(k, "?")}
        elif mark == 0xE0 and data.startswith(b"JFIF\0") and len(data) >= 12:
            unit, x, y = data[7], *struct.unpack_from(">HH", data, 8)
            if unit:
                out |= {"dpi_x": x * (1.0 if unit == 1 else 2.54), "dpi_y": y * (1.0 if unit == 1 else 2.54)}
        elif mark == 0xE2 and data.startswith(b"ICC_PROFILE\0"):
            out["profile"] = "sRGB" if b"sRGB" in data else "icc"
        elif mark == 0xEE and data.startswith(b"Adobe") and len(data) >= 12:
            adobe = data[11]
        if mark == 0xDA:
            break
        at += 2 + n
    if out.get("colors") == "cmyk" and adobe == 2:
        out["colors"] = "ycck"
    return out if "width" in out else None


_OBJ = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)


def pdf_info(b: bytes) -> dict | None:
    """What the rules ask of a PDF file: pages, language, tags, fonts and whether they are embedded, labels, streams."""
    if b"%PDF-" not in b[:1024]:
        return None
    bodies = [m.group(2) for m in _OBJ.finditer(b)]
    n_streams = uncompressed = 0
    for body in list(bodies):
        m = _STREAM.search(body)
        if not m:
            continue
        n_streams += 1
        head = body[: m.start()]
        if b"/Filter" not in head:
            uncompressed += 1
        elif b"/ObjStm" in head and b"FlateDecode" in head:  # objects packed in a stream
            try:
                bodies.append(zlib.decompress(m.group(1)))
            except zlib.error:
                pass
    every = b"\n".join(_STREAM.sub(b"", x) for x in bodies)
    fonts = {f for x in bodies if re.search(rb"/Type\s*/Font\b", x) for f in re.findall(rb"/BaseFont\s*/([^\s/<>\[\]()]+)", x)}
    embedded = {f for x in bodies if re.search(rb"/FontFile[23]?\b", x) for f in re.findall(rb"/FontName\s*/([^\s/<>\[\]()]+)", x)}
    labels = re.search(rb"/PageLabels\s*<<.*?/Nums\s*\[(.*?)\]", every, re.S)
    lang = re.search(rb"/Lang\s*\(([^)]*)\)", every)
    return {
        "format": "pdf", "version": b[b.index(b"%PDF-") + 5 :][:3].decode("latin-1"), "pages": len(re.findall(rb"/Type\s*/Page(?!s)\b", every)), "lang": lang and lang.group(1).decode("latin-1"), "marked": b"/MarkInfo" in every, "tagged": b"/StructTreeRoot" in every,
        "fonts": len(fonts), "fonts_not_embedded": len(fonts - embedded), "page_labels": len(re.findall(rb"<<", labels.group(1))) if labels else 0, "streams": n_streams, "streams_plain": uncompressed, "alt_texts": len(re.findall(rb"/Alt\s*\(", every)), "spot_colors": len(re.findall(rb"/Separation\b", every)),
    }


def font_info(b: bytes) -> dict | None:
    """Characters that a TrueType or OpenType font maps (cmap formats 4 and 12), and whether it covers ideographs."""
    if b[:4] not in (b"\x00\x01\x00\x00", b"OTTO", b"true"):
        return None
    (n,) = struct.unpack_from(">H", b, 4)
    table = next((struct.unpack_from(">II", b, 12 + 16 * k + 8) for k in range(n) if b[12 + 16 * k : 16 + 16 * k] == b"cmap"), None)
    if table is None:
        return {"format": "font", "characters": 0, "covers_cjk": False}
    base, ranges = table[0], []
    (count,) = struct.unpack_from(">H", b, base + 2)
    for k in range(count):
        (off,) = struct.unpack_from(">I", b, base + 4 + 8 * k + 4)
        at = base + off
        (kind,) = struct.unpack_from(">H", b, at)
        if kind == 4:
            seg = struct.unpack_from(">H", b, at + 6)[0] // 2
            ends = struct.unpack_from(f">{seg}H", b, at + 14)
            starts = struct.unpack_from(f">{seg}H", b, at + 16 + 2 * seg)
            ranges += [(s, e) for s, e in zip(starts, ends) if s <= e and s != 0xFFFF]
        elif kind == 12:
            (groups,) = struct.unpack_from(">I", b, at + 12)
            ranges += [struct.unpack_from(">II", b, at + 16 + 12 * g) for g in range(groups)]
    has = sum(any(s <= c <= e for s, e in ranges) for c in SAMPLES)
    return {"format": "font", "characters": sum(e - s + 1 for s, e in set(ranges)), "covers_cjk": has >= COVERED * len(SAMPLES)}


FIELDS = (
    ("format", "string"), ("width", "int"), ("height", "int"), ("bits", "int"), ("colors", "string"), ("dpi_x", "double"), ("dpi_y", "double"), ("transparent", "boolean"), ("profile", "string"), ("palette", "int"), ("version", "string"), ("pages", "int"), ("lang", "string"), ("marked", "boolean"), ("tagged", "boolean"),
    ("fonts", "int"), ("fonts_not_embedded", "int"), ("page_labels", "int"), ("streams", "int"), ("streams_plain", "int"), ("alt_texts", "int"), ("spot_colors", "int"), ("characters", "int"), ("covers_cjk", "boolean"),
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def file_info(b: bytes | None) -> dict:
    """What one of the readers makes of a file's bytes; format ``unknown`` for others and ``broken`` where it fails."""
    try:
        return next((x for f in (png_info, jpeg_info, pdf_info, font_info) if b and (x := f(b))), {"format": "unknown"})
    except (struct.error, IndexError, ValueError):
        return {"format": "broken"}


def file_metadata(files: DataFrame) -> DataFrame:
    """(path, size, format, ...): metadata of files (path, content); null contents and unknown ones come out as such."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), *((k, _ARROW[t]) for k, t in FIELDS)])

    def run(batches):
        for b in batches:
            paths, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            infos = [file_info(c) for c in contents]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([None if c is None else len(c) for c in contents], pa.int64()), *(pa.array([i.get(k) for i in infos], _ARROW[t]) for k, t in FIELDS)], schema=schema)

    return map_arrow(files.select("path", "content"), run, "path string, size bigint, " + ", ".join(f"{k} {t}" for k, t in FIELDS))


def read_binary(spark: SparkSession, *paths: str) -> DataFrame:
    """``file_metadata`` of the files under paths."""
    return file_metadata(spark.read.format("binaryFile").load(list(paths)).select("path", "content"))


def metadata_findings(info: DataFrame) -> DataFrame:
    """(path, rule_id, n): the rules that ask for a file's metadata."""
    c = F.col
    image, pdf = c("format").isin("png", "jpeg"), c("format") == "pdf"
    # fixed values: which figure each rule reads
    rules = [
        ("FIG-004", image & ((c("dpi_x") > 300) | (c("dpi_y") > 300)), 1), ("FIG-006", image & c("transparent"), 1), ("FIG-016", image & c("profile").isNotNull() & (c("profile") != "sRGB"), 1), ("FIG-021", image & (c("size") > 20 * 1024 * 1024), 1),
        ("COL-001", image & c("colors").isin("cmyk", "ycck"), 1), ("COL-002", image & c("profile").isNull(), 1), ("COL-005", image & (c("palette") > 256), 1),
        ("PDF-006", pdf & c("marked") & ~c("tagged"), 1), ("PDF-009", pdf & c("lang").isNull(), 1), ("PDF-011", pdf & (c("fonts_not_embedded") > 0), c("fonts_not_embedded")), ("PDF-012", pdf & (c("page_labels") > 0) & (c("page_labels") != c("pages")), 1), ("TIKZ-008", pdf & (c("streams_plain") > 0), c("streams_plain")),
    ]
    hits = F.array(*(F.struct(F.lit(k).alias("rule_id"), F.when(F.coalesce(w, F.lit(False)), F.lit(n) if isinstance(n, int) else n).otherwise(0).cast("bigint").alias("n")) for k, w, n in rules))
    return info.select("path", F.explode(F.filter(hits, lambda h: h.n > 0)).alias("h")).select("path", "h.rule_id", "h.n")
