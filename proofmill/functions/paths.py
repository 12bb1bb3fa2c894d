"""File names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The name a spelled path resolves to.

    ``/`` separates, ``.`` and ``..`` are resolved, repeated separators dropped, case kept and a final
    ``@from-to`` cut. ``..`` beyond the start of a relative path stays, beyond the root it goes.
    Null gives null.
    """
    plain = F.regexp_replace(F.translate(path, "\\", "/"), r"@\d+-\d+$", "")
    rooted = plain.startswith("/")
    parts = F.filter(F.split(plain, "/+"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        top = F.try_element_at(kept, F.lit(-1))
        up = top.isNotNull() & (top != "..")
        return F.when(part != "..", F.array_append(kept, part)).when(up, F.slice(kept, 1, F.size(kept) - 1)).when(rooted, kept).otherwise(F.array_append(kept, part))

    joined = F.array_join(F.when(F.array_contains(parts, ".."), F.aggregate(parts, empty, step)).otherwise(parts), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def file_source(path: Column) -> Column:
    """The first two parts of a resolved path."""
    return F.array_join(F.slice(F.split(F.ltrim(file_name(path), F.lit("/")), "/"), 1, 2), "/")
