"""Text columns as Python slices and splits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_text(col: Column, start: int | None, end: int | None) -> Column:
    """``text[start:end]`` with Python's rules for negative and missing ends."""
    n = F.length(col)

    def at(i: int | None, missing: Column) -> Column:
        return missing if i is None else F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)

    a, b = at(start, F.lit(0)), at(end, n)
    return F.when(col.isNotNull(), F.when(b > a, F.substr(col, a + 1, b - a)).otherwise(F.lit("")))


def java_pattern(literal: str, ignore_case: bool = False) -> str:
    r"""A literal text as a Java pattern: quoted, with ``\E`` inside it taken apart."""
    return ("(?iu)" if ignore_case else "") + "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def java_replacement(text: str) -> str:
    r"""A Python replacement for Java: ``\1`` becomes ``$1``, other ``$`` and ``\`` are escaped."""
    parts = re.split(r"\\(\d+)", text)
    return "".join(f"${p}" if i % 2 else p.replace("\\", "\\\\").replace("$", "\\$") for i, p in enumerate(parts))


def first_piece(col: Column, pattern: str, before: bool = True) -> Column:
    """The text before (or after) the first match of a pattern; the whole text if there is none."""
    return F.element_at(F.split(col, pattern, 2), 1 if before else -1)
