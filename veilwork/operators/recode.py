"""Row-local masks: rounding, top and bottom coding, truncation, substitution, hashing; and recoding into bins."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilwork.core import Mask, chosen, is_numeric, number, row_key
from veilwork.errors import InputError
from veilwork.functions.text import first_piece, java_pattern, java_replacement, slice_text


def rounding(df: DataFrame, magnitude: int = 0, decimals: bool = False, cols: Sequence[str] | str | None = None, output: str = "all") -> DataFrame:
    """Round to ``10^magnitude`` (or to ``magnitude`` decimals); halves go to the even neighbour. Nulls and NaN become null."""
    d = magnitude if decimals else -magnitude
    return Mask({c: F.bround(number(c), d) for c in chosen(df, cols, numeric=True)}).apply(df, output)


def top_recode(df: DataFrame, cutoff: float, to: float | None = None, cols: Sequence[str] | str | None = None, output: str = "all") -> DataFrame:
    """Values not below ``cutoff``, and nulls, become ``to`` (the cutoff itself if not given)."""
    return Mask({c: _top(number(c), cutoff, to) for c in chosen(df, cols, numeric=True)}).apply(df, output)


def bottom_recode(df: DataFrame, cutoff: float, to: float | None = None, cols: Sequence[str] | str | None = None, output: str = "all") -> DataFrame:
    """Values not above ``cutoff``, and nulls, become ``to`` (the cutoff itself if not given)."""
    return Mask({c: _bottom(number(c), cutoff, to) for c in chosen(df, cols, numeric=True)}).apply(df, output)


def topbot_recode(
    df: DataFrame, method: str = "both", top_cutoff: float | None = None, top_to: float | None = None,
    bottom_cutoff: float | None = None, bottom_to: float | None = None, cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Top coding, bottom coding, or top and then bottom coding of its result."""
    if method not in ("top", "bottom", "both"):
        raise InputError(f"unknown method {method}")
    if method in ("top", "both") and top_cutoff is None or method in ("bottom", "both") and bottom_cutoff is None:
        raise InputError("a cutoff is missing")
    made = {}
    for c in chosen(df, cols, numeric=True):
        e = number(c)
        e = _top(e, top_cutoff, top_to) if method != "bottom" else e
        made[c] = _bottom(e, bottom_cutoff, bottom_to) if method != "top" else e
    return Mask(made).apply(df, output)


def _top(c: Column, cutoff: float, to: float | None) -> Column:
    return F.when(c < cutoff, c).otherwise(F.lit(float(cutoff if to is None else to)))


def _bottom(c: Column, cutoff: float, to: float | None) -> Column:
    return F.when(c > cutoff, c).otherwise(F.lit(float(cutoff if to is None else to)))


def truncate(
    df: DataFrame, method: str = "index", idx: int = 0, end: int | None = None, trim_from: str | None = None,
    match: str | None = None, keep_before: bool = True, ignore_case: bool = False, cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Cut texts by index (``text[idx:end]``, or ``idx`` from the start, the end or both) or at a literal's first match."""
    if method == "match":
        if match is None:
            raise InputError("a text to match is missing")
        pattern = java_pattern(match, ignore_case)
        return Mask({c: first_piece(F.col(c).cast("string"), pattern, keep_before) for c in chosen(df, cols)}).apply(df, output, False)
    if method != "index":
        raise InputError(f"unknown method {method}")
    spans = {None: (idx, end), "start": (idx, None), "end": (0, -idx), "both": (idx, -idx)}
    if trim_from not in spans:
        raise InputError(f"unknown side {trim_from}")
    return Mask({c: slice_text(F.col(c).cast("string"), *spans[trim_from]) for c in chosen(df, cols)}).apply(df, output, False)


def substitute(
    df: DataFrame, from_val: object, to_val: object, substring: bool = False, replace_all: bool = False,
    ignore_case: bool = False, cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Replace values, in turn for lists (single ones serve all).

    ``"*"`` replaces every value. Numbers are compared whole. In texts ``from_val`` is a pattern: as whole words, as any
    part (``substring``), or for the whole value where it is found (``substring`` with ``replace_all``).
    """
    old = list(from_val) if isinstance(from_val, (list, tuple)) else [from_val]
    new = list(to_val) if isinstance(to_val, (list, tuple)) else [to_val]
    size = max(len(old), len(new))
    if len(old) not in (1, size) or len(new) not in (1, size):
        raise InputError("lists of values have unequal lengths")
    pairs = list(zip(old * (size // len(old)), new * (size // len(new)), strict=True))
    made = {}
    for c in chosen(df, cols):
        e = F.col(c)
        for a, b in pairs:
            if a == "*":
                e = F.lit(b)
            elif is_numeric(df, c):
                e = F.when(e == F.lit(a), F.lit(b)).otherwise(e)
            else:
                flag = "(?iu)" if ignore_case else ""
                e = e.cast("string")
                if substring and replace_all:
                    e = F.when(F.rlike(e, F.lit(f"{flag}{a}")), F.lit(str(b))).otherwise(e)
                else:
                    e = F.regexp_replace(e, flag + (str(a) if substring else f"\\b{a}\\b"), java_replacement(str(b)))
        made[c] = e
    return Mask(made).apply(df, output, False)


def hashing(
    df: DataFrame, function: str | Callable[[bytes], str] = "sha256", salt: str | int | None = None, append_salt: bool = True,
    salt_path: str | None = None, key: str | list[str] | None = None, seed: int = 1234, cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Hex digests of each cell's text, with a constant salt (text) or one of ``salt`` bytes per cell (number).

    md5, sha1 and the sha2 family stay in the JVM; other hashlib names (shake with 16 bytes) and callables of bytes run
    in Arrow batches. A salt per cell is keyed by row, column and seed, and written to ``salt_path`` if given. Nulls stay null.
    """
    native = {"md5": F.md5, "sha1": F.sha1, **{f"sha{b}": (lambda x, b=b: F.sha2(x, b)) for b in (224, 256, 384, 512)}}
    if not callable(function) and function not in native and function not in hashlib.algorithms_available:
        raise InputError(f"unknown hash function {function}")
    if salt is not None and (isinstance(salt, bool) or not isinstance(salt, (str, int)) or isinstance(salt, int) and salt <= 0):
        raise InputError("the salt is a text or a number of bytes")
    names, row = chosen(df, cols), row_key(df, key)

    def of(data: Column) -> Column:
        if not callable(function) and function in native:
            return native[function](data)

        @F.pandas_udf(StringType())
        def digest(cells: pd.Series) -> pd.Series:
            def one(b: bytes | None) -> str | None:
                if b is None:
                    return None
                if callable(function):
                    return function(bytes(b))
                h = hashlib.new(function, bytes(b))
                return h.hexdigest(16) if function.startswith("shake") else h.hexdigest()

            return cells.map(one)

        return digest(data)

    salts = {c: F.lit(salt) if isinstance(salt, str) else F.substring(F.sha2(F.concat_ws("|", row.cast("string"), F.lit(c), F.lit(str(seed))), 512), 1, 2 * salt) for c in names} if salt is not None else {}
    made = {}
    for c in names:
        text = F.col(c).cast("string")
        if c in salts:
            text = F.concat(text, salts[c]) if append_salt else F.concat(salts[c], text)
        made[c] = of(F.encode(text, "UTF-8"))
    if salt_path and isinstance(salt, int):
        df.select(row.alias("row_key"), *[s.alias(c) for c, s in salts.items()]).write.mode("overwrite").csv(salt_path, header=True)
    return Mask(made).apply(df, output, False)


def rank_swap(df: DataFrame, cols: Sequence[str] | str | None = None, output: str = "all") -> DataFrame:
    """Gives the columns back as they are."""
    return Mask({c: F.col(c) for c in chosen(df, cols)}).apply(df, output)


def bin_edges(df: DataFrame, col: str, bins: int | Sequence[float], method: str | None = None) -> list[float]:
    """Edges of right-closed bins, from one aggregate: equal width, or equidistant, log_equidistant, quantiles, magnitude."""
    if not isinstance(bins, int):
        return sorted(set(map(float, bins)))
    if method not in (None, "equidistant", "log_equidistant", "quantiles", "magnitude"):
        raise InputError(f"unknown bin method {method}")
    if bins < 1:
        raise InputError("one bin or more is needed")
    steps = [i / bins for i in range(bins + 1)]
    if method == "quantiles":
        found = df.agg(F.percentile(number(col), steps).alias("q")).first().q
        return sorted(set(found or []))
    low, high = df.agg(F.min(number(col)), F.max(number(col))).first()
    if low is None:
        return []
    if method in ("log_equidistant", "magnitude"):
        if low <= 0:
            raise InputError("logarithms need values above zero")
        log, power = (math.log, math.exp) if method == "log_equidistant" else (math.log10, lambda x: 10**x)
        a, b = log(low), log(high)
        edges = [power(a + (b - a) * s) for s in steps]
        edges[0], edges[-1] = low, high
        return sorted(set(edges))
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        low, high = low - pad, high + pad
        return [low + (high - low) * s for s in steps]
    edges = [low + (high - low) * s for s in steps]
    edges[-1] = high
    if method is None:
        edges[0] = low - (high - low) * 0.001
    return edges


def _label(x: float, digits: int = 3) -> str:
    """A bin's edge with three digits after the first that isn't zero, for values below one, else three decimals."""
    whole, part = int(x), abs(x - int(x))
    if not part:
        return f"{x:.1f}"
    places = digits if whole else -int(math.floor(math.log10(part))) - 1 + digits
    text = f"{round(x, places):.{places}f}".rstrip("0")
    return text + "0" if text.endswith(".") else text


def global_recode(
    df: DataFrame, bins: int | Sequence[float] = 2, bin_method: str | None = None, labels: Sequence[object] | None = None,
    ints: bool = False, cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Values become their bin's label, ``(a, b]`` unless labels are given; the lowest bin takes its lower edge too.

    Values outside the edges, and nulls, become null. With ``ints`` bins are numbered in the order of their labels as
    text, null last.
    """
    made = {}
    for c in chosen(df, cols, numeric=True):
        edges = bin_edges(df, c, bins, bin_method)
        n = max(0, len(edges) - 1)
        if labels is not None and len(labels) != n:
            raise InputError(f"{n} labels are needed")
        shown = list(edges)
        if n:
            shown[0] = float(_label(edges[0])) - 0.001  # so that the label holds the lowest value
        names = list(map(str, labels)) if labels is not None else [f"({_label(a)}, {_label(b)}]" for a, b in zip(shown, shown[1:], strict=False)]
        x, e = number(c), F.lit(None).cast("string")
        for i in reversed(range(n)):
            inside = (x <= edges[i + 1]) & ((x >= edges[0]) if i == 0 else (x > edges[i]))
            e = F.when(inside, F.lit(names[i])).otherwise(e)
        if ints:
            code = {v: i for i, v in enumerate(sorted(names))}
            number_of = F.lit(len(names))
            for v, i in code.items():
                number_of = F.when(e == v, F.lit(i)).otherwise(number_of)
            e = F.when(e.isNull(), F.lit(len(names))).otherwise(number_of)
        made[c] = e
    return Mask(made).apply(df, output, False)
