"""Variance-based sensitivity: Saltelli samples of Sobol's sequence, and Sobol indices with bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import chosen, is_numeric, number
from veilwork.errors import DataTypeError, InputError
from veilwork.functions.keyed import uniform


@dataclass(frozen=True)
class Parameters:
    names: tuple[str, ...]
    bounds: tuple[tuple[float, float], ...]


def parameters(df: DataFrame) -> Parameters:
    """Names and ranges of the columns, from one aggregate."""
    if odd := [c for c in df.columns if not is_numeric(df, c)]:
        raise DataTypeError(f"not numeric: {', '.join(odd)}")
    names = chosen(df, None)
    got = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("a", F.min), ("b", F.max))]).first()
    return Parameters(tuple(names), tuple((got[f"a{i}"], got[f"b{i}"]) for i in range(len(names))))


# Published initial direction numbers (Joe and Kuo, 2008) of dimensions 2 to 21, each with the degree and the
# inner coefficients of its primitive polynomial.
DIRECTIONS = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)), (5, 14, (1, 3, 5, 5, 31)), (6, 1, (1, 3, 3, 9, 7, 49)), (6, 13, (1, 1, 1, 15, 21, 21)),
    (6, 16, (1, 3, 1, 13, 27, 49)), (6, 19, (1, 1, 1, 15, 7, 5)), (6, 22, (1, 3, 1, 15, 13, 25)),
    (6, 25, (1, 1, 5, 5, 19, 61)), (7, 1, (1, 3, 7, 11, 23, 15, 103)), (7, 4, (1, 3, 7, 13, 13, 15, 69)),
)
#: Binary digits of a point.
BITS = 40


def _primitive(degree: int) -> list[int]:
    """Inner coefficients of the primitive polynomials of a degree: those whose powers of x pass through every remainder."""
    whole, found = (1 << degree) - 1, []
    tests = [whole // p for p in range(2, whole + 1) if whole % p == 0 and all(p % q for q in range(2, int(p**0.5) + 1))] if degree > 1 else []

    def times(a: int, b: int, poly: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = a << 1, b >> 1
            a ^= poly if a >> degree & 1 else 0
        return out

    def power(of: int, poly: int) -> int:
        out, base = 1, 2
        while of:
            out = times(out, base, poly) if of & 1 else out
            base, of = times(base, base, poly), of >> 1
        return out

    for inner in range(1 << (degree - 1)):
        poly = (1 << degree) | (inner << 1) | 1
        if power(whole, poly) == 1 and all(power(t, poly) != 1 for t in tests):
            found.append(inner)
    return found


def direction_numbers(dimensions: int) -> list[list[int]]:
    """``BITS`` direction numbers of each dimension, as whole numbers of that many digits.

    Beyond the published ones polynomials go on in their order; their first numbers are drawn odd, from the dimension.
    """
    table = list(DIRECTIONS)
    degree, known = max(s for s, _, _ in table), {(s, a) for s, a, _ in table}
    while len(table) < dimensions - 1:
        for inner in _primitive(degree):
            if (degree, inner) not in known:
                draw = np.random.default_rng((degree, inner))
                table.append((degree, inner, tuple(2 * int(draw.integers(1 << k)) + 1 for k in range(degree))))
        degree += 1
    out = [[1 << (BITS - 1 - k) for k in range(BITS)]]
    for s, inner, first in table[: dimensions - 1]:
        v = [m << (BITS - 1 - k) for k, m in enumerate(first)]
        for k in range(s, BITS):
            x = v[k - s] ^ (v[k - s] >> s)
            for j in range(1, s):
                x ^= v[k - j] if inner >> (s - 1 - j) & 1 else 0
            v.append(x)
        out.append(v[:BITS])
    return out[:dimensions]


def sobol_point(i: Column, numbers: list[int], digits: int) -> Column:
    """Coordinate of point ``i`` (from 0, below ``2 ** digits``) of a digital net, in the order of Gray codes."""
    gray, out = i.bitwiseXOR(F.shiftright(i, 1)), F.lit(0).cast("bigint")
    for k in range(digits):
        out = out.bitwiseXOR(F.shiftright(gray, k).bitwiseAND(F.lit(1)) * F.lit(numbers[k]).cast("bigint"))
    return out.cast("double") / float(1 << BITS)


def samples(params: Parameters, n: int = 10_000, second_order: bool = True, method: str | None = None, spark=None, skip: int | None = None) -> DataFrame:  # noqa: ANN001
    """``(base, matrix, columns..)``: Saltelli's ``n (2 D + 2)`` rows (``n (D + 2)`` without second order).

    Matrices: a, b, ``ab<i>`` (a with column i of b) and ``ba<i>``. Points are those of Sobol's sequence in 2 D dimensions
    from ``skip`` on (the least power of two that isn't below ``n``, if not given), each made on the executors from its row
    number by exclusive ors of direction numbers: no point needs the one before.
    """
    if method not in (None, "saltelli"):
        raise InputError(f"unknown method {method}")
    d = len(params.names)
    skip = 1 << max(0, (n - 1).bit_length()) if skip is None else skip
    digits = (skip + n).bit_length()
    if n < 0 or skip < 0 or digits > BITS:
        raise InputError(f"points lie between 0 and 2 ** {BITS}")
    base = spark.range(n).withColumnRenamed("id", "base")
    points = [sobol_point(F.col("base") + skip, v, digits) for v in direction_numbers(2 * d)]
    scaled = [lo + x * (hi - lo) for x, (lo, hi) in zip(points, params.bounds * 2, strict=True)]
    base = base.select("base", *[x.alias(f"_p{j}") for j, x in enumerate(scaled)])

    def matrix(name: str, pick: list[int]) -> Column:
        return F.struct(F.lit(name).alias("matrix"), *[F.col(f"_p{j}").alias(c) for j, c in zip(pick, params.names, strict=True)])

    a, b = list(range(d)), list(range(d, 2 * d))
    rows = [matrix("a", a), matrix("b", b), *[matrix(f"ab{i}", [b[i] if k == i else a[k] for k in range(d)]) for i in range(d)]]
    rows += [matrix(f"ba{i}", [a[i] if k == i else b[k] for k in range(d)]) for i in range(d)] if second_order else []
    return base.select("base", F.explode(F.array(*rows)).alias("_m")).select("base", "_m.*")


def analyze(model: Callable[[DataFrame], DataFrame], params: Parameters, table: DataFrame, confidence: float = 0.95, second_order: bool = True, resamples: int = 50, seed: int = 1234) -> DataFrame:
    """``(kind, names, value, low, high)`` for first-order, total and second-order indices.

    ``model`` adds ``prediction``. Indices are ratios of sums over base points, so the bootstrap is a keyed Poisson
    weight per base point and resample, and all resamples are sums of one pass.
    """
    d = len(params.names)
    y = model(table).select("base", "matrix", F.col("prediction").cast("double").alias("y"))
    names = ["a", "b", *[f"ab{i}" for i in range(d)], *([f"ba{i}" for i in range(d)] if second_order else [])]
    wide = y.groupBy("base").pivot("matrix", names).agg(F.first("y"))
    mean = wide.agg(((F.avg("a") + F.avg("b")) / 2).alias("m")).first().m or 0.0
    wide = wide.select("base", *[(F.col(c) - mean).alias(c) for c in names])
    terms = {("S1", (i,)): F.col("b") * (F.col(f"ab{i}") - F.col("a")) for i in range(d)} | {("ST", (i,)): 0.5 * F.pow(F.col("a") - F.col(f"ab{i}"), 2) for i in range(d)}
    if second_order:
        terms |= {("S2", (i, j)): F.col(f"ba{i}") * F.col(f"ab{j}") - F.col("a") * F.col("b") for i in range(d) for j in range(i + 1, d)}
    keys = list(terms)
    # a Poisson(1) count from a keyed uniform, by its cumulative chances
    u = uniform(F.xxhash64("base", "_r"), "boot", seed)
    poisson = sum((F.when(u > c, 1).otherwise(0) for c in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)), F.lit(0))
    each = wide.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples)))).withColumn("_w", F.when(F.col("_r") == 0, 1).otherwise(poisson))
    w = F.col("_w")
    sums = [F.sum(w * terms[k]).alias(f"t{i}") for i, k in enumerate(keys)]
    variance = (F.sum(w * (F.pow("a", 2) + F.pow("b", 2))) / (2 * F.sum(w)) - F.pow(F.sum(w * (F.col("a") + F.col("b"))) / (2 * F.sum(w)), 2)).alias("v")
    got = {r._r: r for r in each.groupBy("_r").agg(F.sum(w).alias("n"), variance, *sums).collect()}  # a row per resample

    def value(r, i: int) -> float:  # noqa: ANN001
        return r[f"t{i}"] / r["n"] / r["v"] if r["v"] else 0.0

    index = {k: [value(got[r], i) for r in sorted(got)] for i, k in enumerate(keys)}
    z, rows = NormalDist().inv_cdf(0.5 + confidence / 2), []
    for kind, at in keys:
        found = index[kind, at]
        if kind == "S2":
            i, j = at
            found = [s - a - b for s, a, b in zip(found, index["S1", (i,)], index["S1", (j,)], strict=True)]
        rest = found[1:] or [found[0]]
        m = sum(rest) / len(rest)
        half = z * (sum((x - m) ** 2 for x in rest) / max(1, len(rest) - 1)) ** 0.5
        rows.append((kind, ",".join(params.names[k] for k in at), found[0], found[0] - half, found[0] + half))
    return table.sparkSession.createDataFrame(rows, "kind string, names string, value double, low double, high double")
