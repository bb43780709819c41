"""Masks that add noise or resample: additive, correlated, restricted and outlier noise, post-randomisation, rotation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import Mask, checkpointed, chosen, is_numeric, number, row_key, with_position
from veilwork.errors import InputError, NotInRangeError
from veilwork.functions.keyed import normal, uniform
from veilwork.functions.stats import chi2_quantile
from veilwork.plans.encode import encode_columns


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and sample covariances of rows without nulls in ``cols``, in one aggregate of p (p + 3) / 2 numbers."""
    x = [number(c) for c in cols]
    full = df.filter(F.expr("true") if not cols else _all([c.isNotNull() for c in x]))
    asks = [F.count(F.lit(1))] + [F.avg(c) for c in x] + [F.covar_samp(x[i], x[j]) for i in range(len(x)) for j in range(i, len(x))]
    got = list(full.agg(*[a.alias(f"a{i}") for i, a in enumerate(asks)]).first())
    n, mean, rest = got[0], np.array([m if m is not None else np.nan for m in got[1 : len(x) + 1]], float), iter(got[len(x) + 1 :])
    cov = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        for j in range(i, len(x)):
            v = next(rest)
            cov[i, j] = cov[j, i] = np.nan if v is None else v
    return n, mean, cov


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _deviation(variance: float, n: int, degrees: int) -> float:
    return math.sqrt(max(0.0, variance * (n - 1) / (n - degrees))) if n > degrees and not math.isnan(variance) else 0.0


def add_noise_additive(
    df: DataFrame, magnitude: float = 5, centered: bool = False, degrees: int = 1, seed: int = 1234,
    key: str | list[str] | None = None, cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """``x + N(0, m sd)``; centred noise keeps mean and variance: ``d x + m N((1 - d) / m mean, sd)``, ``d = sqrt(1 - m^2)``."""
    m, names, row, made = magnitude / 100, chosen(df, cols, numeric=True), row_key(df, key), {}
    asks = [f(number(c)) for c in names for f in (F.count, F.avg, F.var_samp)]
    got = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(asks)]).first()
    for i, c in enumerate(names):
        n, mean, var = got[3 * i : 3 * i + 3]
        sd, z = _deviation(var if var is not None else math.nan, n, degrees), normal(row, c, seed)
        d = math.sqrt(max(0.0, 1 - m * m))
        made[c] = number(c) * d + (1 - d) * (mean or 0.0) + z * (m * sd) if centered else number(c) + z * (m * sd)
    return Mask(made).apply(df, output)


def add_noise_correlated(
    df: DataFrame, magnitude: float = 5, encode_non_numeric: bool = False, seed: int = 1234, key: str | list[str] | None = None,
    cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Noise with covariances in proportion to the data's (two columns or more).

    With ``encode_non_numeric`` columns that aren't numbers become the codes of their sorted values first, and the share
    is the square of the magnitude in percent.
    """
    names, share = chosen(df, cols, numeric=not encode_non_numeric, least=2), magnitude / 100
    row = row_key(df, key)
    if encode_non_numeric:
        share = share * share
        keyed = df.withColumn("_key", row)
        df, row = encode_columns(keyed, names), F.col("_key")
    _, _, cov = moments(df, names)
    root = lower_root(np.nan_to_num(cov) * share)
    z = [normal(row, f"z{k}", seed) for k in range(len(names))]
    made = Mask({c: number(c) + sum((z[k] * float(root[i, k]) for k in range(i + 1)), F.lit(0.0)) for i, c in enumerate(names)})
    out = made.apply(df, output, not encode_non_numeric)
    return out.drop("_key") if encode_non_numeric else out


def lower_root(cov: np.ndarray) -> np.ndarray:
    """Lower triangular root of a covariance matrix; a column that depends on those before it adds no draw of its own."""
    p, root = len(cov), np.zeros_like(cov)
    for j in range(p):
        left = cov[j, j] - root[j, :j] @ root[j, :j]
        if left <= 1e-12 * max(cov[j, j], 1e-300):
            continue
        root[j, j] = math.sqrt(left)
        root[j + 1 :, j] = (cov[j + 1 :, j] - root[j + 1 :, :j] @ root[j, :j]) / root[j, j]
    return root


def add_noise_restricted(df: DataFrame, magnitude: float = 5, cols: Sequence[str] | str | None = None, output: str = "all") -> DataFrame:
    """Shrink to the mean: ``c x + (1 - c) mean``, with c from the row count and the magnitude; no randomness."""
    m, names = magnitude / 100, chosen(df, cols, numeric=True)
    asks = [F.count(F.lit(1)), *[F.avg(number(c)) for c in names]]
    n, *means = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(asks)]).first()
    if m > n - 1:
        raise InputError("the magnitude is too large for the number of rows")
    c_ = math.sqrt((n - 1 - m) / ((n + 1) * (1 + m))) if n < 500 else math.sqrt((n - 1) / (n + n * m - 1))
    return Mask({c: number(c) * c_ + (1 - c_) * (mean or 0.0) for c, mean in zip(names, means, strict=True)}).apply(df, output)


#: Starts of the robust centre, the most steps of each, and the most of the best one after them, until it is stable.
STARTS, STEPS, LAST_STEPS = 30, 20, 500


def _far(data: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Squared distances as the bits of doubles of 0 or more, which sort like the numbers."""
    with np.errstate(invalid="ignore"):
        far = np.einsum("ij,jk,ik->i", data - mean, inverse, data - mean)
    return (np.maximum(np.nan_to_num(far, nan=np.inf, posinf=np.inf), 0) + 0.0).view(np.int64)


def _summed(table: DataFrame, p: int, parts: Callable[[np.ndarray, np.ndarray], Iterator[tuple]]) -> dict[int, dict[int, float]]:
    """Totals over all rows of the (centre, keys, numbers) that ``parts`` makes of a batch's values and counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = b.to_numpy(float)
            for s, k, v in parts(a[:, :p], a[:, p]):
                yield pd.DataFrame({"s": np.full(len(k), s, np.int32), "k": k, "v": v})

    out: dict[int, dict[int, float]] = {}
    for s, k, v in table.mapInPandas(run, "s int, k long, v double").groupBy("s", "k").agg(F.sum("v")).collect():
        out.setdefault(s, {})[k] = v
    return out


def _places(table: DataFrame, p: int, centres: list[tuple[np.ndarray, np.ndarray]], ranks: list[int]) -> list[tuple[int, float, float]]:
    """Per (mean, inverse): the bin of the row of that rank by distance, the rows below the bin, and those in it.

    A bin is a millionth (2^-20) of its distance wide; it is found by counts over all rows, of 2^-8 first.
    """
    found = [(0, 0.0, 0.0)] * len(centres)
    for top, shift in ((63, 44), (44, 32)):
        heads = [f[0] for f in found]

        def parts(data: np.ndarray, n: np.ndarray, top: int = top, shift: int = shift, heads: list[int] = heads) -> Iterator[tuple]:
            for s, centre in enumerate(centres):
                bits = _far(data, *centre)
                at = bits >> top == heads[s]
                k, where = np.unique(bits[at] >> shift, return_inverse=True)
                yield s, k, np.bincount(where, n[at], len(k))

        counts = _summed(table, p, parts)
        for s, rank in enumerate(ranks):
            below = found[s][1]
            for k, n in sorted(counts[s].items()):
                if below + n >= rank:
                    found[s] = k, below, n
                    break
                below += n
    return found


def _concentrated(table: DataFrame, p: int, fits: list[tuple[np.ndarray, np.ndarray]], h: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per (mean, covariance): those of the ``h`` rows nearest to it. Rows that tie for the last places share them."""
    centres = [(mean, np.linalg.pinv(cov)) for mean, cov in fits]
    places = _places(table, p, centres, [h] * len(fits))

    def parts(data: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        for s, (centre, (last, below, ties)) in enumerate(zip(centres, places, strict=True)):
            k = _far(data, *centre) >> 32
            at = k <= last
            z, w = data[at] - centre[0], n[at] * np.where(k[at] < last, 1.0, (h - below) / ties)
            yield s, np.arange(1 + p + p * p), np.concatenate([[w.sum()], w @ z, ((z * w[:, None]).T @ z).ravel()])

    out = []
    for s, total in sorted(_summed(table, p, parts).items()):
        v = np.array([total[k] for k in range(1 + p + p * p)])
        move = v[1 : p + 1] / v[0]
        cov = (v[p + 1 :].reshape(p, p) - v[0] * np.outer(move, move)) / (v[0] - 1)
        out.append((centres[s][0] + move, (cov + cov.T) / 2))
    return out


def _same(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    return all(np.allclose(x, y, 1e-9, 1e-12) for x, y in zip(a, b, strict=True))


def robust_centre(df: DataFrame, cols: Sequence[str], seed: int = 123) -> tuple[np.ndarray, np.ndarray]:
    """Location and covariance of the half of all complete rows that is closest together (minimum determinant).

    Every step counts and sums over the whole table, equal rows as one with their number. The driver gets totals, and
    of rows only distinct values to start from, 30 (p + 1) at most.
    """
    p, names = len(cols), [f"x{i}" for i in range(len(cols))]
    rows = df.select(*[number(c).alias(x) for c, x in zip(cols, names, strict=True)]).dropna()
    table = checkpointed(rows.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")))
    n = int(table.agg(F.sum("n")).first()[0] or 0)
    if n <= p + 1:
        return moments(df, cols)[1] if n else np.zeros(p), np.eye(p)
    h, rng = (n + p + 1) // 2, np.random.default_rng(seed)
    finite = table.filter(_all([F.abs(x) < float("inf") for x in names])).select(*names)
    pool = np.array(finite.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(STARTS * (p + 1)).collect(), float).reshape(-1, p)
    fits = []
    for _ in range(STARTS):
        some = pool[rng.choice(len(pool), min(len(pool), p + 1), replace=False)]
        fits.append((some.mean(axis=0), np.atleast_2d(np.cov(some.T, bias=True))))
    moving = list(range(STARTS))
    for step in range(STEPS + LAST_STEPS):
        if step == STEPS:
            moving = [s for s in moving if s == min(range(STARTS), key=lambda s: np.linalg.det(fits[s][1]))]
        if not moving:
            break
        new = dict(zip(moving, _concentrated(table, p, [fits[s] for s in moving], h), strict=True))
        moving = [s for s, fit in new.items() if not _same(fit, fits[s])]
        fits = [new.get(s, fit) for s, fit in enumerate(fits)]
        ahead: list[int] = []
        for s in moving:  # one of those that have met
            twin = next((t for t in ahead if _same(fits[s], fits[t])), None)
            if twin is None:
                ahead.append(s)
            else:
                fits[s] = fits[twin]
        moving = ahead
    mean, cov = min(fits, key=lambda fit: np.linalg.det(fit[1]))
    middle = _places(table, p, [(mean, np.linalg.pinv(cov))] * 2, [(n + 1) // 2, n // 2 + 1])
    far = np.array([(k << 32) + (1 << 31) for k, _, _ in middle], np.int64).view(float).mean()
    return mean, cov * max(far / chi2_quantile(0.5, p), 1e-12)


#: Which of the two neighbours of a quantile is taken, by its place between them.
INTERPOLATIONS: dict[str, Callable[[float], float]] = {
    "linear": lambda x: x, "lower": math.floor, "higher": math.ceil, "midpoint": lambda x: (math.floor(x) + math.ceil(x)) / 2, "nearest": round,
}


def quantiles(df: DataFrame, cols: Sequence[str], q: float, interpolation: str = "linear") -> list[float | None]:
    """Each column's exact quantile over its own values."""
    if interpolation not in INTERPOLATIONS:
        raise InputError(f"known: {', '.join(INTERPOLATIONS)}")
    sizes = df.agg(*[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    places = [INTERPOLATIONS[interpolation](round(q * (n - 1), 9)) / (n - 1) if n > 1 else 0.0 for n in sizes]
    return list(df.agg(*[F.percentile(number(c), min(max(p, 0.0), 1.0)).alias(f"q{i}") for i, (c, p) in enumerate(zip(cols, places, strict=True))]).first())


def add_noise_outliers(
    df: DataFrame, magnitude: float = 5, q: float = 0.99, interpolation: str = "linear", seed: int = 123, key: str | list[str] | None = None,
    cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Noise for outlying rows only: above a column's q-quantile, or far from the robust centre (97.5 % of chi-squared).

    A quantile between two values is their ``interpolation``: linear, lower, higher, midpoint or nearest.
    """
    names, row = chosen(df, cols, numeric=True, least=2), row_key(df, key)
    x = [number(c) for c in names]
    asks = [F.count(F.lit(1)), *[F.stddev_samp(c) for c in x]]
    n, *sds = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(asks)]).first()
    tops = quantiles(df, names, q, interpolation)
    mean, cov = robust_centre(df, names, seed)
    inverse = np.linalg.pinv(cov)
    far = sum(((x[i] - float(mean[i])) * (x[j] - float(mean[j])) * float(inverse[i, j]) for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    outlying = F.coalesce(far > chi2_quantile(0.975, len(x)), F.lit(False))
    for c, t in zip(x, tops, strict=True):
        outlying = outlying | F.coalesce(c > t, F.lit(False)) if t is not None else outlying
    made = {}
    for c, e, sd in zip(names, x, sds, strict=True):
        scale = 1.96 * (sd or 0.0) / math.sqrt(max(1, n)) * magnitude / 100
        made[c] = F.when(outlying, e + normal(row, c, seed) * scale).otherwise(e)
    return Mask(made).apply(df, output)


def add_noise(df: DataFrame, method: str = "additive", **options: object) -> DataFrame:
    known = {"additive": add_noise_additive, "correlated": add_noise_correlated, "restricted": add_noise_restricted, "outliers": add_noise_outliers}
    if method not in known:
        raise InputError(f"unknown method {method}")
    return known[method](df, **options)


def transition_matrix(counts: dict[object, int], probs: float, alpha: float, seed: int) -> tuple[list, np.ndarray]:
    """Categories (sorted) and the chances to go from one to another that keep the expected frequencies."""
    names = sorted(counts)
    k, f = len(names), np.array([counts[c] for c in names], float)
    rng = np.random.default_rng(seed)
    stay = rng.uniform(probs, 1, k)
    p = np.repeat(((1 - stay) / (k - 1))[:, None], k, axis=1)
    np.fill_diagonal(p, stay)
    back = (p * f[:, None]).T / (f @ p)[:, None]  # from what a cell became to what it may have been
    t = alpha * p @ back + (1 - alpha) * np.eye(k)
    return names, t / t.sum(axis=1, keepdims=True)


#: Categories that a column may have to be drawn anew: the matrix of chances has their square of numbers.
MOST_CATEGORIES = 2000


def pram(
    df: DataFrame, perturb_cols: Sequence[str] | str | None = None, sensitive_col: str | None = None, probs: float | dict[str, np.ndarray] = 0.8,
    alpha: float = 0.5, seed: int = 1234, key: str | list[str] | None = None, output: str = "all",
) -> DataFrame:
    """Post-randomisation: each cell is drawn anew from its category's row of a transition matrix; nulls stay.

    ``probs`` is the least chance to stay, or a matrix per column (categories sorted). Columns of one value are left.
    Each category's cumulative chances are a row of a small table that is joined; a column of more than
    ``MOST_CATEGORIES`` categories is an error.
    """
    names = [c for c in chosen(df, perturb_cols) if c != sensitive_col]
    if sensitive_col is not None and (sensitive_col not in df.columns or perturb_cols is not None and sensitive_col in chosen(df, perturb_cols)):
        raise InputError("the sensitive column is unknown or to be perturbed")
    if not 0 <= alpha <= 1 or not isinstance(probs, dict) and not 0 <= probs <= 1:
        raise NotInRangeError("alpha and probs lie between 0 and 1")
    out, made = df.withColumn("_key", row_key(df, key)), {}
    for i, c in enumerate(names):
        counts = {r[0]: r[1] for r in df.filter(F.col(c).isNotNull()).groupBy(c).count().limit(MOST_CATEGORIES + 1).collect()}
        if len(counts) > MOST_CATEGORIES:
            raise InputError(f"{c} has more than {MOST_CATEGORIES} categories")
        if len(counts) < 2:
            continue
        if isinstance(probs, dict):
            if c not in probs:
                raise InputError(f"no matrix for {c}")
            order, t = sorted(counts), np.asarray(probs[c], float)
        else:
            order, t = transition_matrix(counts, probs, alpha, seed + i)
        kind = df.schema[c].dataType.simpleString()
        # the chances up to each category but the last; the draw passes so many of them
        table = df.sparkSession.createDataFrame([(name, steps.tolist()) for name, steps in zip(order, np.cumsum(t, axis=1)[:, :-1], strict=True)], f"_c{i} {kind}, _s{i} array<double>")
        out = out.join(F.broadcast(table), F.col(c) == F.col(f"_c{i}"), "left")
        out = out.withColumn(f"_u{i}", uniform(F.col("_key"), c, seed))
        passed = F.size(F.expr(f"filter(_s{i}, x -> x <= _u{i})"))
        categories = df.sparkSession.createDataFrame([(order,)], f"_all{i} array<{kind}>")
        out = out.crossJoin(F.broadcast(categories))  # one row
        made[c] = F.when(F.col(c).isNotNull(), F.element_at(f"_all{i}", passed + 1))
    if not made:
        raise InputError("every column has one value at most")
    out = out.withColumns(made)
    return out.select(*made) if output == "subset" else out.select(*df.columns)


# The angles in degrees that the search leaves out.
SKIPPED = (30, 45, 60, 90, 120, 135, 150, 180)


def rotation(p: int, degrees: float) -> np.ndarray:
    """The product of the rotations by one angle in the planes of every two axes, in order."""
    turn, a = np.eye(p), math.radians(degrees)
    for i, j in combinations(range(p), 2):
        plane = np.eye(p)
        plane[i, i] = plane[j, j] = math.cos(a)
        plane[i, j], plane[j, i] = -math.sin(a), math.sin(a)
        turn = turn @ plane
    return turn


def geometric(
    df: DataFrame, perturb_cols: Sequence[str] | str | None = None, sensitive_col: str | None = None, magnitude: float = 0.3,
    shuffle: bool = False, seed: int = 1234, key: str | list[str] | None = None, output: str = "all",
) -> DataFrame:
    """Standardise, reflect, move, rotate by the angle and axis that hide each column best, expand, and scale back.

    The search is over p x p matrices of correlations on the driver; the mask is one linear combination per column.
    ``shuffle`` moves the perturbed columns, and the sensitive one, together to other rows: each row takes those of the
    row whose place by a keyed draw is its own place in the order of the keys (a unique ``key`` is needed for that).
    """
    names = [c for c in chosen(df, perturb_cols) if c != sensitive_col]
    if sensitive_col is not None and sensitive_col not in df.columns:
        raise InputError(f"unknown column {sensitive_col}")
    if odd := [c for c in names if not is_numeric(df, c)]:
        raise InputError(f"not numeric: {', '.join(odd)}")
    _, mean, cov = moments(df, names)
    keep = [i for i in range(len(names)) if cov[i, i] > 0]
    if len(keep) < 2:
        raise InputError("two columns or more that vary are needed")
    names, mean, cov = [names[i] for i in keep], mean[keep], cov[np.ix_(keep, keep)]
    sd = np.sqrt(np.diag(cov))
    corr, p, best = cov / np.outer(sd, sd), len(names), None
    for degrees in (d for d in range(1, 181) if d not in SKIPPED):
        turn = rotation(p, degrees)
        for axis in range(p):
            t = turn.copy()
            t[:, axis] *= -1
            gap = np.eye(p) - t
            privacy = np.diag(gap @ corr @ gap.T).min()  # variance of what a column differs from itself by
            if best is None or privacy > best[0]:
                best = privacy, t, axis
    _, t, _ = best
    move = np.random.default_rng(seed).uniform(0, 1, p)
    row, z = row_key(df, key), [(number(c) - float(m)) / float(s) for c, m, s in zip(names, mean, sd, strict=True)]
    made = {}
    for i, c in enumerate(names):
        y = sum((z[j] * float(t[i, j]) for j in range(p)), F.lit(float(t[i] @ move)))
        made[c] = (y + F.sign(y) * uniform(row, c, seed) * abs(magnitude)) * float(sd[i]) + float(mean[i])
    if not shuffle:
        return Mask(made).apply(df, output, False)
    if key is None:
        raise InputError("rows are shuffled by their key")
    moved = [*names, *([sensitive_col] if sensitive_col is not None else [])]
    masked = Mask(made).apply(df, "all", False).withColumn("_key", row)
    taken = with_position(masked.select("_key", *[F.col(c).alias(f"_m_{c}") for c in moved]), [uniform(F.col("_key"), "place", seed), F.col("_key")]).drop("_key")
    out = with_position(masked, [F.col("_key")]).join(taken, "_pos").withColumns({c: F.col(f"_m_{c}") for c in moved})
    return out.select(*names) if output == "subset" else out.select(*df.columns)
