"""The lasso's whole least-angle path from the moments of columns, cross-validated by the moments of folds, in one job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import number
from veilwork.errors import InputError

#: Columns whose products one aggregate sums.
WIDEST = 200


@dataclass(frozen=True)
class Moments:
    """Rows, means and mean products around the means of columns, the label last."""

    n: int
    mean: np.ndarray
    cov: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n, far = self.n + other.n, other.mean - self.mean
        cov = (self.n * self.cov + other.n * other.cov) / n + np.outer(far, far) * self.n * other.n / n**2
        return Moments(n, self.mean + far * other.n / n, cov)


def total(parts: Iterable[Moments]) -> Moments:
    first, *rest = parts
    for m in rest:
        first = first + m
    return first


def fold_moments(df: DataFrame, features: Sequence[str], label: str, folds: int, seed: int = 1234) -> list[Moments]:
    """Moments of each fold from one aggregate: (p + 1)(p + 4) / 2 numbers a fold, whatever the rows.

    Rows with a null or NaN are left out. A row's fold hangs on its values alone, so equal rows are in one fold under
    any partitioning. Folds without rows aren't given; a table without rows gives none.
    """
    if len(features) > WIDEST:
        raise InputError(f"more than {WIDEST} columns")
    names = [*features, label]
    rows = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    x = [f"x{i}" for i in range(len(names))]
    at = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    fold = F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(folds))
    asks = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in at]
    found = []
    for r in rows.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), *asks).orderBy("fold").collect():
        cov = np.zeros((len(x), len(x)))
        for i, j in at:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        found.append(Moments(r["n"], np.array([r[f"m{i}"] for i in range(len(x))]), cov))
    return found


def path(gram: np.ndarray, target: np.ndarray, tiny: float = 1e-12) -> list[tuple[float, np.ndarray]]:
    """Knots ``(penalty, coefficients)`` of the lasso from no column to the least squares, between which they are linear.

    ``gram`` and ``target`` are the columns' correlations with each other and their covariances with the label. Each step
    moves the active columns so that their correlations with what is left shrink alike, until another column's is as
    large (it joins) or a coefficient becomes 0 (it leaves). A column that is a sum of active ones never joins.
    """
    p = len(target)
    beta, left, active, barred = np.zeros(p), np.array(target, float), [], set()
    penalty = float(np.abs(left).max(initial=0.0))
    knots, top, gone = [(penalty, beta.copy())], max(penalty, tiny), None
    if p and penalty > 0:
        active = [int(np.abs(left).argmax())]
    while active and penalty > tiny * top:
        signs = np.sign(left[active])
        way = np.linalg.solve(gram[np.ix_(active, active)], signs)
        pull = gram[:, active] @ way
        step, joins, leaves = penalty, None, None
        for j in sorted(set(range(p)) - set(active) - barred):
            for side in (1, -1):
                gap, speed = penalty - side * left[j], 1 - side * pull[j]
                if j == gone and side * left[j] > 0:
                    continue  # it has just left from this side, but can come back on the other
                if speed > tiny and max(gap, 0.0) / speed < step:
                    step, joins = max(gap, 0.0) / speed, j
        for k, j in enumerate(active):
            if beta[j] * way[k] < 0 and -beta[j] / way[k] < step:
                step, joins, leaves = -beta[j] / way[k], None, j
        beta[active] += step * way
        left -= step * pull
        penalty -= step
        gone = leaves
        if leaves is not None:
            beta[leaves] = 0.0
            active.remove(leaves)
        if joins is not None:
            tried = gram[np.ix_([*active, joins], [*active, joins])]
            if np.linalg.eigvalsh(tried)[0] > 1e-10:
                active.append(joins)
            else:
                barred.add(joins)
        if step > 0:
            knots.append((max(penalty, 0.0), beta.copy()))
    return knots


def at_penalty(knots: list[tuple[float, np.ndarray]], penalty: float) -> np.ndarray:
    """The path's coefficients at a penalty."""
    sizes = np.array([k for k, _ in knots])[::-1]
    betas = np.array([b for _, b in knots])[::-1]
    return np.array([np.interp(penalty, sizes, betas[:, i]) for i in range(betas.shape[1])])


@dataclass(frozen=True)
class Lasso:
    """A fitted path, the penalty that cross-validation chose, and its coefficients in the columns' own units."""

    features: tuple[str, ...]
    knots: list[tuple[float, np.ndarray]]
    penalty: float
    coefficients: np.ndarray
    intercept: float

    def sql(self) -> str:
        """The prediction as an expression; null where a column is null."""
        terms = [f"{b!r}D * cast(`{c.replace('`', '``')}` as double)" for c, b in zip(self.features, map(float, self.coefficients), strict=True)]
        return " + ".join([f"{float(self.intercept)!r}D", *terms])

    def column(self) -> Column:
        return F.expr(self.sql())


def _standardised(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sd = np.sqrt(np.diag(m.cov)[:-1])
    of = np.where(sd > 0, sd, 1.0)  # a column of one value has no products, so it never joins
    return m.cov[:-1, :-1] / np.outer(of, of), m.cov[:-1, -1] / of, of


def lasso_path(df: DataFrame, features: Sequence[str], label: str, folds: int = 5, seed: int = 1234) -> Lasso:
    """The path on standardised columns, at the penalty of the least squared error over the folds.

    Each fold's path is fitted to the sum of the other folds' moments and its error is read from the fold's own moments,
    at the penalties of all knots, so rows are read once. Ties go to the larger penalty. With fewer than two folds
    that have rows, the whole path's end (least squares) is taken; a table without rows is an error.
    """
    parts = fold_moments(df, features, label, folds, seed)
    if not parts:
        raise InputError("there is no row without nulls")
    whole = total(parts)
    gram, target, of = _standardised(whole)
    knots, penalty = path(gram, target), 0.0
    if len(parts) > 1:
        tried = []
        for i, held in enumerate(parts):
            rest = total(p for j, p in enumerate(parts) if j != i)
            g, t, sd = _standardised(rest)
            tried.append((held, rest, sd, path(g, t)))
        sizes = sorted({k for *_, found in tried for k, _ in found} | {k for k, _ in knots})
        errors = []
        for size in sizes:
            error = 0.0
            for held, rest, sd, found in tried:
                b = np.append(-at_penalty(found, size) / sd, 1.0)  # of the label less what is predicted
                error += held.n * (b @ held.cov @ b + (b @ (held.mean - rest.mean)) ** 2)
            errors.append(error / whole.n)
        least = min(errors)
        penalty = max(s for s, e in zip(sizes, errors, strict=True) if e <= least * (1 + 1e-12))
    beta = at_penalty(knots, penalty) / of
    return Lasso(tuple(features), knots, float(penalty), beta, float(whole.mean[-1] - beta @ whole.mean[:-1]))


def knots_table(df: DataFrame, features: Sequence[str], label: str, seed: int = 1234) -> DataFrame:
    """``(step, penalty, <column>..)``: the path's knots in the columns' own units, a row per step."""
    parts = fold_moments(df, features, label, 1, seed)
    gram, target, of = _standardised(total(parts)) if parts else (np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    rows = [(i, float(k), *map(float, b / of)) for i, (k, b) in enumerate(path(gram, target))] if parts else []
    return df.sparkSession.createDataFrame(rows, "step int, penalty double, " + ", ".join(f"`{c}` double" for c in features))
