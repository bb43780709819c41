"""Key-variable exploration: which columns tell a sensitive one, by forests, shadows, elimination and stepwise regression."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import at_once, checkpointed, is_numeric, with_position
from veilwork.functions.stats import binomial_tail, t_p_value
from veilwork.operators.noise import moments
from veilwork.plans.encode import embed
from veilwork.plans.models import task

METHODS = ("rf", "boruta", "rfe", "stepwise")


def _prepared(df: DataFrame, features: Sequence[str], target: str, classes: bool) -> DataFrame:
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).alias(target)).dropna()
    if classes:
        rows = StringIndexer(inputCol=target, outputCol="_y").fit(rows.withColumn(target, F.col(target).cast("string"))).transform(rows.withColumn(target, F.col(target).cast("string")))
    else:
        rows = rows.withColumn("_y", F.col(target).cast("double"))
    return rows.select(*features, "_y")


def _forest(rows: DataFrame, features: Sequence[str], classes: bool, trees: int, seed: int):  # noqa: ANN202
    made = VectorAssembler(inputCols=list(features), outputCol="_f").transform(rows)
    kind = RandomForestClassifier if classes else RandomForestRegressor
    return kind(featuresCol="_f", labelCol="_y", numTrees=trees, maxDepth=8, seed=seed).fit(made)


def _quality(model, rows: DataFrame, features: Sequence[str], classes: bool) -> float:  # noqa: ANN001
    out = model.transform(VectorAssembler(inputCols=list(features), outputCol="_f").transform(rows))
    return out.agg(_right(classes)).first()[0] or 0.0


def _right(classes: bool) -> Column:
    """Share of right classes, or the negative mean squared error."""
    return F.avg((F.col("prediction") == F.col("_y")).cast("double")) if classes else -F.avg(F.pow(F.col("prediction") - F.col("_y"), 2))


def _step(n: int, seed: int) -> tuple[int, int]:
    """``(a, b)`` such that row i meets row ``(a i + b) mod n``: a and n have no common divisor, so it is a permutation."""
    rng = random.Random(seed)
    return next(x for x in iter(lambda: rng.randrange(max(1, n // 3), n + 1), None) if math.gcd(x, n) == 1), rng.randrange(n)


def permuted(placed: DataFrame, features: Sequence[str], n: int, seeds: Sequence[int]) -> DataFrame:
    """For each seed, rows with a ``_pos`` from 0 to n - 1 beside the features of another row (prefixed with ``_other_``).

    Each seed is one permutation of the rows (``_turn`` is its number); all of them are found by one join.
    """
    meets = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.pmod(F.col("_pos") * a + b, F.lit(n)).alias("at")) for i, (a, b) in enumerate(_step(n, s) for s in seeds)]))
    others = placed.select(F.col("_pos").alias("_at"), *[F.col(c).alias(f"_other_{c}") for c in features])
    turns = placed.select("*", meets.alias("_m")).select(*placed.columns, F.col("_m.turn").alias("_turn"), F.col("_m.at").alias("_at"))
    return turns.join(others, "_at").drop("_at")


def forest_scores(rows: DataFrame, features: Sequence[str], classes: bool, trees: int = 60, repeats: int = 10, seed: int = 1234) -> dict[str, tuple[float, str]]:
    """Impurity importance, and yes where permuting the column makes held-out predictions worse on average.

    Each repeat is one permutation of the held-out rows; every column in turn takes its values from the other row. All
    columns of all repeats are scored in one job.
    """
    held = F.pmod(F.xxhash64(F.lit(seed), *features, "_y"), F.lit(4)) == 0
    test = checkpointed(with_position(rows.filter(held), [F.xxhash64(F.lit(seed), *features, "_y")]))
    model = _forest(rows.filter(~held), features, classes, trees, seed)
    n, base = test.count(), _quality(model, test, features, classes)
    drops: dict[str, list[float]] = {c: [0.0] for c in features}
    if n > 1:
        mixed = permuted(test, features, n, [seed + r for r in range(repeats)])
        ways = F.explode(F.array(*[F.struct(F.lit(c).alias("way"), *[F.col(f"_other_{f}" if f == c else f).alias(f) for f in features]) for c in features]))
        made = mixed.select("_y", "_turn", ways.alias("_w")).select("_y", "_turn", "_w.*")
        out = model.transform(VectorAssembler(inputCols=list(features), outputCol="_f").transform(made))
        for c, _, quality in out.groupBy("way", "_turn").agg(_right(classes)).collect():
            drops[c].append(base - quality)
    return {c: (float(w), "yes" if np.mean(drops[c]) > 0 else "no") for c, w in zip(features, model.featureImportances.toArray(), strict=True)}


def boruta_scores(rows: DataFrame, features: Sequence[str], classes: bool, trees: int = 60, rounds: int = 8, seed: int = 1234) -> dict[str, tuple[float, str]]:
    """Columns that beat the best of the shadows (the columns of another row, by a permutation) in more rounds than chance explains.

    Rounds don't depend on each other: a few forests are grown at a time.
    """
    placed = checkpointed(with_position(rows, [F.xxhash64(F.lit(seed), *features, "_y")]))
    n, both = placed.count(), [*features, *[f"_other_{c}" for c in features]]

    def grown(r: int) -> list[bool]:
        weights = _forest(permuted(placed, features, n, [seed + r]), both, classes, trees, seed + r).featureImportances.toArray()
        best = weights[len(features) :].max(initial=0)
        return [bool(w > best) for w in weights[: len(features)]]

    hits = {c: sum(x) for c, x in zip(features, zip(*at_once(grown, range(rounds)), strict=True), strict=True)}
    return {c: (float(h) / rounds, "yes" if binomial_tail(h, rounds) < 0.05 else "maybe" if binomial_tail(rounds - h, rounds) >= 0.05 else "no") for c, h in hits.items()}


def elimination_scores(rows: DataFrame, features: Sequence[str], classes: bool, step: int = 1, folds: int = 5, seed: int = 1234) -> dict[str, tuple[float, str]]:
    """Again and again the column of the smallest standardised coefficient goes; the best set by cross-validation stays.

    The folds and the model of all rows are fitted side by side.
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), *features, "_y"), F.lit(folds))
    rows = checkpointed(rows.withColumn("_fold", fold))
    n_classes = rows.agg(F.count_distinct("_y")).first()[0]
    sds = rows.agg(*[F.stddev_samp(c).alias(c) for c in features]).first()

    def fit(data: DataFrame, cols: Sequence[str]):  # noqa: ANN202
        made = VectorAssembler(inputCols=list(cols), outputCol="_f").transform(data)
        return (LogisticRegression if classes else LinearRegression)(featuresCol="_f", labelCol="_y", maxIter=30, regParam=1e-3).fit(made)

    left, gone, scores = list(features), [], {}
    while left:
        cols = list(left)

        def one(k: int):  # noqa: ANN202
            """A fold's quality; the model of all rows comes last."""
            return fit(rows, cols) if k == folds else _quality(fit(rows.filter(F.col("_fold") != k), cols), rows.filter(F.col("_fold") == k), cols, classes)  # noqa: B023

        *parts, model = at_once(one, range(folds + 1))
        scores[tuple(left)] = float(np.mean(parts))
        weights = np.abs(model.coefficientMatrix.toArray()).sum(axis=0) if classes and n_classes >= 2 else np.abs(model.coefficients.toArray())
        order = sorted(range(len(left)), key=lambda i: weights[i] * (sds[left[i]] or 0.0))
        out = {left[i] for i in order[:step]}
        gone, left = [c for c in left if c in out] + gone, [c for c in left if c not in out]
    best = max(scores, key=lambda k: (round(scores[k], 9), -len(k)))
    return {c: (1.0 if c in best else 1.0 / (2 + gone[::-1].index(c)), "yes" if c in best else "no") for c in features}


def stepwise_selection(
    rows: DataFrame, features: Sequence[str], initial: Sequence[str] = (), threshold_in: float = 0.01, threshold_out: float = 0.05, iterations: int = 100,
) -> tuple[list[str], dict[str, float]]:
    """Forward and backward selection by p-values of least squares.

    One pass gives all covariances; every regression is then solved from them on the driver. A column is tried once.
    """
    n, _, cov = moments(rows, [*features, "_y"])
    y = len(features)

    def p_values(cols: Sequence[str]) -> dict[str, float]:
        at = [list(features).index(c) for c in cols]
        xx, xy = cov[np.ix_(at, at)], cov[at, y]
        inverse = np.linalg.pinv(xx)
        beta, free = inverse @ xy, n - len(at) - 1
        if free <= 0:
            return dict.fromkeys(cols, 1.0)
        s2 = max(cov[y, y] - beta @ xy, 0.0) * (n - 1) / free
        se = np.sqrt(np.maximum(np.diag(inverse) * s2 / (n - 1), 1e-300))
        return {c: t_p_value(float(b / s), free) for c, b, s in zip(cols, beta, se, strict=True)}

    chosen, tried, found = list(initial), set(initial), {}
    for _ in range(max(iterations, len(features))):
        changed = False
        gains = {c: p_values([*chosen, c])[c] for c in features if c not in tried}
        if gains:
            c = min(gains, key=gains.get)
            if gains[c] < threshold_in:
                chosen.append(c)
                tried.add(c)
                changed = True
        if chosen:
            found = p_values(chosen)
            worst = max(found, key=found.get)
            if found[worst] > threshold_out:
                chosen.remove(worst)
                changed = True
        if not changed:
            break
    return chosen, p_values(chosen) if chosen else {}


def importance_scores(
    df: DataFrame, features: Sequence[str], target: str, methods: Sequence[str] = METHODS, callback: Callable[[str], None] | None = None, seed: int = 1234, rounds: int = 8,
) -> dict[str, dict[str, tuple[float, str]]]:
    """Per method and column: a score and yes, maybe or no. Boruta needs 250 rows."""
    classes = task(df, target) in ("binary", "multi_class")
    rows = _prepared(df, features, target, classes)
    out = {}
    for m in methods:
        if m == "boruta" and rows.count() < 250:
            continue
        if m == "rf":
            out[m] = forest_scores(rows, features, classes, seed=seed)
        elif m == "boruta":
            out[m] = boruta_scores(rows, features, classes, rounds=rounds, seed=seed)
        elif m == "rfe":
            out[m] = elimination_scores(rows, features, classes, seed=seed)
        elif m == "stepwise":
            chosen, p = stepwise_selection(rows, features)
            out[m] = {c: (1 - p.get(c, 1.0), "yes" if c in chosen else "no") for c in features}
        if callback is not None:
            callback(m)
    return out


def explore_key_variables(
    df: DataFrame, sensitive_col: str, preprocessed: bool = False, methods: Sequence[str] = METHODS, components: int = 6,
    callback: Callable[[str], None] | None = None, seed: int = 1234, rounds: int = 8,
) -> dict[str, DataFrame]:
    """``evidence`` (a row per component) and ``ranking`` (a row per variable, the best of its components).

    Included: yes if all methods say so, maybe if one says yes or maybe, else no; sorted by that and the forest's score.
    A sensitive column of one value gives an empty result.
    """
    if task(df, sensitive_col) is not None and df.agg(F.count_distinct(sensitive_col)).first()[0] < 2:
        return {}
    table = df if preprocessed else embed(df, sensitive_col, size=components)
    features = [c for c in table.columns if c != sensitive_col and is_numeric(table, c)]
    scores = importance_scores(table, features, sensitive_col, methods, callback, seed, rounds)
    rows = []
    for c in features:
        votes = [s[c][1] for s in scores.values()]
        include = "yes" if votes and set(votes) == {"yes"} else "maybe" if {"yes", "maybe"} & set(votes) else "no"
        rows.append((c, re.sub(r"_\d+$", "", c) if c not in df.columns else c, include, *[round(s[c][0], 4) for s in scores.values()]))
    names = list(scores)
    evidence = df.sparkSession.createDataFrame(rows, "component string, variable string, include string" + "".join(f", {m} double" for m in names))
    order = F.when(F.col("include") == "yes", 0).when(F.col("include") == "maybe", 1).otherwise(2)
    best = evidence.withColumn("_o", order).groupBy("variable").agg(F.min("_o").alias("_o"), *[F.round(F.max(m), 4).alias(m) for m in names])
    best = best.withColumn("include", F.element_at(F.array(*map(F.lit, ("yes", "maybe", "no"))), F.col("_o") + 1))
    sort = [F.col("_o"), *([F.desc("rf")] if "rf" in names else [])]
    return {"evidence": evidence.orderBy(order, *sort[1:]), "ranking": best.orderBy(*sort).select("variable", "include", *names)}
