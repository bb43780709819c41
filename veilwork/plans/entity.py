"""Trained embeddings: a vector per category, fitted so that a multinomial model reads the sensitive value from it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.core import stored
from veilwork.errors import InputError
from veilwork.functions.keyed import normal

#: Cells of the table of sensitive values that driver and tasks hold, and of the part of the counts that a task works on.
MOST, PART = 1_000_000, 2_000_000


@dataclass(frozen=True)
class Embedding:
    """``vectors`` is ``(_v, e)``, a row per category; ``classes`` are in the order of the rows of ``weights``; the loss after each round is per row."""

    vectors: DataFrame
    classes: list[str]
    weights: np.ndarray
    losses: list[float]

    def shares(self) -> DataFrame:
        """``(_v, class, share)``: what the model says of each category."""
        classes, weights = self.classes, self.weights

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    p = _softmax(np.array(b["e"].tolist()), weights)
                    yield pd.DataFrame({"_v": np.repeat(b["_v"].to_numpy(), len(classes)), "class": classes * len(b), "share": p.ravel()})

        return self.vectors.mapInPandas(run, "_v string, class string, share double")


def _softmax(e: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = e @ w[:, :-1].T + w[:, -1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _parts(b: pd.DataFrame, k: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Stretches of categories: their counts beside each class, and their vectors."""
    step = max(1, PART // k)
    for at in range(0, len(b), step):
        part = b.iloc[at : at + step]
        n = np.zeros((len(part), k))
        for i, (classes, counts) in enumerate(zip(part["c"], part["n"], strict=True)):
            n[i, classes] = counts
        yield slice(at, at + step), n, np.array(part["e"].tolist())


def fit(df: DataFrame, col: str, sensitive_col: str, size: int = 6, rounds: int = 20, steps: int = 40, turns: int = 3, ridge: float = 1e-3, seed: int = 1234) -> Embedding:
    """Vectors of ``size`` numbers for the categories of ``col``, by rounds that never make the penalised loss larger.

    Rows count only through how often each category has each sensitive value, which one aggregate gives. A round moves
    all vectors, each by its own counts (``steps`` steps under a bound of the curvature), and writes them as a table in
    the shared folder; then, ``turns`` times, it adds up the gradient of the classes' weights over all categories and moves these. So the
    number of categories is bound by the tables alone; the driver and each task hold classes times size numbers, a
    million at most (more is an error). Vectors start from a hash of the category's text and weights from a seed. Null
    is the category None; rows without a sensitive value are left out; an empty table has no vectors.
    """
    y = F.col(sensitive_col).cast("string").alias("y")
    rows = df.select(F.coalesce(F.col(col).cast("string"), F.lit("None")).alias("_v"), y).filter("y is not null")
    counts = stored(rows.groupBy("_v", "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "counts")
    found = counts.groupBy("y").agg(F.sum("n").alias("n")).limit(MOST // (size + 1) + 1).collect()
    if len(found) * (size + 1) > MOST:
        raise InputError(f"{sensitive_col} has too many values")
    total = {r.y: r.n for r in found}
    classes, k = sorted(total), len(total)
    start = [0.1 * normal(F.col("_v"), f"e{i}", seed) for i in range(size)]
    if not k:
        return Embedding(counts.select("_v", F.array(*start).alias("e")), [], np.zeros((0, size + 1)), [])
    index = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], "y string, c int")
    table = counts.join(F.broadcast(index), "y").groupBy("_v").agg(F.collect_list(F.struct("c", "n")).alias("r"))
    table = table.select("_v", F.col("r.c").alias("c"), F.col("r.n").alias("n"), F.array(*start).alias("e"))
    schema = "_v string, c array<int>, n array<double>, e array<double>"
    whole = sum(total.values())
    w = np.random.default_rng(seed).normal(size=(k, size + 1))
    w[:, -1] = np.log([total[c] / whole for c in classes])

    def move(batches: Iterator[pd.DataFrame], w: np.ndarray) -> Iterator[pd.DataFrame]:
        values, axes = np.linalg.eigh(w[:, :-1].T @ w[:, :-1])
        for b in batches:
            moved = []
            for _, n, e in _parts(b, k):
                all_n = n.sum(axis=1, keepdims=True)
                for _ in range(steps):
                    way = (n - all_n * _softmax(e, w)) @ w[:, :-1] - ridge * e
                    e = e + way @ axes / (0.5 * all_n * values + ridge) @ axes.T
                moved += e.tolist()
            b["e"] = moved
            yield b

    def gradient(batches: Iterator[pd.DataFrame], w: np.ndarray) -> Iterator[pd.DataFrame]:
        way, square, loss = np.zeros_like(w), np.zeros((size + 1, size + 1)), 0.0
        for b in batches:
            for _, n, e in _parts(b, k):
                p, all_n, one = _softmax(e, w), n.sum(axis=1, keepdims=True), np.column_stack([e, np.ones(len(e))])
                way += (n - all_n * p).T @ one
                square += (all_n * one).T @ one
                loss -= (n * np.log(np.maximum(p, 1e-300))).sum()
        flat = np.concatenate([way.ravel(), square.ravel(), [loss]])
        yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

    losses = []
    for _ in range(rounds):
        table = stored(table.mapInPandas(lambda b, w=w: move(b, w), schema), "vectors")
        for _ in range(turns):
            sums = table.mapInPandas(lambda b, w=w: gradient(b, w), "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
            flat = np.zeros(w.size + (size + 1) ** 2 + 1)
            for i, x in sums.collect():
                flat[i] = x
            last, loss = w, float(flat[-1] / whole)
            w = w + (flat[: w.size].reshape(w.shape) - ridge * w) @ np.linalg.inv(0.5 * flat[w.size : -1].reshape(size + 1, size + 1) + ridge * np.eye(size + 1))
        losses.append(loss)
    return Embedding(table.select("_v", "e"), classes, last, losses)
