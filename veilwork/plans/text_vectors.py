"""Reduced vectors of texts: the leading directions of their word counts, found in passes that move no row."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import stored
from veilwork.errors import InputError

METHODS = ("pca", "incremental", "truncated", "fast")
#: Numbers that the driver and a task hold for the directions: hashed columns times directions.
MOST = 1 << 23


def word_columns(text: Column, width: int) -> Column:
    """The hashed column, below ``width``, of every word of a text, repeats included. Null has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))


def _of_rows(lists: pa.Array, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows times directions, and the row and column of every word."""
    column = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return np.stack([np.bincount(row, d[column], len(lists)) for d in directions.T], axis=1), row, column


def _product(rows: DataFrame, directions: np.ndarray, n: int, centred: bool) -> np.ndarray:
    """The transposed counts times the counts times ``directions``: each task adds up its rows, tasks are summed by column.

    What a task emits and what the driver gets is a row per column that has a word: ``width`` at most.
    """
    width, size = directions.shape
    held = rows.sparkSession.sparkContext.broadcast(directions)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = held.value, np.zeros((width, size + 1))
        for b in batches:
            y, row, column = _of_rows(b.column(0), q)
            for k in range(size):
                total[:, k] += np.bincount(column, y[row, k], width)
            total[:, size] += np.bincount(column, minlength=width)
        used = np.flatnonzero(total[:, size])
        for at in np.array_split(used, max(1, len(used) // 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, k]) for k in range(size + 1)]], ["c", *[f"v{k}" for k in range(size + 1)]])

    names = [f"v{k}" for k in range(size + 1)]
    made = rows.mapInArrow(sums, "c bigint, " + ", ".join(f"{v} double" for v in names)).groupBy("c").agg(*[F.sum(v).alias(v) for v in names])
    got = made.toPandas()
    out, counts = np.zeros((width, size)), np.zeros(width)
    out[got["c"]], counts[got["c"]] = got[names[:-1]].to_numpy(), got[names[-1]].to_numpy()
    held.unpersist()
    return out - np.outer(counts, counts @ directions) / n if centred else out


@dataclass(frozen=True)
class TextVectors:
    """Fitted directions (``width`` x size), what is subtracted from every row's scores, and the singular values."""

    directions: np.ndarray
    shift: np.ndarray
    values: np.ndarray

    def column(self, text: Column) -> Column:
        """The vector of a text: an array of numbers."""
        directions, shift = self.directions, self.shift

        @F.pandas_udf("array<double>")
        def vectors(words: pd.Series) -> pd.Series:
            lists = pa.array([np.asarray(w, dtype=np.int32) for w in words], pa.list_(pa.int32()))
            return pd.Series(list(_of_rows(lists, directions)[0] - shift))

        return vectors(word_columns(text, len(directions)))


def _independent(z: DataFrame, size: int, seed: int, steps: int, near: float) -> np.ndarray:
    """The rotation of the white columns ``z0, z1, ..`` into independent ones, all at once; each step is one aggregate."""
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
    for _ in range(steps):
        g = [F.tanh(sum((F.col(f"z{j}") * float(w[i, j]) for j in range(size)), F.lit(0.0))) for i in range(size)]
        asks = [F.avg(g[i] * F.col(f"z{j}")) for i in range(size) for j in range(size)] + [F.avg(1 - x * x) for x in g]
        got = np.array(z.agg(*asks).first(), float)
        new = got[: size * size].reshape(size, size) - got[size * size :, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done, w = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < near, new
        if done:
            return w
    warnings.warn(f"independent components still moved after {steps} steps", stacklevel=2)
    return w


def fit(
    df: DataFrame, text_col: str, size: int = 6, method: str = "pca", width: int = 1 << 18, over: int = 10, seed: int = 1234, passes: int = 30, near: float = 1e-4,
) -> TextVectors:
    """Directions of the texts' word counts in ``width`` hashed columns.

    ``pca`` (and ``incremental``: its sums are added up batch by batch either way) of the counts less their mean,
    ``truncated`` of the counts as they are, ``fast``: the components of pca turned into independent ones of variance 1.
    A random subspace of ``size + over`` directions is multiplied by the counts and made orthonormal again until the
    leading singular values move by less than ``near`` of the largest; after ``passes`` passes a warning says that they do.
    Each pass reads the hashed words, written once, and moves sums per column; no row or text. The driver and each task
    hold ``width`` times ``size + over`` numbers, at most ``MOST``. Null and empty texts have no words; texts of fewer
    directions than ``size`` get zeros in the rest, so does an empty table. Signs: a direction's largest part is above 0.
    """
    if method not in METHODS:
        raise InputError(f"unknown reduction {method}; known: {', '.join(METHODS)}")
    if size < 1 or width < 1 or over < 0 or width * (size + over) > MOST:
        raise InputError(f"one direction or more, and {MOST} numbers at most, are needed")
    rows = stored(df.select(word_columns(F.col(text_col), width).alias("w")), "words")
    n, held = rows.count(), min(width, size + over)
    q, last = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, held)))[0], None
    directions, values = np.zeros((width, size)), np.zeros(size)
    k = min(size, held)
    for _ in range(passes if n else 0):
        z = _product(rows, q, n, method != "truncated")
        squares, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values[:k] = np.sqrt(np.maximum(squares[::-1][:k], 0))
        directions[:, :k] = q @ turn[:, ::-1][:, :k]
        if last is not None and np.abs(values - last).max() <= near * max(values[0], 1e-300):
            break
        last, q = values.copy(), np.linalg.qr(z)[0]
    else:
        if n:
            warnings.warn(f"singular values still moved after {passes} passes", stacklevel=2)
    directions[:, values <= 1e-6 * max(values[0], 1e-300)] = 0.0
    directions *= np.where(directions[np.abs(directions).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
    if method == "truncated" or not n:
        return TextVectors(directions, np.zeros(size), values)
    counts = np.zeros(width)
    found = rows.select(F.explode("w").alias("c")).groupBy("c").count().toPandas()  # a row per hashed column
    counts[found["c"]] = found["count"]
    out = TextVectors(directions, counts @ directions / n, values)
    if method != "fast":
        return out
    kept = int((values > 1e-6 * max(values[0], 1e-300)).sum())
    white = out.directions[:, :kept] * np.sqrt(n) / values[:kept]
    vectors = TextVectors(white, out.shift[:kept] * np.sqrt(n) / values[:kept], values).column(F.col(text_col))
    z = stored(df.select(vectors.alias("v")).select(*[F.col("v")[i].alias(f"z{i}") for i in range(kept)]), "scores") if kept else None
    turned = white @ _independent(z, kept, seed, 10 * passes, near).T if kept else white
    directions = np.zeros((width, size))
    directions[:, :kept] = turned * np.where(turned[np.abs(turned).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    return TextVectors(directions, counts @ directions / n, values)
