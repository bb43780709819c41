"""Groups of near rows at any size: cells along a curve through principal scores, and exchanges over the cells' borders."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import number, stored, with_position, with_running

#: Principal scores that make the curve, bits of each on it, and bins in which a score's rows are counted.
AXES, BITS, BINS = 4, 12, 1024


def greedy_groups(z: np.ndarray, aggr: int) -> np.ndarray:
    """A group per row: again and again the row farthest from the middle of those left, with its nearest; the last group has up to 2 aggr - 1."""
    left, out, g = np.arange(len(z)), np.zeros(len(z), int), 0
    while len(left) >= 2 * aggr:
        rest = z[left]
        start = np.argmax(((rest - rest.mean(axis=0)) ** 2).sum(axis=1))
        near = np.argsort(((rest - rest[start]) ** 2).sum(axis=1), kind="stable")[:aggr]
        out[left[near]] = g
        left, g = np.delete(left, near), g + 1
    out[left] = g
    return out


def group_loss(z: np.ndarray, groups: np.ndarray) -> float:
    """Squared distances of rows from the middle of their group, summed."""
    size = np.bincount(groups)
    inside = np.maximum(size, 1)
    return float(sum(((z[:, k] - (np.bincount(groups, z[:, k]) / inside)[groups]) ** 2).sum() for k in range(z.shape[1])))


def _curve(codes: Sequence[Column], bits: int) -> Column:
    """Place on a curve that halves one score after the other: the codes' bits in turn."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(codes):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)).cast("long"), b * len(codes) + i))
    return out


def _codes(rows: DataFrame, scores: Sequence[Column]) -> tuple[list[Column], int]:
    """For each score the share of rows below its bin, in 2^BITS steps, as columns; and the number of rows.

    Bins are even in the inverse hyperbolic sine, so far values don't widen those of the middle. One aggregate; the
    driver gets a count per bin that has rows. Counts are whole numbers, so codes don't hang on partitions.
    """
    at = [F.least(F.greatest(F.floor((F.asinh(8 * s) + 12) * (BINS / 24)), F.lit(0)), F.lit(BINS - 1)).cast("int") for s in scores]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), a.alias("bin")) for i, a in enumerate(at)]))
    counts = np.zeros((len(scores), BINS), dtype=object)
    for axis, place, n in rows.select(cells.alias("x")).groupBy("x.axis", "x.bin").count().collect():
        counts[axis, place] = n
    n = int(counts[0].sum())
    below = [np.array([2**BITS * (c - k) // max(n, 1) for c, k in zip(row.cumsum(), row, strict=True)], dtype=np.int32) for row in counts]
    return [F.element_at(F.lit(b), a + 1) for b, a in zip(below, at, strict=True)], n


def near_groups(
    rows: DataFrame, names: Sequence[str], mean: np.ndarray, cov: np.ndarray, aggr: int, cell: int = 2000, exchanges: int = 2,
) -> DataFrame:
    """``(_rid, <names>)`` of rows ``(_rid, <names>)`` without nulls: each value the mean of its group of near rows.

    Rows lie along a curve through up to four principal scores, in cells of ``cell`` to twice as many rows that are
    grouped greedily. An exchange lays whole groups in another order and groups the rows of each new cell again; that is
    kept where it brings rows nearer to their groups, so the loss never grows. Orders are in turn by the power of two of
    the group's loss, so that the far rows of all cells meet, and along a curve whose borders lie a third of a cell aside. A
    table of less than two cells is one cell, grouped as a whole. Groups have aggr to 2 aggr - 1 rows. Ties go by ``_rid``.
    Fewer rows than aggr are one group; no rows give none.
    """
    sd = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    keep = [k for k in np.argsort(-values)[:AXES] if values[k] > 1e-9 * values.max()]
    signs = [1 if vectors[np.argmax(np.abs(vectors[:, k])), k] > 0 else -1 for k in keep]
    scores = [sum(((number(c) - float(m)) * float(s * v / d / np.sqrt(values[k])) for c, m, d, v in zip(names, mean, sd, vectors[:, k], strict=True)), F.lit(0.0)) for k, s in zip(keep, signs, strict=True)]
    codes, n = _codes(rows, scores)
    cell = max(cell, 8 * aggr)
    blocks = max(1, n // cell)
    kind = dict(rows.dtypes)["_rid"]
    share = blocks / max(n, 1)
    block = lambda before: F.least(F.floor(before * share), F.lit(blocks - 1)).cast("long")
    schema = f"_rid {kind}, _block long, _g int, " + ", ".join(f"`{c}` double" for c in names)

    def group(part: pd.DataFrame, to: str) -> pd.DataFrame:
        part = part.sort_values("_rid", kind="stable")
        z = (part[names].to_numpy(float) - mean) / sd
        new = greedy_groups(z, aggr)
        if "_g" in part:
            old = part.groupby(["_block", "_g"]).ngroup().to_numpy()
            new = new if group_loss(z, new) < group_loss(z, old) else old
        return pd.DataFrame({"_rid": part["_rid"], "_block": part[to], "_g": new.astype("int32"), **{c: part[c] for c in names}})

    if blocks == 1:
        found = rows.withColumn("_to", F.lit(0).cast("long"))
    else:
        coded = rows.withColumns({f"_c{i}": c for i, c in enumerate(codes)}).withColumn("_at", _curve([F.col(f"_c{i}") for i in range(len(codes))], BITS))
        laid = with_position(coded.drop(*[f"_c{i}" for i in range(len(codes))]), [F.col("_at"), F.col("_rid")])
        found = laid.withColumn("_to", block(F.col("_pos"))).drop("_at", "_pos")
    found = found.groupBy("_to").applyInPandas(lambda part: group(part, "_to"), schema)
    for k in range(exchanges if blocks > 1 else 0):
        found = stored(found, "groups")
        middles = [F.floor(F.avg(c) + (2**BITS // 3) * (1 + k // 2 % 2)).alias(f"_c{i}") for i, c in enumerate(codes)]
        lost = sum((F.var_pop(number(c) / float(d)) for c, d in zip(names, sd, strict=True)), F.lit(0.0)) * F.count(F.lit(1))
        groups = found.groupBy("_block", "_g").agg(F.count(F.lit(1)).alias("_n"), lost.alias("_lost"), *middles)
        groups = groups.withColumn("_at", _curve([F.col(f"_c{i}") for i in range(len(codes))], BITS + 1))
        groups = groups.withColumn("_level", -F.floor(F.log2(F.col("_lost") + 1e-12)) if k % 2 == 0 else F.lit(0))
        laid = with_running(groups, [F.col("_level"), F.col("_at"), F.col("_block"), F.col("_g")], {"_before": F.col("_n")})
        moved = stored(laid.select("_block", "_g", block(F.col("_before")).alias("_to")), "moves")
        found = found.join(moved, ["_block", "_g"]).groupBy("_to").applyInPandas(lambda part: group(part, "_to"), schema)
    if exchanges and blocks > 1:
        found = stored(found, "groups")
    means = found.groupBy("_block", "_g").agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)])
    return found.select("_rid", "_block", "_g").join(means, ["_block", "_g"]).select("_rid", *[F.col(f"_m{i}").alias(c) for i, c in enumerate(names)])
