"""Operator 11, hard negatives: histograms of integer scores find each window's k-th row digit by digit, then it is gathered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from veilwork.errors import InputError
from veilwork.llm.common import written

#: Bits of a digit; rows and windows of a block; scores that a task holds at once; rows gathered beyond the k wanted.
DIGIT, ROWS, WINDOWS, CELLS, SPARE = 8, 16_384, 1024, 1 << 20, 64
#: Scores below this are exact in double precision, those below 2^24 in single precision.
EXACT = float(1 << 53)
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Vectors:
    """``rows``: rid, vec_id, label, dim, q (whole numbers); ``blocks``: the same, many rows to one, by ``cell``."""

    rows: DataFrame
    blocks: DataFrame
    groups: int
    bound: int
    first_id: int
    id_bits: int
    rid_bits: int


def quantised(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> Vectors:
    """Vectors in whole numbers ``floor(scale * x)``, and in blocks.

    Rows without id or label, and vectors that are null or hold a null or non-finite component, take no part. Repeated
    rows are rows of their own. A block holds rows of one number of components. Scores must stay below 2^53 and ids less
    than 2^63 apart, else an error is raised.
    """
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    label = F.col(label_col).cast("bigint") if isinstance(rows.schema[label_col].dataType, IntegralType) else F.xxhash64(label_col)
    there = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).filter(~odd)
    q = F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)))
    square = F.aggregate(q, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    made = there.select(F.col(id_col).cast("bigint").alias("vec_id"), label.alias("label"), F.size(x).alias("dim"), F.when(square < EXACT, q.cast("array<int>")).alias("q"), square.alias("square"))
    made = written(made.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n, low, high, last, bound = made.agg(F.count(F.lit(1)), F.min("vec_id"), F.max("vec_id"), F.max("rid"), F.max("square")).first()
    if (bound or 0.0) >= EXACT:
        raise InputError("scores would pass 2^53: take a smaller scale")
    if n and high - low > LAST:
        raise InputError("ids lie 2^63 or more apart")
    spread = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // ROWS), min(spread, -(-n // 512)))
    cell = F.concat_ws(":", "dim", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    blocks = made.groupBy(cell.alias("cell"), "dim").agg(F.collect_list(F.struct("rid", "vec_id", "label", "q")).alias("r"))
    blocks = written(blocks.select("cell", "dim", "r.rid", "r.vec_id", "r.label", F.flatten("r.q").alias("q")), "blocks")
    low, high = low or 0, high or 0
    return Vectors(made.drop("square"), blocks, groups, int(bound or 0), low, (high - low).bit_length(), (last or 0).bit_length())


# --- one pass over all rows -------------------------------------------------------------------------------------------


def _pairs(space: Vectors, windows: DataFrame) -> DataFrame:
    """Every block of rows beside every block of windows: rows move once, windows once for each block of rows."""
    state = [c for c in windows.columns if c not in ("a", "dim", "label", "q", "h")]
    one = windows.groupBy("dim", "h").agg(F.collect_list(F.struct("a", "label", "q", *state)).alias("w"))
    one = one.select("dim", *[F.col(f"w.{c}").alias(f"w_{c}") for c in ("a", "label", *state)], F.flatten("w.q").alias("w_q"))
    one = one.withColumn("cell", F.explode(F.expr(f"transform(sequence(0, {space.groups - 1}), i -> concat_ws(':', dim, i))")))
    one = one.drop("dim").repartition(space.groups, "cell")
    return space.blocks.repartition(space.groups, "cell").hint("merge").join(one, "cell").drop("cell")


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """The rows and the windows of each pair of blocks as arrays, windows of one phase together."""
    for i in range(len(batch)):
        rows, windows = {}, {}
        for name in batch.schema.names:
            column = batch.column(name)
            if name == "dim":
                dim = column[i].as_py()
                continue
            side, key = (windows, name[2:]) if name.startswith("w_") else (rows, name)
            side[key] = column[i].values.to_numpy(zero_copy_only=False)
        rows["q"], windows["q"] = rows["q"].reshape(len(rows["rid"]), dim), windows["q"].reshape(len(windows["a"]), dim)
        order = np.lexsort((windows["a"], windows["phase"]))
        yield rows, {k: v[order] for k, v in windows.items()}


def _chunks(rows: dict, windows: dict, kind: type) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Windows of one phase, few at a time: their scores against all rows of the block, and which rows are theirs."""
    r = rows["q"].astype(kind)
    step = max(1, CELLS // max(1, len(r)))
    cuts = np.flatnonzero(np.diff(windows["phase"])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(windows["a"])], strict=True):
        for at in range(lo, hi, step):
            w = {k: v[at : min(at + step, hi)] for k, v in windows.items()}
            _, first, back = np.unique(w["a"], return_index=True, return_inverse=True)
            scores = (w["q"][first].astype(kind) @ r.T).astype(np.int64)[back]
            ok = (rows["label"] == w["label"][:, None]) == w["same"][:, None]
            ok &= (scores >= w["low"][:, None]) & (scores <= w["high"][:, None]) & (rows["rid"] != w["a"][:, None])
            yield w, scores, ok


def histograms(space: Vectors, windows: DataFrame) -> DataFrame:
    """``(a, w, need, digit, n)``: of each window's interval, the rows at each value of its next digit."""
    kind = np.float32 if space.bound < 1 << 24 else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, windows in _arrays(batch):
                out = []
                for w, scores, ok in _chunks(rows, windows, kind):
                    phase = w["phase"][0]
                    base = w["base"][:, None]
                    if phase == 0:
                        v = base - scores
                    else:
                        ok &= scores == w["score"][:, None]
                        v = rows["vec_id"] - base
                        if phase == 2:
                            ok &= rows["vec_id"] == w["id"][:, None]
                            v = rows["rid"] - base
                    v, bits = v.astype(np.uint64), w["bits"].astype(np.uint64)[:, None]
                    whole = np.where(bits >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(bits, 63)) - np.uint64(1))
                    ok &= v <= whole
                    digit = v >> np.where(bits > DIGIT, bits - np.uint64(DIGIT), np.uint64(0))
                    i, j = np.nonzero(ok)
                    counts = np.bincount((i << DIGIT) + digit[i, j].astype(np.int64), minlength=len(w["a"]) << DIGIT)
                    at = np.flatnonzero(counts)
                    n = at >> DIGIT
                    out.append((w["a"][n], w["w"][n], w["need"][n], at & ((1 << DIGIT) - 1), counts[at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "w", "need", "digit", "n"])

    counts = _pairs(space, windows).mapInArrow(run, "a bigint, w bigint, need bigint, digit bigint, n bigint")
    return counts.groupBy("a", "w", "need", "digit").agg(F.sum("n").alias("n"))


def gathered(space: Vectors, windows: DataFrame) -> DataFrame:
    """``(a, w, rid, vec_id, score)``: each window's rows up to its bound (score, id, rid)."""
    kind = np.float32 if space.bound < 1 << 24 else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, windows in _arrays(batch):
                for w, scores, ok in _chunks(rows, windows, kind):
                    t, ident, rid = (w[k][:, None] for k in ("score", "id", "base"))
                    tied = (rows["vec_id"] < ident) | (rows["vec_id"] == ident) & (rows["rid"] <= rid)
                    i, j = np.nonzero(ok & ((scores > t) | (scores == t) & tied))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w["a"][i], w["w"][i], rows["rid"][j], rows["vec_id"][j], scores[i, j])], ["a", "w", "rid", "vec_id", "score"])

    return _pairs(space, windows).mapInArrow(run, "a bigint, w bigint, rid bigint, vec_id bigint, score bigint")


# --- selection --------------------------------------------------------------------------------------------------------


def _next(state: DataFrame, counts: DataFrame, space: Vectors) -> DataFrame:
    """Each window's interval after a histogram: the digit where the k-th row lies, or the bound if few rows are left."""
    upto = F.sum("n").over(W.partitionBy("a", "w").orderBy("digit"))
    hit = F.when(F.col("upto") >= F.col("need"), F.struct("digit", "upto", "n"))
    found = counts.withColumn("upto", upto).groupBy("a", "w").agg(F.min(hit).alias("hit"))
    s = state.join(found, ["a", "w"], "left")
    shift = F.greatest(F.col("bits") - DIGIT, F.lit(0))
    digit, step = F.col("hit.digit"), F.expr(f"shiftleft(1L, greatest(bits - {DIGIT}, 0))")
    all_of_it, few = F.col("hit").isNull(), F.col("hit.upto") <= F.col("need") + SPARE
    start = F.col("base") + F.when(F.col("phase") == 0, -1).otherwise(1) * digit * step  # of the digit's interval
    end = F.when(F.col("phase") == 0, start - step + 1).otherwise(start + step - 1)
    done = all_of_it | few | (F.col("phase") == 2) & (shift == 0)
    phase, last = F.col("phase"), F.lit(LAST)
    fixed = shift == 0  # the digit is one value: the next part of the key follows
    new = {
        "done": done,
        "need": F.when(done, F.col("need")).otherwise(F.col("need") - (F.col("hit.upto") - F.col("hit.n"))),
        # the bound of a window that is done, else what its rows in question have in common
        "score": F.when(phase == 0, F.when(all_of_it, F.col("low")).when(done, end).otherwise(start)).otherwise(F.col("score")),
        "id": F.when(phase == 0, last).when(phase == 1, F.when(all_of_it, last).when(done, end).otherwise(start)).otherwise(F.col("id")),
        "base": F.when(done, F.when((phase < 2) | all_of_it, last).otherwise(end)).when(~fixed, start).when(phase == 0, F.lit(space.first_id)).otherwise(F.lit(0)),
        "bits": F.when(~fixed, shift).when(phase == 0, F.lit(space.id_bits)).otherwise(F.lit(space.rid_bits)),
        "phase": F.when(~done & fixed, phase + 1).otherwise(phase),
    }
    return s.select("a", "w", "same", "low", "high", *[e.cast(dict(state.dtypes)[c]).alias(c) for c, e in new.items()])


def select_top(space: Vectors, windows: DataFrame, k: int) -> DataFrame:
    """``(a, w, rank, rid, vec_id, score)``: of each window ``(a, w, same, low, high)`` the first ``k`` rows.

    A window holds the rows of the same or of another label than its anchor (the row with rid ``a``, left out itself)
    whose score lies from low to high; higher scores come first, ties by smaller vec_id, then rid. Radix selection over
    that order: a pass counts, for every window, its rows by the next digit (8 bits) of the score; the digit in which the
    k-th row lies is opened in the next pass, and where a score's rows are many, the digits of the id follow. So a
    score that a third of all rows share costs a few more passes and no more memory. A window is done when at most
    ``SPARE`` rows more than k lie up to its digit's end; then only these are gathered. Windows that are done leave the
    passes; state is a row per window, written between passes.
    """
    wide = windows.filter("low <= high").select(
        "a", "w", "same", "low", "high", F.lit(False).alias("done"), F.lit(k).cast("bigint").alias("need"), F.lit(0).cast("bigint").alias("score"),
        F.lit(LAST).alias("id"), F.col("high").alias("base"), F.length(F.bin(F.col("high") - F.col("low"))).alias("bits"), F.lit(0).alias("phase"),
    )
    state, ready = written(wide, "windows"), []
    total = n = state.count()

    def with_anchors(windows: DataFrame, count: int) -> DataFrame:
        block = F.pmod(F.xxhash64("a"), F.lit(-(-count // WINDOWS)))
        return windows.drop("done").join(space.rows.select(F.col("rid").alias("a"), "label", "dim", "q"), "a").withColumn("h", block)

    while n:
        after = written(_next(state, histograms(space, with_anchors(state, n)), space), "windows")
        ready.append(after.filter("done"))
        state = after.filter("not done")
        n = state.count()
    if not ready:
        return space.rows.sparkSession.createDataFrame([], "a bigint, w bigint, rank int, rid bigint, vec_id bigint, score bigint")
    bounds = ready[0]
    for part in ready[1:]:
        bounds = bounds.unionByName(part)
    found = gathered(space, with_anchors(bounds.withColumn("phase", F.lit(0)), total))
    rank = F.row_number().over(W.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id", "rid"))
    return written(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("a", "w", "rank", "rid", "vec_id", "score"), "selected")


def _percent(score: str, share: int, up: bool) -> Column:
    """``share`` percent of a whole score, rounded down or up to a whole number."""
    x = f"({score} * {share}L + {99 if up else 0})"
    return F.expr(f"({x} - pmod({x}, 100L)) div 100L")


def hard_negatives(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; each has as positives its best ``positives`` other rows of its
    label. For each, the best ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the
    positive's, by integer inner products (see ``select_top``). Anchors meet all rows in blocks, in as many passes as
    the score has digits.

    Rows without id or label, and null vectors or ones with null or non-finite components, take no part; vectors of
    other lengths than the anchor's have no product with it. Repeated rows are rows of their own (also as anchors), ties
    go by smaller id. Positives without a negative in their window give no row; an empty table gives no rows.
    """
    space = quantised(rows, scale, id_col, label_col, vector_col)
    anchors = space.rows.filter(F.col("vec_id") % every == 0)
    all_scores = anchors.select(F.col("rid").alias("a"), F.lit(0).cast("bigint").alias("w"), F.lit(True).alias("same"), F.lit(-space.bound).cast("bigint").alias("low"), F.lit(space.bound).cast("bigint").alias("high"))
    best = select_top(space, all_scores, positives).select("a", F.col("rid").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    spans = best.select("a", "w", F.lit(False).alias("same"), _percent("positive_score", low, True).alias("low"), _percent("positive_score", high, False).alias("high"))
    hard = select_top(space, spans, negatives).select("a", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("rid").alias("a"), F.col("vec_id").alias("anchor_id"))
    out = hard.join(best, ["a", "w"]).join(names, "a")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
