"""Disclosure risk over equivalence classes: k-anonymity, l-diversity, t-closeness, beta-likeness, individual risk."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import checkpointed, chosen, with_groups, with_running
from veilwork.errors import InputError, NotInRangeError


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all there; classes are never made of nulls."""
    return df.dropna(subset=list(keys)) if keys else df


def _value(metric: DataFrame) -> float | None:
    return metric.first()[0]


def k_anonymity_rows(df: DataFrame, keys: Sequence[str] | str | None = None, k: int = 5) -> DataFrame:
    """Rows with ``k_count`` (size of their class) and ``is_k_anon`` (larger than k); rows with a null key go."""
    keys = chosen(df, keys)
    return with_groups(_keyed(df, keys), keys, {"k_count": F.count(F.lit(1))}).withColumn("is_k_anon", F.col("k_count") > k)


def k_anonymity_table(df: DataFrame, keys: Sequence[str] | str | None = None, k: int = 5, sensitive_col: str | None = None, label: str | None = None) -> DataFrame:
    """One row: ``share`` of rows in classes of k rows or fewer, of those whose sensitive value holds the pattern ``label``.

    Classes are counted with partial sums, so a class of a third of all rows moves as one row per task.
    """
    keys = chosen(df, keys)
    rows = df if sensitive_col is None or not label else df.filter(F.rlike(F.col(sensitive_col).cast("string"), F.lit(label)))
    classes = _keyed(rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return classes.agg((F.sum(F.when(F.col("n") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def k_anonymity(df: DataFrame, keys: Sequence[str] | str | None = None, k: int = 5, sensitive_col: str | None = None, label: str | None = None) -> float:
    found = _value(k_anonymity_table(df, keys, k, sensitive_col, label))
    if found is None:
        raise ZeroDivisionError("no rows are left")
    return found


def is_k_anonymous(df: DataFrame, keys: Sequence[str] | str | None = None, k: int = 5) -> bool:
    keys = chosen(df, keys)
    return bool(_value(_keyed(df, keys).groupBy(*keys).count().agg(F.bool_and(F.col("count") > k))))


def diversity_classes(df: DataFrame, sensitive_col: str, method: str = "distinct", quasi: Sequence[str] | str | None = None) -> DataFrame:
    """Per class: its key columns, ``rows`` (with a sensitive value) and ``diversity`` (distinct values, nulls one; or entropy)."""
    if method not in ("distinct", "entropy"):
        raise ValueError(f"unknown method {method}")
    keys = chosen(df, [c for c in df.columns if c != sensitive_col] if quasi is None else quasi)
    rows = _keyed(df, keys).groupBy(*keys, F.col(sensitive_col).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    if method == "distinct":
        return rows.groupBy(*keys).agg(F.sum(F.when(F.col("_s").isNotNull(), F.col("_c")).otherwise(0)).alias("rows"), F.count(F.lit(1)).cast("double").alias("diversity"))
    rows = rows.filter("_s is not null")
    total, logs = F.sum("_c"), F.sum(F.col("_c") * F.log("_c"))
    return rows.groupBy(*keys).agg(total.alias("rows"), F.greatest(F.log(total) - logs / total, F.lit(0.0)).alias("diversity"))


def l_diversity(df: DataFrame, sensitive_col: str, L: float = 2, method: str = "distinct", quasi: Sequence[str] | None = None) -> float:
    """Share of rows (those with a sensitive value) in classes of a diversity of L or less; entropy too is compared with L."""
    classes = diversity_classes(df, sensitive_col, method, quasi)
    return _value(classes.agg(F.sum(F.when(F.col("diversity") <= L, F.col("rows")).otherwise(0)) / F.sum("rows")))


def is_l_diverse(df: DataFrame, sensitive_col: str, L: float = 2, method: str = "distinct", quasi: Sequence[str] | None = None) -> bool:
    """Whether every class has L distinct values or more, or an entropy of ln L or more."""
    least = _value(diversity_classes(df, sensitive_col, method, quasi).agg(F.min("diversity")))
    return least is not None and least >= (L if method == "distinct" else math.log(L)) - 1e-12


def _ordered_distances(counts: DataFrame, marginal: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The classes' ordered distances for a domain of any size: prefix sums in global orders and joins by value.

    Let Q(j) be the table's share up to the j-th value, S(x) the sum of Q below x, and f(p, x) the sum of ``|p - Q(j)|``
    over j below x. A class whose share is p before and r after its value at x has ``f(p, x) - f(r, x)`` there; the sum
    of these and f(1, m) is its distance. f needs the number of values with Q below p, and their S: running sums over
    the values and the shares in one order.
    """
    laid = with_running(marginal, [F.col("_s")], {"_n": F.col("_g"), "_j": F.lit(1).cast("long")}).drop("_j_all")
    laid = laid.withColumn("_q", (F.col("_n") + F.col("_g")) / F.col("_n_all"))
    laid = checkpointed(with_running(laid, [F.col("_s")], {"_sum": F.col("_q")}).select("_s", "_j", "_q", "_sum", "_sum_all"))
    m, s_all = laid.agg(F.count(F.lit(1)), F.max("_sum_all")).first()
    # a class's rows lie together in one order, so its running counts are the order's less those at its first row
    rows = checkpointed(with_running(counts, [F.col(k) for k in keys] + [F.col("_s")], {"_before": F.col("_c")}).drop("_before_all"))
    first = rows.groupBy(*keys).agg(F.min("_before").alias("_first"))
    rows = rows.join(first, list(keys)).join(sizes, list(keys)).withColumn("_before", F.col("_before") - F.col("_first"))
    rows = checkpointed(rows.select(*keys, "_s", "rows", (F.col("_before") / F.col("rows")).alias("_p"), ((F.col("_before") + F.col("_c")) / F.col("rows")).alias("_r")))
    shares = rows.select(F.col("_p").alias("_q")).union(rows.select("_r")).distinct()
    both = laid.select("_q", F.lit(1).alias("_kind")).unionByName(shares.withColumn("_kind", F.lit(0)))
    value = F.col("_kind") == 1
    cuts = with_running(both, [F.col("_q"), F.col("_kind")], {"_cut": F.when(value, 1).otherwise(0).cast("long"), "_below": F.when(value, F.col("_q")).otherwise(0.0)})
    cuts = checkpointed(cuts.filter("_kind = 0").select("_q", "_cut", "_below"))

    def f(share: str, side: str) -> Column:
        p, cut, below, x, s = F.col(share), F.col(f"{side}._cut"), F.col(f"{side}._below"), F.col("_j"), F.col("_sum")
        return F.when(x <= cut, p * x - s).otherwise(p * cut - below + (s - below) - p * (x - cut))

    at = rows.join(laid.select("_s", "_j", "_sum"), "_s")
    at = at.join(cuts.alias("a"), F.col("_p") == F.col("a._q")).join(cuts.alias("b"), F.col("_r") == F.col("b._q"))
    total = F.sum(f("_p", "a") - f("_r", "b")) + (m - 1 - (s_all or 0.0) + 1)
    emd = F.greatest(total, F.lit(0.0)) / (m - 1) if m > 1 else F.lit(0.0)
    return at.groupBy(*keys, "rows").agg(emd.alias("emd"))


def closeness_classes(
    df: DataFrame, sensitive_col: str, datatype: str = "numeric", quasi: Sequence[str] | str | None = None, most: int = 100_000,
) -> DataFrame:
    """Per class: its key columns, ``rows`` and ``emd``, the distance of its values from those of the whole table.

    Categories: half the sum of differences, from the values present and the mass of the absent ones. Numbers: ordered
    distance over the m distinct values. Between two values of a class its cumulative share is constant and the table's
    is monotone, so prefix sums give each stretch's part; a class costs its own values, never the whole domain. Up to
    ``most`` distinct values go to every task; beyond, the same sums are made by global orders and joins.
    """
    if datatype not in ("numeric", "categorical"):
        raise ValueError(f"unknown datatype {datatype}")
    keys = chosen(df, [c for c in df.columns if c != sensitive_col] if quasi is None else quasi)
    s = F.col(sensitive_col).cast("double") if datatype == "numeric" else F.col(sensitive_col).cast("string")
    rows = _keyed(df.withColumn("_s", s), [*keys, "_s"])
    counts = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    marginal = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_g"))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("rows"))
    if datatype == "categorical":
        total = marginal.agg(F.sum("_g").alias("_t"))
        marginal = marginal.crossJoin(total).select("_s", (F.col("_g") / F.col("_t")).alias("_q"))  # with one row
        both = counts.join(marginal, "_s").join(sizes, keys)
        p = F.col("_c") / F.col("rows")
        return both.groupBy(*keys, "rows").agg((0.5 * (F.sum(F.abs(p - F.col("_q"))) + 1 - F.sum("_q"))).alias("emd"))
    if not keys:
        raise InputError("classes need a column besides the sensitive one")
    domain = marginal.limit(most + 1).collect()
    if len(domain) > most:
        return _ordered_distances(checkpointed(counts), marginal, sizes, keys)
    domain.sort()
    m, g = len(domain), np.array([r[1] for r in domain], float)
    q = np.cumsum(g) / g.sum() if m else g
    ahead = np.concatenate([[0.0], np.cumsum(q)])
    values = np.array([r[0] for r in domain], float)
    shared = df.sparkSession.sparkContext.broadcast((values, q, ahead))
    kinds = dict(counts.dtypes)

    def distance(rows_: pd.DataFrame) -> pd.DataFrame:
        values, q, ahead = shared.value
        rows_ = rows_.sort_values("_s")
        at, n = np.searchsorted(values, rows_["_s"].to_numpy(float)), rows_["_c"].sum()
        p = np.concatenate([[0.0], np.cumsum(rows_["_c"].to_numpy(float)) / n])
        lo, hi = np.concatenate([[0], at]), np.concatenate([at, [len(values)]])
        hi = np.minimum(hi, len(values) - 1)  # the last prefix is 1 on both sides
        lo = np.minimum(lo, hi)
        cut = np.clip(np.searchsorted(q, p), lo, hi)
        below = p * (cut - lo) - (ahead[cut] - ahead[lo])
        above = (ahead[hi] - ahead[cut]) - p * (hi - cut)
        emd = float((below + above).sum() / (len(values) - 1)) if len(values) > 1 else 0.0
        return pd.DataFrame({**{c: rows_[c].iloc[:1] for c in keys}, "rows": [n], "emd": [emd]})

    return counts.groupBy(*keys).applyInPandas(distance, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", rows bigint, emd double")


def t_closeness(df: DataFrame, sensitive_col: str, t: float = 0.1, datatype: str = "numeric", quasi: Sequence[str] | None = None) -> float:
    """Share of rows in classes at a distance of ``t`` or more."""
    return _value(closeness_classes(df, sensitive_col, datatype, quasi).agg(F.sum(F.when(F.col("emd") >= t - 1e-12, F.col("rows")).otherwise(0)) / F.sum("rows")))


def max_emd(df: DataFrame, sensitive_col: str, datatype: str = "categorical", quasi: Sequence[str] | None = None) -> float:
    return _value(closeness_classes(df, sensitive_col, datatype, quasi).agg(F.max("emd")))


def is_t_close(df: DataFrame, sensitive_col: str, t: float = 0.1, datatype: str = "categorical", quasi: Sequence[str] | None = None) -> bool:
    """Whether every class lies nearer than ``t``."""
    return max_emd(df, sensitive_col, datatype, quasi) < t


def beta_rows(df: DataFrame, sensitive_col: str, beta: float = 1.0, quasi: Sequence[str] | str | None = None, enhanced: bool = True) -> DataFrame:
    """Per class and value: ``n``, its share ``q`` in the class and ``p`` in the table, and whether it ``violates``."""
    if beta <= 0:
        raise InputError("beta must be positive")
    keys = chosen(df, [c for c in df.columns if c != sensitive_col] if quasi is None else quasi)
    rows = _keyed(df, [*keys, sensitive_col])
    counts = rows.groupBy(*keys, sensitive_col).agg(F.count(F.lit(1)).alias("n"))
    marginal = rows.groupBy(sensitive_col).agg(F.count(F.lit(1)).alias("_g"))
    marginal = marginal.crossJoin(marginal.agg(F.sum("_g").alias("_t"))).select(sensitive_col, (F.col("_g") / F.col("_t")).alias("p"))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    both = counts.join(marginal, sensitive_col).join(sizes, keys).withColumn("q", F.col("n") / F.col("_size")).drop("_size")
    limit = F.least(F.lit(float(beta)), -F.log("p")) if enhanced else F.lit(float(beta))
    return both.withColumn("violates", (F.col("q") > F.col("p")) & ((F.col("q") - F.col("p")) / F.col("p") > limit))


def beta_likeness(df: DataFrame, sensitive_col: str, beta: float = 1.0, quasi: Sequence[str] | None = None, enhanced: bool = True) -> float:
    """Share of rows whose class has their value too often by beta-likeness."""
    rows = beta_rows(df, sensitive_col, beta, quasi, enhanced)
    return _value(rows.agg(F.sum(F.when(F.col("violates"), F.col("n")).otherwise(0)) / F.sum("n")))


def is_beta_like(df: DataFrame, sensitive_col: str, beta: float = 1.0, quasi: Sequence[str] | None = None, enhanced: bool = True) -> bool:
    return not beta_likeness(df, sensitive_col, beta, quasi, enhanced)


def frequencies(df: DataFrame, sensitive_col: str, quasi: Sequence[str] | str, weights: str | None = None) -> DataFrame:
    """Rows with ``samp_fq`` (rows of their class with a sensitive value) and ``pop_fq`` (the sum of their weights)."""
    keys = chosen(df, quasi)
    chosen(df, [sensitive_col, *([weights] if weights else [])])
    there = F.col(sensitive_col).isNotNull()
    weight = F.col(weights) if weights else F.lit(1)
    counts = {"samp_fq": F.count(F.when(there, 1)), "pop_fq": F.coalesce(F.sum(F.when(there, weight)), F.lit(0)).cast("double")}
    return with_groups(df, keys, counts)


def approximate_risk(fk: Column, Fk: Column) -> Column:
    """Re-identification risk from a class's sample and population frequency, by the usual approximations."""
    p = fk / Fk
    odds, gain = p / (1 - p), F.log(1 / p)
    return (
        F.when(fk <= 0, F.lit(None).cast("double"))
        .when(fk == Fk, 1 / fk)
        .when(fk == 1, odds * gain)
        .when(fk == 2, odds - odds * odds * gain)
        .otherwise(p / (fk - (1 - p)))
    )


def exact_risk(fk: Column, Fk: Column, nodes: int = 40) -> Column:
    """The mean of 1 / F, F being the population frequency (fk plus a negative binomial number with chance ``p = fk / Fk``).

    It is ``p / fk`` times the integral of ``exp(-x) / (p + (1 - p) exp(-x / fk))`` over x from 0, by Gauss-Laguerre
    nodes; closed forms serve frequencies of one and two.
    """
    p, total = fk / Fk, F.lit(0.0)
    for x, w in zip(*np.polynomial.laguerre.laggauss(nodes), strict=True):
        total = total + F.lit(float(w)) / (p + (1 - p) * F.exp(-float(x) / fk))
    return F.when(fk <= 2, approximate_risk(fk, Fk)).when(fk == Fk, 1 / fk).otherwise(p / fk * total)


def individual_risk(
    df: DataFrame, sensitive_col: str, quasi: Sequence[str] | str, method: str = "approx", weights: str | None = None, qual: float = 1.0, name: str = "risk",
) -> DataFrame:
    """Rows with their risk of re-identification times ``qual``; without weights it is one over the class's frequency."""
    if not 0 < qual <= 1:
        raise NotInRangeError("qual lies above 0, at most at 1")
    if method not in ("approx", "exact"):
        raise InputError(f"unknown method {method}")
    rows = frequencies(df, sensitive_col, quasi, weights)
    fk, Fk = F.col("samp_fq").cast("double"), F.col("pop_fq")
    risk = F.when(fk > 0, (approximate_risk if method == "approx" else exact_risk)(fk, Fk) * qual)
    return rows.withColumn(name, risk).drop("samp_fq", "pop_fq")


def suda(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Gives the table back as it is."""
    return df


def key_report(df: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """For every subset of the keys: rows and share of rows in classes of k or fewer, in one pass by grouping sets."""
    keys = chosen(df, keys)
    rows = _keyed(df, keys).cube(*keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("set"))
    return rows.groupBy("set").agg(F.sum("n").alias("rows"), (F.sum(F.when(F.col("n") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
