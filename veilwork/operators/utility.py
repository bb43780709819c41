"""Information loss and attacks: unequal cells, Jensen-Shannon distance, propensity and attribute-inference scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import number, with_running
from veilwork.errors import InputError
from veilwork.plans import encode, models


def proportion_different(orig: DataFrame, mod: DataFrame, key: str) -> DataFrame:
    """One row ``share``: unequal cells among the columns both have, row by row of ``key``; null beside null is unequal."""
    cols = [c for c in orig.columns if c != key]
    if set(cols) != set(mod.columns) - {key}:
        raise InputError("the tables have different columns")
    a, b = orig.alias("a"), mod.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    unequal = sum((F.when(F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False)), 0).otherwise(1) for c in cols), F.lit(0))
    return both.agg((F.sum(unequal) / (F.count(F.lit(1)) * len(cols))).alias("share"))


def jensen_shannon_columns(orig: DataFrame, mod: DataFrame, bins: int = 99) -> DataFrame:
    """``(column, distance)``: base-2 Jensen-Shannon distance of each numeric column over ``bins`` bins of the joint range.

    All columns of both tables are counted in one grouped pass over unpivoted bin numbers.
    """
    cols = orig.columns
    if set(cols) != set(mod.columns):
        raise InputError("the tables have different columns")
    both = orig.select(*[number(c).alias(c) for c in cols], F.lit(0).alias("_t")).unionByName(mod.select(*[number(c).alias(c) for c in cols], F.lit(1).alias("_t")))
    ends = both.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))]).first()
    cells = []
    for i, c in enumerate(cols):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        if low is None:
            continue
        width = (high - low or 1.0) / bins
        place = F.least(F.greatest(F.ceil((F.col(c) - low) / width), F.lit(1)), F.lit(bins)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), place).alias("bin")))
    counts = both.select("_t", F.explode(F.array(*cells)).alias("x")).filter("x.bin is not null")
    counts = counts.groupBy("x.column", "x.bin").agg(F.count(F.when(F.col("_t") == 0, 1)).alias("p"), F.count(F.when(F.col("_t") == 1, 1)).alias("q"))
    totals = counts.groupBy("column").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    shares = counts.join(totals, "column").select("column", (F.col("p") / F.col("np")).alias("p"), (F.col("q") / F.col("nq")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return shares.groupBy("column").agg(F.sqrt(F.greatest(F.sum((part(F.col("p")) + part(F.col("q"))) / 2), F.lit(0.0))).alias("distance"))


def jensen_shannon(orig: DataFrame, mod: DataFrame, sensitive_col: str | None = None, preprocessor: str | None = "label_encode") -> float:
    """Mean distance over the encoded columns (not the sensitive one)."""
    a, b = encode.encoder(preprocessor)(orig, mod, sensitive_col)
    drop = [sensitive_col] if sensitive_col else []
    return jensen_shannon_columns(a.drop(*drop), b.drop(*drop)).agg(F.avg("distance")).first()[0]


def propensity_score(
    orig: DataFrame, mod: DataFrame, sensitive_col: str | None = None, test_size: float = 0.1, seed: int = 1234,
    preprocessor: str | None = "label_encode", method: str = "logreg", cache: str | None = None, retrain: bool = False,
) -> float:
    """How well a model tells the tables apart on rows held out by a keyed split: ``|AUC - 0.5| / 0.5``.

    With a folder ``cache`` the model is kept there, and read when the same rows come again (not if ``retrain``).
    """
    models.check(method)
    a, b = encode.encoder(preprocessor)(orig, mod, sensitive_col)
    drop = [sensitive_col] if sensitive_col else []
    both = a.drop(*drop).withColumn("_label", F.lit(0.0)).unionByName(b.drop(*drop).withColumn("_label", F.lit(1.0)))
    features = [c for c in both.columns if c != "_label"]
    part = F.pmod(F.xxhash64(F.lit(seed), *features, "_label"), F.lit(1000)) < int(1000 * test_size)
    return abs(models.auc(models.train(both.filter(~part), features, "_label", method, seed, cache=cache, retrain=retrain), both.filter(part), "_label") - 0.5) / 0.5


def auc_score(
    orig: DataFrame, mod: DataFrame, sensitive_col: str, method: str = "logreg", preprocessor: str | None = "label_encode",
    absolute_risk: bool = False, seed: int = 1234, cache: str | None = None, retrain: bool = False,
) -> float:
    """Attribute inference: train on the original, compare ``|0.5 - AUC|`` on both; ``min / original`` (or over 0.5).

    With a folder ``cache`` the model of the original is kept there, so that further masks of one table don't train
    again (unless ``retrain``).
    """
    models.check(method)
    if models.task(orig, sensitive_col) == "regression":
        raise InputError("the sensitive column is a number of many values")
    a, b = encode.encoder(preprocessor)(orig, mod, sensitive_col, encode_sensitive=True)
    features = [c for c in a.columns if c != sensitive_col]
    model = models.train(a, features, sensitive_col, method, seed, cache=cache, retrain=retrain)
    x, y = (abs(0.5 - models.auc(model, t, sensitive_col)) for t in (a, b))
    return y / 0.5 if absolute_risk else min(x, y) / x if x else 0.0


def mape(true: Column, predicted: Column) -> Column:
    """Mean absolute percentage error; rows of a true value of zero are left out."""
    return F.avg(F.abs(F.try_divide(true - predicted, true))) * 100


def unused_name(cols: Sequence[str], prefix: str = "class") -> str:
    name, i = prefix, 0
    while name in cols:
        name, i = f"{prefix}_{i}", i + 1
    return name


def roc_points(scored: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, tpr, fpr)`` for a plot, from counts per distinct score, added up from the highest in a global order."""
    counts = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("double")).alias("_p"), F.count(F.lit(1)).cast("double").alias("_n"))
    laid = with_running(counts, [F.desc("threshold")], {"_tp": F.col("_p"), "_all": F.col("_n")})
    tp, n = F.col("_tp") + F.col("_p"), F.col("_all") + F.col("_n")
    return laid.select("threshold", (tp / F.col("_tp_all")).alias("tpr"), ((n - tp) / (F.col("_all_all") - F.col("_tp_all"))).alias("fpr"))


def risk_utility_pairs(log: DataFrame, risk: str, utility: str) -> DataFrame:
    """``(step, risk, utility)`` of a search's log, for a plot: the values of two of its metrics at each step without an error."""
    good = log.filter("error_log is null")
    return good.select("step", F.col(risk)["value"].alias("risk"), F.col(utility)["value"].alias("utility"))
