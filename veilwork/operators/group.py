"""Masks over ranks and groups: microaggregation, rank-preserving shuffling, local suppression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from veilwork.core import checkpointed, chosen, is_numeric, number, with_groups, with_position, with_ranks, with_running
from veilwork.errors import InputError, LessThanOrEqualToZeroError, NotInRangeError
from veilwork.functions.keyed import normal
from veilwork.operators import cluster
from veilwork.operators.near_groups import near_groups
from veilwork.operators.noise import moments
from veilwork.operators.risk import individual_risk
from veilwork.plans.encode import encode_columns

Measure = str | Callable[[Column], Column]
MEASURES = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "mode": F.mode, "sum": F.sum}


def _measure(measure: Measure) -> Callable[[Column], Column]:
    if callable(measure):
        return measure
    if measure not in MEASURES:
        raise InputError(f"unknown measure {measure}")
    return MEASURES[measure]


def pandas_measure(function: Callable, **options: object) -> Callable[[Column], Column]:
    """A measure from a function of a pandas Series. A group's values come to one task, so groups must be small ones."""

    def measured(values: pd.Series) -> float:
        return float(function(values, **options))

    return pandas_udf(measured, "double")


def _size(aggr: int) -> int:
    if aggr <= 0:
        raise LessThanOrEqualToZeroError("groups hold one row or more")
    return aggr


def with_id(df: DataFrame, key: str | None) -> DataFrame:
    """Adds ``_rid``: the unique key named, else the row's place in the order of all columns."""
    return df.withColumn("_rid", F.col(key)) if key else with_position(df, [F.col(c) for c in df.columns], "_rid")


def _output(df: DataFrame, names: Sequence[str], original: Sequence[str], output: str) -> DataFrame:
    return df.select(*names) if output == "subset" else df.select(*original)


def quantile_magg(
    df: DataFrame, aggr: int = 2, measure: Measure = "mean", cols: Sequence[str] | str | None = None, output: str = "all",
    drop_duplicates: bool = True, measure_kwargs: dict | None = None,
) -> DataFrame:
    """Each value becomes the measure of its quantile bin (``n div aggr`` bins, right-closed, equal edges merged).

    A value with i values below it and c equal to the least lies in bin ``max(ceil(i q / (n - 1)), floor((c - 1) q / (n - 1)) + 1)``.
    Without ``drop_duplicates`` equal edges are an error, and so is a column of one value in either case. With
    ``measure_kwargs`` the measure is a function of a pandas Series that gets them.
    """
    of, names, out = pandas_measure(measure, **measure_kwargs) if measure_kwargs else _measure(measure), chosen(df, cols, numeric=True), df
    for c in names:
        x = out.withColumn("_x", number(c))
        n = x.filter("_x is not null").count()
        if not 1 <= aggr <= max(1, n):
            raise NotInRangeError(f"aggr lies between 1 and {n}")
        q, ranked = n // aggr, with_ranks(x, "_x")
        if n > 1:
            # edge k lies at the place k (n - 1) / q: two equal edges have all places between them on one value
            first = f"(_r_n * {q}L + {n - 2}L) div {n - 1}L"
            edge = F.expr(first)
            merged = F.expr(f"{first} < {q}L and (({first} + 1) * {n - 1}L + {q - 1}L) div {q}L <= _r_n + _r_c - 1")
            least, single, twice = ranked.filter("_x is not null").agg(F.max(F.when(F.col("_r_n") == 0, F.col("_r_c"))), F.max("_r_c") == n, F.bool_or(merged)).first()
            if single:
                raise ValueError(f"{c} has one value only")
            if twice and not drop_duplicates:
                raise ValueError(f"{c} has equal edges of bins")
            bins = F.greatest(edge, F.lit((least - 1) * q // (n - 1) + 1))
        else:
            bins = F.lit(1)
        out = with_groups(ranked.withColumn("_bin", bins), ["_bin"], {"_new": of(F.col("_x"))})
        out = out.withColumn(c, F.when(F.col("_x").isNotNull(), F.col("_new"))).drop("_x", "_bin", "_new", "_r_n", "_r_c", "_r_d")
    return _output(out, names, df.columns, output)


def sequential_magg(
    df: DataFrame, aggr: int = 2, sort_all: bool = False, sort_by: str | None = None, measure: Measure = "mean",
    key: str | None = None, cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Chunks of ``aggr`` rows in the order of ``key`` (else of all columns), of one column, or of each column by itself."""
    _size(aggr)
    of, names, out = _measure(measure), chosen(df, cols, numeric=True), with_id(df, key)
    if sort_by is not None:
        chosen(df, sort_by)
    for i, c in enumerate(names):
        if sort_all or i == 0:
            order = [number(c), F.col("_rid")] if sort_all else [F.col(sort_by), F.col("_rid")] if sort_by else [F.col("_rid")]
            out = with_position(out.drop("_pos"), order)
        out = out.withColumn(f"_new_{c}", of(number(c)).over(W.partitionBy(F.floor(F.col("_pos") / aggr))))
    out = out.withColumns({c: F.col(f"_new_{c}") for c in names})
    return _output(out, names, df.columns, output)


def ranking_magg(
    df: DataFrame, aggr: int = 2, rank_method: str = "first", measure: Measure = "mean", key: str | None = None,
    cols: Sequence[str] | str | None = None, output: str = "all",
) -> DataFrame:
    """Sorted values in chunks of ``aggr``; each row takes the measure of the chunk at its rank (ties: average, min, max, first, dense)."""
    _size(aggr)
    ranks = {"first": "_pos", "min": "_r_n", "max": "_r_n + _r_c - 1", "average": "floor(_r_n + (_r_c - 1) / 2)", "dense": "_r_d"}
    if rank_method not in ranks:
        raise InputError(f"unknown rank method {rank_method}")
    of, names, out = _measure(measure), chosen(df, cols, numeric=True), with_id(df, key)
    for c in names:
        x = out.withColumn("_x", number(c))
        laid = with_position(x.filter("_x is not null"), [F.col("_x"), F.col("_rid")])
        chunks = laid.groupBy(F.floor(F.col("_pos") / aggr).alias("_chunk")).agg(of(F.col("_x")).alias("_new"))
        laid = with_ranks(laid, "_x").withColumn("_chunk", F.floor(F.expr(ranks[rank_method]) / aggr)).join(chunks, "_chunk").withColumn(c, F.col("_new"))
        rest = x.filter("_x is null").withColumn(c, F.lit(None).cast("double"))
        out = laid.select(*df.columns, "_rid").unionByName(rest.select(*df.columns, "_rid"))
    return _output(out, names, df.columns, output)


def robust_magg(
    df: DataFrame, aggr: int = 2, cell: int = 2000, key: str | None = None, cols: Sequence[str] | str | None = None, output: str = "all", exchanges: int = 2,
) -> DataFrame:
    """Groups of near rows over all columns: again and again the row farthest from the middle, and its nearest neighbours.

    Less than two cells of rows are grouped as a whole; beyond, cells lie along a curve through principal scores, and
    ``exchanges`` group rows anew over their borders (see ``near_groups``). Rows with nulls stay.
    """
    _size(aggr)
    names = chosen(df, cols, numeric=True, least=2)
    _, mean, cov = moments(df, names)
    if not np.all(np.diag(cov) > 0):
        raise ValueError("a column has one value only")
    out = with_id(df, key)
    made = near_groups(out.select("_rid", *[number(c).alias(c) for c in names]).dropna(subset=names), names, mean, cov, aggr, cell, exchanges)
    joined = out.alias("o").join(made.alias("m"), "_rid", "left")
    exprs = [F.coalesce(F.col(f"m.{c}"), F.col(f"o.{c}").cast("double")).alias(c) if c in names else F.col(f"o.{c}") for c in df.columns]
    return _output(joined.select(*exprs), names, df.columns, output)


def advanced_magg(
    df: DataFrame, aggr: int = 2, clust: str | Callable | None = None, reduct: str | Callable | None = None, scale: str | None = None,
    clusters: int = 8, seed: int = 1234, measure: Measure = "mean", key: str | None = None, cols: Sequence[str] | str | None = None, output: str = "all",
    radius: float = 0.5, least: int = 5, landmarks: int = 256,
) -> DataFrame:
    """Chunks of ``aggr`` rows ordered by cluster, then by the first component, then by id.

    ``clust``: kmeans, bisecting, gaussian, dbscan (of ``radius`` and ``least`` rows), agglomerative (single linkage), birch
    (features of the threshold ``radius``) or a function (features frame -> frame with ``prediction``); ``reduct``: pca, ipca (the same component: it is summed up over
    all rows either way), fica, kpca (by ``landmarks``) or a function (frame -> frame with ``component``); ``scale``:
    standard or robust. Orders of reachability (optics) aren't offered.
    """
    _size(aggr)
    if clust is None and reduct is None:
        raise InputError("a clustering or a reduction is needed")
    models = {"kmeans": lambda: KMeans(k=clusters, seed=seed), "bisecting": lambda: BisectingKMeans(k=clusters, seed=seed), "gaussian": lambda: GaussianMixture(k=clusters, seed=seed)}
    near = {"dbscan": lambda x: cluster.dbscan(x, radius, least), "agglomerative": lambda x: cluster.single_linkage(x, clusters), "birch": lambda x: cluster.birch(x, clusters, radius)}
    clust = near.get(clust, clust) if isinstance(clust, str) else clust
    if reduct == "kpca":
        reduct = lambda x: cluster.kernel_component(x, landmarks=landmarks, seed=seed)
    scalers = {"standard": lambda: StandardScaler(withMean=True, inputCol="_raw", outputCol="features"), "robust": lambda: RobustScaler(withCentering=True, inputCol="_raw", outputCol="features")}
    if isinstance(clust, str) and clust not in models or isinstance(reduct, str) and reduct not in ("pca", "ipca", "fica") or scale is not None and scale not in scalers:
        raise InputError(f"known: {', '.join([*models, *near, 'pca', 'ipca', 'fica', 'kpca', *scalers])}")
    of, names, out = _measure(measure), chosen(df, cols, numeric=True), with_id(df, key)
    x = out.dropna(subset=names).withColumns({f"_x_{c}": number(c) for c in names})
    x = VectorAssembler(inputCols=[f"_x_{c}" for c in names], outputCol="_raw" if scale else "features").transform(x)
    x = scalers[scale]().fit(x).transform(x) if scale else x
    if clust is not None:
        x = clust(x) if callable(clust) else models[clust]().fit(x).transform(x)
    if reduct is not None:
        x = reduct(x) if callable(reduct) else independent_component(x, len(names), seed) if reduct == "fica" else PCA(k=1, inputCol="features", outputCol="_c").fit(x).transform(x).withColumn("component", vector_to_array("_c")[0])
    order = [F.col(c) for c, used in (("prediction", clust), ("component", reduct)) if used is not None]
    laid = with_position(x, [*order, F.col("_rid")]).withColumn("_chunk", F.floor(F.col("_pos") / aggr))
    laid = laid.withColumns({f"_x_{c}": of(F.col(f"_x_{c}")).over(W.partitionBy("_chunk")) for c in names}).withColumns({c: F.col(f"_x_{c}") for c in names})
    rest = out.filter(~_complete(names)).withColumns({c: number(c) for c in names})
    return _output(laid.select(*df.columns).unionByName(rest.select(*df.columns)), names, df.columns, output)


def independent_component(x: DataFrame, p: int, seed: int, steps: int = 60) -> DataFrame:
    """Adds ``component``: the first independent component of ``features``, by fixed-point steps on whitened columns.

    Each step is one aggregate over all rows; the driver holds p numbers and a p x p matrix.
    """
    cols = [f"_f{i}" for i in range(p)]
    x = checkpointed(x.withColumns({c: vector_to_array("features")[i] for i, c in enumerate(cols)}))
    _, mean, cov = moments(x, cols)
    values, vectors = np.linalg.eigh(np.nan_to_num(cov))
    keep = values > 1e-12 * max(values.max(), 1e-300)
    white = vectors[:, keep] / np.sqrt(values[keep])
    z = [sum(((F.col(c) - float(mean[i])) * float(white[i, k]) for i, c in enumerate(cols)), F.lit(0.0)) for k in range(white.shape[1])]
    w = np.random.default_rng(seed).normal(size=len(z))
    w /= np.linalg.norm(w)
    for _ in range(steps):
        g = F.tanh(sum((zk * float(wk) for zk, wk in zip(z, w, strict=True)), F.lit(0.0)))
        got = x.agg(*[F.avg(zk * g).alias(f"a{k}") for k, zk in enumerate(z)], F.avg(1 - g * g).alias("d")).first()
        new = np.array([v or 0.0 for v in got[: len(z)]]) - (got["d"] or 0.0) * w
        new /= np.linalg.norm(new) or 1.0
        done, w = abs(new @ w) > 1 - 1e-9, new
        if done:
            break
    w = w * (1 if w[np.argmax(np.abs(w))] > 0 else -1)
    return x.withColumn("component", sum((zk * float(wk) for zk, wk in zip(z, w, strict=True)), F.lit(0.0))).drop(*cols)


def _complete(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull()
    return out


def microaggregation(df: DataFrame, method: str = "sequential", **options: object) -> DataFrame:
    known = {"quantile": quantile_magg, "sequential": sequential_magg, "ranking": ranking_magg, "robust": robust_magg, "advanced": advanced_magg}
    if method not in known:
        raise InputError(f"unknown method {method}")
    return known[method](df, **options)


# A rational approximation of the normal quantile (relative error below 1.2e-9).
TAIL = 0.02425
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_quantile(p: Column) -> Column:
    """The normal quantile as a column expression."""

    def poly(x: Column, terms: Sequence[float]) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return (
        F.when(p < TAIL, poly(low, C) / (poly(low, D) * low + 1))
        .when(p > 1 - TAIL, -poly(high, C) / (poly(high, D) * high + 1))
        .otherwise(q * poly(r, A) / (poly(r, B) * r + 1))
    )


def shuffle(
    df: DataFrame, shuffle_cols: Sequence[str] | str, cor_cols: Sequence[str] | str | None = None, cor_method: str = "spearman",
    seed: int = 1234, key: str | None = None, output: str = "all", scores: bool = False,
) -> DataFrame:
    """Re-assign each column's own values in the rank order of scores drawn given the other columns.

    Normal scores of the predictors, the correlations (``2 sin(pi r / 6)``) and keyed noise give scores for the shuffled
    columns; the k-th smallest value goes to the row with the k-th smallest score. Every column keeps its values, each
    as often as before. Two range-partitioned orders and one join on the place per column. ``scores`` keeps the drawn
    scores as ``score_<column>``. Correlations are spearman, pearson or kendall. Named predictors that aren't
    numbers are codes of their sorted values; unnamed ones are the other numeric columns.
    """
    targets = chosen(df, shuffle_cols)
    predictors = [c for c in df.columns if c not in targets and is_numeric(df, c)] if cor_cols is None else chosen(df, cor_cols)
    if set(targets) & set(predictors):
        raise InputError("a column is shuffled and a predictor at once")
    if odd := [c for c in targets if not is_numeric(df, c)]:
        raise InputError(f"not numeric: {', '.join(odd)}")
    if cor_method not in ("spearman", "pearson", "kendall"):
        raise InputError("known correlations: spearman, pearson, kendall")
    out = with_id(df, key)
    scored = encode_columns(out.select("_rid", *targets, *predictors), predictors)
    scored = scored.select("_rid", *[number(c).alias(c) for c in targets + predictors])
    n = scored.count()
    for c in targets + predictors:
        ranked = with_ranks(scored, c)
        middle = F.col("_r_n") + (F.col("_r_c") + 1) / 2
        scored = ranked.withColumn(f"_k_{c}", middle).withColumn(f"_s_{c}", normal_quantile((middle - 0.5) / n)).drop("_r_n", "_r_c", "_r_d")
    basis = [c if cor_method == "pearson" else f"_k_{c}" for c in targets + predictors]
    _, _, cov = moments(scored, basis)
    sd, t = np.sqrt(np.diag(cov)), len(targets)
    if cor_method == "kendall":
        cov = kendall_matrix(scored, targets + predictors) * np.outer(sd, sd)
    keep = [i for i in range(t, len(basis)) if sd[i] > 0]
    if not keep or not np.all(sd[:t] > 0):
        raise InputError("the columns have one value only")
    corr = 2 * np.sin(np.pi / 6 * np.clip(cov / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1)), -1, 1))
    np.fill_diagonal(corr, 1)
    b = corr[:t][:, keep] @ np.linalg.pinv(corr[np.ix_(keep, keep)])
    values, vectors = np.linalg.eigh(corr[:t, :t] - b @ corr[keep][:, :t])
    root = vectors * np.sqrt(np.maximum(values, 0))
    z = [normal(F.xxhash64("_rid"), f"z{k}", seed) for k in range(t)]
    names = targets + predictors
    for i, c in enumerate(targets):
        y = sum((F.col(f"_s_{names[j]}") * float(b[i, k]) for k, j in enumerate(keep)), F.lit(0.0))
        y = y + sum((z[k] * float(root[i, k]) for k in range(t)), F.lit(0.0))
        places = with_position(scored.select("_rid", y.alias("_y")), [F.col("_y"), F.col("_rid")]).withColumnRenamed("_y", f"score_{c}")
        sorted_values = with_position(out.select(F.col(c).alias("_v"), F.col("_rid").alias("_o")), [F.col("_v"), F.col("_o")])
        new = places.join(sorted_values, "_pos").select("_rid", F.col("_v").alias(f"_new_{c}"), *[f"score_{c}"] * scores)
        out = out.join(new, "_rid")
    out = out.withColumns({c: F.col(f"_new_{c}") for c in targets})
    more = [f"score_{c}" for c in targets] if scores else []
    return _output(out, targets + more, df.columns + more, output)


def kendall_matrix(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Kendall's tau-b of every two columns, over rows where both are there."""
    out = np.eye(len(names))
    for i in range(len(names)):
        for j in range(i):
            out[i, j] = out[j, i] = kendall(df, names[i], names[j])
    return out


def kendall(df: DataFrame, a: str, b: str) -> float:
    """Kendall's tau-b of two columns: concordant less discordant pairs, over the pairs that aren't tied.

    Rows are laid by ``a`` and get their rank by ``b``. Bit by bit of that rank, from the top, the rows that agree on
    the higher bits are split in two, and a pair is discordant at the bit where it parts, if the one with the bit unset
    comes later. So each bit takes a running count over the rows, never a pair of rows.
    """
    rows = df.select(number(a).alias("x"), number(b).alias("y")).dropna()
    pairs = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    ranked = checkpointed(with_ranks(with_ranks(pairs, "x", "_a_"), "y", "_b_").select("n", F.col("_a_d").alias("x"), F.col("_b_d").alias("y")))
    n, bits = ranked.agg(F.sum("n"), F.max("y")).first()
    half = lambda k: F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias(k)
    if not n or n < 2:
        return 0.0
    tied_a = ranked.groupBy("x").agg(F.sum("n").alias("n")).agg(half("t")).first()[0]
    tied_b = ranked.groupBy("y").agg(F.sum("n").alias("n")).agg(half("t")).first()[0]
    both = ranked.agg(half("t")).first()[0]
    discordant = 0.0
    for bit in range(int(bits).bit_length()):
        # rows of equal x don't make a pair: with y descending inside an x, a set bit never comes before an unset one
        order = [F.shiftright("y", bit + 1), F.col("x"), F.col("y").bitwiseAND(F.lit(1 << bit))]
        one = F.when(F.col("y").bitwiseAND(F.lit(1 << bit)) != 0, F.col("n")).otherwise(0)
        laid = with_running(ranked, order, {"_ones": one}).withColumn("_head", F.shiftright("y", bit + 1))
        first = laid.groupBy("_head").agg(F.min("_ones").alias("_start"))
        late = laid.join(first, "_head").filter(F.col("y").bitwiseAND(F.lit(1 << bit)) == 0)
        discordant += late.agg(F.sum(F.col("n").cast("double") * (F.col("_ones") - F.col("_start")))).first()[0] or 0.0
    total = n * (n - 1) / 2
    concordant = total - tied_a - tied_b + both - discordant
    scale = np.sqrt((total - tied_a) * (total - tied_b))
    return float((concordant - discordant) / scale) if scale else 0.0


def shuffle_by_model(*_: object, **__: object) -> DataFrame:
    raise NotImplementedError("shuffling by a model isn't defined")


def local_suppression(
    df: DataFrame, suppress_col: str, sensitive_col: str, to_val: object = None, method: str = "approx", risk_threshold: float = 0.15,
    max_unique: int = 20, weights: str | None = None, qual: float = 1.0, output: str = "all",
) -> DataFrame:
    """Cells of ``suppress_col`` in rows of a risk above the threshold become ``to_val``.

    Quasi-identifiers are the columns, other than the sensitive one, with fewer than ``max_unique`` values.
    """
    if not 0 <= risk_threshold <= 1:
        raise NotInRangeError("the threshold lies between 0 and 1")
    chosen(df, [suppress_col, sensitive_col])
    others = [c for c in df.columns if c not in (sensitive_col, weights)]
    # only columns that can be below the limit by a sketch of all are counted exactly
    rough = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in others]).first()
    few = [c for c in others if rough[c] < 1.5 * max_unique + 10]
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in few]).first() if few else {}
    quasi = [c for c in few if counts[c] < max_unique]
    risky = individual_risk(df, sensitive_col, quasi, method, weights, qual, name="_risk")
    out = risky.withColumn(suppress_col, F.when(F.col("_risk") > risk_threshold, F.lit(to_val)).otherwise(F.col(suppress_col)))
    return out.select(suppress_col) if output == "subset" else out.select(*df.columns)
