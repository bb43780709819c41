"""Encoders: sorted labels, and category embeddings from their counts beside the sensitive column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.core import is_numeric, with_position
from veilwork.errors import InputError
from veilwork.plans import entity, text_vectors


def label_codes(values: DataFrame, col: str) -> DataFrame:
    """``(col, code)``: distinct values as text in sorted order from 0; null is the text None."""
    text = F.coalesce(F.col(col).cast("string"), F.lit("None")).alias("_v")
    return with_position(values.select(text).distinct(), [F.col("_v")], "_code").select("_v", "_code")


def label_encode_both(a: DataFrame, b: DataFrame, sensitive_col: str | None = None, encode_sensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tables with every column that isn't a number as codes of the values of both, columns in their order."""
    if set(a.columns) != set(b.columns):
        raise InputError("the tables have different columns")
    cols = [c for c in a.columns if not (c == sensitive_col and not encode_sensitive)]
    return encode_columns(a, cols, a.unionByName(b)), encode_columns(b.select(*a.columns), cols, a.unionByName(b))


def encode_columns(df: DataFrame, cols: Sequence[str], values: DataFrame | None = None) -> DataFrame:
    """The table with those of ``cols`` that aren't numbers as codes of the values of ``values`` (its own if none)."""
    out = df
    for c in (c for c in cols if not is_numeric(df, c)):
        codes = label_codes(df if values is None else values, c)
        out = out.join(codes, F.coalesce(out[c].cast("string"), F.lit("None")) == codes["_v"]).withColumn(c, F.col("_code")).drop("_v", "_code")
    return out.select(*df.columns)


def label_encode(df: DataFrame) -> DataFrame:
    return encode_columns(df, df.columns)


def column_kinds(df: DataFrame, share: float = 0.75, length: int = 200) -> dict[str, str]:
    """binary, numerical, textual, binary_categorical or categorical per column, from one aggregate of sketches.

    Only columns whose sketch (off by 2 % as a rule) comes near a limit are counted exactly, in a second aggregate.
    """
    asks = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        numeric = is_numeric(df, c)
        asks += [F.bool_and(F.col(c).isin(0, 1)).alias(f"b{i}")] if numeric else [F.approx_count_distinct(c, 0.02).alias(f"d{i}"), F.max(F.length(F.col(c).cast("string"))).alias(f"l{i}")]
    got = df.agg(*asks).first().asDict()
    near = [i for i, c in enumerate(df.columns) if not is_numeric(df, c) and (got[f"d{i}"] <= 100 or abs(got[f"d{i}"] - share * got["n"]) < 0.2 * share * got["n"])]
    if near:
        got |= df.agg(*[F.count_distinct(df.columns[i]).alias(f"d{i}") for i in near]).first().asDict()
    out = {}
    for i, c in enumerate(df.columns):
        if is_numeric(df, c):
            out[c] = "binary" if got[f"b{i}"] else "numerical"
        elif got[f"d{i}"] > share * got["n"] or (got[f"l{i}"] or 0) > length:
            out[c] = "textual"
        else:
            out[c] = "binary_categorical" if got[f"d{i}"] == 2 else "categorical"
    return out


def category_vectors(df: DataFrame, col: str, sensitive_col: str, size: int = 6, most: int = 1_000_000) -> dict[str, np.ndarray]:
    """A vector per category: the leading singular directions of its standardised counts beside the sensitive values.

    The table of counts (categories x sensitive values) is what the driver gets; more than ``most`` cells are an error.
    Deterministic, and distinct categories get distinct vectors: the last component holds the category's share.
    """
    counts = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("None")).alias("a"), F.col(sensitive_col).cast("string").alias("b")).count().limit(most + 1).collect()
    names, classes = ({v: i for i, v in enumerate(sorted(found))} for found in ({r.a for r in counts}, {r.b or "" for r in counts}))
    if len(names) * len(classes) > most:
        raise InputError(f"{col} has too many categories to be embedded beside {sensitive_col}")
    t = np.zeros((len(names), len(classes)))
    for r in counts:
        t[names[r.a], classes[r.b or ""]] += r["count"]
    rows, cols = t.sum(axis=1, keepdims=True), t.sum(axis=0, keepdims=True)
    z = (t - rows @ cols / t.sum()) / np.sqrt(rows @ cols / t.sum() + 1e-12)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    out = np.zeros((len(names), size))
    k = min(size - 1, u.shape[1])
    out[:, :k] = u[:, :k] * s[:k] * np.where(np.abs(u[:, :k]).max(axis=0) == u[:, :k].max(axis=0), 1, -1)
    out[:, -1] = rows[:, 0] / t.sum() + np.arange(len(names)) * 1e-6
    return dict(zip(names, out, strict=True))


def embed(
    df: DataFrame, sensitive_col: str, ignore: Sequence[str] = (), size: int = 6, normalize: bool = False, fit_on: DataFrame | None = None,
    reduct: str = "pca", width: int = 1 << 18, trained: bool = False,
) -> DataFrame:
    """Sensitive, ignored, numeric, binary, embedded and text columns, without nulls.

    Numbers are imputed by their mean (0 / 1 columns by their mode), categories by None, texts by "None"; a category
    becomes ``size`` columns of its vector (of counts, or ``trained``, see ``entity.fit``), a text as many components (``reduct``, see ``text_vectors.fit``) of its words in ``width`` hashed columns.
    """
    base = df if fit_on is None else fit_on
    if base.filter(F.col(sensitive_col).isNull()).limit(1).count():
        raise ValueError("the sensitive column has nulls")
    used = [c for c in df.columns if c != sensitive_col and c not in ignore]
    kinds = column_kinds(base.select(*used))
    numeric = [c for c in used if kinds[c] == "numerical"]
    binary = [c for c in used if kinds[c] == "binary"]
    asks = [f(F.col(c).cast("double")).alias(f"{n}{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))] + [F.mode(c).alias(f"b{c}") for c in binary]
    got = base.agg(*asks).first() if asks else None
    out = df
    parts = [F.col(sensitive_col), *[F.col(c) for c in ignore]]
    for c in numeric:
        x = F.coalesce(F.col(c).cast("double"), F.lit(got[f"m{c}"] or 0.0))
        parts.append(((x - (got[f"m{c}"] or 0.0)) / (got[f"s{c}"] or 1.0) if normalize else x).alias(c))
    parts += [F.coalesce(F.col(c).cast("double"), F.lit(float(got[f"b{c}"] or 0))).alias(c) for c in binary]
    for c in (c for c in used if kinds[c] == "binary_categorical"):
        first = base.agg(F.min(F.col(c).cast("string"))).first()[0]
        parts.append(F.when(F.coalesce(F.col(c).cast("string"), F.lit(first)) == first, 0.0).otherwise(1.0).alias(c))
    for c in (c for c in used if kinds[c] == "categorical"):
        if trained:
            table = entity.fit(base, c, sensitive_col, size).vectors.select("_v", *[F.col("e")[i].alias(f"{c}_{i}") for i in range(size)])
        else:
            vectors = category_vectors(base, c, sensitive_col, size)
            table = df.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in vectors.items()], "_v string, " + ", ".join(f"`{c}_{i}` double" for i in range(size)))
        out = out.join(table, F.coalesce(F.col(c).cast("string"), F.lit("None")) == table["_v"], "left").drop("_v")
        parts += [F.coalesce(f"{c}_{i}", F.lit(0.0)).alias(f"{c}_{i}") for i in range(size)]
    for c in (c for c in used if kinds[c] == "textual"):
        text = F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit("None"))
        fitted = text_vectors.fit(base.select(text.alias("text")), "text", size, reduct, width)
        out = out.withColumn(f"_p_{c}", fitted.column(text))
        parts += [F.col(f"_p_{c}")[i].alias(f"{c}_{i}") for i in range(size)]
    return out.select(*parts)


def embed_both(a: DataFrame, b: DataFrame, sensitive_col: str, encode_sensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    if set(a.columns) != set(b.columns):
        raise InputError("the tables have different columns")
    both = a.unionByName(b)
    out = tuple(embed(t, sensitive_col, fit_on=both) for t in (a, b))
    if encode_sensitive and not is_numeric(a, sensitive_col):
        codes = label_codes(both.select(sensitive_col), sensitive_col)
        out = tuple(t.join(codes, t[sensitive_col].cast("string") == codes["_v"]).withColumn(sensitive_col, F.col("_code")).drop("_v", "_code") for t in out)
    return out


def _as_is(a: DataFrame, b: DataFrame, sensitive_col: str | None = None, encode_sensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    return a, b


def encoder(name: str | None) -> Callable[..., tuple[DataFrame, DataFrame]]:
    known = {None: _as_is, "label_encode": label_encode_both, "embeddings": embed_both}
    if name not in known:
        raise InputError(f"unknown preprocessor {name}")
    return known[name]
