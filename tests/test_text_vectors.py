"""Reduced vectors of texts against the exact decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.errors import InputError
from veilwork.plans import encode, text_vectors


def some_texts(n=400, words=500, seed=1):
    """Texts of three topics and common words, with copies, one very long and some without any word."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        topic = rng.integers(3)
        at = np.concatenate([rng.integers(0, 40, 6), 40 + 100 * topic + (rng.exponential(20, 12).astype(int) % 100), rng.integers(340, words, 3)])
        out.append(" ".join(f"w{i}" for i in at))
    return out + out[:50] + [out[0] * 1] * 40 + [" ".join(f"w{i % words}" for i in range(3000)), None, "", " ,; "]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(5, "id")


def counts(spark, df, width):
    rows = df.orderBy("id").select(text_vectors.word_columns(F.col("text"), width).alias("w")).collect()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        np.add.at(out[i], r.w, 1)
    return out


def found(df, fitted):
    return np.array([r.v for r in df.select("id", fitted.column(F.col("text")).alias("v")).orderBy("id").collect()])


@pytest.mark.parametrize("method", ["truncated", "pca", "incremental"])
def test_directions_equal_the_exact_ones(spark, method):
    df = frame(spark, some_texts())
    a = counts(spark, df, 1 << 12)
    a = a if method == "truncated" else a - a.mean(axis=0)
    fitted = text_vectors.fit(df, "text", 4, method, 1 << 12)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.abs(fitted.values / s[:4] - 1).max() < 0.01
    got = found(df, fitted)
    for k in range(3):  # the fourth is one of many alike
        assert abs(np.corrcoef(got[:, k], u[:, k])[0, 1]) > 0.99
    assert np.allclose(text_vectors.fit(df.repartition(2), "text", 4, method, 1 << 12).values, fitted.values, rtol=1e-6)


def test_independent_components_are_white_and_tell_topics(spark):
    texts = some_texts()[:400]
    df = frame(spark, texts)
    z = found(df, text_vectors.fit(df, "text", 2, "fast", 1 << 12))
    assert np.allclose(z.mean(axis=0), 0, atol=1e-6) and np.allclose(z.T @ z / len(z), np.eye(2), atol=1e-6)


def test_odd_texts(spark):
    df = frame(spark, some_texts(60))
    with pytest.raises(InputError):
        text_vectors.fit(df, "text", method="other")
    with pytest.raises(InputError):
        text_vectors.fit(df, "text", size=1000)
    for method in text_vectors.METHODS:
        assert not text_vectors.fit(df.limit(0), "text", 3, method, 64).directions.any()
        one = text_vectors.fit(df.filter("text is null or text = ''"), "text", 3, method, 64)
        assert not found(df.filter("text is null"), one).any()
        same = frame(spark, ["a b", "a b", "c"])
        assert found(same, text_vectors.fit(same, "text", 3, method, 64)).shape == (3, 3)
    table = df.select((F.col("id") % 2).cast("string").alias("s"), F.concat(F.col("text"), F.lit(" x"), F.col("id").cast("string")).alias("t"))
    for reduct in text_vectors.METHODS:
        out = encode.embed(table, "s", reduct=reduct, width=1 << 10)
        assert out.columns == ["s", *[f"t_{i}" for i in range(6)]] and out.count() == table.count()
