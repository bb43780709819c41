import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veilwork.plans import encode, entity


def mixed(n=4000, categories=60, classes=10, seed=3):
    r = np.random.default_rng(seed)
    of = r.integers(0, categories, n)
    logits = r.normal(size=(categories, 2)) @ r.normal(size=(2, classes)) * 1.5
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = [r.choice(classes, p=p[c]) for c in of]
    return pd.DataFrame({"cat": [f"c{c}" for c in of], "y": [f"y{v}" for v in y]})


def best_loss(e, counts, steps=4000):
    """The loss of the best weights for given vectors, by the plain descent."""
    one = np.column_stack([e, np.ones(len(e))])
    n, w = counts.sum(axis=1, keepdims=True), np.zeros((counts.shape[1], one.shape[1]))
    back = np.linalg.pinv(0.5 * (n * one).T @ one)
    for _ in range(steps):
        z = np.exp(one @ w.T)
        w = w + (counts - n * z / z.sum(axis=1, keepdims=True)).T @ one @ back
    z = np.exp(one @ w.T)
    return -(counts * np.log(z / z.sum(axis=1, keepdims=True))).sum() / counts.sum()


def test_loss_falls_below_that_of_singular_vectors_and_reruns_agree(spark):
    frame = mixed()
    df = spark.createDataFrame(frame)
    found = entity.fit(df, "cat", "y", 3, rounds=15)
    assert all(b <= a + 1e-6 for a, b in zip(found.losses, found.losses[1:], strict=False))
    counts = pd.crosstab(frame.cat, frame.y)
    singular = encode.category_vectors(df, "cat", "y", 3)
    assert found.losses[-1] <= best_loss(np.array([singular[c] for c in counts.index]), counts.to_numpy(float))
    again = entity.fit(df.repartition(7), "cat", "y", 3, rounds=15)
    assert np.allclose(again.losses, found.losses, atol=1e-9)
    a, b = ({r._v: r.e for r in t.vectors.collect()} for t in (found, again))
    assert a.keys() == b.keys() == set(frame.cat) and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)


def test_nulls_many_categories_and_empty_tables(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("cat"), F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("y"))
    found = entity.fit(df, "cat", "y", 2, rounds=2, steps=5)
    assert found.vectors.count() == 16_001 and found.vectors.filter("_v = 'None'").count() == 1
    assert found.losses[1] < found.losses[0] < 0.7
    assert entity.fit(df.limit(0), "cat", "y", 2).vectors.count() == 0


def test_table_of_trained_vectors(spark):
    df = spark.createDataFrame(mixed(600, 5, 3)).withColumn("n", F.rand(1))
    out = encode.embed(df, "y", size=2, trained=True)
    assert out.columns == ["y", "n", "cat_0", "cat_1"] and out.count() == 600 and out.select("cat_0").distinct().count() == 5


def test_kinds_of_columns_near_the_limits(spark):
    df = spark.range(1000).select(
        F.col("id").alias("number"), (F.col("id") % 2).alias("flag"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("two"), F.when(F.col("id") < 999, "a").alias("one"),
        F.concat(F.lit("x"), F.least(F.col("id"), F.lit(749))).alias("just"), F.concat(F.lit("x"), F.least(F.col("id"), F.lit(750))).alias("over"),
        F.when(F.col("id") == 5, F.repeat(F.lit("y"), 201)).otherwise("z").alias("long"),
    )
    want = {"number": "numerical", "flag": "binary", "two": "binary_categorical", "one": "categorical", "just": "categorical", "over": "textual", "long": "textual"}
    assert encode.column_kinds(df) == want
