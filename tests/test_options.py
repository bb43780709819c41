import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilwork.operators import group, utility
from veilwork.plans import models



@pytest.mark.parametrize("values", [[1, 2, 3, 4, 5, 6, 7, 8], [1, 1, 1, 2, 3, 4, 5, 6], [1, 2, 3, 3, 3, 3, 4, 5], [1, 2, 2, 3, 3, 4, 4, 5], [1, 2, 3, 4, 5, 9, 9, 9]])
@pytest.mark.parametrize("aggr", [1, 2, 3])
def test_equal_edges_are_an_error_where_pandas_says_so(spark, values, aggr):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    try:
        pd.qcut(pd.Series(values), len(values) // aggr)
    except ValueError:
        with pytest.raises(ValueError):
            group.quantile_magg(df, aggr, cols="x", drop_duplicates=False)
    else:
        bins = pd.qcut(pd.Series(values), len(values) // aggr)
        want = pd.Series(values, dtype=float).groupby(bins, observed=True).transform("mean")
        got = group.quantile_magg(df, aggr, cols="x", drop_duplicates=False).toPandas().x
        assert np.allclose(sorted(got), sorted(want))


def test_a_column_of_one_value_is_an_error(spark):
    with pytest.raises(ValueError):
        group.quantile_magg(spark.range(4).select(F.lit(2.0).alias("x")), 2, cols="x")


def test_measures_of_pandas(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 4, 8, 16, 32]], "x double")
    got = group.quantile_magg(df, 3, pd.Series.quantile, cols="x", measure_kwargs={"q": 0.25}).toPandas().x
    assert sorted(got) == [1.5] * 3 + [12.0] * 3
    got = group.ranking_magg(df, 3, measure=group.pandas_measure(lambda s: s.max() - s.min()), cols="x").toPandas().x
    assert sorted(got) == [3.0] * 3 + [24.0] * 3


def test_predictors_of_a_shuffle_are_encoded(spark):
    r = np.random.default_rng(2)
    words = np.array(["low", "mid", "top"])[r.integers(0, 3, 400)]
    value = pd.Series(words).map({"low": 0.0, "mid": 5.0, "top": 10.0}) + r.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "word": words, "value": value}))
    out = group.shuffle(df, "value", "word", key="id").toPandas()
    assert sorted(out.value) == sorted(value) and (out.sort_values("id").value.to_numpy() != value).mean() > 0.9
    assert list(out.sort_values("id").word) == list(words)
    means = out.groupby("word").value.mean()
    assert means["low"] + 3 < means["mid"] < means["top"] - 3


def test_scores_keep_their_models(spark, tmp_path):
    df = spark.range(300).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") > 150).cast("int").alias("s"))
    mod = df.withColumn("a", F.round(F.col("a") / 100) * 100)
    plain = utility.auc_score(df, mod, "s", "rfclass")
    found = [utility.auc_score(df, mod, "s", "rfclass", cache=str(tmp_path)) for _ in range(2)]
    assert found == [plain, plain] and len(os.listdir(tmp_path / "rfclass")) == 1
    utility.auc_score(df, mod.withColumn("b", F.lit(0.0)), "s", "rfclass", cache=str(tmp_path))
    assert len(os.listdir(tmp_path / "rfclass")) == 1  # another mask of the same table, the same model
    a, b = (utility.propensity_score(df, mod, method="rfclass", cache=c) for c in (None, str(tmp_path)))
    assert a == b and len(os.listdir(tmp_path / "rfclass")) == 2


def watched(monkeypatch, kinds):
    """Each fit's kind, rows, weight of all of them, columns and rows of each task."""
    seen = []

    def fit(self, data, inner):
        weight = F.sum("_n") if "_n" in data.columns else F.count(F.lit(1))
        tasks = [r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect()]
        seen.append((type(self).__name__, sum(tasks), data.agg(weight).first()[0], data.columns, tasks))
        return inner(self, data)

    for kind in kinds:
        monkeypatch.setattr(kind, "_fit", lambda self, data, inner=kind._fit: fit(self, data, inner))
    return seen


@pytest.mark.parametrize("method, kinds", [("tpotclass", (models.RandomForestClassifier, models.LogisticRegression, models.GBTClassifier)), ("tpotreg", (models.RandomForestRegressor, models.LinearRegression, models.GBTRegressor))])
def test_only_the_best_kind_of_model_is_fitted_to_all_rows(spark, monkeypatch, method, kinds):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 20 > 9).cast("int").alias("y"))
    seen = watched(monkeypatch, kinds)
    won = models.train(df, ["a", "b"], "y", method).stages[-1]
    assert len(seen) == 4 and {s[0] for s in seen[:3]} == {k.__name__ for k in kinds}
    assert len({s[2] for s in seen[:3]}) == 1 and seen[0][2] < 400 and seen[3][2] == 400  # the same part for each, and all rows
    assert type(won).__name__.startswith(seen[3][0].removesuffix("Classifier").removesuffix("Regressor"))


def test_a_small_file_of_many_rows_is_dealt_over_all_tasks(spark, monkeypatch):
    seen = watched(monkeypatch, [models.RandomForestClassifier, models.LinearRegression])
    df = spark.range(60_000, numPartitions=1).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 97 > 40).cast("int").alias("y"))
    for method in ("rfclass", "encv"):
        model = models.train(df, ["a"], "y", method)
        assert models.auc(model, df, "y") > 0.95
        _, rows, _, columns, tasks = seen[-1]
        assert rows == 60_000 and len(tasks) == 4 and max(tasks) < 20_000 and not {"id", "a", "y"} & set(columns)
    models.train(df.limit(3000), ["a"], "y", "encv")
    assert seen[-1][4] == [3000]


def test_equal_rows_weigh_as_many_as_they_are(spark, monkeypatch):
    seen = watched(monkeypatch, [models.LogisticRegression])
    df = spark.range(2000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 * 100).cast("double").alias("b"), F.lit(3.0).alias("c"))
    df = df.withColumn("y", (F.col("a") * 100 + F.col("b") + F.pmod(F.hash("a", "b"), F.lit(7)) * 50 > 700).cast("int"))
    model = models.train(df, ["a", "b", "c"], "y", "logreg")
    fitted = list(seen)
    assert len(fitted) == 10 and fitted[-1][2] == 2000 and all(rows <= 3 * 35 for _, rows, *_ in fitted)
    assert sum(weight for _, _, weight, *_ in fitted[:9]) == 3 * 2 * 2000  # three penalties, each fold left out once
    single = models.VectorAssembler(inputCols=["a", "b", "c"], outputCol="_features").transform(df).withColumn("_y", F.col("y").cast("double"))
    kept = single.withColumn("_y", F.col("_y").alias("_y", metadata=model.transform(labelled(df)).schema["_y"].metadata))
    for penalty in (1e-2, 1.0):
        plain = models.LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=50, regParam=penalty).fit(kept)
        mine = models.LogisticRegression(featuresCol="_scaled", labelCol="_y", maxIter=50, regParam=penalty, standardization=False, weightCol="_n")
        counted = model.transform(labelled(df)).groupBy("_scaled", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n"))
        assert mine.getStandardization() == model.stages[-1].getStandardization()
        got, want = (m.transform(t).agg(F.sort_array(F.collect_set(F.round(models.vector_to_array("probability")[0], 4)))).first()[0] for m, t in ((mine.fit(counted), counted), (plain, kept)))
        assert np.allclose(got, want, atol=2e-4)


def labelled(df):
    return df.withColumn("_label_text", F.lpad(F.col("y").cast("double").cast("decimal(38,6)").cast("string"), 40, "0"))
