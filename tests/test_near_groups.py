import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilwork.operators import group
from veilwork.operators.near_groups import greedy_groups, group_loss
from veilwork.queries import queries


def plain_greedy(z, aggr):
    """The definition, row by row."""
    left, out, g = list(range(len(z))), [0] * len(z), 0
    while left:
        take = left
        if len(left) >= 2 * aggr:
            middle = np.mean([z[i] for i in left], axis=0)
            start = max(left, key=lambda i: (((z[i] - middle) ** 2).sum(), -i))
            take = sorted(left, key=lambda i: (((z[i] - z[start]) ** 2).sum(), i))[:aggr]
        for i in take:
            out[i] = g
        left, g = [i for i in left if i not in set(take)], g + 1
    return np.array(out)


def sample(n, seed=1):
    r = np.random.default_rng(seed)
    a = r.normal(size=n)
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": a * 0.5 + r.normal(size=n), "c": np.exp(2 * r.normal(size=n))})


def loss_of(frame, out):
    names = ["a", "b", "c"]
    both = frame.merge(out, on="id", suffixes=("", "_new"))
    assert len(both) == len(frame)
    sd = frame[names].std()
    return sum((((both[c] - both[f"{c}_new"]) / sd[c]) ** 2).sum() for c in names)


def test_greedy_equals_its_definition():
    r = np.random.default_rng(0)
    for n, aggr in [(1, 3), (5, 3), (6, 3), (50, 4), (61, 2)]:
        z = r.normal(size=(n, 3))
        assert (greedy_groups(z, aggr) == plain_greedy(z, aggr)).all()


def test_less_than_two_cells_are_grouped_as_a_whole(spark):
    frame = sample(300)
    out = group.robust_magg(spark.createDataFrame(frame), 3, key="id", cols=["a", "b", "c"]).toPandas().sort_values("id")
    x = frame[["a", "b", "c"]]
    found = plain_greedy(((x - x.mean()) / x.std()).to_numpy(), 3)
    assert np.allclose(out[["a", "b", "c"]], x.groupby(found).transform("mean"))


def test_cells_lose_little_and_exchanges_never_more(spark):
    frame = sample(3000)
    df = spark.createDataFrame(frame)
    x = frame[["a", "b", "c"]]
    z = ((x - x.mean()) / x.std()).to_numpy()
    whole = group_loss(z, greedy_groups(z, 3))
    losses = [loss_of(frame, group.robust_magg(df, 3, cell=200, key="id", cols=["a", "b", "c"], exchanges=k).toPandas()) for k in (0, 1, 2)]
    assert losses == sorted(losses, reverse=True)
    assert losses[2] < 1.12 * whole, (losses, whole)


def test_groups_are_large_enough_and_dont_hang_on_partitions(spark):
    frame = sample(1001, 4)
    frame.loc[:330, ["a", "b", "c"]] = [0.5, 0.25, 1.0]  # a third of all rows are alike
    frame["word"] = "w"
    df = spark.createDataFrame(frame).withColumn("a", F.when(F.col("id") != 1000, F.col("a")))
    one, two = (group.robust_magg(t, 4, cell=60, key="id", cols=["a", "b", "c"]).toPandas().sort_values("id").reset_index(drop=True) for t in (df, df.repartition(9)))
    pd.testing.assert_frame_equal(one, two)
    assert len(one) == 1001 and one.loc[1000, "c"] == frame.loc[1000, "c"] and np.isnan(one.loc[1000, "a"])
    sizes = one[one.id != 1000].round(9).groupby(["a", "b", "c"]).size()
    assert sizes.min() >= 4
    assert np.allclose(one.loc[:999, ["b", "c"]].sum(), frame.loc[:999, ["b", "c"]].sum())


def test_columns_of_one_value_are_an_error(spark):
    with pytest.raises(ValueError):
        group.robust_magg(spark.range(5).select("id", F.lit(1.0).alias("a"), F.col("id").alias("b")), cols=["a", "b"])


def test_query_of_robust_groups_holds_on_repeated_rows(spark, tmp_path, monkeypatch):
    def found(part, name):
        part.write.parquet(f"{tmp_path}/{name}/part.parquet")
        return queries()["mask_magg_robust_groups"](spark, f"{tmp_path}/{name}").first()

    single = spark.range(60).selectExpr("id as p_partkey", "cast(id * 7 % 50 as int) as p_size", "900 + id * 13 % 60 / 10D as p_retailprice")
    copies = single.crossJoin(spark.range(6).toDF("k")).selectExpr("p_partkey + 60 * k as p_partkey", "p_size", "p_retailprice")
    one, six = found(single, "one"), found(copies, "six")
    assert one.enough and one.moved and six.enough and six.moved
    assert (six.rows, six.p_size) == (360, 6 * one.p_size) and abs(six.p_retailprice - 6 * one.p_retailprice) < 0.01
    # rows left as they are still show: where all are single, and where only some of them are
    monkeypatch.setattr(group, "robust_magg", lambda df, *_, **__: df)
    still = found(single, "still")
    assert not still.enough and not still.moved
    some = found(copies.filter("p_partkey < 60 or p_partkey % 60 >= 20"), "some")
    assert not some.enough and not some.moved
