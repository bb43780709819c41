import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwork.core import with_position, with_ranks
from veilwork.errors import DataTypeError, InputError, LessThanOrEqualToZeroError, NotInRangeError
from veilwork.operators import group, noise, recode
from veilwork.sources import tables


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(600).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)) / 7).alias("b"))


def test_rounding_goes_to_even(spark):
    df = frame(spark, [(2.5,), (3.5,), (float("nan"),), (None,)], "x double")
    assert values(recode.rounding(df, decimals=True), "x") == [2.0, 4.0, None, None]
    assert values(recode.rounding(frame(spark, [(1250.0,), (1350.0,)], "x double"), 2), "x") == [1200.0, 1400.0]


def test_top_and_bottom_take_nulls_and_the_cutoff(spark):
    df = frame(spark, [(1.0,), (5.0,), (None,), (float("nan"),), (9.0,)], "x double")
    assert values(recode.top_recode(df, 5, 7), "x") == [1.0, 7.0, 7.0, 7.0, 7.0]
    assert values(recode.bottom_recode(df, 5), "x") == [5.0, 5.0, 5.0, 5.0, 9.0]
    with pytest.raises(InputError):
        recode.topbot_recode(df, "middle")


@pytest.mark.parametrize(("idx", "end", "side"), [(0, None, None), (1, 3, None), (-2, None, None), (2, None, "start"), (2, None, "end"), (0, None, "end"), (1, None, "both"), (0, None, "both"), (-3, -1, None), (9, None, None)])
def test_truncate_is_a_python_slice(spark, idx, end, side):
    texts = ["Female", "", "ab", None]
    expected = {None: lambda t: t[idx:end], "start": lambda t: t[idx:], "end": lambda t: t[0:-idx], "both": lambda t: t[idx:-idx]}[side]
    df = frame(spark, [(t,) for t in texts], "x string")
    assert values(recode.truncate(df, idx=idx, end=end, trim_from=side), "x") == [None if t is None else expected(t) for t in texts]


def test_truncate_by_a_literal(spark):
    df = frame(spark, [("a.b.c",), ("abc",), (None,), ("x\\Ey.z",)], "x string")
    assert values(recode.truncate(df, "match", match="."), "x") == ["a", "abc", None, "x\\Ey"]
    assert values(recode.truncate(df, "match", match=".", keep_before=False), "x") == ["b.c", "abc", None, "z"]
    assert values(recode.truncate(df, "match", match="\\E"), "x")[3] == "x"


def test_substitute(spark):
    df = frame(spark, [("Big big house",), ("bigger",), (None,)], "x string")
    assert values(recode.substitute(df, "big", "X"), "x") == ["Big X house", "bigger", None]
    assert values(recode.substitute(df, "big", "X", ignore_case=True), "x")[0] == "X X house"
    assert values(recode.substitute(df, "big", "X", substring=True), "x")[1] == "Xger"
    assert values(recode.substitute(df, "big", "X", substring=True, replace_all=True), "x")[:2] == ["X", "X"]
    assert values(recode.substitute(df, "*", "X"), "x") == ["X"] * 3
    n = frame(spark, [(1,), (2,), (None,)], "x int")
    assert values(recode.substitute(n, [1, 2], [2, 3]), "x") == [3, 3, None]
    with pytest.raises(InputError):
        recode.substitute(n, [1, 2], [2, 3, 4])


def test_hashing(spark):
    import hashlib

    df = frame(spark, [("39",), (None,), ("é",)], "x string")
    for name in ("md5", "sha1", "sha256", "sha512", "blake2b", "sha3_256"):
        assert values(recode.hashing(df, name, salt="s"), "x") == [hashlib.new(name, (t + "s").encode()).hexdigest() if t else None for t in ("39", None, "é")]
    assert values(recode.hashing(df, lambda b: b.decode()[::-1]), "x") == ["93", None, "é"]
    assert values(recode.hashing(df, "shake_128"), "x")[0] == hashlib.shake_128(b"39").hexdigest(16)
    with pytest.raises(InputError):
        recode.hashing(df, "nothing")
    with pytest.raises(InputError):
        recode.hashing(df, salt=[1])


def test_bin_labels(spark):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("x"))
    assert values(recode.global_recode(df, 5), "x")[::2] == ["(0.99, 2.8]", "(2.8, 4.6]", "(4.6, 6.4]", "(6.4, 8.2]", "(8.2, 10.0]"]
    assert values(recode.global_recode(df, list(range(0, 12, 2))), "x")[:3] == ["(-0.001, 2.0]", "(-0.001, 2.0]", "(2.0, 4.0]"]
    assert "".join(values(recode.global_recode(df, 3, labels="ABC"), "x")) == "AAAABBBCCC"
    assert values(recode.global_recode(df, [2, 5], labels=["m"]), "x") == [None, "m", "m", "m", "m", None, None, None, None, None]
    assert values(recode.global_recode(df, 2, labels="ba", ints=True), "x") == [1] * 5 + [0] * 5
    for m in ("equidistant", "log_equidistant", "quantiles", "magnitude"):
        assert None not in values(recode.global_recode(df, 4, m), "x")
    with pytest.raises(InputError):
        recode.global_recode(df, 2, "odd")


def test_noise_moments(numbers):
    sd, mean = (numbers.agg(f("a")).first()[0] for f in (F.stddev, F.avg))
    plain = noise.add_noise(numbers, "additive", magnitude=50, key="id", cols="a")
    both = numbers.join(plain.select("id", F.col("a").alias("n")), "id").agg(F.stddev(F.col("n") - F.col("a"))).first()[0]
    assert abs(both / (0.5 * sd) - 1) < 0.1
    centred = noise.add_noise(numbers, "additive", magnitude=50, centered=True, key="id", cols="a").agg(F.avg("a"), F.stddev("a")).first()
    assert abs(centred[0] / mean - 1) < 0.1 and abs(centred[1] / sd - 1) < 0.1


def test_noise_is_the_same_under_any_partitioning(numbers):
    one, many = (noise.add_noise(numbers.repartition(n), "additive", key="id", cols=["a", "b"]) for n in (1, 8))
    for a, b in zip(sorted(one.collect()), sorted(many.collect()), strict=True):
        assert np.allclose(a, b, rtol=1e-12)  # sums of the fit differ in the last bit


def test_correlated_noise_keeps_a_perfect_correlation(spark):
    df = frame(spark, [(float(i), float(10 - i)) for i in range(1, 10)], "a double, b double")
    out = noise.add_noise(df, "correlated", magnitude=50)
    assert abs(out.agg(F.corr("a", "b")).first()[0] + 1) < 1e-9
    with pytest.raises(InputError):
        noise.add_noise(df, "correlated", cols="a")


def test_restricted_and_outlier_noise(numbers, spark):
    out = noise.add_noise(numbers, "restricted", magnitude=20, cols="a")
    assert abs(out.agg(F.avg("a")).first()[0] - numbers.agg(F.avg("a")).first()[0]) < 1e-9
    same = numbers.join(noise.add_noise(numbers, "outliers", key="id", cols=["a", "b"]).select("id", F.col("a").alias("n")), "id")
    assert 0 < same.filter("a <> n").count() < 60
    with pytest.raises(InputError):
        noise.add_noise(frame(spark, [(1.0,)], "x double"), "restricted", magnitude=500)
    with pytest.raises(InputError):
        noise.add_noise(numbers, "other")


def test_robust_centre_uses_every_row(spark):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(size=(12_000, 2)) @ [[3, 1], [0, 2]], np.tile([1.0, 1.0], (8_000, 1)), rng.normal(40, 1, (4_000, 2))])
    df = frame(spark, data.tolist(), "a double, b double")
    mean, cov = noise.robust_centre(df, ["a", "b"])
    far = np.einsum("ij,jk,ik->i", data - mean, np.linalg.inv(cov), data - mean)
    half = data[np.argsort(far, kind="stable")[: (len(data) + 3) // 2]]
    assert np.allclose(half.mean(axis=0), mean, atol=1e-4)
    assert abs(np.median(far) - noise.chi2_quantile(0.5, 2)) < 1e-4
    assert np.allclose(cov / cov[0, 0], np.cov(half.T) / np.cov(half.T)[0, 0], atol=1e-4)
    again = noise.robust_centre(df.repartition(7), ["a", "b"])
    assert np.allclose(again[0], mean) and np.allclose(again[1], cov)


def test_pram(spark):
    df = spark.range(4000).select("id", F.when(F.pmod("id", F.lit(4)) == 0, "a").when(F.pmod("id", F.lit(4)) == 1, None).otherwise("b").alias("c"))
    out = noise.pram(df, "c", key="id")
    before, after = (Counter(values(t, "c")) for t in (df, out))
    assert after[None] == before[None] and set(after) == {"a", "b", None}
    assert abs(after["a"] / before["a"] - 1) < 0.1
    stay = noise.pram(df, "c", key="id", alpha=0)
    assert Counter(values(stay, "c")) == before
    swap = noise.pram(df, "c", key="id", probs={"c": np.array([[0.0, 1], [1, 0]])})
    assert Counter(values(swap, "c"))["a"] == before["b"]
    with pytest.raises(NotInRangeError):
        noise.pram(df, "c", alpha=2)
    with pytest.raises(InputError):
        noise.pram(df.withColumn("c", F.lit("a")), "c")


def test_geometric(numbers, spark):
    out = noise.geometric(numbers, ["a", "b"], key="id")
    assert out.count() == 600 and out.join(numbers.withColumnRenamed("a", "x"), "id").filter("a = x").count() < 5
    with pytest.raises(InputError):
        noise.geometric(spark.range(5).select(F.lit(1.0).alias("a"), F.lit(1.0).alias("b")))


def test_global_order(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id")
    placed = with_position(df, [F.col("v"), F.col("id")]).orderBy("_pos").collect()
    assert [r._pos for r in placed] == list(range(1000)) and [(r.v, r.id) for r in placed] == sorted((r.v, r.id) for r in placed)
    all_ = sorted(values(df, "v"))
    for r in with_ranks(df, "v").limit(50).collect():
        assert (r._r_n, r._r_c, r._r_d) == (all_.index(r.v), all_.count(r.v), len(set(all_[: all_.index(r.v)])))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=4, max_size=40), st.integers(1, 4))
def test_sequential_chunks(spark, xs, aggr):
    df = frame(spark, list(enumerate(xs)), "id int, x int").withColumn("x", F.col("x").cast("double"))
    got = {r.id: r.x for r in group.sequential_magg(df, aggr, key="id", cols="x").collect()}
    for i in range(len(xs)):
        part = xs[i // aggr * aggr : i // aggr * aggr + aggr]
        assert math.isclose(got[i], sum(part) / len(part), abs_tol=1e-9)


def test_microaggregation(numbers):
    for method, more in (("robust", {"cols": ["a", "b"]}), ("ranking", {"cols": "a"}), ("advanced", {"cols": ["a", "b"], "reduct": "pca"})):
        out = group.microaggregation(numbers, method, aggr=3, key="id", **more)
        assert out.count() == 600 and out.columns == numbers.columns
        assert abs(out.agg(F.avg("a")).first()[0] - numbers.agg(F.avg("a")).first()[0]) < 0.5
    sizes = group.microaggregation(numbers, "robust", aggr=3, key="id", cols=["a", "b"]).groupBy("a", "b").count()
    assert sizes.agg(F.min("count")).first()[0] >= 3
    with pytest.raises(InputError):
        group.microaggregation(numbers, "other")
    with pytest.raises(LessThanOrEqualToZeroError):
        group.sequential_magg(numbers, 0)
    with pytest.raises(NotInRangeError):
        group.quantile_magg(numbers, 10_000, cols="a")
    with pytest.raises(InputError):
        group.advanced_magg(numbers, cols="a")


def test_shuffle_keeps_values_and_the_tie(spark):
    df = spark.range(500).select("id", (F.col("id") * 1.0).alias("p"), (F.col("id") * 2 + F.pmod(F.xxhash64("id"), F.lit(40))).cast("double").alias("s"))
    out = group.shuffle(df, "s", "p", key="id")
    assert sorted(values(out, "s")) == sorted(values(df, "s"))
    assert out.agg(F.corr("p", "s")).first()[0] > 0.9
    with pytest.raises(InputError):
        group.shuffle(df, "s", "s")
    with pytest.raises(NotImplementedError):
        group.shuffle_by_model(df)


def test_local_suppression(spark):
    rows = [(1, "x", "f"), (1, "x", "g"), (2, "y", "f")]
    df = frame(spark, rows, "zip int, nation string, disease string")
    out = {(r.zip, r.disease): r.nation for r in group.local_suppression(df, "nation", "disease", "NA", risk_threshold=0.6).collect()}
    assert out == {(1, "f"): "x", (1, "g"): "x", (2, "f"): "NA"}
    assert values(group.local_suppression(df, "nation", "disease", "NA", risk_threshold=0.0), "nation") == ["NA"] * 3
    with pytest.raises(NotInRangeError):
        group.local_suppression(df, "nation", "disease", "NA", risk_threshold=2)
    with pytest.raises(InputError):
        group.local_suppression(df, "none", "disease", "NA")


def test_columns_are_checked(spark):
    df = frame(spark, [("a",)], "x string")
    with pytest.raises(DataTypeError):
        recode.rounding(df)
    with pytest.raises(InputError):
        recode.rounding(df, cols="y")


def test_generated_tables(spark):
    b = tables.binary_table(spark, 400)
    assert b.filter("Label <> Perc_0").count() == 0 and 100 < b.filter("Label <> Perc_40").count() < 220
    n = tables.numeric_table(spark)
    assert n.count() == 1000 and len(n.columns) == 7 and all(abs(r[1] - 5 * (1 + r.Label)) < 1 for r in n.groupBy("Label").avg("STDEV_0_5").collect())
    made = tables.l_diverse_table(spark, [1, 3, 5], columns=2)
    assert sorted(r.d for r in made.groupBy("col_0").agg(F.count_distinct("sensitive").alias("d")).collect()) == [1, 3, 5]
    assert tables.t_close_table(spark, [3, 4, 5, 6, 8, 11, 7, 9, 10], columns=2).groupBy("col_0").count().filter("count = 3").count() == 3
    changed = tables.change_categories(b.withColumn("id", F.monotonically_increasing_id()), "Perc_0", 0.25, "id")
    assert changed.filter("Perc_0 <> Label").count() == 100
    with pytest.raises(NotInRangeError):
        tables.change_categories(b, "Perc_0", 2)
    assert tables.geometric_sequence() == [0.5, 1, 2, 4, 8, 16]
