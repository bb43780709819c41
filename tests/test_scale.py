"""What the masks and metrics share at scale: orders, running sums, draws, caches; and the options that queries don't show."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork import core
from veilwork.errors import InputError
from veilwork.functions.keyed import normal, uniform
from veilwork.operators import group, noise, recode, risk, utility
from veilwork.plans import cache, encode, models, ranking, search
from veilwork.sources import tables


def test_running_sums_and_ranks(spark):
    rng = np.random.default_rng(0)
    x, w = rng.integers(0, 40, 500), rng.normal(size=500)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(x, w, strict=True))], "i long, x long, w double").repartition(7)
    order = np.lexsort((np.arange(500), x))
    rows = {r.i: r for r in core.with_running(df, [F.col("x"), F.col("i")], {"s": F.col("w"), "n": F.lit(1).cast("long")}).collect()}
    before = np.concatenate([[0], np.cumsum(w[order])[:-1]])
    for k, i in enumerate(order.tolist()):
        assert abs(rows[i].s - before[k]) < 1e-9 and (rows[i].n, rows[i].n_all) == (k, 500) and abs(rows[i].s_all - w.sum()) < 1e-9
    for r in core.with_ranks(df, "x").collect():
        assert (r._r_n, r._r_c, r._r_d) == ((x < r.x).sum(), (x == r.x).sum(), len(set(x[x < r.x].tolist())))
    assert core.with_running(df.limit(0), [F.col("x")], {"s": F.col("w")}).count() == 0


def test_draws_are_digits_of_a_digest(spark):
    rows = spark.range(2000).select("id", uniform(F.col("id"), "c", 7).alias("u"), normal(F.col("id"), "c", 7).alias("z")).collect()
    for r in rows[:50]:
        d = hashlib.md5(f"{r.id}|c|7".encode()).hexdigest()
        u, v = ((int(d[a : a + 13], 16) + 0.5) / 2**52 for a in (0, 13))
        assert r.u == u and math.isclose(r.z, math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v), abs_tol=1e-12)
    u, z = np.array([r.u for r in rows]), np.array([r.z for r in rows])
    assert abs(u.mean() - 0.5) < 0.03 and abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.06


def test_no_window_over_a_whole_table(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("y", (F.col("c_custkey") % 3 == 0).cast("int"))
    for df in (utility.roc_points(c, "y", "c_acctbal"), core.with_ranks(c, "c_acctbal")):
        assert "SinglePartition" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [1, 100_000])
def test_distances_of_any_domain(spark, most):
    rng = np.random.default_rng(1)
    k, s = rng.integers(0, 6, 900), np.round(rng.normal(size=900), 2)
    s[k == 2] += 1
    rows = [(int(a), float(b)) for a, b in zip(k, s, strict=True)] + [(0, None), (9, 3.5)]
    df = spark.createDataFrame(rows, "k int, s double")
    domain = np.unique([b for _, b in rows if b is not None])
    share = lambda v: np.searchsorted(np.sort(v), domain, side="right") / len(v)
    whole = share([b for _, b in rows if b is not None])
    found = {r.k: (r.rows, r.emd) for r in risk.closeness_classes(df, "s", "numeric", "k", most=most).collect()}
    assert set(found) == {0, 1, 2, 3, 4, 5, 9}
    for c, (n, emd) in found.items():
        own = [b for a, b in rows if a == c and b is not None]
        assert n == len(own) and abs(emd - np.abs(share(own) - whole).sum() / (len(domain) - 1)) < 1e-9


def test_kendall_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 25, 300)
    b = a // 2 + rng.integers(0, 9, 300)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(None, 1)], "a int, b int")
    s = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
    tau = s.sum() / math.sqrt((a[:, None] != a).sum() * (b[:, None] != b).sum())
    assert abs(group.kendall(df, "a", "b") - tau) < 1e-12
    assert group.kendall(df.limit(0), "a", "b") == 0.0 and group.kendall(df.withColumn("a", F.lit(1)), "a", "b") == 0.0


@pytest.mark.parametrize("method", ["spearman", "pearson", "kendall"])
def test_shuffled_values_follow_the_scores(spark, sf, method):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    out = group.shuffle(p, "p_retailprice", "p_size", method, key="p_partkey", scores=True)
    rows, old = out.collect(), [r.p_retailprice for r in p.collect()]
    rows.sort(key=lambda r: (r.score_p_retailprice, r.p_partkey))
    assert [r.p_retailprice for r in rows] == sorted(old)
    assert sum(r.p_retailprice != q for r, q in zip(sorted(rows, key=lambda r: r.p_partkey), [r.p_retailprice for r in p.orderBy("p_partkey").collect()], strict=True)) > len(old) / 2


def test_quantiles_between_two_values(spark):
    x = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    for kind, method in {"linear": "linear", "lower": "lower", "higher": "higher", "midpoint": "midpoint", "nearest": "nearest"}.items():
        for q in (0.0, 0.3, 0.6, 0.99, 1.0):
            assert abs(noise.quantiles(df, ["x"], q, kind)[0] - np.quantile(x, q, method=method)) < 1e-9
    with pytest.raises(InputError):
        noise.quantiles(df, ["x"], 0.5, "other")


def test_roots_of_covariances():
    for cov in ([[4.0, 2.0], [2.0, 3.0]], [[1.0, -1.0], [-1.0, 1.0]], [[0.0, 0.0], [0.0, 2.0]], np.diag([1.0, 2.0, 3.0]) + 1):
        root = noise.lower_root(np.array(cov))
        assert np.allclose(root @ root.T, cov) and np.allclose(root, np.tril(root))


def test_rotation_turns_in_every_plane():
    turn = noise.rotation(4, 33)
    assert np.allclose(turn @ turn.T, np.eye(4)) and np.abs(turn).min() > 0.01
    a = math.radians(20)
    assert np.allclose(noise.rotation(2, 20), [[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])


def test_categories_have_a_bound(spark, monkeypatch):
    df = spark.range(60).select("id", F.col("id").cast("string").alias("c"), (F.col("id") % 2).alias("s"))
    monkeypatch.setattr(noise, "MOST_CATEGORIES", 50)
    with pytest.raises(InputError):
        noise.pram(df, "c", key="id")
    with pytest.raises(InputError):
        tables.change_categories(df, "c", 0.5, key="id", most=50)
    with pytest.raises(InputError):
        encode.category_vectors(df, "c", "s", most=100)


def test_models_are_kept_by_the_content_of_their_rows(spark, tmp_path):
    rows, folder = tables.binary_table(spark, 300), str(tmp_path / "models")
    first = models.train(rows, ["Perc_10", "Perc_40"], "Label", "rfclass", cache=folder)
    again = models.train(rows.orderBy(F.desc("Perc_40")), ["Perc_10", "Perc_40"], "Label", "rfclass", cache=folder)
    assert isinstance(again, PipelineModel) and first.uid == again.uid and models.auc(again, rows, "Label") > 0.8
    assert len(cache.entries(spark, folder).collect()) == 1
    models.train(rows.filter("Perc_0 = 1"), ["Perc_10"], "Perc_40", "rfclass", cache=folder)
    found = cache.entries(spark, folder).collect()
    assert {r.name for r in found} == {"rfclass"} and len(found) == 2 and all(r.bytes > 0 for r in found)
    assert models.train(rows, ["Perc_10", "Perc_40"], "Label", "rfclass", cache=folder, retrain=True).uid != first.uid
    made = []
    for _ in range(2):
        kept = cache.kept(folder, "table", rows, lambda: made.append(1) or rows.limit(5), DataFrame)
        assert kept.count() == 5
    assert made == [1]
    with pytest.raises(InputError):
        cache.entry_path(folder, "a/b", rows)


def test_regressors_are_searched(spark):
    rows = tables.numeric_table(spark, 200).withColumn("y", F.col("STDEV_1_0") * 3 if "STDEV_1_0" in tables.numeric_table(spark, 10).columns else F.col("STDEV_0_5") * 3)
    x = [c for c in rows.columns if c.startswith("STDEV")][:2]
    model = models.train(rows, x, "y", "tpotreg")
    rfreg = models.train(rows, x, "y", "rfreg")
    error = lambda m: m.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert type(model.stages[-1]).__name__ == "LinearRegressionModel" and error(model) < error(rfreg)


def test_independent_component(spark):
    rows = spark.range(2000).select("id", uniform(F.col("id"), "a", 1).alias("a"), normal(F.col("id"), "b", 1).alias("b"))
    rows = rows.select("id", "a", (F.col("a") * 3 + F.col("b")).alias("x"), (F.col("a") - F.col("b")).alias("y"))
    made = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows)
    assert abs(group.independent_component(made, 2, 0).stat.corr("a", "component")) > 0.97
    for reduct in ("ipca", "fica"):
        out = group.advanced_magg(rows, 4, reduct=reduct, key="id", cols=["x", "y"])
        assert out.count() == 2000 and out.select("x").distinct().count() == 500


def test_permuted_rows_meet_each_other_once(spark):
    rows = spark.range(101).select(F.col("id").alias("_pos"), (F.col("id") * 7).alias("x"))
    met = ranking.permuted(rows, ["x"], 101, [3]).collect()
    assert sorted(r._other_x for r in met) == [7 * i for i in range(101)] and sum(r.x == r._other_x for r in met) < 10


def test_forest_scores_by_permutation(spark):
    rows = spark.range(600).select((F.col("id") % 10).cast("double").alias("a"), uniform(F.col("id"), "noise", 1).alias("b"), (F.col("id") % 10 > 4).cast("double").alias("_y"))
    found = ranking.forest_scores(rows, ["a", "b"], True, trees=10, repeats=3)
    assert found["a"][1] == "yes" and found["a"][0] > found["b"][0]


def test_searches_of_a_configuration(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 1.7).alias("x"))
    functions = {"rounding": recode.rounding, "values": lambda df: df.select("x").distinct().count() / 50}
    config = {"mitigations": [{"rounding": {"magnitude": 1, "cols": "x"}}], "metrics": [{"values": {}}], "optimizations": {"exhaustive": None}}
    (tmp_path / "more.json").write_text(json.dumps({"optimizations": {"iterative": {"iters": 2}, "incremental": {"iters": 1, "retry": 2}}}, indent=1))
    runs = search.from_config(df, config, str(tmp_path / "more.json"), functions=functions)
    assert [type(r) for r in runs] == [search.IterativeSearch, search.IncrementalSearch] and runs[0].iters == 2
    runs[0].optimize()
    assert runs[0].log.frame(spark).orderBy("step").collect()[1].fitness < 0.5
    for bad in ({"metrics": []}, config | {"optimizations": {"other": {}}}):
        with pytest.raises(InputError):
            search.from_config(df, bad, functions=functions)


def test_a_folder_is_needed_on_a_cluster(spark):
    assert core.new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("n", [300, 5000])
def test_ranking_by_all_methods(spark, n):
    """A column that tells, one that tells a little and noise: all four methods, for a class and for a number."""
    rows = spark.range(n).select(
        F.rand(1).alias("tells"), F.rand(2).alias("little"), F.rand(3).alias("noise"), F.rand(4).alias("_e")
    ).select("tells", "little", "noise", (F.col("tells") + 0.3 * F.col("little") + 0.2 * F.col("_e") > 0.75).cast("int").alias("y"), (3 * F.col("tells") + F.col("_e")).alias("z"))
    for target in ("y", "z") if n == 300 else ("y",):
        table = rows.drop("z" if target == "y" else "y").withColumnRenamed(target, "target")
        table = table.withColumn("target", F.col("target").cast("int" if target == "y" else "double"))
        found = ranking.explore_key_variables(table, "target", preprocessed=True)
        ranked = found["ranking"].collect()
        assert [c for c in found["ranking"].columns[2:]] == list(ranking.METHODS)
        best = ranked[0]
        assert best.variable == "tells" and best.include == "yes" and all(isinstance(best[m], float) for m in ranking.METHODS)
        noise = next(r for r in ranked if r.variable == "noise")
        assert noise.include != "yes" and noise.boruta < best.boruta and noise.stepwise <= best.stepwise
    if n == 300:
        scores = ranking.boruta_scores(ranking._prepared(rows, ["tells", "noise"], "y", True), ["tells", "noise"], True, trees=10, rounds=3)
        assert scores["tells"][0] == 1.0 and isinstance(scores["noise"][0], float)
        assert ranking.elimination_scores(ranking._prepared(rows, ["tells", "noise"], "z", False), ["tells", "noise"], False)["tells"][1] == "yes"
