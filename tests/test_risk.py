import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.errors import InputError, NotInRangeError
from veilwork.operators import recode, risk, utility
from veilwork.plans import encode, models, ranking, search, sensitivity
from veilwork.sources import tables
from veilwork.streaming import reports


def near(a, b):
    return math.isclose(a, b, abs_tol=1e-6)


def test_k_anonymity_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, s int")
    assert near(risk.k_anonymity(df, "k", 1), 1 / 3)
    assert risk.k_anonymity_rows(df, "k", 1).count() == 3
    assert not risk.is_k_anonymous(df, "k", 1) and risk.is_k_anonymous(df.filter("k = 'a'"), "k", 1)
    with pytest.raises(ZeroDivisionError):
        risk.k_anonymity(df, "k", 1, "s", "nothing")


def test_l_diversity(spark):
    assert near(risk.l_diversity(tables.l_diverse_table(spark, 2), "sensitive", 3), 1.0)
    assert near(risk.l_diversity(tables.l_diverse_table(spark, [2, 3, 3, 2, 2]), "sensitive", 2), 0.6)
    assert risk.is_l_diverse(tables.l_diverse_table(spark, 2), "sensitive", 2)
    nulls = spark.createDataFrame([("a", None), ("a", None), ("a", 1)], "k string, s int")
    assert risk.diversity_classes(nulls, "s").first().diversity == 2
    with pytest.raises(ValueError):
        risk.l_diversity(nulls, "s", method="odd")


def test_t_closeness_examples(spark):
    salaries = tables.t_close_table(spark, [3, 4, 5, 6, 8, 11, 7, 9, 10])
    found = sorted(r.emd for r in risk.closeness_classes(salaries, "sensitive").collect())
    assert all(near(a, b) for a, b in zip(found, [1 / 6, 0.236111111, 0.375], strict=True))
    letters = tables.t_close_table(spark, list("ABCABACCB"))
    found = sorted(r.emd for r in risk.closeness_classes(letters, "sensitive", "categorical").collect())
    assert all(near(a, b) for a, b in zip(found, [0, 1 / 3, 1 / 3], strict=True))
    assert near(risk.t_closeness(letters, "sensitive", 0.0, "categorical"), 1.0)
    assert not risk.is_t_close(letters, "sensitive", 0.1) and risk.is_t_close(letters, "sensitive", 0.5)
    one = tables.t_close_table(spark, [5, 5, 5])
    assert risk.closeness_classes(one, "sensitive").first().emd == 0
    with pytest.raises(ValueError):
        risk.t_closeness(letters, "sensitive", datatype="odd")


def test_beta_likeness(spark):
    letters = tables.t_close_table(spark, list("ABCABACCB"))
    assert near(risk.beta_likeness(letters, "sensitive", 1e-9), 4 / 9)
    assert risk.is_beta_like(letters, "sensitive", 100)
    with pytest.raises(InputError):
        risk.beta_likeness(letters, "sensitive", 0)


def test_individual_risk_against_the_series(spark):
    df = spark.createDataFrame([(f, F_) for f in (1.0, 2.0, 3.0, 9.0) for F_ in (f, 2 * f, 10 * f)], "f double, g double")
    for r in df.withColumn("exact", risk.exact_risk(F.col("f"), F.col("g"))).collect():
        p, term, total = r.f / r.g, 1.0, 0.0
        for j in range(5000):
            total += term / (r.f + j)
            term *= (r.f + j) / (j + 1) * (1 - p)
        expected = 1 / r.f if r.f == r.g else p**r.f * total
        assert r.f == 2 or abs(r.exact / expected - 1) < 1e-3
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, s int")
    assert sorted(x.risk for x in risk.individual_risk(t, "s", "k").collect()) == [0.5, 0.5, 1.0]
    with pytest.raises(NotInRangeError):
        risk.individual_risk(t, "s", "k", qual=0)
    with pytest.raises(InputError):
        risk.individual_risk(t, "s", "none")


def test_utility_on_equal_tables(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("x"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("c"))
    assert utility.jensen_shannon(df, df) == 0
    assert utility.proportion_different(df, df, "id").first().share == 0
    nulls = df.withColumn("x", F.lit(None).cast("long"))
    assert near(utility.proportion_different(nulls, nulls, "id").first().share, 0.5)
    far = utility.jensen_shannon_columns(df.select("id"), df.select((F.col("id") + 1000).alias("id"))).first().distance
    assert near(far, 1.0)
    with pytest.raises(InputError):
        utility.jensen_shannon(df, df.drop("c"))
    with pytest.raises(InputError):
        utility.propensity_score(df, df, method="odd")


def test_drift_raises_scores(spark):
    base = spark.range(1000).select(F.lit(0).alias("x"))
    scores = [utility.jensen_shannon(base, spark.range(1000).select((F.col("id") < 1000 * r).cast("int").alias("x"))) for r in (0, 0.3, 0.6, 1)]
    assert scores == sorted(scores) and scores[-1] > 0.99


def test_encoders(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("a", 0, "y"), (None, 1, "x"), ("c", 0, "y")], "c string, n int, s string")
    assert sorted(r.c for r in encode.label_encode(df).collect()) == [0, 1, 2, 3]
    out = encode.embed(df.withColumn("c", F.coalesce("c", F.lit("b"))).union(df), "s")
    assert out.columns[0] == "s" and len([c for c in out.columns if c.startswith("c_")]) == 6
    assert out.select([c for c in out.columns if c.startswith("c_")]).distinct().count() == 4
    with pytest.raises(ValueError):
        encode.embed(df, "c")
    with pytest.raises(InputError):
        encode.encoder("odd")


def test_models_and_ranking(spark):
    rows = tables.binary_table(spark, 600)
    assert models.auc(models.train(rows, ["Perc_0"], "Label", "logreg"), rows, "Label") == 1.0
    assert utility.auc_score(rows, rows, "Label", "rfclass") == 1.0
    found = ranking.explore_key_variables(rows, "Label", methods=("rf", "stepwise"))["ranking"].collect()
    assert found[0].variable == "Perc_0" and found[0].include == "yes"
    assert ranking.explore_key_variables(rows, "One_Cat") == {}
    assert models.task(rows, "Label") == "binary"


def test_sobol_indices_of_a_known_function(spark):
    params = sensitivity.Parameters(("x", "y", "z"), ((-math.pi, math.pi),) * 3)
    table = sensitivity.samples(params, 2048, spark=spark)
    assert table.count() == 2048 * 8
    f = F.sin("x") + 7 * F.pow(F.sin("y"), F.lit(2)) + 0.1 * F.pow("z", F.lit(4)) * F.sin("x")
    got = {(r.kind, r.names): r.value for r in sensitivity.analyze(lambda t: t.withColumn("prediction", f), params, table, resamples=5).collect()}
    for key, value in {("S1", "x"): 0.314, ("S1", "y"): 0.442, ("S1", "z"): 0.0, ("ST", "x"): 0.558, ("S2", "x,z"): 0.244}.items():
        assert abs(got[key] - value) < 0.05
    with pytest.raises(InputError):
        sensitivity.samples(params, 8, method="sample", spark=spark)


def run(spark, kind, value=None, **options):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, b int")
    functions = {"round": recode.rounding, "top": recode.top_recode, "zero": lambda df: 0, "one": lambda df: 1, "sum": lambda df: df.agg(F.sum("b")).first()[0] / 60}
    masks = [{"round": {"magnitude": 2, "cols": "b"}}, {"top": {"cutoff": 2, "cols": "a"}}]
    s = kind(df, masks, [{value or "one": {}}], functions=functions, **options)
    out = s.optimize()
    return s, out


def test_searches(spark):
    s, out = run(spark, search.IterativeSearch, iters=3)
    assert len(s.log.rows) == 4 and out.count() == 3 and s.log.frame(spark).count() == 4
    assert len(run(spark, search.IterativeSearch, "zero", iters=5)[0].log.rows) == 1
    assert len(run(spark, search.IterativeSearch, iters=9, reuse_mutations=False)[0].log.rows) == 3
    s, _ = run(spark, search.IncrementalSearch, iters=9, retry=2)
    assert len(s.log.rows) == 3
    s, out = run(spark, search.StochasticSearch, "sum", iters=6)
    assert out.agg(F.sum("b")).first()[0] == 0
    s, _ = run(spark, search.ExhaustiveSearch)
    assert len(s.log.rows) == 5 and s.log.rows[-1]["perm_num"] == 2
    _, fitness, log = search.apply_and_evaluate(out, [], [{lambda df: 0.5: {}}])
    assert fitness == 0.5 and log.count() == 1


def test_search_errors(spark):
    from veilwork import errors

    for kind, options, error in (
        (search.IterativeSearch, {"iters": -1}, errors.LessThanZeroError),
        (search.IterativeSearch, {"theta": 2}, errors.NotInRangeError),
        (search.IncrementalSearch, {"retry": 0}, errors.LessThanOrEqualToZeroError),
        (search.StochasticSearch, {"alpha": 2}, errors.NotInRangeError),
        (search.ExhaustiveSearch, {"num_perms": 0}, errors.LessThanOrEqualToZeroError),
    ):
        with pytest.raises(error):
            run(spark, kind, **options)
    df = spark.range(2)
    with pytest.raises(errors.SumNotEqualToOneError):
        search.Search(df, [{"a": {}, "p": 0.4}], [])
    with pytest.raises(ValueError):
        search.Search(df, [{"a": {}, "p": 0.4}, {"b": {}}], [])
    assert search.even_split(3) == [0.34, 0.33, 0.33]
    bad = search.IterativeSearch(df, [{lambda df: 1: {}}], [{lambda df: 1: {}}], iters=1, exit_on_error=False)
    bad.optimize()
    assert bad.log.rows[1]["error_log"]


def test_masks_and_reports_on_streams(spark, sf):
    mask = recode.Mask({"value": F.bround("value", -1)})
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = reports.masked_stream(stream, mask).writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("masked").count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_points_are_those_of_sobols_sequence(spark):
    numbers = sensitivity.direction_numbers(10)
    rows = spark.range(1024).select("id", *[sensitivity.sobol_point(F.col("id"), v, 10).alias(f"x{j}") for j, v in enumerate(numbers)]).orderBy("id").collect()
    got = np.array([r[1:] for r in rows])
    # published: the first points of the first five dimensions
    known = [[0] * 5, [0.5] * 5, [0.75, 0.25, 0.25, 0.25, 0.75], [0.25, 0.75, 0.75, 0.75, 0.25], [0.375, 0.375, 0.625, 0.875, 0.375]]
    assert got[:5, :5].tolist() == known
    plain = np.zeros((1024, 10), np.int64)  # one point from the one before, by the digit that changes
    for i in range(1, 1024):
        low = ((i - 1) ^ i).bit_length() - 1
        plain[i] = plain[i - 1] ^ np.array([v[low] for v in numbers])
    assert np.array_equal(got, plain / 2.0**sensitivity.BITS)
    for j in range(10):  # each dimension meets every interval of 1/1024 once
        assert sorted((got[:, j] * 1024).astype(int)) == list(range(1024))


def test_directions_beyond_the_published_ones(spark):
    numbers = sensitivity.direction_numbers(60)
    assert len({tuple(v) for v in numbers}) == 60 and numbers[:10] == sensitivity.direction_numbers(10)
    assert [len(sensitivity._primitive(s)) for s in range(1, 9)] == [1, 1, 2, 2, 6, 6, 18, 16]
    assert all(a in sensitivity._primitive(s) for s, a, _ in sensitivity.DIRECTIONS)
    for v in numbers:
        top = [x >> (sensitivity.BITS - 8) for x in v[:8]]
        points = {0}
        for x in top:
            points |= {p ^ x for p in points}
        assert len(points) == 256
