import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.errors import InputError
from veilwork.plans import angles, models


def plain_lasso(gram, target, penalty, steps=20000):
    """Coordinate descent of 1/2 b'Gb - t'b + penalty |b|."""
    b = np.zeros(len(target))
    for _ in range(steps):
        old = b.copy()
        for j in range(len(b)):
            r = target[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - penalty, 0) / gram[j, j]
        if np.abs(b - old).max() < 1e-14:
            break
    return b


def correlated(seed, n=300, p=6):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) @ r.normal(size=(p, p))
    y = x @ r.normal(size=p) + r.normal(size=n)
    x = (x - x.mean(0)) / x.std(0)
    return x, y, x.T @ x / n, x.T @ (y - y.mean()) / n


@pytest.mark.parametrize("seed", range(25))
def test_path_equals_coordinate_descent_at_and_between_knots(seed):
    _, _, gram, target = correlated(seed)
    knots = angles.path(gram, target)
    sizes = [k for k, _ in knots]
    assert sizes == sorted(sizes, reverse=True) and abs(sizes[-1]) < 1e-9
    for size in [*sizes, *[(a + b) / 2 for a, b in zip(sizes, sizes[1:], strict=False)]]:
        b = angles.at_penalty(knots, size)
        left = target - gram @ b
        assert np.abs(left).max() <= size + 1e-9  # the conditions that only the lasso's answer fulfils
        assert np.allclose(left[b != 0], size * np.sign(b[b != 0]), atol=1e-9)
        if np.linalg.cond(gram) < 100:  # beyond, the descent stops before its end
            assert np.allclose(b, plain_lasso(gram, target, size), atol=1e-8)
    assert np.allclose(knots[-1][1], np.linalg.solve(gram, target), atol=1e-8)


def test_some_paths_drop_columns():
    """Coefficients that return to 0 are among those tested."""
    drops = 0
    for seed in range(25):
        _, _, gram, target = correlated(seed)
        betas = [b for _, b in angles.path(gram, target)]
        drops += any(((a != 0) & (b == 0)).any() for a, b in zip(betas, betas[1:], strict=False))
    assert drops


def test_columns_repeated_constant_or_tied():
    x, y, gram, target = correlated(3)
    twice = np.block([[gram, gram], [gram, gram]])
    found = angles.path(twice, np.concatenate([target, target]))
    b = found[-1][1]
    assert np.allclose(b[:6] + b[6:], np.linalg.solve(gram, target), atol=1e-7)
    still = np.zeros((7, 7))
    still[:6, :6] = gram
    assert np.allclose(angles.path(still, np.append(target, 0.0))[-1][1], np.append(np.linalg.solve(gram, target), 0), atol=1e-8)
    assert np.allclose(angles.path(np.eye(3), np.array([1.0, 1.0, -1.0]))[-1][1], [1, 1, -1])
    assert [b.tolist() for _, b in angles.path(np.eye(2), np.zeros(2))] == [[0, 0]]
    assert len(angles.path(np.zeros((0, 0)), np.zeros(0))) == 1


def test_moments_of_folds_add_up_and_cross_validation_equals_a_plain_one(spark):
    x, y, _, _ = correlated(5, n=400)
    y = y + 1e6  # a far mean
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)]
    names = [f"f.{i}" for i in range(6)]
    ticked = [f"`{c}`" for c in names]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [*names, "y"])).select(*[F.col(c).alias(c.replace(".", "_").strip("`")) for c in ticked], "y")
    names = [c.replace(".", "_") for c in names]
    parts = angles.fold_moments(df, names, "y", 4)
    whole = angles.total(parts)
    both = np.column_stack([x, y])
    assert whole.n == 400 and np.allclose(whole.cov, np.cov(both.T, bias=True), rtol=1e-8, atol=1e-6)
    folded = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(1234), *names, "y"), F.lit(4))).toPandas()
    found = angles.lasso_path(df, names, "y", 4)

    def error(size):
        out = 0.0
        for k in range(4):
            a, b = folded[folded.fold != k], folded[folded.fold == k]
            m, s = a[names].mean(), a[names].std(ddof=0)
            z = ((a[names] - m) / s).to_numpy()
            t = z.T @ (a.y - a.y.mean()).to_numpy() / len(a)
            beta = plain_lasso(z.T @ z / len(a), t, size)
            out += ((b.y - a.y.mean() - ((b[names] - m) / s).to_numpy() @ beta) ** 2).sum()
        return out

    best = error(found.penalty)
    assert all(best <= error(k) * (1 + 1e-7) for k, _ in found.knots)
    again = angles.lasso_path(df.repartition(7), names, "y", 4)
    assert np.allclose(again.coefficients, found.coefficients, atol=1e-8)
    got = df.select("y", found.column().alias("p")).toPandas()
    assert ((got.y - got.p) ** 2).mean() < 1.2


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0), (float("nan"), 9.0), (4.0, None)], "a double, y double")
    found = angles.lasso_path(df, ["a"], "y", 1)
    assert np.allclose([found.coefficients[0], found.intercept], [2, 0])
    assert df.filter("a is null").select(found.column().alias("p")).first().p is None
    assert angles.knots_table(df.limit(0), ["a"], "y").count() == 0
    with pytest.raises(InputError):
        angles.lasso_path(df.limit(0), ["a"], "y")


def test_model_is_saved_and_loaded(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 7).alias("a"), F.col("id").alias("odd name"), (F.col("id") * 3 - F.col("id") % 7).alias("y"))
    for _ in range(2):
        model = models.train(df, ["a", "odd name"], "y", "larscv", cache=str(tmp_path))
        off = model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
        assert off < 1e-6
