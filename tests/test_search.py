"""Branches of the exhaustive search that run side by side."""

import time

import pytest
from pyspark.sql import functions as F

from veilwork.errors import LessThanOrEqualToZeroError
from veilwork.plans import search


def run(spark, branches, masks=3, wait=0.0, **options):
    df = spark.range(40).select("id", F.col("id").alias("x"))

    def add(df, by):
        return df.withColumn("x", F.floor((F.col("x") * 3 + by) / (by + 1)))

    def score(df):
        time.sleep(wait)
        return df.select("x").distinct().count() / 40

    s = search.ExhaustiveSearch(df, [{"add": {"by": i + 1}} for i in range(masks)], [{"score": {}}], functions={"add": add, "score": score}, branches=branches, **options)
    began = time.perf_counter()
    best = s.optimize()
    took = time.perf_counter() - began
    return [tuple(map(str, r)) for r in s.log.frame(spark).orderBy("step").collect()], sorted(map(tuple, best.collect())), took


@pytest.mark.parametrize("options", [{}, {"num_perms": 5}, {"iters": 7}, {"size_perms": 2}, {"theta": 0.5}, {"iters": 0}, {"return_best": False}])
def test_the_log_is_the_same_for_any_number_of_branches(spark, options):
    log, best, _ = run(spark, 1, **options)
    assert (log, best) == run(spark, 4, **options)[:2] == run(spark, 50, **options)[:2]


def test_branches_run_side_by_side(spark):
    run(spark, 1)
    one, four = run(spark, 1, wait=1.0), run(spark, 4, wait=1.0)
    assert one[:2] == four[:2] and four[2] < 0.75 * one[2]


def test_an_error_comes_with_its_order(spark):
    df, seen = spark.range(5), []

    def fails(df):
        raise ValueError("no")

    def same(df):
        return df

    masks = [{same: {}}, {same: {}}, {fails: {}}]
    s = search.ExhaustiveSearch(df, masks, [{(lambda df: df.count() / 10): {}}], callback=lambda i, f: seen.append(i))
    with pytest.raises(ValueError, match="no"):
        s.optimize()
    assert seen == [1, 2]  # the third step of the first order fails
    with pytest.raises(LessThanOrEqualToZeroError):
        search.ExhaustiveSearch(df, masks, [{(lambda df: 0.5): {}}], branches=0)
