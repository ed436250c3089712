"""Percentiles by selection against Spark's own, on skewed groups and on one group of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import selection

SHARES = {"low": 0.005, "q1": 0.25, "mid": 0.5, "high": 0.995}


def same(rows, keys, shares=None):
    shares = shares or SHARES
    got = {tuple(r[k] for k in keys): tuple(r)[len(keys) :] for r in selection.percentiles(rows, keys, "v", **shares).collect()}
    want = rows.where("v is not null").groupBy(*keys).agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(s)).alias(n) for n, s in shares.items()])
    want = {tuple(r[k] for k in keys): tuple(r)[len(keys) :] for r in want.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][0] == v[0] and got[k][1:] == pytest.approx(v[1:], rel=1e-12), k


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice([0.0, 1.0, rng.gauss(0, 1), rng.expovariate(0.01)])) for _ in range(40_000)]
    rows += [(f"k{rng.randrange(300)}", rng.choice([None, rng.random()])) for _ in range(2000)] + [(None, 1.0), (None, 3.0), ("none", None), ("one", 7.0)]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("small", [0, 10, 10_000])
def test_groups(skewed, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL", small)
    same(skewed, ["k"])


def test_one_group_of_all_rows(spark, skewed):
    same(skewed, [])
    wide = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"), F.lit("a").alias("k"))
    same(wide, ["k"])
    same(wide, [], {"mid": 0.5})


def test_few_values_of_a_large_group_are_ordered(spark):
    wide = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    bounds = wide.agg(F.percentile_approx("v", [0.4998, 0.5002], selection.ACCURACY)).first()[0]
    assert wide.where(F.col("v").between(*bounds)).count() < 400


def test_bounds_that_fail_are_mended(skewed, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 0)
    monkeypatch.setattr(selection.F, "percentile_approx", lambda c, at, n: F.array(*[F.min(c)] * len(at)))
    same(skewed, ["k"])


def test_empty(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert selection.medians(none, ["k"], "v").count() == 0
