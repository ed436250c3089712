"""Searches by the tree against all pairs, on dense towns, one hot spot, empty regions and odd rows."""

import math
import random
import statistics

import pytest

from terravane.functions import columns as C
from terravane.operators import spatial, tree

SCHEMA = "id long, lat double, lng double, price double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = [(23.1 + r.gauss(0, 0.004), 113.2 + r.gauss(0, 0.004)) for _ in range(150)]  # a dense town
    out += [(23.15, 113.3)] * 120  # a third on one spot
    out += [(22.0 + r.random() * 3, 111.0 + r.random() * 5) for _ in range(60)]
    out += [(-33.9, 18.4), (64.1, -21.9), (23.1, 113.2), (23.1 + 5 / 110.57, 113.2)]  # far away, and at about the radius
    r.shuffle(out)
    kept = [(i, a, b, float(r.choice([1, 2, 3, 5, 8, 13]) + (i % 50) * 0.25) if i % 17 else None) for i, (a, b) in enumerate(out)]
    return [*kept, (900, None, 113.0, 1.0), (901, 23.0, None, 2.0)]


@pytest.fixture(scope="module")
def spark_rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def km(a, b):
    return math.hypot(a[2] * C.KM_LNG - b[2] * C.KM_LNG, a[1] * 110.57 - b[1] * 110.57)


def placed(rows):
    return [x for x in rows if x[1] is not None and x[2] is not None]


@pytest.mark.parametrize("k", [1, 7])
def test_nearest_is_that_of_all_pairs(spark_rows, rows, k):
    got = {(r["id"], r["rank"]): r["neighbour"] for r in tree.nearest(spark_rows, spark_rows, "id", k).collect()}
    want = {}
    for a in placed(rows):
        order = sorted((round(km(a, b), 9), b[0]) for b in placed(rows) if b[0] != a[0])
        want.update({(a[0], n + 1): b for n, (_, b) in enumerate(order[:k])})
    assert got == want


def test_nearest_of_few_points_and_of_none(spark, spark_rows):
    one = spark.createDataFrame([(5, 23.0, 113.0, 1.0), (6, 23.1, 113.0, 1.0)], SCHEMA)
    assert {tuple(r)[:2] for r in tree.nearest(one, one, "id", 4).collect()} == {(5, 6), (6, 5)}
    assert tree.nearest(one.where("id = 5"), one.where("id = 5"), "id", 4).count() == 0
    assert tree.nearest(spark_rows, one.where("false"), "id", 4).count() == 0
    assert {r["neighbour"] for r in tree.nearest(spark_rows, one, "id", 1, drop_self=False).where("id < 900").collect()} == {5, 6}


@pytest.mark.parametrize("radius", [0.001, 0.4, 5.0, 300.0, 30_000.0])
def test_counts_are_those_of_all_pairs(spark_rows, rows, radius):
    got = {(r["lat"], r["lng"]): r["n"] for r in tree.counts(spark_rows, spark_rows, radius).collect()}
    assert got == {(a[1], a[2]): sum(km(a, b) <= radius for b in placed(rows)) for a in placed(rows)}


@pytest.mark.parametrize("radius", [0.4, 5.0, 300.0])
@pytest.mark.parametrize("other", [True, False])
def test_medians_are_those_of_all_pairs(spark_rows, rows, radius, other):
    got = {r["id"]: (r["n"], r["median"]) for r in tree.neighbourhood_median(spark_rows, spark_rows, "id", "price", radius, other).collect()}
    want = {}
    for a in placed(rows):
        near = [b for b in placed(rows) if km(a, b) <= radius and not (other and a[0] == b[0])]
        values = [b[3] for b in near if b[3] is not None]
        if near:
            want[a[0]] = (len(near), statistics.median(values) if values else None)
    assert got == want


def test_both_ways_of_a_neighbourhood_agree(spark_rows, monkeypatch):
    plain = {tuple(r) for r in spatial.neighbourhood_median(spark_rows, spark_rows, "id", "price").collect()}
    dense = {tuple(r) for r in spatial.poi_density(spark_rows, spark_rows.where("id % 3 = 0"), "id").collect()}
    near = {tuple(r)[:2] for r in spatial.nearest(spark_rows, spark_rows, "id", 3, 1.0).select("id", "neighbour", "rank").collect()}
    monkeypatch.setattr(spatial, "PAIRS", 0)
    assert {tuple(r) for r in spatial.neighbourhood_median(spark_rows, spark_rows, "id", "price").collect()} == plain
    assert {tuple(r) for r in spatial.poi_density(spark_rows, spark_rows.where("id % 3 = 0"), "id").collect()} == dense
    assert {tuple(r)[:2] for r in spatial.nearest(spark_rows, spark_rows, "id", 3, 1.0).select("id", "neighbour", "rank").collect()} == near
