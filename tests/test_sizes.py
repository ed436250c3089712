"""What only shows on large tables: sums of many digits, large numbers, dense neighbourhoods."""

import math
import random
import statistics

import duckdb
import pytest

from terravane.functions import columns as C
from terravane.operators import models, reporting, spatial, tiles
from terravane.plans import registry
from tests.oracle import compare


def test_a_cent_of_a_large_book_is_within_the_tolerance(spark):
    make = lambda *off: spark.createDataFrame([(c, i, 10, 274_877_906_944.35 * (i + 1) + d, 0.2) for i, (c, d) in enumerate(zip(C.CLASSES, off))], "risk_class string, class_rank int, loan_count long, balance double, balance_pct double")
    plain = make(0.0, 0.0, 0.0, 0.0, 0.0)
    assert reporting.reconcile(make(0.01, 0.01, -0.01, 0.0, -0.01), make(0.01, 0.01, -0.01, 0.0, -0.01), plain).count() == 0
    two = {x.mismatch for x in reporting.reconcile(make(0.02, 0.0, 0.0, 0.0, 0.0), plain, plain).collect()}
    assert two == {"report_vs_summary:正常:balance", "report_vs_detail:正常:balance"}


def test_ratios_at_a_half_are_rounded_as_the_statement_does(spark, tmp_path):
    # balance and price whose ratio's text ends in a half, or just under one, while ten thousand times the ratio does not
    pairs = [(150104.37, 278616.0), (361609.22, 219990.4), (440034.72, 237696.0), (485113.05, 243000.0), (450662.61, 274920.0), (260533.26, 299894.4)]
    spark.createDataFrame([(i, i, "n", 1, m / (200 + i)) for i, (_, m) in enumerate(pairs)], "p_partkey long, p_size int, p_name string, x int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    loans = spark.createDataFrame([(i, i, b, "1995-01-01") for i, (b, _) in enumerate(pairs)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string")
    loans.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    query, sql = registry.ALL["files_masked_csv"]
    assert compare(spark, con, query, sql, str(tmp_path)) == "" and query(spark, str(tmp_path)).count() == 6


@pytest.fixture(scope="module")
def town(spark):
    """A dense town, one spot with many rows, lone places, rows without a place or a value."""
    r = random.Random(5)
    places = [(23.1 + r.gauss(0, 0.02), 113.2 + r.gauss(0, 0.02)) for _ in range(200)] + [(23.15, 113.3)] * 60 + [(22.0 + r.random() * 2, 112.0 + r.random() * 2) for _ in range(60)] + [(-33.9, 18.4), (64.1, -21.9)]
    rows = [(i, a, b, float(r.choice([1, 2, 3, 5, 8]) + i % 50 * 0.25) if i % 17 else None, float(i % 7), float(i % 11)) for i, (a, b) in enumerate(places)]
    rows += [(900, None, 113.0, 1.0, 1.0, 1.0), (901, 23.0, float("nan"), 2.0, 1.0, 2.0)]
    return rows, spark.createDataFrame(rows, "id long, lat double, lng double, price double, a double, g double")


def km(a, b):
    return math.hypot((a[2] - b[2]) * C.KM_LNG, (a[1] - b[1]) * 110.57)


@pytest.mark.parametrize(("points", "work"), [(12_000, 1_000_000_000), (20, 500)])
def test_tiles_are_those_of_all_pairs_and_form_no_rows_of_pairs(spark, town, monkeypatch, points, work):
    # the second case has narrow tiles, and several tasks for the queries of one
    monkeypatch.setattr(tiles, "POINTS", points)
    monkeypatch.setattr(tiles, "WORK", work)
    rows, frame = town
    known = [x for x in rows if x[1] is not None and not math.isnan(x[2])]
    got = {r.id: (r.neighbours, r.neighbourhood) for r in spatial.neighbourhood_median(frame, frame, "id", "price", 3.0, 4).collect()}
    assert len(got) == len(rows) and got[900] == got[901] == (0, None)
    prices = {r.id: r for r in spatial.neighbour_prices(frame, frame, "id", "price", 1.0, (1, 6, 30)).collect()}
    assert len(prices) == len(known)
    for a in known:
        near = [b for b in known if b[0] != a[0] and km(a, b) <= 3.0]
        values = [b[3] for b in near if b[3] is not None]
        assert got[a[0]] == (len(near), statistics.median(values) if len(near) >= 4 and values else None)
        order = [b for _, _, b in sorted((round(km(a, b), 9), b[0], b) for b in known if b[0] != a[0])]
        assert prices[a[0]].nearest_km == pytest.approx(km(a, order[0]), abs=1e-9)
        for k in (1, 6, 30):
            values = [b[3] for b in order[:k] if b[3] is not None]
            assert prices[a[0]][f"median_{k}"] == (statistics.median(values) if values else None)
    plan = spatial.neighbourhood_median(frame, frame, "id", "price", 3.0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan and "Window" not in plan


def test_local_sums_by_tiles_are_those_of_all_pairs(town):
    rows, frame = town
    known = [x for x in rows if x[1] is not None and not math.isnan(x[2])]
    dealt = tiles.Tiles(frame.select("id", "lat", "lng"), frame.select("lat", "lng", "price", "a"), 4.0)
    got = {r.id: r for r in tiles.weighted_sums(dealt, ["id"], {"w": [], "y": ["price"], "ay": ["a", "price"]}, 2.0).collect()}
    assert set(got) == {x[0] for x in known}
    for q in known:
        near = [(math.exp(-((km(q, p) / 2.0) ** 2)), p) for p in known if km(q, p) <= 4.0]
        assert got[q[0]].n == len(near) and got[q[0]].w == pytest.approx(sum(w for w, _ in near))
        priced = [(w, p) for w, p in near if p[3] is not None]
        assert (got[q[0]].y is None) == (not priced)
        if priced:
            assert got[q[0]].y == pytest.approx(sum(w * p[3] for w, p in priced)) and got[q[0]].ay == pytest.approx(sum(w * p[3] * p[4] for w, p in priced))


def test_nearest_of_fewer_points_than_asked_for(spark, town):
    _, frame = town
    few = frame.where("id in (0, 1, 900)")
    assert {tuple(r)[:2] for r in spatial.nearest(few, few, "id", 4, 1.0).collect()} == {(0, 1), (1, 0)}


def test_local_regression_forms_no_rows_of_pairs(town):
    _, frame = town
    plan = models.local_least_squares(frame, frame, "id", "a", "g", "price", 3.0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan and "q_id" not in plan


def forms_no_pairs(spark, name):
    plan = registry.ALL[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    return "FlatMapCoGroups" in plan and "p_unit_price" not in plan


def test_local_regression_query_forms_no_rows_of_pairs(spark):
    assert forms_no_pairs(spark, "model_local_regression")


def test_collateral_features_query_forms_no_rows_of_pairs(spark):
    assert forms_no_pairs(spark, "spatial_collateral_features")


def test_features_query_forms_no_rows_of_pairs(spark):
    assert forms_no_pairs(spark, "spatial_features")


def test_neighbour_prices_are_kept_once_for_each_place(spark):
    # what a round writes is one row for each place, not one for each of its neighbours
    assert "rank" not in registry.ALL["spatial_neighbour_prices"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
