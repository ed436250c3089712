"""Registered queries against DuckDB, and the boundary rules of the platform."""

import pytest
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators import dashboard, reporting, risk, spatial
from terravane.operators.merge import inserted_and_updated, upsert
from terravane.plans import registry
from terravane.streaming import changes
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", [k for k, (_, sql) in registry.ALL.items() if sql])
def test_query_equals_its_statement(spark, duck, name):
    query, sql = registry.ALL[name]
    assert compare(spark, duck, query, sql, DATA) == ""


def enrich(spark, balance=5e6, price=1e7, missing=0.0, risky=0, avm=None, **kw):
    loans = spark.createDataFrame([(1, 1, 501, balance)], "loan_id long, customer_id long, collateral_id long, balance double")
    c = spark.createDataFrame([(501, price, missing, risky, avm)], "collateral_id long, true_market_price double, missing_pct double, is_high_risk_zone int, avm_value double")
    return risk.enrich(loans, c, **kw).first()


def test_alert_lines_are_exclusive(spark):
    assert enrich(spark, balance=7.5e6).alert_level is None and enrich(spark, balance=7.501e6).alert_level == "warn"
    assert enrich(spark, balance=8.5e6).alert_level == "warn" and enrich(spark, balance=8.501e6).alert_level == "strong"
    assert enrich(spark, balance=8500040.0).alert_level == "warn" and enrich(spark, balance=8500040.0, round_first=False).alert_level == "strong"


def test_confidence_and_missing_values(spark):
    assert not enrich(spark, missing=75.0).low_confidence and enrich(spark, missing=75.01).low_confidence
    assert enrich(spark, balance=9e6, missing=80.0).alert_level is None
    nothing = enrich(spark, price=None)
    assert nothing.market_valuation == 0.0 and nothing.ltv is None and nothing.risk_class == "次级"
    lone = risk.enrich(spark.createDataFrame([(1, 9, 5.0)], "loan_id long, collateral_id long, balance double"), spark.createDataFrame([], "collateral_id long, true_market_price double, missing_pct double, is_high_risk_zone int")).first()
    assert lone.risk_class == "损失" and lone.low_confidence and not lone.alert and lone.market_valuation is None


def test_zone_and_deviation_rules(spark):
    assert enrich(spark, balance=1e6, risky=1).risk_class == "关注" and enrich(spark, balance=8e6, risky=1).risk_class == "次级"
    assert not enrich(spark, avm=1.3e7).abnormal_valuation and enrich(spark, avm=1.31e7).abnormal_valuation
    assert enrich(spark).valuation_deviation_pct is None and enrich(spark).model_version == "unknown"


def test_reconciliation_tolerances(spark):
    five = [(c, i, 10, 100.0, 0.2) for i, c in enumerate(C.CLASSES)]
    make = lambda rows: spark.createDataFrame(rows, "risk_class string, class_rank int, loan_count long, balance double, balance_pct double")
    near = [(c, r, n, b + 0.01 * (r == 0), p) for c, r, n, b, p in five]
    assert reporting.reconcile(make(five), make(five), make(near)).count() == 0
    more = [(c, r, n + (r == 2), b, p) for c, r, n, b, p in five]
    assert {x.mismatch for x in reporting.reconcile(make(five), make(five), make(more)).collect()} == {"report_vs_detail:次级:loan_count", "detail_vs_summary:次级:loan_count"}
    with pytest.raises(Exception, match="unknown class"):
        reporting.checked(spark.createDataFrame([("odd",)], "risk_class string")).collect()


def test_summary_has_all_classes_and_no_rows(spark):
    rows = risk.class_summary(spark.createDataFrame([], "risk_class string, balance double")).collect()
    assert len(rows) == 5 and all(r.loan_count == 0 and r.balance_pct == 0 for r in rows)


def test_addresses_and_urls(spark):
    rows = [("广州市天河区体育西路 1 号", "天河", "体育西路"), ("中山市西区街道颐和公馆13号", "西区", "颐和公馆"), ("惠州市惠城区惠城123号", "惠城", "惠城"), ("合成地址1", None, None), ("", None, None), (None, None, None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "a string").select("a", C.district(F.col("a")).alias("d"), C.community(F.col("a")).alias("c")).collect()
    assert [tuple(r) for r in got] == rows
    keys = spark.createDataFrame([("",), (None,), ("http://[bad",)], "u string").select(C.url_key(F.col("u")).alias("k")).collect()
    assert keys[0].k == keys[1].k == "md5:d41d8cd98f00b204e9800998ecf8427e" and all(len(r.k) < 64 for r in keys)


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "k int, v string, w string")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"]).collect()) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert tuple(inserted_and_updated(old, new, ["k"]).first()) == (1, 1)
    assert {tuple(r) for r in upsert(upsert(old, new, ["k"]), new, ["k"]).collect()} == {tuple(r) for r in upsert(old, new, ["k"]).collect()}


def test_zone_rules(spark):
    points = [(f"c{i}", "gz", 23.131, 113.321, 100.0) for i in range(20)] + [(f"d{i}", "gz", 23.151, 113.321, 75.0 if i else 75.0) for i in range(19)]
    zones = spatial.price_zones(spark.createDataFrame(points, "id string, city string, lat double, lng double, unit_price double")).collect()
    assert len(zones) == 1 and zones[0].samples == 20
    valued = spark.createDataFrame([(0.85,), (0.85,), (0.85,), (None,)], "ltv double").withColumns({"lat": F.lit(23.131), "lng": F.lit(113.321)})
    zone = spatial.ltv_zones(valued).first()
    assert zone.samples == 3 and zone.is_high_risk_zone == 0


def test_migration_counts_only_matched_pairs(spark):
    snaps = spark.createDataFrame([("2026-01-01", 1, "正常"), ("2026-01-01", 2, "正常"), ("2026-02-01", 1, "关注"), ("2026-03-01", 1, "关注"), ("2026-03-01", 2, "损失")], "snap_date string, loan_id int, risk_class string")
    rows = {(r.from_date, r.risk_class): (r.base, r.down) for r in dashboard.roll_rates(snaps).collect()}
    assert rows == {("2026-01-01", "正常"): (1, 1), ("2026-02-01", "关注"): (1, 0)}


def test_delete_wins_and_full_equals_incremental(spark):
    log = spark.createDataFrame([("loan", "UPDATE", 1), ("loan", "DELETE", 1), ("loan", "INSERT", 2), ("collateral", "UPDATE", 7), ("loan", "UPDATE", None)], "table_name string, event_type string, entity_id long")
    loans = spark.createDataFrame([(1, 7, 1), (2, 8, 1), (3, 7, 2), (4, 9, 3)], "loan_id long, collateral_id long, customer_id long")
    plan = changes.plan_impact(log, loans)
    assert {(r.loan_id, r.action) for r in plan.collect()} == {(1, "delete"), (2, "recalc"), (3, "recalc")}
    compute = lambda df: df.select("loan_id", (F.col("loan_id") * 10).alias("v"))
    after = changes.recompute(compute(loans), plan, loans, compute)
    assert sorted(after.collect()) == sorted(compute(loans.where("loan_id <> 1")).collect())


def test_stream_replay_changes_nothing(spark, tmp_path):
    log = spark.createDataFrame([(1, "loan", "UPDATE", 5, 90.0), (2, "loan", "DELETE", 5, 99.0), (3, "loan", "INSERT", 6, 85.0), (4, "customer", "UPDATE", 5, 99.0)], "id long, table_name string, event_type string, entity_id long, balance double")
    log.withColumn("cdc_ts", F.current_timestamp()).write.parquet(f"{tmp_path}/log")
    dimension = lambda: spark.createDataFrame([(5, 100.0), (6, 100.0)], "loan_id long, market_valuation double")
    for checkpoint in ("a", "a", "b"):
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/log").schema).parquet(f"{tmp_path}/log")
        changes.run_alerts(stream, dimension, f"{tmp_path}/inbox", f"{tmp_path}/{checkpoint}").awaitTermination(120)
        assert [(r.event_id, r.ltv, r.risk_class) for r in spark.read.parquet(f"{tmp_path}/inbox").collect()] == [(1, 0.9, "可疑")]
