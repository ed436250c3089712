"""Loads that fail leave what was there; snapshots, report files and optional inputs."""

import json

import pytest
from pyspark.sql import functions as F

from terravane.operators import spatial
from terravane.sources import outputs


def rows(spark, n, start=0):
    return spark.range(start, start + n).select("id", (F.col("id") % 2).alias("odd"))


def test_a_load_that_fails_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert outputs.refill(rows(spark, 10), path, "t") == 10
    with pytest.raises(RuntimeError, match="t: 5 rows loaded of 6"):
        outputs.refill(rows(spark, 5, 100), path, "t", expected=6)
    broken = rows(spark, 5).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("bad row")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="bad row"):
        outputs.refill(broken, path, "t")
    assert spark.read.parquet(path).count() == 10
    assert outputs.refill(rows(spark, 3, 50), path, "t", expected=3) == 3
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [50, 51, 52]
    assert outputs.refill(rows(spark, 0), path, "t") == 0 and spark.read.parquet(path).count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_an_upload_holds_one_day(spark, tmp_path):
    target = f"{tmp_path}/objects"
    lake = spark.createDataFrame([("a", "sale", "2026-05-01"), ("b", "rent", "2026-05-01"), ("c", "sale", "2026-05-02")], "k string, type string, dt string")
    assert {(r.type, r.n) for r in outputs.upload(lake, "2026-05-01", target).collect()} == {("sale", 1), ("rent", 1)}
    with pytest.raises(RuntimeError, match="no snapshot of 2026-05-09"):
        outputs.upload(lake, "2026-05-09", target)
    assert spark.read.parquet(target).count() == 2
    outputs.upload(lake, "2026-05-02", target)
    assert [(r.k, r.type) for r in spark.read.parquet(target).collect()] == [("c", "sale")]


def test_a_snapshot_follows_its_risk_run(spark, tmp_path):
    path = f"{tmp_path}/snap"
    state = rows(spark, 4).withColumn("made", F.lit("2026-05-02"))
    with pytest.raises(Exception, match="has not been made"):
        outputs.keep_day(state, path, F.lit("2026-05-03"), F.col("made"))
    outputs.keep_day(state, path, F.lit("2026-05-02"), F.col("made"))
    outputs.keep_day(rows(spark, 1), path, F.lit("2026-05-01"))
    outputs.keep_day(state.limit(2), path, F.lit("2026-05-02"), F.col("made"))
    got = spark.read.parquet(path).groupBy(F.col("snap_date").cast("string").alias("d")).agg(F.count("*").alias("n"), F.sum("is_demo").alias("demo")).collect()
    assert sorted(tuple(r) for r in got) == [("2026-05-01", 1, 0), ("2026-05-02", 2, 0)]


def test_optional_inputs(spark, tmp_path):
    doc = {"source": "s", "features": {"income_monthly": [1.0, 2.0], "debt_ratio": [0.1, 0.2], "credit_score": [600.0, 700.0]}}
    (tmp_path / "good.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "bad.json").write_text('{"source": ')
    (tmp_path / "empty.json").write_text("")
    people = outputs.benchmark(spark, f"{tmp_path}/good.json").collect()
    assert [tuple(r) for r in people] == [(0, 1.0, 0.1, 600.0), (1, 2.0, 0.2, 700.0)]
    assert all(outputs.optional_json(spark, f"{tmp_path}/{n}.json", "source string") is None for n in ("bad", "empty", "absent"))


def test_caps(spark):
    table = rows(spark, 9)
    assert outputs.capped(table, "id", None).count() == 9 and [r.id for r in outputs.capped(table, "id", 3).collect()] == [0, 1, 2]


def test_overview_figures_beside_all(spark):
    zones = spark.createDataFrame([("gz", "price", 5, 1), ("gz", "ltv", 7, 0), ("sz", "price", 2, 1)], "city string, zone_type string, sample_count int, is_high_risk_zone int")
    got = {(r.level, r.city, r.zone_type): tuple(r)[3:] for r in spatial.overview(zones, "gz").collect()}
    assert got["all", None, None] == (3, 2, 14, 2, 1, 12) and got["city", "sz", None] == (1, 1, 2, 0, 0, 0)
    assert spatial.overview(zones, None, "ltv").where("level = 'all'").first().picked == 1
    plan = spatial.overview(zones)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    with pytest.raises(ValueError, match="zone_type"):
        spatial.overview(zones, zone_type="x")
