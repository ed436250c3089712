"""Boundary rules of cleaning, geocoding, ledgers, models and pages on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from terravane.operators import attribution, cleaning, geocode, ledger, models, order, stages


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def test_places_at_the_edge_are_inside(spark):
    rows = spark.createDataFrame([(19.9, 109.4), (25.6, 117.6), (19.89, 110.0), (None, 110.0)], "lat double, lng double")
    assert [r[0] for r in rows.select(cleaning.inside(F.col("lat"), F.col("lng"))).collect()] == [True, True, False, False]


def test_reasons_come_in_their_order(spark):
    region = cleaning.Region(("gz", "sz"), {"beijing": "bj"}, ("望京", "胡同"), {"望京": ("望京灶",)}, {"gz": 100.0}, {"gz": 10.0})
    schema = "city string, community string, title string, lat double, lng double, unit_price double, url string"
    rows = [
        ("gz", None, "胡同", 40.0, 116.0, 500.0, "https://beijing.anjuke.com/x"),
        ("gz", None, "胡同", None, 116.0, 500.0, "https://beijing.anjuke.com/x"),
        ("gz", "x", "胡同", 23.0, 113.0, 500.0, "https://www.anjuke.com/x"),
        ("gz", None, "望京灶大桥", None, None, 100.0, None),
        ("gz", None, None, None, None, 100.5, "https://gz.58.com/x"),
        ("gz", None, None, None, None, 9.0, None),
        ("fs", None, None, None, None, 1.0, "https://m.anjuke.com/"),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = [r[0] for r in frame.select(cleaning.foreign_reason(frame, region)).collect()]
    assert got == ["coord_outside", "url_mismatch:bj", "text:胡同", None, "price_over_100", "price_below_10", None]


@pytest.mark.parametrize(("title", "name"), [("急售，泰安花园三房", "泰安花园"), ("万买泰安花园", "泰安花园"), ("海博熙泰三期 精装", "海博熙泰"), ("精装花园", None), ("大花园", None), (None, None), ("阳光家园花园", "阳光家园花园"), ("颐安都会中央北区公馆", "颐安都会中央北区公馆")])
def test_names_in_titles(spark, title, name):
    names = cleaning.Names(("花园", "家园", "公馆"), "买售", ("精装",), ("大花园",))
    assert one(spark, title).select(cleaning.title_community(F.col("v"), names)).first()[0] == name


@pytest.mark.parametrize(("text", "plain", "core"), [("广州，天河花园@abc", "天河花园", "天河花园"), ("广州广州 骏景花园 南向三房", "骏景花园南向三房", "骏景花园"), ("+#金色家园/出售", "金色家园出售", "金色家园"), (None, "", ""), ("家园", "家园", "家园")])
def test_addresses_for_the_geocoder(spark, text, plain, core):
    row = one(spark, text).select(cleaning.clean_address("广州", F.col("v")), cleaning.clean_address("广州", F.col("v"), True)).first()
    assert tuple(row) == (plain, core)


def test_canonical_names(spark):
    rows = spark.createDataFrame([("万科启城家园",), ("家园",), ("颐安都会中央",), ("某某三期",), (None,)], "v string")
    assert [r[0] for r in rows.select(cleaning.canonical_name(F.col("v"))).collect()] == ["万科启城", "家园", "颐安都会", "某某", None]


def test_geocoding_states(spark):
    d = spark.createDataFrame([("gz", "联洋", 1.0, 2.0, "hit", 2), ("gz", "联洋花园", 3.0, 4.0, "hit", 1), ("sz", "东城", 5.0, 6.0, "hit", 3), ("gz", "查无", None, None, "miss", 4)], "city string, community string, lat double, lng double, status string, place int")
    asked = spark.createDataFrame([("gz", "联洋"), ("gz", "新联洋花园二区"), ("gz", "东城"), ("gz", "查无"), ("gz", ""), ("gz", None), ("gz", "洋花")], "city string, community string")
    got = {r.community: (r.lat, r.status) for r in geocode.geocode(asked, d).collect()}
    assert got == {"联洋": (1.0, "hit"), "新联洋花园二区": (3.0, "hit"), "东城": (None, "pending"), "查无": (None, "miss"), "洋花": (3.0, "hit")}


def test_counterfactual_classes(spark):
    import math

    up = math.log(1.5)
    rows = [("normal", 0.0, 0.0, 0.0), ("city_drift", up, 0.0, 0.0), ("book_noise", 0.0, 0.0, up), ("either", up / 1.7, 0.0, up / 1.7), ("model", 0.0, up, 0.0), ("several", up, up, up)]
    frame = spark.createDataFrame([("sz", *r) for r in rows], "city string, want string, a1 double, a2 double, b double")
    assert all(r.want == r.category for r in attribution.counterfactual(frame, ("gz",)).collect())
    assert attribution.counterfactual(frame.where("want = 'city_drift'").withColumn("city", F.lit("gz")), ("gz",)).first().category == "city_excluded"


def test_recorded_attempts_keep_the_stored_bound(spark):
    old = spark.createDataFrame([(1, "2026-05-01", "failed", 2, 5)], "loan_id long, alert_date string, status string, attempt_count int, max_retries int")
    new = spark.createDataFrame([(1, "2026-05-01", "failed"), (2, "2026-05-01", "success")], "loan_id long, alert_date string, status string")
    got = {r.loan_id: tuple(r)[2:] for r in ledger.record_deliveries(old, new).collect()}
    assert got == {1: ("failed", 3, 5), 2: ("success", 1, 3)}


@pytest.mark.parametrize("size", [200, 1_000_000])
def test_ranks_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(order, "ROWS", size)
    rows = [(i, float(i % 50) if i % 7 else None) for i in range(3000)]
    got = {r.k: r["rank"] for r in order.with_rank(spark.createDataFrame(rows, "k int, v double").repartition(5), "v", "k").collect()}
    want = {k: n for n, (_, k) in enumerate(sorted((v, k) for k, v in rows if v is not None), 1)}
    assert {k: n for k, n in got.items() if n is not None} == want and sum(n is None for n in got.values()) == sum(v is None for _, v in rows)
    down = {r.k: r["rank"] for r in order.with_rank(spark.createDataFrame(rows, "k int, v double"), "v", "k", descending=True).where("v is not null").collect()}
    assert down == {k: n for n, (_, k) in enumerate(sorted((-v, k) for k, v in rows if v is not None), 1)}


def test_local_regression_finds_its_plane(spark):
    rows = [(i, 23.0 + (i % 10) / 200, 113.0 + (i // 10) / 200, float(i % 7), float(i % 11), 5.0 + 2.0 * (i % 7) - 3.0 * (i % 11)) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, lat double, lng double, a double, g double, y double")
    for r in models.local_least_squares(frame.limit(10), frame, "id", "a", "g", "y", 3.0).join(frame, "id").collect():
        assert r.predicted == pytest.approx(r.y, abs=1e-6)
    far = frame.limit(1).withColumn("lat", F.lit(30.0))
    assert models.local_least_squares(far, frame, "id", "a", "g", "y", 3.0).first().predicted is None


def test_calibration_ends_near_the_benchmark(spark):
    bench = spark.createDataFrame([(i, 0.1 + 0.5 * i / 300) for i in range(300)], "id int, debt double")
    people = bench.withColumn("debt", F.col("debt") * 0.8)
    moved, path = models.calibrate(people, "id", bench, ["debt"], lambda df: F.col("debt"))
    assert path[0] > 0.05 >= path[-1] and len(path) <= 21 and all(a >= b for a, b in zip(path, path[1:])) and moved.count() == 300


def test_permuted_values_are_the_same_values(spark):
    rows = spark.createDataFrame([(i, i * i) for i in range(500)], "id long, v long")
    out = models.permuted(rows, "id", "v", "s", 8)
    assert sorted(r.v for r in out.collect()) == [i * i for i in range(500)] and out.where("v = id * id").count() < 25


def test_stages_keep_their_order():
    assert [s for s, *_ in stages.run({s: lambda: None for s in stages.ORDER}, only=("alert", "etl", "risk"))] == ["etl", "risk", "alert"]
    with pytest.raises(ValueError, match="unknown"):
        stages.run({}, only=("nothing",))


def test_a_new_policy_without_a_cap_takes_the_old_one_off(spark):
    kind = "policy_id int, scope_type string, scope_value string, action string, ltv_cap double, created_at int"
    old = spark.createDataFrame([(1, "zone", "z1", "reject", 0.7, 10), (2, "city", "gz", "watch", 0.5, 11)], kind)
    new = spark.createDataFrame([(9, "zone", "z1", "watch", None, 20), (8, "city", "fs", "reject", None, 20), (7, "city", "dg", "watch", 2.5, 20)], kind)
    assert sorted(tuple(r) for r in ledger.upsert_policies(old, new).select("policy_id", "action", "ltv_cap", "created_at").collect()) == [(1, "watch", None, 10), (2, "watch", 0.5, 11)]


@pytest.mark.parametrize("size", [30, 1_000_000])
def test_equal_samples_have_chance_one(spark, monkeypatch, size):
    monkeypatch.setattr(order, "ROWS", size)
    same = spark.createDataFrame([(float(i),) for i in range(1000)], "v double")
    r = models.distribution_gap(same, same, "v").first()
    assert (r.ks, r.p_value) == (0.0, 1.0)
    # values of the limiting law's tables
    for n, at, want in ((200, 5, 1.0), (200, 10, 0.963945), (200, 16, 0.544142), (200, 28, 0.039682)):
        a = spark.createDataFrame([(float(i),) for i in range(n)], "v double")
        b = spark.createDataFrame([(float(i + at),) for i in range(n)], "v double")
        assert models.distribution_gap(a, b, "v").first().p_value == pytest.approx(want, abs=1e-3), at


def test_names_within_names_of_every_length(spark):
    import random

    rng = random.Random(2)
    name = lambda n: "".join(rng.choice("甲乙丙丁") for _ in range(n))
    entries = [("gz", name(rng.randrange(1, 41)), i) for i in range(60)] + [("gz", "阳光花园二期东区甲乙丙丁戊己", 60), ("sz", "甲", 61)]
    asked = [("gz", name(rng.randrange(1, 41))) for _ in range(120)] + [("gz", "阳光花园二期东区甲乙丙丁戊"), ("gz", "我的阳光花园二期东区甲乙丙丁戊己楼"), ("gz", "花"), ("sz", "乙丙"), ("zs", "甲")]
    known = {}
    for c, n, p in entries:
        known.setdefault((c, n), p)
    d = spark.createDataFrame([(c, n, float(p), 1.0, "hit", p) for (c, n), p in known.items()], "city string, community string, lat double, lng double, status string, place int")
    got = {(r.city, r.community): (r.lat, r.status) for r in geocode.geocode(spark.createDataFrame(asked, "city string, community string"), d).collect()}
    for c, n in set(asked):
        same = known.get((c, n))
        first = same if same is not None else min((p for (x, e), p in known.items() if x == c and (e in n or n in e)), default=None)
        assert got[c, n] == ((float(first), "hit") if first is not None else (None, "pending")), n


def test_titles_fall_back_to_the_vocabulary(spark):
    names = cleaning.Names(("花园", "家园", "公馆"), "买售", ("精装", "三居", "两居", "入住"), ("望花园",))
    known = spark.createDataFrame([("悦泰春天", "悦泰春天", 12), ("悦泰春", "悦泰春天", 12)], "name string, canonical string, n long")
    rows = [(1, "悦泰春天 3房2厅 精装"), (2, "刚需小三居 大两居 拎包入住"), (3, "望花园 精装修 三房"), (4, "泰安花园 悦泰春天"), (5, None), (6, "悦泰春 房"), (6, "悦泰春 房"), (7, "大悦泰春天城 房")]
    got = sorted((r.k, r.name) for r in cleaning.communities(spark.createDataFrame(rows, "k int, title string"), "k", names, known, ("天城",)).where("k <> 5").collect() if r.name)
    assert got == [(1, "悦泰春天"), (4, "泰安花园"), (6, "悦泰春天"), (6, "悦泰春天")]


def test_one_copy_of_the_title_parser(spark):
    names = cleaning.Names(("花园", "家园"), "买售", ("精装",), ("望花园",))
    plan = spark.createDataFrame([("a",)], "title string").select(cleaning.title_community(F.col("title"), names).alias("name"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 1


def test_strings_of_a_title_once_where_they_stand_first(spark):
    rows = spark.createDataFrame([(1, "a甲乙丙 丁甲乙丙戊，x"), (2, "甲乙"), (3, None)], "k int, title string")
    got = sorted((r.gram, r.start, r.leads, r.trails) for r in cleaning.grams(rows).collect())
    want = [("甲乙丙", 2, True, True), ("丁甲乙", 6, True, False), ("乙丙戊", 8, False, True), ("丁甲乙丙", 6, True, False), ("甲乙丙戊", 7, False, True), ("丁甲乙丙戊", 6, True, True)]
    assert got == sorted(want)
