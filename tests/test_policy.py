"""Scopes of policies and the ratios of an event, on rows at their bounds."""

from terravane.operators import dashboard, ledger

LOANS = "loan_id long, city string, lat double, lng double, ltv double, balance double, low_confidence boolean"
ZONES = "zone_id string, city string, center_lat double, center_lng double, is_high_risk_zone int"
POLICIES = "policy_id long, scope_type string, scope_value string, ltv_cap double, enabled int, updated_at int"


def _tables(spark):
    loans = [
        (1, "gz", 23.0, 113.0, 0.7, 10.0, True),  # at the cap
        (2, "gz", 23.0, 113.0, 0.8, 20.0, False),
        (3, "gz", 23.04, 113.0, 0.85, 5.0, True),  # at the line, 4.4 km away
        (4, "gz", 23.05, 113.0, 0.9, 1.0, True),  # 5.6 km away
        (5, "gz", None, None, None, 2.0, True),
        (6, None, 23.0, 113.0, 0.95, None, None),
    ]
    zones = [("a", "gz", 23.0, 113.0, 0), ("b", "sz", 22.0, 114.0, 1), ("c", "sz", None, None, 1)]
    return spark.createDataFrame(loans, LOANS), spark.createDataFrame(zones, ZONES)


def test_policies_cover_their_scope_and_are_listed_in_order(spark):
    loans, zones = _tables(spark)
    policies = [(1, "city", "gz", 0.7, 1, 3), (2, "zone", "a", None, 1, 9), (3, "zone", "b", 0.1, 0, 9), (4, "zone", "gone", 0.1, 1, 3), (5, "city", None, None, 1, 1)]
    got = dashboard.policy_list(spark.createDataFrame(policies, POLICIES), loans, zones).collect()
    assert [(r["policy_id"], r["in_scope"], r["hit"], r["newly_hit"], r["low_confidence"]) for r in got] == [
        (2, 4, 4, 3, 2), (4, 0, 0, 0, 0), (1, 5, 3, 2, 2), (5, 0, 0, 0, 0), (3, 0, 0, 0, 0),
    ]


def test_zones_by_risk_and_cover(spark):
    loans, zones = _tables(spark)
    got = [(r["zone_id"], r["loans"], r["balance"]) for r in dashboard.zone_cover(zones, loans).collect()]
    assert got == [("b", 0, 0.0), ("c", 0, 0.0), ("a", 4, 35.0)]


def test_event_passes_at_its_bounds(spark):
    def day(d, city_ltvs, others):
        return [(d, "gz", x) for x in city_ltvs] + [(d, "sz", x) for x in others]

    rows = day(1, [0.9] * 10, [0.8] * 10) + day(2, [1.0] * 13, [0.8] * 17) + day(3, [1.0] * 13, [0.8] * 17) + day(4, [], [0.5]) + day(5, [2.0], [None])
    got = {r["day"]: tuple(r)[1:] for r in ledger.event_ratios(spark.createDataFrame(rows, "day int, city string, ltv double"), "gz").collect()}
    assert got == {1: (None, None, None, False), 2: (1.1111, 1.5, 1.3, True), 3: (1.0, 1.0, 1.0, False), 4: (None, 0.0, 0.0, False), 5: (None, None, None, False)}


def test_price_drop_without_rows(spark):
    none = spark.createDataFrame([], "id int, original_price double")
    now = spark.createDataFrame([(1, 2.0)], "id int, true_market_price double")
    assert tuple(ledger.price_drop(none, now, "id").first()) == (0, None, None, None, None)
