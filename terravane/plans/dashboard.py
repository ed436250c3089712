"""Dashboard, policy and migration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators import dashboard, risk, spatial
from terravane.plans.risk import BASE, ENRICHED, RANK, enriched
from terravane.sources.adapter import CITIES, oracle, view, views
from terravane.sources.shared import stored

HISTOGRAM = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.85]
DEVIATIONS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4]


def _wide(spark, sf_dir):
    c = view(spark, sf_dir, "collateral").select("collateral_id", "city", "property_addr", "lat", "lng", "area")
    return enriched(spark, sf_dir).join(c, "collateral_id", "left")


def kpis(spark, sf_dir):
    return enriched(spark, sf_dir).agg(
        F.count("*").alias("loans"), C.money(F.col("balance")).alias("balance"), F.count_if("alert").alias("alerts"), F.count_if(F.col("alert_level") == "strong").alias("strong"),
        F.round(F.avg("ltv"), 6).alias("avg_ltv"), F.count_if("low_confidence").alias("low_confidence"),
    )


def ltv_histogram(spark, sf_dir):
    return enriched(spark, sf_dir).where("ltv is not null").groupBy(dashboard.bucket(F.col("ltv"), HISTOGRAM).alias("bucket")).agg(F.count("*").alias("n"))


def city_distribution(spark, sf_dir):
    city = F.coalesce(C.city_in(F.col("property_addr"), CITIES, prefix=True), F.lit("未标注"))
    return _wide(spark, sf_dir).groupBy(city.alias("city")).agg(F.count("*").alias("n"), C.money(F.col("balance")).alias("balance"))


def _alerts(spark, sf_dir):
    e = enriched(spark, sf_dir).where("alert")
    batch = e.select("loan_id", F.lit("batch").alias("src"), "ltv", "alert_level", F.col("origination_date").alias("alert_date"))
    stream = e.where("loan_id % 5 = 0").select("loan_id", F.lit("stream").alias("src"), "ltv", F.col("origination_date").alias("alert_date"))
    return batch.unionByName(stream, allowMissingColumns=True)


def alert_page(spark, sf_dir):
    """Second page of the merged alerts with their confirmations."""
    alerts = _alerts(spark, sf_dir)
    confirmed = alerts.where("loan_id % 3 = 0 and src = 'batch'").select("loan_id", "src", F.when(F.col("loan_id") % 2 == 0, "confirmed").otherwise("odd").alias("raw"))
    status = F.when(F.col("raw").isin("pending", "confirmed", "disposed"), F.col("raw")).otherwise("pending").alias("status")
    page = alerts.join(confirmed, ["loan_id", "src"], "left").orderBy(F.desc("alert_date"), F.desc("loan_id"), "src").offset(20).limit(20)
    label = F.when(F.lower(F.trim("alert_level")) == "warn", "警示级").when(F.lower(F.trim("alert_level")) == "strong", "强预警级").otherwise("—")
    return page.select("loan_id", "src", "ltv", "alert_date", label.alias("label"), status)


def npl_by_zone_flag(spark, sf_dir):
    rows = enriched(spark, sf_dir).withColumn("high", F.coalesce("is_high_risk_zone", F.lit(0)))
    sides = F.array(F.when(F.col("high") == 1, "high").otherwise("normal"), F.lit("total"))
    return dashboard.npl_groups(rows.withColumn("side", F.explode(sides)), "side")


def policy(spark, sf_dir):
    rows = _wide(spark, sf_dir).select("loan_id", "lat", "lng", "ltv", "balance", "low_confidence")
    return dashboard.policy_impact(rows, spatial.price_zones(view(spark, sf_dir, "place"), side=0.2, least=3), 0.7)


def policy_list(spark, sf_dir):
    """Policies of all cities and price zones, some without a cap, and one of a zone that is not there."""
    places = view(spark, sf_dir, "place")
    zones = stored(spatial.price_zones(places, side=0.2, least=3), "zones")
    cities = places.groupBy("city").agg(F.count("*").alias("n")).select(F.lit("city").alias("scope_type"), F.col("city").alias("scope_value"), "n")
    scopes = zones.select(F.lit("zone").alias("scope_type"), F.col("zone_id").alias("scope_value"), F.col("samples").alias("n")).unionByName(cities)
    n = F.col("n")
    lost = F.when((F.col("scope_type") == "zone") & (n % 11 == 0), F.concat("scope_value", F.lit("-gone"))).otherwise(F.col("scope_value"))
    cap = F.when(n % 3 != 0, (n % 5 + 5) / 10)
    policies = scopes.select(n.alias("policy_id"), "scope_type", lost.alias("scope_value"), cap.alias("ltv_cap"), (n % 2).alias("enabled"), (n % 7).alias("updated_at"))
    return dashboard.policy_list(policies, _wide(spark, sf_dir), zones)


def policy_zones(spark, sf_dir):
    zones = spatial.price_zones(view(spark, sf_dir, "place"), side=0.2, least=3)
    return dashboard.zone_cover(zones, _wide(spark, sf_dir))


def policy_rows(spark, sf_dir):
    """The worst loans that a city's cap would hit."""
    rows = _wide(spark, sf_dir).where("city = 'gz' and ltv > 0.7")
    return rows.orderBy(F.desc("ltv"), "loan_id").limit(50).select("loan_id", "ltv", "balance", F.when(F.col("ltv") > C.RED, "raise").otherwise("new").alias("change"))


def valuation_tiers(spark, sf_dir):
    base = enriched(spark, sf_dir)
    return dashboard.source_tier(base).groupBy("tier").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("abnormal_valuation").cast("double")), 4).alias("abnormal_rate"), F.median("valuation_deviation_pct").alias("median_deviation")
    )


def deviation_buckets(spark, sf_dir):
    return enriched(spark, sf_dir).where("valuation_deviation_pct is not null").groupBy(dashboard.bucket(F.col("valuation_deviation_pct"), DEVIATIONS).alias("bucket")).agg(F.count("*").alias("n"))


def valuation_page(spark, sf_dir):
    return enriched(spark, sf_dir).orderBy(F.col("valuation_deviation_pct").desc_nulls_last(), "loan_id").limit(20).select("loan_id", "valuation_deviation_pct", "market_valuation")


def deviation_parts(spark, sf_dir):
    collateral, avm, places = views(spark, sf_dir, "collateral", "avm", "place")
    cities = places.groupBy("city").agg(F.median("unit_price").alias("city_price"))
    rows = collateral.join(avm, "collateral_id").join(cities, "city").withColumnsRenamed({"avm_value": "estimate", "true_market_price": "book"})
    out = dashboard.deviation_parts(rows)
    return out.groupBy("city").agg(
        F.count("*").alias("n"), F.round(F.max("a1"), 6).alias("a1"), F.round(F.var_pop("a2"), 6).alias("var_a2"), F.round(F.var_pop("b"), 6).alias("var_b"),
        F.round(F.avg((F.abs(F.col("signed")) > 0.3).cast("double")), 4).alias("abnormal_rate"), F.round(F.avg((F.abs(F.exp("a2") - 1) > 0.3).cast("double")), 4).alias("without_city_rate"),
    )


def masked_export(spark, sf_dir):
    loans, borrower, collateral = views(spark, sf_dir, "loan", "borrower", "collateral")
    return (
        loans.join(borrower, "customer_id", "left")
        .join(collateral, "collateral_id", "left")
        .select("loan_id", C.mask(F.col("customer_id")).alias("customer"), C.mask(F.col("name")).alias("name"), F.replace("property_addr", F.lit(","), F.lit("，")).alias("address"))
    )


def alert_dates(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("alert_date").agg(F.count("*").alias("n")).orderBy(F.desc("alert_date"))


def _snapshots(spark, sf_dir):
    """Three days' snapshots as the stored table that pages read: one join, its loans spread over the days."""
    loans, collateral = views(spark, sf_dir, "loan", "collateral")
    days = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).cast("date").alias("snap_date")) for i, d in enumerate(("2026-01-31", "2026-02-28", "2026-03-31"))])
    spread = loans.withColumn("_d", F.explode(days)).select("*", "_d.i", "_d.snap_date").where("loan_id % 13 <> i")
    moved = spread.withColumn("balance", F.round(F.col("balance") * (1 + F.col("i") * 0.1 * ((F.col("loan_id") % 5) - 2)), 2))
    return stored(risk.enrich(moved, collateral).select("snap_date", "loan_id", "risk_class", "balance"), "snapshots")


def migration_matrix(spark, sf_dir):
    s = _snapshots(spark, sf_dir)
    return dashboard.migration(s.where("snap_date = date'2026-02-28'"), s.where("snap_date = date'2026-03-31'"))


def entered_and_left(spark, sf_dir):
    s = _snapshots(spark, sf_dir)
    return dashboard.entered_and_left(s.where("snap_date = date'2026-02-28'"), s.where("snap_date = date'2026-03-31'"))


def roll_rates(spark, sf_dir):
    return dashboard.roll_rates(_snapshots(spark, sf_dir))


def snapshot_dates(spark, sf_dir):
    return _snapshots(spark, sf_dir).groupBy("snap_date").agg(F.count("*").alias("n")).orderBy(F.desc("snap_date"))


def _case(col, bounds):
    return f"CAST(CASE {' '.join(f'WHEN {col} < {b} THEN {i}' for i, b in enumerate(bounds))} ELSE {len(bounds)} END AS INT)"


_E = f"WITH e AS ({ENRICHED})"
_AL = f"""{_E}, al AS (SELECT loan_id, 'batch' AS src, ltv, alert_level, origination_date AS alert_date FROM e WHERE alert_level IS NOT NULL
  UNION ALL SELECT loan_id, 'stream', ltv, NULL, origination_date FROM e WHERE alert_level IS NOT NULL AND loan_id % 5 = 0)"""
_COVER = f"""{_E}, z AS (SELECT printf('price-%s-%.2f-%.2f', g.city, gx * 0.2::DOUBLE, gy * 0.2::DOUBLE) AS zone_id, g.city AS zone_city, n, la, ln, CAST(m <= cm * 0.75 AS INT) AS is_high_risk_zone
  FROM (SELECT city, floor(lng / 0.2::DOUBLE) AS gx, floor(lat / 0.2::DOUBLE) AS gy, count(*) AS n, median(unit_price) AS m, round(avg(lat), 6) AS la, round(avg(lng), 6) AS ln FROM place GROUP BY 1, 2, 3 HAVING count(*) >= 3) g
  JOIN (SELECT city, median(unit_price) AS cm FROM place GROUP BY 1) c ON c.city = g.city),
  k AS (SELECT zone_id, collateral_id FROM z CROSS JOIN collateral WHERE 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lng - ln) / 2), 2))) <= 5)"""
_BAD = f"({RANK}) BETWEEN 2 AND 4"
_NPL = f"""count(*) AS loans, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS balance, count(*) FILTER ({_BAD}) AS npl_loans,
  CAST(coalesce(sum(CAST(balance AS DECIMAL(18,2))) FILTER ({_BAD}), 0) AS DOUBLE) AS npl_balance, round(avg(ltv), 4) AS avg_ltv, count(alert_level) AS alerts,
  round(count(*) FILTER ({_BAD}) / count(*), 4) AS npl_rate, round(CAST(coalesce(sum(CAST(balance AS DECIMAL(18,2))) FILTER ({_BAD}), 0) AS DOUBLE) / CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE), 4) AS npl_balance_rate"""
_CLS = "CASE WHEN x.collateral_id IS NULL THEN '损失' WHEN base = '正常' AND is_high_risk_zone = 1 THEN '关注' ELSE base END"
_SNAP = f"""WITH s AS (SELECT snap_date, loan_id, balance, {_CLS} AS risk_class FROM (
  SELECT *, CASE WHEN ltv IS NULL OR ltv < 0 THEN '次级' WHEN ltv <= 0.6 THEN '正常' WHEN ltv <= 0.75 THEN '关注' WHEN ltv <= 0.85 THEN '次级' WHEN ltv <= 1 THEN '可疑' ELSE '损失' END AS base FROM (
  SELECT t.d AS snap_date, l.loan_id, round(l.balance * (1 + 0.1::DOUBLE * t.i * (l.loan_id % 5 - 2)), 2) AS balance, c.collateral_id, c.is_high_risk_zone,
    CASE WHEN c.true_market_price > 0 THEN round(round(l.balance * (1 + 0.1::DOUBLE * t.i * (l.loan_id % 5 - 2)), 2) / c.true_market_price, 4) END AS ltv
  FROM loan l CROSS JOIN (VALUES (0, DATE '2026-01-31'), (1, DATE '2026-02-28'), (2, DATE '2026-03-31')) t(i, d) LEFT JOIN collateral c ON c.collateral_id = l.collateral_id WHERE l.loan_id % 13 <> t.i)) x)"""

QUERIES = {
    "dashboard_kpis": (kpis, oracle(BASE, f"{_E} SELECT count(*) AS loans, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS balance, count(alert_level) AS alerts, count(*) FILTER (alert_level = 'strong') AS strong, round(avg(ltv), 6) AS avg_ltv, count(*) FILTER (low_confidence) AS low_confidence FROM e")),
    "dashboard_ltv_histogram": (ltv_histogram, oracle(BASE, f"{_E} SELECT {_case('ltv', HISTOGRAM)} AS bucket, count(*) AS n FROM e WHERE ltv IS NOT NULL GROUP BY 1")),
    "dashboard_cities": (city_distribution, oracle(BASE, f"{_E} SELECT coalesce(city, '未标注') AS city, count(*) AS n, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM e GROUP BY 1")),
    "dashboard_alert_page": (
        alert_page,
        oracle(BASE, f"""{_AL} SELECT loan_id, src, ltv, alert_date, CASE alert_level WHEN 'warn' THEN '警示级' WHEN 'strong' THEN '强预警级' ELSE '—' END AS label,
        CASE WHEN src = 'batch' AND loan_id % 6 = 0 THEN 'confirmed' ELSE 'pending' END AS status FROM al ORDER BY alert_date DESC, loan_id DESC, src LIMIT 20 OFFSET 20"""),
    ),
    "dashboard_alert_dates": (alert_dates, oracle(BASE, f"{_AL} SELECT alert_date, count(*) AS n FROM al GROUP BY 1")),
    "dashboard_npl": (npl_by_zone_flag, oracle(BASE, f"{_E} SELECT CASE WHEN is_high_risk_zone = 1 THEN 'high' ELSE 'normal' END AS side, {_NPL} FROM e GROUP BY 1 UNION ALL SELECT 'total', {_NPL} FROM e")),
    "dashboard_policy": (
        policy,
        oracle(BASE + " place", f"""{_E}, z AS (SELECT printf('price-%s-%.2f-%.2f', city, floor(lng / 0.2::DOUBLE) * 0.2::DOUBLE, floor(lat / 0.2::DOUBLE) * 0.2::DOUBLE) AS zone_id, round(avg(lat), 6) AS la, round(avg(lng), 6) AS ln
        FROM place GROUP BY city, floor(lng / 0.2::DOUBLE), floor(lat / 0.2::DOUBLE) HAVING count(*) >= 3),
        k AS (SELECT zone_id, collateral_id FROM z CROSS JOIN collateral WHERE 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lng - ln) / 2), 2))) <= 5)
        SELECT zone_id, count(*) AS in_scope, count(*) FILTER (ltv > 0.7) AS hit, count(*) FILTER (ltv > 0.7 AND ltv <= 0.85) AS newly_hit, count(*) FILTER (ltv > 0.85) AS already_alert,
        count(*) FILTER (ltv > 0.7 AND low_confidence) AS low_confidence, CAST(coalesce(sum(CAST(balance AS DECIMAL(18,2))) FILTER (ltv > 0.7), 0) AS DOUBLE) AS hit_balance
        FROM k JOIN e ON e.collateral_id = k.collateral_id GROUP BY 1"""),
    ),
    "policy_list": (
        policy_list,
        oracle(BASE + " place", f"""{_COVER}, p AS (SELECT 'zone' AS scope_type, CASE WHEN n % 11 = 0 THEN zone_id || '-gone' ELSE zone_id END AS scope_value, n FROM z UNION ALL SELECT 'city', city, count(*) FROM place GROUP BY city),
        c AS (SELECT n AS policy_id, scope_type, scope_value, CASE WHEN n % 3 <> 0 THEN (n % 5 + 5) / 10 END AS ltv_cap, n % 2 AS enabled, n % 7 AS updated_at FROM p),
        s AS (SELECT 'zone' AS t, zone_id AS v, ltv, low_confidence AS low FROM k JOIN e ON e.collateral_id = k.collateral_id UNION ALL SELECT 'city', city, ltv, low_confidence FROM e),
        h AS (SELECT t, v, count(*) AS n, count(*) FILTER (x) AS hit, count(*) FILTER (x AND ltv <= 0.85) AS fresh, count(*) FILTER (x AND low) AS low
          FROM (SELECT s.*, ltv IS NOT NULL AND (ltv_cap IS NULL OR ltv > ltv_cap) AS x FROM s JOIN c ON t = scope_type AND v = scope_value) GROUP BY 1, 2)
        SELECT c.*, coalesce(n, 0) AS in_scope, coalesce(hit, 0) AS hit, coalesce(fresh, 0) AS newly_hit, coalesce(low, 0) AS low_confidence FROM c LEFT JOIN h ON t = scope_type AND v = scope_value"""),
    ),
    "policy_zones": (
        policy_zones,
        oracle(BASE + " place", f"""{_COVER} SELECT zone_id, zone_city AS city, is_high_risk_zone, coalesce(n, 0) AS loans, coalesce(b, 0) AS balance
        FROM (SELECT zone_id, zone_city, is_high_risk_zone FROM z) LEFT JOIN (SELECT zone_id AS i, count(*) AS n, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS b FROM k JOIN e ON e.collateral_id = k.collateral_id GROUP BY 1) ON i = zone_id"""),
    ),
    "dashboard_policy_rows": (policy_rows, oracle(BASE, f"{_E} SELECT loan_id, ltv, balance, CASE WHEN ltv > 0.85 THEN 'raise' ELSE 'new' END AS change FROM e WHERE city = 'gz' AND ltv > 0.7 ORDER BY ltv DESC, loan_id LIMIT 50")),
    "dashboard_tiers": (
        valuation_tiers,
        oracle(BASE, f"""{_E} SELECT CASE WHEN valuation_deviation_pct IS NOT NULL THEN 'avm' WHEN market_valuation IS NULL THEN 'none' WHEN abs(market_valuation - true_market_price) < 0.01 THEN 'fallback' ELSE 'dwd' END AS tier,
        count(*) AS n, round(avg(abnormal_valuation::INT), 4) AS abnormal_rate, median(valuation_deviation_pct) AS median_deviation FROM e GROUP BY 1"""),
    ),
    "dashboard_deviations": (deviation_buckets, oracle(BASE, f"{_E} SELECT {_case('valuation_deviation_pct', DEVIATIONS)} AS bucket, count(*) AS n FROM e WHERE valuation_deviation_pct IS NOT NULL GROUP BY 1")),
    "dashboard_valuation_page": (valuation_page, oracle(BASE, f"{_E} SELECT loan_id, valuation_deviation_pct, market_valuation FROM e ORDER BY valuation_deviation_pct DESC NULLS LAST, loan_id LIMIT 20")),
    "dashboard_deviation_parts": (
        deviation_parts,
        oracle("collateral avm place", """WITH r AS (SELECT c.city, ln(avm_value / (p * area)) AS a, -ln(true_market_price / (p * area)) AS b, avm_value / true_market_price - 1 AS signed
          FROM collateral c JOIN avm v ON v.collateral_id = c.collateral_id JOIN (SELECT city, median(unit_price) AS p FROM place GROUP BY 1) u ON u.city = c.city WHERE true_market_price > 0 AND avm_value > 0),
        m AS (SELECT city, median(a) AS a1 FROM r GROUP BY 1)
        SELECT r.city, count(*) AS n, round(max(a1), 6) AS a1, round(var_pop(a - a1), 6) AS var_a2, round(var_pop(b), 6) AS var_b, round(avg((abs(signed) > 0.3)::INT), 4) AS abnormal_rate,
        round(avg((abs(exp(a - a1) - 1) > 0.3)::INT), 4) AS without_city_rate FROM r JOIN m ON m.city = r.city GROUP BY 1"""),
    ),
    "dashboard_masked_export": (
        masked_export,
        oracle("loan borrower collateral", """SELECT loan_id, 'c****' || CASE WHEN length(CAST(l.customer_id AS STRING)) > 4 THEN right(CAST(l.customer_id AS STRING), 4) ELSE '' END AS customer, 'c****' || right(name, 4) AS name, property_addr AS address
        FROM loan l LEFT JOIN borrower b ON b.customer_id = l.customer_id LEFT JOIN collateral c ON c.collateral_id = l.collateral_id"""),
    ),
    "migration_matrix": (
        migration_matrix,
        oracle("loan collateral", f"""{_SNAP} SELECT a.risk_class AS from_class, b.risk_class AS to_class, count(*) AS loans, CAST(sum(CAST(b.balance AS DECIMAL(18,2))) AS DOUBLE) AS end_balance
        FROM s a JOIN s b ON a.loan_id = b.loan_id AND a.snap_date = DATE '2026-02-28' AND b.snap_date = DATE '2026-03-31' GROUP BY 1, 2"""),
    ),
    "migration_entered_left": (entered_and_left, oracle("loan", "SELECT loan_id, CASE WHEN loan_id % 13 = 1 THEN 'entered' ELSE 'left' END AS change FROM loan WHERE loan_id % 13 IN (1, 2)")),
    "migration_roll_rates": (
        roll_rates,
        oracle("loan collateral", f"""{_SNAP}, r AS (SELECT *, {RANK} AS k, dense_rank() OVER (ORDER BY snap_date) AS i FROM s)
        SELECT a.snap_date AS from_date, b.snap_date AS to_date, a.risk_class, count(*) AS base, count(*) FILTER (b.k > a.k) AS down, round(count(*) FILTER (b.k > a.k) / count(*), 4) AS rate
        FROM r a JOIN r b ON a.loan_id = b.loan_id AND b.i = a.i + 1 GROUP BY 1, 2, 3"""),
    ),
    "migration_dates": (snapshot_dates, oracle("loan collateral", f"{_SNAP} SELECT snap_date, count(*) AS n FROM s GROUP BY 1")),
}
