"""Queries of valuation pages, spatial pages and prototypes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators import attribution as A
from terravane.operators import dashboard, pages, spatial
from terravane.plans.dashboard import _wide
from terravane.plans.risk import BASE, ENRICHED, enriched
from terravane.sources.adapter import CITIES, oracle, view, views
from terravane.sources.shared import stored

EXCLUDED = ("gz", "zs")


def _parts(spark, sf_dir):
    collateral, avm, places = views(spark, sf_dir, "collateral", "avm", "place")
    cities = places.groupBy("city").agg(F.median("unit_price").alias("city_price"))
    rows = collateral.join(avm, "collateral_id").join(cities, "city").withColumn("estimate", F.col("avm_value") * 1.003).withColumnRenamed("true_market_price", "book")
    rows = dashboard.deviation_parts(rows)
    tier = F.when(F.col("collateral_id") % 2 == 0, "dwd").otherwise("avm")
    return rows.select("collateral_id", "city", "estimate", "book", "area", "city_price", "a1", "a2", "b", "signed", tier.alias("tier"), F.concat(F.lit("v"), (F.col("collateral_id") % 3).cast("string")).alias("model_version"))


def counterfactual(spark, sf_dir):
    return A.counterfactual(_parts(spark, sf_dir), EXCLUDED).select("collateral_id", "category", "fix_a1", "fix_b", "fix_a2")


def summary(spark, sf_dir):
    return A.summary(A.counterfactual(_parts(spark, sf_dir), EXCLUDED))


def mix(spark, sf_dir):
    return A.mix(A.counterfactual(_parts(spark, sf_dir), EXCLUDED))


def by_city(spark, sf_dir):
    return A.dimension(_parts(spark, sf_dir), "city")


def by_class(spark, sf_dir):
    """Noise of the books by loan class: the deviation that is left without the model's part."""
    loans = enriched(spark, sf_dir).select("collateral_id", "risk_class")
    return A.dimension(loans.join(_parts(spark, sf_dir).withColumn("signed", F.exp("b") - 1), "collateral_id"), "risk_class")


def overview(spark, sf_dir):
    return A.overview(_parts(spark, sf_dir))


def histogram(spark, sf_dir):
    return A.histogram(_parts(spark, sf_dir))


def queue(spark, sf_dir):
    return A.queue(_parts(spark, sf_dir), 10, 20).select("collateral_id", F.round("signed", 6).alias("signed"))


def contrast(spark, sf_dir):
    return A.contrast(_parts(spark, sf_dir))


def city_ranks(spark, sf_dir):
    return A.city_ranks(_parts(spark, sf_dir))


def dropped(spark, sf_dir):
    cities = spark.createDataFrame([(c,) for c in CITIES.values()], "city string")
    return A.dropped_cities(cities, _parts(spark, sf_dir).where("city not in ('gz', 'sg')"))


def lineage(spark, sf_dir):
    """Versions of the models of each day and city with the change of their error, and the numbers that two days' next ones get."""
    rows = view(spark, sf_dir, "listing").groupBy("first_seen", "city").agg((F.floor(F.avg("unit_price")) / 8).alias("mape"))
    nth = F.row_number().over(Window.partitionBy("first_seen").orderBy("city"))
    v = rows.withColumn("nth", nth).select(F.concat(F.col("first_seen").cast("string"), F.lit("-r"), F.col("nth").cast("string")).alias("version"), (F.datediff("first_seen", F.lit("1990-01-01")) * 100 + F.col("nth")).alias("trained_at"), "mape")
    v = stored(v, "versions")
    none = F.lit(None).cast("double").alias("delta")
    return A.lineage(v).select("version", "delta").unionByName(A.next_version(v, "1995-03-15").select("version", none)).unionByName(A.next_version(v, "2026-06-01").select("version", none))


def segments(spark, sf_dir):
    ads = view(spark, sf_dir, "ad")
    return A.position_segments(ads.withColumn("ape", (F.col("load_no") % 100) / 100))


def zone_shares(spark, sf_dir):
    return A.zone_shares(enriched(spark, sf_dir))


def _features(spark, sf_dir):
    places = view(spark, sf_dir, "place")
    n = F.col("place_id")
    return places.select(
        F.when(n % 5 == 0, "collateral").otherwise("listing").alias("entity_type"), n.cast("string").alias("entity_id"), F.col("city").alias("district"), "lat", "lng", F.when(n % 7 != 0, F.concat(F.lit("z"), (n % 9).cast("string"))).alias("zone_id"),
        F.when(n % 4 != 0, (n % 50) / 10).alias("poi_density"), F.when(n % 6 != 0, (n % 120).cast("double")).alias("commute_min"), F.when(n % 3 != 0, (n % 21 - 10) / 20).alias("price_deviation"),
    )


def feature_means(spark, sf_dir):
    f = _features(spark, sf_dir)
    return pages.feature_means(f, "zone_id").withColumnRenamed("zone_id", "of").unionByName(pages.feature_means(f, "district").withColumnRenamed("district", "of"))


def loan_features(spark, sf_dir):
    """How many loans have a feature row of their collateral, and its means."""
    rows = pages.loan_features(view(spark, sf_dir, "loan"), _features(spark, sf_dir))
    return rows.groupBy("zone_id").agg(F.count("*").alias("loans"), F.round(F.avg("poi_density"), 6).alias("poi_density"))


def zone_drill(spark, sf_dir):
    loans = _wide(spark, sf_dir).select("loan_id", "lat", "lng", "ltv")
    means, buckets, near = pages.zone_drill_down(_features(spark, sf_dir), loans, "z3", 23.0, 113.5)
    none = F.lit(None).cast("double")
    out = means.select(F.concat(F.lit("mean "), "entity_type").alias("what"), "n", "poi_density")
    out = out.unionByName(buckets.select(F.concat(F.lit("bucket "), F.col("bucket").cast("string")).alias("what"), "n", none.alias("poi_density")))
    return out.unionByName(near.select(F.concat(F.lit("loan "), F.col("loan_id").cast("string")).alias("what"), F.lit(1).cast("long").alias("n"), F.round("km", 6).alias("poi_density")))


def city_options(spark, sf_dir):
    loans = _wide(spark, sf_dir).where("city <> 'gz'")
    return pages.city_options(spatial.price_zones(view(spark, sf_dir, "place"), side=0.2, least=4), loans)


def zone_distances(spark, sf_dir):
    """Loans by whether their collateral's cell is a zone's, with the mean distance to the nearest zone's centre."""
    loans = _wide(spark, sf_dir).select("loan_id", "lat", "lng")
    return pages.zone_of_loans(loans, _zones(spark, sf_dir), 0.2)


def _zones(spark, sf_dir):
    return spatial.price_zones(view(spark, sf_dir, "place"), side=0.2, least=3)


def suggestions(spark, sf_dir):
    rows = _wide(spark, sf_dir).select("loan_id", "lat", "lng", "ltv", "balance", "low_confidence")
    zones = _zones(spark, sf_dir).withColumn("is_high_risk_zone", F.when(F.col("samples") % 2 == 0, 1).otherwise(0))
    return pages.policy_suggestions(rows, zones, 0.7, 5)


def community_features(spark, sf_dir):
    places = view(spark, sf_dir, "place").withColumn("community", F.concat(F.lit("c"), (F.col("place_id") % 97).cast("string")))
    return pages.community_features(places, "place_id").withColumns({c: F.round(c, 6) for c in ("lat", "lng")})


def collateral_features(spark, sf_dir):
    collateral, places = views(spark, sf_dir, "collateral", "place")
    zones = spatial.ltv_zones(spatial.collateral_ltv(view(spark, sf_dir, "loan"), collateral), side=0.2, least=3)
    return pages.collateral_features(collateral, places, zones, 0.2).select("collateral_id", "zone_id", F.round("price_deviation", 3).alias("price_deviation"))


def prototype_states(spark, sf_dir):
    e = enriched(spark, sf_dir).join(view(spark, sf_dir, "collateral").select("collateral_id", (F.col("missing_pct") / 100).alias("missing")), "collateral_id")
    return e.groupBy(pages.prototype_state(F.try_divide("balance", "market_valuation"), F.col("missing")).alias("state")).agg(F.count("*").alias("n"))


def prototype_layers(spark, sf_dir):
    """Price by tenth-of-a-degree cell, and the non-performing share of high-risk zones."""
    places = view(spark, sf_dir, "place")
    cells = pages.grid_average(places, "unit_price")
    npl = A.zone_shares(enriched(spark, sf_dir)).where("side = 'high'").select(F.lit("npl").alias("cell"), F.col("loans").alias("n"), F.col("npl_rate").alias("average"))
    return cells.unionByName(npl)


def prototype_consistency(spark, sf_dir):
    """Whether layers' balances agree: two that do, one that does not."""
    loans = view(spark, sf_dir, "loan")
    return pages.consistent({"same": (loans, loans.withColumn("balance", F.col("balance"))), "near": (loans, loans.where("loan_id >= 0")), "off": (loans, loans.where("loan_id % 2 = 0"))})


_KM = f"sqrt(pow((a.lng - b.lng) * {C.KM_LNG!r}::DOUBLE, 2) + pow((a.lat - b.lat) * 110.57::DOUBLE, 2))"
_P = """(WITH m AS (SELECT city, median(unit_price) AS city_price FROM place GROUP BY 1), k AS (SELECT c.*, avm_value * 1.003::DOUBLE AS estimate, true_market_price AS book, city_price FROM collateral c JOIN avm a ON a.collateral_id = c.collateral_id JOIN m ON m.city = c.city WHERE avm_value > 0 AND true_market_price > 0),
  l AS (SELECT *, ln(estimate / (city_price * area)) AS a, -ln(book / (city_price * area)) AS b FROM k), t AS (SELECT city, median(a) AS a1 FROM l GROUP BY 1)
  SELECT l.*, t.a1, l.a - t.a1 AS a2, estimate / book - 1 AS signed FROM l JOIN t ON t.city = l.city)"""
_OFF = lambda x: f"(abs(exp({x}) - 1) > 0.3)"
_CF = f"""(SELECT *, CASE WHEN NOT {_OFF('a1 + a2 + b')} THEN 'normal' WHEN fix_a1 AND NOT fix_b THEN CASE WHEN city IN ('gz', 'zs') THEN 'city_excluded' ELSE 'city_drift' END WHEN fix_b AND NOT fix_a1 THEN 'book_noise' WHEN fix_a1 AND fix_b THEN 'either' WHEN fix_a2 THEN 'model' ELSE 'several' END AS category
  FROM (SELECT *, CASE WHEN {_OFF('a1 + a2 + b')} THEN NOT {_OFF('a2 + b')} END AS fix_a1, CASE WHEN {_OFF('a1 + a2 + b')} THEN NOT {_OFF('a1 + a2')} END AS fix_b, CASE WHEN {_OFF('a1 + a2 + b')} THEN NOT {_OFF('a1 + b')} END AS fix_a2 FROM {_P}))"""
_CAP = "collateral avm place"
_F = """(SELECT CASE WHEN place_id % 5 = 0 THEN 'collateral' ELSE 'listing' END AS entity_type, CAST(place_id AS VARCHAR) AS entity_id, city AS district, CASE WHEN place_id % 7 <> 0 THEN 'z' || CAST(place_id % 9 AS VARCHAR) END AS zone_id, CASE WHEN place_id % 4 <> 0 THEN (place_id % 50) / 10 END AS poi_density,
  CASE WHEN place_id % 6 <> 0 THEN place_id % 120 END AS commute_min, CASE WHEN place_id % 3 <> 0 THEN (place_id % 21 - 10) / 20 END AS price_deviation FROM place)"""
_Z = """(SELECT g.city, gx, gy, printf('price-%s-%.2f-%.2f', g.city, gx * 0.2::DOUBLE, gy * 0.2::DOUBLE) AS zone_id, round(la, 6) AS center_lat, round(ln, 6) AS center_lng, samples FROM (SELECT city, floor(lng / 0.2::DOUBLE) AS gx, floor(lat / 0.2::DOUBLE) AS gy, count(*) AS samples, avg(lat) AS la, avg(lng) AS ln
  FROM place GROUP BY 1, 2, 3 HAVING count(*) >= 3) g)"""
_W = f"(SELECT e.*, c.lat, c.lng FROM ({ENRICHED}) e LEFT JOIN collateral c ON c.collateral_id = e.collateral_id)"
_MEAN = "count(*) AS n, round(avg(poi_density), 6) AS poi_density, round(avg(commute_min), 6) AS commute_min, round(avg(price_deviation), 6) AS price_deviation"
_BUCKET = "CASE " + " ".join(f"WHEN {{x}} < {b} THEN {i}" for i, b in enumerate(A.HISTOGRAM)) + " ELSE 7 END"
_SIDE = "count(*) AS loans, count(*) FILTER (bad) AS npl_loans, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS balance, CAST(coalesce(sum(CASE WHEN bad THEN CAST(balance AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS npl_balance"
_SHARES = f"""(WITH r AS (SELECT *, risk_class IN ('次级', '可疑', '损失') AS bad FROM ({ENRICHED})), s AS (SELECT CASE WHEN coalesce(is_high_risk_zone, 0) <> 0 THEN 'high' ELSE 'normal' END AS side, {_SIDE} FROM r GROUP BY 1 UNION ALL SELECT 'total', {_SIDE} FROM r)
  SELECT side, loans, npl_loans, balance, npl_balance, round(npl_loans / loans, 4) AS npl_rate, round(npl_balance / balance, 4) AS npl_balance_rate,
  CASE WHEN side = 'high' THEN round((npl_loans / loans) / (SELECT npl_loans / loans FROM s WHERE side = 'normal'), 4) END AS lift FROM s)"""

QUERIES = {
    "attribution_counterfactual": (counterfactual, oracle(_CAP, f"SELECT collateral_id, category, fix_a1, fix_b, fix_a2 FROM {_CF}")),
    "attribution_summary": (summary, oracle(_CAP, f"SELECT category, count(*) AS n, array_to_string(list_sort(list(DISTINCT city)), ',') AS cities, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM {_CF} WHERE category <> 'normal' GROUP BY 1")),
    "attribution_mix": (
        mix,
        oracle(_CAP, f"SELECT CASE WHEN category = 'book_noise' THEN 'baseline' WHEN category IN ('city_excluded', 'city_drift', 'model') THEN 'model' ELSE 'mixed' END AS side, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM {_CF} WHERE category <> 'normal' GROUP BY 1"),
    ),
    "attribution_by_city": (by_city, oracle(_CAP, f"SELECT city, count(*) AS n, round(avg(CAST(abs(signed) > 0.3 AS INT)), 4) AS abnormal_rate, round(median(abs(signed)), 6) AS median_abs, round(median(signed), 6) AS median_signed FROM {_P} GROUP BY 1")),
    "attribution_by_class": (
        by_class,
        oracle(f"{BASE} place", f"SELECT risk_class, count(*) AS n, round(avg(CAST(abs(s) > 0.3 AS INT)), 4) AS abnormal_rate, round(median(abs(s)), 6) AS median_abs, round(median(s), 6) AS median_signed FROM (SELECT e.risk_class, exp(p.b) - 1 AS s FROM ({ENRICHED}) e JOIN {_P} p ON p.collateral_id = e.collateral_id) GROUP BY 1"),
    ),
    "attribution_overview": (overview, oracle(_CAP, f"SELECT count(*) AS n, count(*) FILTER (signed > 0.3) AS over, count(*) FILTER (signed < -0.3) AS under, count(DISTINCT collateral_id % 2) AS tiers, count(DISTINCT collateral_id % 3) AS versions FROM {_P}")),
    "attribution_histogram": (histogram, oracle(_CAP, f"SELECT CAST(i AS INT) AS bucket, count(city) AS n FROM range(8) g(i) LEFT JOIN (SELECT *, {_BUCKET.format(x='signed')} AS k FROM {_P}) ON k = i GROUP BY 1")),
    "attribution_queue": (queue, oracle(_CAP, f"SELECT collateral_id, round(signed, 6) AS signed FROM {_P} WHERE abs(signed) > 0.3 ORDER BY abs(signed) DESC, collateral_id LIMIT 20 OFFSET 10")),
    "attribution_contrast": (
        contrast,
        oracle(_CAP, f"SELECT city, count(*) AS n, round(median(p), 2) AS implied, round(median(p) / max(city_price), 4) AS ratio, round((max(p) - min(p)) / avg(p), 4) AS spread FROM (SELECT *, estimate / area AS p FROM {_P}) GROUP BY 1"),
    ),
    "attribution_city_ranks": (
        city_ranks,
        oracle(_CAP, f"""SELECT *, by_estimate = by_book AS agrees FROM (SELECT city, CAST(rank() OVER (ORDER BY round(e, 6) DESC) AS INT) AS by_estimate, CAST(rank() OVER (ORDER BY round(k, 6) DESC) AS INT) AS by_book, round(e / k, 4) AS ratio
        FROM (SELECT city, median(estimate / area) AS e, median(book / area) AS k FROM {_P} GROUP BY 1))"""),
    ),
    "attribution_dropped": (dropped, oracle(_CAP, f"SELECT unnest([{', '.join(repr(c) for c in CITIES.values())}]) AS city EXCEPT SELECT city FROM {_P} WHERE city NOT IN ('gz', 'sg')")),
    "attribution_lineage": (
        lineage,
        oracle("listing", """WITH r AS (SELECT first_seen, city, floor(avg(unit_price)) / 8 AS mape FROM listing GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (PARTITION BY first_seen ORDER BY city) AS nth FROM r)
        SELECT CAST(first_seen AS VARCHAR) || '-r' || CAST(nth AS VARCHAR) AS version, round(mape - lag(mape) OVER (ORDER BY first_seen, nth), 3) AS delta FROM v
        UNION ALL SELECT '1995-03-15-r' || CAST(count(*) + 1 AS VARCHAR), NULL FROM v WHERE first_seen = DATE '1995-03-15' UNION ALL SELECT '2026-06-01-r1', NULL"""),
    ),
    "valuation_segments": (
        segments,
        oracle("ad", "SELECT CASE WHEN lat IS NOT NULL AND community IS NOT NULL THEN 'both' WHEN lat IS NOT NULL THEN 'place' WHEN community IS NOT NULL THEN 'community' ELSE 'none' END AS segment, count(*) AS n, round(avg(load_no % 100), 3) AS mape FROM ad GROUP BY 1"),
    ),
    "dashboard_zone_shares": (zone_shares, oracle(BASE, f"SELECT * FROM {_SHARES}")),
    "spatial_feature_means": (feature_means, oracle("place", f"SELECT zone_id AS of, {_MEAN} FROM {_F} WHERE entity_type = 'listing' AND zone_id IS NOT NULL GROUP BY 1 UNION ALL SELECT district, {_MEAN} FROM {_F} WHERE entity_type = 'listing' GROUP BY 1")),
    "spatial_loan_features": (
        loan_features,
        oracle("loan place", f"SELECT zone_id, count(*) AS loans, round(avg(poi_density), 6) AS poi_density FROM loan l LEFT JOIN {_F} f ON f.entity_type = 'collateral' AND f.entity_id = CAST(l.collateral_id AS VARCHAR) GROUP BY 1"),
    ),
    "spatial_zone_drill": (
        zone_drill,
        oracle(f"{BASE} place", f"""SELECT 'mean ' || entity_type AS what, count(*) AS n, round(avg(poi_density), 6) AS poi_density FROM {_F} WHERE zone_id = 'z3' GROUP BY 1
        UNION ALL SELECT 'bucket ' || CAST(i AS VARCHAR), count(district), NULL FROM range(8) g(i) LEFT JOIN (SELECT *, {_BUCKET.format(x='price_deviation')} AS k FROM {_F} WHERE zone_id = 'z3' AND price_deviation IS NOT NULL) ON k = i GROUP BY 1
        UNION ALL SELECT 'loan ' || CAST(loan_id AS VARCHAR), 1, round(km, 6) FROM (SELECT b.loan_id, {_KM} AS km FROM (SELECT 23.0::DOUBLE AS lat, 113.5::DOUBLE AS lng) a, {_W} b WHERE km <= 5 ORDER BY km, loan_id LIMIT 20)"""),
    ),
    "spatial_city_options": (
        city_options,
        oracle(f"{BASE} place", f"""WITH z AS (SELECT city, count(*) AS zones FROM {_Z.replace('>= 3', '>= 4')} GROUP BY 1), l AS (SELECT city, count(*) AS loans FROM {_W} WHERE city <> 'gz' GROUP BY 1)
        SELECT coalesce(z.city, l.city) AS city, coalesce(zones, 0) AS zones, coalesce(loans, 0) AS loans FROM z FULL JOIN l ON l.city = z.city"""),
    ),
    "spatial_zone_of_loans": (
        zone_distances,
        oracle(f"{BASE} place", f"""WITH z AS {_Z}, d AS (SELECT b.loan_id, min({_KM}) AS km FROM z AS q, {_W} b, LATERAL (SELECT q.center_lat AS lat, q.center_lng AS lng) a WHERE b.lat IS NOT NULL GROUP BY 1)
        SELECT EXISTS (SELECT 1 FROM z WHERE gx = floor(w.lng / 0.2::DOUBLE) AND gy = floor(w.lat / 0.2::DOUBLE)) AS in_zone, count(*) AS loans, round(avg(km), 4) AS mean_km FROM {_W} w LEFT JOIN d ON d.loan_id = w.loan_id WHERE w.lat IS NOT NULL GROUP BY 1"""),
    ),
    "policy_suggestions": (
        suggestions,
        oracle(f"{BASE} place", f"""WITH z AS (SELECT * FROM {_Z} WHERE samples % 2 = 0), p AS (SELECT q.zone_id, b.loan_id, b.ltv, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - q.center_lat) / 2), 2) + cos(radians(q.center_lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - q.center_lng) / 2), 2))) AS km FROM z q, {_W} b)
        SELECT zone_id, count(*) AS in_scope, count(*) FILTER (ltv > 0.7) AS hit FROM p WHERE km <= 5 GROUP BY 1 HAVING count(*) FILTER (ltv > 0.7) > 0 ORDER BY hit DESC, zone_id LIMIT 5"""),
    ),
    "spatial_community_features": (
        community_features,
        oracle("place", f"""WITH p AS (SELECT *, 'c' || CAST(place_id % 97 AS VARCHAR) AS community FROM place), a AS (SELECT city, community, median(lat) AS lat, median(lng) AS lng, median(unit_price) AS price FROM p GROUP BY 1, 2),
        n AS (SELECT a.city, a.community, count(*) AS k, median(b.unit_price) AS m FROM a JOIN p b ON {_KM} <= 5 AND (b.city <> a.city OR b.community <> a.community) GROUP BY 1, 2)
        SELECT a.city || '|' || a.community AS entity_id, a.city AS district, round(lat, 6) AS lat, round(lng, 6) AS lng, CASE WHEN k >= 5 THEN round((price - m) / m, 4) END AS price_deviation FROM a LEFT JOIN n ON n.city = a.city AND n.community = a.community"""),
    ),
    "spatial_collateral_features": (
        collateral_features,
        oracle("loan collateral place", f"""WITH o AS (SELECT collateral_id, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS owed FROM loan GROUP BY 1), g AS (SELECT floor(lng / 0.2::DOUBLE) AS gx, floor(lat / 0.2::DOUBLE) AS gy FROM collateral c JOIN o ON o.collateral_id = c.collateral_id WHERE true_market_price > 0 GROUP BY 1, 2 HAVING count(*) >= 3),
        n AS (SELECT a.collateral_id, count(*) AS k, median(b.unit_price) AS m FROM collateral a JOIN place b ON {_KM} <= 5 GROUP BY 1)
        SELECT c.collateral_id, CASE WHEN g.gx IS NOT NULL THEN printf('ltv-%.2f-%.2f', g.gx * 0.2::DOUBLE, g.gy * 0.2::DOUBLE) END AS zone_id, CASE WHEN k >= 5 THEN round((true_market_price / area - m) / m, 3) END AS price_deviation
        FROM collateral c LEFT JOIN n ON n.collateral_id = c.collateral_id LEFT JOIN g ON g.gx = floor(c.lng / 0.2::DOUBLE) AND g.gy = floor(c.lat / 0.2::DOUBLE)"""),
    ),
    "prototype_states": (
        prototype_states,
        oracle(BASE, f"""SELECT CASE WHEN ltv0 > 0.85 AND missing > 0.2 THEN 'review' WHEN ltv0 > 0.85 THEN 'alert' WHEN missing > 0.2 THEN 'low confidence' ELSE 'normal' END AS state, count(*) AS n FROM (SELECT balance / nullif(market_valuation, 0) AS ltv0, missing_pct / 100 AS missing FROM ({ENRICHED}) WHERE held) WHERE ltv0 IS NOT NULL GROUP BY 1
        UNION ALL SELECT * FROM (SELECT 'none' AS state, count(*) AS n FROM ({ENRICHED}) WHERE held AND NOT coalesce(market_valuation > 0, false)) WHERE n > 0"""),
    ),
    "prototype_layers": (
        prototype_layers,
        oracle(f"{BASE} place", f"SELECT CAST(CAST(trunc(lat * 10) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(trunc(lng * 10) AS BIGINT) AS VARCHAR) AS cell, count(*) AS n, round(avg(unit_price), 2) AS average FROM place GROUP BY 1 UNION ALL SELECT 'npl', loans, npl_rate FROM {_SHARES} WHERE side = 'high'"),
    ),
    "prototype_consistency": (prototype_consistency, oracle("loan", """SELECT unnest(['same', 'near', 'off']) AS layer, unnest([true, true, false]) AS consistent""")),
}
