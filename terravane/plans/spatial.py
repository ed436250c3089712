"""Spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators import spatial
from terravane.sources.adapter import oracle, view, views

# fixed values: the cities' centres (longitude, latitude)
CENTRES = {
    "gz": (113.2644, 23.1291), "sz": (114.0579, 22.5431), "fs": (113.1219, 23.0219), "dg": (113.7518, 23.0207), "zh": (113.5767, 22.2710),
    "zs": (113.3928, 22.5176), "hui": (114.4162, 23.1115), "jm": (113.0822, 22.5789), "zq": (112.4720, 23.0472), "qy": (113.0611, 23.6820),
    "sg": (113.5975, 24.8108), "st": (116.6822, 23.3541), "sw": (115.3754, 22.7868), "jy": (116.3732, 23.5497), "cz": (116.6228, 23.6567),
    "mz": (116.1226, 24.2885), "hy": (114.7004, 23.7442), "yj": (111.9827, 21.8580), "mm": (110.9250, 21.6633), "zj": (110.3593, 21.2707), "yf": (112.0445, 22.9153),
}


def price_zones(spark, sf_dir):
    (places,) = views(spark, sf_dir, "place")
    return spatial.price_zones(places, side=0.2, least=3)


def ltv_zones(spark, sf_dir):
    """Zones of a fifth of a degree, for loans small enough that some zones are under the line."""
    loans, collateral = views(spark, sf_dir, "loan", "collateral")
    return spatial.ltv_zones(spatial.collateral_ltv(loans.withColumn("balance", F.col("balance") / 8), collateral), side=0.2, least=3)


def neighbourhoods(spark, sf_dir):
    (places,) = views(spark, sf_dir, "place")
    return spatial.neighbourhood_median(places, places, "place_id", "unit_price")


def poi_density(spark, sf_dir):
    (places,) = views(spark, sf_dir, "place")
    return spatial.poi_density(places, places.where("place_id % 9 = 0"), "place_id", coverage_km=4.0).withColumn("poi_density", F.round("poi_density", 6))


def commute(spark, sf_dir):
    (places,) = views(spark, sf_dir, "place")
    return spatial.commute_minutes(places.withColumn("city", F.when(F.col("place_id") % 4 != 0, F.col("city"))), CENTRES).select("place_id", "commute_min")


def features(spark, sf_dir):
    """Neighbourhood deviation, density and commute of each place, and how much of them is missing."""
    (places,) = views(spark, sf_dir, "place")
    near = spatial.neighbourhood_median(places, places, "place_id", "unit_price", radius_km=4.0, least=12)
    poi = spatial.poi_density(places, places.where("place_id % 9 = 0"), "place_id", coverage_km=4.0)
    out = spatial.commute_minutes(places, CENTRES).join(near, "place_id").join(poi, "place_id")
    out = out.withColumn("price_deviation", F.round(F.try_divide("unit_price", "neighbourhood") - 1, 4))
    return out.select("place_id", "price_deviation", spatial.missing_share("price_deviation", "poi_density", "commute_min").alias("missing_pct"))


def nearest(spark, sf_dir):
    (places,) = views(spark, sf_dir, "place")
    return spatial.nearest(places, places, "place_id", 3, 3.0).select("place_id", "rank", "neighbour", F.round("km", 6).alias("km"))


def neighbour_prices(spark, sf_dir):
    places = view(spark, sf_dir, "place")
    return spatial.neighbour_prices(places, places, "place_id", "unit_price", 6.0).withColumn("nearest_km", F.round("nearest_km", 6))


def datum_shift(spark, sf_dir):
    (places,) = views(spark, sf_dir, "place")
    lat, lng = C.gcj_to_wgs(F.col("lat"), F.col("lng"))
    return places.select("place_id", F.round(lat, 5).alias("lat"), F.round(lng, 5).alias("lng"))


_KM = f"sqrt(pow((a.lng - b.lng) * {C.KM_LNG!r}::DOUBLE, 2) + pow((a.lat - b.lat) * 110.57::DOUBLE, 2))"
_PAIRS = f"SELECT a.place_id AS a, b.place_id AS b, b.unit_price AS price, {_KM} AS km FROM place a CROSS JOIN place b"
_HAV = "2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lng) / 2), 2)))"
_COMMUTE = f"""SELECT place_id, CASE WHEN km <= 60 THEN round(km / 30 * 60, 2) END AS commute_min FROM (
  SELECT place_id, min({_HAV}) AS km FROM place CROSS JOIN (VALUES {', '.join(f"('{c}', {x}::DOUBLE, {y}::DOUBLE)" for c, (x, y) in CENTRES.items())}) v(code, x, y) WHERE {{where}} GROUP BY 1)"""
_POI = f"""SELECT place_id, CASE WHEN n > 0 OR reach THEN n / (pi() * 4) END AS poi_density FROM (
  SELECT a AS place_id, count(*) FILTER (km <= 2 AND b % 9 = 0) AS n, bool_or(km <= 4 AND b % 9 = 0) AS reach FROM ({_PAIRS}) GROUP BY 1)"""



def _waves(v: str, *terms) -> str:
    return "(" + " + ".join(f"{a} * sin({v} * pi() * {w})" for a, w in terms) + ") * 2 / 3.0::DOUBLE"


def overview(spark, sf_dir):
    """Figures of the overview page for the price zones of one city, beside those of all."""
    n = F.col("place_id")
    zones = view(spark, sf_dir, "place").select("city", F.when(n % 2 == 0, "price").otherwise("ltv").alias("zone_type"), (n % 40).alias("sample_count"), (n % 7 == 0).cast("int").alias("is_high_risk_zone"))
    return spatial.overview(zones, "gz", "price")


QUERIES = {
    "spatial_overview": (
        overview,
        oracle("place", """WITH z AS (SELECT city, CASE WHEN place_id % 2 = 0 THEN 'price' ELSE 'ltv' END AS zone_type, place_id % 40 AS s, place_id % 7 = 0 AS high, city = 'gz' AND place_id % 2 = 0 AS fits FROM place)
        SELECT CASE WHEN grouping(city) = 1 THEN 'all' WHEN grouping(zone_type) = 1 THEN 'city' ELSE 'kind' END AS level, city, zone_type, count(*) AS zones, count(*) FILTER (high) AS high_risk, CAST(sum(s) AS BIGINT) AS samples,
        count(*) FILTER (fits) AS picked, count(*) FILTER (fits AND high) AS picked_high, CAST(coalesce(sum(s) FILTER (fits), 0) AS BIGINT) AS picked_samples FROM z GROUP BY GROUPING SETS ((city, zone_type), (city), ())"""),
    ),
    "spatial_price_zones": (
        price_zones,
        oracle("place", """SELECT printf('price-%s-%.2f-%.2f', g.city, gx * 0.2::DOUBLE, gy * 0.2::DOUBLE) AS zone_id, g.city, round(la, 6) AS center_lat, round(ln, 6) AS center_lng, samples, m AS median_price,
        round(m / c.cm - 1, 4) AS deviation, CAST(m <= c.cm * 0.75 AS INT) AS is_high_risk_zone
        FROM (SELECT city, floor(lng / 0.2::DOUBLE) AS gx, floor(lat / 0.2::DOUBLE) AS gy, count(*) AS samples, median(unit_price) AS m, avg(lat) AS la, avg(lng) AS ln FROM place GROUP BY 1, 2, 3 HAVING count(*) >= 3) g
        JOIN (SELECT city, median(unit_price) AS cm FROM place GROUP BY 1) c ON c.city = g.city"""),
    ),
    "spatial_ltv_zones": (
        ltv_zones,
        oracle("loan collateral", """SELECT printf('ltv-%.2f-%.2f', gx * 0.2::DOUBLE, gy * 0.2::DOUBLE) AS zone_id, round(gy * 0.2::DOUBLE + 0.1, 6) AS center_lat, round(gx * 0.2::DOUBLE + 0.1, 6) AS center_lng, samples,
        round(m, 4) AS median_ltv, CAST(m > 0.85 AS INT) AS is_high_risk_zone FROM (
        SELECT floor(lng / 0.2::DOUBLE) AS gx, floor(lat / 0.2::DOUBLE) AS gy, count(*) AS samples, median(owed / true_market_price) AS m
        FROM collateral c JOIN (SELECT collateral_id, CAST(sum(CAST(balance / 8 AS DECIMAL(18,2))) AS DOUBLE) AS owed FROM loan GROUP BY 1) o ON o.collateral_id = c.collateral_id
        WHERE true_market_price > 0 GROUP BY 1, 2 HAVING count(*) >= 3)"""),
    ),
    "spatial_neighbourhood": (
        neighbourhoods,
        oracle("place", f"""SELECT place_id, coalesce(n, 0) AS neighbours, CASE WHEN n >= 5 THEN m END AS neighbourhood FROM place
        LEFT JOIN (SELECT a, count(*) AS n, median(price) AS m FROM ({_PAIRS}) WHERE km <= 5 AND a <> b GROUP BY 1) ON a = place_id"""),
    ),
    "spatial_poi_density": (poi_density, oracle("place", f"SELECT place_id, round(poi_density, 6) AS poi_density FROM ({_POI})")),
    "spatial_commute": (commute, oracle("place", _COMMUTE.format(where="place_id % 4 = 0 OR city = code"))),
    "spatial_features": (
        features,
        oracle("place", f"""WITH nb AS (SELECT a, count(*) AS n, median(price) AS m FROM ({_PAIRS}) WHERE km <= 4 AND a <> b GROUP BY 1),
        f AS (SELECT p.place_id, CASE WHEN n >= 12 THEN round(unit_price / m - 1, 4) END AS price_deviation, poi_density, commute_min FROM place p LEFT JOIN nb ON a = p.place_id
        JOIN ({_POI}) d ON d.place_id = p.place_id JOIN ({_COMMUTE.format(where="city = code")}) c ON c.place_id = p.place_id)
        SELECT place_id, price_deviation, round(((price_deviation IS NULL)::INT + (poi_density IS NULL)::INT + (commute_min IS NULL)::INT) / 3.0::DOUBLE * 100, 2) AS missing_pct FROM f"""),
    ),
    "spatial_nearest": (
        nearest,
        oracle("place", f"""SELECT a AS place_id, CAST(rn AS INT) AS rank, b AS neighbour, round(km, 6) AS km
        FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 9), b) AS rn FROM ({_PAIRS}) WHERE a <> b) WHERE rn <= 3"""),
    ),
    "spatial_datum": (
        datum_shift,
        oracle("place", f"""WITH o AS (SELECT place_id, lat, lng, lng - 105 AS x, lat - 35 AS y, radians(lat) AS rad FROM place), w AS (SELECT *, {_waves("x", (20, 6), (20, 2))} AS common, 1 - 0.00669342162296594323::DOUBLE * pow(sin(rad), 2) AS curve FROM o),
        d AS (SELECT *, -100 + 2 * x + 3 * y + 0.2::DOUBLE * y * y + 0.1::DOUBLE * x * y + 0.2::DOUBLE * sqrt(abs(x)) + common + {_waves("y", (20, 1), (40, "(1 / 3.0::DOUBLE)"))} + {_waves("y", (160, "(1 / 12.0::DOUBLE)"), (320, "(1 / 30.0::DOUBLE)"))} AS dlat,
          300 + x + 2 * y + 0.1::DOUBLE * x * x + 0.1::DOUBLE * x * y + 0.1::DOUBLE * sqrt(abs(x)) + common + {_waves("x", (20, 1), (40, "(1 / 3.0::DOUBLE)"))} + {_waves("x", (150, "(1 / 12.0::DOUBLE)"), (300, "(1 / 30.0::DOUBLE)"))} AS dlng FROM w)
        SELECT place_id, round(lat - dlat * 180 / (6378245.0::DOUBLE * (1 - 0.00669342162296594323::DOUBLE) / (curve * sqrt(curve)) * pi()), 5) AS lat, round(lng - dlng * 180 / (6378245.0::DOUBLE / sqrt(curve) * cos(rad) * pi()), 5) AS lng FROM d"""),
    ),
    "spatial_neighbour_prices": (
        neighbour_prices,
        oracle("place", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 9), b) AS rn FROM ({_PAIRS}) WHERE a <> b)
        SELECT a AS place_id, round(min(km), 6) AS nearest_km, {", ".join(f"median(price) FILTER (rn <= {k}) AS median_{k}" for k in (3, 8, 20, 50))} FROM r GROUP BY 1"""),
    ),
}
