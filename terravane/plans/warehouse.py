"""Listing warehouse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators import warehouse
from terravane.operators.merge import inserted_and_updated, one_of_each, replace_keys
from terravane.sources.adapter import oracle, views

#: Orders the copies of one key totally.
TIE = "lat lng unit_price area city line_no total_price discount tax agent".split()


def _latest(spark, sf_dir):
    return warehouse.latest(views(spark, sf_dir, "listing")[0], [F.col(c) for c in TIE])


def latest_listings(spark, sf_dir):
    return _latest(spark, sf_dir).select("url_key", "city", "community", "unit_price", "area", "first_seen", "last_seen")


def _halves(spark, sf_dir):
    rows = _latest(spark, sf_dir).select("url_key", "city", "community", "unit_price", "first_seen", "last_seen", "line_no")
    new = rows.where("line_no >= 3").withColumns({"unit_price": F.when(F.col("line_no") != 3, F.col("unit_price") * 2), "first_seen": F.date_add("first_seen", 30), "last_seen": F.date_add("last_seen", 45)})
    return rows.where("line_no <= 5").drop("line_no"), new.drop("line_no")


def merged_listings(spark, sf_dir):
    return warehouse.merge_listings(*_halves(spark, sf_dir))


def merge_counts(spark, sf_dir):
    return inserted_and_updated(*_halves(spark, sf_dir), ["url_key"])


def retention(spark, sf_dir):
    rows = _latest(spark, sf_dir)
    return warehouse.retention(rows.select(F.when(F.col("line_no") != 6, F.datediff("last_seen", "first_seen")).alias("days")))


def days_on_market(spark, sf_dir):
    days = F.datediff("last_seen", "first_seen").cast("double")
    return _latest(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n"), F.round(F.avg(days), 4).alias("mean_days"), F.median(days).alias("median_days"))


def city_prices(spark, sf_dir):
    return warehouse.city_stats(_latest(spark, sf_dir))


def building_age(spark, sf_dir):
    rows = _latest(spark, sf_dir).select("url_key", warehouse.repaired_age(F.col("age"), F.col("first_seen"), F.col("building_year")).cast("int").alias("age"))
    return rows


def first_of_dwelling(spark, sf_dir):
    """Listings of one dwelling count once; some listings lack an area or a price."""
    rows = _latest(spark, sf_dir).withColumns({"area": F.when(F.col("etl_no") % 23 != 0, F.col("area")), "unit_price": F.when(F.col("etl_no") % 29 != 0, F.col("unit_price"))})
    return warehouse.one_of_each_dwelling(rows, [F.col("url_key")]).select("url_key")


def cleaned_rows(spark, sf_dir):
    (rows,) = views(spark, sf_dir, "listing")
    i = F.xxhash64("url_key") % 1
    raw = rows.select(
        F.concat(F.lit("  "), "url_key").alias("url_key"),
        F.when(F.col("line_no") == 1, "  ").otherwise(F.col("community")).alias("community"),
        F.when(F.col("line_no") == 2, "n/a").when(F.col("line_no") == 3, "NaN").when(F.col("line_no") == 4, "0").when(F.col("line_no") == 5, "inf").otherwise(F.col("area").cast("int").cast("string")).alias("area"),
        F.when(F.col("line_no") == 4, "0").when(F.col("line_no") == 5, "").otherwise(F.concat(F.lit(" "), F.col("bedrooms").cast("string"))).alias("bedrooms"),
        (F.lit(0) + i).cast("string").alias("lat"),
    )
    return warehouse.clean(raw)


def url_keys(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = F.element_at(
        F.array(
            F.concat(F.lit("https://gz.zu.anjuke.com/fangyuan/"), F.col("page_id"), F.lit("?from=a")),
            F.concat(F.lit("https://m.anjuke.com/gz/prop/view/A"), F.col("page_id"), F.lit("?x=prop/view/B1")),
            F.concat(F.lit("http://GZ.58.COM/xinfang/huxing/h-"), F.col("page_id"), F.lit("#f")),
            F.concat(F.lit("https://zu.anjuke.com/other/"), F.col("page_id")),
            F.col("url"),
        ),
        (F.col("page_id") % 5 + 1).cast("int"),
    )
    return pages.select("page_id", C.url_key(made).alias("url_key"))


def replaced_alerts(spark, sf_dir):
    """A batch's alerts take the place of the same keys' old ones."""
    (rows,) = views(spark, sf_dir, "listing")
    old = rows.where("line_no <= 2").select("url_key", F.lit("old").alias("state")).distinct()
    new = rows.where("line_no = 2 and city = 'gz' or line_no = 3 and city = 'sz'").select("url_key", F.lit("new").alias("state")).distinct()
    return replace_keys(old, new, ["url_key"])


def layer_counts(spark, sf_dir):
    (rows,) = views(spark, sf_dir, "listing")
    top = _latest(spark, sf_dir)
    return warehouse.count_checks(ods=rows, dwd=top, dws=top.select("city").distinct())


def top_cities(spark, sf_dir):
    return _latest(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(5)


LATEST = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY last_seen DESC, etl_no DESC, {', '.join(TIE)}) AS rn FROM listing) WHERE rn = 1"
_HALVES = f"WITH r AS ({LATEST}), o AS (SELECT * FROM r WHERE line_no <= 5), n AS (SELECT * FROM r WHERE line_no >= 3)"

QUERIES = {
    "warehouse_latest": (latest_listings, oracle("listing", f"SELECT url_key, city, community, unit_price, area, first_seen, last_seen FROM ({LATEST})")),
    "warehouse_upsert": (
        merged_listings,
        oracle("listing", f"""{_HALVES} SELECT r.url_key, r.city, r.community, CASE WHEN line_no > 3 THEN unit_price * 2 ELSE unit_price END AS unit_price,
        CASE WHEN line_no > 5 THEN first_seen + 30 ELSE first_seen END AS first_seen, CASE WHEN line_no >= 3 THEN last_seen + 45 ELSE last_seen END AS last_seen,
        CAST(CASE WHEN line_no > 5 THEN last_seen + 45 - (first_seen + 30) WHEN line_no >= 3 THEN last_seen + 45 - first_seen ELSE last_seen - first_seen END AS INT) AS days_on_market FROM r"""),
    ),
    "warehouse_upsert_counts": (merge_counts, oracle("listing", f"{_HALVES} SELECT count(*) FILTER (line_no > 5) AS inserted, count(*) FILTER (line_no <= 5) AS updated FROM n")),
    "warehouse_retention": (
        retention,
        oracle("listing", f"""WITH r AS (SELECT CASE WHEN line_no = 6 THEN '90+' WHEN last_seen - first_seen <= 7 THEN '0-7' WHEN last_seen - first_seen <= 30 THEN '8-30' WHEN last_seen - first_seen <= 90 THEN '31-90' ELSE '90+' END AS b FROM ({LATEST}))
        SELECT bucket, count(b) AS n FROM (SELECT unnest(['0-7','8-30','31-90','90+']) AS bucket) LEFT JOIN r ON b = bucket GROUP BY 1"""),
    ),
    "warehouse_days_on_market": (days_on_market, oracle("listing", f"SELECT city, count(*) AS n, round(avg(last_seen - first_seen), 4) AS mean_days, CAST(median(last_seen - first_seen) AS DOUBLE) AS median_days FROM ({LATEST}) GROUP BY 1")),
    "warehouse_city_prices": (
        city_prices,
        oracle("listing", f"""SELECT city, count(*) AS n, round(avg(unit_price), 2) AS avg_price, round(median(unit_price), 2) AS median_price, round(avg(area), 2) AS avg_area,
        round(CAST(sum(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS avg_total FROM ({LATEST}) GROUP BY 1"""),
    ),
    "warehouse_building_age": (building_age, oracle("listing", f"SELECT url_key, CAST(coalesce(age, year(first_seen) - building_year) AS INT) AS age FROM ({LATEST})")),
    "warehouse_dwellings": (
        first_of_dwelling,
        oracle("listing", f"""WITH r AS (SELECT * FROM ({LATEST})), f AS (SELECT * FROM r WHERE community IS NOT NULL AND etl_no % 23 <> 0 AND etl_no % 29 <> 0) SELECT min(url_key) AS url_key FROM f GROUP BY city, community, bedrooms, halls, bathrooms, area, floor, unit_price
        UNION ALL SELECT url_key FROM r WHERE community IS NULL OR etl_no % 23 = 0 OR etl_no % 29 = 0"""),
    ),
    "warehouse_cleaned": (
        cleaned_rows,
        oracle("listing", """SELECT url_key, CASE WHEN line_no = 1 THEN NULL ELSE community END AS community, CASE WHEN line_no IN (2,3,4,5) THEN NULL ELSE area END AS area,
        CAST(CASE WHEN line_no = 4 THEN 0 WHEN line_no = 5 THEN NULL ELSE bedrooms END AS DOUBLE) AS bedrooms, CAST(NULL AS DOUBLE) AS lat FROM listing"""),
    ),
    "warehouse_url_keys": (
        url_keys,
        """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'rent:zu:' || page_id WHEN 1 THEN 'sale:anjuke:A' || page_id WHEN 2 THEN 'sale:58:h-' || page_id
        WHEN 3 THEN 'md5:' || md5('https://zu.anjuke.com/other/' || page_id) ELSE 'md5:' || md5(coalesce(url, '')) END AS url_key FROM pages""",
    ),
    "warehouse_replace": (
        replaced_alerts,
        oracle("listing", """WITH n AS (SELECT DISTINCT url_key FROM listing WHERE line_no = 2 AND city = 'gz' OR line_no = 3 AND city = 'sz')
        SELECT url_key, 'new' AS state FROM n UNION ALL SELECT DISTINCT url_key, 'old' FROM listing WHERE line_no <= 2 AND url_key NOT IN (SELECT url_key FROM n)"""),
    ),
    "warehouse_layer_counts": (
        layer_counts,
        oracle("listing", """SELECT CAST(0 AS INT) AS step, 'ods' AS layer, count(*) AS n FROM listing UNION ALL SELECT 1, 'dwd', count(DISTINCT url_key) FROM listing
        UNION ALL SELECT 2, 'dws', count(DISTINCT city) FROM listing"""),
    ),
    "warehouse_top_cities": (top_cities, oracle("listing", f"SELECT city, count(*) AS n FROM ({LATEST}) GROUP BY 1 ORDER BY n DESC, city LIMIT 5")),
}
