"""Listing warehouse: cleaning, current rows, keyed history, price statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators.merge import one_of_each, upsert
from terravane.operators.selection import medians

#: Numbers of which a zero says nothing, and those of which it does.
ZERO_IS_NULL = ("area", "total_price", "unit_price", "monthly_rent", "building_year", "lat", "lng")
ZERO_COUNTS = ("bedrooms", "halls", "bathrooms", "age", "parking")


def clean(raw: DataFrame) -> DataFrame:
    """Trimmed text, blanks as null, numbers parsed and null where they cannot be."""
    out = {}
    for c in raw.columns:
        if c in ZERO_IS_NULL or c in ZERO_COUNTS:
            out[c] = C.number(F.col(c), c in ZERO_IS_NULL)
        else:
            out[c] = C.blank_to_null(F.col(c))
    return raw.select(*[v.alias(k) for k, v in out.items()])


def latest(listings: DataFrame, tie: list[Column]) -> DataFrame:
    """The row of each key that was seen last, by load number, then ``tie``."""
    return one_of_each(listings, ["url_key"], [F.col("last_seen").desc(), F.col("etl_no").desc(), *tie])


def merge_listings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by url_key: new values where there are any, the first date kept, the days between first and last."""
    merged = upsert(old, new, ["url_key"], {"first_seen": lambda o, n: F.coalesce(o, n)})
    days = F.datediff("last_seen", "first_seen")
    return merged.withColumn("days_on_market", days)


DWELLING = ("city", "community", "bedrooms", "halls", "bathrooms", "area", "floor", "unit_price")


def one_of_each_dwelling(listings: DataFrame, order: list[Column]) -> DataFrame:
    """Listings that agree in all of DWELLING count once; those without a community, an area or a price always stay."""
    told = F.col("community").isNotNull() & F.col("area").isNotNull() & F.col("unit_price").isNotNull()
    return one_of_each(listings.where(told), list(DWELLING), order).unionByName(listings.where(~told))


def repaired_age(age: Column, first_seen: Column, building_year: Column) -> Column:
    return F.coalesce(age, F.year(first_seen) - building_year)


def retention(listings: DataFrame) -> DataFrame:
    """Listings by days on the market; all four buckets, unknown days in the last."""
    bucket = F.when(F.col("days") <= 7, "0-7").when(F.col("days") <= 30, "8-30").when(F.col("days") <= 90, "31-90").otherwise("90+")
    spine = listings.sparkSession.createDataFrame([(b,) for b in ("0-7", "8-30", "31-90", "90+")], "bucket string")
    counted = listings.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def city_stats(listings: DataFrame) -> DataFrame:
    means = listings.groupBy("city").agg(
        F.count("*").alias("n"),
        F.round(F.avg("unit_price"), 2).alias("avg_price"),
        F.round(F.avg("area"), 2).alias("avg_area"),
        F.round(F.try_divide(C.money(F.col("total_price")), F.count("total_price")), 2).alias("avg_total"),
    )
    middle = medians(listings, ["city"], "unit_price", "_m").withColumnRenamed("city", "_city")
    out = means.join(middle, F.col("city").eqNullSafe(F.col("_city")), "left")
    return out.select("city", "n", "avg_price", F.round("_m", 2).alias("median_price"), "avg_area", "avg_total")


def count_checks(**tables: DataFrame) -> DataFrame:
    """Row counts of layers, side by side, each with the one before it."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("layer"), "n")
        out = one if out is None else out.unionByName(one)
    return out
