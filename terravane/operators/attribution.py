"""Why valuations differ from book prices: counterfactual classes, mixes, contrasts, self-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators.dashboard import bucket

#: Deviation beyond which a valuation is abnormal, and bounds of the signed histogram.
THRESHOLD = 0.30
HISTOGRAM = [-0.5, -0.3, -0.15, 0.0, 0.15, 0.3, 0.5]


def off(x: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a log deviation is beyond the threshold as a share."""
    return F.abs(F.exp(x) - 1) > threshold


def counterfactual(rows: DataFrame, excluded: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Rows (city, a1, a2, b) with flags of which part alone explains the deviation, and its class.

    a1 is the city's part, a2 the model's, b the book's. The order of the
    classes matters: the model is named only if neither other part explains.
    """
    total = F.col("a1") + F.col("a2") + F.col("b")
    normal = ~off(total, threshold)
    fix = {"fix_a1": ~off(F.col("a2") + F.col("b"), threshold), "fix_b": ~off(F.col("a1") + F.col("a2"), threshold), "fix_a2": ~off(F.col("a1") + F.col("b"), threshold)}
    out = rows.withColumns({k: F.when(~normal, v) for k, v in fix.items()})
    a1, b, a2 = F.col("fix_a1"), F.col("fix_b"), F.col("fix_a2")
    frozen = F.col("city").isin(*excluded) if excluded else F.lit(False)
    kind = (
        F.when(normal, "normal")
        .when(a1 & ~b, F.when(frozen, "city_excluded").otherwise("city_drift"))
        .when(b & ~a1, "book_noise")
        .when(a1 & b, "either")
        .when(a2, "model")
        .otherwise("several")
    )
    return out.withColumn("category", kind)


def summary(classified: DataFrame) -> DataFrame:
    """Rows, share and cities (in order) of each class that is not normal."""
    known = classified.where("category <> 'normal'")
    out = known.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("city")), ",").alias("cities"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row for each class
    return out.withColumn("share", F.round(F.col("n") / total, 4))


def mix(classified: DataFrame) -> DataFrame:
    """Whose deviation it is: of the book, of the model side, or of both."""
    side = F.when(F.col("category") == "book_noise", "baseline").when(F.col("category").isin("city_excluded", "city_drift", "model"), "model").otherwise("mixed")
    out = classified.where("category <> 'normal'").groupBy(side.alias("side")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def dimension(rows: DataFrame, *by: str) -> DataFrame:
    """Number, abnormal share, and median absolute and signed deviation (signed) of each group."""
    s = F.col("signed")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg((F.abs(s) > THRESHOLD).cast("double")), 4).alias("abnormal_rate"), F.round(F.median(F.abs(s)), 6).alias("median_abs"), F.round(F.median(s), 6).alias("median_signed")
    )


def overview(rows: DataFrame) -> DataFrame:
    """Number, over- and undervalued rows (signed), and different versions and tiers."""
    s = F.col("signed")
    return rows.agg(F.count("*").alias("n"), F.count_if(s > THRESHOLD).alias("over"), F.count_if(s < -THRESHOLD).alias("under"), F.count_distinct("tier").alias("tiers"), F.count_distinct("model_version").alias("versions"))


def histogram(rows: DataFrame) -> DataFrame:
    """Rows in each of the eight half-open buckets of the signed deviation."""
    spine = rows.sparkSession.createDataFrame([(i,) for i in range(len(HISTOGRAM) + 1)], "bucket int")
    n = rows.groupBy(bucket(F.col("signed"), HISTOGRAM).alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def queue(rows: DataFrame, offset: int, most: int) -> DataFrame:
    """A page of abnormal rows by deviation, then id."""
    return rows.where(F.abs("signed") > THRESHOLD).orderBy(F.desc(F.abs("signed")), "collateral_id").offset(offset).limit(most)


def contrast(rows: DataFrame) -> DataFrame:
    """Cities' frozen unit price against the one that estimates imply, and how far rows of a city are apart.

    ``rows``: city, estimate, area, city_price.
    """
    implied = rows.where("estimate > 0 and area > 0").withColumn("_p", F.col("estimate") / F.col("area"))
    out = implied.groupBy("city").agg(F.count("*").alias("n"), F.median("_p").alias("_m"), F.max("city_price").alias("_f"), F.max("_p").alias("_hi"), F.min("_p").alias("_lo"), F.avg("_p").alias("_mean"))
    return out.select("city", "n", F.round("_m", 2).alias("implied"), F.round(F.try_divide("_m", "_f"), 4).alias("ratio"), F.round((F.col("_hi") - F.col("_lo")) / F.col("_mean"), 4).alias("spread"))


def city_ranks(rows: DataFrame) -> DataFrame:
    """Rank of each city by its estimates' and by its books' median unit price, and whether they agree.

    ``rows``: city, estimate, book, area. The windows hold a row for each city.
    """
    known = rows.where("area > 0")
    m = known.groupBy("city").agg(F.median(F.col("estimate") / F.col("area")).alias("_e"), F.median(F.col("book") / F.col("area")).alias("_b"))
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(c, 6))))
    out = m.select("city", rank("_e").alias("by_estimate"), rank("_b").alias("by_book"), F.round(F.try_divide("_e", "_b"), 4).alias("ratio"))
    return out.withColumn("agrees", F.col("by_estimate") == F.col("by_book"))


def dropped_cities(cities: DataFrame, scored: DataFrame) -> DataFrame:
    """Cities without a single scored row."""
    return cities.join(scored.select("city"), "city", "left_anti")


def lineage(versions: DataFrame) -> DataFrame:
    """Model versions (version, trained_at, mape) with the change of MAPE since the one before; a row for each version."""
    w = Window.partitionBy(F.lit(1)).orderBy("trained_at", "version")
    return versions.withColumn("delta", F.round(F.col("mape") - F.lag("mape").over(w), 3))


def next_version(versions: DataFrame, day: str) -> DataFrame:
    """(version): the day and r with the number after the day's highest."""
    n = F.regexp_extract("version", f"^{day}-r([0-9]+)$", 1).try_cast("int")
    return versions.agg(F.concat(F.lit(f"{day}-r"), (F.coalesce(F.max(n), F.lit(0)) + 1).cast("string")).alias("version"))


def position_segments(rows: DataFrame) -> DataFrame:
    """MAPE and number of rows (ape, lat, community) by what is known of their position."""
    known = F.when(F.col("lat").isNotNull() & F.col("community").isNotNull(), "both").when(F.col("lat").isNotNull(), "place").when(F.col("community").isNotNull(), "community").otherwise("none")
    return rows.groupBy(known.alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("ape") * 100, 3).alias("mape"))


def zone_shares(rows: DataFrame) -> DataFrame:
    """Non-performing shares of loans in high-risk zones, of the others and of all, and how far the first are above the second (lift)."""
    bad = C.class_rank(F.col("risk_class")).between(2, 4)
    sides = F.array(F.when(F.coalesce("is_high_risk_zone", F.lit(0)) != 0, "high").otherwise("normal"), F.lit("total"))
    groups = rows.select("balance", bad.alias("_bad"), F.explode(sides).alias("side")).groupBy("side")
    out = groups.agg(F.count("*").alias("loans"), F.count_if("_bad").alias("npl_loans"), C.money(F.col("balance")).alias("balance"), F.coalesce(C.money(F.when(F.col("_bad"), F.col("balance"))), F.lit(0.0)).alias("npl_balance"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    out = out.withColumns({"npl_rate": rate("npl_loans", "loans"), "npl_balance_rate": rate("npl_balance", "balance")})
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("npl_rate"))).over(Window.partitionBy(F.lit(1)))  # noqa: E731  three rows
    out = out.withColumn("lift", F.when(F.col("side") == "high", F.round(F.try_divide(of("high"), of("normal")), 4)))
    return out.withColumns({c: F.round(c, 4) for c in ("npl_rate", "npl_balance_rate")})
