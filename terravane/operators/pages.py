"""Spatial and policy pages: means, drill-downs, options, suggestions, features of communities and collateral; the prototype's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators import spatial
from terravane.operators.attribution import HISTOGRAM
from terravane.operators.dashboard import bucket, policy_impact

_MEANS = ("poi_density", "commute_min", "price_deviation")


def feature_means(features: DataFrame, by: str) -> DataFrame:
    """Means of listings' features for each zone or city."""
    known = features.where(f"entity_type = 'listing' and {by} is not null")
    return known.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in _MEANS])


def loan_features(loans: DataFrame, features: DataFrame) -> DataFrame:
    """Loans with the spatial features of their collateral, whose id is text in the features."""
    own = features.where("entity_type = 'collateral'").select(F.col("entity_id").alias("_entity"), "zone_id", *_MEANS)
    return loans.join(own, F.col("collateral_id").cast("string") == F.col("_entity"), "left").drop("_entity")


def zone_drill_down(features: DataFrame, loans: DataFrame, zone: str, lat: float, lng: float, radius_km: float = 5.0, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A zone's means by kind of entity, its histogram of price deviations, and the loans nearest to its centre."""
    mine = features.where(F.col("zone_id") == zone)
    means = mine.groupBy("entity_type").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in _MEANS])
    spine = features.sparkSession.createDataFrame([(i,) for i in range(len(HISTOGRAM) + 1)], "bucket int")
    counts = mine.where("price_deviation is not null").groupBy(bucket(F.col("price_deviation"), HISTOGRAM).alias("bucket")).agg(F.count("*").alias("n"))
    buckets = F.broadcast(spine).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    dx, dy = C.east_km(F.col("lng")) - C.east_km(F.lit(lng)), C.north_km(F.col("lat")) - C.north_km(F.lit(lat))
    near = loans.withColumn("km", F.sqrt(dx * dx + dy * dy)).where(F.col("km") <= radius_km).orderBy("km", "loan_id").limit(most)
    return means, buckets, near


def city_options(zones: DataFrame, loans: DataFrame) -> DataFrame:
    """Cities that have zones or loans, with the numbers of both."""
    a, b = zones.groupBy("city").agg(F.count("*").alias("zones")), loans.where("city is not null").groupBy("city").agg(F.count("*").alias("loans"))
    return a.join(b, "city", "full").select("city", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("zones", "loans")])


def zone_of_loans(loans: DataFrame, zones: DataFrame, side: float, start_km: float = 20.0) -> DataFrame:
    """Loans by whether their grid cell is a zone's, and the mean distance to the nearest zone's centre."""
    placed = loans.where("lat is not null and lng is not null")
    cell = lambda c: F.floor(F.col(c) / F.lit(side))
    held = zones.select(cell("center_lng").alias("_gx"), cell("center_lat").alias("_gy")).distinct().withColumn("_in", F.lit(True))
    spots = placed.select("lat", "lng").distinct().withColumn("spot", F.xxhash64("lat", "lng"))
    centres = zones.select(F.xxhash64("zone_id").alias("spot"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    near = spatial.nearest(spots, centres, "spot", 1, start_km, drop_self=False).select("spot", "km")
    out = placed.withColumns({"_gx": cell("lng"), "_gy": cell("lat"), "spot": F.xxhash64("lat", "lng")}).join(held, ["_gx", "_gy"], "left").join(near, "spot", "left")
    return out.groupBy(F.coalesce("_in", F.lit(False)).alias("in_zone")).agg(F.count("*").alias("loans"), F.round(F.avg("km"), 4).alias("mean_km"))


def policy_suggestions(loans: DataFrame, zones: DataFrame, cap: float, most: int) -> DataFrame:
    """High-risk zones whose loans a cap would hit, those with most hits first; the impact of all zones is one grouped join."""
    hit = policy_impact(loans, zones.where("is_high_risk_zone = 1"), cap).where("hit > 0")
    return hit.orderBy(F.desc("hit"), "zone_id").limit(most).select("zone_id", "in_scope", "hit")


def community_features(places: DataFrame, key: str, radius_km: float = 5.0, least: int = 5) -> DataFrame:
    """Communities of (city, community): median place and price, and how far the price is from its neighbours', its own places left out."""
    known = places.where("community is not null and community <> ''")
    own = known.groupBy("city", "community").agg(F.median("lat").alias("lat"), F.median("lng").alias("lng"), F.median("unit_price").alias("price"))
    near = spatial.within(own.select("city", "community", "lat", "lng"), places.select("city", "community", "lat", "lng", "unit_price"), radius_km)
    other = ~(F.col("q_city").eqNullSafe(F.col("p_city")) & F.col("q_community").eqNullSafe(F.col("p_community")))
    m = near.where(other).groupBy(F.col("q_city").alias("city"), F.col("q_community").alias("community")).agg(F.count("*").alias("_n"), F.median("p_unit_price").alias("_m"))
    off = F.when(F.col("_n") >= least, F.round(F.try_divide(F.col("price") - F.col("_m"), F.col("_m")), 4))
    return own.join(m, ["city", "community"], "left").select(F.concat_ws("|", "city", "community").alias("entity_id"), F.col("city").alias("district"), "lat", "lng", off.alias("price_deviation"))


def collateral_features(collateral: DataFrame, places: DataFrame, ltv_zones: DataFrame, side: float, radius_km: float = 5.0) -> DataFrame:
    """Collateral with the zone of its cell and how far its book price for a square metre is from its neighbourhood's."""
    near = spatial.neighbourhood_median(collateral.select("collateral_id", "lat", "lng"), places.select(F.lit(-1).alias("collateral_id"), "lat", "lng", "unit_price"), "collateral_id", "unit_price", radius_km, other_than_self=False)
    cell = lambda c: F.floor(F.col(c) / F.lit(side))
    zones = ltv_zones.select(cell("center_lng").alias("_gx"), cell("center_lat").alias("_gy"), "zone_id")
    unit = F.when(F.col("area") > 0, F.col("true_market_price") / F.col("area"))
    out = collateral.join(near, "collateral_id", "left").withColumns({"_gx": cell("lng"), "_gy": cell("lat")}).join(zones, ["_gx", "_gy"], "left")
    return out.withColumn("price_deviation", F.try_divide(unit - F.col("neighbourhood"), F.col("neighbourhood"))).drop("_gx", "_gy", "neighbours", "neighbourhood")


def prototype_state(ltv: Column, missing: Column) -> Column:
    """The prototype's four states; none without a valuation."""
    over, low = ltv > C.RED, missing > 0.20
    return F.when(ltv.isNull(), "none").when(over & low, "review").when(over, "alert").when(low, "low confidence").otherwise("normal")


def grid_average(points: DataFrame, value: str) -> DataFrame:
    """Number and mean for each cell of a tenth of a degree, cut towards zero."""
    cell = F.concat_ws(":", *[(F.col(c) * 10).cast("bigint").cast("string") for c in ("lat", "lng")])
    return points.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("average"))


def consistent(layers: dict[str, tuple[DataFrame, DataFrame]], eps: float = 0.02) -> DataFrame:
    """Whether two layers' balances differ by no more than ``eps``."""
    out = None
    for name, (a, b) in layers.items():
        sums = [df.agg(C.money(F.col("balance")).alias(n)) for df, n in ((a, "_a"), (b, "_b"))]
        one = sums[0].crossJoin(sums[1]).select(F.lit(name).alias("layer"), (F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))) <= eps).alias("consistent"))
        out = one if out is None else out.unionByName(one)
    return out
