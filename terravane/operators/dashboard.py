"""Portfolio pages: indicators, histograms, zones and policies, migration, valuation error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import columns as C


def front_page(alerts: DataFrame, collateral: DataFrame, versions: DataFrame, states: DataFrame, today: Column) -> DataFrame:
    """One row: days since the newest alert, share of addresses that can be read, newest model version, and alerts, those confirmed or further, and those disposed."""
    age = alerts.agg(F.datediff(today, F.max("alert_date")).cast("long").alias("age_days"))
    parsed = collateral.agg(F.round(F.avg(C.district(F.trim("property_addr")).isNotNull().cast("double")), 4).alias("parsed"))
    newest = versions.agg(F.max_by("version", F.struct("trained_at", "version")).alias("version"))
    funnel = states.agg(F.count("*").alias("alerts"), F.count_if(F.col("status").isin("confirmed", "disposed")).alias("confirmed"), F.count_if(F.col("status") == "disposed").alias("disposed"))
    return age.crossJoin(parsed).crossJoin(newest).crossJoin(funnel)


def bucket(col: Column, bounds: list[float]) -> Column:
    """Number of the half-open bucket [lo, hi) that a value is in; the last one is open."""
    out = F.when(col.isNull(), None)
    for i, b in enumerate(bounds):
        out = out.when(col < b, i)
    return out.otherwise(len(bounds)).cast("int")


def npl_groups(rows: DataFrame, *by: str) -> DataFrame:
    """Count, balance and non-performing shares of each group."""
    bad = C.class_rank(F.col("risk_class")).between(2, 4)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("loans"),
        C.money(F.col("balance")).alias("balance"),
        F.count_if(bad).alias("npl_loans"),
        F.coalesce(C.money(F.when(bad, F.col("balance"))), F.lit(0.0)).alias("npl_balance"),
        F.round(F.avg("ltv"), 4).alias("avg_ltv"),
        F.count_if("alert").alias("alerts"),
    )
    return out.withColumns({"npl_rate": C.share(F.col("npl_loans").cast("double"), F.col("loans").cast("double")), "npl_balance_rate": C.share(F.col("npl_balance"), F.col("balance"))})


def _in_zones(zones: DataFrame, loans: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of a zone and a loan within its radius (great circle, R = 6371.0 km): q_zone_id and the loan's columns as p_.

    Zones and loans meet by grid cell, so the join grows with neighbourhoods,
    not with loans times zones; the flat distance only picks candidates.
    """
    from terravane.operators.spatial import within

    at = loans.withColumns({"at_lat": F.col("lat"), "at_lng": F.col("lng")})
    spots = zones.select("zone_id", F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"), F.col("center_lat").alias("at_lat"), F.col("center_lng").alias("at_lng"))
    pairs = within(spots, at, radius_km * 1.05)
    return pairs.where(C.haversine_km(F.col("q_at_lat"), F.col("q_at_lng"), F.col("p_at_lat"), F.col("p_at_lng"), 6371.0) <= radius_km)


def policy_list(policies: DataFrame, loans: DataFrame, zones: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """Policies with the loans in their scope, those they hit and which of these are new or of low confidence; enabled and newest first.

    A city's policy covers the loans of the city, a zone's those within the
    radius of its centre; a scope has one policy. A policy without a cap hits all
    loans that have a ratio; loans without one are in scope and never hit. A
    policy whose zone is not there, or that covers nothing, has zeros.
    """
    facts = loans.select("city", "lat", "lng", "ltv", F.col("low_confidence").alias("low"))
    cities = facts.select(F.lit("city").alias("scope_type"), F.col("city").alias("scope_value"), "ltv", "low").where("scope_value is not null")
    asked = zones.join(policies.where("scope_type = 'zone'").select(F.col("scope_value").alias("zone_id")), "zone_id", "left_semi")
    near = _in_zones(asked, facts, radius_km).select(F.lit("zone").alias("scope_type"), F.col("q_zone_id").alias("scope_value"), F.col("p_ltv").alias("ltv"), F.col("p_low").alias("low"))
    scope = ["scope_type", "scope_value"]
    hit = F.col("ltv").isNotNull() & (F.col("ltv_cap").isNull() | (F.col("ltv") > F.col("ltv_cap")))
    sums = cities.unionByName(near).join(policies.select(*scope, "ltv_cap"), scope).groupBy(*scope).agg(
        F.count("*").alias("in_scope"), F.count_if(hit).alias("hit"), F.count_if(hit & (F.col("ltv") <= C.RED)).alias("newly_hit"), F.count_if(hit & F.col("low")).alias("low_confidence")
    )
    figures = ("in_scope", "hit", "newly_hit", "low_confidence")
    out = policies.join(sums, scope, "left").orderBy(F.desc("enabled"), F.desc("updated_at"), F.desc("policy_id"))
    return out.select(*policies.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in figures])


def zone_cover(zones: DataFrame, loans: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """Zones with the number and balance of the loans around them: high-risk zones first, then those that cover most."""
    near = _in_zones(zones, loans.select("lat", "lng", "balance"), radius_km).groupBy(F.col("q_zone_id").alias("zone_id")).agg(F.count("*").alias("loans"), C.money(F.col("p_balance")).alias("balance"))
    out = zones.select("zone_id", "city", "is_high_risk_zone").join(near, "zone_id", "left")
    out = out.select("zone_id", "city", "is_high_risk_zone", F.coalesce("loans", F.lit(0)).alias("loans"), F.coalesce("balance", F.lit(0.0)).alias("balance"))
    return out.orderBy(F.desc("is_high_risk_zone"), F.desc("loans"), "zone_id")


def policy_impact(loans: DataFrame, zones: DataFrame, cap: float, radius_km: float = 5.0) -> DataFrame:
    """For each zone: loans within its radius, those over the cap, and which of these are alerted already."""
    pairs = _in_zones(zones, loans, radius_km)
    hit = F.col("p_ltv") > cap
    return pairs.groupBy(F.col("q_zone_id").alias("zone_id")).agg(
        F.count("*").alias("in_scope"),
        F.count_if(hit).alias("hit"),
        F.count_if(hit & (F.col("p_ltv") <= C.RED)).alias("newly_hit"),
        F.count_if(hit & (F.col("p_ltv") > C.RED)).alias("already_alert"),
        F.count_if(hit & F.col("p_low_confidence")).alias("low_confidence"),
        F.coalesce(C.money(F.when(hit, F.col("p_balance"))), F.lit(0.0)).alias("hit_balance"),
    )


def migration(before: DataFrame, after: DataFrame) -> DataFrame:
    """Loans in both snapshots by class before and after, with balances at the end."""
    joined = before.select("loan_id", F.col("risk_class").alias("from_class")).join(after.select("loan_id", F.col("risk_class").alias("to_class"), "balance"), "loan_id")
    return joined.groupBy("from_class", "to_class").agg(F.count("*").alias("loans"), C.money(F.col("balance")).alias("end_balance"))


def entered_and_left(before: DataFrame, after: DataFrame) -> DataFrame:
    came = after.join(before.select("loan_id"), "loan_id", "left_anti").select("loan_id", F.lit("entered").alias("change"))
    return came.unionByName(before.join(after.select("loan_id"), "loan_id", "left_anti").select("loan_id", F.lit("left").alias("change")))


def roll_rates(snapshots: DataFrame) -> DataFrame:
    """For each pair of consecutive dates and class before: loans in both, and those in a worse class after."""
    from pyspark.sql import Window

    # a row for each date only; dates are few and the window never holds loans
    dates = snapshots.select("snap_date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("snap_date")))
    known = snapshots.join(F.broadcast(dates), "snap_date").withColumn("_rank", C.class_rank(F.col("risk_class"))).where("_rank < 5")
    after = known.select("loan_id", (F.col("_i") - 1).alias("_i"), F.col("_rank").alias("_to"), F.col("snap_date").alias("to_date"))
    pairs = known.select("loan_id", "_i", "risk_class", "_rank", F.col("snap_date").alias("from_date")).join(after, ["loan_id", "_i"])
    out = pairs.groupBy("from_date", "to_date", "risk_class").agg(F.count("*").alias("base"), F.count_if(F.col("_to") > F.col("_rank")).alias("down"))
    return out.withColumn("rate", C.share(F.col("down").cast("double"), F.col("base").cast("double")))


def source_tier(rows: DataFrame) -> DataFrame:
    """Where a valuation came from, told from its values."""
    tier = (
        F.when(F.col("valuation_deviation_pct").isNotNull(), "avm")
        .when(F.col("market_valuation").isNull(), "none")
        .when(F.abs(F.col("market_valuation") - F.col("true_market_price")) < 0.01, "fallback")
        .otherwise("dwd")
    )
    return rows.withColumn("tier", tier)


def deviation_parts(rows: DataFrame) -> DataFrame:
    """Log deviation of estimate and book from the city's unit price, and the city's part of it.

    ``rows``: city, estimate, book, area, city_price.
    """
    known = rows.where("estimate > 0 and book > 0 and area > 0 and city_price > 0")
    a = F.log(F.col("estimate") / (F.col("city_price") * F.col("area")))
    b = -F.log(F.col("book") / (F.col("city_price") * F.col("area")))
    parts = known.withColumns({"a": a, "b": b})
    cities = parts.groupBy("city").agg(F.median("a").alias("a1"))
    out = parts.join(cities, "city").withColumn("a2", F.col("a") - F.col("a1"))
    return out.withColumn("signed", F.exp(F.log(F.col("estimate") / F.col("book"))) - 1)


def grade(rows: Column, age_s: Column, warn: float, bad: float) -> Column:
    return F.when((rows == 0) | age_s.isNull(), "empty").when(age_s >= bad, "bad").when(age_s >= warn, "warn").otherwise("ok")
