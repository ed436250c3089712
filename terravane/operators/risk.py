"""Loan risk: valuation tiers, loan-to-value, classes, alerts, class summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators.selection import percentiles


def unit_prices(listings: DataFrame, least: int = 20) -> DataFrame:
    """Median unit price of each (city, community) with ``least`` listings or more."""
    known = listings.where("city is not null and community is not null and community <> '' and unit_price > 0")
    grouped = percentiles(known, ["city", "community"], "unit_price", median_price=0.5).withColumnRenamed("n", "samples")
    return grouped.where(F.col("samples") >= least).select("city", "community", "median_price", "samples")


def with_market_value(collateral: DataFrame, prices: DataFrame, cities: dict[str, str]) -> DataFrame:
    """Add ``dwd_value``: the median price of the address's district times the area; null without one."""
    addressed = collateral.withColumn("_city", C.city_in(F.col("property_addr"), cities)).withColumn("_district", C.district(F.trim("property_addr")))
    keyed = prices.select(F.col("city").alias("_city"), F.col("community").alias("_district"), F.col("median_price").alias("_price"))
    # as many rows as districts are priced: unbounded in principle, so Spark decides how to join
    value = F.round(F.nullif(F.col("_price"), F.lit(0.0)) * F.nullif(F.col("area"), F.lit(0.0)), 2)
    return addressed.join(keyed, ["_city", "_district"], "left").withColumn("dwd_value", value).drop("_city", "_district", "_price")


def enrich(loans: DataFrame, collateral: DataFrame, version: str | None = None, round_first: bool = True) -> DataFrame:
    """One row for each loan with its valuation, ratio, class and alert.

    ``collateral`` may hold avm_value and dwd_value. Without collateral a loan
    is a loss without an alert. ``round_first`` compares the rounded ratio with
    the alert lines.
    """
    held = collateral.withColumn("_held", F.lit(True))
    for c in ("avm_value", "dwd_value"):
        if c not in held.columns:
            held = held.withColumn(c, F.lit(None).cast("double"))
    held = held.select("collateral_id", "_held", "avm_value", "dwd_value", "true_market_price", "missing_pct", "is_high_risk_zone")
    wide = loans.join(held, "collateral_id", "left")
    has = F.col("_held").isNotNull()
    wide = wide.withColumn("market_valuation", F.when(has, F.coalesce("avm_value", "dwd_value", "true_market_price", F.lit(0.0))))
    ratio = F.when(F.col("market_valuation") > 0, F.try_divide(F.coalesce("balance", F.lit(0.0)), F.col("market_valuation")))
    wide = wide.withColumn("_ratio", ratio).withColumn("ltv", C.rounded(F.col("_ratio"), 4))
    base = F.coalesce("true_market_price", F.lit(0.0))
    off = F.when(F.col("avm_value").isNotNull() & (F.col("market_valuation") > 0) & (base > 0), C.rounded(F.abs(F.col("market_valuation") - base) / base, 4))
    low = F.when(has, F.coalesce("missing_pct", F.lit(0.0)) > C.LOW_CONFIDENCE).otherwise(True)
    line = F.col("ltv") if round_first else F.col("_ratio")
    wide = wide.withColumns({"valuation_deviation_pct": off, "low_confidence": low, "_class": C.classify(F.col("ltv"))})
    risky = (F.coalesce("is_high_risk_zone", F.lit(0)) != 0) & (F.col("_class") == C.CLASSES[0])
    level = F.when(has & ~F.col("low_confidence"), F.when(line > C.RED, "strong").when(line > C.WARN, "warn"))
    wide = wide.withColumns(
        {
            "risk_class": F.when(~has, C.CLASSES[-1]).when(risky, C.CLASSES[1]).otherwise(F.col("_class")),
            "alert_level": level,
            "alert": level.isNotNull(),
            "avm_hit": F.col("avm_value").isNotNull(),
            "dwd_hit": F.col("avm_value").isNull() & F.col("dwd_value").isNotNull(),
            "abnormal_valuation": F.coalesce(F.col("valuation_deviation_pct") > C.ABNORMAL, F.lit(False)),
            "model_version": F.coalesce(F.lit(version), F.lit("unknown")),
        }
    )
    return wide.drop("_held", "_ratio", "_class", "avm_value", "dwd_value", "missing_pct")


def overlay_features(collateral: DataFrame, features: DataFrame, zones: DataFrame) -> DataFrame:
    """Collateral with the latest build's spatial features, and the zone's flag where a zone is set."""
    f = features.select(F.col("entity_id").alias("collateral_id"), F.col("missing_pct").alias("_missing"), "zone_id", F.lit(True).alias("_known"))
    z = zones.select("zone_id", F.col("is_high_risk_zone").alias("_flag"))
    out = collateral.join(f, "collateral_id", "left").join(z, "zone_id", "left")
    return out.withColumns(
        {
            "missing_pct": F.when(F.col("_known"), F.coalesce("_missing", F.lit(100.0))).otherwise(F.col("missing_pct")),
            "is_high_risk_zone": F.when(F.col("zone_id").isNotNull(), F.coalesce("_flag", F.lit(0))).otherwise(F.col("is_high_risk_zone")).cast("int"),
        }
    ).drop("_missing", "_known", "_flag", "zone_id")


def scaled_missing(collateral: DataFrame) -> DataFrame:
    """Missing shares in percent: a share of 1 or less was stored as a part of one."""
    m = F.col("missing_pct")
    return collateral.withColumn("missing_pct", F.when(m <= 1, m * 100).otherwise(m))


def with_customers(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Loans with their customers' credit score, income and debt ratio, null where a customer is not known."""
    return loans.join(customers.select("customer_id", "credit_score", "income", "debt_ratio"), "customer_id", "left")


def latest_build(features: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Rows of the newest build of each kind of entity; a table that is not there counts as empty."""
    if features is None:
        return spark.createDataFrame([], "entity_type string, entity_id long, build_date int")
    newest = features.groupBy("entity_type").agg(F.max("build_date").alias("build_date"))
    return features.join(newest, ["entity_type", "build_date"], "left_semi")


def spine(spark: SparkSession) -> DataFrame:
    """The five classes and their ranks."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(C.CLASSES)], "risk_class string, class_rank int")


def class_summary(rows: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Count, balance and share of each class; all five are always there.

    Unknown classes are left out, or with ``keep_unknown`` kept and part of the denominator.
    """
    sums = rows.groupBy("risk_class").agg(F.count("*").alias("loan_count"), C.money(F.coalesce("balance", F.lit(0.0))).alias("balance"))
    five = spine(rows.sparkSession)
    out = sums.join(F.broadcast(five), "risk_class", "full") if keep_unknown else F.broadcast(five).join(sums, "risk_class", "left")
    out = out.select("risk_class", F.coalesce("class_rank", F.lit(5)).alias("class_rank"), F.coalesce("loan_count", F.lit(0)).alias("loan_count"), F.coalesce("balance", F.lit(0.0)).alias("balance"))
    # the window holds the classes' rows, so that loans are read once
    total = F.sum(F.col("balance").cast("decimal(18,2)")).over(Window.partitionBy(F.lit(1))).cast("double")
    return out.withColumn("_total", total).withColumn("balance_pct", F.coalesce(C.share(F.col("balance"), F.col("_total")), F.lit(0.0))).drop("_total")


def review_alerts(enriched: DataFrame) -> DataFrame:
    """Up to two review rows for a loan: an unknown model version, an abnormal valuation."""
    found = F.array_compact(
        F.array(
            F.when(F.col("model_version") == "unknown", F.struct(F.lit("R-UBQ-01").alias("code"), F.lit("model version unknown").alias("detail"))),
            F.when(F.col("abnormal_valuation"), F.struct(F.lit("R-UNW-03").alias("code"), F.format_string("deviation %.2f%%", F.col("valuation_deviation_pct") * 100).alias("detail"))),
        )
    )
    return enriched.select("loan_id", F.explode(found).alias("a")).select("loan_id", "a.code", "a.detail")
