"""Risk and reporting queries, each with a DuckDB statement of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators import reporting, risk
from terravane.sources.adapter import CITIES, oracle, views
from terravane.sources.shared import stored

VERSION = "v1"
_CITY = "CASE " + " ".join(f"WHEN contains(property_addr, '{n}') THEN '{c}'" for n, c in CITIES.items()) + " END"
_CLASS = "CASE WHEN ltv IS NULL OR ltv < 0 THEN '次级' WHEN ltv <= 0.60 THEN '正常' WHEN ltv <= 0.75 THEN '关注' WHEN ltv <= 0.85 THEN '次级' WHEN ltv <= 1.00 THEN '可疑' ELSE '损失' END"
RANK = "coalesce(list_position(['正常','关注','次级','可疑','损失'], risk_class) - 1, 5)"
#: DuckDB: enriched loans, over views loan collateral avm listing.
ENRICHED = f"""
SELECT *, CASE WHEN NOT held THEN '损失' WHEN is_high_risk_zone = 1 AND base_class = '正常' THEN '关注' ELSE base_class END AS risk_class,
  CASE WHEN held AND NOT low_confidence THEN CASE WHEN ltv > 0.85 THEN 'strong' WHEN ltv > 0.75 THEN 'warn' END END AS alert_level,
  coalesce(valuation_deviation_pct > 0.30, false) AS abnormal_valuation
FROM (SELECT *, {_CLASS} AS base_class, CASE WHEN held THEN missing_pct > 75 ELSE true END AS low_confidence,
        CASE WHEN avm_hit AND market_valuation > 0 AND true_market_price > 0 THEN round(abs(market_valuation - true_market_price) / true_market_price, 4) END AS valuation_deviation_pct
  FROM (SELECT *, CASE WHEN market_valuation > 0 THEN round(balance / market_valuation, 4) END AS ltv
    FROM (SELECT l.*, c.collateral_id IS NOT NULL AS held, c.missing_pct, c.is_high_risk_zone, c.true_market_price, c.property_addr, c.city,
            a.avm_value IS NOT NULL AS avm_hit, a.avm_value IS NULL AND d.v IS NOT NULL AS dwd_hit,
            CASE WHEN c.collateral_id IS NOT NULL THEN coalesce(a.avm_value, d.v, c.true_market_price, 0) END AS market_valuation
      FROM loan l LEFT JOIN collateral c ON l.collateral_id = c.collateral_id LEFT JOIN avm a ON a.collateral_id = c.collateral_id
      LEFT JOIN (SELECT k.collateral_id, round(p.m * k.area, 2) AS v
        FROM (SELECT *, {_CITY} AS code, regexp_extract(property_addr, '市(..)区', 1) AS dist FROM collateral) k
        JOIN (SELECT city, community, median(unit_price) AS m FROM listing WHERE community IS NOT NULL AND unit_price > 0 GROUP BY 1, 2 HAVING count(*) >= 20) p
          ON p.city = k.code AND p.community = k.dist) d ON d.collateral_id = c.collateral_id)))
"""
BASE = "loan collateral avm listing"


def enriched(spark, sf_dir):
    """Loans with all valuation tiers."""
    loans, collateral, avm, listing = views(spark, sf_dir, *BASE.split())
    valued = risk.with_market_value(collateral, risk.unit_prices(listing), CITIES).join(avm, "collateral_id", "left")
    return risk.enrich(loans, valued, VERSION)


def class_summary(spark, sf_dir):
    loans, collateral = views(spark, sf_dir, "loan", "collateral")
    return risk.class_summary(risk.enrich(loans, collateral)).orderBy("class_rank")


def enriched_loans(spark, sf_dir):
    names = "loan_id customer_id collateral_id market_valuation ltv risk_class low_confidence alert_level alert avm_hit dwd_hit valuation_deviation_pct abnormal_valuation model_version"
    return enriched(spark, sf_dir).select(*names.split())


def unit_prices(spark, sf_dir):
    (listing,) = views(spark, sf_dir, "listing")
    return risk.unit_prices(listing)


def address_parts(spark, sf_dir):
    (collateral,) = views(spark, sf_dir, "collateral")
    a = F.col("property_addr")
    return collateral.select("collateral_id", C.city_in(a, CITIES).alias("city_anywhere"), F.coalesce(C.city_in(a, CITIES, prefix=True), F.lit("未标注")).alias("city_first"), C.city_label(a).alias("label"), C.district(a).alias("district"), C.community(a).alias("community"))


def _overlaid(spark, sf_dir):
    (collateral,) = views(spark, sf_dir, "collateral")
    features = collateral.where("collateral_id % 3 <> 0").select(
        F.col("collateral_id").alias("entity_id"),
        F.when(F.col("collateral_id") % 4 != 0, (F.col("collateral_id") * 5 % 101).cast("double")).alias("missing_pct"),
        F.when(F.col("collateral_id") % 5 != 0, F.concat(F.lit("z"), F.col("collateral_id") % 11)).alias("zone_id"),
    )
    zones = features.where("zone_id is not null and zone_id <> 'z7'").select("zone_id", F.when(F.col("zone_id").isin("z1", "z2"), 1).otherwise(0).alias("is_high_risk_zone")).distinct()
    return risk.overlay_features(collateral, features, zones)


def spatial_overlay(spark, sf_dir):
    return _overlaid(spark, sf_dir).select("collateral_id", "missing_pct", "is_high_risk_zone")


def review_alerts(spark, sf_dir):
    return risk.review_alerts(enriched(spark, sf_dir).withColumn("model_version", F.when(F.col("loan_id") % 10 == 0, "unknown").otherwise(F.col("model_version"))))


def stale_loans(spark, sf_dir):
    """Stored results whose loans are gone."""
    (loans,) = views(spark, sf_dir, "loan")
    stored = loans.select("loan_id")
    return stored.join(loans.where("loan_id % 17 <> 0").select("loan_id"), "loan_id", "left_anti")


def run_report(spark, sf_dir):
    one = lambda c: F.count_if(c)
    return enriched(spark, sf_dir).agg(
        F.count("*").alias("loans"),
        one(F.col("avm_hit")).alias("avm_hits"),
        one(F.col("dwd_hit")).alias("dwd_hits"),
        one(~F.col("avm_hit") & ~F.col("dwd_hit")).alias("fallbacks"),
        one(F.col("ltv") > C.WARN).alias("over_warn"),
        one(F.col("ltv") > C.RED).alias("over_red"),
        one(F.col("alert")).alias("alerts"),
        one(F.col("low_confidence")).alias("low_confidence"),
        one(F.col("abnormal_valuation")).alias("abnormal"),
        F.round(F.avg("valuation_deviation_pct"), 6).alias("deviation_mean"),
        F.max("valuation_deviation_pct").alias("deviation_max"),
    )


def g11_report(spark, sf_dir):
    return reporting.report(enriched(spark, sf_dir)).orderBy("class_rank")


def g11_reconcile(spark, sf_dir):
    detail = stored(risk.class_summary(enriched(spark, sf_dir)), "detail_sums")
    kept = detail.withColumns({"loan_count": F.col("loan_count") + F.when(F.col("class_rank") == 3, 1).otherwise(0), "balance": F.col("balance") + F.when(F.col("class_rank") == 1, 0.01).when(F.col("class_rank") == 2, 5.0).otherwise(0.0)})
    return reporting.reconcile(kept, kept, detail)


def class_state(spark, sf_dir):
    odd = enriched(spark, sf_dir).withColumn("risk_class", F.when(F.col("loan_id") % 100 == 0, "未知").otherwise(F.col("risk_class")))
    return risk.class_summary(odd, keep_unknown=True).orderBy("class_rank")


def _sums(source: str) -> str:
    return f"""SELECT s.risk_class, CAST({RANK.replace("risk_class", "s.risk_class")} AS INT) AS class_rank, CAST(coalesce(n, 0) AS BIGINT) AS loan_count, CAST(coalesce(b, 0) AS DOUBLE) AS balance,
    round(CAST(coalesce(b, 0) AS DOUBLE) / (SELECT CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) FROM {source}), 4) AS balance_pct
    FROM (SELECT unnest(['正常','关注','次级','可疑','损失']) AS risk_class UNION SELECT risk_class FROM {source}) s
    LEFT JOIN (SELECT risk_class, count(*) AS n, sum(CAST(balance AS DECIMAL(18,2))) AS b FROM {source} GROUP BY 1) g ON g.risk_class = s.risk_class"""


_SIMPLE = ENRICHED.replace("LEFT JOIN avm a ON a.collateral_id = c.collateral_id", "LEFT JOIN avm a ON a.collateral_id = c.collateral_id AND false").replace(">= 20", ">= 20 AND false")

QUERIES = {
    "risk_class_summary": (class_summary, oracle(BASE, f"WITH e AS ({_SIMPLE}) {_sums('e')}")),
    "risk_enriched_loans": (
        enriched_loans,
        oracle(BASE, f"SELECT loan_id, customer_id, collateral_id, market_valuation, ltv, risk_class, low_confidence, alert_level, alert_level IS NOT NULL AS alert, avm_hit, dwd_hit, valuation_deviation_pct, abnormal_valuation, '{VERSION}' AS model_version FROM ({ENRICHED})"),
    ),
    "risk_unit_prices": (unit_prices, oracle("listing", "SELECT city, community, median(unit_price) AS median_price, count(*) AS samples FROM listing WHERE community IS NOT NULL AND unit_price > 0 GROUP BY 1, 2 HAVING count(*) >= 20")),
    "risk_address_parts": (
        address_parts,
        oracle("collateral", f"""SELECT collateral_id, {_CITY} AS city_anywhere, {_CITY} AS city_first, split_part(property_addr, '市', 1) || '市' AS label,
        regexp_extract(property_addr, '市(..)区', 1) AS district, '花园' AS community FROM collateral"""),
    ),
    "risk_spatial_overlay": (
        spatial_overlay,
        oracle("collateral", """SELECT collateral_id, CASE WHEN collateral_id % 3 = 0 THEN missing_pct WHEN collateral_id % 4 = 0 THEN 100 ELSE CAST(collateral_id * 5 % 101 AS DOUBLE) END AS missing_pct,
        CAST(CASE WHEN collateral_id % 3 = 0 OR collateral_id % 5 = 0 THEN is_high_risk_zone WHEN collateral_id % 11 IN (1, 2) THEN 1 ELSE 0 END AS INT) AS is_high_risk_zone FROM collateral"""),
    ),
    "risk_review_alerts": (
        review_alerts,
        oracle(BASE, f"""WITH e AS ({ENRICHED}) SELECT loan_id, 'R-UBQ-01' AS code, 'model version unknown' AS detail FROM e WHERE loan_id % 10 = 0
        UNION ALL SELECT loan_id, 'R-UNW-03', printf('deviation %.2f%%', valuation_deviation_pct * 100) FROM e WHERE abnormal_valuation"""),
    ),
    "risk_stale_loans": (stale_loans, oracle("loan", "SELECT loan_id FROM loan WHERE loan_id % 17 = 0")),
    "risk_run_report": (
        run_report,
        oracle(BASE, f"""SELECT count(*) AS loans, count(*) FILTER (avm_hit) AS avm_hits, count(*) FILTER (dwd_hit) AS dwd_hits, count(*) FILTER (NOT avm_hit AND NOT dwd_hit) AS fallbacks,
        count(*) FILTER (ltv > 0.75) AS over_warn, count(*) FILTER (ltv > 0.85) AS over_red, count(alert_level) AS alerts, count(*) FILTER (low_confidence) AS low_confidence,
        count(*) FILTER (abnormal_valuation) AS abnormal, round(avg(valuation_deviation_pct), 6) AS deviation_mean, max(valuation_deviation_pct) AS deviation_max FROM ({ENRICHED})"""),
    ),
    "report_g11": (
        g11_report,
        oracle(BASE, f"""WITH e AS ({ENRICHED}), s AS ({_sums('e')}) SELECT *, CAST(0 AS INT) AS is_total FROM s
        UNION ALL SELECT '合计', CAST(9 AS INT), CAST(sum(loan_count) AS BIGINT), CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE), 1.0, CAST(1 AS INT) FROM s"""),
    ),
    "report_reconcile": (
        g11_reconcile,
        oracle("loan", """SELECT unnest(['report_vs_detail:可疑:loan_count', 'detail_vs_summary:可疑:loan_count', 'report_vs_detail:次级:balance', 'detail_vs_summary:次级:balance', 'detail_vs_summary:total:balance']) AS mismatch"""),
    ),
    "report_class_state": (class_state, oracle(BASE, f"WITH e AS (SELECT * REPLACE (CASE WHEN loan_id % 100 = 0 THEN '未知' ELSE risk_class END AS risk_class) FROM ({ENRICHED})) {_sums('e')}")),
}
