"""Change events: impact planning, incremental recomputation, stream alerts, delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators.merge import delete_keys, replace_keys


def plan_impact(changes: DataFrame, loans: DataFrame) -> DataFrame:
    """(loan_id, action) of a batch of changes (table_name, event_type, entity_id): recalc or delete; a delete wins."""
    known = changes.where("entity_id is not null")
    own = known.where("table_name = 'loan'").select(F.col("entity_id").alias("loan_id"), (F.col("event_type") == "DELETE").alias("gone"))
    out = own
    for table, key in (("collateral", "collateral_id"), ("customer", "customer_id")):
        touched = known.where(F.col("table_name") == table).select(F.col("entity_id").alias(key)).distinct()
        out = out.unionByName(loans.join(touched, key, "left_semi").select("loan_id", F.lit(False).alias("gone")))
    return out.groupBy("loan_id").agg(F.max("gone").alias("gone")).select("loan_id", F.when(F.col("gone"), "delete").otherwise("recalc").alias("action"))


def recompute(state: DataFrame, plan: DataFrame, loans: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored results with the planned loans computed anew or deleted; the others are not touched."""
    wanted = loans.join(plan.where("action = 'recalc'"), "loan_id", "left_semi")
    kept = delete_keys(state, plan.where("action = 'delete'"), ["loan_id"])
    return replace_keys(kept, compute(wanted), ["loan_id"])


def alerts(changes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Alerts of loan inserts and updates whose unrounded ratio is over the red line; a stream or a table.

    ``dimension``: loan_id, market_valuation. It is read when the batch is.
    """
    live = changes.where("table_name = 'loan' and event_type in ('INSERT', 'UPDATE')").withColumn("loan_id", F.col("entity_id"))
    joined = live.join(dimension.where("market_valuation > 0").select("loan_id", "market_valuation"), "loan_id")
    ratio = F.col("balance") / F.col("market_valuation")
    return joined.where(ratio > C.RED).select(F.col("id").alias("event_id"), "loan_id", F.round(ratio, 4).alias("ltv"), C.classify(ratio).alias("risk_class"), F.to_date("cdc_ts").alias("alert_date"))


def run_alerts(changes: DataFrame, read_dimension: Callable[[], DataFrame], inbox: str, checkpoint: str):
    """Stream query that appends alerts of new changes to ``inbox``; a replayed batch changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        # a batch owns its folder, so that running it again overwrites what it wrote
        alerts(df, read_dimension()).dropDuplicates(["event_id"]).write.mode("overwrite").parquet(f"{inbox}/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(changes: DataFrame) -> DataFrame:
    """Events of each hour of the log's last 24, zeros included."""
    hours = changes.groupBy(F.date_trunc("hour", "cdc_ts").alias("hour")).agg(F.count("*").alias("n"))
    last = changes.agg(F.date_trunc("hour", F.max("cdc_ts")).alias("_last"))
    spine = last.select(F.explode(F.sequence(F.col("_last") - F.expr("interval 23 hours"), F.col("_last"), F.expr("interval 1 hour"))).alias("hour"))
    return F.broadcast(spine).join(hours, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def consumer_lag(changes: DataFrame, offsets: DataFrame, consumers: list[str]) -> DataFrame:
    """Newest id less each consumer's offset; the whole log for one that has none."""
    spine = changes.sparkSession.createDataFrame([(c,) for c in consumers], "consumer string")
    top = changes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return F.broadcast(spine).join(offsets, "consumer", "left").crossJoin(top).select("consumer", (F.col("_top") - F.coalesce("last_id", F.lit(0))).alias("lag"))


def dispatch(pending: DataFrame, ledger: DataFrame) -> DataFrame:
    """What to do with each alert by its ledger row: dedup, final_failed, retry or first."""
    joined = pending.join(ledger, ["loan_id", "alert_date"], "left")
    action = F.when(F.col("status") == "success", "dedup").when((F.col("status") == "failed") & (F.col("attempt_count") >= F.col("max_retries")), "final_failed").when(F.col("status") == "failed", "retry").otherwise("first")
    return joined.select("loan_id", "alert_date", action.alias("action"), F.when(action.isin("retry", "first"), F.coalesce("attempt_count", F.lit(0)) + 1).alias("attempt"))
