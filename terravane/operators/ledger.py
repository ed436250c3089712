"""Stored tables that pages and jobs keep: inboxes, ledgers, confirmations, policies, audit, snapshots.

Each function gives the table after a change; the caller writes it, or the
partitions that it touches. A change that is made twice leaves what it left
the first time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators.merge import delete_keys, one_of_each, replace_keys, upsert

LOAN_DAY = ["loan_id", "alert_date"]


def inbox(old: DataFrame, new: DataFrame) -> DataFrame:
    """Alerts by loan and day: known ones get the new values in place, with the time of their first arrival."""
    return upsert(old, new, LOAN_DAY, {"received_at": lambda o, n: F.coalesce(o, n)})


def record_deliveries(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The dispatch ledger after results (loan_id, alert_date, status): attempts counted up, the stored bound of retries kept."""
    fresh = results.select("loan_id", "alert_date", "status", F.lit(1).alias("attempt_count"), F.lit(3).alias("max_retries"))
    return upsert(ledger, fresh, LOAN_DAY, {"attempt_count": lambda o, n: (F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0))).cast("int"), "max_retries": lambda o, n: F.coalesce(o, n)})


def confirm(old: DataFrame, new: DataFrame) -> DataFrame:
    """Confirmations (loan_id, alert_date, confirmed_by, confirmed_at, status): the last writer is kept, the status becomes confirmed."""
    return upsert(old, new.withColumn("status", F.lit("confirmed")), LOAN_DAY)


def dispose(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same after disposals (loan_id, alert_date, disposed_by, disposed_at): whoever confirmed first stays; a disposal without a confirmation confirms."""
    wide = new.select("*", F.col("disposed_by").alias("confirmed_by"), F.col("disposed_at").alias("confirmed_at"), F.lit("disposed").alias("status"))
    keep = lambda o, n: F.coalesce(o, n)
    return upsert(old, wide, LOAN_DAY, {"confirmed_by": keep, "confirmed_at": keep})


def replace_day(old: DataFrame, batch: DataFrame, day: Column | str, alerting: Column) -> DataFrame:
    """Alerts after a batch of loans was judged again: the day's rows of all its loans go, those that alert come."""
    of_day = F.col("alert_date") == F.to_date(F.lit(day) if isinstance(day, str) else day)
    gone = old.where(of_day).join(batch.select("loan_id"), "loan_id", "left_semi").select(*LOAN_DAY)
    return delete_keys(old, gone.distinct(), LOAN_DAY).unionByName(batch.where(alerting).select(*old.columns))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, day: str, dated: tuple[str, ...]) -> dict[str, DataFrame]:
    """Tables without deleted loans; of the ``dated`` ones only that day's rows go."""
    out = {}
    for name, df in tables.items():
        if name in dated:
            lost = gone.select("loan_id", F.to_date(F.lit(day)).alias("alert_date"))
            out[name] = df.join(lost, LOAN_DAY, "left_anti")
        else:
            out[name] = df.join(gone, "loan_id", "left_anti")
    return out


def replace_partition(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Rows of ``new`` in place of all rows of the partitions (a build, a date, a date and class) that it has."""
    return replace_keys(old, new, list(by))


def without_demo(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("coalesce(is_demo, 0) = 0")


def snapshot_dates(snapshots: DataFrame) -> DataFrame:
    """Each snapshot's loans, and whether any is for demonstration; newest first."""
    return snapshots.groupBy("snap_date").agg(F.count("*").alias("n"), F.max("is_demo").alias("is_demo")).orderBy(F.desc("snap_date"))


def default_dates(snapshots: DataFrame, asked: DataFrame) -> DataFrame:
    """(from_date, to_date, message) of a migration page: what was asked for in order, or the last two dates; a message with fewer than two.

    ``asked`` is one row (from_date, to_date), null for no wish.
    """
    dates = snapshots.select("snap_date").distinct().orderBy(F.desc("snap_date")).limit(2)
    held = dates.agg(F.count("*").alias("_n"), F.min("snap_date").alias("_a"), F.max("snap_date").alias("_b"))
    a, b = F.coalesce("from_date", "_a"), F.coalesce("to_date", "_b")
    enough = F.col("_n") > 1
    return asked.crossJoin(held).select(
        F.when(enough, F.least(a, b)).alias("from_date"), F.when(enough, F.greatest(a, b)).alias("to_date"), F.when(~enough, "fewer than two snapshots").alias("message")
    )


SCOPE = ["scope_type", "scope_value"]


def checked_policies(policies: DataFrame) -> DataFrame:
    """Policies (action, ltv_cap, ...) with ``problem``: a cap out of (0, 2], or none where loans are rejected or held stricter."""
    cap = F.col("ltv_cap")
    bad = F.when(F.col("action").isin("reject", "strict") & cap.isNull(), "cap is missing").when((cap <= 0) | (cap > 2), "cap is out of bounds")
    return policies.withColumn("problem", bad)


def upsert_policies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Policies by scope: sound ones replace the scope's policy, its cap too if they have none; the policy keeps its id and its first date."""
    sound = checked_policies(new).where("problem is null").drop("problem")
    keep = lambda o, n: F.coalesce(o, n)
    held = lambda df: df.withColumn("ltv_cap", F.struct("ltv_cap"))  # noqa: E731  a cap that is null differs from a policy that is not there
    out = upsert(held(old), held(sound), SCOPE, {"policy_id": keep, "created_at": keep})
    return out.withColumn("ltv_cap", F.col("ltv_cap.ltv_cap"))


def delete_policies(old: DataFrame, ids: DataFrame, user: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Policies without ``ids``, and an audit row for each that went."""
    gone = old.join(ids, "policy_id", "left_semi")
    audit = gone.select(F.lit(user).alias("user"), F.lit("policy_delete").alias("action"), F.to_json(F.struct(*old.columns)).alias("detail"), at.alias("ts"))
    return old.join(ids, "policy_id", "left_anti"), audit


def scope_label(kind: Column, value: Column) -> Column:
    return F.when(kind == "zone", F.concat(F.lit("zone "), value)).when(kind == "city", F.concat(F.lit("city "), value)).otherwise(F.coalesce(value, F.lit("all")))


def toggled(registry: DataFrame, source: str, flag: str, on: bool) -> DataFrame:
    """The source registry with one of its two flags set."""
    if flag not in ("enabled", "scheduled"):
        raise ValueError(f"unknown flag {flag}")
    return registry.withColumn(flag, F.when(F.col("source") == source, F.lit(int(on))).otherwise(F.col(flag)).cast("int"))


def in_order_of(col: Column, *values: str) -> Column:
    """Place of a value in a fixed order, others last."""
    at = F.array_position(F.array(*map(F.lit, values)), F.coalesce(col, F.lit("")))
    return F.when(at > 0, at).otherwise(len(values) + 1).cast("int")


def table_health(tables: dict[str, tuple[DataFrame, str]], now: Column) -> DataFrame:
    """Rows, newest time and its age in seconds of each table."""
    out = None
    for name, (df, ts) in tables.items():
        one = df.agg(F.count("*").alias("rows"), F.max(F.col(ts).cast("timestamp")).alias("newest")).select(F.lit(name).alias("table"), "rows", "newest")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("age_s", F.unix_timestamp(now) - F.unix_timestamp("newest"))


# fixed values: what is worse than what
STATES = ("ok", "idle", "empty", "warn", "bad")


def worst(states: DataFrame, *by: str) -> DataFrame:
    """The worst state of each group: bad, warn, empty only if all are, idle, ok."""
    s = F.col("status")
    fold = F.when(F.max(s == "bad"), "bad").when(F.max(s == "warn"), "warn").when(F.min(s == "empty"), "empty").when(F.max(s == "idle"), "idle").otherwise("ok")
    return states.groupBy(*by).agg(fold.alias("status"))


def least_age(health: DataFrame) -> DataFrame:
    """Age of what is newest among all tables."""
    return health.agg(F.min("age_s").alias("age_s"))


def level_of(columns: DataFrame, levels: DataFrame) -> DataFrame:
    """Columns (table, column) with their level: their own, else their table's, else none; of several the most sensitive (level_rank)."""
    ranked = levels.groupBy("table", "column").agg(F.max("level_rank").alias("level_rank"))
    own = ranked.where("column <> '*'").withColumnRenamed("level_rank", "_own")
    whole = ranked.where("column = '*'").select("table", F.col("level_rank").alias("_whole"))
    out = columns.join(own, ["table", "column"], "left").join(whole, "table", "left")
    return out.select("table", "column", F.coalesce("_own", "_whole").alias("level_rank"))


def audit_page(audit: DataFrame, most: int = 200) -> DataFrame:
    """The newest audit rows with the number of rows that their action touched, read from its JSON."""
    rows = F.coalesce(F.get_json_object("detail", "$.rows").try_cast("long"), F.lit(0))
    return audit.withColumn("touched", rows).orderBy(F.desc("ts"), F.desc("audit_id")).limit(most)


def audit_totals(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"), F.max("ts").alias("newest"))


def either_alert(offline: DataFrame, stream: DataFrame, loan_id: int) -> DataFrame:
    """One loan's alerts of both kinds, newest first; the filter goes into both scans."""
    both = offline.select("loan_id", "ltv", "alert_date", F.lit("offline").alias("source")).unionByName(stream.select("loan_id", "ltv", "alert_date", F.lit("stream").alias("source")))
    return both.where(F.col("loan_id") == loan_id).orderBy(F.desc("alert_date"), "source")


def top_alerts(alerts: DataFrame, day: str, n: int, least: float = 0.0) -> DataFrame:
    """A day's n alerts of the highest ratio, from ``least`` on, ties by loan."""
    return alerts.where((F.col("alert_date") == F.to_date(F.lit(day))) & (F.col("ltv") >= least)).orderBy(F.desc("ltv"), "loan_id").limit(n)


def newest(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """The single newest row's columns."""
    return rows.agg(F.max_by(F.struct(*columns), F.struct(by, *columns)).alias("_top")).select("_top.*")


def disposition(alerts: DataFrame, shares: tuple[float, float] = (0.5, 0.3)) -> DataFrame:
    """Alerts of each day split by rank: the first share is disposed, the next confirmed, the rest pending.

    Ranks are counted within a day and ratio, then ratios are added up, so that
    no window holds a whole day.
    """
    bands = alerts.groupBy("alert_date", "ltv").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("alert_date").orderBy(F.desc("ltv"))  # different ratios of four digits, not alerts
    bands = bands.withColumns({"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("alert_date"))})
    nth = F.row_number().over(Window.partitionBy("alert_date", "ltv").orderBy("loan_id"))
    place = (F.col("_before") + F.col("_nth") - 1) / F.col("_all")
    out = alerts.withColumn("_nth", nth).join(bands, ["alert_date", "ltv"])
    state = F.when(place < shares[0], "disposed").when(place < shares[0] + shares[1], "confirmed").otherwise("pending")
    return out.withColumn("state", state).select(*alerts.columns, "state")


def perturbed(collateral: DataFrame, factor: Column, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """Collateral with the prices of the chosen rows changed, and their original prices for the way back."""
    original = collateral.where(chosen).select("collateral_id", F.col("true_market_price").alias("original_price"))
    return collateral.withColumn("true_market_price", F.when(chosen, F.round(F.col("true_market_price") * factor, 2)).otherwise(F.col("true_market_price"))), original


def restored(collateral: DataFrame, original: DataFrame) -> DataFrame:
    kept = original.withColumn("_was", F.lit(True))
    out = collateral.join(kept, "collateral_id", "left")
    return out.withColumn("true_market_price", F.when(F.col("_was"), F.col("original_price")).otherwise(F.col("true_market_price"))).select(*collateral.columns)


def recovered(disposals: DataFrame, loans: DataFrame, line: float = 0.75) -> DataFrame:
    """Disposals with status recovered where the loan's ratio has fallen below ``line``."""
    low = loans.where(F.col("ltv") < line).select("loan_id", F.lit(True).alias("_low"))
    out = disposals.join(low, "loan_id", "left")
    return out.withColumn("status", F.when((F.col("status") == "disposed") & F.coalesce("_low", F.lit(False)), "recovered").otherwise(F.col("status"))).drop("_low")


def closed_loop(disposals: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Shares of alerts confirmed, disposed and recovered, and how far the ratio of disposed loans fell on average."""
    ltv = before.select("loan_id", F.col("ltv").alias("_a")).join(after.select("loan_id", F.col("ltv").alias("_b")), "loan_id")
    s = F.col("status")
    done = s.isin("disposed", "recovered")
    share = lambda c: F.round(F.try_divide(F.count_if(c).cast("double"), F.count("*")), 4)
    return disposals.join(ltv, "loan_id", "left").agg(
        F.count("*").alias("alerts"), share(s != "pending").alias("confirmed"), share(done).alias("disposed"), share(s == "recovered").alias("recovered"), F.round(F.avg(F.when(done, F.col("_a") - F.col("_b"))), 6).alias("mean_drop")
    )


def day_records(alerts: DataFrame) -> DataFrame:
    """Alerts, strong and warning ones, and their balance, of each day."""
    level = F.col("alert_level")
    return alerts.groupBy("alert_date").agg(
        F.count("*").alias("alerts"), F.count_if(level == "strong").alias("strong"), F.count_if(level == "warn").alias("warn"), F.sum(F.col("balance").cast("decimal(18,2)")).cast("double").alias("balance"), F.max("ltv").alias("top_ltv")
    )


def acceptance(days: DataFrame, wanted_days: int) -> DataFrame:
    """How many of the wanted days have alerts, and the day that has most."""
    return days.agg(F.count("*").alias("days"), F.round(F.count("*") / wanted_days, 4).alias("coverage"), F.max_by("alert_date", F.struct("alerts", "alert_date")).alias("peak_day"), F.max("alerts").alias("peak"))


# fixed values: least growth from one day to the next that counts as an event passed on: a city's mean ratio, all alerts, the city's strong alerts; and the bounds of a price drop
PASSED_ON = (1.08, 1.5, 1.3)
PRICE_DROP = (0.08, 0.12)


def event_ratios(loans: DataFrame, city: str, warn: float = 0.75) -> DataFrame:
    """(day, three ratios to the day before, passed): whether an event in ``city`` shows in its mean ratio, in all alerts and in its strong ones.

    ``loans``: day, city, ltv. Days come from the loans; a ratio to a day that has
    none of what is counted is null and does not pass. The window holds a row
    for each day.
    """
    mine = F.col("city") == city
    days = loans.groupBy("day").agg(F.avg(F.when(mine, F.col("ltv"))).alias("_mean"), F.count_if(F.col("ltv") > warn).alias("_alerts"), F.count_if(mine & (F.col("ltv") > C.RED)).alias("_strong"))
    before = Window.orderBy("day")
    names = {"_mean": "mean_ratio", "_alerts": "alert_ratio", "_strong": "strong_ratio"}
    out = days.withColumns({n: F.try_divide(F.col(c).cast("double"), F.lag(c).over(before)) for c, n in names.items()})
    passed = [F.coalesce(F.col(n) >= least, F.lit(False)) for n, least in zip(names.values(), PASSED_ON)]
    return out.withColumn("passed", passed[0] & passed[1] & passed[2]).select("day", *[F.round(n, 4).alias(n) for n in names.values()], "passed")


def price_drop(original: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """One row: mean prices before and now of the rows whose original price was kept, their drop, and whether it is within bounds; nulls without such rows."""
    means = original.join(now, key).agg(F.count("*").alias("rows"), F.avg("original_price").alias("_a"), F.avg("true_market_price").alias("_b"))
    drop = 1 - F.try_divide("_b", "_a")
    return means.select("rows", F.round("_a", 1).alias("before"), F.round("_b", 1).alias("now"), F.round(drop, 4).alias("drop"), drop.between(*PRICE_DROP).alias("within"))


def first_of_url(rows: DataFrame, order: list[Column]) -> DataFrame:
    return one_of_each(rows, ["url_key"], order)
