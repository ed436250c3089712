"""Queries over stored tables: inboxes, confirmations, policies, audit, snapshots, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import ledger as L
from terravane.operators import risk
from terravane.plans.dashboard import _snapshots
from terravane.plans.dashboard import QUERIES as DASHBOARD
from terravane.sources.adapter import oracle, view, views

DAY = "1995-03-10"



def _alerts(spark, sf_dir):
    """Loans of a ratio over the warning line, by the books' prices alone."""
    loans, collateral = views(spark, sf_dir, "loan", "collateral")
    out = risk.enrich(loans, collateral).where("ltv > 0.75")
    return out.select("loan_id", "customer_id", F.col("origination_date").alias("alert_date"), "ltv", "balance", "risk_class", F.when(F.col("ltv") > 0.85, "strong").otherwise("warn").alias("alert_level"))


def inbox(spark, sf_dir):
    """An inbox after the same alerts came again and new ones came."""
    a = _alerts(spark, sf_dir).select("loan_id", "alert_date", "ltv", F.lit(1).alias("received_at"))
    again = a.where(F.col("loan_id") % 3 != 0).withColumns({"ltv": F.col("ltv") + 1, "received_at": F.lit(2)})
    once = L.inbox(a.where(F.col("loan_id") % 2 == 0), again)
    return L.inbox(once, again)


def deliveries(spark, sf_dir):
    a = _alerts(spark, sf_dir).select("loan_id", "alert_date")
    old = a.where(F.col("loan_id") % 2 == 0).withColumns({"status": F.lit("failed"), "attempt_count": (F.col("loan_id") % 3).cast("int"), "max_retries": F.lit(5)})
    return L.record_deliveries(old, a.where(F.col("loan_id") % 3 == 0).withColumn("status", F.when(F.col("loan_id") % 4 == 0, "failed").otherwise("success")))


def confirmations(spark, sf_dir):
    a = _alerts(spark, sf_dir).select("loan_id", "alert_date")
    who = lambda n, t: {f"{n}_by": F.concat(F.lit(f"{t}"), (F.col("loan_id") % 4).cast("string")), f"{n}_at": F.lit(t)}
    empty = {"disposed_by": F.lit(None).cast("string"), "disposed_at": F.lit(None).cast("string")}
    old = a.where(F.col("loan_id") % 2 == 0).withColumns({**who("confirmed", "a"), **empty, "status": F.lit("pending")})
    confirmed = L.confirm(old, a.where(F.col("loan_id") % 3 == 0).withColumns(who("confirmed", "b")))
    return L.dispose(confirmed, a.where(F.col("loan_id") % 5 == 0).withColumns(who("disposed", "c")))


def replaced_day(spark, sf_dir):
    """Alerts after a day's loans were judged again with half their ratio."""
    a = _alerts(spark, sf_dir)
    batch = a.where(F.col("alert_date") >= DAY).where(F.col("loan_id") % 2 == 0).withColumns({"ltv": F.col("ltv") / 2, "alert_date": F.to_date(F.lit(DAY))})
    return L.replace_day(a, batch, DAY, F.col("ltv") > 0.6).select("loan_id", "alert_date", "ltv")


def cascaded(spark, sf_dir):
    a = _alerts(spark, sf_dir).select("loan_id", "alert_date")
    gone = a.where(F.col("loan_id") % 3 == 0).select("loan_id").distinct()
    out = L.cascade({"state": a, "alert": a, "review": a}, gone, DAY, ("alert", "review"))
    parts = [df.groupBy(F.lit(n).alias("table")).agg(F.count("*").alias("n"), F.sum("loan_id").alias("ids")) for n, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def partitions(spark, sf_dir):
    """A table of builds after one was built anew and one added."""
    p = view(spark, sf_dir, "place").select("place_id", "city", (F.col("place_id") % 3).cast("int").alias("build"), "unit_price")
    new = p.where("build = 1 and place_id % 2 = 0").unionByName(p.where("build = 1 and place_id % 5 = 0").withColumn("build", F.lit(9)))
    return L.replace_partition(p, new, "build").groupBy("build").agg(F.count("*").alias("n"))


def snapshot_pages(spark, sf_dir):
    s = _snapshots(spark, sf_dir).withColumn("is_demo", F.when(F.col("snap_date") == "2026-01-31", 1).otherwise(0))
    both = L.snapshot_dates(s).withColumn("kept", F.lit("all")).unionByName(L.snapshot_dates(L.without_demo(s)).withColumn("kept", F.lit("real")))
    asked = spark.createDataFrame([("2026-03-31", "2026-02-28"), (None, None)], "f string, t string").select(F.to_date("f").alias("from_date"), F.to_date("t").alias("to_date"))
    wanted = L.default_dates(s, asked).select(F.col("from_date").alias("snap_date"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("is_demo"), F.concat_ws("|", "to_date", "message").alias("kept"))
    few = L.default_dates(s.where("snap_date = date'2026-01-31'"), asked.limit(1)).select(F.col("from_date").alias("snap_date"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("is_demo"), F.col("message").alias("kept"))
    return both.unionByName(wanted).unionByName(few)


def policies(spark, sf_dir):
    """The policy list after an upsert by scope and a delete, the problems of refused policies, and the audit of what went."""
    places = view(spark, sf_dir, "place")
    n = F.col("place_id")
    kind, value = F.when(n % 3 == 0, "zone").when(n % 3 == 1, "city").otherwise("all"), F.concat(F.lit("s"), n.cast("string"))
    scope = [kind.alias("scope_type"), value.alias("scope_value")]
    old = places.where(n % 5 != 0).select(n.alias("policy_id"), *scope, F.when(n % 2 == 0, "reject").otherwise("watch").alias("action"), F.when(n % 4 != 3, (n % 10 + 1) / 10).alias("ltv_cap"), (n % 2).alias("enabled"), n.alias("created_at"), n.alias("updated_at"))
    action = F.when(n % 3 == 0, "strict").when(n % 3 == 1, "watch").otherwise("reject")
    new = places.where(n % 2 == 0).select((n + 1_000_000).alias("policy_id"), *scope, action.alias("action"), F.when(n % 7 != 0, (n % 25) / 10).alias("ltv_cap"), F.lit(1).cast("long").alias("enabled"), (n + 5).alias("created_at"), (n + 6).alias("updated_at"))
    out = L.upsert_policies(old, new).unionByName(L.checked_policies(new).where("problem is not null").withColumns({"action": F.col("problem"), "policy_id": -F.col("policy_id")}).drop("problem"))
    kept, audit = L.delete_policies(out, out.where("policy_id > 0 and policy_id % 10 = 3").select("policy_id"), "root", F.lit(99).cast("long"))
    listed = kept.orderBy(F.desc("enabled"), F.desc("updated_at"), F.desc("policy_id")).select("policy_id", L.scope_label(F.col("scope_type"), F.col("scope_value")).alias("scope"), "action", "ltv_cap", "created_at")
    return listed.unionByName(audit.select(F.get_json_object("detail", "$.policy_id").cast("long").alias("policy_id"), F.get_json_object("detail", "$.scope_value").alias("scope"), "action", F.lit(None).cast("double").alias("ltv_cap"), F.col("ts").alias("created_at")))


def sources(spark, sf_dir):
    """The source list in its fixed order after two flags were set."""
    n = F.col("place_id")
    kind = F.when(n % 4 == 0, "file").when(n % 4 == 1, "mysql").when(n % 4 == 2, "kafka").otherwise("other")
    rows = view(spark, sf_dir, "place").select(F.concat(F.lit("p"), n.cast("string")).alias("source"), kind.alias("source_type"), (n % 2).cast("int").alias("enabled"), (n % 3 == 0).cast("int").alias("scheduled"))
    out = L.toggled(L.toggled(rows, "p2", "enabled", True), "p3", "scheduled", False)
    place = L.in_order_of(F.col("source_type"), "mysql", "kafka", "file")
    return out.withColumn("place", place).orderBy("place", "source")


def health(spark, sf_dir):
    """State of three tables, of the whole, and the age of what is newest."""
    from terravane.operators.dashboard import grade

    log, loans = views(spark, sf_dir, "change", "loan")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    h = L.table_health({"change": (log, "cdc_ts"), "loan": (loans, "origination_date"), "none": (loans.where("false"), "origination_date")}, now)
    graded = h.select("table", "rows", "age_s", grade(F.col("rows"), F.col("age_s"), 1e8, 1e9).alias("status"))
    whole = L.worst(graded, F.lit("all").alias("table")).select("table", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("age_s"), "status")
    return graded.unionByName(whole).unionByName(L.least_age(h).select(F.lit("newest").alias("table"), F.lit(None).cast("long").alias("rows"), "age_s", F.lit(None).cast("string").alias("status")))


def levels(spark, sf_dir):
    """Levels of columns: their own, their table's, or none."""
    n = F.col("customer_id")
    cols = view(spark, sf_dir, "borrower").select(F.when(n % 3 == 0, "loan").when(n % 3 == 1, "customer").otherwise("x").alias("table"), F.concat(F.lit("c"), (n % 90).cast("string")).alias("column"))
    p = F.col("place_id")
    known = view(spark, sf_dir, "place").select(F.when(p % 2 == 0, "loan").otherwise("customer").alias("table"), F.when(p % 22 == 0, "*").otherwise(F.concat(F.lit("c"), (p % 60).cast("string"))).alias("column"), (p % 5).cast("int").alias("level_rank"))
    return L.level_of(cols.distinct(), known)


def _audit(spark, sf_dir):
    e = view(spark, sf_dir, "image")
    return e.select(F.col("id").alias("audit_id"), F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("user"), F.concat(F.col("table_name"), F.lit("_edit")).alias("action"),
                    F.when(F.col("id") % 7 == 0, "oops").when(F.col("id") % 5 == 0, '{"note": 1}').otherwise(F.concat(F.lit('{"rows": '), (F.col("id") % 40).cast("string"), F.lit("}"))).alias("detail"), F.col("cdc_ts").alias("ts"))


def audit_page(spark, sf_dir):
    return L.audit_page(_audit(spark, sf_dir)).select("audit_id", "user", "touched")


def audit_totals(spark, sf_dir):
    return L.audit_totals(_audit(spark, sf_dir)).select("action", "n", "users")


def one_alert(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    first = a.agg(F.min("loan_id")).first()[0]
    return L.either_alert(a, a.withColumn("ltv", F.col("ltv") + 1), first)


def top_alerts(spark, sf_dir):
    a = _alerts(spark, sf_dir).withColumn("alert_date", F.to_date(F.lit(DAY)))
    return L.top_alerts(a, DAY, 25, 0.8).select("loan_id", "ltv")


def newest(spark, sf_dir):
    return L.newest(view(spark, sf_dir, "image"), "cdc_ts", "id", "table_name", "event_type")


def disposition(spark, sf_dir):
    a = _alerts(spark, sf_dir).withColumn("alert_date", F.to_date(F.concat((1990 + F.col("loan_id") % 4).cast("string"), F.lit("-01-01"))))
    return L.disposition(a).select("loan_id", "state")


def perturbation(spark, sf_dir):
    """Mean price before, after and after the way back, and the mean ratio of the changed ones."""
    c = view(spark, sf_dir, "collateral")
    changed, original = L.perturbed(c, F.lit(0.8), F.col("collateral_id") % 4 == 0)
    ratio = changed.join(original, "collateral_id").agg(F.round(F.avg(F.col("true_market_price") / F.col("original_price")), 4).alias("ratio"), F.count("original_price").alias("changed"))
    mean = lambda df, name: df.agg(F.round(F.avg("true_market_price"), 2).alias(name))
    return mean(c, "before").crossJoin(mean(changed, "after")).crossJoin(mean(L.restored(changed, original), "restored")).crossJoin(ratio)


def closed_loop(spark, sf_dir):
    """Disposals half of whose loans have fallen under the line."""
    a = _alerts(spark, sf_dir)
    after = a.withColumn("ltv", F.when(F.col("loan_id") % 2 == 0, F.col("ltv") * 0.5).otherwise(F.col("ltv")))
    d = L.recovered(L.disposition(a).select("loan_id", F.col("state").alias("status")), after)
    return L.closed_loop(d, a, after)


def day_records(spark, sf_dir):
    return L.day_records(_alerts(spark, sf_dir))


def acceptance(spark, sf_dir):
    return L.acceptance(L.day_records(_alerts(spark, sf_dir)), 3000)


def event_ratios(spark, sf_dir):
    """Ratios from month to month; loans have no snapshots here, so a loan's day is the month it began in."""
    loans, collateral = view(spark, sf_dir, "loan"), view(spark, sf_dir, "collateral")
    joined = loans.join(collateral.select("collateral_id", "city", "true_market_price"), "collateral_id").where("true_market_price > 0")
    return L.event_ratios(joined.select(F.trunc("origination_date", "month").alias("day"), "city", F.round(F.col("balance") / F.col("true_market_price"), 4).alias("ltv")), "gz")


def price_drop(spark, sf_dir):
    """Collateral of one city before and after its prices were lowered, most of it by 12 parts in 100."""
    collateral = view(spark, sf_dir, "collateral")
    lower = F.when(F.col("collateral_id") % 5 == 0, 0.97).otherwise(0.88)
    now, original = L.perturbed(collateral, lower, F.col("city") == "gz")
    return L.price_drop(original, now.select("collateral_id", "true_market_price"), "collateral_id")


_A = """(SELECT *, CASE WHEN ltv > 0.85 THEN 'strong' ELSE 'warn' END AS alert_level FROM (SELECT loan_id, l.customer_id, origination_date AS alert_date, round(balance / true_market_price, 4) AS ltv, balance
  FROM loan l JOIN collateral c ON c.collateral_id = l.collateral_id WHERE true_market_price > 0) WHERE ltv > 0.75)"""
_LC = "loan collateral"
_STATE = "CASE WHEN rn / n < 0.5 THEN 'disposed' WHEN rn / n < 0.8 THEN 'confirmed' ELSE 'pending' END"
_DATES = DASHBOARD["migration_dates"][1]

QUERIES = {
    "ledger_inbox": (
        inbox,
        oracle(_LC, f"SELECT loan_id, alert_date, CASE WHEN loan_id % 3 <> 0 THEN ltv + 1 ELSE ltv END AS ltv, CAST(CASE WHEN loan_id % 2 = 0 THEN 1 ELSE 2 END AS INT) AS received_at FROM {_A} WHERE loan_id % 2 = 0 OR loan_id % 3 <> 0"),
    ),
    "ledger_deliveries": (
        deliveries,
        oracle(_LC, f"""SELECT loan_id, alert_date, CASE WHEN loan_id % 3 = 0 AND loan_id % 4 <> 0 THEN 'success' ELSE 'failed' END AS status, CAST(CASE WHEN loan_id % 2 = 0 THEN loan_id % 3 ELSE 0 END + CASE WHEN loan_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS attempt_count,
        CAST(CASE WHEN loan_id % 2 = 0 THEN 5 ELSE 3 END AS INT) AS max_retries FROM {_A} WHERE loan_id % 2 = 0 OR loan_id % 3 = 0"""),
    ),
    "ledger_confirmations": (
        confirmations,
        oracle(_LC, f"""SELECT loan_id, alert_date, CASE WHEN loan_id % 3 = 0 THEN 'b' WHEN loan_id % 2 = 0 THEN 'a' ELSE 'c' END || CAST(loan_id % 4 AS VARCHAR) AS confirmed_by, CASE WHEN loan_id % 3 = 0 THEN 'b' WHEN loan_id % 2 = 0 THEN 'a' ELSE 'c' END AS confirmed_at,
        CASE WHEN loan_id % 5 = 0 THEN 'c' || CAST(loan_id % 4 AS VARCHAR) END AS disposed_by, CASE WHEN loan_id % 5 = 0 THEN 'c' END AS disposed_at, CASE WHEN loan_id % 5 = 0 THEN 'disposed' WHEN loan_id % 3 = 0 THEN 'confirmed' ELSE 'pending' END AS status
        FROM {_A} WHERE loan_id % 2 = 0 OR loan_id % 3 = 0 OR loan_id % 5 = 0"""),
    ),
    "ledger_replaced_day": (
        replaced_day,
        oracle(_LC, f"""WITH a AS {_A}, b AS (SELECT loan_id, ltv / 2 AS ltv FROM a WHERE alert_date >= DATE '{DAY}' AND loan_id % 2 = 0)
        SELECT loan_id, alert_date, ltv FROM a WHERE NOT (alert_date = DATE '{DAY}' AND loan_id IN (SELECT loan_id FROM b)) UNION ALL SELECT loan_id, DATE '{DAY}', ltv FROM b WHERE ltv > 0.6"""),
    ),
    "ledger_cascade": (
        cascaded,
        oracle(_LC, f"""WITH a AS {_A} SELECT t AS "table", count(*) AS n, CAST(sum(loan_id) AS BIGINT) AS ids FROM a, (VALUES ('state'), ('alert'), ('review')) v(t) WHERE loan_id % 3 <> 0 OR (t <> 'state' AND alert_date <> DATE '{DAY}') GROUP BY 1"""),
    ),
    "ledger_partitions": (partitions, oracle("place", "SELECT CAST(b AS INT) AS build, count(*) AS n FROM (SELECT place_id % 3 AS b FROM place WHERE place_id % 3 <> 1 OR place_id % 2 = 0 UNION ALL SELECT 9 FROM place WHERE place_id % 3 = 1 AND place_id % 5 = 0) GROUP BY 1")),
    "ledger_snapshot_pages": (
        snapshot_pages,
        f"""WITH d AS (SELECT * FROM ({_DATES})) SELECT snap_date, n, CAST(CASE WHEN snap_date = DATE '2026-01-31' THEN 1 ELSE 0 END AS INT) AS is_demo, 'all' AS kept FROM d UNION ALL SELECT snap_date, n, CAST(0 AS INT), 'real' FROM d WHERE snap_date <> DATE '2026-01-31'
        UNION ALL SELECT DATE '2026-02-28', NULL, NULL, '2026-03-31' FROM range(2) UNION ALL SELECT NULL, 0, NULL, 'fewer than two snapshots'""",
    ),
    "ledger_policies": (
        policies,
        oracle("place", """WITH p AS (SELECT place_id AS n, CASE place_id % 3 WHEN 0 THEN 'zone' WHEN 1 THEN 'city' ELSE 'all' END AS kind, 's' || CAST(place_id AS VARCHAR) AS value FROM place),
        o AS (SELECT n AS policy_id, kind, value, CASE WHEN n % 2 = 0 THEN 'reject' ELSE 'watch' END AS action, CASE WHEN n % 4 <> 3 THEN (n % 10 + 1) / 10 END AS ltv_cap, n AS created_at FROM p WHERE n % 5 <> 0),
        w AS (SELECT n + 1000000 AS policy_id, kind, value, CASE n % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'watch' ELSE 'reject' END AS action, CASE WHEN n % 7 <> 0 THEN (n % 25) / 10 END AS ltv_cap, n + 5 AS created_at FROM p WHERE n % 2 = 0),
        x AS (SELECT *, CASE WHEN action <> 'watch' AND ltv_cap IS NULL THEN 'cap is missing' WHEN ltv_cap <= 0 OR ltv_cap > 2 THEN 'cap is out of bounds' END AS problem FROM w),
        m AS (SELECT coalesce(o.policy_id, s.policy_id) AS policy_id, coalesce(o.kind, s.kind) AS kind, coalesce(o.value, s.value) AS value, CASE WHEN s.value IS NULL THEN o.action ELSE s.action END AS action, CASE WHEN s.value IS NULL THEN o.ltv_cap ELSE s.ltv_cap END AS ltv_cap,
          coalesce(o.created_at, s.created_at) AS created_at FROM o FULL JOIN (SELECT * FROM x WHERE problem IS NULL) s ON s.kind = o.kind AND s.value = o.value UNION ALL SELECT -policy_id, kind, value, problem, ltv_cap, created_at FROM x WHERE problem IS NOT NULL)
        SELECT policy_id, CASE WHEN gone THEN value WHEN kind = 'all' THEN value ELSE kind || ' ' || value END AS scope, CASE WHEN gone THEN 'policy_delete' ELSE action END AS action, CASE WHEN NOT gone THEN ltv_cap END AS ltv_cap, CASE WHEN gone THEN 99 ELSE created_at END AS created_at
        FROM (SELECT *, policy_id > 0 AND policy_id % 10 = 3 AS gone FROM m)"""),
    ),
    "ledger_sources": (
        sources,
        oracle("place", """SELECT *, CAST(CASE source_type WHEN 'mysql' THEN 1 WHEN 'kafka' THEN 2 WHEN 'file' THEN 3 ELSE 4 END AS INT) AS place FROM (SELECT 'p' || CAST(place_id AS VARCHAR) AS source, ['file', 'mysql', 'kafka', 'other'][CAST(place_id % 4 + 1 AS INT)] AS source_type,
        CAST(CASE WHEN place_id = 2 THEN 1 ELSE place_id % 2 END AS INT) AS enabled, CAST(place_id % 3 = 0 AND place_id <> 3 AS INT) AS scheduled FROM place)"""),
    ),
    "ledger_health": (
        health,
        oracle("change loan", """WITH h AS (SELECT 'change' AS t, count(*) AS n, epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(cdc_ts))) AS a FROM change UNION ALL SELECT 'loan', count(*), epoch(TIMESTAMP '2030-01-01') - epoch(max(origination_date)::TIMESTAMP) FROM loan UNION ALL SELECT 'none', 0, NULL),
        g AS (SELECT *, CASE WHEN n = 0 OR a IS NULL THEN 'empty' WHEN a >= 1e9 THEN 'bad' WHEN a >= 1e8 THEN 'warn' ELSE 'ok' END AS s FROM h)
        SELECT t AS "table", n AS rows, CAST(a AS BIGINT) AS age_s, s AS status FROM g UNION ALL SELECT 'all', NULL, NULL, CASE WHEN bool_or(s = 'bad') THEN 'bad' WHEN bool_or(s = 'warn') THEN 'warn' WHEN bool_and(s = 'empty') THEN 'empty' ELSE 'ok' END FROM g UNION ALL SELECT 'newest', NULL, CAST(min(a) AS BIGINT), NULL FROM h"""),
    ),
    "ledger_levels": (
        levels,
        oracle("borrower place", """WITH c AS (SELECT DISTINCT CASE customer_id % 3 WHEN 0 THEN 'loan' WHEN 1 THEN 'customer' ELSE 'x' END AS t, 'c' || CAST(customer_id % 90 AS VARCHAR) AS c FROM borrower),
        k AS (SELECT CASE WHEN place_id % 2 = 0 THEN 'loan' ELSE 'customer' END AS t, CASE WHEN place_id % 22 = 0 THEN '*' ELSE 'c' || CAST(place_id % 60 AS VARCHAR) END AS c, CAST(max(place_id % 5) AS INT) AS r FROM place GROUP BY 1, 2)
        SELECT c.t AS "table", c.c AS "column", coalesce(o.r, w.r) AS level_rank FROM c LEFT JOIN k o ON o.t = c.t AND o.c = c.c LEFT JOIN k w ON w.t = c.t AND w.c = '*'"""),
    ),
    "ledger_audit_page": (
        audit_page,
        oracle("image", """SELECT id AS audit_id, 'u' || CAST(user_id % 9 AS VARCHAR) AS user, CASE WHEN id % 7 = 0 OR id % 5 = 0 THEN 0 ELSE id % 40 END AS touched FROM image ORDER BY cdc_ts DESC, id DESC LIMIT 200"""),
    ),
    "ledger_audit_totals": (audit_totals, oracle("image", "SELECT table_name || '_edit' AS action, count(*) AS n, count(DISTINCT user_id % 9) AS users FROM image GROUP BY 1")),
    "ledger_one_alert": (one_alert, oracle(_LC, f"WITH a AS (SELECT loan_id, ltv, alert_date FROM {_A} ORDER BY loan_id LIMIT 1) SELECT *, 'offline' AS source FROM a UNION ALL SELECT loan_id, ltv + 1, alert_date, 'stream' FROM a")),
    "ledger_top_alerts": (top_alerts, oracle(_LC, f"SELECT loan_id, ltv FROM {_A} WHERE ltv >= 0.8 ORDER BY ltv DESC, loan_id LIMIT 25")),
    "ledger_newest": (newest, oracle("image", "SELECT id, table_name, event_type FROM image ORDER BY cdc_ts DESC, id DESC LIMIT 1")),
    "ledger_disposition": (
        disposition,
        oracle(_LC, f"SELECT loan_id, {_STATE} AS state FROM (SELECT loan_id, row_number() OVER (PARTITION BY loan_id % 4 ORDER BY ltv DESC, loan_id) - 1 AS rn, count(*) OVER (PARTITION BY loan_id % 4) AS n FROM {_A})"),
    ),
    "ledger_perturbation": (
        perturbation,
        oracle("collateral", """SELECT round(avg(true_market_price), 2) AS before, round(avg(CASE WHEN collateral_id % 4 = 0 THEN round(true_market_price * 0.8, 2) ELSE true_market_price END), 2) AS after, round(avg(true_market_price), 2) AS restored,
        round(avg(CASE WHEN collateral_id % 4 = 0 THEN round(true_market_price * 0.8, 2) / true_market_price END), 4) AS ratio, count(CASE WHEN collateral_id % 4 = 0 THEN true_market_price END) AS changed FROM collateral"""),
    ),
    "ledger_closed_loop": (
        closed_loop,
        oracle(_LC, f"""WITH a AS (SELECT *, {_STATE} AS s, CASE WHEN loan_id % 2 = 0 THEN ltv * 0.5 ELSE ltv END AS low FROM (SELECT *, row_number() OVER (PARTITION BY alert_date ORDER BY ltv DESC, loan_id) - 1 AS rn, count(*) OVER (PARTITION BY alert_date) AS n FROM {_A}))
        SELECT count(*) AS alerts, round(avg(CAST(s <> 'pending' AS INT)), 4) AS confirmed, round(avg(CAST(s = 'disposed' AS INT)), 4) AS disposed, round(avg(CAST(s = 'disposed' AND low < 0.75 AS INT)), 4) AS recovered, round(avg(CASE WHEN s = 'disposed' THEN ltv - low END), 6) AS mean_drop FROM a"""),
    ),
    "ledger_day_records": (
        day_records,
        oracle(_LC, f"SELECT alert_date, count(*) AS alerts, count(*) FILTER (alert_level = 'strong') AS strong, count(*) FILTER (alert_level = 'warn') AS warn, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS balance, max(ltv) AS top_ltv FROM {_A} GROUP BY 1"),
    ),
    "ledger_event_ratios": (
        event_ratios,
        oracle(_LC, """WITH a AS (SELECT date_trunc('month', origination_date)::DATE AS day, city, round(balance / true_market_price, 4) AS ltv FROM loan l JOIN collateral c ON c.collateral_id = l.collateral_id WHERE true_market_price > 0),
        d AS (SELECT day, avg(ltv) FILTER (city = 'gz') AS m, count(*) FILTER (ltv > 0.75) AS n, count(*) FILTER (city = 'gz' AND ltv > 0.85) AS s FROM a GROUP BY 1),
        r AS (SELECT day, m / nullif(lag(m) OVER w, 0) AS mr, n / nullif(lag(n) OVER w, 0) AS nr, s / nullif(lag(s) OVER w, 0) AS sr FROM d WINDOW w AS (ORDER BY day))
        SELECT day, round(mr, 4) AS mean_ratio, round(nr, 4) AS alert_ratio, round(sr, 4) AS strong_ratio, coalesce(mr >= 1.08, FALSE) AND coalesce(nr >= 1.5, FALSE) AND coalesce(sr >= 1.3, FALSE) AS passed FROM r"""),
    ),
    "ledger_price_drop": (
        price_drop,
        oracle("collateral", """WITH p AS (SELECT true_market_price AS a, round(true_market_price * CASE WHEN collateral_id % 5 = 0 THEN 0.97::DOUBLE ELSE 0.88::DOUBLE END, 2) AS b FROM collateral WHERE city = 'gz')
        SELECT count(*) AS rows, round(avg(a), 1) AS before, round(avg(b), 1) AS now, round(1 - avg(b) / avg(a), 4) AS drop, 1 - avg(b) / avg(a) BETWEEN 0.08 AND 0.12 AS within FROM p"""),
    ),
    "ledger_acceptance": (
        acceptance,
        oracle(_LC, f"WITH d AS (SELECT alert_date, count(*) AS n FROM {_A} GROUP BY 1) SELECT count(*) AS days, round(count(*) / 3000, 4) AS coverage, arg_max(alert_date, (n, alert_date)) AS peak_day, max(n) AS peak FROM d"),
    ),
}
