"""Change-stream queries, over the log as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import risk
from terravane.sources.adapter import oracle, view, views
from terravane.sources import binlog
from terravane.sources.keyed import KeyedTable
from terravane.sources.shared import shared_path, stored
from terravane.streaming import changes, log


def impact(spark, sf_dir):
    log, loans = views(spark, sf_dir, "change", "loan")
    return changes.plan_impact(log, loans)


def stream_alerts(spark, sf_dir):
    log, loans, collateral = views(spark, sf_dir, "change", "loan", "collateral")
    dimension = loans.join(collateral, "collateral_id").select("loan_id", F.col("true_market_price").alias("market_valuation"))
    return changes.alerts(log, dimension)


def incremental(spark, sf_dir):
    """State after a batch: the planned loans anew, the deleted ones gone."""
    log, loans, collateral = views(spark, sf_dir, "change", "loan", "collateral")
    compute = lambda df: risk.enrich(df, collateral).select("loan_id", "balance", "ltv", "risk_class")
    plan = changes.plan_impact(log, loans)
    moved = loans.withColumn("balance", F.col("balance") * 2)
    return changes.recompute(compute(loans), plan, moved, compute)


def keyed_state(spark, sf_dir):
    """The same from a keyed table whose touched buckets alone were rewritten, after the batch was given twice."""
    log_, loans, collateral = views(spark, sf_dir, "change", "loan", "collateral")
    compute = lambda df: risk.enrich(df, collateral).select("loan_id", "balance", "ltv", "risk_class")
    plan = stored(changes.plan_impact(log_, loans), "plan")
    moved = loans.withColumn("balance", F.col("balance") * 2).join(plan.where("action = 'recalc'"), "loan_id", "left_semi")
    first = compute(loans)
    table = KeyedTable(spark, shared_path(spark, "state"), first.schema, "loan_id", buckets=8)
    table.replace(first)
    for _ in range(2):
        table.apply(compute(moved), plan.where("action = 'delete'").select("loan_id"), 1)
    table.clean()
    return table.read()


def _binlog(spark, sf_dir):
    """Change images as log files of JSON lines; some lines are broken."""
    e = view(spark, sf_dir, "image")
    text = lambda c: F.coalesce(F.col(c), F.lit("null"))
    line = F.concat(F.lit('{"table": "'), F.col("table_name"), F.lit('", "type": "'), F.col("event_type"), F.lit('", "before": '), text("before_json"), F.lit(', "after": '), text("after_json"), F.lit(', "ts": "'), F.col("cdc_ts").cast("string"), F.lit('"}'))
    path = shared_path(spark, "binlog")
    e.select(line.alias("value"), F.format_string("binlog.%06d", (F.col("id") / 1000).cast("long")).alias("file")).write.partitionBy("file").text(path)
    return path.removeprefix("file:")


def captured(spark, sf_dir):
    """What a capture reads from log files, by table and event."""
    rows = binlog.read(spark, _binlog(spark, sf_dir))
    balance = F.get_json_object("after_json", "$.balance").cast("double")
    return rows.groupBy("table_name", "event_type").agg(F.count("*").alias("n"), F.count("after_json").alias("after_images"), F.round(F.sum(balance), 2).alias("balance"), F.substring(F.max("ts"), 1, 19).alias("last"))


def json_ends(spark, sf_dir):
    """The ends of nested change images, with names repaired that were read in the wrong encoding."""
    e = view(spark, sf_dir, "image").where("before_json is not null")
    broken = F.decode(F.encode(F.lit("广州"), "UTF-8"), "ISO-8859-1")
    text = F.concat(F.lit('{"image": '), F.col("before_json"), F.lit(', "list": [1, {"city": "'), broken, F.lit('"}, [true, null]], "plain": "café"}'))
    return log.leaves(e.select("id", text.alias("text")), "id", "text").where(F.col("path") != "$").groupBy("path", "value").agg(F.count("*").alias("n"))


def hourly(spark, sf_dir):
    return changes.hourly(view(spark, sf_dir, "change"))


def lag(spark, sf_dir):
    offsets = spark.createDataFrame([("risk", 900), ("stream", 120)], "consumer string, last_id long")
    return changes.consumer_lag(view(spark, sf_dir, "change"), offsets, ["risk", "stream", "report"])


def dispatch(spark, sf_dir):
    loans = view(spark, sf_dir, "loan").select("loan_id", F.col("origination_date").alias("alert_date"))
    m = F.col("loan_id") % 4
    ledger = loans.where("loan_id % 4 < 3").select("loan_id", "alert_date", F.when(m == 0, "success").otherwise("failed").alias("status"), (F.col("loan_id") % 3 + 1).cast("int").alias("attempt_count"), F.when(m == 1, 3).otherwise(2).alias("max_retries"))
    return changes.dispatch(loans, ledger).groupBy("action").agg(F.count("*").alias("n"), F.coalesce(F.sum("attempt"), F.lit(0)).cast("long").alias("attempts"))


def messages(spark, sf_dir):
    return log.messages(view(spark, sf_dir, "image"), "2026-05-01")


def kafka_records(spark, sf_dir):
    """Keys with the numbers of their messages, after messages went through their JSON text."""
    records = log.keyed(log.messages(view(spark, sf_dir, "image"), "2026-05-01"))
    back = log.parsed(records, "event_id long, table_name string, event_type string, loan_id int, balance double")
    return records.groupBy("key").count().select("key", F.col("count").alias("n")).join(log.keyed(back.withColumn("customer_id", F.lit(None))).groupBy("key").agg(F.count("*").alias("parsed")), "key", "left")


def next_batch(spark, sf_dir):
    return log.batch_after(view(spark, sf_dir, "change"), 900, 250).select("id", "table_name", "event_type")


def offsets(spark, sf_dir):
    """Offsets after a batch, after the same batch again, and after a rewind of another consumer."""
    events = view(spark, sf_dir, "change")
    first = spark.createDataFrame([("risk", 900), ("stream", 5000000)], "consumer string, last_id long")
    batch = stored(log.batch_after(events, 900, 250).select("id"), "batch")
    out = log.advance(log.advance(first, "risk", batch), "risk", batch)
    out = log.advance(log.advance(out, "stream", batch), "report", batch.where("id < 0"))
    return log.advance(log.rewound(out, "replay", 10), "replay", batch)


def health(spark, sf_dir):
    now = F.lit("2026-05-01 12:00:00").cast("timestamp")
    at = spark.createDataFrame([("bin.000009", 500, "2026-05-01 11:00:00", "bin.000010", 4)], "file string, pos long, t string, master_file string, master_pos long").withColumn("updated_at", F.to_timestamp("t"))
    found = log.health(at, view(spark, sf_dir, "change"), spark.createDataFrame([("risk", -2000)], "consumer string, last_id long"), "risk", now)
    sent = spark.createDataFrame([("binlog_lag", "2026-05-01 11:45:00")], "alert_type string, t string").select("alert_type", F.to_timestamp("t").alias("alert_ts"))
    late = sent.withColumn("alert_ts", F.to_timestamp(F.lit("2026-05-01 11:00:00")))
    return log.throttled(found, sent, now).withColumn("sent", F.lit("lately")).unionByName(log.throttled(found, late, now).withColumn("sent", F.lit("long ago")))


_BODY = "CASE WHEN event_type = 'DELETE' THEN before_json ELSE after_json END"
_PLAN = f"""SELECT loan_id, CASE WHEN bool_or(gone) THEN 'delete' ELSE 'recalc' END AS action FROM (
  SELECT entity_id AS loan_id, event_type = 'DELETE' AS gone FROM change WHERE table_name = 'loan' AND entity_id IS NOT NULL
  UNION ALL SELECT l.loan_id, false FROM loan l JOIN change c ON (c.table_name = 'collateral' AND c.entity_id = l.collateral_id)
  UNION ALL SELECT l.loan_id, false FROM loan l JOIN change c ON (c.table_name = 'customer' AND c.entity_id = l.customer_id)) GROUP BY 1"""
_CLS = "CASE WHEN ltv IS NULL OR ltv < 0 THEN '次级' WHEN ltv <= 0.6 THEN '正常' WHEN ltv <= 0.75 THEN '关注' WHEN ltv <= 0.85 THEN '次级' WHEN ltv <= 1 THEN '可疑' ELSE '损失' END"

QUERIES = {
    "change_messages": (
        messages,
        oracle("image", f"""WITH b AS (SELECT *, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN j END AS o FROM (SELECT *, {_BODY} AS j FROM image))
        SELECT id AS event_id, table_name, event_type, strftime(cdc_ts, '%Y-%m-%d %H:%M:%S') AS cdc_ts, '2026-05-01' AS biz_date, CASE WHEN table_name = 'loan' THEN CAST(o->>'loan_id' AS INT) END AS loan_id, CAST(NULL AS INT) AS customer_id,
        CASE WHEN table_name = 'loan' THEN CAST(o->>'collateral_id' AS INT) END AS collateral_id, CASE WHEN table_name = 'loan' THEN CAST(o->>'balance' AS DOUBLE) END AS balance, CAST(NULL AS DOUBLE) AS interest_rate, CASE WHEN table_name = 'loan' THEN o->>'risk_class' END AS risk_class,
        CASE WHEN o IS NULL THEN '{{}}' ELSE '{{' || array_to_string(list_transform(json_keys(o), lambda k: '"' || k || '":' || coalesce('"' || (o->>k) || '"', 'null')), ',') || '}}' END AS payload FROM b"""),
    ),
    "change_kafka_records": (
        kafka_records,
        oracle("image", f"""SELECT table_name || ':' || CAST(coalesce(CASE WHEN table_name = 'loan' AND json_valid(j) AND json_type(j) = 'OBJECT' THEN CAST(j->>'loan_id' AS BIGINT) END, id) AS VARCHAR) AS key, count(*) AS n, count(*) AS parsed FROM (SELECT *, {_BODY} AS j FROM image) GROUP BY 1"""),
    ),
    "change_next_batch": (next_batch, oracle("change", "SELECT id, table_name, event_type FROM change WHERE id > 900 ORDER BY id LIMIT 250")),
    "change_offsets": (
        offsets,
        oracle("change", "WITH b AS (SELECT max(id) AS m FROM (SELECT id FROM change WHERE id > 900 ORDER BY id LIMIT 250)) SELECT 'risk' AS consumer, coalesce(m, 900) AS last_id FROM b UNION ALL SELECT 'stream', 5000000 UNION ALL SELECT 'replay', coalesce(m, 10) FROM b"),
    ),
    "change_health": (
        health,
        oracle("change", "SELECT 'consumer_lag' AS alert_type, CAST(max(id) + 2000 AS VARCHAR) || ' events behind' AS detail, s AS sent FROM change, (VALUES ('lately'), ('long ago')) v(s) GROUP BY 3 UNION ALL SELECT 'binlog_lag', 'stands still for 3600 s at bin.000009:500', 'long ago'"),
    ),
    "change_impact": (impact, oracle("change loan", _PLAN)),
    "change_stream_alerts": (
        stream_alerts,
        oracle("change loan collateral", f"""SELECT event_id, loan_id, round(ltv, 4) AS ltv, {_CLS} AS risk_class, alert_date FROM (SELECT e.id AS event_id, l.loan_id, e.balance / c.true_market_price AS ltv, CAST(cdc_ts AS DATE) AS alert_date
        FROM change e JOIN loan l ON l.loan_id = e.entity_id JOIN collateral c ON c.collateral_id = l.collateral_id WHERE e.table_name = 'loan' AND e.event_type <> 'DELETE' AND c.true_market_price > 0) WHERE ltv > 0.85"""),
    ),
    "change_incremental": (
        incremental,
        oracle("change loan collateral", f"""WITH p AS ({_PLAN}), s AS (SELECT l.loan_id, CASE WHEN p.action = 'recalc' THEN balance * 2 ELSE balance END AS balance, true_market_price, is_high_risk_zone
          FROM loan l JOIN collateral c ON c.collateral_id = l.collateral_id LEFT JOIN p ON p.loan_id = l.loan_id WHERE p.action IS NULL OR p.action = 'recalc'),
        t AS (SELECT *, CASE WHEN true_market_price > 0 THEN round(balance / true_market_price, 4) END AS ltv FROM s)
        SELECT loan_id, balance, ltv, CASE WHEN {_CLS} = '正常' AND is_high_risk_zone = 1 THEN '关注' ELSE {_CLS} END AS risk_class FROM t"""),
    ),
    "change_keyed_state": (
        keyed_state,
        oracle("change loan collateral", f"""WITH p AS ({_PLAN}), s AS (SELECT l.loan_id, CASE WHEN p.action = 'recalc' THEN balance * 2 ELSE balance END AS balance, true_market_price, is_high_risk_zone
          FROM loan l JOIN collateral c ON c.collateral_id = l.collateral_id LEFT JOIN p ON p.loan_id = l.loan_id WHERE p.action IS NULL OR p.action = 'recalc'),
        t AS (SELECT *, CASE WHEN true_market_price > 0 THEN round(balance / true_market_price, 4) END AS ltv FROM s)
        SELECT loan_id, balance, ltv, CASE WHEN {_CLS} = '正常' AND is_high_risk_zone = 1 THEN '关注' ELSE {_CLS} END AS risk_class FROM t"""),
    ),
    "change_capture": (
        captured,
        oracle("image", """WITH g AS (SELECT * FROM image WHERE coalesce(before_json, '') NOT LIKE '{bad%' AND coalesce(after_json, '') <> '[1')
        SELECT table_name, event_type, count(*) AS n, count(after_json) AS after_images, round(sum(CAST(json_extract_string(after_json, '$.balance') AS DOUBLE)), 2) AS balance, max(strftime(cdc_ts, '%Y-%m-%d %H:%M:%S')) AS last FROM g GROUP BY 1, 2"""),
    ),
    "change_json_ends": (
        json_ends,
        oracle("image", """WITH g AS (SELECT * FROM image WHERE before_json IS NOT NULL AND before_json NOT LIKE '{bad%'), l AS (
          SELECT '$.image.loan_id' AS path, json_extract_string(before_json, '$.loan_id') AS value FROM g UNION ALL SELECT '$.image.risk_class', 'old' FROM g UNION ALL SELECT '$.list[0]', '1' FROM g
          UNION ALL SELECT '$.list[1].city', '广州' FROM g UNION ALL SELECT '$.list[2][0]', 'true' FROM g UNION ALL SELECT '$.list[2][1]', NULL FROM g UNION ALL SELECT '$.plain', 'café' FROM g)
        SELECT path, value, count(*) AS n FROM l GROUP BY 1, 2"""),
    ),
    "change_hourly": (
        hourly,
        oracle("change", """SELECT h AS hour, count(id) AS n FROM (SELECT date_trunc('hour', max(cdc_ts)) - to_hours(CAST(i AS INT)) AS h FROM change CROSS JOIN range(24) r(i) GROUP BY i)
        LEFT JOIN change ON date_trunc('hour', cdc_ts) = h GROUP BY 1"""),
    ),
    "change_lag": (lag, oracle("change", "SELECT consumer, max(id) - off AS lag FROM change CROSS JOIN (VALUES ('risk', 900), ('stream', 120), ('report', 0)) v(consumer, off) GROUP BY consumer, off")),
    "change_dispatch": (
        dispatch,
        oracle("loan", """SELECT action, count(*) AS n, CAST(coalesce(sum(CASE WHEN action = 'first' THEN 1 WHEN action = 'retry' THEN k + 1 END), 0) AS BIGINT) AS attempts FROM (
        SELECT loan_id % 3 + 1 AS k, CASE loan_id % 4 WHEN 0 THEN 'dedup' WHEN 3 THEN 'first' WHEN 1 THEN CASE WHEN loan_id % 3 + 1 >= 3 THEN 'final_failed' ELSE 'retry' END
          ELSE CASE WHEN loan_id % 3 + 1 >= 2 THEN 'final_failed' ELSE 'retry' END END AS action FROM loan) GROUP BY 1"""),
    ),
}
