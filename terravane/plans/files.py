"""Queries that write files in the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import ledger as L
from terravane.plans.ledger import _A, _alerts
from terravane.plans.risk import BASE, ENRICHED, enriched
from terravane.plans.warehouse import LATEST, _latest
from terravane.sources import files as S
from terravane.sources import outputs as O
from terravane.sources.adapter import CITIES, oracle, view, views
from terravane.sources.shared import shared_path, stored

_FIELDS = "url string, title string, unit_price double"


def _lines(spark, sf_dir):
    """JSON lines of the advertisements in folders task=<city>_<kind>, with bad lines, blank ones and a city that is none."""
    ads = view(spark, sf_dir, "ad")
    n = F.col("load_no")
    kind = F.when(n % 4 == 0, "rent").when(n % 4 == 1, "fangyuan").when(n % 4 == 2, "sale").otherwise("other")
    good = F.to_json(F.struct("url", "title", "unit_price", F.lit("x").alias("_source")))
    line = F.when(n % 37 == 0, F.lit("{bad json")).when(n % 41 == 0, F.lit("")).when(n % 43 == 0, F.lit('{"_source": "y"}')).when(n % 47 == 0, F.lit('{"url": "u", "unit_price": "abc"}')).otherwise(good)
    path = shared_path(spark, "lines")
    city = F.when(n % 31 == 0, "atlantis").otherwise(F.col("city"))
    ads.select(line.alias("value"), F.concat_ws("_", city, kind).alias("task")).write.partitionBy("task").text(path)
    return path


def scanned(spark, sf_dir):
    rows = S.scan_lines(spark, _lines(spark, sf_dir), _FIELDS, list(CITIES.values()))
    return rows.groupBy("city", "kind").agg(F.count("*").alias("n"), F.round(F.sum("unit_price"), 2).alias("price"))


def incremental(spark, sf_dir):
    """Files that a second run picks: none that are as they were, the ones that were marked otherwise, all on a backfill."""
    path = _lines(spark, sf_dir)
    found = stored(S.list_files(spark, path), "listing")
    seen = S.mark_files(found.limit(0), found)
    again = S.new_files(found, seen).count()
    changed = S.new_files(found, seen.withColumn("length", F.when(F.col("path").contains("gz_"), F.col("length") + 1).otherwise(F.col("length"))))
    cities = changed.select(F.regexp_extract("path", "task=([a-z]+)_", 1).alias("city")).distinct()
    whole = S.new_files(found, seen, backfill=True).agg((F.count("*") > 0).alias("backfill"), F.lit(again).cast("long").alias("again"))
    return cities.crossJoin(whole)


def lake(spark, sf_dir):
    """Lake partitions after two days' runs over some cities, the second of which replaces only what it has."""
    ads = view(spark, sf_dir, "ad").where("url is not null").select("url", "title", "unit_price", "city", F.when(F.col("load_no") % 2 == 0, "sale").otherwise("rent").alias("kind"), F.col("ad_id").alias("_file"), F.lit(0).alias("_line"))
    path = shared_path(spark, "lake")
    S.write_lake(S.first_of_each_url(ads.where("city in ('gz', 'sz', 'fs')")), path, "2026-05-01")
    S.write_lake(S.first_of_each_url(ads.where("city = 'sz'").where("kind = 'sale'")).where("unit_price > 30000"), path, "2026-05-01")
    return S.lake_counts(spark, path)


def snapshot(spark, sf_dir):
    path = shared_path(spark, "lake")
    ads = view(spark, sf_dir, "ad").withColumn("url_key", F.col("ad_id")).select("url_key", "city", "unit_price", F.lit("sale").alias("kind"))
    S.write_lake(ads, path, "2026-05-01")
    S.write_lake(ads.where("city = 'gz'"), path, "2026-05-02")
    both = spark.read.parquet(path)
    day = lambda d: S.snapshot(both, d, ["url_key", "city"]).groupBy("snapshot_dt", "city").agg(F.count("*").alias("n"))
    return day("2026-05-01").unionByName(day("2026-05-02"))


def union_types(spark, sf_dir):
    """Columns of sale and rent rows together: whole and broken numbers meet in doubles, numbers and text in text."""
    ads = view(spark, sf_dir, "ad")
    sale = ads.where("load_no % 2 = 0").select("ad_id", F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit("s").alias("only_sale"))
    rent = ads.where("load_no % 2 = 1").select("ad_id", F.lit(1.5).cast("double").alias("a"), F.lit("t").alias("b"), F.lit(7).alias("only_rent"))
    return S.union_by_name([sale, rent])


def bulk(spark, sf_dir):
    """Rows after a dump and a load, with the number of characters that had to be replaced."""
    ads = view(spark, sf_dir, "ad").select("ad_id", F.when(F.col("load_no") % 3 != 0, F.concat("title", F.lit("\n\x01x"))).alias("title"), "unit_price")
    dumped = stored(S.bulk_lines(ads), "bulk")
    path = shared_path(spark, "dump")
    dumped.select("line").write.text(path)
    back = S.read_bulk(spark, path, "ad_id string, title string, unit_price double")
    strict = S.strict_load(ads, back, "ad")
    return back.agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.round(F.sum("unit_price"), 2).alias("price"), F.max(F.length("title")).alias("longest")).crossJoin(dumped.agg(F.sum("replaced").alias("replaced"))).crossJoin(strict)


def layers(spark, sf_dir):
    """Layers of the warehouse, each loaded strictly from the one before."""
    rows = _latest(spark, sf_dir).select("url_key", "city")
    ods, dwd = stored(rows, "ods"), stored(rows.where("city <> 'gz'"), "dwd")
    return S.strict_load(rows, ods, "ods").unionByName(S.strict_load(ods.where("city <> 'gz'"), dwd, "dwd"))


def refilled(spark, sf_dir):
    """Layers that were emptied and filled, one of them by a load that failed and left it as it was."""
    rows = _latest(spark, sf_dir).select("url_key", "city")
    ods, dwd = shared_path(spark, "ods"), shared_path(spark, "dwd")
    first = O.refill(rows.where("city = 'gz'"), ods, "ods")
    whole = O.refill(rows, ods, "ods")
    O.refill(spark.read.parquet(ods).where("city <> 'gz'"), dwd, "dwd")
    try:
        O.refill(rows, dwd, "dwd", expected=whole + 1)
        said = "no failure"
    except RuntimeError as e:
        said = str(e).split(":")[0]
    layer = lambda name, path: spark.read.parquet(path).agg(F.lit(name).alias("layer"), F.count("*").alias("n"), F.count_if(F.col("city") == "gz").alias("gz"), F.lit(said).alias("failed"))
    return layer("ods", ods).unionByName(layer("dwd", dwd)).unionByName(spark.range(1).select(F.lit("first").alias("layer"), F.lit(first).cast("long").alias("n"), F.lit(first).cast("long").alias("gz"), F.lit(said).alias("failed")))


def object_snapshot(spark, sf_dir):
    """What an object store holds after two days' uploads: the second day's rows only."""
    ads = view(spark, sf_dir, "ad").select("ad_id", "city", F.when(F.col("load_no") % 3 == 0, "rent").otherwise("sale").alias("type"), F.when(F.col("load_no") % 2 == 0, "2026-05-01").otherwise("2026-05-02").alias("dt"))
    target = shared_path(spark, "objects")
    O.upload(ads, "2026-05-01", target)
    O.upload(ads, "2026-05-02", target)
    return spark.read.parquet(target).groupBy("type", "city").agg(F.count("*").alias("n"), F.max("ad_id").alias("last"))


def daily_snapshot(spark, sf_dir):
    """Snapshots of three days, the second of which was written twice."""
    state = enriched(spark, sf_dir).select("loan_id", "balance", "risk_class")
    state, path = stored(state, "state"), shared_path(spark, "snapshots")
    for day, share in (("2026-05-01", 1), ("2026-05-02", 2), ("2026-05-03", 3), ("2026-05-02", 4)):
        O.keep_day(state.where(F.col("loan_id") % share == 0), path, F.lit(day), F.lit(day))
    return spark.read.parquet(path).groupBy("snap_date", "risk_class").agg(F.count("*").alias("n"), F.sum("is_demo").alias("demo"))


def report_outputs(spark, sf_dir):
    """Lines of the class report's CSV and figures of its JSON, the second with a failed check."""
    from terravane.operators import reporting

    report = stored(reporting.report(enriched(spark, sf_dir)), "report")
    folder = shared_path(spark, "reports")
    none = report.select(F.lit("").alias("mismatch")).limit(0)
    csv, text = O.report_files(report, folder, "2026-05-01", none)
    _, failed = O.report_files(report, folder, "2026-05-02", report.where("is_total = 1").select(F.lit("total").alias("mismatch")))
    lines = spark.read.text(csv).select(F.when(F.col("value").startswith("risk_class"), F.col("value")).otherwise(F.regexp_extract("value", "^([^,]*,[^,]*),", 1)).alias("line"))
    for path in (text, failed):
        doc = spark.read.json(path)
        lines = lines.unionByName(doc.select(F.concat_ws("|", "date", "status", F.array_join("mismatches", ","), F.size("rows").cast("string")).alias("line")))
        lines = lines.unionByName(doc.select(F.explode("rows").alias("r")).select(F.concat_ws("|", "r.risk_class", F.col("r.loan_count").cast("string"), F.format_string("%.2f", "r.balance_pct_percent")).alias("line")))
    return lines


def dispatch_outputs(spark, sf_dir):
    """The ledger's CSV of one day, and the summary of its JSON."""
    loans = view(spark, sf_dir, "loan").select("loan_id", F.col("origination_date").alias("alert_date"), F.date_add("origination_date", 1).alias("dispatch_date"), F.when(F.col("loan_id") % 2 == 0, "success").otherwise("failed").alias("status"), (F.col("loan_id") % 3 + 1).alias("attempt_count"))
    day = str(loans.agg(F.mode("alert_date", True)).first()[0])
    summary = loans.where(F.col("alert_date") == day).agg(F.count("*").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"))
    csv, text = O.dispatch_files(loans, shared_path(spark, "dispatch"), day, summary)
    return spark.read.text(csv).select(F.col("value").alias("line")).distinct().unionByName(spark.read.json(text).select(F.concat_ws("|", "date", F.col("sent").cast("string"), F.col("failed").cast("string")).alias("line")))


def masked_csv(spark, sf_dir):
    """The alert export as CSV lines, its header included."""
    a = _alerts(spark, sf_dir).join(view(spark, sf_dir, "loan").select("loan_id", "collateral_id"), "loan_id").join(view(spark, sf_dir, "collateral").select("collateral_id", F.concat(F.lit("a,"), "property_addr").alias("property_addr")), "collateral_id")
    path = shared_path(spark, "csv")
    S.masked_export(a.withColumn("confirmed", F.when(F.col("loan_id") % 3 == 0, F.lit(True)))).write.option("header", "true").csv(path)
    lines = spark.read.text(path)
    return lines.distinct().withColumnRenamed("value", "line")


def json_sink(spark, sf_dir):
    rows = view(spark, sf_dir, "loan").select("loan_id", F.col("balance").cast("decimal(14,2)").alias("balance"), F.when(F.col("loan_id") % 2 == 0, F.col("customer_id")).alias("customer_id"))
    path = shared_path(spark, "jsonl")
    S.json_lines(rows).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def inbox_replay(spark, sf_dir):
    """Rows of an inbox table after the same alerts were written twice."""
    a = stored(_alerts(spark, sf_dir).select("loan_id", "alert_date", "ltv", F.lit(1).alias("received_at")), "alerts")
    return L.inbox(L.inbox(a, a), a).groupBy("received_at").agg(F.count("*").alias("n"))


def repaired(spark, sf_dir):
    """Addresses that were read with the wrong encoding, ones that were not, and Latin text, after repair."""
    n, address = F.col("collateral_id"), F.col("property_addr")
    broken = F.decode(F.encode(address, "UTF-8"), "ISO-8859-1")
    text = F.when(n % 7 == 0, F.lit("café")).when(n % 2 == 0, broken).otherwise(address)
    return view(spark, sf_dir, "collateral").select("collateral_id", S.repaired_text(text).alias("text"))


def renamed(spark, sf_dir):
    rows = view(spark, sf_dir, "loan").select(F.col("loan_id").alias("UNKNOWN_COL0"), F.col("balance").alias("UNKNOWN_COL1"), F.col("customer_id").alias("kept"))
    return S.named(rows, ["loan_id", "balance", "customer_id"])


_KIND = "CASE WHEN load_no % 4 = 2 THEN 'sale' ELSE 'rent' END"
_GOOD = "load_no % 4 <> 3 AND load_no % 37 <> 0 AND load_no % 41 <> 0 AND load_no % 31 <> 0"
_KEYED = "(SELECT *, 'sale:anjuke:' || regexp_extract(url, 'view/([A-Za-z0-9]+)', 1) AS k, CASE WHEN load_no % 2 = 0 THEN 'sale' ELSE 'rent' END AS kind FROM ad)"

_PCT = "printf('%.2f', round(pct * 100, 2))"
QUERIES = {
    "files_refilled": (
        refilled,
        oracle("listing", f"""WITH r AS ({LATEST}) SELECT 'ods' AS layer, count(*) AS n, count(*) FILTER (city = 'gz') AS gz, 'dwd' AS failed FROM r UNION ALL SELECT 'dwd', count(*), 0, 'dwd' FROM r WHERE city <> 'gz' UNION ALL SELECT 'first', count(*), count(*), 'dwd' FROM r WHERE city = 'gz'"""),
    ),
    "files_object_snapshot": (object_snapshot, oracle("ad", "SELECT CASE WHEN load_no % 3 = 0 THEN 'rent' ELSE 'sale' END AS type, city, count(*) AS n, max(ad_id) AS last FROM ad WHERE load_no % 2 <> 0 GROUP BY 1, 2")),
    "migration_daily_snapshot": (
        daily_snapshot,
        oracle(BASE, f"WITH e AS (SELECT loan_id, risk_class FROM ({ENRICHED})) SELECT CAST(day AS DATE) AS snap_date, risk_class, count(*) AS n, CAST(0 AS BIGINT) AS demo FROM e JOIN (VALUES ('2026-05-01', 1), ('2026-05-02', 4), ('2026-05-03', 3)) v(day, share) ON loan_id % share = 0 GROUP BY 1, 2"),
    ),
    "report_files": (
        report_outputs,
        oracle(BASE, f"""WITH e AS (SELECT risk_class, count(*) AS n, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS b FROM ({ENRICHED}) GROUP BY 1),
        f AS (SELECT v.c, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM (VALUES ('正常'), ('关注'), ('次级'), ('可疑'), ('损失')) v(c) LEFT JOIN e ON e.risk_class = v.c),
        t AS (SELECT c, n, b, round(b / sum(b) OVER (), 4) AS pct FROM f UNION ALL SELECT '合计', sum(n), sum(b), 1 FROM f)
        SELECT 'risk_class,loan_count,balance,balance_pct' AS line UNION ALL SELECT CAST(c AS VARCHAR) || ',' || CAST(CAST(n AS BIGINT) AS VARCHAR) FROM t
        UNION ALL SELECT c || '|' || CAST(CAST(n AS BIGINT) AS VARCHAR) || '|' || {_PCT} FROM t JOIN range(2) ON true UNION ALL SELECT '2026-05-01|ok||6' UNION ALL SELECT '2026-05-02|blocked|total|6'"""),
    ),
    "files_dispatch": (
        dispatch_outputs,
        oracle("loan", """WITH d AS (SELECT origination_date AS day, count(*) AS n, count(*) FILTER (loan_id % 2 <> 0) AS failed FROM loan GROUP BY 1 ORDER BY n DESC, day LIMIT 1)
        SELECT 'loan_id,alert_date,dispatch_date,status,attempt_count' AS line UNION ALL SELECT DISTINCT CAST(loan_id AS VARCHAR) || ',' || CAST(day AS VARCHAR) || ',' || CAST(CAST(day + INTERVAL 1 DAY AS DATE) AS VARCHAR) || ',' || CASE WHEN loan_id % 2 = 0 THEN 'success' ELSE 'failed' END || ',' || CAST(loan_id % 3 + 1 AS VARCHAR)
        FROM loan JOIN d ON day = origination_date UNION ALL SELECT CAST(day AS VARCHAR) || '|' || CAST(n AS VARCHAR) || '|' || CAST(failed AS VARCHAR) FROM d"""),
    ),
    "files_scan": (scanned, oracle("ad", f"SELECT city, {_KIND} AS kind, count(*) AS n, round(sum(CASE WHEN load_no % 43 <> 0 AND load_no % 47 <> 0 THEN unit_price END), 2) AS price FROM ad WHERE {_GOOD} GROUP BY 1, 2")),
    "files_incremental": (incremental, oracle("ad", "SELECT 'gz' AS city, true AS backfill, CAST(0 AS BIGINT) AS again FROM ad LIMIT 1")),
    "files_lake": (
        lake,
        oracle("ad", f"""WITH a AS (SELECT * FROM {_KEYED} WHERE city IN ('gz', 'sz', 'fs') QUALIFY row_number() OVER (PARTITION BY k ORDER BY ad_id) = 1), b AS (SELECT * FROM {_KEYED} WHERE city = 'sz' AND kind = 'sale' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ad_id) = 1)
        SELECT kind AS type, city, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT kind, city, k FROM a WHERE NOT (city = 'sz' AND kind = 'sale') UNION ALL SELECT kind, city, k FROM b WHERE unit_price > 30000) GROUP BY 1, 2"""),
    ),
    "files_snapshot": (snapshot, oracle("ad", "SELECT DATE '2026-05-01' AS snapshot_dt, city, count(*) AS n FROM ad GROUP BY 2 UNION ALL SELECT DATE '2026-05-02', city, count(*) FROM ad WHERE city = 'gz' GROUP BY 2")),
    "files_union_types": (
        union_types,
        oracle("ad", "SELECT ad_id, CASE WHEN load_no % 2 = 0 THEN 1::DOUBLE ELSE 1.5 END AS a, CASE WHEN load_no % 2 = 0 THEN '2' ELSE 't' END AS b, CASE WHEN load_no % 2 = 0 THEN 's' END AS only_sale, CAST(CASE WHEN load_no % 2 = 1 THEN 7 END AS BIGINT) AS only_rent FROM ad"),
    ),
    "files_bulk": (
        bulk,
        oracle("ad", "SELECT count(*) AS n, count(CASE WHEN load_no % 3 <> 0 THEN 1 END) AS titles, round(sum(unit_price), 2) AS price, CAST(max(CASE WHEN load_no % 3 <> 0 THEN length(title) + 3 END) AS INT) AS longest, CAST(2 * count(CASE WHEN load_no % 3 <> 0 THEN 1 END) AS BIGINT) AS replaced, 'ad' AS layer, count(*) AS counted, count(*) AS loaded FROM ad"),
    ),
    "files_layers": (layers, oracle("listing", f"SELECT 'ods' AS layer, count(*) AS counted, count(*) AS loaded FROM ({LATEST}) UNION ALL SELECT 'dwd', count(*), count(*) FROM ({LATEST}) WHERE city <> 'gz'")),
    "files_masked_csv": (
        masked_csv,
        oracle("loan collateral", f"""SELECT 'loan_id,customer,address,ltv,balance,risk_class,alert_level,confirmed' AS line UNION ALL
        SELECT a.loan_id || ',' || CASE WHEN length(CAST(a.customer_id AS VARCHAR)) <= 4 THEN 'c****' ELSE 'c****' || right(CAST(a.customer_id AS VARCHAR), 4) END || ',a，' || property_addr || ',' || printf('%.4f', a.ltv) || ',' || CAST(a.balance AS VARCHAR) || ',' ||
        CASE WHEN a.ltv <= 0.85 THEN '次级' WHEN a.ltv <= 1 THEN '可疑' ELSE '损失' END || ',' || alert_level || ',' || CASE WHEN a.loan_id % 3 = 0 THEN '1' ELSE '0' END FROM {_A} a JOIN loan l ON l.loan_id = a.loan_id JOIN collateral c ON c.collateral_id = l.collateral_id"""),
    ),
    "files_json_lines": (
        json_sink,
        oracle("loan", """SELECT '{"loan_id":' || loan_id || ',"balance":"' || CAST(CAST(balance AS DECIMAL(14,2)) AS VARCHAR) || '","customer_id":' || CASE WHEN loan_id % 2 = 0 THEN CAST(customer_id AS VARCHAR) ELSE 'null' END || '}' AS line FROM loan"""),
    ),
    "files_inbox_replay": (inbox_replay, oracle("loan collateral", f"SELECT CAST(1 AS INT) AS received_at, count(*) AS n FROM {_A}")),
    "files_repaired_text": (repaired, oracle("collateral", "SELECT collateral_id, CASE WHEN collateral_id % 7 = 0 THEN 'café' ELSE property_addr END AS text FROM collateral")),
    "files_renamed": (renamed, oracle("loan", "SELECT loan_id, balance, customer_id AS kept FROM loan")),
}
