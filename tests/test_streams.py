"""Streams over files: forwarding, replay, incremental state, duplicates."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terravane.operators import risk
from terravane.sources import binlog
from terravane.sources.adapter import view
from terravane.sources.keyed import KeyedTable
from terravane.streaming import log

SF = "/root/testdata/sf0.001"
LOG = "id long, table_name string, event_type string, before_json string, after_json string, cdc_ts timestamp"


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _events(spark, rows):
    return spark.createDataFrame(rows, "id long, table_name string, event_type string, before_json string, after_json string, t string").withColumn("cdc_ts", F.to_timestamp("t")).drop("t")


def test_messages_take_the_right_image(spark):
    t = "2026-05-01 10:00:00"
    rows = [
        (1, "loan", "UPDATE", '{"loan_id": 7, "balance": 1}', '{"loan_id": 7, "balance": null, "risk_class": "正常"}', t),
        (2, "loan", "DELETE", '{"loan_id": 8, "balance": 2.5}', None, t),
        (3, "loan", "INSERT", None, "{bad", t),
        (4, "collateral", "UPDATE", None, '{"collateral_id": 3}', t),
        (5, "loan", "INSERT", None, None, t),
    ]
    got = {r.event_id: r for r in log.messages(_events(spark, rows), "2026-05-01").collect()}
    assert (got[1].loan_id, got[1].balance, got[1].risk_class) == (7, None, "正常")
    assert (got[2].loan_id, got[2].balance) == (8, 2.5)
    assert got[3].payload == "{}" and got[3].loan_id is None and got[5].payload == "{}"
    assert got[4].collateral_id is None and json.loads(got[4].payload) == {"collateral_id": "3"}
    keys = {r.key for r in log.keyed(log.messages(_events(spark, rows), "2026-05-01")).collect()}
    assert keys == {"loan:7", "loan:8", "loan:3", "collateral:4", "loan:5"}


def test_forwarder_moves_on_and_replays(spark, tmp_path):
    t, folder = "2026-05-01 10:00:00", f"{tmp_path}/log"
    make = lambda ids: _events(spark, [(i, "loan", "INSERT", None, f'{{"loan_id": {i}}}', t) for i in ids]).coalesce(1)
    make(range(5)).write.parquet(folder)
    run = lambda out, checkpoint: log.forward(_stream(spark, folder, LOG), "2026-05-01", log.to_folder(out), checkpoint).awaitTermination()
    out, at = f"{tmp_path}/out", f"{tmp_path}/at"
    run(out, at)
    make(range(5, 8)).write.mode("append").parquet(folder)
    run(out, at)
    run(out, at)
    keys = [r.key for r in spark.read.json(out).collect()]
    assert sorted(keys) == sorted(f"loan:{i}" for i in range(8))
    run(out, f"{tmp_path}/anew")  # from the start: batches overwrite what they had written
    assert sorted(r.key for r in spark.read.json(out).collect()) == sorted(f"loan:{i}" for i in range(8))


def test_consumer_equals_a_full_computation(spark, tmp_path):
    loans, collateral = view(spark, SF, "loan"), view(spark, SF, "collateral")
    compute = lambda df: risk.enrich(df, collateral).select("loan_id", "balance", "ltv", "risk_class")
    ids = [r.loan_id for r in loans.orderBy("loan_id").limit(4).collect()]
    changes = "id long, table_name string, event_type string, entity_id long"
    folder = f"{tmp_path}/changes"
    spark.createDataFrame([(1, "loan", "UPDATE", ids[0]), (2, "loan", "DELETE", ids[1]), (3, "loan", "UPDATE", None)], changes).coalesce(1).write.parquet(folder)
    moved = loans.where(F.col("loan_id") != ids[1]).withColumn("balance", F.when(F.col("loan_id").isin(ids[0], ids[2]), F.col("balance") * 2).otherwise(F.col("balance")))
    state = KeyedTable(spark, f"{tmp_path}/s", compute(loans).schema, "loan_id", buckets=16)
    state.replace(compute(loans))
    run = lambda at="c": log.consume(_stream(spark, folder, changes), state, lambda: moved, compute, f"{tmp_path}/sum", risk.class_summary, f"{tmp_path}/{at}").awaitTermination()
    run()
    before = state.manifest()["folders"]
    spark.createDataFrame([(4, "loan", "UPDATE", ids[2])], changes).coalesce(1).write.mode("append").parquet(folder)
    run()
    after = state.manifest()
    assert sorted(state.read().collect()) == sorted(compute(moved).collect())
    summary = spark.read.parquet(f"{tmp_path}/sum/1")
    assert sorted(summary.collect()) == sorted(risk.class_summary(compute(moved)).collect())
    # one loan, one bucket: the others' files are those of the version before
    assert sum(after["folders"][b] != before[b] for b in before) == 1 and after["batch"] == 1
    run("again")  # all batches once more, from the start: nothing moves
    assert state.manifest() == after


def test_keyed_tables_keep_untouched_buckets_and_whole_versions(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(200)], "k long, v string")
    table = KeyedTable(spark, f"{tmp_path}/t", rows.schema, "k", buckets=8)
    assert table.read().count() == 0
    assert table.replace(rows) == 0
    old = {p: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/t/data").rglob("*.parquet")}
    changed = spark.createDataFrame([(3, "new"), (900, "more")], rows.schema)
    gone = spark.createDataFrame([(5,), (3,), (901,)], "k long")
    assert table.apply(changed, gone, batch=7) == 1 and table.apply(changed, gone, batch=7) == 1 and table.apply(gone.selectExpr("k", "'x' v"), gone, batch=6) == 1
    want = {i: f"v{i}" for i in range(200) if i != 5} | {3: "new", 900: "more"}
    assert {r.k: r.v for r in table.read().collect()} == want and table.read(0).count() == 200
    touched = {r[0] for r in spark.createDataFrame([(3,), (5,), (900,), (901,)], "k long").select(table.bucket("k")).collect()}
    a, b = table.manifest(0)["folders"], table.manifest(1)["folders"]
    assert {int(x) for x in a if a[x] != b[x]} == touched
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())
    assert table.apply(changed.limit(0), gone.limit(0), batch=8) == 2 and table.manifest()["folders"] == b
    # a bucket that loses all its rows is no longer named
    one = spark.createDataFrame([(1, "a")], rows.schema)
    lone = KeyedTable(spark, f"{tmp_path}/u", rows.schema, "k", buckets=4)
    lone.replace(one)
    lone.apply(one.limit(0), one.select("k"), 1)
    assert lone.manifest()["folders"] == {} and lone.read().count() == 0
    table.clean(keep=1)
    assert table.versions() == [2] and {r.k: r.v for r in table.read().collect()} == want
    left = {p for p in Path(f"{tmp_path}/t/data").rglob("*.parquet")}
    assert len(left) <= 8 + 2 and not any(f"_bucket={b}/" in str(p) and p in old for b in touched for p in left)


def _append(path, rows, end="\n"):
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + end)


def test_ranges_of_a_log_give_each_line_once(tmp_path, monkeypatch):
    for n in (1, 2):
        _append(tmp_path / f"binlog.00000{n}", [{"table": "t", "type": "INSERT", "after": {"i": n * 100 + i}} for i in range(50)])
    whole = [x for r in binlog.ranges(str(tmp_path), ("", 0), binlog.files(str(tmp_path))[-1]) for x in binlog.lines(str(tmp_path), r)]
    assert len(whole) == 100
    for part in (1, 7, 60, 61, 1000):
        cut = [x for r in binlog.ranges(str(tmp_path), ("", 0), binlog.files(str(tmp_path))[-1], part) for x in binlog.lines(str(tmp_path), r)]
        assert cut == whole, part
    # behind any position: the lines that begin there or later
    for row in (whole[0], whole[49], whole[60]):
        rest = [x for r in binlog.ranges(str(tmp_path), row[:2], binlog.files(str(tmp_path))[-1], 64) for x in binlog.lines(str(tmp_path), r)]
        assert rest == whole[whole.index(row) + 1 :]


def test_capture_restarts_and_replays(spark, tmp_path):
    logs, out = tmp_path / "logs", f"{tmp_path}/out"
    logs.mkdir()
    positions = KeyedTable(spark, f"{tmp_path}/pos", spark.createDataFrame([], "repl_key string, file string, pos long").schema, "repl_key", buckets=1)
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    run = lambda at="c", **k: log.capture(binlog.stream(spark, str(logs), **k), positions, sink, f"{tmp_path}/{at}").awaitTermination()
    event = lambda i: {"table": "loan", "type": "UPDATE", "before": None, "after": {"loan_id": i}, "ts": "2026-05-01"}
    seen = lambda: sorted(json.loads(r.after_json)["loan_id"] for r in spark.read.parquet(out).collect())
    _append(logs / "binlog.000001", [event(1), "{broken", event(2), '{"table": "loan", "half'], end="")
    run()
    assert seen() == [1, 2]
    at = positions.read().first()
    assert at.file == "binlog.000001" and at.pos < (logs / "binlog.000001").stat().st_size
    _append(logs / "binlog.000001", ['": 1, "type": "x", "after": {"loan_id": 3}}'])
    _append(logs / "binlog.000002", [event(4), event(5)])
    run()
    run()  # nothing new
    assert seen() == [1, 2, 3, 4, 5]
    assert tuple(positions.read().select("file", "pos").first()) == ("binlog.000002", (logs / "binlog.000002").stat().st_size)
    # another capture that goes on from the first one's stored position
    again = KeyedTable(spark, f"{tmp_path}/pos2", positions.schema, "repl_key", buckets=1)
    rows = []
    log.capture(binlog.stream(spark, str(logs), at.file, at.pos), again, lambda df, n: rows.extend(r.after_json for r in df.collect()), f"{tmp_path}/d").awaitTermination()
    assert sorted(json.loads(r)["loan_id"] for r in rows) == [3, 4, 5] and again.read().collect() == positions.read().collect()


def test_a_crash_after_the_data_repeats_the_batch(spark, tmp_path):
    logs, out = tmp_path / "logs", f"{tmp_path}/out"
    logs.mkdir()
    _append(logs / "binlog.000001", [{"table": "t", "type": "INSERT", "after": {"i": i}} for i in range(3)])
    positions = KeyedTable(spark, f"{tmp_path}/pos", spark.createDataFrame([], "repl_key string, file string, pos long").schema, "repl_key", buckets=1)

    def falls(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        log.capture(binlog.stream(spark, str(logs)), positions, falls, f"{tmp_path}/c").awaitTermination()
    assert positions.read().count() == 0
    log.capture(binlog.stream(spark, str(logs)), positions, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(out).count() == 3 and positions.read().first().file == "binlog.000001"


def test_ends_of_nested_json(spark):
    broken = "广州".encode().decode("latin-1")
    rows = [(1, json.dumps({"a": {"b": [1, {"c": broken}], "é": None}, "d": True, "e": {}}, ensure_ascii=False)), (2, "{bad"), (3, None), (4, '"x"'), (5, "[" * 30 + "7" + "]" * 30), (6, "[]"), (7, "1.50")]
    got = sorted((r.k, r.path, r.value) for r in log.leaves(spark.createDataFrame(rows, "k int, t string"), "k", "t").where("value is not null").collect())
    assert got == sorted([(1, "$.a.b[0]", "1"), (1, "$.a.b[1].c", "广州"), (1, "$.d", "true"), (2, "$", "{bad"), (4, "$", "x"), (5, "$" + "[0]" * 30, "7"), (7, "$", "1.5")])


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    rows = [(1, "2026-05-01 10:00:00"), (1, "2026-05-01 10:10:00"), (2, "2026-05-01 10:20:00")]
    spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{tmp_path}/e")
    log.deduplicated(events).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/o").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [1, 2]


def test_positions_and_throttle(spark):
    p = spark.createDataFrame([("b.9", 5, "b.10", 9), ("b.10", 9, "b.10", 5), ("b.10", 10, "b.10", 9), ("b.2", 1, "b.2", 1)], "fa string, pa string, fb string, pb string")
    assert [r[0] for r in p.select(log.ahead(F.col("fa"), F.col("pa"), F.col("fb"), F.col("pb"))).collect()] == [True, True, True, False]
    alerts = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "alert_type string, detail string")
    sent = spark.createDataFrame([("b", "2026-05-01 10:00:00")], "alert_type string, t string").select("alert_type", F.to_timestamp("t").alias("alert_ts"))
    at = lambda s: F.lit(s).cast("timestamp")
    assert {(r.alert_type, r.detail) for r in log.throttled(alerts, sent, at("2026-05-01 10:29:59")).collect()} == {("a", "x")}
    assert {r.alert_type for r in log.throttled(alerts, sent, at("2026-05-01 10:30:00")).collect()} == {"a", "b"}
