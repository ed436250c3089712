"""Streams with state: throttled alerts against a plain loop, an inbox that is replayed, a lookup with an age."""

import random

import pytest
from pyspark.sql import functions as F

from terravane.streaming import stateful

KIND = "alert_type string, detail string, alert_ts timestamp"


def alerts(spark, rows):
    return spark.createDataFrame(rows, "alert_type string, detail string, s long").select("alert_type", "detail", F.timestamp_seconds("s").alias("alert_ts"))


def kept(rows, seconds):
    last, out = {}, []
    for kind, detail, s in sorted(rows, key=lambda r: (r[2], r[1])):
        if kind not in last or s - last[kind] >= seconds:
            out.append((kind, detail, s))
            last[kind] = s
    return sorted(out)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_throttled_streams_equal_a_loop_and_replays_change_nothing(spark, tmp_path, one_partition):
    rng, start = random.Random(7), 1_777_000_000
    batches = [[(rng.choice("abc"), f"d{n}", start + 600 * b + rng.randrange(600)) for n in range(12)] for b in range(4)]
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda at: (
        stateful.throttled(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder), 900)
        .writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    for b in batches:
        alerts(spark, b).coalesce(1).write.mode("append").parquet(folder)
        run(f"{tmp_path}/c")
    seen = lambda: sorted((r.alert_type, r.detail, int(r.alert_ts.timestamp())) for r in spark.read.parquet(out).select("*", F.lit(1)).collect())
    want = kept([r for b in batches for r in b], 900)
    assert seen() == want and 3 < len(want) < 20
    run(f"{tmp_path}/c")
    assert seen() == want


def test_the_inbox_takes_an_event_once(spark, tmp_path, one_partition):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(rows, "event_id long, v string").withColumn("ts", F.timestamp_seconds(F.lit(1_777_000_000) + F.col("event_id"))).coalesce(1).write.mode("append").parquet(folder)
        events = spark.readStream.schema("event_id long, v string, ts timestamp").parquet(folder)
        query = stateful.inbox(events, "ts").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_lookup_is_read_anew_when_it_is_old(spark):
    now, reads = [0.0], []

    def read():
        reads.append(now[0])
        return spark.range(len(reads))

    table = stateful.Lookup(read, 10.0, lambda: now[0])
    assert table().count() == 1
    now[0] = 9.9
    assert table().count() == 1
    now[0] = 10.0
    assert table().count() == 2 and reads == [0.0, 10.0]
