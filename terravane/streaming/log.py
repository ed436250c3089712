"""The change log as a stream: batches, messages, offsets, consumers, health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators.merge import one_of_each, replace_keys
from terravane.sources.files import repaired_text
from terravane.sources.keyed import KeyedTable
from terravane.sources.shared import forget, stored
from terravane.streaming import changes as changes_

BODY = "loan_id int, customer_id int, collateral_id int, balance double, interest_rate double, risk_class string"
#: Seconds that a capture may stand still, events that a consumer may lag, and seconds in which an alert is not repeated.
STALE_S, MOST_LAG, THROTTLE_S = 1800, 1000, 1800


def batch_after(log: DataFrame, last_id: int, limit: int) -> DataFrame:
    """The next events past an offset, in the order of their ids."""
    return log.where(F.col("id") > last_id).orderBy("id").limit(limit)


def body(log: DataFrame) -> Column:
    """The JSON image that an event is about: before a delete, after all else."""
    return F.when(F.col("event_type") == "DELETE", F.col("before_json")).otherwise(F.col("after_json"))


def messages(log: DataFrame, biz_date: str) -> DataFrame:
    """A flat message for each event (id, table_name, event_type, before_json, after_json, cdc_ts).

    A loan's fields stand at the top, null where they are missing; JSON that
    cannot be read counts as an empty object.
    """
    image = F.from_json(body(log), BODY)
    fields = [x.split()[0] for x in BODY.split(", ")]
    loan = F.col("table_name") == "loan"
    payload = F.coalesce(F.to_json(F.from_json(body(log), "map<string,string>")), F.lit("{}"))
    return log.withColumn("_image", image).select(
        F.col("id").alias("event_id"), "table_name", "event_type", F.date_format("cdc_ts", "yyyy-MM-dd HH:mm:ss").alias("cdc_ts"), F.lit(biz_date).alias("biz_date"),
        *[F.when(loan, F.col(f"_image.{c}")).alias(c) for c in fields], payload.alias("payload"),
    )


def keyed(messages: DataFrame) -> DataFrame:
    """(key, value) of each message, as a Kafka sink takes them: events of one loan share a key and so keep their order."""
    key = F.concat(F.col("table_name"), F.lit(":"), F.coalesce("loan_id", "event_id").cast("string"))
    return messages.select(key.alias("key"), F.to_json(F.struct(*messages.columns), {"ignoreNullFields": "false"}).alias("value"))


def parsed(records: DataFrame, fields: str) -> DataFrame:
    """Messages of records (value), as a Kafka source gives them; what cannot be read is left out."""
    out = records.select(F.from_json(F.col("value").cast("string"), fields).alias("m"))
    return out.where("m is not null and m.event_id is not null").select("m.*")


def read_kafka(spark: SparkSession, servers: str, topic: str, start: str = "latest") -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()


def advance(offsets: DataFrame, consumer: str, batch: DataFrame) -> DataFrame:
    """Offsets (consumer, last_id) after a batch; an offset never goes back, and an empty batch moves none."""
    top = batch.agg(F.max("id").alias("last_id")).where("last_id is not null").select(F.lit(consumer).alias("consumer"), "last_id")
    both = offsets.where(F.col("consumer") == consumer).unionByName(top).groupBy("consumer").agg(F.max("last_id").alias("last_id"))
    return replace_keys(offsets, both, ["consumer"])


def rewound(offsets: DataFrame, consumer: str, last_id: int) -> DataFrame:
    """Offsets from which ``consumer`` reads anew after ``last_id``."""
    return replace_keys(offsets, offsets.sparkSession.createDataFrame([(consumer, last_id)], "consumer string, last_id long"), ["consumer"])


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of events (event_id, ts) without repeats within ``delay``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def forward(log: DataFrame, biz_date: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Stream query that gives the keyed messages of new events to ``sink``; offsets move when a batch has been taken."""

    def batch(df: DataFrame, number: int) -> None:
        sink(keyed(messages(df, biz_date)), number)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_folder(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that owns a folder for each batch: a batch that is run again overwrites what it wrote."""
    return lambda df, number: df.write.mode("overwrite").json(f"{folder}/batch={number}")


def consume(log: DataFrame, state: KeyedTable, loans: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], summary_path: str, summarise: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Stream query that keeps computed loans, a keyed table, and their summary up to date with the log.

    A batch plans what its events touch, computes those loans anew, deletes the
    deleted ones, rewrites their buckets alone, then the summary of all. A batch
    that is run again changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        now = loans()
        plan = stored(changes_.plan_impact(df, now), "plan")
        wanted = now.join(plan.where("action = 'recalc'"), state.key, "left_semi")
        version = state.apply(compute(wanted), plan.where("action = 'delete'").select(state.key), number)
        summarise(state.read(version)).write.mode("overwrite").parquet(f"{summary_path}/{number}")
        state.clean()
        forget(plan)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): what stands at the ends of each row's JSON, of any depth, with strings repaired that were read in the wrong encoding.

    Numbers and booleans are given as JSON writes them, null as null; an empty
    object or list has no ends; text that is no JSON is one itself, at ``$``.
    Each round opens one level of all rows, so there are as many rounds as the
    deepest row has levels.
    """
    spark = rows.sparkSession
    whole = rows.select(key, F.lit("$").alias("path"), F.try_parse_json(text).alias("v"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)

    def ends(df: DataFrame) -> DataFrame:
        said = F.when(kind == "STRING", repaired_text(F.try_variant_get("v", "$", "string"))).otherwise(F.to_json("v"))
        return df.where(~kind.isin("OBJECT", "ARRAY")).select(key, "path", F.when(kind != "VOID", said).alias("value"))

    out = whole.where("v is null").select(key, "path", repaired_text(F.col("_text")).alias("value"))
    level = stored(whole.where("v is not null").select(key, "path", "v"), "level")
    while True:
        out = out.unionByName(ends(level))
        inner = level.where(kind.isin("OBJECT", "ARRAY"))
        if not inner.limit(1).count():
            return out
        opened = spark.sql("SELECT r.*, e.pos, e.key AS _key, e.value AS _value FROM {inner} AS r, LATERAL variant_explode(r.v) AS e", inner=inner)
        step = F.coalesce(F.concat(F.lit("."), repaired_text(F.col("_key"))), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = stored(opened.select(key, F.concat("path", step).alias("path"), F.col("_value").alias("v")), "level")


def capture(source: DataFrame, positions: KeyedTable, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Stream query that gives the changes of a log (file, pos, ...) to ``sink``, and then writes how far it came.

    The data is there before the position is: after a crash a batch is given
    again, under its number, and none is lost. ``positions`` has repl_key, file, pos.
    """

    def batch(df: DataFrame, number: int) -> None:
        sink(df, number)
        top = df.agg(F.max(F.struct("file", "pos")).alias("at")).where("at is not null")
        top = top.select(F.lit("binlog").alias("repl_key"), "at.file", "at.pos")
        positions.apply(top, top.limit(0), number)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ahead(file_a: Column, pos_a: Column, file_b: Column, pos_b: Column) -> Column:
    """Whether log position a is past b: by file name, then by place in the file."""
    return F.struct(file_a.alias("f"), pos_a.cast("long").alias("p")) > F.struct(file_b.alias("f"), pos_b.cast("long").alias("p"))


def health(positions: DataFrame, log: DataFrame, offsets: DataFrame, consumer: str, now: Column) -> DataFrame:
    """(alert_type, detail) of what stands still or lags.

    ``positions`` is one row (file, pos, updated_at, master_file, master_pos).
    """
    stale = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    late = positions.where(ahead(F.col("master_file"), F.col("master_pos"), F.col("file"), F.col("pos")) & (stale > STALE_S))
    late = late.select(F.lit("binlog_lag").alias("alert_type"), F.format_string("stands still for %d s at %s:%d", stale, "file", F.col("pos").cast("long")).alias("detail"))
    lag = changes_.consumer_lag(log, offsets, [consumer]).where(F.col("lag") > MOST_LAG)
    return late.unionByName(lag.select(F.lit("consumer_lag").alias("alert_type"), F.format_string("%d events behind", "lag").alias("detail")))


def throttled(alerts: DataFrame, sent: DataFrame, now: Column, seconds: int = THROTTLE_S) -> DataFrame:
    """Alerts of a type that has not been sent (alert_type, alert_ts) in the last ``seconds``; one for each type."""
    recent = sent.where(F.unix_timestamp(now) - F.unix_timestamp("alert_ts") < seconds).select("alert_type").distinct()
    return one_of_each(alerts.join(recent, "alert_type", "left_anti"), ["alert_type"], [F.col("detail")])
