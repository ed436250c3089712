"""File connectors: JSON lines, partitioned lake, bulk text, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.functions import columns as C
from terravane.operators.merge import one_of_each

#: A crawl file's or folder's name says its city and kind: gz_sale_0.jsonl, task=gz_rent.
_TASK = r"([A-Za-z0-9]+)_(sale|fangyuan|rent)(?:_[^/]*)?(?:/[^/]*)?$"


def new_files(listing: DataFrame, seen: DataFrame, backfill: bool = False) -> DataFrame:
    """Files (path, modified, length) that the manifest does not hold as they are now; all of them on a backfill."""
    return listing if backfill else listing.join(seen.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")


def mark_files(seen: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest with the files that were read, each once and as they were."""
    from terravane.operators.merge import replace_keys

    return replace_keys(seen, done.select("path", "modified", "length"), ["path"])


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of the files under a folder, as Spark's reader sees them; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def scan_lines(spark: SparkSession, paths: str | list[str], schema: str, cities: list[str]) -> DataFrame:
    """Rows of JSON-line files with their task (city, kind) and place; bad lines, blank ones and files of other names are left out.

    An object without any of the fields is a row of nulls; a value of another
    type than its field is null.

    ``kind`` is sale or rent; ``_file`` and ``_line`` order rows as they stand in the files.
    """
    kinds = T.StructType.fromDDL(schema)
    lines = spark.read.schema(T.StructType([*kinds.fields, T.StructField("_bad", T.StringType())])).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(paths)
    place = F.col("_metadata.file_path")
    tagged = lines.select("*", place.alias("_file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_line"))
    city, kind = F.regexp_extract("_file", _TASK, 1), F.regexp_extract("_file", _TASK, 2)
    tagged = tagged.withColumns({"_city": city, "_kind": F.when(kind == "sale", "sale").otherwise("rent")}).where((kind != "") & F.col("_city").isin(cities))
    # a field of another type makes a line bad for the reader; if it is an object all the same, its other fields count
    sound = F.col("_bad").isNull() | F.coalesce(F.schema_of_variant(F.try_parse_json("_bad")).startswith("OBJECT"), F.lit(False))
    return tagged.where(sound).drop("_bad").withColumnsRenamed({"_city": "city", "_kind": "kind"})


def first_of_each_url(rows: DataFrame) -> DataFrame:
    """Rows with their url_key, the first of each as they stand in the files."""
    keyed = rows.withColumn("url_key", C.url_key(F.col("url")))
    return one_of_each(keyed, ["url_key"], [F.col("_file"), F.col("_line")])


def write_lake(rows: DataFrame, path: str, day: str) -> None:
    """Add a day's rows (url_key, kind, city, ...) to the lake by dt, type and city; only the partitions that occur are replaced."""
    out = rows.withColumns({"dt": F.lit(day), "first_seen": F.to_date(F.lit(day)), "last_seen": F.to_date(F.lit(day))}).withColumnRenamed("kind", "type").drop("_file", "_line")
    # one writer for each partition's rows would be a hot task for a large city: rows stay where they are
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "type", "city").parquet(path)


def lake_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows and different keys of each lake partition, read where the files are."""
    return spark.read.option("basePath", path).parquet(path).groupBy("type", "city").agg(F.count("*").alias("n"), F.count_distinct("url_key").alias("keys"))


def snapshot(lake: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """The columns of a lake day, with the day as the snapshot's date."""
    return lake.where(F.col("dt").cast("string") == day).select(*columns, F.to_date(F.lit(day)).alias("snapshot_dt"))


#: Which type holds the values of both: whole numbers widen to doubles, all else meets in text.
def common_type(a: str | None, b: str | None) -> str:
    if a is None or b is None or a == b:
        return a or b or "string"
    numbers = {"bigint": 0, "double": 1}
    return max((a, b), key=numbers.get) if a in numbers and b in numbers else "string"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns; where types differ, under their common type."""
    kinds: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kind = "bigint" if kind in ("int", "smallint", "tinyint") else kind
            kinds[name] = common_type(kinds.get(name), kind)
    out = None
    for df in frames:
        part = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        out = part if out is None else out.unionByName(part)
    return out


SEPARATOR, NULL = "\x01", "\\N"


def bulk_lines(rows: DataFrame) -> DataFrame:
    """(line, replaced): a row's columns joined by the bulk loader's separator, nulls as \\N; separators and line ends inside become spaces and are counted."""
    texts = [F.col(c).cast("string") for c in rows.columns]
    clean = [F.coalesce(F.regexp_replace(t, "[\\x01\\r\\n]", " "), F.lit(NULL)) for t in texts]
    dirty = sum((F.coalesce(F.regexp_count(t, F.lit("[\\x01\\r\\n]")), F.lit(0)) for t in texts), F.lit(0))
    return rows.select(F.concat_ws(SEPARATOR, *clean).alias("line"), dirty.alias("replaced"))


def read_bulk(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", SEPARATOR).option("nullValue", NULL).option("quote", "").option("emptyValue", "").csv(path)


def strict_load(source: DataFrame, loaded: DataFrame, name: str) -> DataFrame:
    """``loaded``'s and the source's row counts; the job fails when they differ."""
    a, b = source.agg(F.count("*").alias("counted")), loaded.agg(F.count("*").alias("loaded"))
    off = F.col("counted") != F.col("loaded")
    said = F.concat(F.lit(f"{name}: "), F.col("loaded"), F.lit(" rows loaded of "), F.col("counted"))
    return a.crossJoin(b).select(F.lit(name).alias("layer"), "counted", F.when(off, F.raise_error(said)).otherwise(F.col("loaded")).alias("loaded"))


def masked_export(rows: DataFrame) -> DataFrame:
    """The alert list as it leaves the house: fixed column order, personal data masked, ratio with four digits, no bare commas, confirmation as 0 or 1.

    ``rows``: loan_id, customer_id, property_addr, ltv, balance, risk_class, alert_level, confirmed.
    """
    return rows.select(
        "loan_id",
        C.mask(F.col("customer_id")).alias("customer"),
        F.replace("property_addr", F.lit(","), F.lit("，")).alias("address"),
        F.format_string("%.4f", "ltv").alias("ltv"),
        "balance",
        "risk_class",
        "alert_level",
        F.coalesce(F.col("confirmed").cast("int"), F.lit(0)).alias("confirmed"),
    )


def json_lines(rows: DataFrame) -> DataFrame:
    """A JSON text for each row, exact decimals as text and nulls kept."""
    out = rows.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in rows.schema.fields])
    return out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("value"))


def repaired_text(text: Column) -> Column:
    """Text whose UTF-8 bytes were once read as Latin-1, read anew; text that this cannot have happened to stays."""
    back = F.try_validate_utf8(F.encode(text, "ISO-8859-1"))
    latin = ~text.rlike("[^\\x00-\\xff]")
    return F.when(latin & back.isNotNull(), back).otherwise(text)


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns called UNKNOWN_COL<i> under the name that the source's table has at that place."""
    return rows.withColumnsRenamed({f"UNKNOWN_COL{i}": n for i, n in enumerate(names) if f"UNKNOWN_COL{i}" in rows.columns})
