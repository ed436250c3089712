"""Report files, layers that are emptied and filled, object-store snapshots, optional inputs."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terravane.sources.shared import remove


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def swap(spark: SparkSession, made: str, path: str) -> None:
    """Put the folder ``made`` in the place of ``path``, whose files go; both on one file system."""
    fs, new = _file_system(spark, made)
    _, old = _file_system(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{uuid.uuid4().hex}")
    there = fs.exists(old)
    if there:
        fs.rename(old, aside)
    fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        if there:
            fs.rename(aside, old)
        raise RuntimeError(f"{made} did not become {path}")
    if there:
        fs.delete(aside, True)


def refill(rows: DataFrame, path: str, name: str, expected: int | None = None) -> int:
    """Empty a stored table and fill it with ``rows``; the number of rows.

    Rows are counted while they are written and again in what was written; if
    these differ, or differ from ``expected``, the load fails and the table
    stays as it was.
    """
    spark, made = rows.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(made)
        counted, loaded = seen.get["n"], spark.read.schema(rows.schema).parquet(made).count()
        if counted != loaded or expected is not None and expected != loaded:
            raise RuntimeError(f"{name}: {loaded} rows loaded of {counted if expected is None else expected}")
    except Exception:
        remove(spark, made)
        raise
    swap(spark, made, path)
    return loaded


def upload(lake: DataFrame, day: str, target: str) -> DataFrame:
    """(type, n): the one snapshot of ``day`` (dt, type, ...) under ``target``/type, which holds nothing else afterwards.

    A kind without rows is emptied. A day that the lake does not have fails and
    leaves the target as it was.
    """
    spark = lake.sparkSession
    mine = lake.where(F.col("dt").cast("string") == day).drop("dt")
    if not mine.limit(1).count():
        raise RuntimeError(f"the lake has no snapshot of {day}")
    made = f"{target.rstrip('/')}.{uuid.uuid4().hex}"
    mine.write.partitionBy("type").parquet(made)
    swap(spark, made, target)
    return spark.read.parquet(target).groupBy("type").agg(F.count("*").alias("n"))


def keep_day(rows: DataFrame, path: str, day: Column, computed: Column | None = None) -> None:
    """Write the day's real snapshot (snap_date, is_demo 0) beside the other days'; run again, it takes the place of what it wrote.

    The rows must have been computed for that day (``computed``), so a snapshot
    cannot come before its risk run.
    """
    early = F.raise_error(F.lit("the risk run of the day has not been made")) if computed is not None else None
    at = F.when(computed != day, early).otherwise(day) if computed is not None else day
    laid = rows.withColumns({"snap_date": at.cast("date"), "is_demo": F.lit(0)})
    laid.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("snap_date").parquet(path)


def percent(share: Column) -> Column:
    return F.round(share * 100, 2)


def report_files(report: DataFrame, folder: str, day: str, mismatches: DataFrame) -> tuple[str, str]:
    """The class report (risk_class, class_rank, loan_count, balance, balance_pct) as CSV with shares in percent, and as JSON with the checks' result. A report is six rows, and each is one file."""
    csv, text = f"{folder}/ads_1104_g11_{day}.csv", f"{folder}/g11_report_{day}.json"
    rows = report.orderBy("class_rank").coalesce(1)
    rows.select("risk_class", "loan_count", "balance", percent(F.col("balance_pct")).alias("balance_pct")).write.mode("overwrite").option("header", "true").csv(csv)
    line = F.struct("class_rank", "risk_class", "loan_count", "balance", "balance_pct", percent(F.col("balance_pct")).alias("balance_pct_percent"))
    bad = mismatches.agg(F.array_sort(F.collect_list("mismatch")).alias("mismatches"))
    whole = report.agg(F.array_sort(F.collect_list(line)).alias("rows")).crossJoin(bad)  # one row each
    status = F.when(F.size("mismatches") == 0, "ok").otherwise("blocked")
    whole.select(F.lit(day).alias("date"), status.alias("status"), "mismatches", "rows").coalesce(1).write.mode("overwrite").json(text)
    return csv, text


def dispatch_files(ledger: DataFrame, folder: str, day: str, summary: DataFrame) -> tuple[str, str]:
    """The day's delivery ledger as CSV in the order of loans, and the run's summary (one row) as JSON."""
    csv, text = f"{folder}/alert_dispatch_{day}.csv", f"{folder}/alert_summary_{day}.json"
    mine = ledger.where(F.col("alert_date").cast("string") == day)
    mine.select("loan_id", "alert_date", "dispatch_date", "status", "attempt_count").orderBy("loan_id").write.mode("overwrite").option("header", "true").csv(csv)
    summary.select(F.lit(day).alias("date"), "*").coalesce(1).write.mode("overwrite").json(text)
    return csv, text


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON document of that schema as one row; None where the file is absent, empty or damaged."""
    try:
        rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(path)
        found = rows.select("*").limit(1).collect()
    except AnalysisException:
        return None
    return rows.drop("_bad") if found and found[0]["_bad"] is None else None


def benchmark(spark: SparkSession, path: str) -> DataFrame | None:
    """People (person, income_monthly, debt_ratio, credit_score) of a benchmark snapshot's arrays; None without the file."""
    doc = optional_json(spark, path, "source string, features struct<income_monthly:array<double>,debt_ratio:array<double>,credit_score:array<double>>")
    if doc is None:
        return None
    each = F.posexplode(F.arrays_zip("features.income_monthly", "features.debt_ratio", "features.credit_score"))
    return doc.select(each.alias("person", "f")).select("person", "f.income_monthly", "f.debt_ratio", "f.credit_score")


def capped(rows: DataFrame, key: str, most: int | None) -> DataFrame:
    """All rows, or the first ``most`` by key, for a trial run."""
    return rows if most is None else rows.orderBy(key).limit(most)
