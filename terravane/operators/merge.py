"""Keyed merges of whole tables: upsert, replace, delete, first or latest row of a key.

Plain Parquet tables have no MERGE; a merge is a join whose result is written
as a new table or as the partitions that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Full merge on ``keys``; a column takes coalesce(new, old), or what its rule makes of (old, new). Keys must be unique on either side."""
    rules = rules or {}
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    out = []
    for c in old.columns:
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        rule = rules.get(c) if c not in keys else None
        out.append((rule(before, after) if rule else F.coalesce(after, before)).alias(c))
    return o.join(n, on, "full").select(*out)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of all old rows with their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def one_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def inserted_and_updated(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys of ``new`` are new, and how many are known."""
    known = new.join(old.select(*keys).distinct().withColumn("_known", F.lit(1)), keys, "left")
    return known.agg(F.count_if(F.col("_known").isNull()).alias("inserted"), F.count("_known").alias("updated"))
