"""Exact percentiles of groups of any size, by selection: no group's values are held together.

A sketch of each group gives bounds between which a percentile must lie: its
ranks are off by a ten-thousandth of the group at most. A second pass counts
what lies between bounds by value and all else as a whole, so that of a large
group some thousandths of its values are put in order, and of a small one all.
Should a rank fall outside of its bounds, its group is computed as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.sources.shared import stored

ACCURACY = 10_000
#: Groups of up to so many rows are put in order as they are.
SMALL = 10_000
#: Most groups whose bounds are broadcast, some 100 bytes each.
BROADCAST_GROUPS = 100_000


def percentiles(rows: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """(keys, n, a column for each share): the number of values of each group and its percentiles, interpolated as ``percentile`` does.

    Null values do not count, and a group that has no others is not there. Keys
    may be null; without keys all rows are one group.
    """
    infinite = F.lit(float("inf"))
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    places = [p for s in shares.values() for p in (max(s - 2 / ACCURACY, 0.0), min(s + 2 / ACCURACY, 1.0))]
    sketch = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", places, ACCURACY).alias("_q"))
    whole = F.flatten(F.array_repeat(F.array(-infinite, infinite), len(shares)))
    sketch = stored(sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", F.when(F.col("_n") <= SMALL, whole).otherwise(F.col("_q")).alias("_b")), "sketch")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    few = F.broadcast(sketch) if sketch.count() <= BROADCAST_GROUPS else sketch
    bounded = known.join(few, same) if keys else known.crossJoin(few)  # one row of bounds

    inside = reduce(lambda a, b: a | b, [F.col("_v").between(F.col("_b")[2 * i], F.col("_b")[2 * i + 1]) for i in range(len(shares))])
    passed = F.coalesce(F.array_max(F.filter("_b", lambda b: b <= F.col("_v"))), -infinite)
    steps = bounded.select(*keys, "_n", F.when(inside, F.col("_v")).otherwise(passed).alias("_at"), (~inside).alias("_between"))
    steps = steps.groupBy(*keys, "_n", "_at", "_between").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys, "_n").orderBy("_at", "_between").rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.withColumn("_upto", F.sum("_c").over(w))

    def at(rank):
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank) & ~F.col("_between"), F.col("_at")))

    def share(s: float):
        place = F.lit(s) * (F.col("_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        return F.when(low == high, at(low)).otherwise((high - place) * at(low) + (place - low) * at(high))

    found = stored(placed.groupBy(*keys, "_n").agg(*[share(s).alias(name) for name, s in shares.items()]).withColumnRenamed("_n", "n"), "percentiles")
    missed = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in shares])
    if not found.where(missed).limit(1).count():
        return found
    lost = found.where(missed).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    again = known.join(lost, same, "left_semi") if keys else known
    again = again.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile("_v", F.lit(s)).alias(name) for name, s in shares.items()])
    return found.where(~missed).unionByName(again)


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): the median of each group that has values."""
    return percentiles(rows, keys, value, **{name: 0.5}).drop("n")
