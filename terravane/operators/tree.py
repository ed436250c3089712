"""Nearest neighbours and neighbourhoods by an adaptive tree over the points' counts.

Cells are squares of the projected plane, each split into sixteen while it holds
more than ``LEAF`` spots; a spot is a place, with all points that share it, and
the last cell of its path. Searches start with all query spots at once and go
down one level in each round: a join of what is still open with its children.
No pair of points is formed but for spots at the edge of what is asked for, so
that a dense town or a spot that holds a third of all points costs no squares.
Coordinates are in degrees; rows without one take part in nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators.order import bucketed
from terravane.sources.shared import stored

#: Side of the cells of level 0 in km; each level's is a quarter of the one above.
SIDE = 4096.0
#: The finest cells, four metres wide; spots themselves are one level below.
FINEST = 10
SPOT = FINEST + 1
#: Most spots of a cell that is not split.
LEAF = 64
#: Distances to cells are believed to this many km.
SLACK = 1e-6

_CELL, _AT = ["level", "cx", "cy"], ["sx", "sy"]


def _spots(points: DataFrame) -> DataFrame:
    known = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng"))
    return known.withColumns({"_x": C.east_km(F.col("lng").cast("double")) + 0.0, "_y": C.north_km(F.col("lat").cast("double")) + 0.0})


def _query_spots(queries: DataFrame) -> DataFrame:
    return _spots(queries.select("lat", "lng")).select(F.col("_x").alias("sx"), F.col("_y").alias("sy")).distinct()


def _paths(spots: DataFrame, first: int) -> DataFrame:
    """(_x, _y, path): the cells that hold each spot, from level ``first`` to the first that is not split, then the spot."""
    fine = SIDE / 4**FINEST
    cell = lambda c, level: F.floor(F.col(c) / (F.lit(4.0) ** (FINEST - level)))
    placed = spots.withColumns({"fx": F.floor(F.col("_x") / fine), "fy": F.floor(F.col("_y") / fine)})
    cells = placed.groupBy("fx", "fy").agg(F.count("*").alias("c")).withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(FINEST))))
    cells = cells.withColumns({"cx": cell("fx", F.col("level")), "cy": cell("fy", F.col("level"))})
    whole = cells.groupBy(*_CELL).agg(F.sum("c").alias("c")).where((F.col("c") <= LEAF) | (F.col("level") == FINEST)).select(*_CELL)
    homes = cells.join(whole, _CELL).groupBy("fx", "fy").agg(F.min("level").alias("home"))
    step = lambda level, x, y: F.struct(level.cast("int").alias("level"), x.cast("double").alias("cx"), y.cast("double").alias("cy"))
    above = F.transform(F.sequence(F.lit(first), F.col("home")), lambda level: step(level, cell("fx", level), cell("fy", level)))
    return placed.join(homes, ["fx", "fy"]).select(*spots.columns, F.concat(above, F.array(step(F.lit(SPOT), F.col("_x"), F.col("_y")))).alias("path"))


def _nodes(paths: DataFrame, first: int) -> DataFrame:
    """(level, cx, cy, plevel, px, py, n): cells, the cells above them, and their points; above level ``first`` is one root."""
    root = F.struct(F.lit(first - 1).alias("level"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    steps = paths.select("n", F.explode(F.arrays_zip(F.col("path").alias("own"), F.concat(F.array(root), F.slice("path", 1, F.size("path") - 1)).alias("above"))).alias("s"))
    flat = steps.select("n", *[F.col(f"s.own.{c}").alias(c) for c in _CELL], *[F.col(f"s.above.{c}").alias(p) for c, p in zip(_CELL, ("plevel", "px", "py"))])
    return stored(flat.groupBy(*_CELL, "plevel", "px", "py").agg(F.sum("n").alias("n")), "cells")


def _top(spots: DataFrame) -> int:
    """The finest level at which all spots lie in 16 cells at most, no more than one cell has below it."""
    lo_x, hi_x, lo_y, hi_y = spots.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if lo_x is None:
        return 0
    fits = [lv for lv in range(FINEST) if math.prod(math.floor(hi / (SIDE / 4**lv)) - math.floor(lo / (SIDE / 4**lv)) + 1 for lo, hi in ((lo_x, hi_x), (lo_y, hi_y))) <= 16]
    return max(fits, default=0)


def _measured(cells: DataFrame) -> DataFrame:
    """Add the distances from a spot to the nearest and to the farthest place of a cell."""
    side = F.lit(SIDE) / F.lit(4.0) ** F.col("level")
    spot = F.col("level") == SPOT

    def ends(c: str, s: str):
        low, high = F.col(c) * side - F.col(s), (F.col(c) + 1) * side - F.col(s)
        off = F.abs(F.col(s) - F.col(c))
        return F.when(spot, off).otherwise(F.greatest(low, -high, F.lit(0.0))), F.when(spot, off).otherwise(F.greatest(F.abs(low), F.abs(high)))

    (nx, fx), (ny, fy) = ends("cx", "sx"), ends("cy", "sy")
    return cells.withColumns({"near": F.sqrt(nx * nx + ny * ny), "far": F.sqrt(fx * fx + fy * fy)})


def _below(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    under = nodes.select(*[F.col(c).alias(f"_{c}") for c in _CELL], "n", F.col("plevel").alias("level"), F.col("px").alias("cx"), F.col("py").alias("cy"))
    return cells.select(*_AT, *_CELL).join(under, _CELL).select(*_AT, *[F.col(f"_{c}").alias(c) for c in _CELL], "n")


def nearest(queries: DataFrame, points: DataFrame, key: str, k: int, drop_self: bool = True) -> DataFrame:
    """(key, neighbour, km, rank): the k nearest points of each query by projected distance, ties by key; fewer where there are no more.

    A cell stays open while its nearest place is not beyond the distance within
    which other cells hold k points for certain. With ``drop_self`` points of the
    query's own key are left out, of which there is one at most.
    """
    want = k + int(drop_self)
    rows = _spots(points.select(key, "lat", "lng")).select(F.col(key).alias("neighbour"), "_x", "_y")
    # of a spot only its first keys can be asked for; the limit is applied before rows are shuffled
    nth = F.row_number().over(Window.partitionBy("_x", "_y").orderBy("neighbour"))
    rows = stored(rows.withColumn("_nth", nth).where(F.col("_nth") <= want).drop("_nth"), "spots")
    spots = rows.groupBy("_x", "_y").agg(F.count("*").alias("n"))
    first = _top(spots)
    nodes = _nodes(_paths(spots, first), first)
    depth = nodes.where(F.col("level") < SPOT).agg(F.max("level")).first()[0] or first
    cells = _query_spots(queries).select(*_AT, F.lit(first - 1).alias("level"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0).cast("long").alias("n"))
    by = Window.partitionBy(*_AT)
    for level in range(first, depth + 2):
        found = _measured(_below(cells.where(F.col("level") < SPOT), nodes).unionByName(cells.where(F.col("level") == SPOT)))
        found = found.withColumn("_upto", F.sum("n").over(by.orderBy("far").rangeBetween(Window.unboundedPreceding, 0)))
        found = found.withColumn("_most", F.min(F.when(F.col("_upto") >= want, F.col("far"))).over(by))
        cells = found.where(F.col("_most").isNull() | (F.col("near") <= F.col("_most") + SLACK)).select(*_AT, *_CELL, "n")
        if (level - first) % 3 == 2:
            cells = stored(cells, "open")
    hits = cells.select(*_AT, F.col("cx").alias("_x"), F.col("cy").alias("_y")).join(rows, ["_x", "_y"])
    dx, dy = F.col("sx") - F.col("_x"), F.col("sy") - F.col("_y")
    order = [F.round("km", 9), F.col("neighbour")]
    first = F.row_number().over(by.orderBy(*order))
    hits = hits.select(*_AT, "neighbour", F.sqrt(dx * dx + dy * dy).alias("km")).withColumn("_nth", first).where(F.col("_nth") <= want).drop("_nth")
    out = _spots(queries.select(key, "lat", "lng")).select(key, F.col("_x").alias("sx"), F.col("_y").alias("sy")).join(hits, _AT)
    if drop_self:
        out = out.where(F.col(key) != F.col("neighbour"))
    ranked = out.select(key, "neighbour", "km").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _first(radius_km: float) -> int:
    """The level whose cells are at most twice the radius wide."""
    return min(FINEST, max(0, math.ceil(math.log(SIDE / (2 * radius_km), 4))))


def _covered(spots: DataFrame, nodes: DataFrame, radius_km: float) -> DataFrame:
    """(sx, sy, level, cx, cy, n): the largest cells, and the spots, that lie wholly within the radius of each query spot."""
    first = _first(radius_km)
    side = SIDE / 4**first
    reach = math.ceil(radius_km / side)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    start = spots.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    start = start.select(*_AT, F.lit(first).alias("level"), *[(F.floor(F.col(s) / side) + F.col(d)).cast("double").alias(c) for s, d, c in (("sx", "_dx", "cx"), ("sy", "_dy", "cy"))])
    cells, parts = start.join(nodes.select(*_CELL, "n"), _CELL), []
    # a spot's distance is exact, a cell's is believed with some slack
    slack = F.when(F.col("level") == SPOT, 0.0).otherwise(SLACK)
    while True:
        found = _measured(cells).where(F.col("near") <= radius_km + slack).withColumn("_whole", F.col("far") <= radius_km - slack)
        found = stored(found.where((F.col("level") < SPOT) | F.col("_whole")).select(*_AT, *_CELL, "n", "_whole"), "covered")
        parts.append(found.where("_whole").drop("_whole"))
        split = found.where(~F.col("_whole"))
        if not split.limit(1).count():
            break
        cells = _below(split, nodes)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts(queries: DataFrame, points: DataFrame, radius_km: float) -> DataFrame:
    """(lat, lng, n): the points within the radius of each distinct place of the queries, where there are any."""
    spots = _spots(points.select("lat", "lng")).groupBy("_x", "_y").agg(F.count("*").alias("n"))
    first = _first(radius_km)
    n = _covered(_query_spots(queries), _nodes(_paths(spots, first), first), radius_km).groupBy(*_AT).agg(F.sum("n").alias("n"))
    at = _spots(queries.select("lat", "lng").distinct()).select("lat", "lng", F.col("_x").alias("sx"), F.col("_y").alias("sy"))
    return at.join(n, _AT).select("lat", "lng", "n")


def neighbourhood_median(queries: DataFrame, points: DataFrame, key: str, value: str, radius_km: float, other_than_self: bool = True) -> DataFrame:
    """(key, n, median): points around each query and the exact median of their values, for queries that have any.

    Counts by range of values tell in which range a spot's middle lies, and only
    the values of that range are then put in order. The three middle values of a
    spot give the median of each query there, its own point left out. Null
    values count as points but not in the median; with ``other_than_self`` keys
    of points do not repeat, and rows without a key take part in nothing.
    """
    if other_than_self:
        queries, points = queries.where(F.col(key).isNotNull()), points.where(F.col(key).isNotNull())
    first = _first(radius_km)
    placed = _spots(points.select("lat", "lng", F.col(value).cast("double").alias("_v")))
    counted = stored(placed.groupBy("_x", "_y", "_v").agg(F.count("*").alias("n")), "values")
    paths = stored(_paths(counted.groupBy("_x", "_y").agg(F.sum("n").alias("n")), first), "paths")
    nodes = _nodes(paths, first)
    inside = stored(_covered(_query_spots(queries), nodes, radius_km), "inside")

    ranged = bucketed(counted.where(F.col("_v").isNotNull()), "_v", "bucket", 256)
    within = ranged.join(paths.select("_x", "_y", "path"), ["_x", "_y"]).select("bucket", "_v", "n", F.inline("path"))
    within = stored(within.groupBy(*_CELL, "bucket", "_v").agg(F.sum("n").alias("c")), "ranges")
    sums = inside.drop("n").join(within.groupBy(*_CELL, "bucket").agg(F.sum("c").alias("c")), _CELL).groupBy(*_AT, "bucket").agg(F.sum("c").alias("c"))
    by = Window.partitionBy(*_AT)
    sums = sums.withColumns({"_m": F.sum("c").over(by), "_upto": F.sum("c").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    low = F.greatest(F.floor((F.col("_m") - 2) / 2), F.lit(0))
    middle = sums.withColumn("_low", low).where((F.col("_upto") > F.col("_low")) & (F.col("_upto") - F.col("c") <= F.floor((F.col("_m") + 1) / 2)))
    middle = middle.select(*_AT, "bucket", "_m", "_low", (F.col("_upto") - F.col("c")).alias("_before"))
    values = inside.drop("n").join(middle, _AT).join(within, [*_CELL, "bucket"]).groupBy(*_AT, "_m", "_low", "_before", "_v").agg(F.sum("c").alias("c"))
    upto = F.min("_before").over(by) + F.sum("c").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("_upto", upto)
    nth = lambda i: F.max(F.when((F.col("_upto") > F.col("_low") + i) & (F.col("_upto") - F.col("c") <= F.col("_low") + i), F.col("_v")))
    found = values.groupBy(*_AT, "_m", "_low").agg(F.array(*[nth(i) for i in range(3)]).alias("_mid"))
    spots = inside.groupBy(*_AT).agg(F.sum("n").alias("n")).join(found, _AT, "left")

    asked = _spots(queries.select(key, "lat", "lng")).select(key, F.col("_x").alias("sx"), F.col("_y").alias("sy"))
    if other_than_self:
        own = _spots(points.select(key, "lat", "lng", F.col(value).cast("double").alias("_own"))).select(key, "_x", "_y", "_own")
        dx, dy = F.col("sx") - F.col("_x"), F.col("sy") - F.col("_y")
        asked = asked.join(own, key, "left").withColumn("_self", F.coalesce(F.sqrt(dx * dx + dy * dy) <= radius_km, F.lit(False)))
        asked = asked.withColumn("_own", F.when(F.col("_self"), F.col("_own"))).drop("_x", "_y")
    else:
        asked = asked.withColumns({"_self": F.lit(False), "_own": F.lit(None).cast("double")})
    out = asked.join(spots, _AT).withColumns({"n": F.col("n") - F.col("_self").cast("int"), "_left": F.col("_m") - F.col("_own").isNotNull().cast("int")})

    def at(place):
        here = F.get("_mid", (place - F.col("_low")).cast("int"))
        return F.when(F.col("_own").isNull() | (here < F.col("_own")), here).otherwise(F.get("_mid", (place - F.col("_low") + 1).cast("int")))

    half = (at(F.floor((F.col("_left") - 1) / 2)) + at(F.floor(F.col("_left") / 2))) / 2
    return out.where(F.col("n") > 0).select(key, "n", F.when(F.col("_left") > 0, half).alias("median"))
