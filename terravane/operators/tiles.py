"""Neighbourhoods compared in tiles: each tile's queries meet the points in and around it in one task, which forms no rows of pairs.

A tile is a square of cells of one radius; points go to every tile that they
are at most a cell away from. Cells are counted first: tiles are made wide
where points are sparse, and the queries of a tile that has much to compare are
dealt to several tasks. Coordinates are in degrees; rows without one, or with
one that is no number, take part in nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.sources.shared import stored

#: Points that a tile should hold, most points in and around one for which tasks compare all, and the pairs that one task compares.
POINTS, MOST, WORK = 12_000, 1_000_000, 1_000_000_000

_TILE = ["_tx", "_ty"]


def located(rows: DataFrame) -> DataFrame:
    """Rows that have a place, with ``_x`` and ``_y`` in kilometres."""
    known = rows.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng"))
    return known.withColumns({"_x": C.east_km(F.col("lng").cast("double")) + 0.0, "_y": C.north_km(F.col("lat").cast("double")) + 0.0})


def _cells(rows: DataFrame, side: float) -> DataFrame:
    return rows.withColumns({"_cx": F.floor(F.col("_x") / F.lit(side)), "_cy": F.floor(F.col("_y") / F.lit(side))})


class Tiles:
    """Queries and points of one radius dealt to tiles, with what their comparison costs."""

    def __init__(self, queries: DataFrame, points: DataFrame, radius_km: float) -> None:
        # a little wider than the radius, so that rounding puts no point within it two cells away
        self.radius, self.side = radius_km, radius_km * (1 + 1e-9)
        self.queries, self.points = located(queries), located(points)
        one, none = F.lit(1.0), F.lit(0.0)
        both = _cells(self.queries, self.side).select("_cx", "_cy", one.alias("q"), none.alias("p")).unionAll(_cells(self.points, self.side).select("_cx", "_cy", none.alias("q"), one.alias("p")))
        self.cells = stored(both.groupBy("_cx", "_cy").agg(F.sum("q").alias("q"), F.sum("p").alias("p")), "cells")
        self.seen = self.cells.agg(F.try_divide(F.sum(F.col("q") * F.col("p")), F.sum("q"))).first()[0] or 0.0
        """Points of the cell of the mean query."""
        self.wide = max(1, min(64, math.floor(math.sqrt(POINTS / max(self.seen, 1e-9)))))
        asked = self._own(self.cells.where("q > 0")).groupBy(*_TILE).agg(F.sum("q").alias("q"))
        held = self._around(self.cells.where("p > 0")).groupBy(*_TILE).agg(F.sum("p").alias("p"))
        tiles = asked.join(held, _TILE, "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
        self.tiles = stored(tiles.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("p") / WORK))), "tiles")
        self.pairs, self.most = (x or 0.0 for x in self.tiles.agg(F.sum(F.col("q") * F.col("p")), F.max("p")).first())

    def _own(self, cells: DataFrame) -> DataFrame:
        return cells.withColumns({"_tx": F.floor(F.col("_cx") / F.lit(self.wide)), "_ty": F.floor(F.col("_cy") / F.lit(self.wide))})

    def _around(self, cells: DataFrame) -> DataFrame:
        for c, t in (("_cx", "_tx"), ("_cy", "_ty")):
            cells = cells.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - 1) / F.lit(self.wide)), F.floor((F.col(c) + 1) / F.lit(self.wide)))))
        return cells

    def compared(self, asked: list[str], held: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """What ``work`` makes of the queries of each tile (``asked``, _x, _y) and of the points in and around it (``held``, _x, _y)."""
        q = self._own(_cells(self.queries, self.side)).join(self.tiles.select(*_TILE, "_parts"), _TILE)
        q = q.select(*_TILE, F.pmod(F.xxhash64("_x", "_y", *asked), "_parts").alias("_part"), *asked, "_x", "_y")
        p = self._around(_cells(self.points, self.side)).join(self.tiles.select(*_TILE, "_parts"), _TILE)
        # columns of their own, as both sides may come from one table
        p = p.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), *[F.col(c).alias(c) for c in (*_TILE, *held, "_x", "_y")])
        by = [*_TILE, "_part"]
        return q.groupBy(*by).cogroup(p.groupBy(*by)).applyInArrow(work, schema)


def _within(radius: float) -> float:
    """The largest square whose root is not above the radius."""
    top = radius * radius
    while math.sqrt(math.nextafter(top, math.inf)) <= radius:
        top = math.nextafter(top, math.inf)
    while math.sqrt(top) > radius:
        top = math.nextafter(top, 0.0)
    return top


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy().astype(float, copy=False) for n in names]


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are."""
    found = pa.chunked_array([*a.chunks, *b.chunks], type=a.type).combine_chunks().dictionary_encode().indices.to_numpy()
    return found[: len(a)], found[len(a) :]


def squares(q: pa.Table, p: pa.Table, radius: float, most: int = 2**31) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of p in their order, squared distances): queries that lie together, with all points that may be within the radius of any of them, ``most`` at a time."""
    (qx, qy), (px, py) = _numbers(q, "_x", "_y"), _numbers(p, "_x", "_y")
    wide, high = np.ptp(qx), np.ptp(qy)
    side = max(radius / 8, math.sqrt(wide * high * 32 / len(qx)), max(wide, high) / 1000, 1e-9)
    cx, cy = np.floor((qx - qx.min()) / side).astype(np.int64), np.floor((qy - qy.min()) / side).astype(np.int64)
    cell = cx * 2048 + cy
    order = np.argsort(cell, kind="stable")
    reach = radius * (1 + 1e-9)
    for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        x, y = qx[rows], qy[rows]
        dx = np.maximum(np.maximum(x.min() - px, px - x.max()), 0.0)
        dy = np.maximum(np.maximum(y.min() - py, py - y.max()), 0.0)
        near = np.flatnonzero(dx * dx + dy * dy <= reach * reach)
        for part in np.split(near, range(most, len(near), most)):
            nx, ny = px[part], py[part]
            step = max(1, 100_000 // max(1, len(part)))
            for i in range(0, len(rows), step):
                d = x[i : i + step, None] - nx
                d *= d
                e = y[i : i + step, None] - ny
                e *= e
                d += e
                yield rows[i : i + step], part, d


def medians(tiles: Tiles, key: str, value: str | None, other_than_self: bool) -> DataFrame:
    """(key, n, median): for every located query the points within the radius and the median of their values; without ``value`` only their number.

    Null values count as points but not in the median. With ``other_than_self``
    points of the query's own key do not count.
    """
    top, radius = _within(tiles.radius), tiles.radius

    def work(q: pa.Table, p: pa.Table) -> pa.Table:
        n, middle = np.zeros(q.num_rows, np.int64), np.full(q.num_rows, np.nan)
        known = 0
        if value is not None:
            # points in the order of their values, nulls last, so that those within the radius are in order too
            p = p.take(pc.sort_indices(p, sort_keys=[("_v", "ascending")], null_placement="at_end"))
            known, values = p.num_rows - p["_v"].null_count, p["_v"].to_numpy()
        own = _codes(q[key], p[key]) if other_than_self else None
        none = np.ones(q.num_rows, bool)
        for rows, near, d in squares(q, p, radius) if q.num_rows and p.num_rows else ():
            inside = d <= top
            if own:
                inside &= own[1][near] != own[0][rows][:, None]
            n[rows] = np.count_nonzero(inside, axis=1)
            if value is None:
                continue
            upto = int(np.searchsorted(near, known))
            for at, line in zip(rows, inside):
                held = np.flatnonzero(line[:upto])
                m = len(held)
                if m:
                    none[at] = False
                    middle[at] = 0.5 * values[near[held[(m - 1) // 2]]] + 0.5 * values[near[held[m // 2]]]
        return pa.table([q[key], pa.array(n), pa.array(middle, mask=none)], names=[key, "n", "median"])

    kind = tiles.queries.schema[key].dataType.simpleString()
    return tiles.compared([key], [key] * other_than_self + ["_v"] * (value is not None), work, f"`{key}` {kind}, n long, median double")


def nearest(tiles: Tiles, keep: list[str], key: str, k: int, drop_self: bool, value: str | None = None) -> DataFrame:
    """(keep, neighbours, kms, values): for every located query its k nearest points within the radius, ties by key; without ``value`` no values."""
    top, radius = _within(tiles.radius), tiles.radius
    held = [key, *(["_v"] if value else [])]

    def work(q: pa.Table, p: pa.Table) -> pa.Table:
        p = p.take(pc.sort_indices(p, sort_keys=[(key, "ascending")]))
        own = _codes(q[key], p[key]) if drop_self else None
        hits, kms = [np.zeros(0, np.int64)] * q.num_rows, [np.zeros(0)] * q.num_rows
        for rows, near, d in squares(q, p, radius) if q.num_rows and p.num_rows else ():
            off = d > top
            if own:
                off |= own[1][near] == own[0][rows][:, None]
            km = np.sqrt(d)
            # to a billionth, so that equal distances are ties whatever their last digits
            rank = np.rint(km * 1e9)
            rank[off] = np.inf
            if len(near) > 2000 and k < len(near):
                most = np.partition(rank, k - 1, axis=1)[:, k - 1]
                picks = [c[np.argsort(r[c], kind="stable")[:k]] for r, m in zip(rank, most) for c in [np.flatnonzero(r <= m)]]
            else:
                picks = np.argsort(rank, axis=1, kind="stable")[:, :k]
            for at, c, r, s in zip(rows, picks, rank, km):
                c = c[: np.searchsorted(r[c], np.inf)]
                hits[at], kms[at] = near[c], s[c]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hits], dtype=np.int64)]), pa.int32())
        at = pa.array(np.concatenate([np.zeros(0, np.int64), *hits]))
        lists = [p[c].combine_chunks().take(at) for c in held]
        lists.insert(1, pa.array(np.concatenate([np.zeros(0), *kms])))
        return pa.table([*[q[c] for c in keep], *[pa.ListArray.from_arrays(offsets, x) for x in lists]], names=[*keep, *["neighbours", "kms", "values"][: len(lists)]])

    kinds = ", ".join(f"`{c}` {tiles.queries.schema[c].dataType.simpleString()}" for c in keep)
    return tiles.compared(keep, held, work, f"{kinds}, neighbours array<{tiles.points.schema[key].dataType.simpleString()}>, kms array<double>" + (", values array<double>" if value else ""))


def weighted_sums(tiles: Tiles, keep: list[str], terms: dict[str, list[str]], scale: float) -> DataFrame:
    """(keep, n, terms): for every located query the points within the radius, and the sums of products of columns with weights exp(-(km / scale)^2).

    ``terms`` has each product's columns, none for the weights alone. Products
    with a null do not count; a sum of none is null.
    """
    top, radius = _within(tiles.radius), tiles.radius
    held = sorted({c for names in terms.values() for c in names})

    def work(q: pa.Table, p: pa.Table) -> pa.Table:
        n, sums, known = np.zeros(q.num_rows, np.int64), np.zeros((q.num_rows, len(terms))), np.zeros((q.num_rows, len(terms)), bool)
        there = {c: pc.is_valid(p[c]).to_numpy() for c in held}
        given = {c: np.where(there[c], x, 0.0) for c, x in zip(held, _numbers(p, *held))}
        made, valid = np.ones((p.num_rows, len(terms))), np.ones((p.num_rows, len(terms)))
        for i, names in enumerate(terms.values()):
            for c in names:
                made[:, i] *= given[c]
                valid[:, i] *= there[c]
        whole = valid.all()
        for rows, near, d in squares(q, p, radius, 4096) if q.num_rows and p.num_rows else ():
            inside = d <= top
            n[rows] += np.count_nonzero(inside, axis=1)
            d *= -1.0 / scale**2
            w = np.exp(d, out=d)
            w *= inside
            sums[rows] += w @ made[near]
            known[rows] |= n[rows][:, None] > 0 if whole else w @ valid[near] > 0
        return pa.table([*[q[c] for c in keep], pa.array(n), *[pa.array(sums[:, i].copy(), mask=~known[:, i]) for i in range(len(terms))]], names=[*keep, "n", *terms])

    kinds = ", ".join(f"`{c}` {tiles.queries.schema[c].dataType.simpleString()}" for c in keep)
    return tiles.compared(keep, held, work, f"{kinds}, n long, {', '.join(f'`{t}` double' for t in terms)}")
