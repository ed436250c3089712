"""Embedding near-duplicates by lattice hashing.

In each of ``TABLES`` tables, unit vectors are projected onto ``BLOCKS`` random
8-dimensional spaces and each projection is decoded to the nearest point of the
E8 lattice; the points together are the vector's cell. A vector also looks into
the cells that differ in one block by one of the ``PROBES`` next nearest of the
240 neighbouring points. Two vectors are compared where one's own cell is among
the other's cells, and linked if their cosine is 0.9 or more.

Exact copies count as one vector. A large bucket first elects a centre, and
vectors within 12.9 degrees of it form a core: any two of them are within 25.8
degrees, so all are linked and no pair has to be looked at. What is left is
compared between cores: two lone vectors by their cosine, larger cores, if their
centres are near enough for any link, member by member in tiles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.common import Scratch, connected_components
from terravane.llm.shingles import mix

TABLES, BLOCKS, PROBES, SCALE = 16, 2, 2, 0.55
#: Vectors are linked from this cosine; those from CORE of one centre are all linked (2 * CORE**2 - 1 > LINK).
LINK, CORE = 0.9, 0.9748
#: Cosine of two centres below which no members of their cores can be linked: 25.85 + 2 * 12.9 degrees.
APART = 0.62
#: Bucket size from which a centre is elected, and vectors in a tile.
CORE_BUCKET, TILE = 16, 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    eye = np.eye(8)
    whole = [s * eye[i] + t * eye[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = np.array(np.meshgrid(*[[0.5, -0.5]] * 8)).reshape(8, -1).T
    return np.concatenate([np.array(whole), signs[(signs < 0).sum(axis=1) % 2 == 0]])


ROOTS = _roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest whole-numbered points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer of the best even-sum point and the best one shifted by halves."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """For each vector and table its own cell's key, then those of the cells that it looks into."""
    dim = unit.shape[1]
    rng = np.random.default_rng(800 + dim)
    out = np.empty((len(unit), tables, 1 + blocks * probes), np.uint64)
    weights = rng.integers(1, 1 << 63, (tables, blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = rng.integers(1, 1 << 63, tables, dtype=np.uint64)
    for t in range(tables):
        projected = unit @ rng.normal(size=(dim, 8 * blocks)) * scale + rng.random(8 * blocks) * 2
        own, near = [], []
        for b in range(blocks):
            x = projected[:, 8 * b : 8 * b + 8]
            point = decode(x)
            best = np.argsort(-((x - point) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
            as_key = lambda p, b=b: ((2 * p).astype(np.int64).astype(np.uint64) * weights[t, b]).sum(axis=-1, dtype=np.uint64)
            own.append(as_key(point))
            near.append(as_key(point[:, None] + ROOTS[best]))
        total = np.sum(own, axis=0, dtype=np.uint64)
        out[:, t, 0] = total
        for b in range(blocks):
            out[:, t, 1 + b * probes : 1 + (b + 1) * probes] = total[:, None] - own[b][:, None] + near[b]
        out[:, t] = mix(out[:, t] + salts[t])
    return out.reshape(len(unit), -1)


def _coded(batches):
    """Class (128 bits of the bytes; null if not to be linked), bytes and cell keys of each vector."""
    for batch in batches:
        column = batch.column(1)
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        cls, raw, keys = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
        by_dim: dict[int, list[int]] = {}
        rows = {}
        for i, v in enumerate(column):
            if not v.is_valid or not len(v) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(kind)
            if np.isfinite(x).all() and x.any():
                rows[i] = x
                by_dim.setdefault(len(x), []).append(i)
        for at in by_dim.values():
            x = np.array([rows[i] for i in at], dtype=np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            found = cells(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
            for i, k in zip(at, found, strict=True):
                raw[i] = rows[i].tobytes()
                cls[i] = hashlib.blake2b(raw[i], digest_size=16).digest()
                keys[i] = k
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "cls", "vec", "keys"])


def _cosines(a: list[bytes], b: list[bytes], kind) -> np.ndarray:
    """Cosines in double precision, pair by pair; -1 for vectors of different lengths."""
    out = np.full(len(a), -1.0)
    same = np.flatnonzero([len(x) == len(y) for x, y in zip(a, b, strict=True)])
    for size in {len(a[i]) for i in same}:
        at = np.array([i for i in same if len(a[i]) == size])
        x, y = (np.frombuffer(b"".join(v[i] for i in at), kind).reshape(len(at), -1).astype(np.float64) for v in (a, b))
        out[at] = np.einsum("ij,ij->i", _unit(x), _unit(y))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _with_cosine(pairs: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """Pairs (a, b, ...) with their cosine."""
    left, right = (vectors.select(F.col("cls").alias(x), F.col("vec").alias(f"v_{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").select(*pairs.columns, "v_a", "v_b")
    schema = T.StructType([*pairs.schema.fields, T.StructField("cosine", T.DoubleType())])

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 2
            found = _cosines(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found)], names=[*batch.schema.names[:n], "cosine"])

    return joined.mapInArrow(run, schema)


def _tiles(kind: str):
    """Links between two blocks of members: each member's weight of links, and whether there is any."""

    def run(batches):
        for batch in batches:
            cls, weight, a_out, b_out = [], [], [], []
            for a, b, left, right in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x, y = (_unit(np.frombuffer(b"".join(m["vec"] for m in side), kind).reshape(len(side), -1).astype(np.float64)) for side in (left, right))
                if x.shape[1] != y.shape[1]:
                    continue
                near = x @ y.T >= LINK
                if near.any():
                    for side, sums in ((left, near @ np.array([m["m"] for m in right])), (right, near.T @ np.array([m["m"] for m in left]))):
                        cls += [m["cls"] for m in side]
                        weight += sums.tolist()
                    a_out += [a] * (len(left) + len(right))
                    b_out += [b] * (len(left) + len(right))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((cls, weight, a_out, b_out), kinds, strict=True)], names=["cls", "weight", "a", "b"])

    return run


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``embeddings`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components,
    and vectors of different lengths, are linked with nothing. Repeated rows
    are links of each other, with the same id or not. A cosine of just 0.9 is a
    link. A null id is a component's id only if all ids in it are null. Vectors
    of any length are compared whole. Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    scratch = Scratch(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "embedding")
    kind = "<f4" if rows.schema["embedding"].dataType == T.ArrayType(T.FloatType(), rows.schema["embedding"].dataType.containsNull) else "<f8"
    coded = scratch.keep(rows.mapInArrow(_coded, "vec_id long, cls binary, vec binary, keys array<long>"), "coded")
    classes = coded.where("cls is not null").groupBy("cls").agg(F.count("*").alias("m"), F.min("vec_id").alias("vec_id"), F.first("vec").alias("vec"), F.first("keys").alias("keys"))
    classes = scratch.keep(classes, "classes")
    spread = classes.select("cls", F.posexplode("keys").alias("pos", "key")).select("cls", "key", (F.col("pos") % (1 + BLOCKS * PROBES) == 0).alias("home"))
    spread = spread.groupBy("cls", "key").agg(F.max("home").alias("home"))
    counts = spread.groupBy("key").agg(F.count("*").alias("c"), F.max("home").alias("any_home")).where("c > 1 and any_home").select("key", "c")
    shared = scratch.keep(spread.join(counts, "key"), "shared")
    cores = scratch.keep(_cores(classes, shared, kind), "cores")
    sizes = cores.groupBy("leader").agg(F.count("*").alias("n"), F.sum("m").alias("weight"))
    sizes = scratch.keep(sizes, "sizes")
    held = shared.join(cores.select("cls", "leader"), "cls").groupBy("key", "leader").agg(F.max("home").alias("home"))
    a, b = (held.select("key", F.col("leader").alias(x), F.col("home").alias(f"home_{x}")) for x in "ab")
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("home_a") | F.col("home_b"))).select("a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(sizes.select(F.col("leader").alias(x), F.col("n").alias(f"n_{x}"), F.col("weight").alias(f"w_{x}")), x)
    lone = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    near = scratch.keep(_with_cosine(pairs, classes, kind).where(F.col("cosine") >= F.when(lone, LINK).otherwise(APART)), "near")
    single = near.where(lone)
    tiled = scratch.keep(_tile_links(cores, classes, near.where(~lone), sizes, kind), "tiled")
    edges = single.select("a", "b").unionByName(tiled.select("a", "b").distinct())
    extra = single.select(F.col("a").alias("cls"), F.col("w_b").alias("weight")).unionByName(single.select(F.col("b").alias("cls"), F.col("w_a").alias("weight")))
    extra = extra.unionByName(tiled.select("cls", "weight")).groupBy("cls").agg(F.sum("weight").alias("extra"))
    merged = connected_components(edges, scratch).withColumnRenamed("id", "leader")
    members = cores.join(merged, "leader", "left").select("cls", "leader", "vec_id", F.coalesce("component", "leader").alias("component"))
    least = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = members.join(least, "component").join(sizes, "leader").join(extra, "cls", "left")
    named = named.select(F.col("cls").alias("_cls"), "component_id", (F.col("weight") - 1 + F.coalesce("extra", F.lit(0))).alias("n_links"))
    out = coded.select("vec_id", "cls").join(named, F.col("cls") == F.col("_cls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _cores(classes: DataFrame, shared: DataFrame, kind: str) -> DataFrame:
    """cls, m, vec_id and leader: the centre of the core that a class belongs to, itself if it is alone or a centre."""
    large = shared.where(F.col("c") >= CORE_BUCKET)
    popular = large.groupBy("cls").agg(F.sum("c").alias("popular"))
    ranked = large.join(popular, "cls")
    centres = ranked.where("home").groupBy("key").agg(F.max(F.struct("popular", "cls")).alias("top"))
    stars = ranked.join(centres, "key").where(F.struct("popular", "cls") < F.col("top"))
    stars = stars.select(F.col("top.cls").alias("a"), F.col("cls").alias("b"), F.col("top.popular").alias("rank")).distinct()
    close = _with_cosine(stars, classes, kind).where(F.col("cosine") >= CORE)
    chosen = close.groupBy("b").agg(F.max(F.struct("rank", "a")).alias("best")).select(F.col("b").alias("cls"), F.col("best.a").alias("leader"))
    # a centre that follows another is none
    valid = chosen.join(chosen.select(F.col("cls").alias("leader")), "leader", "left_anti")
    return classes.select("cls", "m", "vec_id").join(valid, "cls", "left").select("cls", "m", "vec_id", F.coalesce("leader", "cls").alias("leader"))


def _tile_links(cores: DataFrame, classes: DataFrame, near: DataFrame, sizes: DataFrame, kind: str) -> DataFrame:
    """(cls, weight, a, b): links of members of near cores, compared in tiles of about TILE by TILE."""
    wanted = near.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    members = cores.join(wanted, "leader", "left_semi").join(sizes.select("leader", "n"), "leader").join(classes.select("cls", "vec"), "cls")
    members = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / TILE)))
    blocks = members.groupBy("leader", "block").agg(F.collect_list(F.struct("cls", "m", "vec")).alias("members"))
    left, right = (blocks.select(F.col("leader").alias(x), F.col("members").alias(f"m_{x}")) for x in "ab")
    tiles = near.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "m_a", "m_b")
    return tiles.mapInArrow(_tiles(kind), "cls binary, weight long, a binary, b binary")
