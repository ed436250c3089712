"""MinHash near-duplicates by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so ``PERMUTATIONS`` evaluations make twice as many values, and
the share of agreeing values is an unbiased estimate of the Jaccard similarity.
Bands of a few values are hashed, 21 of 6 for a similarity of 0.85 and 25 of 5
for 0.8; a pair at that similarity shares no band with a probability of 5e-5.

Texts with equal shingle sets are one node of a graph. In each band bucket one
node is the centre, the one that shares most buckets, and the others are
compared with it only, so a bucket of thousands costs thousands of comparisons.
Where that leaves a bucket with nodes of several components, the rest is found
by an exact prefix filter on their shingle sets: two sets of the wanted
similarity share one of their few rarest shingles, and positions in that order
bound what they can share. Only pairs of different components are compared
there, so no link that joins two components of a bucket is lost and no group is
expanded into all its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from terravane.llm.common import Scratch, columns, connected_components, free_name, text_id, tidied
from terravane.llm.shingles import chunks, mix, shingle_sets

PERMUTATIONS = 64
#: Similarity in percent from which texts are linked, unless another is given.
PERCENT = 85
#: Most of the pairs at that similarity that share no band.
MISSED = 5e-5
#: Most ids that are broadcast to pick texts (16 bytes each); above, texts are shuffled by id.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(64)
_MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_FOLD = np.uint64(0xA0761D6478BD642F)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima and maxima, permutation by permutation, for each non-empty set."""
    values = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        x = (values ^ _XOR[p]) * _MULTIPLY[p]
        out[:, 2 * p] = np.minimum.reduceat(x, at)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, at)
    return out


def banding(percent: int) -> tuple[int, int]:
    """Number of bands and their values: the longest bands that miss few pairs, or bands of one value."""
    for rows in range(2 * PERMUTATIONS, 1, -1):
        n = 2 * PERMUTATIONS // rows
        if (1 - (percent / 100) ** rows) ** n <= MISSED:
            return n, rows
    return 2 * PERMUTATIONS, 1


def bands(signature: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    n, rows = banding(percent)
    out = np.empty((len(signature), n), np.uint64)
    for b in range(n):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * _FOLD + signature[:, b + r * n])
        out[:, b] = h
    return out


def _set_id(s: np.ndarray) -> bytes | None:
    """128 bits of a set of shingles, by which equal sets are known; None for an empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


SIGNED = "doc_id long, node binary, n_shingles long, bands array<long>, th binary"


def _sign(percent: int):
    """The function for mapInArrow that signs rows for links at ``percent``."""

    @tidied
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                full = [s for s in sets if len(s)]
                keys = iter(bands(signatures(full), percent).astype(np.int64) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([_set_id(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        batch.column(2)[a:b],
                    ],
                    names=["doc_id", "node", "n_shingles", "bands", "th"],
                )

    return run


@tidied
def _sets(batches):
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(1)):
            sets = [s for s in shingle_sets(data, offsets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"]
            )


def text_hash() -> Column:
    """The 128 bits that a row's text is known by; null counts as empty."""
    return text_id(F.coalesce(F.col("text"), F.lit("")))


def pick(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with a table of ids, of text hashes or of both (columns id, th); broadcast only if few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    names = {c: free_name(docs, f"_{c}") for c in ids.columns}
    ids = ids.withColumnsRenamed(names)
    by = {"id": lambda c: F.col("doc_id").eqNullSafe(F.col(c)), "th": lambda c: text_hash() == F.col(c)}
    return docs.join(F.broadcast(ids) if few else ids, [by[c](name) for c, name in names.items()], how)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("n"), (F.size("s_a") + F.size("s_b")).alias("total"))
    return both.where((100 + percent) * F.col("n") >= percent * F.col("total")).select("a", "b")


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _placed(docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, node of the component (null without shingles) and component_id for each row."""
    rows = docs.select("doc_id", "text", text_hash().alias("th"))
    signed = scratch.keep(rows.mapInArrow(_sign(percent), SIGNED), "signed")
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = scratch.keep(nodes, "nodes")
    spread = nodes.select("node", "doc_id", "n", F.explode("bands").alias("key"))
    counts = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = scratch.keep(spread.join(counts, "key"), "shared")
    popular = shared.groupBy("node").agg(F.sum("c").alias("popular"))
    ranked = shared.join(popular, "node")
    centres = ranked.groupBy("key").agg(F.max(F.struct("popular", "node", "n")).alias("top"))
    stars = shared.select("key", F.col("node").alias("b"), "n").join(centres.select("key", F.col("top.node").alias("a"), F.col("top.n").alias("m")), "key")
    stars = stars.where((F.col("a") != F.col("b")) & _sizes_fit("n", "m", percent)).select("a", "b").distinct()
    sets = scratch.keep(
        pick(rows, shared.select(F.col("doc_id").alias("id")).distinct(), "left_semi").mapInArrow(_sets, "node binary, shingles array<long>").dropDuplicates(["node"]), "sets"
    )
    links = scratch.keep(_confirm(stars, sets, percent), "links")
    first = connected_components(links, scratch)
    placed = shared.join(first.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    placed = scratch.keep(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_nodes = placed.join(mixed, "key", "left_semi").select("node", "n", "component").distinct()
    pairs = scratch.keep(_prefix_pairs(scratch, open_nodes, sets, percent), "pairs")
    more = scratch.keep(_confirm(pairs, sets, percent), "more")
    scratch.drop(pairs)
    merged = connected_components(links.union(more), scratch).withColumnRenamed("id", "node")
    scratch.drop(shared, sets, links, placed, more)
    members = nodes.select("node", "doc_id").join(merged, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = members.join(least, "component").select(F.col("node").alias("_node"), "component", "component_id")
    out = signed.select("doc_id", "th", "node", "n_shingles").join(named, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "th", "n_shingles", "component", "component_id")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing;
    their component is their own id. Rows that repeat an id are each returned,
    judged by their own text. A null id is never a component's id unless all of
    its ids are null; such rows are kept. Very long texts are compared whole,
    by all their shingles. Other columns are ignored; an empty table gives an
    empty result.
    """
    out = _placed(docs, Scratch(docs.sparkSession), percent)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _prefix_pairs(scratch: Scratch, open_nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that may still be similar enough.

    Shingles are ordered from rare to frequent; both sets have a common shingle
    among their first n - ceil(percent n / 100) + 1, and what follows the positions of
    the first common one bounds the rest of the overlap.
    """
    spread = scratch.keep(open_nodes.join(sets, "node").select("node", "n", "component", F.explode("shingles").alias("h")), "open")
    known = spread.groupBy("h").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "h"))
    need = F.ceil(F.col("n") * percent / 100)
    prefix = spread.join(known, "h").withColumn("i", place).where((F.col("i") <= F.col("n") - need + 1) & (F.col("df") > 1))
    prefix = scratch.keep(prefix.select("h", "node", "n", "component", "i"), "prefix")
    a, b = (prefix.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "i")]) for x in "ab")
    most = 1 + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & _sizes_fit("n_a", "n_b", percent)
    fits = fits & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    return a.join(b, "h").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: of each component the one with its smallest id, null ids last.

    Of rows that share that id the smallest hash of the text decides, then that
    of the whole row but for its maps. Null, empty and blank texts have no shingles and all
    stay. Very long texts are compared whole; other columns stay, whatever
    their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    placed = _placed(docs, scratch, percent).where("n_shingles > 0").groupBy("component", F.col("doc_id").alias("id"), "th").agg(F.count("*").alias("c"))
    placed = scratch.keep(placed, "placed")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    first = placed.groupBy(F.col("component").alias("_component")).agg(F.min(order).alias("top"))
    top = first.select("_component", F.col("top.id").alias("_id"), F.col("top.th").alias("_th"))
    chosen = (F.col("component") == F.col("_component")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    gone = scratch.keep(placed.join(top, chosen, "left_anti").select("id", "th"), "gone")
    kept = placed.where("c > 1").join(top, chosen, "left_semi")
    again = scratch.keep(kept.select("id", "th"), "again")
    out = pick(docs, gone, "left_anti")
    if again.limit(1).count():
        # copies of a kept row down to its id and text; maps have no hash, rows that differ only there are equally good
        row, plain = F.struct(*columns(docs)), [c for c, f in zip(columns(docs), docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
        th, one = free_name(docs, "_th"), free_name(docs, "_row")
        firsts = pick(out, again, "left_semi").groupBy("doc_id", text_hash().alias(th)).agg(F.min_by(row, F.xxhash64(*plain)).alias(one)).select(f"{one}.*")
        out = pick(out, again, "left_anti").unionByName(firsts)
    return out.select(*columns(docs))
