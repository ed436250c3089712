"""Document fingerprints by winnowing.

A text's rolling hashes of ``K`` code points are cut into windows of ``WINDOW``
consecutive hashes, and the smallest hash of each window is kept with its
position, the rightmost of equal ones. Any passage of ``K + WINDOW - 1`` code
points that two texts share therefore leaves a common hash in both. Short texts
have smaller windows, an eighth of their hashes but four at least (which keeps
all that a larger window would keep), and under ``4 * K`` code points shorter
grams, a quarter of the text.

A fingerprint is a string of 16 hexadecimal digits for each kept hash: 8 for
the hash, 8 for its position. The likeness of two fingerprints is twice the
number of different hashes in both over the sum of their numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import limit_batches, tidied

K, WINDOW = 20, 100
#: Most ranges of ids; the driver holds one number for each.
MAX_RANGES = 4096
_BEFORE = 0x110000
_ROUNDS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_S, _LOW, _HIGH = np.uint64(29), np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive codes; spans double until k is put together."""
    span, size, level = (codes.astype(np.uint64) + np.uint64(1)) * _ROUNDS[5], 1, 0
    out, done = None, 0
    while True:
        if k & size:
            n = len(codes) - (done + size) + 1
            part = span[done : done + n]
            out = part if out is None else (out[:n] ^ (out[:n] >> _S)) * _ROUNDS[4] + part
            done += size
        if done == k:
            return out
        span = (span[:-size] ^ (span[:-size] >> _S)) * _ROUNDS[level % 4] + span[size:]
        size, level = size * 2, level + 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values; spans double until w is covered."""
    w, size = min(w, len(x)), 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (32 bits) and the positions of their grams' last code points, by position.

    Every code point ends a gram of k: before the text stand k - 1 of a code
    that no text has. So texts of all lengths, short ones too, share the grams
    of what they share.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    hashes = gram_hashes(np.concatenate([np.full(k - 1, _BEFORE, dtype=np.uint32), codes]), k)
    window = max(min(4, window), min(window, len(hashes) // 8))
    # of equal hashes the rightmost is the smallest key
    keys = (hashes & _HIGH) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    least = sliding_min(keys, window)
    kept = least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])]
    return (kept >> np.uint64(32)).astype(np.uint32), (_LOW - (kept & _LOW)).astype(np.uint32)


def as_string(kept: tuple[np.ndarray, np.ndarray]) -> str:
    return np.stack(kept, axis=1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two sorted arrays of different hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _row(doc_id, text: str, seen, following: str, seen_next):
    changed = edited(text, following)
    kept = winnow(changed)
    mine, theirs = np.unique(seen[0]), np.unique(seen_next[0])
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        as_string(seen),
        as_string(kept),
        likeness(mine, np.unique(kept[0])),
        likeness(mine, theirs),
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


@tidied
def _in_order(batches):
    """Rows by range, those of the range first and the one after its end last; each needs only the row behind it."""
    held, out = None, []
    for batch in batches:
        for pid, ahead, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), (t.as_py() or "" for t in batch.column(3)), strict=True):
            if held is None and ahead:
                continue  # the row after the end is known already
            seen = winnow(text)
            if held is not None:
                out.append(_row(*held[1:], text, seen))
            held = None if ahead else (pid, doc_id, text, seen)
            if len(out) >= 256:
                yield _batch(out)
                out = []
    if out:
        yield _batch(out)


@tidied
def _alone(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), (t.as_py() or "" for t in batch.column(1)), strict=True):
            rows.append(_row(doc_id, text, winnow(text), "", winnow("")))
        if rows:
            yield _batch(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited form, whole.

    The next document is that of the next larger id, after the last the first;
    rows that share an id follow each other by text. Null texts count as empty.
    A row with a null id has no place in the order: it has no next document,
    and nothing replaces its last quarter. Very long texts are fingerprinted
    whole, two at a time. Other columns are ignored; an empty table gives an
    empty result.

    Ids are cut into ranges by approximate quantiles. A range gets its own rows
    and the first row of the next range, so texts are shuffled once and each
    task streams through sorted rows, two at a time.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select("doc_id", "text")
    lone = rows.where("doc_id is null").mapInArrow(_alone, SCHEMA)
    ids = rows.where("doc_id is not null")
    n = min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)
    bounds = sorted(set(ids.agg(quantiles.alias("q")).first()["q"] or []))
    pid = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    ranged = ids.withColumn("pid", pid)
    heads = sorted((r["pid"], r["head"]) for r in ranged.groupBy("pid").agg(F.min("doc_id").alias("head")).collect())
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    lookup = F.broadcast(spark.createDataFrame(before, "head long, pid int"))  # MAX_RANGES rows at most
    after = ids.join(lookup, F.col("doc_id") == F.col("head")).select("pid", F.lit(1).alias("ahead"), "doc_id", "text")
    laid = ranged.select("pid", F.lit(0).alias("ahead"), "doc_id", "text").unionByName(after)
    laid = laid.repartition(F.col("pid")).sortWithinPartitions("pid", "ahead", "doc_id", "text")
    return laid.mapInArrow(_in_order, SCHEMA).unionByName(lone)
