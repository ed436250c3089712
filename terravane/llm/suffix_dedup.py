"""Exact removal of repeated 200-byte strings with a logarithmic family of suffix arrays.

Sampling. Every 200-byte string of a text is given the smallest hash of its
32-byte grams. Consecutive strings with the same smallest gram form a run, so
a run stands for about 85 suffixes that share an anchor, and equal strings have
equal anchors wherever they are: matches of 200 bytes are never missed though
only the suffixes at anchors are indexed.

Index. A batch of texts becomes the sorted array of the suffixes at its
anchors, ordered by their bytes to a depth of 32, in the buckets of a bucketed
table; suffixes that are equal to that depth are one entry with their number.
The array is merge-scanned against each existing level: both are sorted and in
the same buckets, so a scan is one linear pass without a shuffle, and what has
32 bytes in common is a match to be followed further. Levels of equal size are
merged before the next batch comes in, likewise in one pass, so that n batches
leave at most about log2(n) levels and an entry is rewritten about log2(n)
times. Entries meet by content, never by hash.

Resolution. Only suffixes with a match need their order beyond 32 bytes. Runs
that agree in anchor and content are repeated as a whole. Of the others the
bytes are fetched and all their suffixes are sorted by content, anchor by
anchor, to the depth of 200 (by doubling, dropping what is already unique);
those that are equal there are repeated strings. Blocks of whole anchors are
sorted within a task; an anchor with more runs than a block may hold is
compared in a distributed way, by anchor and hash of each string.

Texts are known by 128 bits of their content. Copies of 200 bytes or more are
repeated from end to end.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Scratch, free_name, text_id, tidied
from terravane.llm.near_dup import BROADCAST_IDS
from terravane.llm.shingles import chunks, mix

#: Length of a repeated string and of the grams that anchor it, in bytes.
LENGTH, GRAM = 200, 32
_W = LENGTH - GRAM + 1
#: Runs of one anchor up to which its strings are compared within a task; and bytes compared at a time, which take a worker about 100 times their memory.
BLOCK_RUNS, BLOCK_BYTES = 2000, 1 << 19
#: Bytes of a long text whose strings are looked at together.
SLICE = 1 << 20
#: Batches that a whole corpus is indexed in.
BATCHES = 5
_TABLE = np.random.default_rng(32).integers(1, 1 << 63, 256, dtype=np.uint64)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_S = np.uint64(29)
_POS = np.uint64((1 << 20) - 1)


def _join(a: np.ndarray, b: np.ndarray, by: np.uint64) -> np.ndarray:
    return (a ^ (a >> _S)) * by + b


def _string_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM and of the LENGTH bytes that start at each place (of all data, ends of texts disregarded)."""
    span, size, kept = _TABLE[data], 1, {}
    for level in range(7):
        span = _join(span[:-size], span[size:], _C[level])
        size *= 2
        if size in (8, GRAM, 64, 128):
            kept[size] = span
    n = len(data) - LENGTH + 1
    whole = _join(kept[128][:n], kept[64][128 : 128 + n], _C[5])
    return kept[GRAM], mix(_join(whole, kept[8][192 : 192 + n], _C[6]))


def _least(x: np.ndarray) -> np.ndarray:
    size = 1
    while size * 2 <= _W:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (_W - size)], x[_W - size :])


def _stretches(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte, and owner, of the stretches that strings at sorted starts cover."""
    if not len(starts):
        return starts, starts, owner
    new = np.r_[True, (np.diff(starts) > LENGTH) | (owner[1:] != owner[:-1])]
    at = np.flatnonzero(new)
    return starts[at], starts[np.r_[at[1:], len(starts)] - 1] + LENGTH, owner[at]


def _valid(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a string lies within its text, and the text's number."""
    n = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][doc], doc


def suffix_ranks(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks, by content, of the LENGTH-byte strings at ``places`` (sorted) among each other; -1 for those that occur once.

    Suffixes are sorted to a depth of 8, 16, 32, 64 and 128 bytes in turn, each
    from the ranks at half the depth, and at last to LENGTH. A place falls out
    as soon as its suffix is unlike all others.
    """
    # the places from which any part of a string is taken
    near = np.flatnonzero(np.cumsum(np.bincount(places, minlength=len(data)) - np.bincount(places + LENGTH, minlength=len(data))[: len(data)]) > 0)
    padded = np.append(data, np.zeros(LENGTH, np.uint8)).astype(np.uint64)
    key = np.zeros(len(near), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[near + i]
    rank, at = _ranked(key, near, len(padded)), near
    for depth, step in ((8, 8), (16, 16), (32, 32), (64, 64), (128, LENGTH - 128)):
        if step < depth:
            at = places
        at = at[at + step < len(padded)]
        at = at[(rank[at] >= 0) & (rank[at + step] >= 0)]
        rank = _ranked(rank[at].astype(np.uint64) << np.uint64(32) | rank[at + step].astype(np.uint64), at, len(padded))
    return rank[places]


def _ranked(key: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, -1, np.int64)
    if len(at):
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[back] > 1
        out[at[again]] = back[again]
    return out


def _sliced(column: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, first byte of a long text's slice, bytes, offsets); a string lies in just one slice."""
    for a, b, data, offsets in chunks(column):
        if len(data) <= SLICE + LENGTH or b - a > 1:
            yield a, b, 0, data, offsets
            continue
        for base in range(0, len(data) - LENGTH + 1, SLICE):
            part = data[base : base + SLICE + LENGTH - 1]
            yield a, b, base, part, np.array([0, len(part)])


RUNS = "batch int, gram binary, run long, th binary, start long, n int, kind int"
_RUN_TYPES = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())


def _array(batches: int):
    """The function for mapInArrow that makes, of (th, text), runs (kind 0) and stretches that repeat within a run of a periodic text (kind 1)."""

    @tidied
    def run(rows):
        for batch in rows:
            for a, b, base, data, offsets in _sliced(batch.column(1)):
                if not len(data) or int(np.diff(offsets).max()) < LENGTH:
                    continue
                th = batch.column(0)[a:b]
                grams, strings = _string_hashes(data)
                place, doc = _valid(offsets)
                where = np.arange(len(grams), dtype=np.uint64) & _POS
                first, last = _least((grams & ~_POS) | where)[place], _least((grams & ~_POS) | (_POS - where))[place]
                value = first >> np.uint64(20)
                at = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
                n = np.diff(np.r_[at, len(place)])
                anchor = place[at] + (((first[at] & _POS).astype(np.int64) - place[at]) & int(_POS))
                inside = np.arange(len(place)) - np.repeat(at, n)
                content = mix(np.add.reduceat(mix(strings[place] + inside.astype(np.uint64) * _C[3]), at))
                raw = data.tobytes()
                text = th.take(pa.array(doc[at]))
                number = np.array([h[0] for h in th.to_pylist()])[doc[at]] % batches
                gram = pa.array([raw[x : x + GRAM] for x in anchor.tolist()], pa.binary())
                start = place[at] - offsets[doc[at]] + base
                yield _runs([number, gram, content.astype(np.int64), text, start, n, np.zeros(len(at))])
                # at a period of _W no window holds its anchor twice, but the run goes on from one anchor to the next
                tied = np.flatnonzero(np.logical_or.reduceat((first & _POS) != (_POS - (last & _POS)), at) | (n > _W))
                if len(tied):
                    names, firsts = text.to_pylist(), start.tolist()
                    found = _block([(True, names[i], firsts[i], raw[place[at[i]] : place[at[i]] + n[i] + LENGTH - 1]) for i in tied.tolist()])
                    k = found.num_rows
                    s, e = (found.column(i).to_numpy() for i in (1, 2))
                    yield _runs([np.zeros(k), pa.array([b""] * k, pa.binary()), np.zeros(k), found.column(0), s, e - s, np.ones(k)])

    return run


def _runs(columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(arrays, _RUN_TYPES, strict=True)], names=["batch", "gram", "run", "th", "start", "n", "kind"])


class SuffixIndex:
    """Levels of sorted arrays of the suffixes at anchors; ``add`` takes a batch's runs in and keeps which grams it finds again."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.spark = scratch, scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str, str]] = []  # batches, table, path
        self.again: list[DataFrame] = []

    def _write(self, entries: DataFrame) -> tuple[str, str]:
        name, path = f"suffixes_{uuid.uuid4().hex}", self.scratch.path("level")
        entries.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, "gram").sortBy("gram").saveAsTable(name)
        return name, path

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch._delete(path)

    def add(self, runs: DataFrame) -> None:
        """Index the grams of ``runs`` (column gram, repeated as they come)."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, one, at_one), (m, two, at_two) = self.levels[-1], self.levels[-2]
            a, b = (self.spark.table(t).select("gram", F.col("count").alias(f"count_{i}")) for i, t in enumerate((one, two)))
            both = a.join(b, "gram", "full").select("gram", (F.coalesce("count_0", F.lit(0)) + F.coalesce("count_1", F.lit(0))).alias("count"))
            self.levels[-2:] = [(n + m, *self._write(both))]
            self._drop(one, at_one)
            self._drop(two, at_two)
        name, path = self._write(runs.groupBy("gram").agg(F.count("*").alias("count")))
        new = self.spark.table(name)
        found, again = new, F.col("count") > 1
        for i, (_, level, _) in enumerate(self.levels):
            found = found.join(self.spark.table(level).select("gram", F.col("count").alias(f"count_{i}")), "gram", "left")
            again = again | F.col(f"count_{i}").isNotNull()
        self.levels.append((1, name, path))
        # what is found is small: one file for several buckets
        self.again.append(self.scratch.keep(found.where(again).select("gram").coalesce(-(-self.buckets // 4)), "again"))

    def found(self) -> DataFrame:
        """Every gram that occurs again in its batch or in an earlier one, once."""
        out = self.again[0]
        for more in self.again[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def close(self) -> None:
        for _, name, path in self.levels:
            self._drop(name, path)
        self.levels = []
        self.scratch.drop(*self.again)


@tidied
def _cut(batches):
    """Bytes of the wanted runs of (th, text, runs), some texts at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            n = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat = part.column(2).flatten()
            gram, start, length, single, large = (flat.field(i) for i in range(5))
            raw = [t.as_buffer().to_pybytes() for t in part.column(1)]
            owner = np.repeat(np.arange(part.num_rows), n)
            data = [raw[o][s : s + k + LENGTH - 1] for o, s, k in zip(owner.tolist(), start.to_pylist(), length.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([gram, single, part.column(0).take(pa.array(owner)), start, pa.array(data, pa.binary()), large], names=["gram", "single", "th", "start", "data", "large"])


CUT = "gram binary, single boolean, th binary, start long, data binary, large boolean"
SPANS = "th binary, start long, end long"


def _block(rows: list[tuple]) -> pa.RecordBatch:
    """Stretches of the rows' strings that occur twice or more among them; rows are (wanted, th, start, bytes)."""
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    offsets = np.cumsum([0] + [len(r[3]) for r in rows])
    place, row = _valid(offsets)
    again = np.flatnonzero((suffix_ranks(data, place) >= 0) & np.array([r[0] for r in rows])[row])
    s, e, r = _stretches(place[again], row[again])
    shift = np.array([x[2] for x in rows])[r] - offsets[r]
    return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in r.tolist()], pa.binary()), pa.array(s + shift, pa.int64()), pa.array(e + shift, pa.int64())], names=["th", "start", "end"])


@tidied
def _compare(batches):
    """Rows sorted by gram, compared in blocks of whole grams."""
    rows, size, last = [], 0, None
    for batch in batches:
        for gram, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if gram != last and size >= BLOCK_BYTES:
                yield _block(rows)
                rows, size = [], 0
            last = gram
            rows.append(tuple(row))
            size += len(row[3])
    if rows:
        yield _block(rows)


SPELT = "gram binary, h long, single boolean, th binary, start long"


@tidied
def _spell(batches):
    """The hash of each string of each row."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            raw = part.column(4).to_pylist()
            offsets = np.cumsum([0] + [len(x) for x in raw])
            place, row = _valid(offsets)
            hashes = _string_hashes(np.frombuffer(b"".join(raw), np.uint8))[1][place]
            of = pa.array(row)
            start = pa.array(place - offsets[row] + part.column(3).to_numpy()[row])
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), pa.array(hashes.astype(np.int64)), part.column(1).take(of), part.column(2).take(of), start], names=["gram", "h", "single", "th", "start"])


def repeated_spans(docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """(th, spans) for each text that holds repeated bytes: th is the text's id, spans an array of (start, end) that may overlap."""
    hashed = docs.select(text_id(F.col("text")).alias("th"), "text").where(F.octet_length("text") >= LENGTH)
    copies = hashed.groupBy("th", F.octet_length("text").cast("long").alias("end")).agg(F.count("*").alias("c")).where("c > 1")
    copies = copies.select("th", F.lit(0).cast("long").alias("start"), "end")
    raw = scratch.keep(hashed.mapInArrow(_array(batches), RUNS), "runs", ("kind", "batch"))
    index = SuffixIndex(scratch)
    try:
        for i in range(batches):
            index.add(raw.where((F.col("kind") == 0) & (F.col("batch") == i)))
        hits = raw.where("kind = 0").join(index.found(), "gram", "left_semi").select("gram", "run", "th", "start", "n")
        hits = scratch.keep(hits, "hits")
    finally:
        index.close()
    local = scratch.keep(raw.where("kind = 1").select("th", "start", (F.col("start") + F.col("n")).alias("end")).distinct(), "local")
    scratch.drop(raw)
    # rows of copies count each: their strings do occur as often
    runs = hits.groupBy("gram", "run").agg(F.count("*").alias("c"), F.min(F.struct("th", "start", "n")).alias("one"))
    grams = runs.groupBy("gram").agg(F.count("*").alias("n_runs"), F.min("c").alias("least"))
    runs = scratch.keep(runs.join(grams, "gram").select("gram", "run", "c", "one", "n_runs", "least"), "settled")
    whole = hits.join(runs.where("c > 1").select("gram", "run"), ["gram", "run"], "left_semi").select("th", "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("end"))
    # a run that several texts share needs one of them for the others to be compared with
    wanted = runs.where("n_runs > 1 and least = 1").select(
        F.col("one.th").alias("th"),
        F.struct("gram", F.col("one.start").alias("start"), F.col("one.n").alias("n"), (F.col("c") == 1).alias("single"), (F.col("n_runs") > BLOCK_RUNS).alias("large")).alias("r"),
    )
    wanted = scratch.keep(wanted.groupBy("th").agg(F.collect_list("r").alias("runs")), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("th")
    texts = hashed.join(F.broadcast(ids) if few else ids, "th", "left_semi").dropDuplicates(["th"])
    cut = scratch.keep(texts.join(wanted, "th").select("th", "text", "runs").mapInArrow(_cut, CUT), "cut")
    # no join by gram may come before: Spark takes its shuffle for this one's, and may then read it by map task, where an anchor's rows do not meet
    near = cut.where("not large").drop("large").repartition(F.col("gram")).sortWithinPartitions("gram").mapInArrow(_compare, SPANS)
    spelt = cut.where("large").drop("large").mapInArrow(_spell, SPELT)
    again = spelt.groupBy("gram", "h").agg(F.count("*").alias("c")).where("c > 1")
    far = spelt.where("single").join(again, ["gram", "h"], "left_semi").select("th", "start", (F.col("start") + LENGTH).alias("end"))
    spans = copies.unionByName(whole).unionByName(near).unionByName(far).unionByName(local)
    return spans.distinct().groupBy("th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch, in order."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return list(zip(starts[new].tolist(), reach[np.r_[new[1:], len(starts)] - 1].tolist(), strict=True))


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)], strict=True))


def _texts(batch: pa.RecordBatch):
    """(bytes, spans) of each row's columns text and, the last, spans, some rows at a time; None for a null text."""
    text, spans = batch.column(batch.schema.get_field_index("text")), batch.column(batch.num_columns - 1)
    for a in range(0, batch.num_rows, 256):
        part = spans[a : a + 256]
        flat = part.flatten()
        starts, ends = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        length = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.r_[0, np.cumsum(length)]
        for i, t in enumerate(text[a : a + 256]):
            yield t.as_buffer().to_pybytes() if t.is_valid else None, _merged(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])


@tidied
def _digest(batches):
    for batch in batches:
        out = []
        for doc_id, (raw, gone) in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
            raw = raw or b""
            out.append((doc_id, len(raw), sum(e - s for s, e in gone), len(gone), hashlib.sha256(_kept(raw, gone)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 4 else pa.int64()) for i in range(5)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, batches: int) -> DataFrame:
    """``docs`` and, as last column, its texts' spans."""
    scratch = Scratch(docs.sparkSession)
    th, held = free_name(docs, "_th"), free_name(docs, "_spans")
    spans = repeated_spans(docs.select("text"), scratch, batches).withColumnsRenamed({"th": th, "spans": held})
    spans = scratch.keep(spans, "spans")
    return docs.join(spans, text_id(F.col("text")) == F.col(th), "left").drop(th)


def digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of ``docs`` (doc_id, text).

    A null text counts as empty; texts under 200 bytes keep everything; rows
    that are repeated, with the same id or not, are repeats of each other and
    lose all bytes from 200 on; null ids are returned as they come; a very long
    text is indexed slice by slice and judged whole; other columns are ignored;
    an empty table gives an empty result.
    """
    return _with_spans(docs.select("doc_id", "text"), batches).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@tidied
def _strip(batches):
    for batch in batches:
        # a cut within a code point takes all of it
        texts = [None if raw is None else _kept(raw, gone).decode("utf-8", "ignore") for raw, gone in _texts(batch)]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(names)], names=names)


def strip_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with repeated bytes removed from its texts; every row, repeated ones too, and every other column stays, whatever its name.

    A null text stays null; an empty one stays empty; a text whose bytes are all
    repeated becomes empty; a null id does not matter; a very long text is
    judged whole; an empty table gives an empty result.
    """
    # rows pass through Python under plain names
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    return _with_spans(plain, batches).mapInArrow(_strip, plain.schema).toDF(*docs.columns)
