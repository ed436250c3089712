"""Language-model scores by prediction by partial matching, next to a unigram baseline.

The model is a byte-context trie of order ``ORDER`` over 257 symbols (bytes and
one end), kept as relations: every context length has a table of (context,
symbol) counts from the training texts. Only the longest contexts count every
symbol; a shorter one counts it once for each longer context in which it was
new (update exclusion). A symbol seen in a context gets (2c - 1) / 2T of its
probability, half of the number of different symbols over T goes to the escape,
and what a longer context has seen is excluded from the counts of the shorter
one. The code length of a text is that of all its bytes
and its end, from a pretrained model, so it depends only on its strings of
``ORDER + 1`` symbols.

Texts are dealt into chunks of about ``CHUNK_BYTES``. A chunk gathers its
different strings and words with their training counts; these are summed over
chunks, each different string is scored once, from its own context or, if it
was never trained on, from shorter ones; and each chunk gets back the scores of
the strings and words that it holds, ahead of its texts. Texts pass through a
task some at a time; it keeps the different strings of one chunk. No task and
no broadcast holds the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Scratch, crc_mod, tidied
from terravane.llm.shingles import chunks, mix, word_hashes

ORDER, SYMBOLS = 5, 257
CHUNK_BYTES = 32 << 20
_END, _PAD, _BITS = 256, 257, 9
#: The baseline's end token.
_END_WORD = np.uint64(0x5E17D5B1F00D)


def string_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed ORDER + 1 symbols that end at each byte and end of each text, and where each text's begin."""
    n = np.diff(offsets)
    at = np.cumsum(np.r_[0, n + ORDER + 1])
    symbols = np.full(at[-1], _PAD, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(data)) + ORDER * (doc + 1) + doc
    symbols[place] = data
    symbols[at[1:] - 1] = _END
    code = np.zeros(len(symbols) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        code = (code << np.uint64(_BITS)) | symbols[j : len(symbols) - ORDER + j]
    real = np.flatnonzero(symbols[ORDER:] != _PAD)
    return code[real], np.cumsum(np.r_[0, n + 1])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and where each text's begin; the end token is left out."""
    return word_hashes(data, offsets)


class Lookup:
    """Codes with their values, in buckets by the first bits of a scramble of the codes."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        keys = mix(codes)
        order = np.argsort(keys)
        self._keys, self._values = keys[order], values[order]
        bits = len(codes).bit_length()
        self._shift = np.uint64(64 - bits) if bits else np.uint64(63)
        sizes = np.bincount((self._keys >> self._shift).astype(np.int64), minlength=1 << max(bits, 1))
        self._first = np.cumsum(sizes) - sizes

    def get(self, codes: np.ndarray) -> np.ndarray:
        """Values of codes that are all there."""
        keys = mix(codes)
        at = self._first[keys >> self._shift]
        left = np.flatnonzero(self._keys[at] != keys)
        while len(left):
            at[left] += 1
            left = left[self._keys[at[left]] != keys[left]]
        return self._values[at]


#: Codes of a chunk that are gathered before they are counted.
PENDING = 2_000_000


class Tally:
    """Different codes, in order, with the number of times that they came from training texts."""

    def __init__(self) -> None:
        self._codes, self._counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._new: tuple[list, list] = ([], [])
        self._pending = 0

    def add(self, codes: np.ndarray, train: np.ndarray) -> None:
        self._new[0].append(codes[train])
        self._new[1].append(codes[~train])
        self._pending += len(codes)
        if self._pending > PENDING:
            self.counted()

    def put(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of different codes, which come in order."""
        at = np.searchsorted(self._codes, codes)
        known = at < len(self._codes)
        known[known] = self._codes[at[known]] == codes[known]
        self._counts[at[known]] += counts[known]
        self._codes = np.insert(self._codes, at[~known], codes[~known])
        self._counts = np.insert(self._counts, at[~known], counts[~known])

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        for some, step in zip(self._new, (1, 0), strict=True):
            if some:
                codes = np.concatenate(some)
                some.clear()
                codes.sort()
                first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
                self.put(codes[first], np.diff(np.r_[first, len(codes)]) * step)
        self._pending = 0
        return self._codes, self._counts


PARTS = "chunk int, kind int, code long, n long"


def _runs(batch: pa.RecordBatch):
    """(chunk, first row, end row) of a batch that is sorted by its first column."""
    chunk = batch.column(0).to_numpy()
    at = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else []
    for a, b in zip(at, [*at[1:], len(chunk)], strict=True):
        yield int(chunk[a]), int(a), int(b)


@tidied
def _gather(batches):
    """Different strings (kind 0) and words (kind 1) of each chunk with their counts in its training texts; rows come sorted by chunk."""
    now, kinds, texts = None, (), 0

    def told():
        kinds[1].put(np.array([_END_WORD]), np.array([texts]))
        for kind in (0, 1):
            codes, counts = kinds[kind].counted()
            for a in range(0, len(codes), 100_000):
                n = len(codes[a : a + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, now, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(codes[a : a + n].view(np.int64)), pa.array(counts[a : a + n])], names=["chunk", "kind", "code", "n"]
                )

    for batch in batches:
        for chunk, first, end in _runs(batch):
            if chunk != now:
                if now is not None:
                    yield from told()
                now, kinds, texts = chunk, (Tally(), Tally()), 0
            held = batch.column(1).slice(first, end - first).to_numpy(zero_copy_only=False).astype(bool)
            texts += int((~held).sum())
            for a, b, data, offsets in chunks(batch.column(2).slice(first, end - first)):
                for kind, (codes, at) in enumerate((string_codes(data, offsets), _words(data, offsets))):
                    kinds[kind].add(codes, np.repeat(~held[a:b], np.diff(at)))
    if now is not None:
        yield from told()


def _low(column: str, order: int):
    """The last ``order + 1`` symbols."""
    return F.col(column).bitwiseAND(F.lit((1 << (_BITS * (order + 1))) - 1))


def score_strings(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """(code, value): log10 probability of the last symbol after the others, for each row of (code, n); n counts in training."""
    seen = {ORDER: strings.where("n > 0")}
    for k in range(ORDER - 1, -1, -1):
        seen[k] = scratch.keep(seen[k + 1].select(_low("code", k).alias("code")).groupBy("code").agg(F.count("*").alias("n")), f"order{k}")
    done: list[DataFrame] = []
    # left: codes with their count at this order, and what the longer context has seen of it
    left = strings.select("code", "n", F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("d_x"))
    for k in range(ORDER, -1, -1):
        context = F.shiftright("code", _BITS)
        stats = seen[k].groupBy(context.alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"))
        if k:
            shorter = seen[k - 1].select(F.col("code").alias("_low"), F.col("n").alias("_n"))
            also = seen[k].withColumn("_low", _low("code", k - 1)).join(shorter, "_low").groupBy(context.alias("context")).agg(F.sum("_n").alias("next_x"))
            stats = stats.join(also, "context")
        else:
            stats = stats.withColumn("next_x", F.lit(0).cast("long"))
        here = left.withColumn("context", F.shiftright(_low("code", k), _BITS)).join(stats, "context", "left")
        t, d = F.col("t") - F.col("x"), F.col("d") - F.col("d_x")
        step = F.when(F.col("n") > 0, F.log10((F.col("n") - 0.5) / t)).when(d > 0, F.log10(0.5 * d / t)).otherwise(F.lit(0.0))
        here = scratch.keep(
            here.select("code", "n", (F.col("log") + step).alias("log"), F.coalesce("next_x", F.lit(0)).alias("x"), F.coalesce("d", F.lit(0)).alias("d_x")), f"scored{k}"
        )
        done.append(here.where("n > 0").select("code", F.col("log").alias("value")))
        left = here.where("n = 0")
        if k:
            counts = seen[k - 1].select(F.col("code").alias("_low"), F.col("n").alias("_n"))
            left = left.withColumn("_low", _low("code", k - 1)).join(counts, "_low", "left")
            left = left.select("code", F.coalesce("_n", F.lit(0)).alias("n"), "log", "x", "d_x")
    done.append(left.select("code", (F.col("log") - F.log10(F.greatest(F.lit(1), F.lit(SYMBOLS) - F.col("d_x")))).alias("value")))
    scratch.drop(*[seen[k] for k in range(ORDER)])
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _judge(n_all: int, n_different: int):
    """The function for mapInArrow that scores texts (part 2); their chunk's strings (part 0) and words (part 1) come before them."""
    norm = n_all + 0.5 * (n_different + 1)

    @tidied
    def run(batches):
        now, parts, tables = None, ([], []), None
        for batch in batches:
            for chunk, first, end in _runs(batch):
                if chunk != now:
                    now, parts, tables = chunk, ([], []), None
                rows = batch.slice(first, end - first)
                part = rows.column(1).to_numpy()
                _, words, texts = (int(x) for x in np.searchsorted(part, (0, 1, 2)))
                for k, a, b in ((0, 0, words), (1, words, texts)):
                    if a < b:  # ids of texts may be null, codes never are
                        parts[k].append(tuple(rows.column(i).slice(a, b - a).to_numpy().copy() for i in (2, 3)))
                if texts == len(part):
                    continue
                if tables is None:
                    none = [(np.zeros(0, np.int64), np.zeros(0))]
                    tables = [Lookup(np.concatenate([c for c, _ in p or none]).view(np.uint64), np.concatenate([v for _, v in p or none])) for p in parts]
                    parts = ([], [])
                yield _scores(rows.slice(texts), *tables, n_all, norm)

    return run


def _scores(rows: pa.RecordBatch, strings: Lookup, words: Lookup, n_all: int, norm: float) -> pa.RecordBatch:
    ends = words.get(np.array([_END_WORD]))[0]
    tokens, hits, base, score = [], [], [], []
    for _, _, data, offsets in chunks(rows.column(4)):
        codes, at = string_codes(data, offsets)
        score.append(np.add.reduceat(strings.get(codes), at[:-1]))
        found, at = _words(data, offsets)
        c = words.get(found)
        sums = np.concatenate([[0.0], np.cumsum(np.log10((c + 0.5) / norm))])
        seen = np.concatenate([[0], np.cumsum(c > 0)])
        tokens.append(np.diff(at) + 1)
        hits.append(seen[at[1:]] - seen[at[:-1]] + (ends > 0))
        base.append(sums[at[1:]] - sums[at[:-1]] + np.log10((ends + 0.5) / norm))
    out = {
        "doc_id": rows.column(2),
        "held_out": pa.array(rows.column(3).to_numpy() > 0),
        "n_tokens": pa.array(np.concatenate(tokens), pa.int64()),
        "n_known": pa.array(np.concatenate(hits), pa.int64()),
        "train_tokens": pa.array(np.full(rows.num_rows, n_all), pa.int64()),
        "base_score": pa.array(np.concatenate(base)),
        "score": pa.array(np.concatenate(score)),
    }
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of every whole text of ``docs`` (doc_id, text); learns from texts whose crc32(id) modulo 5 is not 1.

    Null texts count as empty, which is an end alone; repeated rows are learned
    from and scored each; null ids hash as empty text; without training texts
    all strings have equal probabilities; a very long text is counted and
    scored in memory by itself, whole; other columns are ignored; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-total // chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))
    dealt = rows.select("chunk", "held_out", "text").repartition("chunk").sortWithinPartitions("chunk")
    parts = scratch.keep(dealt.mapInArrow(_gather, PARTS), "parts")
    sums = scratch.keep(parts.groupBy("kind", "code").agg(F.sum("n").alias("n")), "sums")
    words = sums.where("kind = 1").select("kind", "code", F.col("n").cast("double").alias("value"))
    size = sums.where("kind = 1 and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    strings = score_strings(sums.where("kind = 0").select("code", "n"), scratch)
    values = strings.select(F.lit(0).alias("kind"), "code", "value").unionByName(words)
    fetched = parts.join(values, ["kind", "code"]).select("chunk", F.col("kind").alias("part"), F.col("code").alias("doc_id"), "value", F.lit(None).cast("string").alias("text"))
    texts = rows.select("chunk", F.lit(2).alias("part"), "doc_id", F.col("held_out").cast("double").alias("value"), "text")
    laid = fetched.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "part")
    return laid.mapInArrow(_judge(size["n"], size["v"]), SCORES)
