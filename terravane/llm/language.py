"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over windows of ``WINDOW``
bytes, each filter's maximum over the window goes to a softmax. The network is
trained in numpy on windows of a bounded sample of labelled texts. To apply it,
embedding and filters are folded into one table per filter offset (byte to
filter sums); all windows of a text are judged and their probabilities averaged
by length, so the whole text counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm.common import crc_mod, limit_batches
from terravane.llm.shingles import chunks

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
STRIDE = WINDOW - max(WIDTHS) + 1
#: Most texts sampled for each language, and windows of each text: the model's training rows.
TRAIN_TEXTS, TRAIN_WINDOWS = 600, 4
#: Sampled texts that the languages share out evenly, one each at least.
MAX_TEXTS = 20_000
STEPS, BATCH, RATE = 500, 64, 0.01
#: Bytes that are cut into windows at a time.
SLICE = STRIDE << 13
UNKNOWN = "und"


class ByteNet:
    """Embedding, filters and softmax layer; ``fit`` trains them, ``tables`` folds them for use."""

    def __init__(self, n_classes: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.weights = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_classes)), "bias": np.zeros(n_classes)}
        for w in WIDTHS:
            self.weights[f"conv{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))

    def fit(self, windows: np.ndarray, classes: np.ndarray, seed: int = 12) -> None:
        """Adam on cross-entropy; each class is drawn alike."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(classes == c) for c in range(self.weights["out"].shape[1])]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, STEPS + 1):
            chosen = rng.integers(0, len(by_class), BATCH)
            at = np.array([by_class[c][rng.integers(0, len(by_class[c]))] for c in chosen])
            for k, g in self._gradients(windows[at], classes[at]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w8, n = self.weights, len(x)
        e = w8["embed"][x]
        rows = np.arange(n)[:, None]
        pooled, patches = [], {}
        for w in WIDTHS:
            spread = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            act = spread @ w8[f"conv{w}"]
            at = act.argmax(axis=1)
            pooled.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
            patches[w] = (spread[rows, at], at)
        h = np.concatenate(pooled, axis=1)
        on = h > 0
        logits = (h * on) @ w8["out"] + w8["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        grads = {"out": (h * on).T @ p, "bias": p.sum(axis=0), "embed": np.zeros_like(w8["embed"])}
        back = (p @ w8["out"].T) * on
        for i, w in enumerate(WIDTHS):
            b = back[:, i * FILTERS : (i + 1) * FILTERS]
            patch, at = patches[w]
            grads[f"conv{w}"] = np.einsum("nfk,nf->kf", patch, b)
            to = b[:, :, None] * w8[f"conv{w}"].T[None]
            for j in range(w):
                np.add.at(grads["embed"], x[rows, at + j], to[:, :, j * EMBED : (j + 1) * EMBED])
        return grads

    def tables(self) -> dict:
        """One byte-to-filter table for each width and offset, and the softmax layer."""
        w8 = self.weights
        folded = {w: [(w8["embed"] @ w8[f"conv{w}"][j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(w)] for w in WIDTHS}
        return {"conv": folded, "out": w8["out"].astype(np.float32), "bias": w8["bias"].astype(np.float32)}


def window_probabilities(windows: np.ndarray, tables: dict) -> np.ndarray:
    """Class probabilities of each row of WINDOW bytes."""
    out = []
    for a in range(0, len(windows), 128):
        x = windows[a : a + 128]
        pooled = []
        for w in WIDTHS:
            parts = tables["conv"][w]
            act = parts[0][x[:, : WINDOW - w + 1]]
            for j in range(1, w):
                act += parts[j][x[:, j : WINDOW - w + 1 + j]]
            pooled.append(act.max(axis=1))
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ tables["out"] + tables["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        out.append(p / p.sum(axis=1, keepdims=True))
    return np.concatenate(out)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (zero-padded), the number of windows of each text, and each window's length."""
    n_bytes = np.diff(offsets)
    n = np.maximum(1, -(-(n_bytes - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(n)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    length = np.clip(n_bytes[doc] - start, 0, WINDOW)
    where = (offsets[:-1][doc] + start)[:, None] + np.arange(WINDOW)
    padded = np.append(data, np.uint8(0))
    out = padded[np.minimum(where, len(data))]
    out[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
    return out, n, length


def _sample(batches):
    """Windows of the sampled texts, evenly spread."""
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            windows, n, _ = cut_windows(data, offsets)
            at = np.cumsum(n) - n
            lang, out = [], []
            for i, name in enumerate(batch.column(0)[a:b].to_pylist()):
                for w in np.unique(np.linspace(0, n[i] - 1, TRAIN_WINDOWS).astype(int)):
                    lang.append(name)
                    out.append(windows[at[i] + w].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])


def train(docs: DataFrame) -> tuple[list[str], dict] | None:
    """Languages and tables from the rows whose lang is known and that are not held out; None without such rows."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod(F.col("doc_id"), 3) != 1)).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().toPandas()
    if counts.empty:
        return None
    # the texts with a language's smallest hashes; lots that are drawn first leave few to be sorted
    most = min(TRAIN_TEXTS, max(1, MAX_TEXTS // len(counts)))
    counts["share"] = (2 * most + 40) / counts["count"]
    shares = F.broadcast(docs.sparkSession.createDataFrame(counts[["lang", "share"]], "lang string, share double"))
    lot = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1_000_000_007)) / 1_000_000_007
    drawn = known.join(shares, "lang").withColumn("lot", lot).where("lot < share")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("lot", "doc_id", "text"))
    chosen = drawn.withColumn("nth", nth).where(F.col("nth") <= most)
    rows = chosen.select("lang", "text").mapInArrow(_sample, "lang string, window binary").toArrow()
    if not rows.num_rows:
        return None
    order = np.lexsort([rows.column("window").to_pylist(), rows.column("lang").to_pylist()])
    windows = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)[order]
    names = np.array(rows.column("lang").to_pylist(), dtype=object)[order]
    langs = sorted(set(names))
    net = ByteNet(len(langs))
    net.fit(windows, np.searchsorted(np.array(langs), names.astype(str)))
    return langs, net.tables()


def _totals(data: np.ndarray, offsets: np.ndarray, tables: dict) -> np.ndarray:
    """Sums of each text's window probabilities, weighted by length; a very long text is judged in slices."""
    if len(data) <= SLICE:
        windows, n, length = cut_windows(data, offsets)
        return np.add.reduceat(window_probabilities(windows, tables) * length[:, None], np.cumsum(n) - n)
    out = np.zeros((len(offsets) - 1, len(tables["bias"])))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for s in range(a, max(b, a + 1), SLICE):
            part = data[s : min(b, s + SLICE + WINDOW - STRIDE)]
            windows, _, length = cut_windows(part, np.array([0, len(part)]))
            out[i] += window_probabilities(windows, tables).T @ length
    return out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, text, lang).

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if no language can be learned. Rows with a null lang are judged
    but not learned from; rows held out (crc32 of the id modulo 3 is 1) are not
    learned from. Repeated rows and null ids are returned as they come; a very
    long text is judged whole, in slices; of languages with equal probabilities
    the first by name is given; other columns are ignored; an empty table gives an empty result. Texts are judged
    where they are read, without a shuffle; the network is about 40 kB.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    learned = train(docs)
    shared = spark.sparkContext.broadcast(learned)

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                lettered = batch.column(3)[a:b].to_numpy(zero_copy_only=False).astype(bool)
                pred, score = np.full(b - a, UNKNOWN, dtype=object), np.zeros(b - a)
                if model is not None and lettered.any():
                    langs, tables = model
                    total = _totals(data, offsets, tables)
                    best = total.argmax(axis=1)
                    pred[lettered] = np.array(langs, dtype=object)[best[lettered]]
                    share = total[np.arange(b - a), best] / np.maximum(total.sum(axis=1), 1e-12)
                    score[lettered] = np.minimum(share[lettered], 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text", lettered.alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
