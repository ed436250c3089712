"""Quality classifier: a sparse ensemble of rules, compiled to column expressions.

Statistics of each whole text are Spark expressions. On a bounded sample of
labelled rows, gradient-boosted shallow trees over the statistics are grown,
each path from a root becomes a conjunctive rule, and a logistic model with a
lasso penalty over rules and clipped statistics keeps those that matter. What
is left is compiled into one Spark expression, so scoring stays in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import WORD, Scratch, columns, crc_mod, free_name
from terravane.llm.near_dup import text_hash

#: Most labelled rows that the model is fitted on, those with the smallest lots, drawn by a hash of their ids.
TRAIN_ROWS = 10_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
#: Weight of the lasso penalty per training row.
PENALTY = 0.002
THRESHOLD = 0.3


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Name and expression of each statistic; 0 where nothing can be counted."""
    n, n_words = F.length(text), F.size(words)

    def count(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(text, pattern, ""))

    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_length": _share(n.cast("double"), n_words),
        "distinct_words": _share(F.size(F.array_distinct(words)).cast("double"), n_words),
        "repeated_next": _share(F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(n_words, F.lit(1))), lambda a, b: a == b), lambda x: x)).cast("double"), n_words),
        "upper": _share(count(r"\p{Lu}+").cast("double"), n),
        "letters": _share(count(r"\p{L}+").cast("double"), n),
        "digits": _share(count(r"\p{N}+").cast("double"), n),
        "symbols": _share(count(r"[^\p{L}\p{N}\s.,;:'\"()?-]+").cast("double"), n),
        "doubled_symbols": _share(count(r"[^\p{L}\p{N}\s]{2,}").cast("double"), n),
        "sentence_ends": _share(count(r"[.?!](?=\s|$)").cast("double"), n_words),
        "lines": _share(count(r"\n").cast("double"), n),
        "lone_symbols": _share(count(r"(?<!\S)[^\p{L}\p{N}\s](?!\S)").cast("double"), n_words),
    }


def _tree_rules(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray) -> list[tuple]:
    """Paths of boosted trees as sorted tuples of (statistic, above, value)."""
    rules: dict[tuple, None] = {}
    margin = np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        stack = [(np.arange(len(y)), (), 0)]
        while stack:
            at, path, depth = stack.pop()
            best = (1e-6, -1, -1)
            if depth < DEPTH and len(at) >= 20:
                total_g, total_h = g[at].sum(), h[at].sum()
                for f in range(bins.shape[1]):
                    gs = np.cumsum(np.bincount(bins[at, f], g[at], BINS))[:-1]
                    hs = np.cumsum(np.bincount(bins[at, f], h[at], BINS))[:-1]
                    ns = np.cumsum(np.bincount(bins[at, f], minlength=BINS))[:-1]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    gain[(ns < 5) | (len(at) - ns < 5)] = 0
                    b = int(np.argmax(gain))
                    if gain[b] > best[0] and b < len(edges[f]):
                        best = (float(gain[b]), f, b)
            if best[1] < 0:
                if path:
                    margin[at] += RATE * g[at].sum() / (h[at].sum() + 1)
                continue
            _, f, b = best
            for above in (False, True):
                further = tuple(sorted({*path, (f, above, float(edges[f][b]))}))
                rules[further] = None
                side = bins[at, f] > b
                stack.append((at[side if above else ~side], further, depth + 1))
    return list(rules)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, value in rule:
        out &= (x[:, f] > value) == above
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights by accelerated proximal gradient; the intercept is not penalised."""
    n, k = a.shape
    full = np.c_[a, np.ones(n)]
    step = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        new = z - step * (full.T @ (1 / (1 + np.exp(-(full @ z))) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (old - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


class RuleModel:
    """Weighted rules and clipped statistics; ``expression`` is the probability of label 1."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.names, self.rules, self.linear, self.intercept = names, [], [], 0.0
        if not len(y) or y.min() == y.max():
            self.intercept = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
        rules = _tree_rules(x, bins, edges, y)
        low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        spread = np.maximum(high - low, 1e-12)
        clipped = (np.clip(x, low, high) - low) / spread
        columns = np.c_[np.stack([_holds(x, r) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0)), clipped]
        weights, self.intercept = _lasso(columns, y, PENALTY)
        self.rules = [(r, float(w)) for r, w in zip(rules, weights, strict=False) if w]
        self.linear = [(f, float(low[f]), float(high[f]), float(w)) for f, w in enumerate(weights[len(rules) :]) if w and high[f] > low[f]]

    def expression(self) -> Column:
        total = F.lit(self.intercept)
        for rule, w in self.rules:
            holds = F.lit(True)
            for f, above, value in rule:
                holds = holds & (F.col(self.names[f]) > value if above else F.col(self.names[f]) <= value)
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        for f, low, high, w in self.linear:
            total = total + F.lit(w / (high - low)) * (F.least(F.greatest(F.col(self.names[f]), F.lit(low)), F.lit(high)) - F.lit(low))
        return 1 / (1 + F.exp(-total))


def _texts(docs: DataFrame, text: str, words: str) -> DataFrame:
    """``docs`` with the whole text and its words in columns of these names."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns(docs), whole.alias(text), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias(words))


def _fitted(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> RuleModel:
    """The model, from the statistics of a bounded sample of labelled rows."""
    stats = statistics(F.col("_text"), F.col("_words"))
    held = crc_mod(F.col("doc_id"), 5) == 0
    known = labels.where("quality is not null").where(~held).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    labelled = scratch.keep(docs.select("doc_id").where(~held).distinct().join(known, "doc_id"), "labelled")
    labelled = labelled.withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)) / 1_000_000_007)
    # lots are drawn first, so that tasks send the driver about as many rows together as the sample has
    share = (2 * TRAIN_ROWS + 40) / max(1, labelled.count())
    drawn = scratch.keep(labelled.where(F.col("lot") < share).orderBy("lot", "doc_id").limit(TRAIN_ROWS), "drawn")
    # of several texts of an id the one with the smallest hash, so that reruns agree
    mine = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")  # TRAIN_ROWS rows at most
    rows = _texts(mine, "_text", "_words").select("doc_id", text_hash().alias("th"), *[c.alias(n) for n, c in stats.items()])
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*stats), "th").alias("row")).select("doc_id", "row.*")
    sample = one.join(drawn, "doc_id").orderBy("lot", "doc_id").select("y", *stats).toPandas().to_numpy(dtype=float)
    return RuleModel(list(stats), sample[:, 1:], sample[:, 0])


def score(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality; labels of held-out ids (crc32 of the id
    modulo 5 is 0) are never read; of several labels of an id the mean decides;
    null labels and labels of unknown ids are ignored. Null and empty texts
    have all statistics 0 and a score like any other. Without labels of both
    classes every score is the same. Repeated rows and null ids are returned
    as they come; of texts that share an id the one with the smallest hash is
    learned from; very long texts are scored whole; other columns are ignored;
    an empty table gives an empty result. Rows are scored where they are read.
    """
    rows = docs.select("doc_id", "text")
    model = _fitted(rows, labels, Scratch(docs.sparkSession))
    stats = statistics(F.col("_text"), F.col("_words"))
    held = crc_mod(F.col("doc_id"), 5) == 0
    measured = _texts(rows, "_text", "_words").select("doc_id", held.alias("held_out"), *[c.alias(n) for n, c in stats.items()])
    scored = measured.select("doc_id", "held_out", F.round(model.expression(), 9).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text the classifier rejects.

    The text alone decides, so null and repeated ids are each judged by their
    own text; null and empty texts are judged like any other; very long texts
    are judged whole; other columns stay, whatever their names; without labels
    of both classes all rows get one verdict; an empty table gives an empty
    result.
    """
    model = _fitted(docs.select("doc_id", "text"), labels, Scratch(docs.sparkSession))
    text, words, good = (free_name(docs, n) for n in ("_text", "_words", "_good"))
    stats = {n: (free_name(docs, f"_{n}"), c) for n, c in statistics(F.col(text), F.col(words)).items()}
    model.names = [stats[n][0] for n in model.names]
    measured = _texts(docs, text, words).select(*columns(docs), *[c.alias(n) for n, c in stats.values()])
    scored = measured.select(*columns(docs), F.round(model.expression(), 9).alias(good))
    # an array of one score or of none: a condition that the optimizer does not copy into the statistics
    passed = F.explode(F.filter(F.array(good), lambda s: s >= THRESHOLD))
    return scored.select(*columns(docs), passed.alias(good)).select(*columns(docs))
