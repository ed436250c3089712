"""Learned models against slow versions written from their definitions."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import fingerprint, language, quality, url_filter


def grams(url):
    text = url_filter._PAD + re.sub(r"[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), url))
    return [text[i : i + url_filter.ORDER + 1] for i in range(len(text) - url_filter.ORDER)]


class Markov:
    """Witten-Bell interpolation over context lengths 0 to ORDER."""

    def __init__(self, urls):
        self.counts = [defaultdict(Counter) for _ in range(url_filter.ORDER + 1)]
        for u in urls:
            for g in grams(u):
                for k in range(url_filter.ORDER + 1):
                    s = g[url_filter.ORDER - k :]
                    self.counts[k][s[:-1]][s[-1]] += 1

    def log(self, gram):
        p = 1 / url_filter.ALPHABET
        for k in range(url_filter.ORDER + 1):
            s = gram[url_filter.ORDER - k :]
            seen = self.counts[k].get(s[:-1])
            if seen:
                t, d = sum(seen.values()), len(seen)
                p = (seen[s[-1]] + d * p) / (t + d)
        return math.log(p)


def test_url_models_and_threshold(spark):
    rng = random.Random(21)
    words = ["good", "spam", "news", "Page", "x", "42", "é"]
    urls = [f"http://h{rng.randrange(9)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['fr', 'es', 'en'])}/{rng.choice(words)}{rng.choice(words)}" for _ in range(220)]
    urls += urls[:15] + ["", "no scheme", "http://long.org/" + "spam/x" * 4000] + ["http://tie.org/same"] * 3
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate([*urls, None])), "page_id long, url string")).collect()}
    assert len(got) == len(urls) + 1 and got[len(urls)].llr == 0.0

    def action(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text)).action if fits else None

    fold = {u: crc32(u.encode()) % 5 for u in urls}
    of = {u: action(u) for u in urls}
    models = {a: Markov([u for u in urls if of[u] == a and fold[u]]) for a in ("allow", "block")}
    score = lambda u: np.mean([models["allow"].log(g) - models["block"].log(g) for g in grams(u)]) if u else 0.0
    held = {a: [score(u) for u in set(urls) if of[u] == a and not fold[u]] for a in models}
    m, s = {a: np.mean(v) for a, v in held.items()}, {a: np.std(v) for a, v in held.items()}
    threshold = (m["allow"] * s["block"] + m["block"] * s["allow"]) / (s["allow"] + s["block"])
    judged = [i for i, u in enumerate(urls) if of[u] is None]
    assert len(judged) > 40 and len({got[i].llr for i in judged if urls[i] == "http://tie.org/same"}) == 1
    for i in judged:
        assert got[i].llr == pytest.approx(score(urls[i]), abs=1e-8)
        if abs(score(urls[i]) - threshold) > 1e-8:
            assert got[i].verdict == ("allow" if score(urls[i]) >= threshold else "block")


def test_compiled_rules_equal_the_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "PENALTY", 1e-5)
    rng = np.random.default_rng(22)
    x = rng.normal(size=(500, 4)).round(2)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.2)).astype(float)
    names = ["one", "two", "three", "four"]
    model = quality.RuleModel(names, x, y)
    assert model.rules and model.linear
    frame = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(x)], "i long, one double, two double, three double, four double")
    got = {r.i: r.p for r in frame.select("i", model.expression().alias("p")).collect()}
    for i, row in enumerate(x):
        total = model.intercept
        for rule, w in model.rules:
            total += w * all((row[f] > v) == above for f, above, v in rule)
        for f, low, high, w in model.linear:
            total += w * (min(max(row[f], low), high) - low) / (high - low)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
    assert np.mean([(got[i] > 0.5) == y[i] for i in range(len(y))]) > 0.95


def test_rules_are_paths_of_trees():
    rng = np.random.default_rng(23)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(2)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(2)], axis=1)
    rules = quality._tree_rules(x, bins, edges, y)
    assert all(1 <= len(r) <= quality.DEPTH for r in rules) and len(set(rules)) == len(rules)
    for rule in rules:  # the other side of each rule's last cut, and the path above it, are rules too
        assert any(set(rule) - set(other) == {c} and (c[0], not c[1], c[2]) in other for c in rule for other in rules)
        inside = np.array([all((row[f] > v) == above for f, above, v in rule) for row in x])
        assert (inside == quality._holds(x, rule)).all() and inside.sum() >= 5


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(24)
    a = rng.normal(size=(400, 12))
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * a[:, 0] - a[:, 1] + 0.5)))).astype(float)
    w, b = quality._lasso(a, y, 0.02, 4000)
    slope = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / 400
    assert abs(np.mean(1 / (1 + np.exp(-(a @ w + b))) - y)) < 1e-6
    assert 0 < (w != 0).sum() < 12
    for j in range(12):
        assert abs(slope[j]) <= 0.02 + 1e-6 if w[j] == 0 else slope[j] == pytest.approx(-0.02 * np.sign(w[j]), abs=1e-6)


def direct(net, window):
    """Embedding, valid convolution at each offset, largest response above 0, softmax."""
    w8, pooled = net.weights, []
    e = w8["embed"][window]
    for w in language.WIDTHS:
        acts = [[sum(e[i + j] @ w8[f"conv{w}"][j * language.EMBED : (j + 1) * language.EMBED, f] for j in range(w)) for i in range(language.WINDOW - w + 1)] for f in range(language.FILTERS)]
        pooled += [max(0.0, max(a)) for a in acts]
    logits = np.array(pooled) @ w8["out"] + w8["bias"]
    p = np.exp(logits - logits.max())
    return p / p.sum()


def test_folded_tables_equal_direct_convolution():
    rng = np.random.default_rng(25)
    net = language.ByteNet(3, seed=4)
    windows = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    windows[2, 40:] = 0
    assert np.allclose(language.window_probabilities(windows, net.tables()), [direct(net, w) for w in windows], atol=1e-5)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(26)
    net = language.ByteNet(3, seed=5)
    x, y = rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        return -np.mean([math.log(direct_fast(net, w)[c]) for w, c in zip(x, y, strict=True)])

    def direct_fast(net, window):
        e, pooled = net.weights["embed"][window], []
        for w in language.WIDTHS:
            spread = np.concatenate([e[j : language.WINDOW - w + 1 + j] for j in range(w)], axis=1)
            pooled.append(np.maximum((spread @ net.weights[f"conv{w}"]).max(axis=0), 0))
        logits = np.concatenate(pooled) @ net.weights["out"] + net.weights["bias"]
        p = np.exp(logits - logits.max())
        return p / p.sum()

    grads = net._gradients(x, y)
    for name, weight in net.weights.items():
        for at in [np.unravel_index(np.abs(grads[name]).argmax(), weight.shape), tuple(rng.integers(0, s) for s in weight.shape)]:
            kept, step = weight[at], 1e-6
            weight[at] = kept + step
            up = loss()
            weight[at] = kept - step
            down = loss()
            weight[at] = kept
            assert (up - down) / (2 * step) == pytest.approx(grads[name][at], abs=1e-5)


def test_texts_are_judged_whole(docs, monkeypatch):
    rows = [(i, "alpha beta gamma" if i % 2 else "один два три", "en" if i % 2 else "ru") for i in range(60)]
    mixed = "alpha beta gamma " * 80 + "один два три " * 30
    rows += [(100, mixed, None), (101, "x", None), (102, "два" * 90, None)]
    frame = docs(rows)
    langs, tables = language.train(frame)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame).collect()}
    for i, text in ((100, mixed), (101, "x"), (102, "два" * 90)):
        raw, total, at = text.encode(), np.zeros(len(langs)), 0
        while at == 0 or at + language.WINDOW - language.STRIDE < len(raw):
            part = raw[at : at + language.WINDOW]
            window = np.frombuffer(part.ljust(language.WINDOW, b"\0"), np.uint8)[None]
            total += len(part) * language.window_probabilities(window, tables)[0]
            at += language.STRIDE
        assert got[i][0] == langs[total.argmax()] and got[i][1] == pytest.approx(total.max() / total.sum(), abs=1e-5)
    data = np.frombuffer((mixed * 9).encode(), np.uint8)
    offsets = np.array([0, len(data) - 700, len(data) - 700, len(data)])
    whole = language._totals(data, offsets, tables)
    monkeypatch.setattr(language, "SLICE", 5 * language.STRIDE)
    assert np.allclose(language._totals(data, offsets, tables), whole, rtol=1e-4)


def test_likeness_is_dice_of_different_hashes(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("n_chars", F.lit("clash"))
    rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: r[0])
    out = {r.doc_id: r for r in fingerprint.fingerprints(frame).collect()}
    hashes = lambda print_: {print_[i : i + 8] for i in range(0, len(print_), 16)}
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for (i, _), (j, _) in zip(rows, [*rows[1:], rows[0]], strict=True):
        mine = hashes(out[i].fingerprint)
        assert out[i].near_edited == pytest.approx(dice(mine, hashes(out[i].edited_fingerprint)))
        assert out[i].near_next == pytest.approx(dice(mine, hashes(out[j].fingerprint)))
