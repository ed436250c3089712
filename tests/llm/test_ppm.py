import math
import random
import re
import time
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from terravane.llm import ppm, shingles

K = ppm.ORDER


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Brute:
    """The model by its definition, from strings of K + 1 symbols."""

    def __init__(self, texts):
        counts = [Counter() for _ in range(K + 1)]
        for t in texts:
            s = [257] * K + list(t.encode()) + [256]
            counts[K].update(tuple(s[i - K : i + 1]) for i in range(K, len(s)))
        for k in range(K - 1, -1, -1):
            counts[k].update(x[1:] for x in counts[k + 1])
        self.by = [defaultdict(dict) for _ in range(K + 1)]
        for k, c in enumerate(counts):
            for x, n in c.items():
                self.by[k][x[:-1]][x[-1]] = n

    def log(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(K, -1, -1):
            seen = self.by[k].get(tuple(context[K - k :]), {})
            left = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / total)
            if left:
                out += math.log10(0.5 * len(left) / total)
            excluded |= set(seen)
        return out - math.log10(max(1, ppm.SYMBOLS - len(excluded)))

    def score(self, text):
        s = [257] * K + list(text.encode()) + [256]
        return sum(self.log(s[i - K : i], s[i]) for i in range(K, len(s)))


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 200])
def test_equals_brute_force(docs, chunk_bytes):
    texts = ["the cat sat on the mat", "The cat\tsat", "a mat, a hat é", "", None, "zzz unseen words ☃", "the the the the", "the cat sat on the mat"] * 4
    rows = list(enumerate(texts)) + [(3, "the hat")]
    held = {i: crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    train = [t or "" for i, t in rows if not held[i]]
    model = Brute(train)
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    got = ppm.score(docs(rows), chunk_bytes).collect()
    want = sorted((i, held[i], len(words(t or "")) + 1, sum(c[w] > 0 for w in [*words(t or ""), None]), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t or ""), None]), model.score(t or "")) for i, t in rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got)), want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], abs=1e-6)


def test_partial_counts_are_summed(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90))) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i // 40] * 20, pa.int32()), pa.array([i % 3 == 0] * 20), pa.array(texts[i : i + 20])], names=["chunk", "held_out", "text"]) for i in (0, 20, 40)]
    told = lambda: sorted(r for b in ppm._gather(batches) for r in zip(*b.to_pydict().values()))
    whole = told()
    monkeypatch.setattr(ppm, "PENDING", 3)
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert told() == whole and {c for c, *_ in whole} == {0, 1} and sum(n for _, k, _, n in whole if k == 0) > 0


def test_values_are_found_without_a_search_of_the_whole_table():
    rng = np.random.default_rng(21)
    for n in (0, 1, 2, 1000):  # codes of one bit pattern too
        codes = np.unique(np.r_[rng.integers(0, 1 << 54, n, dtype=np.uint64), np.arange(n, dtype=np.uint64) << np.uint64(45)])
        values, asked = rng.random(len(codes)), rng.integers(0, max(1, len(codes)), 3 * n)
        order = rng.permutation(len(codes))
        assert (ppm.Lookup(codes[order], values[order]).get(codes[asked] if n else codes) == (values[asked] if n else values)).all()
    codes = np.unique(rng.integers(0, 1 << 54, 1_300_000, dtype=np.uint64))
    asked, table = codes[rng.integers(0, len(codes), 500_000)], ppm.Lookup(codes, np.zeros(len(codes)))

    def least(f):
        took = []
        for _ in range(3):
            began = time.thread_time()
            f(asked)
            took.append(time.thread_time() - began)
        return min(took)

    assert least(table.get) < 0.6 * least(lambda x: np.searchsorted(codes, x))


def test_tally_counts_training_codes_and_keeps_the_others(monkeypatch):
    monkeypatch.setattr(ppm, "PENDING", 50)
    rng = np.random.default_rng(22)
    tally, want = ppm.Tally(), Counter()
    for n in (0, 7, 60, 200, 3):
        codes, train = rng.integers(0, 90, n, dtype=np.uint64), rng.random(n) < 0.5
        tally.add(codes, train)
        want.update(codes[train].tolist())
        want.update(dict.fromkeys(codes[~train].tolist(), 0))
    codes, counts = tally.counted()
    assert codes.tolist() == sorted(want) and dict(zip(codes.tolist(), counts.tolist())) == want and 0 in counts


def test_long_texts_equal_brute_force(docs):
    rng = random.Random(8)
    long = " ".join(rng.choice(["the", "cat", "sat", "Ön", "mat"]) for _ in range(160_000))
    assert len(long.encode()) > 600_000
    rows = [(i, "the cat sat on a mat") for i in range(12)] + [(20, long), (21, long[:1000]), (None, "null id"), (None, "null id")]
    held = {i: crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    model = Brute([t for i, t in rows if not held[i]])
    got = ppm.score(docs(rows), 1 << 14).collect()
    want = [(str(i), held[i], model.score(t)) for i, t in rows if t is not long] + [("20", held[20], model.score(long))]
    for g, w in zip(sorted((str(r.doc_id), r.held_out, r.score) for r in got), sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9)


def test_probabilities_add_up_to_one():
    model = Brute(["abracadabra", "abc", "bcd"])
    for context in ([257] * K, list(b"dabra"), list(b"zzzzz"), list(b"xxabr")):
        assert sum(10 ** model.log(context, s) for s in range(257)) == pytest.approx(1.0)


def test_empty_table_and_no_training(docs):
    assert ppm.score(docs([])).count() == 0
    row = next(r for r in ppm.score(docs([(i, "ab") for i in range(40) if crc32(str(i).encode()) % 5 == 1])).collect())
    assert row.held_out and row.n_known == 0 and row.score < 0
