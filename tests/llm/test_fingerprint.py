import hashlib
import random

import numpy as np

from terravane.llm import fingerprint as fp


def test_winnow_keeps_rightmost_minimum_of_each_window():
    rng = random.Random(1)
    for n in (1, 3, 10, 79, 80, 400, 5000):
        text = "".join(rng.choice("ab é") for _ in range(n))
        k = fp.K
        codes = np.array([0x110000] * (k - 1) + [ord(c) for c in text])
        hashes = [int(fp.gram_hashes(codes[i : i + k], k)[0]) >> 32 for i in range(n)]
        w = min(max(4, min(fp.WINDOW, len(hashes) // 8)), len(hashes))
        want = {max(range(i, i + w), key=lambda j: (-hashes[j], j)) for i in range(len(hashes) - w + 1)}
        kept, places = fp.winnow(text)
        assert sorted(want) == places.tolist() and [hashes[i] for i in sorted(want)] == kept.tolist()


def test_shared_passage_leaves_a_common_hash():
    rng = random.Random(2)
    for _ in range(30):
        passage = "".join(rng.choice("abcdefgh ") for _ in range(fp.K + fp.WINDOW - 1))
        a, b = ("".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in "ab")
        assert set(fp.winnow(a + passage)[0]) & set(fp.winnow(passage + b)[0])


def test_near_copies_of_every_length_are_alike():
    rng = random.Random(4)
    for n in (12, 19, 20, 21, 40, 60, 64, 76, 79, 80, 85, 300):
        for _ in range(5):
            text = "".join(rng.choice("abcdefgh ") for _ in range(n))
            other = "".join(rng.choice("abcdefgh ") for _ in range(n))
            a, b, c = (np.unique(fp.winnow(t)[0]) for t in (text, text + "abcd", other))
            assert fp.likeness(a, b) > 0.5 and fp.likeness(a, c) < 0.3


def test_rows(docs):
    rng = random.Random(3)
    rows = [(9, None), (4, ""), (2, "".join(rng.choice("abc é") for _ in range(300))), (7, "xyz" * 40), (5, "☃"), (1, "long " * 9000), (5, "a")]
    got = {}
    for r in fp.fingerprints(docs([*rows, (None, "lone text")])).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        t, q = t or "", len(t or "") // 4
        edited = t[: len(t) - q] + (following or "")[:q]
        assert any(r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == fp.as_string(fp.winnow(t)) and r.edited_fingerprint == fp.as_string(fp.winnow(edited)) for r in got[i])
    assert sum(map(len, got.values())) == len(rows) + 1
    assert fp.fingerprints(docs([])).count() == 0


def test_likeness_on_documents(spark):
    out = fp.fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).toPandas()
    long = out[out.n_chars > 400]
    assert (long.near_edited > long.near_next).mean() > 0.97 and long.near_edited.mean() > 0.4
