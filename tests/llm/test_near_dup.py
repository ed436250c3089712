import random
import re

from tests.llm.conftest import components
from terravane.llm import near_dup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in ids}


def text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_equals_brute_force(spark, docs):
    rng, rows = random.Random(3), [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "x"), (7, "é a\u00a0b c"), (8, "É a\u00a0b c")]
    base = [text(rng, 150) for _ in range(25)]
    for i, b in enumerate(base):
        rows.append((100 + 40 * i, b))
        for j in range(rng.randrange(1, 12)):
            words = b.split()
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
            rows.append((100 + 40 * i + j + 1, " ".join(words)))
    chain = text(rng, 120).split()
    for j in range(30):  # each near the next, far from the first
        rows.append((5000 + j, " ".join(chain)))
        chain = chain[4:] + [f"c{j}{x}" for x in range(4)]
    rows += [(6000 + j, base[0].upper()) for j in range(20)]
    rows.append((7000, text(rng, 30_000, 5000)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)
    kept = near_dup.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, x in got.items() if x[2]}


def test_null_ids_repeats_and_empty_table(spark, docs):
    same = "a b c d e f g"
    got = near_dup.near_duplicates(docs([(None, same), (3, same), (3, same), (2, "z"), (None, "q r")])).collect()
    want = [("2", "2", True), ("3", "3", True), ("3", "3", True), ("None", "3", False), ("None", "None", True)]
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == want
    assert near_dup.near_duplicates(docs([])).count() == 0


def test_one_row_of_each_group_is_kept(docs):
    same, lone = "a b c d e f g", "h i j k l m n"
    rows = [(None, same), (3, same), (3, same), (3, same.upper()), (3, "other text of the id"), (2, "z"), (None, "q r"), (None, lone), (None, lone), (7, ""), (7, ""), (None, None)]
    out = near_dup.keep_one(docs(rows))
    assert out.columns == docs(rows).columns
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in out.collect())
    assert got == sorted([("3", same), ("3", "other text of the id"), ("2", "z"), ("None", "q r"), ("None", lone), ("7", ""), ("7", ""), ("None", "")])


def test_stage_links_from_four_fifths_on(spark, docs):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]  # 100 shingles
    at = lambda n: " ".join(words[: n + 4])  # noqa: E731  n of them
    rows = [(1, at(100)), (2, at(80)), (3, "x " + at(79)), (4, at(62))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()) == [1, 4]
    assert sorted(r.doc_id for r in near_dup.keep_one(docs(rows)).collect()) == [1, 2, 4]
    assert near_dup.banding(85) == (21, 6) and near_dup.banding(80) == (25, 5)


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    s = near_dup.signatures([np.unique(a), np.unique(b)])
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.12
