"""Held-out quality of what is learned, on the given tables, and defined results of odd rows."""

import random
from zlib import crc32

import numpy as np
import pytest

from terravane.llm import language, lattice, quality, url_filter
from tests.llm.conftest import components

DATA = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.3)).all()
    held = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.9


def test_quality_of_odd_rows(spark, docs):
    rows = [(1, None), (None, ""), (2, "☃"), (3, "a " * 50_000), (3, "a " * 50_000)]
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id long, quality int")
    out = quality.score(docs(rows), labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.score(docs([]), labels).count() == 0
    assert quality.keep_good(docs(rows), labels).columns == docs(rows).columns


def test_texts_are_rejected_not_ids(spark, docs):
    good = [f"The house number {i} stands by the river and has a garden." for i in range(102)]
    junk = [f"$$$ ### {i} @@@ !!! %%% ### {i} &&&" for i in range(102)]
    rows = [(2 * i, good[i]) for i in range(100)] + [(2 * i + 1, junk[i]) for i in range(100)]
    rows += [(None, good[100]), (None, junk[100]), (500, good[101]), (500, junk[101])]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    assert sorted(r.text for r in quality.keep_good(docs(rows), labels).collect()) == sorted(good)


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language.identify(docs).toPandas().merge(docs.select("doc_id", "lang", "n_chars").toPandas(), on="doc_id")
    assert (out.held_out == [crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    held = out[out.held_out & out.lang.notna() & (out.n_chars > 50)]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_language_of_odd_rows(docs):
    rows = [(i, "alpha beta gamma" if i % 2 else "один два три", "en" if i % 2 else "ru") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "en"), (None, "alpha beta", None), (104, "три " * 100_000, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(rows)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[None][0] == "en" and got[104][0] == "ru"
    assert language.identify(docs([])).count() == 0
    assert {r.lang_pred for r in language.identify(docs([(1, "abc", None)])).collect()} == {"und"}


def test_every_language_is_learned_from(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "MAX_TEXTS", 60)
    rows = [(i, f"{chr(97 + i % 30 % 26)} text number {i}", f"l{i // 100:02}") for i in range(3000)] + [(None, "no id here", "zz")] * 50
    langs, _ = language.train(docs(rows).coalesce(1))
    assert langs == [f"l{i:02}" for i in range(30)] + ["zz"]


def test_url_rules_and_model(spark):
    rows = [
        (1, "http://www.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "http://example.com", "example.com", "", None, None),
        (4, "http://x.net/es/1#a", "x.net", "/es/1", "net/es/", "block"),
        (5, "http://notcom/", "notcom", "/", None, None),
        (6, "no scheme", "", "", None, None),
        (7, None, "", "", None, None),
        (8, "ftp://x://y/z", "x:", "//y/z", None, None),
        (9, "://com/", "com", "/", "com/", "allow"),
        (9, "://com/", "com", "/", "com/", "allow"),
        (None, "http://q.NET/FR/", "q.net", "/FR/", None, None),
    ]
    frame = spark.createDataFrame([(r[0], r[1], "h", "a") for r in rows], "page_id long, url string, html string, action string")
    got = url_filter.judge(frame).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    for want in rows:
        assert any((r.page_id, r.host, r.path, r.rule) == (want[0], *want[2:5]) and (want[5] is None or r.verdict == want[5]) for r in got), want
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_url_models_separate_unseen_urls(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h{rng.randrange(99)}.{'com' if i % 2 else 'net'}/{'fr' if i % 2 == 0 else 'en'}/{'spam' if i % 2 == 0 else 'good'}{rng.randrange(999)}") for i in range(600)]
    rows += [(1000 + i, f"http://h{i}.org/{'spam' if i % 2 else 'good'}{i}") for i in range(40)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert np.mean([(got[1000 + i] == "block") == (i % 2 == 1) for i in range(40)]) > 0.9


def brute_links(vectors):
    good = {i: np.array(v, float) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    unit = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = unit @ unit.T >= 0.9
    return [(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids) if x < y and near[x, y]]


@pytest.mark.parametrize("seed", [1, 2])
def test_lattice_recall(spark, seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for size in (1, 1, 2, 3, 5, 40, 120):
        for _ in range(8 if size < 10 else 1):
            centre = rng.normal(size=64)
            for _ in range(size):
                rows.append((i, (centre + rng.normal(size=64) * rng.choice([0.02, 0.15, 0.3])).tolist()))
                i += 1
    rows += [(i + j, rows[0][1]) for j in range(30)]
    rows += [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [None] + [1.0] * 63), (9004, []), (9005, [1e-30] * 64), (9006, [1e30] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in lattice.near_duplicates(frame).collect()}
    links = brute_links([r for r in rows if r[1]])
    assert len(got) == len(rows)
    assert 0.95 * 2 * len(links) <= sum(r.n_links for r in got.values()) <= 2 * len(links)
    want = components([r[0] for r in rows], links)
    assert np.mean([got[k].component_id == v for k, v in want.items()]) > 0.97
    assert all(got[9000 + j].n_links == 0 and got[9000 + j].kept for j in range(5)) and got[9005].n_links == 1
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


def test_lattice_of_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [-4.0, 3.0, -2.0, 1.0]
    edge = [1.0, 0.001, 0.0, 0.0]
    rows = [(5, v), (5, v), (None, v), (3, [2 * x for x in v]), (7, w), (7, [1.0, 0.0, 0.0, 0.0]), (9, edge), (None, w[:3]), (11, None), (None, None)]
    names = ("cls", "key", "leader", "component", "a", "b", "n", "m", "vec", "keys", "home", "cosine", "c")
    frame = spark.createDataFrame([(*r, *["?"] * len(names)) for r in rows], f"vec_id long, embedding array<double>, {', '.join(f'{n} string' for n in names)}")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.near_duplicates(frame).collect())
    want = [("5", 3, "3", False), ("5", 3, "3", False), ("None", 3, "3", False), ("3", 3, "3", True), ("7", 0, "7", True), ("7", 1, "7", True), ("9", 1, "7", False), ("None", 0, "None", True), ("11", 0, "11", True), ("None", 0, "None", True)]
    assert got == sorted(want)


def test_quality_of_an_id_with_several_texts(spark, docs):
    good = [(i, f"The house number {i} stands by the river and has a garden.") for i in range(0, 200, 2)]
    junk = [(i, f"$$$ ### {i} @@@ !!! %%% ### {i} &&&") for i in range(1, 200, 2)]
    twice = [(i, t) for i, _ in good[:30] for t in ("x", "y z")]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    runs = [sorted((r.doc_id, r.score) for r in quality.score(docs(rows).repartition(n), labels).collect()) for n, rows in ((1, good + junk + twice), (5, twice + junk + good))]
    assert runs[0] == runs[1]


def test_lattice_recall_on_the_given_table(spark):
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    links = brute_links(rows)
    found = sum(r.n_links for r in lattice.near_duplicates(frame).collect())
    assert 0.9 * 2 * len(links) <= found <= 2 * len(links)
