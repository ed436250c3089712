import hashlib
import random
from collections import Counter

from terravane.llm import suffix_dedup


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + 200] for _, d in data for k in range(len(d) - 199))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        flat = bytes(gone)
        spans = len([x for x in flat.split(b"\0") if x])
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((str(i), len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(docs, rows, **more):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs(rows), **more).collect())
    assert got == brute(rows)


def noise(rng, n, letters="abcdefghijklmnop é"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_equals_brute_force(docs):
    rng = random.Random(5)
    passage, other = noise(rng, 260), noise(rng, 500)
    rows = [(1, None), (2, ""), (3, "short"), (None, "short")]
    for i in range(30):
        rows.append((10 + i, noise(rng, rng.randrange(50, 900)) + passage[: rng.randrange(190, 260)] + noise(rng, 120)))
    for i in range(8):
        cut = rng.randrange(0, 250)
        rows.append((60 + i, noise(rng, 40) + other[cut : cut + rng.randrange(150, 250)] + noise(rng, 40)))
    twice = noise(rng, 240)
    rows += [(80, twice + noise(rng, 30) + twice), (81, other), (81, other), (82, "x" * 450), (83, "ab" * 150 + noise(rng, 50) + "ab" * 130), (84, "x" * 199), (85, "y" * 200), (86, "z" * 201)]
    rows.append((90, noise(rng, 20_000) + passage + noise(rng, 20_000)))
    check(docs, rows)


def test_many_versions_of_one_anchor_are_compared_by_hash(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_RUNS", 5)
    rng = random.Random(6)
    passage = noise(rng, 230)
    rows = [(i, noise(rng, 150) + passage[i % 20 : 205 + i % 25] + noise(rng, 150)) for i in range(60)]
    check(docs, rows, batches=5)


def test_levels_merge_geometrically_and_results_do_not_depend_on_batches(docs, spark):
    rng = random.Random(16)
    passage = noise(rng, 300)
    rows = [(i, noise(rng, 150) + (passage[i % 40 : 230 + i % 60] if i % 3 else "") + noise(rng, 150)) for i in range(70)] + [(100, passage), (101, passage), (102, None)]
    check(docs, rows, batches=11)
    scratch = suffix_dedup.Scratch(spark)
    index = suffix_dedup.SuffixIndex(scratch)
    sizes, entries = [], 0
    for i in range(9):
        grams = [(bytes([i, j]) * 16,) for j in range(3)] + [(b"x" * 32,)] * (2 if i == 4 else 1)
        index.add(spark.createDataFrame(grams, "gram binary"))
        sizes.append([n for n, _, _ in index.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1], [4, 2, 1, 1], [8, 1]]
    for _, name, path in index.levels:
        entries += spark.table(name).count()
        for part in sorted(spark.table(name).inputFiles()):
            held = [bytes(r.gram) for r in spark.read.parquet(part).collect()]
            assert held == sorted(held) and len(set(held)) == len(held)
    assert entries == 8 * 3 + 1 + 3 + 1 and {bytes(r.gram) for r in index.found().collect()} == {b"x" * 32}
    names = [name for _, name, _ in index.levels]
    index.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_suffix_ranks_are_by_content():
    import numpy as np

    rng = random.Random(17)
    part = bytes(rng.randrange(3) for _ in range(700))
    raw = part + bytes(rng.randrange(256) for _ in range(400)) + part[100:420] + b"\0" * 500 + part[300:520]
    places = np.arange(len(raw) - 199)
    seen = Counter(raw[i : i + 200] for i in places.tolist())
    ranks = suffix_dedup.suffix_ranks(np.frombuffer(raw, np.uint8), places).tolist()
    again = sorted({raw[i : i + 200] for i in places.tolist() if seen[raw[i : i + 200]] > 1})
    assert len(again) > 100
    for i in places.tolist():
        text = raw[i : i + 200]
        assert (ranks[i] >= 0) == (seen[text] > 1)
    assert sorted({(r, raw[i : i + 200]) for i, r in enumerate(ranks) if r >= 0}) == [(r, t) for r, t in zip(sorted({r for r in ranks if r >= 0}), again, strict=True)]


def test_texts_over_a_mebibyte(docs):
    rng = random.Random(18)
    unit = noise(rng, 50_000)
    passage = noise(rng, 400)
    long = [noise(rng, 40_000) + "".join(chr(97 + rng.randrange(26)) for _ in range(1_100_000)) for _ in range(2)]
    rows = [(1, long[0] + passage + unit), (2, unit[:30_000] + long[1] + passage[50:]), (3, passage), (4, long[0][1_040_000:1_060_000]), (None, "")]
    data = {i: (t or "").encode() for i, t in rows}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs(rows)).collect()}
    cut = lambda d, *spans: b"".join(d[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(d)]))
    one, two, mid = data[1], data[2], data[4]
    first = [(one.index(mid), one.index(mid) + len(mid)), (len(long[0].encode()), len(long[0].encode()) + len((passage + unit[:30_000]).encode()))]
    second = [(0, len(unit[:30_000].encode())), (len((unit[:30_000] + long[1]).encode()), len(two))]
    for i, spans in ((1, first), (2, second), (3, [(0, len(data[3]))]), (4, [(0, len(mid))]), (None, [])):
        d = data[i]
        assert got[i] == (len(d), sum(e - s for s, e in spans), len(spans), hashlib.sha256(cut(d, *spans)).hexdigest()), i


def test_strip_keeps_rows_and_columns(docs):
    rows = [(1, "é" * 150), (2, "é" * 150), (3, None), (4, "plain")]
    out = suffix_dedup.strip_repeats(docs(rows))
    assert out.columns == docs(rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "", 2: "", 3: None, 4: "plain"}
    assert suffix_dedup.digests(docs([])).count() == 0


def test_a_text_that_repeats_its_own_lines(docs):
    rng = random.Random(7)
    for period in (168, 169, 170):
        line = noise(rng, period, "abcdefghijklmnop ")
        check(docs, [(1, (line * 6)[:1000]), (2, noise(rng, 90) + line * 2 + line[:31] + noise(rng, 90)), (3, None)])
        check(docs, [(1, (line * 6)[:1000]), (2, noise(rng, 300))])


def test_anchors_meet_when_joins_become_broadcasts_while_they_run(docs, spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_RUNS", 5)
    rng = random.Random(23)
    many = noise(rng, 230)
    rows = [(1000 + i, noise(rng, 150) + many[i % 5 : 205 + i] + noise(rng, 150)) for i in range(20)]
    for i in range(0, 120, 2):
        passage = noise(rng, 230)
        rows += [(j, noise(rng, 150) + passage + noise(rng, 150)) for j in (i, i + 1)]
    conf = {"autoBroadcastJoinThreshold": "1", "adaptive.autoBroadcastJoinThreshold": "10m", "adaptive.coalescePartitions.enabled": "false", "files.maxPartitionBytes": "4k", "files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        check(docs, rows, batches=2)
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_blocks_of_small_anchors_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(24)
    raw = [rng.randbytes(330) for _ in range(9000)]
    kinds = {"gram": pa.binary(), "single": pa.bool_(), "th": pa.binary(), "start": pa.int64(), "data": pa.binary()}
    batches = []
    for a in range(0, len(raw), 1000):
        rows = [[b"%032d" % (i // 3) for i in range(a, a + 1000)], [True] * 1000, [b"t" * 16] * 1000, list(range(a, a + 1000)), raw[a : a + 1000]]
        batches.append(pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds.values(), strict=True)], names=list(kinds)))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in suffix_dedup._compare(iter(batches))) == 0
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 100e6


def test_a_batch_is_scanned_against_all_levels_in_one_pass(spark):
    index = suffix_dedup.SuffixIndex(suffix_dedup.Scratch(spark))
    try:
        for i in range(4):
            index.add(spark.createDataFrame([(bytes([i, j]) * 16,) for j in range(40)] + [(b"x" * 32,)], "gram binary"))
        assert [n for n, _, _ in index.levels] == [2, 1, 1]
        assert [x.count() for x in index.again] == [0, 1, 1, 1]
        assert all(len(x.inputFiles()) <= -(-index.buckets // 4) for x in index.again)
    finally:
        index.close()
