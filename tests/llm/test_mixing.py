import re
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from terravane.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Clamp and reshare until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("counts", [{"a": 400, "b": 60, None: 90, "é": 5, "Z": 300}, {"a": 10}, {"a": 50, "b": 50, "c": 50}])
def test_targets_and_taken(spark, counts):
    rows, i = [], 0
    for s, n in counts.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * (i * 7 % 40)) + ("\n x\ty" if i % 3 else ""), s, "clash"))
            i += 1
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    total, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        total[r[2]] += size[r[0]]
    expected = brute_targets(total)
    for r in out:
        s = rows[r.doc_id][2]
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s])
        assert r.target == pytest.approx(expected[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 1 + counts[s] * 0.01
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_nulls_empty_and_repeated(spark):
    rows = [(None, None, None, None), (1, "", "a", None), (1, "x y", "a", None), (1, "x y", "a", None), (2, "   ", "b", None)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5
    assert sorted(r["size"] for r in out) == [0, 0, 1, 2, 2]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text_counts_whole(spark):
    rows = [(1, "w " * 700_000, "a", None), (2, "w", "a", None), (3, "w w", "b", None)]
    got = {r.doc_id: (r["size"], r.source_size, r.target) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1][:2] == (700_000, 700_001) and got[3][:2] == (2, 2) and got[3][2] == 4.0


def test_repeat_rows_keeps_columns_and_targets(spark):
    rows = [(i, "w " * 20, "a" if i % 4 else "b", str(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    got = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    expected = brute_targets({"a": 300 * 20, "b": 100 * 20})
    for s in got:
        assert abs(got[s] * 20 - expected[s]) <= 20
    assert mixing.repeat_rows(spark.createDataFrame([], SCHEMA)).count() == 0
