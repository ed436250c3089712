"""Whitening against numpy's eigenvectors, and exact deviations against Python's whole numbers."""

import numpy as np
import pytest

from terravane.llm import whitening

SF = "/root/testdata/sf0.01"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(vectors, k):
    """n, deviations, whitened rows and explained shares."""
    x = np.array([[int(np.floor(64.0 * float(c))) + 1000000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, dev, (x - sums / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def equal(out, ids, vectors, k):
    n, dev, want, explained = brute(vectors, k)
    out = out.sort_values("vec_id", kind="stable")
    assert list(out.columns) == COLUMNS and len(out) == k * len(ids)
    assert set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-8
    assert out.component.tolist() == list(range(1, k + 1)) * len(ids)
    order = np.argsort(ids, kind="stable")
    assert out.deviation.tolist() == [dev[i] for i in order for _ in range(k)]
    assert np.allclose(out.explained.to_numpy().reshape(-1, k), explained, rtol=1e-9)
    got = out.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((got * want[order]).sum(axis=0))
    assert np.abs(got - sign * want[order]).max() < 1e-6


def test_equals_numpy_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    equal(whitening.whiten(table).toPandas(), [i for i, _ in good], [v for _, v in good], 16)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for i in range(60)]
    good += [(100 + i, good[7][1]) for i in range(30)] + [(7, good[7][1])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0, 2.0]), (206, [1e300, 0.0, 0.0, 0.0, 0.0])]
    extra = "x string, n string, component string, `a.b` string"
    table = spark.createDataFrame([(i, v, "?", "?", "?", "?") for i, v in good + bad], f"vec_id long, embedding array<double>, {extra}")
    equal(whitening.whiten(table).toPandas(), [i for i, _ in good], [v for _, v in good], 5)
    lost = whitening.whiten(table.selectExpr("if(vec_id = 3, null, vec_id) vec_id", "embedding")).toPandas()
    assert lost.vec_id.isna().sum() == 5


def test_dependent_dimensions_have_no_components_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(a), 2.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, size=(40, 2)))]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    equal(out, [i for i, _ in rows], [v for _, v in rows], 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_tables_without_variance_give_no_rows(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.columns == COLUMNS and out.count() == 0


def test_deviations_are_exact_at_every_size():
    rng = np.random.default_rng(5)
    for n, wide in ((3, 100), (10**6, 10**4), (10**9, 10**3), (10**9, 10**9), (10**12, 10**15)):
        base = rng.integers(10**6, 2 * 10**6, size=7)
        rest = rng.integers(0, n, size=7)
        x = base + rng.integers(-wide, wide, size=(20, 7))
        want = [sum((n * (int(a) - int(b)) - int(r)) ** 2 for a, b, r in zip(row, base, rest, strict=True)) for row in x]
        assert whitening.deviations(x, n, base, rest) == want


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2.0**44 * (i % 2)), float(i)]) for i in range(4)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.count() and out.where("deviation is not null").count() == 0
