"""Embedding whitening: Spark MLlib's ``computeSVD`` over centred distributed rows.

Entries become whole numbers, so sums and deviations are exact. Each distinct
vector is fitted once: the distinct vectors, less their means, are the rows of a
``RowMatrix``. Its Gram matrix is summed over the executors and decomposed as a
matrix of dimension by dimension; a squared singular value over the number of
rows is a component's variance, a right singular vector the component. The
total variance comes from the exact deviations, not from the decomposition, so
that one can be held against the other. The driver holds that matrix and no row.

Rows are projected, and the whitened fit list is measured, in numpy over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Scratch, tidied

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Whole numbers from here on are not exact in double precision.
_EXACT = float(2**53)
#: Singular values under this share of the largest are rounding errors of the Gram matrix.
RCOND = 1e-6
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"
_LIMB = 26


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < _EXACT))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """Exact sum of each dimension over the fit list."""

    def part(batches):
        total = [0] * dims
        for b in batches:
            x = _matrix(b.column(0), dims)
            high, low = x >> _LIMB, x & ((1 << _LIMB) - 1)
            total = [t + (int(h) << _LIMB) + int(s) for t, h, s in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], names=["d", "s"])

    rows = fit.mapInArrow(tidied(part), "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r.d: int(r.s) for r in rows.collect()}
    return [found.get(d, 0) for d in range(dims)]


def deviations(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> list[int]:
    """Exact sum over dimensions of (n*x - S)^2 for each row of ``x``, where S = n*base + rest."""
    if not len(x):
        return []
    off = x - base
    most = n * (int(np.abs(off).max()) + 1)
    if most * most * x.shape[1] < 2**63:
        a = off * n - rest
        return (a * a).sum(axis=1).tolist()
    if most < 2**52 and x.shape[1] < 512:
        # squares of numbers of two limbs, each sum still within 64 bits
        a = np.abs(off * n - rest)
        high, low = a >> _LIMB, a & ((1 << _LIMB) - 1)
        parts = ((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist())
        return [(h << 2 * _LIMB) + (m << _LIMB + 1) + s for h, m, s in zip(*parts, strict=True)]
    shift = [int(r) for r in rest]
    return [sum((n * o - r) ** 2 for o, r in zip(row, shift, strict=True)) for row in off.astype(object)]


def _centred(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n in double precision; the whole part is taken off exactly."""
    return (x - base).astype(float) - rest / n


def _total_variance(fit: DataFrame, n: int, base: np.ndarray, rest: np.ndarray) -> float:
    """Trace of the covariance, from the exact deviations of the fit list."""

    def part(batches):
        total = sum(sum(deviations(_matrix(b.column(0), len(base)), n, base, rest)) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([total / n / n / n])], names=["v"])

    return fit.mapInArrow(tidied(part), "v double").agg(F.sum("v")).first()[0]


def _identity_error(fit: DataFrame, n: int, base: np.ndarray, rest: np.ndarray, to: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity; centred before multiplying."""
    k = to.shape[1]

    def summed(of, size):
        def part(batches):
            total = np.zeros(size)
            for b in batches:
                total += of(_centred(_matrix(b.column(0), len(base)), n, base, rest) @ to).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "v"])

        out = np.zeros(size)
        for r in fit.mapInArrow(tidied(part), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v / n
        return out

    mean = summed(lambda w: w.sum(axis=0), k)
    return float(np.abs(summed(lambda w: (w - mean).T @ (w - mean), k * k).reshape(k, k) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row and component.

    Rows are dropped whose vector is null or holds null or non-finite entries,
    or entries of 2^53 / 64 or more, which have no exact whole number. Vectors
    must be as long as most are (of equally frequent lengths the longest
    counts); others, and empty ones, are dropped too. Components number at most
    the dimensions whose variance is over 1e-12 of the largest: none, and no
    rows, for an empty table or where all vectors are equal. Equal variances
    are numbered as the decomposition gives them; each component points to
    where its largest entry (the first of equal ones) is positive. Null and
    repeated ids are returned as they come, repeated vectors are fitted once;
    other columns are ignored, whatever their names. ``deviation`` is null
    where it exceeds a long.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, {_OUT}"
    rows = scratch.keep(embeddings.where(_usable(F.col("embedding"))).select("vec_id", _whole(F.col("embedding")).alias("x")), "rows")
    lengths = rows.where("size(x) > 0").groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths.dims
    rows = rows.where(F.size("x") == dims)
    fit = scratch.keep(rows.select("x").distinct(), "fit")
    n = fit.count()
    sums = _sums(fit, dims)
    base = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    total = _total_variance(fit, n, base, rest)
    if not total:
        return spark.createDataFrame([], schema)

    off = F.zip_with("x", F.array(*[F.lit(int(b)).cast("long") for b in base]), lambda x, b: (x - b).cast("double"))
    off = F.zip_with(off, F.array(*[F.lit(float(r / n)) for r in rest]), lambda x, r: x - r)
    centred = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(off).alias("v")), "v")
    # all singular values are asked for: MLlib then decomposes the Gram matrix itself and not by iterations that stop at 1e-10
    svd = RowMatrix(centred, n, dims).computeSVD(dims, computeU=False, rCond=RCOND)
    variances = np.asarray(svd.s.toArray()) ** 2 / n
    k = min(components, len(variances))
    axes = np.asarray(svd.V.toArray())[:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    to, explained = axes / np.sqrt(variances[:k]), variances[:k] / total
    error = _identity_error(fit, n, base, rest, to)

    def project(batches):
        for b in batches:
            x, m = _matrix(b.column(1), dims), b.num_rows
            dev = pa.array([d if d < 2**63 else None for d in deviations(x, n, base, rest)], pa.int64())
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)),
                    dev.take(pa.array(each)),
                    pa.array((_centred(x, n, base, rest) @ to).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(tidied(project), schema)
