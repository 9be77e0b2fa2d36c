"""Embedding whitening by weighted multiplicity covariance: identical vectors are grouped and whitened once.

Vectors become exact integers, so that identical ones can be found. The distinct vectors with their weights give the sums,
then the weighted covariance of the centred vectors, both as one small matrix per task. Its eigenvectors whiten each
distinct vector once, and rows get the answer of their vector by a join on its bytes.
"""

from __future__ import annotations

import sys
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.centroids import scaled
from murmuration.llm.common import Tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LARGEST = 1 << 50  # of a scaled entry
WIDTHS = ("<i2", "<i4", "<i8")
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _packed(x: np.ndarray) -> bytes:
    """A vector's entries in the fewest of 2, 4 or 8 bytes each that hold all of them; the first byte says which."""
    for code, width in enumerate(WIDTHS):
        if not len(x) or (np.iinfo(width).min <= x.min() and x.max() <= np.iinfo(width).max):
            return bytes([code]) + x.astype(width).tobytes()
    raise AssertionError("entries have 64 bits")


def _opened(keys: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(key, dtype=WIDTHS[key[0]], offset=1) for key in keys]).astype(np.int64)


def _keys(batches):
    for batch in batches:
        fits, rows = scaled(batch.column(1), SCALE, LARGEST)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(pa.array(fits)), pa.array([len(x) for x in rows], pa.int32()), pa.array(map(_packed, rows), pa.binary())],
            names=["vec_id", "size", "key"])


def _moments(batches):
    """Exact sum of every dimension of the distinct vectors that a task has seen, and the sum of their weights."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x, weight = _opened(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            own = (x.astype(object) * weight[:, None].astype(object)).sum(axis=0)
            total, n = own if total is None else total + own, n + int(weight.sum())
    total = [] if total is None else total.tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0)), pa.array([n] * len(total), pa.int64())],
        names=["i", "total", "n"])


def _partial(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(matrix.shape, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(matrix.ravel())], names=["i", "j", "value"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # size x size numbers
        out[r["i"], r["j"]] = r["value"]
    return out


def _products(mean: np.ndarray):
    """Weighted products of the centred vectors: one matrix per task."""

    def run(batches):
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                centred = _opened(batch.column(0).to_pylist()) - mean
                total += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        yield _partial(total)

    return run


def _whitened(n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray):
    """``key, weight, deviation, whitened`` of every distinct vector."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _opened(batch.column(0).to_pylist())
            size = float(n) * np.abs(x).max() + max(map(abs, sums))
            kind = np.int64 if size * size * len(sums) < 2.0 ** 62 else object
            off = n * x.astype(kind) - np.array(sums, dtype=kind)
            deviation = [d if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()]
            white = (x - mean) @ axes
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))],
                names=["key", "weight", "deviation", "whitened"])

    return run


def _squares(width: int):
    """Weighted products of the whitened vectors, which are centred: they are projections of centred vectors."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                z = batch.column(1).flatten().to_numpy().reshape(-1, width)
                total += (z * batch.column(0).to_numpy()[:, None]).T @ z
        yield _partial(total)

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """``RESULT``: one row per row of ``vectors(vec_id, embedding)`` and component, the components by falling variance.

    An entry c becomes x = floor(64 c) + 1,000,000. The model is fitted on the distinct x vectors, each weighing ``one`` or
    its ``counts``; n is the sum of the weights, S that of the vectors. ``whitened`` is x - S / n on the component's unit
    eigenvector over the root of its eigenvalue, ``explained`` the eigenvalue's share of all variance, ``deviation`` the
    exact sum of (n x - S)^2 and ``identity_error`` the largest entry of the whitened vectors' covariance less the identity.

    The driver holds one matrix of dimension x dimension, made of one per task. A vector that a third of all rows repeat is
    one row per task in the grouping; the join back splits it at run time.

    Rows whose vector is null or holds null or non-finite entries are left out, and so are vectors of another length than
    the commonest (of equals the longest) and empty ones. There are as many components as dimensions, if those are fewer.
    A component without variance has ``whitened`` 0 and takes no part in ``identity_error``; without any variance all shares
    are 0. Scaled entries beyond +-2^50 count as that bound, and a deviation beyond 64 bits is null. Null ids stay null,
    repeated rows are answered each, extra columns are ignored, and no rows give no rows.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    rows = tables.put("keys", vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), "embedding")
                      .mapInArrow(_keys, "vec_id long, size int, key binary"))
    sizes = rows.where("size > 0").groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.col("size") == sizes[0]["size"]).drop("size")
    weight = {"one": F.lit(1).cast("long"), "counts": F.col("count")}[weights]
    distinct = tables.put("distinct", rows.groupBy("key").count().select("key", weight.alias("weight")))
    moments = (distinct.mapInArrow(_moments, "i int, total decimal(38,0), n long").groupBy("i")
               .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("i").collect())  # a row per dimension
    n, sums = int(moments[0]["n"]), [int(r["total"]) for r in moments]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    covariance = _summed(distinct.mapInArrow(_products(mean), "i int, j int, value double"), len(sums)) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    width = min(components, len(sums))
    varies = values[:width] > 1e-12 * len(sums) * values[0]
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values[:width], 1.0)), 0.0)
    # x = y + OFFSET and S = S_y + n OFFSET: all differences are the same without the offset.
    white = tables.put("white", distinct.mapInArrow(
        _whitened(n, sums, mean, axes[:, :width] * scale), "key binary, weight long, deviation long, whitened array<double>"))
    tables.drop("distinct")
    square = _summed(white.select("weight", "whitened").mapInArrow(_squares(width), "i int, j int, value double"), width) / n
    error = np.abs(square - np.diag(varies.astype(float))).max()
    trace = values.sum()
    explained = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in values[:width]])
    return (rows.join(white.drop("weight"), "key")
            .select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
            .select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(float(error)).alias("identity_error")))
