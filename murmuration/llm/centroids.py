"""Centroid clustering by an incremental distance matrix: exact integer dot products are kept with every vector.

A vector's squared distance to a centroid is |v|^2 - 2 v.c + |c|^2. The table of a round holds v.c for every centroid; when
centroids move, only the components that changed are multiplied, and the nearest centroid follows from the new products.
"""

from __future__ import annotations

import hashlib
import sys
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import Tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
LARGEST = 1 << 27  # up to which all products and distances of 64 components are exact in 64 bits
STATE = "vec_id long, x array<int>, norm long, dots array<long>, cluster int, distance long"


def scaled(lists: pa.Array, scale: int, largest: int, size: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which lists have entries that are all there and finite (and ``size`` of them), and floor(scale x entry) of each such list."""
    n = pc.list_value_length(lists)
    fits = pc.fill_null(pc.is_valid(n) if size is None else pc.equal(n, size), False).to_numpy(zero_copy_only=False)
    chosen = lists.filter(pa.array(fits))
    flat = chosen.flatten()
    gaps = flat.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    bad = gaps | ~np.isfinite(values)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(chosen).to_numpy(zero_copy_only=False))]).astype(np.int64)
    whole = np.diff(np.concatenate([[0], np.cumsum(bad)])[bounds]) == 0
    with np.errstate(over="ignore"):
        numbers = np.clip(np.floor(scale * np.where(bad, 0.0, values)), -largest, largest).astype(np.int64)
    fits[np.flatnonzero(fits)] = whole
    return fits, [numbers[a:b] for a, b, good in zip(bounds, bounds[1:], whole) if good]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), type=kind))


def _vectors(batches):
    for batch in batches:
        fits, rows = scaled(batch.column(1), SCALE, LARGEST, DIMENSIONS)
        x = np.array(rows, dtype=np.int64).reshape(-1, DIMENSIONS)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), _lists(x, pa.int32())], names=["vec_id", "x"])


def _moved(change: np.ndarray, norms: np.ndarray, first: bool):
    """A round over the kept products; ``change`` is what every centroid has moved by."""
    parts = [(k, at, change[k, at]) for k in range(len(change)) if len(at := np.flatnonzero(change[k]))]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), DIMENSIONS)
            if first:
                norm, dots = (x * x).sum(axis=1), np.zeros((len(x), len(change)), dtype=np.int64)
            else:
                norm, dots = batch.column(2).to_numpy(), _matrix(batch.column(3), len(change))
            for k, at, by in parts:
                dots[:, k] += x[:, at] @ by
            distances = norms - 2 * dots
            nearest = distances.argmin(axis=1)  # the first of equals
            least = norm + distances[np.arange(len(x)), nearest]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(norm), _lists(dots, pa.int64()),
                 pa.array(nearest.astype(np.int32)), pa.array(least)],
                names=["vec_id", "x", "norm", "dots", "cluster", "distance"])

    return run


def _sums(k: int):
    """One row per cluster and component that a task has seen: exact sums."""

    def run(batches):
        total, count = np.zeros((k, DIMENSIONS), dtype=object), [0] * k
        for batch in batches:
            x, cluster = _matrix(batch.column(0), DIMENSIONS), batch.column(1).to_numpy()
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                total[c] += own.sum(axis=0).astype(object)
                count[c] += len(own)
        rows = [(c, i, Decimal(int(total[c, i])), count[c]) for c in range(k) if count[c] for i in range(DIMENSIONS)]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["cluster", "i", "total", "n"])

    return run


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per vector that takes part.

    ``vectors(vec_id, embedding)``: those with exactly ``DIMENSIONS`` entries, none null or not finite, in integers
    floor(``SCALE`` x entry). Centroids start as the ``k`` vectors of the least sha256 of ``1:<vec_id>`` (by their entries
    where an id repeats), move ``rounds`` times to the floor of their vectors' means, and stay where they have none.
    Ties go to the smaller number. All numbers are exact.

    The driver holds k centroids, and k x ``DIMENSIONS`` sums of a round, each made by one row per task.

    Rows that don't fit are left out. A null ``vec_id`` starts no centroid but is assigned; if no row has an id there are
    no centroids and no rows. With fewer vectors than ``k`` there are as many centroids. Integers beyond +-``LARGEST``
    count as that bound. Inertia beyond 64 bits is null. Repeated rows count each; extra columns are ignored; no rows
    give no rows.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    rows = tables.put("vectors", vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), "embedding")
                      .mapInArrow(_vectors, "vec_id long, x array<int>"))
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    starts = rows.where("vec_id is not null").orderBy(order, "x").limit(k).select("x").collect()  # k rows
    centroids = np.array([r["x"] for r in starts], dtype=np.int64).reshape(-1, DIMENSIONS)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    before, state, name = np.zeros_like(centroids), rows, "vectors"
    for round_ in range(rounds + 1):
        moved = _moved(centroids - before, (centroids * centroids).sum(axis=1), round_ == 0)
        state = tables.put(f"round{round_}", state.mapInArrow(moved, STATE))
        tables.drop(name)
        name, before = f"round{round_}", centroids
        if round_ < rounds:
            sums = (state.select("x", "cluster").mapInArrow(_sums(len(centroids)), "cluster int, i int, total decimal(38,0), n long")
                    .groupBy("cluster", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
            centroids = centroids.copy()
            for r in sums.collect():  # k x DIMENSIONS rows
                centroids[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    inertia = {r["cluster"]: int(r["total"]) for r in state.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # at most k rows
    whole = sum(inertia.values())
    about = spark.createDataFrame(
        [(c, own if own < 1 << 63 else None, whole if whole < 1 << 63 else None,
          hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, own in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
