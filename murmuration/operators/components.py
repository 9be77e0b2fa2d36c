"""Connected components by randomised contraction, after Boegeholz, Brand and Todor (ICDE 2020).

Every round ranks the vertices at random. A vertex moves to the lowest-ranked vertex within two steps, and the edges are
rewritten accordingly. The graph shrinks by a constant factor per round in expectation, whatever its shape, so long
paths and large stars need few rounds alike. The moves are composed backwards at the end, smallest table first.

A contracted graph of at most ``MAX_PAIRS_IN_TASK`` pairs is finished by one task, which saves the rounds that have little
to do.

The joins here are of edges with one row per vertex. The latter is stored first: a side that is an aggregate on the join
key would be joined without a shuffle of its own, and adaptive skew-join handling splits a vertex that owns many of the
edges only where both sides are shuffled. The aggregates combine before they shuffle.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.session import durable, durable_with

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

MAX_PAIRS_IN_TASK = 500_000


def _undirected(edges: DataFrame) -> DataFrame:
    return (edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
            .where("a <> b").distinct())


def _moves(pairs: DataFrame, seed: int) -> DataFrame:
    """``id, rep``: the lowest-ranked vertex within two steps of ``id``, itself included."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("nbr")),
        F.struct(F.col("b").alias("id"), F.col("a").alias("nbr")),
    )).alias("end")).select("end.*")

    def rank(vertex: str) -> Column:
        # As text, the seed is not part of the generated code, which is then compiled once for all rounds.
        return F.xxhash64(vertex, F.lit(str(seed)))

    best = ends.groupBy("id").agg(F.min_by("nbr", rank("nbr")).alias("best"))
    nearest = durable(best.select(F.col("id").alias("nbr"),
                                  F.when(rank("best") < rank("id"), F.col("best")).otherwise(F.col("id")).alias("seen")))
    # The choices of all neighbours include the best of the vertex's own neighbours: they see at least themselves.
    return (ends.join(nearest, "nbr").groupBy("id").agg(F.min_by("seen", rank("seen")).alias("seen"))
            .select("id", F.when(rank("seen") < rank("id"), F.col("seen")).otherwise(F.col("id")).alias("rep")))


def lowest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the lowest id of each one's component: trees are hooked to lower ones and flattened until no edge is between two."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = ends[:len(a)], ends[len(a):], np.arange(len(ids))
    while len(a):
        a, b = label[a], label[b]
        between = a != b
        a, b = a[between], b[between]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def _finished(pairs: DataFrame) -> DataFrame:
    """``id, rep`` of few pairs, found by one task."""
    def run(batches):
        rows = [batch for batch in batches if batch.num_rows]
        if rows:
            ends = pa.Table.from_batches(rows)
            found = lowest_labels(ends.column("a").to_numpy(), ends.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in found], names=["id", "rep"])

    long = [F.col(c).cast("long").alias(c) for c in ("a", "b")]
    return pairs.select(*long).repartition(1).mapInArrow(run, "id long, rep long")


def connected_components(vertices: DataFrame, edges: DataFrame, seed: int = 0,
                         max_in_task: int = MAX_PAIRS_IN_TASK) -> DataFrame:
    """``id, component`` for every vertex and edge end; the label is the lowest id of the component."""
    n = F.count(F.lit(1))
    pairs, seen = durable_with(_undirected(edges), n=n)
    rounds: list[DataFrame] = []
    while seen["n"]:
        if seen["n"] <= max_in_task:
            rounds.append(durable(_finished(pairs)))
            break
        moves = durable(_moves(pairs, seed + len(rounds)))
        rounds.append(moves)
        moved = (pairs
                 .join(moves.select(F.col("id").alias("a"), F.col("rep").alias("src")), "a")
                 .join(moves.select(F.col("id").alias("b"), F.col("rep").alias("dst")), "b"))
        pairs, seen = durable_with(_undirected(moved), n=n)
    everyone = vertices.select("id")
    if not rounds:
        return everyone.select("id", F.col("id").alias("component"))
    final = rounds.pop()
    while rounds:
        later = final.select(F.col("id").alias("rep"), F.col("rep").alias("last"))
        final = (rounds.pop().join(later, "rep", "left")
                 .select("id", F.coalesce("last", "rep").alias("rep")))
    final = durable(final)
    lowest = durable(final.groupBy("rep").agg(F.min("id").alias("component")))
    linked = final.join(lowest, "rep").select("id", "component")
    return everyone.join(linked, "id", "full").select("id", F.coalesce("component", "id").alias("component"))
