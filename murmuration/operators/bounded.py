"""Connected components that fit into a task, done by one task each.

Rounds over a graph carry a value one step, so long paths need many. What is asked of a component depends on that component
alone: components of at most ``MAX_EDGES`` edges are found by contraction, in few rounds whatever their shape, and sent
to tasks whole, many to a task. Larger ones are left to rounds over links.

Core numbers need no rounds over links: a few vertices with many neighbours often hold a large component together. Without
them it falls apart, and the parts are blocks that tasks peel whole. What blocks must tell each other is asked in rounds.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmuration.operators.components import connected_components
from murmuration.operators.graph import endpoints
from murmuration.session import discard, durable, durable_with

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

MAX_EDGES = 1_000_000
EDGES_PER_PARTITION = 250_000
HUB_NEIGHBOURS = 64  # a vertex with more different neighbours is of no block


@dataclass(frozen=True)
class Parts:
    """Edges of small components and of large ones, if there are any, with their ``component``; and how many edges there are."""

    small: DataFrame
    large: DataFrame | None
    total: int

    def in_tasks(self, work: Callable, schema: str) -> DataFrame:
        """What ``work(src, dst, w)`` returns for the small components' edges, as columns of ``schema``; computed now.

        The arrays hold one or many whole components.
        """
        names = [field.split()[0] for field in schema.split(", ")]

        def run(batches):
            rows = [batch for batch in batches if batch.num_rows]
            if rows:
                found = work(*(column.to_numpy() for column in pa.Table.from_batches(rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in found], names=names)

        partitions = max(-(-self.total // EDGES_PER_PARTITION), self.small.sparkSession.sparkContext.defaultParallelism)
        edges = self.small.repartition(partitions, "component").select("src", "dst", "w")
        return durable(edges.mapInArrow(run, schema))


def by_component(pairs: DataFrame, max_edges: int = MAX_EDGES) -> Parts:
    """Part stored ``pairs(src, dst, w)`` without nulls by the size of their components."""
    labels = durable(connected_components(endpoints(pairs).distinct(), pairs))
    located = durable(pairs.join(labels.withColumnRenamed("id", "src"), "src")
                      .select(*(F.col(name).cast("long").alias(name) for name in ("src", "dst", "w", "component"))))
    sizes = located.groupBy("component").count()
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    discard(labels)
    if (largest or 0) <= max_edges:
        return Parts(located, None, total or 0)
    big = durable(sizes.where(F.col("count") > max_edges).select("component"))
    return Parts(located.join(big, "component", "left_anti"), located.join(big, "component", "left_semi"), total)


def core_numbers_of(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and core numbers of a multigraph."""
    none = np.zeros(0, dtype=np.int64)
    return peeled(np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w]), none, none)[:2]


def peeled(ids: np.ndarray, nbrs: np.ndarray, w: np.ndarray, others: np.ndarray, numbers: np.ndarray,
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and core numbers by links ``ids, nbrs, w``, and the place of each link's id: vertices are peeled off in the order
    of the edge ends they have left. ``others`` are neighbours that are no ids; they go as their ``numbers`` say."""
    ids, at = np.unique(ids, return_inverse=True)
    n, order = len(ids), np.argsort(others)
    inside = np.searchsorted(ids, nbrs)
    inside[inside == n] = 0
    place = n + np.searchsorted(others[order], nbrs)
    nbr = np.where(ids[inside] == nbrs, inside, place)
    numbers = numbers[order]
    order = np.argsort(nbr, kind="stable")
    meets, weight = at[order], w[order]
    first = np.searchsorted(nbr[order], np.arange(n + len(numbers) + 1))
    degree = np.bincount(at, weights=w, minlength=n).astype(np.int64)
    core, left, waits = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), np.ones(len(numbers), dtype=bool)
    k = 0
    while left.any():
        k = max(k, min(int(degree[left].min()), int(numbers[waits].min(initial=np.iinfo(np.int64).max))))
        outside = np.flatnonzero(waits & (numbers <= k))
        waits[outside] = False
        inner = np.flatnonzero(left & (degree <= k))
        gone = np.concatenate([inner, n + outside])
        while len(gone):
            core[inner], left[inner] = k, False
            many = first[gone + 1] - first[gone]
            links = np.repeat(first[gone] - np.cumsum(many) + many, many) + np.arange(many.sum())
            met, where = np.unique(meets[links], return_inverse=True)
            degree[met] -= np.bincount(where, weights=weight[links], minlength=len(met)).astype(np.int64)
            gone = inner = met[left[met] & (degree[met] <= k)]
    return ids, core, at


def core_numbers_in_blocks(pairs: DataFrame, bounds: DataFrame | None = None, max_edges: int = MAX_EDGES,
                           hub_neighbours: int = HUB_NEIGHBOURS) -> DataFrame:
    """``id, core`` of stored ``pairs(src, dst, w)`` without nulls, ``w`` edges each; computed now.

    Vertices with more than ``hub_neighbours`` different neighbours are hubs. Components without them are blocks, many to a task;
    of those with more than ``max_edges`` edges, vertices are dealt to blocks by their hash. A round peels all blocks, as far as
    what it knows of hubs and other blocks' vertices goes, which is bounds from above; these fall until none does. A hub's
    number is the largest h such that neighbours of at least h have h edge ends to it; its neighbours are counted per number by
    the blocks.
    """
    spark = pairs.sparkSession
    pairs = pairs.select(*(F.col(c).cast("long").alias(c) for c in ("src", "dst", "w")))
    ends = pairs.select(F.explode(F.array(*(F.struct(F.col(c).alias("id"), "w") for c in ("src", "dst")))).alias("e")).select("e.*")
    degrees, seen = durable_with(
        ends.groupBy("id").agg(F.count("*").alias("n"), F.sum("w").alias("degree")).withColumn("hub", F.col("n") > hub_neighbours),
        links=F.sum("n"), hubs=F.count_if("hub"))
    blocks = max(-(-(seen["links"] or 0) // (2 * EDGES_PER_PARTITION)), spark.sparkContext.defaultParallelism)
    inner, hubs = pairs, degrees.where("hub").select("id")
    if seen["hubs"]:
        for end in ("src", "dst"):
            inner = inner.join(hubs.withColumnRenamed("id", end), end, "left_anti")
    vertices = degrees.where("not hub").select("id", "n", F.lit(None).cast("long").alias("component"))
    labels = connected_components(vertices.select("id"), inner.select("src", "dst"))
    sized = durable(vertices.drop("component").join(labels, "id"))
    sizes = sized.groupBy("component").agg(F.sum("n").alias("links"))
    big = durable(sizes.where(F.col("links") > 2 * max_edges).select("component", F.lit(True).alias("big")))

    def block(of: str):
        return F.pmod(F.xxhash64(of), F.lit(blocks)).cast("int")

    place = sized.join(big, "component", "left").select("id", F.when(F.col("big"), block("id")).otherwise(block("component")).alias("block"))
    located = pairs
    for end in ("src", "dst"):
        located = located.join(place.select(F.col("id").alias(end), F.col("block").alias(f"{end}_block")), end, "left")
    located = durable(located)
    links = located.select(F.explode(F.array(*(
        F.struct(F.col(f"{a}_block").alias("block"), F.col(a).alias("id"), F.col(b).alias("nbr"), "w", F.col(f"{b}_block").alias("nbr_block"))
        for a, b in (("src", "dst"), ("dst", "src"))))).alias("link")).select("link.*")
    away = links.where("block is not null and (nbr_block is null or nbr_block <> block)")
    partitions = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    uses, used = durable_with(away.select("block", F.col("nbr").alias("id")).distinct(), n=F.count(F.lit(1)))
    start = degrees.join(uses.select("id").unionByName(hubs).distinct(), "id", "left_semi").select("id", "hub", F.col("degree").alias("core"))
    if bounds is not None:
        start = start.join(bounds, "id", "left").select("id", "hub", F.least("core", F.coalesce("bound", "core")).alias("core"))
    state = durable(start)
    between = durable(links.where("block is null and nbr_block is null").select("id", "nbr", "w")) if seen["hubs"] else None
    kept = (links.where("block is not null").select("block", "id", "nbr", "w").repartition(partitions, "block")
            .sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK))
    try:
        while True:
            rows = uses.join(state, "id").select(F.col("block").alias("to_block"), "id", "hub", "core")
            found = durable(kept.groupBy("block").cogroup(rows.groupBy("to_block")).applyInArrow(_peeled_block, "id long, core long, w long"))
            numbers = found.where("w is null").select("id", "core")
            if not used["n"] and not seen["hubs"]:
                return numbers
            after = numbers
            if seen["hubs"]:
                after = after.unionByName(_of_hubs(found.where("w is not null"), between, state))
            moved = state.join(after.withColumnRenamed("core", "now"), "id", "left").select(
                "id", "hub", F.least("core", F.coalesce("now", "core")).alias("core"), F.col("core").alias("before"))
            state, changed = durable_with(moved, n=F.count_if(F.col("core") < F.col("before")))
            state = state.drop("before")
            if not changed["n"]:
                return numbers.unionByName(state.where("hub").select("id", "core"))
            discard(found)
    finally:
        kept.unpersist()


def _of_hubs(met: DataFrame, between: DataFrame, state: DataFrame) -> DataFrame:
    """``id, core`` of hubs from their edge ends ``met(id, core, w)`` per number of a neighbour, and from links ``between`` hubs."""
    other = between.join(state.select(F.col("id").alias("nbr"), "core"), "nbr").select("id", "core", "w")
    ends = met.unionByName(other).groupBy("id", "core").agg(F.sum("w").alias("w"))
    reached = F.least(F.col("core"), F.sum("w").over(Window.partitionBy("id").orderBy(F.desc("core"))))
    return ends.select("id", reached.alias("h")).groupBy("id").agg(F.max("h").alias("core"))


def _peeled_block(links: pa.Table, known: pa.Table) -> pa.Table:
    """Numbers of a block's vertices, and with ``w`` how many edge ends each hub has at vertices of each number."""
    if not links.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("id", "core", "w")})
    nbrs, w = links.column("nbr").to_numpy(), links.column("w").to_numpy()
    others = known.column("id").to_numpy()
    ids, core, at = peeled(links.column("id").to_numpy(), nbrs, w, others, known.column("core").to_numpy())
    hubs = others[known.column("hub").to_numpy(zero_copy_only=False)]
    to_hub = np.isin(nbrs, hubs)
    ends = pa.table({"id": nbrs[to_hub], "core": core[at[to_hub]], "w": w[to_hub]}).group_by(["id", "core"]).aggregate([("w", "sum")])
    return pa.concat_tables([
        pa.table({"id": ids, "core": core, "w": pa.nulls(len(ids), pa.int64())}),
        pa.table({"id": ends.column("id"), "core": ends.column("core"), "w": ends.column("w_sum")})])


def strong_components_of(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the lowest id of each one's strongly connected component, after Tarjan, without recursion."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    order = np.argsort(ends[:len(src)], kind="stable")
    target = ends[len(src):][order].tolist()
    first = np.searchsorted(ends[:len(src)][order], np.arange(len(ids) + 1)).tolist()
    n, clock = len(ids), 0
    found, low, label, at = [-1] * n, [0] * n, [-1] * n, first[:n]
    open_, path = [], []
    for root in range(n):
        if found[root] >= 0:
            continue
        path.append(root)
        while path:
            v = path[-1]
            if found[v] < 0:
                found[v] = low[v] = clock
                clock += 1
                open_.append(v)
            if at[v] < first[v + 1]:
                t = target[at[v]]
                at[v] += 1
                if found[t] < 0:
                    path.append(t)
                elif label[t] < 0:
                    low[v] = min(low[v], found[t])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == found[v]:
                start = len(open_) - 1
                while open_[start] != v:
                    start -= 1
                members = open_[start:]
                del open_[start:]
                lowest = min(members)
                for member in members:
                    label[member] = lowest
    return ids, ids[np.array(label, dtype=np.int64)]
