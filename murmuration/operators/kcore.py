"""k-core of a directed multigraph: every kept vertex has at least k edge ends on kept vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmuration.operators.bounded import (EDGES_PER_PARTITION, MAX_EDGES, Parts, by_component, core_numbers_in_blocks,
                                            core_numbers_of)
from murmuration.operators.graph import PropertyGraph, degrees, endpoints, induced_subgraph
from murmuration.operators.propagate import (MAX_ROWS_PER_NEIGHBOUR, merged_edges, neighbours, prepare_links, run_jobs,
                                             self_links)
from murmuration.session import discard, durable, durable_with

ROUNDS_PER_JOB, MOST_ROUNDS_PER_JOB = 4, 16
# A round runs as many tasks as the session has shuffle partitions, whatever the graph's size, so up to this many pairs
# components come first. With more, the rounds of some jobs do, after which there may be no need for components.
PAIRS_PARTED_AT_ONCE, JOBS_BEFORE_PARTING = 10_000_000, 1


def kcore_ids(edges: DataFrame, k: int, max_rows: int = MAX_ROWS_PER_NEIGHBOUR, max_edges: int = MAX_EDGES,
              at_once: int = PAIRS_PARTED_AT_ONCE) -> DataFrame:
    """Ids of the k-core's vertices.

    Components of at most ``max_edges`` edges are peeled in tasks, larger ones in rounds. A round keeps the vertices with
    weight >= k towards kept neighbours. Dropped vertices never come back, so the number of kept vertices shows when it is
    done. Of more than ``at_once`` pairs, components are looked for only in what the first rounds leave. A vertex with an
    edge has a neighbour with one, so the 1-core needs no rounds.
    """
    if k <= 1:
        return durable(endpoints(edges).where("id is not null").distinct().select(F.col("id").cast("long").alias("id")))
    pairs, seen = durable_with(merged_edges(edges).where("src is not null"), n=F.count(F.lit(1)))
    if seen["n"] > at_once:
        alive, settled = _peeled(pairs, k, max_rows, JOBS_BEFORE_PARTING)
        if settled:
            return alive
        pairs = durable(_between(pairs, alive))
    parts = by_component(pairs, max_edges)
    kept = parts.in_tasks(core_numbers_of, "id long, core long").where(F.col("core") >= k).select("id")
    return kept if parts.large is None else kept.unionByName(_peeled(parts.large, k, max_rows)[0])


def _between(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with both ends in ``ids``."""
    return (pairs.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
            .join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w"))


def _peeled(pairs: DataFrame, k: int, max_rows: int, jobs: int | None = None) -> tuple[DataFrame, bool]:
    """Ids left after the rounds of at most so many jobs, and whether they are the k-core. Links are cut down to the
    kept vertices whenever half are gone."""
    links = prepare_links(neighbours(pairs), max_rows)
    # An edge from a vertex to itself is two links to the same neighbour, which is its two ends.
    n = F.count(F.lit(1))
    alive, seen = durable_with(
        links.rows.groupBy("id").agg(F.sum("w").alias("deg")).where(F.col("deg") >= k).select("id"), n=n)
    count = linked = seen["n"]

    def peel(kept: DataFrame) -> DataFrame:
        met = links.gather(kept)
        return met.groupBy("id").agg(F.sum("w").alias("deg")).where(F.col("deg") >= k).select("id")

    done, settled = 0, not count
    while not settled and done != jobs:
        done += 1
        after = alive
        for _ in range(ROUNDS_PER_JOB):
            after = peel(after)
        after, seen = durable_with(after, n=n)
        settled = seen["n"] in (0, count)
        discard(alive)
        alive, count = after, seen["n"]
        if not settled and count <= linked // 2:
            cut = (links.rows.drop("salt").join(alive, "id", "left_semi")
                   .join(alive.withColumnRenamed("id", "nbr"), "nbr", "left_semi"))
            before, links, linked = links, prepare_links(cut, max_rows), count
            before.release()
    links.release()
    return alive, settled


def core_numbers(edges: DataFrame, bounds: DataFrame | None = None, max_rows: int = MAX_ROWS_PER_NEIGHBOUR,
                 max_edges: int = MAX_EDGES, at_once: int = PAIRS_PARTED_AT_ONCE) -> DataFrame:
    """``id, core`` of every vertex with an edge: the largest k whose k-core has it, for all k in one loop.

    Few pairs are peeled by one task, others in blocks by tasks, which tell each other what they must know in rounds: see
    ``core_numbers_in_blocks``. Of more than ``at_once`` pairs, that is done only if first rounds do not end it: every vertex
    starts with its degree, or less where ``bounds(id, bound)`` says so, and takes the h-index of its neighbours' numbers until
    none falls, the largest h such that neighbours of at least h have h edge ends to it. A vertex's neighbours are summed up per
    number first, and no vertex meets more than sqrt(2 x edges) different ones. ``bounds`` must not lie below the result;
    vertices that it lacks have none.
    """
    pairs, seen = durable_with(merged_edges(edges).where("src is not null"), n=F.count(F.lit(1)))
    if seen["n"] <= min(max_edges, EDGES_PER_PARTITION):
        whole = pairs.select(*(F.col(c).cast("long").alias(c) for c in ("src", "dst", "w")), F.lit(0).alias("component"))
        return Parts(whole, None, 0).in_tasks(core_numbers_of, "id long, core long")
    if seen["n"] > at_once:
        numbers, settled = _sunk(pairs, bounds, max_rows, JOBS_BEFORE_PARTING)
        if settled:
            return numbers
        bounds = numbers.select("id", F.col("core").alias("bound"))
    return core_numbers_in_blocks(pairs, bounds, max_edges)


def _sunk(pairs: DataFrame, bounds: DataFrame | None, max_rows: int, jobs: int | None = None) -> tuple[DataFrame, bool]:
    """``id, core`` after the rounds of at most so many jobs, and whether they are the core numbers."""
    links = prepare_links(neighbours(pairs).unionByName(self_links(endpoints(pairs).distinct())), max_rows)
    start = links.rows.groupBy("id").agg(F.sum("w").alias("core"))
    if bounds is not None:
        start = start.join(bounds, "id", "left").select("id", F.least("core", F.coalesce("bound", "core")).alias("core"))

    def settle(state: DataFrame) -> DataFrame:
        met = links.gather(state.select("id", "core"))
        by_number = met.groupBy("id", "core").agg(F.sum("w").alias("w"), F.max(F.when(F.col("w") == 0, F.col("core"))).alias("own"))
        falling = Window.partitionBy("id").orderBy(F.desc("core"))
        reached = by_number.select("id", "own", F.least(F.col("core"), F.sum("w").over(falling)).alias("h"))
        return reached.groupBy("id").agg(F.least(F.max("h"), F.max("own")).alias("core"), F.max("own").alias("before"))

    numbers, settled = run_jobs(start, settle, F.count_if(F.col("core") != F.col("before")), lambda changed: changed == 0,
                                ROUNDS_PER_JOB, MOST_ROUNDS_PER_JOB, jobs)
    links.release()
    return numbers.select("id", "core"), settled


def kcore(graph: PropertyGraph, k: int, max_rows: int = MAX_ROWS_PER_NEIGHBOUR) -> PropertyGraph:
    """The k-core as a graph with names. Vertices without edges belong to it for k = 0 only."""
    if k <= 0:
        return graph
    return induced_subgraph(graph, kcore_ids(graph.edges, k, max_rows))


def prune(graph: PropertyGraph, period: int, every: int = 4, k: int = 2) -> PropertyGraph:
    """Replace the graph of every ``every``-th period by its k-core."""
    return kcore(graph, k) if period % every == 0 else graph


def kcore_stats(core: PropertyGraph) -> DataFrame:
    """One row: vertices, edges, and lowest, highest and summed degree inside the core."""
    summary = degrees(core).agg(
        F.count("*").alias("n_vertices"), F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"), F.coalesce(F.sum("degree"), F.lit(0)).alias("sum_degree"))
    return summary.select("n_vertices", (F.col("sum_degree") / 2).cast("long").alias("n_edges"),
                          "min_degree", "max_degree", "sum_degree")
