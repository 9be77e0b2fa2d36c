"""Strongly connected components by trimming and colouring with random ranks.

A pass first trims some rounds of vertices without an in-link or without an out-link among those left: each is a component
of its own. Then every vertex gets a colour, the least random rank of a vertex that reaches it, and the vertices that
reach the one whose rank is their colour form its component. A component lies within one colour, so links between colours are dropped:
the colours of the next pass are found side by side. With new random ranks in each pass, a pass splits what is left into
parts that are a constant factor smaller in expectation, so a chain of n components needs O(log n) passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.operators.bounded import MAX_EDGES, by_component, strong_components_of
from murmuration.operators.graph import PropertyGraph
from murmuration.operators.propagate import MAX_ROWS_PER_NEIGHBOUR, prepare_links, run_until
from murmuration.session import discard, durable, durable_with

TRIM_ROUNDS = 3
ROUNDS_PER_JOB, MOST_ROUNDS_PER_JOB = 4, 16
OWN, FROM, TO = 0, 1, 2  # link to itself; the neighbour is the link's source; the neighbour is its target


def _directed_links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(
        F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit(FROM).alias("way")),
        F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(TO).alias("way")),
    )).alias("link")).select("link.*")


def strongly_connected_components(graph: PropertyGraph, max_passes: int | None = None,
                                  max_rows: int = MAX_ROWS_PER_NEIGHBOUR, max_edges: int = MAX_EDGES) -> DataFrame:
    """``id, component``: the label is the lowest id of the component.

    Weakly connected components of at most ``max_edges`` edges are searched in tasks, larger ones by passes. With
    ``max_passes`` there are only passes; the search stops early and the vertices left over are labelled by their own id.
    """
    pairs = graph.edges.where("src <> dst").select("src", "dst").distinct()
    if max_passes is None:
        parts = by_component(durable(pairs.withColumn("w", F.lit(1).cast("long"))), max_edges)
        labels = parts.in_tasks(strong_components_of, "id long, component long")
        if parts.large is not None:
            labels = labels.unionByName(_coloured(parts.large, None, max_rows))
    else:
        labels = _coloured(pairs, max_passes, max_rows)
    everyone = graph.vertices.select("id")
    return everyone.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _coloured(pairs: DataFrame, max_passes: int | None, max_rows: int) -> DataFrame:
    """``id, component`` of the vertices whose components are found."""
    n = F.count(F.lit(1))
    links, seen = durable_with(_directed_links(pairs), n=n)
    found: list[DataFrame] = []
    passes = 0
    own = F.col("way") == OWN

    def none(changed: int) -> bool:
        return changed == 0

    while seen["n"] and (max_passes is None or passes < max_passes):
        passes += 1
        ids = links.select("id").distinct()  # either end of a link is its id in one of the two directions
        ring = prepare_links(links.unionByName(ids.select("id", F.col("id").alias("nbr"), F.lit(OWN).alias("way"))), max_rows)

        def rank(vertex: str) -> Column:
            # One number per id, so ranks are distinct. As text, the pass is not part of the generated code.
            return F.xxhash64(F.lit(str(passes)), vertex)

        # A state has a row per vertex left. Links to vertices that are gone give rows too, which have no link to themselves.
        def trim(kept: DataFrame) -> DataFrame:
            return (ring.gather(kept).groupBy("id")
                    .agg(F.max(own).alias("left"), F.max(F.col("way") == FROM).alias("has_in"), F.max(F.col("way") == TO).alias("has_out"))
                    .where("left and has_in and has_out").select("id"))

        def colour(state: DataFrame) -> DataFrame:
            met = ring.gather(state, f"way <> {TO}")
            return (met.groupBy("id").agg(F.min("colour").alias("colour"), F.max(F.when(own, F.col("colour"))).alias("before"))
                    .where("before is not null"))

        core = ids
        for _ in range(TRIM_ROUNDS):
            core = trim(core)
        start = core.select("id", rank("id").alias("colour"), F.lit(None).cast("long").alias("before"))
        colours = run_until(start, colour, F.count_if(F.col("colour") != F.col("before")), none, ROUNDS_PER_JOB, MOST_ROUNDS_PER_JOB)

        # A link goes from a colour to the same or a lower one, so a target of the same colour is a target of the
        # highest colour among those a vertex leads to.
        def reach_back(state: DataFrame) -> DataFrame:
            met = ring.gather(state, f"way <> {FROM}")
            mine = F.max(F.when(own, F.col("colour")))
            led_to = F.max(F.when((F.col("way") == TO) & F.col("reached"), F.col("colour")))
            was = F.max(F.when(own, F.col("reached")))
            return (met.groupBy("id").agg(mine.alias("colour"), was.alias("before"),
                                          (was | F.coalesce(led_to == mine, F.lit(False))).alias("reached"))
                    .where("before is not null"))

        start = colours.select("id", "colour", F.lit(False).alias("before"), (rank("id") == F.col("colour")).alias("reached"))
        done = run_until(start, reach_back, F.count_if(F.col("reached") != F.col("before")), none, ROUNDS_PER_JOB, MOST_ROUNDS_PER_JOB)
        discard(colours)
        ring.release()
        found.append(done.where("reached").select("id", F.lit(passes).alias("pass"), "colour"))
        left = durable(done.where("not reached").select("id", "colour"))
        before = links
        links, seen = durable_with(
            links.join(left, "id").join(left.select(F.col("id").alias("nbr"), F.col("colour").alias("nbr_colour")), "nbr")
            .where("colour = nbr_colour").select("id", "nbr", "way"), n=n)
        discard(before)
    if not found:
        return pairs.sparkSession.createDataFrame([], "id long, component long")
    members = found[0]
    for more in found[1:]:
        members = members.unionByName(more)
    lowest = durable(members.groupBy("pass", "colour").agg(F.min("id").alias("component")))
    return members.join(lowest, ["pass", "colour"]).select("id", "component")
