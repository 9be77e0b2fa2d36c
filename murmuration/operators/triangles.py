"""Distinct triangles per vertex, directions and parallel edges ignored.

Vertices are numbered by (degree, id). Every edge points from the end with the lower number to the other, so no vertex has more than sqrt(2 * edges)
targets, however large its degree. The two target lists of an edge are intersected; no pairs of neighbours are formed.
The lists hold the numbers, which take half the space of the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.ranking import with_dense_index
from murmuration.operators.graph import PropertyGraph, endpoints
from murmuration.session import durable, durable_with


def triangle_count(graph: PropertyGraph) -> DataFrame:
    """``id, triangles`` for every vertex."""
    pairs = durable(graph.edges.where("src <> dst")
                    .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    numbered, seen = durable_with(
        with_dense_index(endpoints(pairs).groupBy("id").agg(F.count("*").alias("degree")), [F.col("degree"), F.col("id")], "place"),
        n=F.count(F.lit(1)))
    place = F.col("place").cast("int" if seen["n"] < 2 ** 31 else "long")
    places = numbered.select("id", place.alias("place"))
    ranked = (pairs.join(places.select(F.col("id").alias("src"), F.col("place").alias("s")), "src")
              .join(places.select(F.col("id").alias("dst"), F.col("place").alias("d")), "dst"))
    arrows = ranked.select(F.least("s", "d").alias("low"), F.greatest("s", "d").alias("high"))
    targets = durable(arrows.groupBy("low").agg(F.collect_list("high").alias("targets")))
    opened = targets.where("size(targets) > 1").select("low", "targets", F.explode("targets").alias("high"))
    common = (opened.join(targets.select(F.col("low").alias("high"), F.col("targets").alias("more")), "high")
              .select("low", "high", F.array_intersect("targets", "more").alias("third"))
              .where("size(third) > 0"))
    n = F.size("third").cast("long")
    corners = common.select(F.explode(F.concat(
        F.array(F.struct(F.col("low").alias("place"), n.alias("n")), F.struct(F.col("high").alias("place"), n.alias("n"))),
        F.transform("third", lambda v: F.struct(v.alias("place"), F.lit(1).cast("long").alias("n"))),
    )).alias("corner")).select("corner.*")
    counts = corners.groupBy("place").agg(F.sum("n").alias("triangles")).join(places, "place").select("id", "triangles")
    return (graph.vertices.select("id").join(counts, "id", "left")
            .select("id", F.coalesce("triangles", F.lit(0).cast("long")).alias("triangles")))


def triangle_total(counts: DataFrame) -> DataFrame:
    """Number of distinct triangles: each is counted at its three corners."""
    return counts.agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("long").alias("n_triangles"))
