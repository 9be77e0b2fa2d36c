"""Synchronous label propagation: each vertex takes the label most edges bring it, both directions counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators.graph import PropertyGraph
from murmuration.operators.propagate import (MAX_ROWS_PER_NEIGHBOUR, both_ways, prepare_links, run_rounds,
                                             self_links)

ROUNDS_PER_JOB = 2


def label_propagation(graph: PropertyGraph, rounds: int = 4, max_rows: int = MAX_ROWS_PER_NEIGHBOUR) -> DataFrame:
    """``id, label`` after ``rounds`` rounds; ties go to the lowest label, a vertex without edges keeps its own."""
    links = prepare_links(both_ways(graph.edges).unionByName(self_links(graph.vertices)), max_rows)

    def vote(state: DataFrame) -> DataFrame:
        votes = links.gather(state).groupBy("id", "label").agg(F.sum("w").alias("votes"))
        best = F.min(F.struct((-F.col("votes")).alias("rank"), "label"))
        return votes.groupBy("id").agg(best.alias("best")).select("id", F.col("best.label").alias("label"))

    start = graph.vertices.select("id", F.col("id").alias("label"))
    labels = run_rounds(start, vote, rounds, ROUNDS_PER_JOB)
    links.release()
    return labels
