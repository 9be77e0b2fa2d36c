"""PageRank with reset 0.15: rank = 0.15 + 0.85 * sum(rank of senders / their out-degree)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators.graph import PropertyGraph, degrees
from murmuration.operators.propagate import MAX_ROWS_PER_NEIGHBOUR, prepare_links, run_rounds, self_links
from murmuration.session import discard, durable_with

RESET = 0.15
ROUNDS_PER_JOB = 5


def pagerank(graph: PropertyGraph, tolerance: float | None = 1e-5, rounds: int | None = None,
             normalize: bool = False, max_rows: int = MAX_ROWS_PER_NEIGHBOUR) -> DataFrame:
    """``id, rank``. Parallel edges count; ranks of vertices without out-edges are not redistributed.

    Runs until no rank moves by ``tolerance`` in one round, or exactly ``rounds`` rounds. ``normalize`` scales the ranks
    so that they add up to the number of vertices. Without ``rounds``, ranks are extrapolated between jobs, see ``_settled``.
    """
    pairs = graph.edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    received = pairs.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "w")
    links = prepare_links(received.unionByName(self_links(graph.vertices)), max_rows)
    start = degrees(graph).select("id", "out_degree", F.lit(1.0).alias("rank"), F.lit(0.0).alias("before"))

    older = {} if rounds is not None else {"older": "before"}

    def spread(state: DataFrame) -> DataFrame:
        met = links.gather(state)
        own = F.col("w") == 0
        share = F.when(own, 0.0).otherwise(F.col("w") * F.col("rank") / F.col("out_degree"))
        return met.groupBy("id").agg(
            F.max(F.when(own, F.col("out_degree"))).alias("out_degree"),
            (F.lit(RESET) + F.lit(1 - RESET) * F.sum(share)).alias("rank"),
            F.max(F.when(own, F.col("rank"))).alias("before"),
            *[F.max(F.when(own, F.col(c))).alias(name) for name, c in older.items()])

    if rounds is not None:
        ranks = run_rounds(start, spread, rounds, ROUNDS_PER_JOB)
    else:
        ranks = _settled(start, spread, tolerance)
    links.release()
    ranks = ranks.select("id", "rank")
    if normalize:
        count, total = ranks.agg(F.count("*"), F.sum("rank")).first()
        ranks = ranks.withColumn("rank", F.col("rank") * F.lit((count or 0) / (total or 1.0)))
    return ranks


def _settled(state: DataFrame, spread: Callable[[DataFrame], DataFrame], tolerance: float) -> DataFrame:
    """Rounds until no rank moves by ``tolerance`` in one.

    Every move is the one before times the same matrix. What keeps moving after some rounds mostly shrinks by one factor,
    so each job ends by adding the rest of that geometric series: the mix of the last two states whose moves are least
    (Kamvar et al., WWW 2003). Moves add up to at most ``1 - RESET`` of those before in plain rounds; if they ever do not,
    the rounds go on without it.
    """
    move, earlier = F.col("rank") - F.col("before"), F.col("before") - F.col("older")
    turn = move - earlier
    measures = {"most": F.max(F.abs(move)), "sum": F.sum(F.abs(move)), "along": F.sum(move * turn), "turned": F.sum(turn * turn)}
    stored, bound, trusted = None, None, True
    while True:
        for _ in range(ROUNDS_PER_JOB):
            state = spread(state)
        state, seen = durable_with(state, **measures)
        discard(stored)
        stored = state
        if seen["most"] is None or seen["most"] < tolerance:
            return state
        trusted = trusted and (bound is None or seen["sum"] <= bound)
        bound = seen["sum"] * (1 - RESET) ** ROUNDS_PER_JOB
        if trusted and seen["turned"] > 0:
            state = state.withColumn("rank", F.col("rank") - F.lit(seen["along"] / seen["turned"]) * move)
