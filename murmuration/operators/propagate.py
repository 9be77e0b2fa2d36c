"""Passing values along graph links, round after round.

The links are stored reliably, shuffled once and kept by the executors, partitioned and sorted by the neighbour a value comes from
(what a lost executor kept is read from the stored table again). A round then shuffles one row per vertex and the
partial aggregates, never the links. Every neighbour with more than ``max_rows`` links is salted: its links are spread
over several groups and its value is sent to each of them.

Each vertex also has one link to itself with weight 0, by which it carries its own values through the aggregate. So a
round uses the state once, and several rounds can be chained into one job without the plan growing exponentially.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.session import discard, durable, durable_with

MAX_ROWS_PER_NEIGHBOUR = 1_000_000
LINKS_PER_PARTITION = 500_000


@dataclass(frozen=True)
class Links:
    """``rows(id, nbr, w, ...)`` plus, where some neighbour is hot, ``salt`` and the table of hot neighbours."""

    rows: DataFrame
    hot: DataFrame | None = None
    stored: tuple[DataFrame, ...] = ()

    def gather(self, state: DataFrame, only: str | None = None) -> DataFrame:
        """One row per link with the neighbour's state, that is the columns of ``state`` other than ``id``."""
        rows = self.rows.where(only) if only else self.rows
        state = state.withColumnRenamed("id", "nbr")
        if self.hot is None:
            return rows.join(state, "nbr")
        copies = F.coalesce(F.col("copies"), F.lit(1))
        spread = (state.join(self.hot, "nbr", "left")  # broadcast or not by its measured size
                  .withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
                  .drop("copies"))
        return rows.join(spread, ["nbr", "salt"])

    def release(self) -> None:
        """Drop the links and their tables; results stored from them stay."""
        self.rows.unpersist()
        for table in self.stored:
            discard(table)


def merged_edges(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` without directions: ``w`` counts the edges between two vertices."""
    return (edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .agg(F.count("*").alias("w")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected weighted neighbours ``id, nbr, w``: edges between two vertices are merged first, ``w`` counts them."""
    return neighbours(merged_edges(edges))


def neighbours(pairs: DataFrame) -> DataFrame:
    """``id, nbr, w`` of ``merged_edges``."""
    return pairs.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr"), "w"),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr"), "w"),
    )).alias("link")).select("link.*")


def self_links(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.col("id").alias("nbr"), F.lit(0).cast("long").alias("w"))


def prepare_links(links: DataFrame, max_rows: int = MAX_ROWS_PER_NEIGHBOUR) -> Links:
    """Store ``links(id, nbr, w, ...)`` and keep them partitioned by neighbour, every hot neighbour salted."""
    links = durable(links)
    sizes = links.groupBy("nbr").count()
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    # With fewer partitions than the session's default, Spark would rather shuffle the links again in every join.
    partitions = max(-(-(total or 0) // LINKS_PER_PARTITION),
                     int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if (largest or 0) <= max_rows:
        return Links(links.repartition(partitions, "nbr").sortWithinPartitions("nbr").persist(StorageLevel.MEMORY_AND_DISK), None, (links,))
    hot = durable(sizes.where(F.col("count") > max_rows)
                  .select("nbr", F.ceil(F.col("count") / max_rows).cast("int").alias("copies")))
    salted = (links.join(hot, "nbr", "left")
              .withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("copies", F.lit(1))).cast("int"))
              .drop("copies"))
    kept = salted.repartition(partitions, "nbr", "salt").sortWithinPartitions("nbr", "salt")
    return Links(kept.persist(StorageLevel.MEMORY_AND_DISK), hot, (links, hot))


def run_rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, per_job: int) -> DataFrame:
    """Exactly ``rounds`` rounds, stored every ``per_job`` of them."""
    before = None
    for done in range(1, rounds + 1):
        state = step(state)
        if done % per_job == 0 or done == rounds:
            state = durable(state)
            discard(before)  # the table two jobs back is read by nothing
            before = state
    return state


def run_until(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Column,
              settled: Callable[[object], bool], per_job: int, most_per_job: int | None = None) -> DataFrame:
    """Rounds until ``settled`` holds for an aggregate of the state, evaluated as each job stores its result.

    With ``most_per_job`` every job makes twice the rounds of the one before, up to that number.
    """
    return run_jobs(state, step, measure, settled, per_job, most_per_job)[0]


def run_jobs(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Column, settled: Callable[[object], bool],
             per_job: int, most_per_job: int | None = None, jobs: int | None = None) -> tuple[DataFrame, bool]:
    """``run_until`` with at most so many ``jobs``, and whether the state has settled."""
    before, done = None, 0
    while True:
        for _ in range(per_job):
            state = step(state)
        per_job = min(2 * per_job, most_per_job or per_job)
        state, seen = durable_with(state, measure=measure)
        discard(before)
        before = state
        done += 1
        if settled(seen["measure"]):
            return state, True
        if done == jobs:
            return state, False
