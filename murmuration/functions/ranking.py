"""Dense row numbers over a total order, without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.session import durable

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def with_dense_index(df: DataFrame, order: list[Column], index: str) -> DataFrame:
    """Add ``index`` = 0, 1, 2, ... in ``order``.

    A range-partitioned sort numbers the rows inside each partition; one small row per partition (its size) gives the
    offsets. The order should be total, otherwise ties are numbered arbitrarily.
    """
    placed = durable(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    partition = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(partition.alias("part")).count().collect()  # one row per partition of the sort
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((row["part"], total))
        total += row["count"]
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    if len(offsets) <= 1:
        return placed.withColumn(index, within).drop("_place")
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    return (placed.withColumn("_part", partition)
            .join(F.broadcast(starts), "_part")  # one row per partition
            .withColumn(index, F.col("_start") + within)
            .drop("_place", "_part", "_start"))
