"""Shards of near-equal bytes by a k-d tree: nodes split at weighted medians of their widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions.ranking import with_dense_index
from murmuration.llm.common import Tables

TIE_BITS = 40


@dataclass
class Node:
    """A subtree that becomes ``leaves`` shards from ``first`` on."""

    first: int
    leaves: int


@dataclass
class Cut:
    """Search for the value of ``dim`` that has ``target`` of the node's weight before it, within [low, high]."""

    node: Node
    dim: str
    low: int
    high: int
    target: float
    enough: float  # a bin of this weight need not be divided
    value: int | None = None  # found; then the search goes on among the rows that have it,
    tied: str | None = None  # in this dimension
    closed: bool = False  # rows from ``low`` on lie after the cut; no ties are left to divide


def _refine(rows: DataFrame, cuts: list[Cut], bins: int) -> None:
    """One histogram of each cut's range narrows it to the bin in which the target falls: one job for all nodes."""
    steps = [-(-(cut.high - cut.low + 1) // bins) for cut in cuts]
    place = F.lit(None).cast("long")
    for cut, step in zip(cuts, steps):
        inside = (F.col("node") == cut.node.first) & F.col(cut.dim).between(cut.low, cut.high)
        if cut.value is not None:
            inside &= F.col(cut.tied) == cut.value
        place = F.when(inside, F.expr(f"({cut.dim} - {cut.low}) div {step}")).otherwise(place)
    counts = (rows.withColumn("bin", place).where("bin is not null").groupBy("node", "bin")
              .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).collect())  # at most nodes x bins rows
    for cut, step in zip(cuts, steps):
        own = sorted((r["bin"], r["weight"], r["n"]) for r in counts if r["node"] == cut.node.first)
        for chosen, weight, n in own:
            if weight > cut.target or chosen == own[-1][0]:
                break
            cut.target -= weight
        cut.low += chosen * step
        cut.high = min(cut.high, cut.low + step - 1)
        if n == 1 or weight <= cut.enough:  # all of the bin goes to the nearer side
            if cut.target > weight / 2:
                cut.low = cut.high + 1
            cut.high, cut.closed = cut.low, True


def kd_assign(rows: DataFrame, dims: list[str], shards: int, bins: int = 1024, tolerance: float = 1e-4) -> DataFrame:
    """Add ``shard`` to ``rows(weight, tie, *dims)``; ``dims`` and ``tie`` (0 <= tie < 2**TIE_BITS) are longs, not null.

    A node of k shards is cut so that floor(k / 2) / k of its weight lies before the cut, along the dimension whose range
    in the node is the largest part of its range over all rows. Medians are found by histograms of ``bins`` bins, each
    narrowing the range of the last; the driver sees nodes x bins sums, never rows. Rows with the cut's own value are
    divided by ``tie``, so no value, however frequent, makes a shard too large: a cut is off by at most half a row, or by
    ``tolerance`` of a shard. Each level stores the rows' nodes, so that no task depends on an executor.
    """
    tables, level = Tables(rows.sparkSession), 0
    rows = rows.withColumn("node", F.lit(0))
    whole = rows.agg(*[F.max(d).alias(f"{d}_max") for d in dims], *[F.min(d).alias(f"{d}_min") for d in dims]).first()
    if whole[f"{dims[0]}_max"] is None:
        return rows.withColumnRenamed("node", "shard")
    spread = {d: max(1, whole[f"{d}_max"] - whole[f"{d}_min"]) for d in dims}
    nodes = [Node(0, shards)]
    while any(node.leaves > 1 for node in nodes):
        wide = [node for node in nodes if node.leaves > 1]
        ranges = {r["node"]: r for r in rows.groupBy("node").agg(
            F.sum("weight").alias("weight"), *[F.max(d).alias(f"{d}_max") for d in dims],
            *[F.min(d).alias(f"{d}_min") for d in dims]).collect()}  # one row per node
        cuts = []
        for node in wide:
            if node.first in ranges:
                own = ranges[node.first]
                dim = max(dims, key=lambda d: (own[f"{d}_max"] - own[f"{d}_min"]) / spread[d])
                cuts.append(Cut(node, dim, own[f"{dim}_min"], own[f"{dim}_max"],
                                own["weight"] * (node.leaves // 2) / node.leaves, tolerance * own["weight"] / node.leaves))
        while open_ := [cut for cut in cuts if cut.low < cut.high]:
            _refine(rows, open_, bins)
        for cut in cuts:  # the value is known; now cut the rows that have it, unless none is left to divide
            cut.value, cut.tied = cut.low, cut.dim
            cut.dim, cut.low, cut.high = "tie", 0, 0 if cut.closed else (1 << TIE_BITS) - 1
        while open_ := [cut for cut in cuts if cut.low < cut.high]:
            _refine(rows, open_, bins)
        moved = F.col("node")
        for cut in cuts:
            value, tie = F.col(cut.tied), F.col("tie")
            after = (value > cut.value) | ((value == cut.value) & (tie >= cut.low))
            moved = F.when((F.col("node") == cut.node.first) & after,
                           F.lit(cut.node.first + cut.node.leaves // 2)).otherwise(moved)
        rows, level = tables.put(f"level{level + 1}", rows.withColumn("node", moved)), level + 1
        if level > 1:
            tables.drop(f"level{level - 1}")
        nodes = [half for node in nodes for half in (
            [node] if node.leaves == 1 else
            [Node(node.first, node.leaves // 2),
             Node(node.first + node.leaves // 2, node.leaves - node.leaves // 2)])]
    return rows.withColumnRenamed("node", "shard")


def document_shards(docs: DataFrame, shards: int = 24, bins: int = 1024) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of ``docs(doc_id, text, lang, source)``.

    Law ``bytes``: the shards' sums of ``size`` (bytes of the text plus 8) are near equal. The dimensions are the size,
    the language and the source (as places in a fixed hashed range) and the id; equal values are divided by text and id,
    so copies mostly stay together and a group too large for a shard is cut. ``slot`` numbers a shard's rows from 0 in
    the order of text, id.

    Nulls: a null text has size 8, a null id, language or source is a value of its own. Repeated rows are rows.
    With fewer rows than shards some shards stay empty; no rows give no rows.
    """
    tables = Tables(docs.sparkSession)

    def hashed(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << 16)).cast("long")

    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text)
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), crc.alias("text_crc32"),
        hashed("lang").alias("d_lang"), hashed("source").alias("d_source"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d_id"),
        # High bits from the text, low bits from the id.
        (F.shiftleft(F.pmod(crc, F.lit(1 << 24)), TIE_BITS - 24)
         + F.pmod(F.xxhash64("doc_id"), F.lit(1 << (TIE_BITS - 24)))).alias("tie"))
    rows = tables.put("rows", rows.withColumn("d_size", F.col("size")).withColumn("weight", F.col("size")))
    placed = kd_assign(rows, ["d_size", "d_id", "d_source", "d_lang"], shards, bins)
    numbered = with_dense_index(placed.select("doc_id", "size", "text_crc32", "shard"),
                                [F.col("shard"), F.col("text_crc32"), F.col("doc_id"), F.col("size")], "index")
    starts, total = [], 0
    counts = {r["shard"]: r["count"] for r in numbered.groupBy("shard").count().collect()}  # one row per shard
    for shard in sorted(counts):
        starts.append((shard, total))
        total += counts[shard]
    start = F.lit(0).cast("long")
    for shard, rows_before in starts:
        start = F.when(F.col("shard") == shard, F.lit(rows_before).cast("long")).otherwise(start)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
                           (F.col("index") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
