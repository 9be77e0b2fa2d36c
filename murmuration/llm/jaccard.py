"""Exact Jaccard join of word shingles by set relations: similar sets share answers, lists are skipped in blocks.

1. Rows with equal sets form a class. A class may miss at most a fifth of its shingles in a linked one, so a class with more
   shingles that no other class has is linked with nothing. That is counted on each set's lowest hashes first, which settles
   unrelated texts with one aggregation, and then on the whole sets of what is left until few more drop out.
2. Highly similar sets find a common pivot by min-hashes, the one with the fewest shingles of its own, and are verified
   against it: a star of members around a centre, with exact distances. Copies, however many, cost one comparison each.
3. Candidates of the rest: every set must share one of its ``a fifth + 1`` rarest hashes with a linked set. Inverted lists
   hold centres, not sets, and are cut into blocks by size and by the number of hashes that no other star has. A hash at
   position i of a set (i are missing already) and a partner with u hashes of its own are at a distance of at least i + u,
   so a hash looks up only the blocks in which that is near enough: the others are skipped by position.
4. Centres are compared exactly. A member's overlap with another centre follows from its centre's overlap and the few
   shingles in which the two differ, and by the triangle inequality and the own shingles most members need no comparison.

Distance here is the size of the symmetric difference: sets of a and b shingles are linked if it is at most (a + b) / 9.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from murmuration.llm.common import Tables
from murmuration.llm.shingles import below, emitted, list_array, mixed, numbers, share_used, shingle_sets
from murmuration.operators.components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

PIVOT_KEYS = 6  # min-hashes by which a set finds pivots
BLOCK = math.log(1.1)  # an index block holds sizes within a factor of 1.1
OWN_STEPS = 20  # and own hashes within a twentieth of the size
SHRINK = 0.9  # whole sets are counted again while more than a tenth drops out


def _class_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketches(batches):
    """doc_id, txt, n, cls, mark, n_used, low: size and digest of a text's set, the digest's first half, and its lowest hashes.

    The set is judged by the first ``n_used`` of them; the others are there for sets that are judged by more.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = list(shingle_sets(part.column(1).to_pylist()))
            classes = [_class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()),
                 pa.array([int.from_bytes(c[:8], "little", signed=True) for c in classes], pa.int64()),
                 pa.array([below(s, share_used(len(s))) for s in sets], pa.int32()),
                 list_array([s[:emitted(s)] for s in sets])],
                names=["doc_id", "txt", "n", "cls", "mark", "n_used", "low"])


def _full_sets(batches):
    """id, n, n_low, n_used, hashes, keys of the texts that have the set expected of them; the id is the class's mark."""
    salts = numbers(PIVOT_KEYS, 4)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [(c, s) for c, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist()))
                    if _class_of(s) == c]
            sets = [s for _, s in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(c[:8], "little", signed=True) for c, _ in rows], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([emitted(s) for s in sets], pa.int32()),
                 pa.array([below(s, share_used(len(s))) for s in sets], pa.int32()), list_array(sets),
                 list_array([np.array([mixed(s ^ salt).min() for salt in salts], dtype=np.uint64) for s in sets])],
                names=["id", "n", "n_low", "n_used", "hashes", "keys"])


def linked(inter: str = "inter", a: str = "n_a", b: str = "n_b") -> Column:
    return 100 * F.col(inter) >= 80 * (F.col(a) + F.col(b) - F.col(inter))


def distance(inter: str = "inter", a: str = "n_a", b: str = "n_b") -> Column:
    return F.col(a) + F.col(b) - 2 * F.col(inter)


def _compare(pairs: DataFrame, sets: DataFrame, *kept: str) -> DataFrame:
    """``a, b, n_a, n_b, inter`` and ``kept`` of every pair of classes ``a, b``."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("h_a", "h_b")).cast("long").alias("inter"), *kept))


def _survivors(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that do not have more hashes of their own than a linked set could miss."""
    own = (sketch.where("n > 0 and doc_id is not null").select("mark", "n_used", F.posexplode("low").alias("place", "hash"))
           .groupBy("hash").agg(F.min("mark").alias("mark"), F.max("mark").alias("other"),
                                F.max(F.col("place") < F.col("n_used")).alias("used")).where("used and mark = other")
           .groupBy("mark").agg(F.count(F.lit(1)).alias("own")))
    return (classes.join(own, "mark", "left")
            .where(F.coalesce("own", F.lit(0)) <= F.floor(F.col("n") / 5)).select("cls", "n", "rep"))


def _close_sets(sets: DataFrame, tables: Tables) -> DataFrame:
    """``sets`` with ``own``, the number of hashes that no other set has, without those that have too many.

    Hashes are counted once, with the exclusive or of their sets' ids. Later rounds take away the hashes of the sets that
    dropped out; where one set is left, the exclusive or is its id.
    """
    def counts(rows: DataFrame) -> DataFrame:
        return (rows.select("id", F.explode("hashes").alias("hash")).groupBy("hash")
                .agg(F.count(F.lit(1)).alias("sets"), F.bit_xor("id").alias("ids")))

    counted = tables.put("counts0", counts(sets))
    alive, before, round_ = sets.select("id", "n", F.lit(0).cast("long").alias("own")), sets.count(), 0
    while True:
        alone = counted.where("sets = 1").groupBy(F.col("ids").alias("id")).agg(F.count(F.lit(1)).alias("more"))
        round_ += 1
        judged = tables.put(f"judged{round_}", alive.join(alone, "id", "left").select(
            "id", "n", (F.col("own") + F.coalesce("more", F.lit(0))).alias("own")))
        fits = F.col("own") <= F.floor(F.col("n") / 5)
        alive, gone = judged.where(fits), judged.where(~fits)
        after = alive.count()
        if after >= SHRINK * before:
            break
        before = after
        less = tables.put("less", counts(sets.join(gone.select("id"), "id", "left_semi")).select(
            "hash", F.col("sets").alias("less"), F.col("ids").alias("gone")))
        counted = tables.put(f"counts{round_}", counted.where("sets > 1").join(less, "hash").select(
            "hash", (F.col("sets") - F.col("less")).alias("sets"), F.col("ids").bitwiseXOR(F.col("gone")).alias("ids")).unionByName(
            counted.where("sets > 1").join(less, "hash", "left_anti")))
        tables.drop("less", f"counts{round_ - 1}", f"judged{round_ - 1}")
    result = tables.put("sets", sets.join(alive.select("id", "own"), "id"))
    tables.drop(f"counts{round_ - 1}", f"judged{round_}", f"judged{round_ - 1}", "sets0")
    return result


def _stars(sets: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Verified pairs with pivots, and ``id, centre, d, own, n`` of the sets that are members of a star."""
    keys = sets.select("id", "own", F.posexplode("keys").alias("k", "key"))
    pivots = tables.put("pivots", keys.groupBy("k", "key").agg(
        F.min(F.struct("own", "id")).alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1")
        .select("k", "key", F.col("b.id").alias("b")))
    pairs = keys.join(pivots, ["k", "key"]).select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    found = tables.put("pivot_pairs", _compare(pairs, sets).where(linked()))
    outer = found.select(F.col("a").alias("b")).distinct()  # has a pivot of its own
    member = (found.join(outer, "b", "left_anti").groupBy("a")
              .agg(F.min(F.struct(distance().alias("d"), F.col("b").alias("centre"))).alias("best"))
              .select(F.col("a").alias("id"), "best.centre", "best.d"))
    return found, tables.put("members", member.join(sets.select("id", "own", "n"), "id"))


def _block(n: Column) -> Column:
    return F.floor(F.log(n) / BLOCK).cast("int")


def _candidates(sets: DataFrame, members: DataFrame, tables: Tables) -> DataFrame:
    """``a, b`` (a < b): pairs of centres of which some sets share what linked sets must share.

    Lists hold the lowest hashes, as many as any linked set may look up. What a set misses in a partner for certain are
    its own hashes, or those of its lowest that no other star has, whichever are more. A set whose lowest hashes are too
    few to be sure of a hit looks up all of its hashes among all hashes.
    """
    placed = (sets.select("id", "n", "own", "n_low", "n_used", "hashes")
              .join(members.select("id", "centre"), "id", "left").withColumn("centre", F.coalesce("centre", "id")))
    enough = F.col("n_used") > F.floor(F.col("n") / 5)
    pairs = tables.put("candidates", _meet(placed.withColumn("asks", enough), tables))
    if not placed.where(~enough).isEmpty():
        whole = placed.withColumn("asks", ~enough).withColumn("n_low", F.col("n")).withColumn("n_used", F.col("n"))
        pairs = pairs.unionByName(_meet(whole, tables)).distinct()
    return pairs


def _meet(placed: DataFrame, tables: Tables) -> DataFrame:
    """Pairs of centres whose lists meet at a hash of a set that ``asks``."""
    rows = placed.select("id", "centre", "n", "own", "n_used", "asks",
                         F.posexplode(F.slice("hashes", F.lit(1), F.col("n_low").cast("int"))).alias("at", "hash"))
    index = tables.put("index", rows.groupBy("hash", "centre").agg(F.lit(1).alias("one")).drop("one"))
    lists = tables.put("lists", index.groupBy("hash").agg(
        F.count(F.lit(1)).alias("size"), F.min("centre").alias("low"), F.max("centre").alias("high"))
        .where("low <> high").select("hash", "size"))
    tables.drop("index")
    most, used = F.floor(F.col("n") / 5), F.col("at") < F.col("n_used")
    set_ = Window.partitionBy("id")
    common = (rows.join(lists, "hash")  # hashes that several stars have
              .withColumn("alone", F.greatest(F.col("own"), F.col("n_used") - F.count_if(used).over(set_)))
              .where(F.col("alone") <= most)
              .withColumn("place", F.row_number().over(set_.orderBy(F.when(used, 0).otherwise(1), "size", "hash")) - 1 + F.col("alone")))
    common = tables.put("common", common)
    tables.drop("lists")
    step = F.floor(F.col("alone") * OWN_STEPS / F.col("n")).cast("int")
    index = common.select("hash", "centre", _block(F.col("n")).alias("block"), step.alias("step")).distinct()
    probes = common.where(F.col("asks") & used & (F.col("place") <= most))
    # Partners of m hashes of which u are missing here are near enough if place + u <= (n + m) / 9, and 4/5 n <= m <= 5/4 n.
    largest = F.greatest(F.lit(1.0), 1.25 * F.col("n") - 2.25 * F.col("place"))
    first = _block(F.ceil(0.8 * F.col("n")))
    probes = probes.select("hash", "centre", "n", "place", F.explode(F.sequence(
        first, F.greatest(first, _block(F.floor(largest))))).alias("block"))
    least, upper = F.floor(F.exp(F.col("block") * BLOCK) - 1e-6), F.ceil(F.exp((F.col("block") + 1) * BLOCK) + 1e-6)
    room = (F.col("n") + upper) / 9 - F.col("place")
    probes = probes.where(room >= 0).select("hash", "centre", "block", F.explode(F.sequence(
        F.lit(0), F.least(F.lit(OWN_STEPS), F.floor(room * OWN_STEPS / F.greatest(F.lit(1), least))).cast("int"))).alias("step"))
    met = probes.distinct().withColumnRenamed("centre", "c").join(index, ["hash", "block", "step"]).where("c <> centre")
    return met.select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct()


def _least_distance(own_a: Column, own_b: Column, plus_a: Column, minus_a: Column, plus_b: Column, minus_b: Column) -> Column:
    """Lower bound of the distance of two sets that are known by what they add to a third set and miss of it.

    The distance is that of the added parts and that of the missing parts. The added parts hold the own hashes of
    both, and each distance is at least the difference of the sizes.
    """
    return F.greatest(own_a + own_b, F.abs(plus_a - plus_b)) + F.abs(minus_a - minus_b)


def _parts_of(d: Column, n: Column, n_centre: Column) -> tuple[Column, Column]:
    """How many hashes a set of n at distance d of its centre adds to it and misses of it."""
    return F.floor((d + n - n_centre) / 2), F.floor((d - n + n_centre) / 2)


def _apart(near: DataFrame, sets: DataFrame, links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The pairs of ``near`` that links do not connect yet."""
    parts = tables.put_result(f"{name}_parts", lambda: connected_components(sets.select("id"), links))
    return tables.put(name, near.join(parts.select(F.col("id").alias("a"), F.col("component").alias("c_a")), "a")
                      .join(parts.select(F.col("id").alias("b"), F.col("component").alias("c_b")), "b")
                      .where("c_a <> c_b").drop("c_a", "c_b"))


def _member_links(near: DataFrame, members: DataFrame, sets: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """``links`` and those of members of stars whose centres ``a, b`` are at a distance ``d_ab`` that is too large, but not by much.

    Only the pairs that are not connected yet matter for the groups. A star is asked by its kinds of members (distance to
    the centre, own hashes, size), and the kinds that can have a link are then compared member by member: first with
    the other centre, then, for pairs still apart, with the other star's members.
    """
    near = _apart(near, sets, links, tables, "apart")
    if near.isEmpty():
        return links
    kinds = tables.put("kinds", members.groupBy("centre", "d", "own", "n").agg(F.count(F.lit(1)).alias("size")).drop("size"))
    other = sets.select(F.col("id").alias("far"), F.col("own").alias("own_far"))
    both = near.select("inter", "n_a", "n_b", F.col("a").alias("centre"), F.col("b").alias("far")).unionByName(
        near.select("inter", F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), F.col("b").alias("centre"), F.col("a").alias("far")))
    plus, minus = _parts_of(F.col("d"), F.col("n"), F.col("n_a"))
    least = _least_distance(F.col("own"), F.col("own_far"), plus, minus, F.col("n_b") - F.col("inter"), F.col("n_a") - F.col("inter"))
    asked = both.join(other, "far").join(kinds, "centre").where(least <= F.floor((F.col("n") + F.col("n_b")) / 9))
    asked = tables.put("asked", asked.select("centre", "far", "inter", F.col("n_b").alias("n_far"), "d", "own", "n")
                       .join(members, ["centre", "d", "own", "n"]))
    differences = (asked.select("id", "centre").distinct()
                   .join(sets.select("id", F.col("hashes").alias("mine")), "id")
                   .join(sets.select(F.col("id").alias("centre"), "hashes"), "centre")
                   .select("id", F.array_except("mine", "hashes").alias("plus"), F.array_except("hashes", "mine").alias("minus")))
    derived = F.col("inter") - F.size(F.array_intersect("minus", "h")) + F.size(F.array_intersect("plus", "h"))
    seen = (asked.join(differences, "id").join(sets.select(F.col("id").alias("far"), F.col("hashes").alias("h")), "far")
            .select(F.col("id").alias("src"), F.col("far").alias("dst"), F.col("n").alias("n_a"), F.col("n_far").alias("n_b"),
                    derived.cast("long").alias("inter")))
    links = tables.put("more", links.unionByName(seen.where(linked()).select("src", "dst")))
    tables.drop("asked")
    apart = _apart(near, sets, links, tables, "open")
    left = kinds.select(F.col("centre").alias("a"), *[F.col(c).alias(f"{c}_x") for c in ("d", "own", "n")])
    right = kinds.select(F.col("centre").alias("b"), *[F.col(c).alias(f"{c}_y") for c in ("d", "own", "n")])
    # x, a member of a, is at least so far from b; what y, a member of b, has in common with it is bounded by that.
    plus_x, minus_x = _parts_of(F.col("d_x"), F.col("n_x"), F.col("n_a"))
    from_b = F.greatest(F.col("d_ab") - F.col("d_x"), _least_distance(
        F.col("own_x"), F.col("own_b"), plus_x, minus_x, F.col("n_b") - F.col("inter"), F.col("n_a") - F.col("inter")))
    plus_xb, minus_xb = _parts_of(from_b, F.col("n_x"), F.col("n_b"))
    plus_y, minus_y = _parts_of(F.col("d_y"), F.col("n_y"), F.col("n_b"))
    least = (F.greatest(F.col("own_x") + F.col("own_y"), plus_xb - plus_y) + F.greatest(F.lit(0), minus_xb - minus_y))
    own_b = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"))
    met = apart.join(own_b, "b").join(left, "a").join(right, "b").where(least <= F.floor((F.col("n_x") + F.col("n_y")) / 9))
    met = tables.put("met", met.select("a", "b", *[f"{c}_{side}" for side in "xy" for c in ("d", "own", "n")]))
    if met.isEmpty():
        return links
    x = members.select(F.col("id").alias("x"), F.col("centre").alias("a"), *[F.col(c).alias(f"{c}_x") for c in ("d", "own", "n")])
    y = members.select(F.col("id").alias("y"), F.col("centre").alias("b"), *[F.col(c).alias(f"{c}_y") for c in ("d", "own", "n")])
    pairs = met.join(x, ["a", "d_x", "own_x", "n_x"]).join(y, ["b", "d_y", "own_y", "n_y"])
    pairs = tables.put("pairs", pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return links.unionByName(_compare(pairs, sets).where(linked()).select(F.col("a").alias("src"), F.col("b").alias("dst")))


def text_key(text: Column) -> Column:
    """By which the texts under one id are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _grouped(docs: DataFrame, tables: Tables) -> DataFrame:
    """``doc_id, txt, n, cls`` of every row; of rows in a group also its least id ``rep``, with the class and text of that row."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", text_key(docs["text"]).alias("txt"))
    sketch = tables.put("sketch", texts.mapInArrow(
        _sketches, "doc_id long, txt long, n long, cls binary, mark long, n_used int, low array<long>"))
    ids = tables.put("ids", sketch.select("doc_id", "txt", "n", "cls"))
    classes = tables.put("classes", sketch.where("n > 0 and doc_id is not null").groupBy("cls", "mark", "n")
                         .agg(F.min(F.struct(F.col("doc_id").alias("rep"), "txt")).alias("first"))
                         .select("cls", "mark", "n", "first.rep", "first.txt"))
    rest = tables.put("rest", _survivors(sketch, classes))
    tables.drop("sketch")
    # Merged at every size: what is left of a large table is no small side either.
    wanted = rest.select("cls", F.col("rep").alias("doc_id")).hint("merge")
    expected = texts.select("doc_id", "text").join(wanted, "doc_id").select("cls", "text")
    sets = tables.put("sets0", expected.mapInArrow(
        _full_sets, "id long, n long, n_low int, n_used int, hashes array<long>, keys array<long>").dropDuplicates(["id"]))
    tables.drop("rest")
    sets = _close_sets(sets, tables)
    found, members = _stars(sets, tables)
    compared = tables.put("compared", _compare(_candidates(sets, members, tables), sets))
    tables.drop("candidates", "common")
    links = tables.put("links", found.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        compared.where(linked()).select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    tables.drop("pivot_pairs")
    radius = tables.put("radius", members.groupBy("centre").agg(F.max("d").alias("r")))
    reach = F.coalesce("r_a", F.lit(0)) + F.coalesce("r_b", F.lit(0))
    near = (compared.where(~linked())
            .join(radius.select(F.col("centre").alias("a"), F.col("r").alias("r_a")), "a", "left")
            .join(radius.select(F.col("centre").alias("b"), F.col("r").alias("r_b")), "b", "left")
            .where((reach > 0) & (distance() <= reach + F.floor((F.col("n_a") + F.col("n_b") + reach) / 9)))
            .select("a", "b", "inter", "n_a", "n_b", distance().alias("d_ab")))
    near = tables.put("near", near)
    tables.drop("compared", "radius")
    if not near.isEmpty():
        links = tables.put("all_links", _member_links(near, members, sets, links, tables))
    parts = tables.put_result("parts", lambda: connected_components(sets.select("id"), links))
    tables.drop("sets", "near", "members", "kinds", "apart", "apart_parts", "open", "open_parts", "met", "pairs", "more", "links", "all_links")
    named = tables.put("named", parts.join(classes.withColumnRenamed("mark", "id"), "id"))
    lowest = tables.put("lowest", named.groupBy("component").agg(F.min(F.struct("rep", "cls", "txt")).alias("lowest")))
    moved = named.join(lowest, "component").select("cls", "lowest")
    answers = tables.put("answers", classes.join(moved, "cls", "left").select(
        "cls", F.coalesce("lowest", F.struct("rep", "cls", "txt")).alias("lowest")))
    tables.drop("parts", "named", "lowest", "classes")
    return ids.join(answers, "cls", "left")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Texts are sets of distinct five-word shingles (of A-Z lower-cased words, a shorter text being one shingle); two are
    linked when 100 x intersection >= 80 x union. ``component_id`` is the least id that links lead to. All links between
    different sets are found, or their sets are known to be connected otherwise. Shingles are told apart by 64 bits.

    Nulls: a null or wordless text has no shingles and is its own component; a row with a null ``doc_id`` takes part in no link and has
    a null component. Rows that repeat an id and a text get equal answers; an id may have several texts. No rows give no rows.
    """
    return _grouped(docs, Tables(docs.sparkSession)).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
        .otherwise(F.col("lowest.rep")).alias("component_id"))


def superseded(docs: DataFrame) -> DataFrame:
    """``moved_id, moved_text``: id and ``text_key`` of the rows for which another row of their group stays.

    Of a group stays the row with the least id; where that id has several texts in the group, one of them. Rows without
    an id or without words are in no group. No rows give no rows.
    """
    stays = (F.col("doc_id") == F.col("lowest.rep")) & (F.col("cls") == F.col("lowest.cls")) & (F.col("txt") == F.col("lowest.txt"))
    return (_grouped(docs, Tables(docs.sparkSession)).where((F.col("n") > 0) & F.col("doc_id").isNotNull() & ~stays)
            .select(F.col("doc_id").alias("moved_id"), F.col("txt").alias("moved_text")).distinct())
