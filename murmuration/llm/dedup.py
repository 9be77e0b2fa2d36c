"""Exact duplicates by skew-safe combining: each partition, then salted digest groups, then the salts' winners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str | Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicate_groups(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs(doc_id, text)``.

    Texts are equal when their normalised forms are. Copies meet three times: in their own partition (the aggregate's
    map side), in one of ``salts`` groups of their digest, and then once per salt. So a text that a third of all rows
    repeat reaches any task as one row per task and at last as ``salts`` rows. Every stage groups by digest and
    whole text, so a digest shared by different texts never merges them.

    Nulls: a null text is the empty text; a null ``doc_id`` loses against any other, and a group that has no other
    keeps its null rows. Rows that repeat an id and a text get equal answers and all count. No rows give no rows.
    """
    tables = Tables(docs.sparkSession)
    rows = docs.select("doc_id", normalised("text").alias("norm"))
    rows = rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    salted = (rows.groupBy("digest", salt, "norm")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    merged = (salted.groupBy("digest", "norm")
              .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")))
    winners = tables.put("winners", merged.select("digest", "keep_id", "group_size"))
    ids = rows.select("doc_id", "digest")
    shared = winners.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        answered = ids.join(winners, "digest")
    else:  # one digest of several texts: those rows are matched by their texts as well
        shared = tables.put("shared", shared)
        answered = (ids.join(shared, "digest", "left_anti").join(winners, "digest")
                    .unionByName(rows.join(shared, "digest", "left_semi")
                                 .join(tables.put("texts", merged.join(shared, "digest", "left_semi")), ["digest", "norm"])
                                 .drop("norm")))
    return answered.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                           F.col("digest").alias("text_sha256"))


def kept_rows(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id``, with all columns of ``docs``.

    The same combining as in ``duplicate_groups``, but the winner's row travels with its group, so that no text is read
    or joined again. Of rows that repeat the winner's id and text one stays, and of rows without an id one where their
    group has no other. Extra columns may have any names and types. No rows give no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id").alias("id"),
                       normalised("text").alias("norm"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    best = F.max_by("row", "id").alias("row"), F.max("id").alias("id")
    salted = rows.groupBy("digest", "salt", "norm").agg(*best)
    return salted.groupBy("digest", "norm").agg(*best).select("row.*")
