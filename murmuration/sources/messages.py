"""Message sources and the projections of messages into users, messages and communications.

All functions take and return DataFrames, streaming or not, with the columns of ``MESSAGE_SCHEMA``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions.ids import name_id
from murmuration.functions.text import (SHORT_MENTION_PATTERN, clean_text, contains_any, first_mention,
                                        format_timestamp)
from murmuration.schemas import MESSAGE_SCHEMA
from murmuration.session import durable

# Fixed values.
TRACK_WORDS = [" @"]
LANGUAGES = ["en", "en-gb"]


def read_messages(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.format(file_format).schema(MESSAGE_SCHEMA).load(path)


def stream_messages(spark: SparkSession, path: str, file_format: str = "parquet", words: list[str] | None = None,
                    max_files: int | None = None) -> DataFrame:
    """Message files as they arrive, optionally only messages that contain one of ``words``."""
    reader = spark.readStream.format(file_format).schema(MESSAGE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    messages = reader.load(path)
    return track(messages, words) if words else messages


def stream_lines(spark: SparkSession, path: str | None = None, host: str | None = None,
                 port: int | None = None, max_files: int | None = None) -> DataFrame:
    """Text lines (column ``value``) from files in a folder, or from a socket that somebody else serves."""
    if host is not None:
        return spark.readStream.format("socket").option("host", host).option("port", port).load()
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def line_counts(lines: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """How many lines contain each of two texts, in one pass."""
    return lines.agg(F.count_if(F.contains("value", F.lit(first))).alias(f"lines_with_{first}"),
                     F.count_if(F.contains("value", F.lit(second))).alias(f"lines_with_{second}"))


def track(messages: DataFrame, words: list[str] = TRACK_WORDS) -> DataFrame:
    return messages.where(contains_any(F.col("text"), words))


def filter_language(messages: DataFrame, languages: list[str] = LANGUAGES) -> DataFrame:
    """Messages of users with one of ``languages`` (lower case), upper and lower case alike."""
    return messages.where(F.lower("user.lang").isin(*languages))


def project_users(messages: DataFrame) -> DataFrame:
    """One row per message with its author; ``latest`` keeps one row per author."""
    return messages.select(
        F.col("user.id").cast("string").alias("user_id"),
        name_id("user.screen_name").alias("local_id"),
        F.col("user.name").alias("name"),
        F.col("user.lang").alias("lang"),
        F.col("user.followers_count").alias("followers"),
        F.col("user.friends_count").alias("friends"),
        F.col("user.screen_name").alias("screen_name"),
        F.col("user.statuses_count").alias("statuses"),
    )


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key, as after writing rows in ``order`` to a table with that primary key."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(key).agg(last.alias("last")).select("last.*")


def latest_users(messages: DataFrame) -> DataFrame:
    """One row per author, as of the author's last message; names are hashed after the reduction."""
    slim = messages.select("user", "created_at", "message_id", F.col("user.id").alias("key"))
    last = slim.groupBy("key").agg(F.max_by("user", F.struct("created_at", "message_id")).alias("user"))
    return project_users(last)


def project_messages(messages: DataFrame) -> DataFrame:
    """Stored form of messages: cleaned text, the time kept as a timestamp."""
    return messages.select(
        F.col("message_id").cast("string").alias("message_id"),
        F.col("user.id").cast("string").alias("user_id"),
        name_id("user.screen_name").alias("local_id"),
        "created_at",
        F.col("retweet_count").alias("retweets"),
        clean_text(F.col("text")).alias("text"),
    )


def export_messages(messages: DataFrame) -> DataFrame:
    """``project_messages`` with the creation time in the exchange format."""
    return project_messages(messages).withColumn("created_at", format_timestamp(F.col("created_at")))


def project_communications(messages: DataFrame) -> DataFrame:
    """Sender and first mentioned name (or an empty text) of every message."""
    return messages.select(
        F.col("message_id").cast("string").alias("message_id"),
        F.col("user.id").cast("string").alias("sender_user_id"),
        F.col("user.screen_name").alias("sender_name"),
        first_mention(F.col("text")).alias("dest_name"),
        "text",
    )


def project_geo(messages: DataFrame) -> DataFrame:
    """Longitude and latitude as text, empty where a message has no position."""
    return messages.select(
        "message_id",
        F.coalesce(F.col("geo.lon").cast("string"), F.lit("")).alias("lon"),
        F.coalesce(F.col("geo.lat").cast("string"), F.lit("")).alias("lat"),
    )


def enrich_mentions(messages: DataFrame, users: DataFrame, pattern: str = SHORT_MENTION_PATTERN) -> DataFrame:
    """Name and id of the first mentioned user, empty if there is none or it is unknown: one row per message.

    Of users that share a screen name (renamed accounts) the one with the largest id is meant. Messages without a mention
    are not joined; the users' side is stored, so that the messages to a much-mentioned user can be split among tasks.
    """
    known = durable(users.where("screen_name <> ''").groupBy(F.col("screen_name").alias("dest_name")).agg(
        F.max_by(F.struct(F.col("name").alias("known_name"), F.col("user_id").alias("known_id")), F.struct("user_id", "name"))
        .alias("known"))).select("dest_name", "known.*")
    named = messages.select("message_id", first_mention(F.col("text"), pattern).alias("dest_name"))
    found = named.where("dest_name <> ''").join(known, "dest_name", "left").select("message_id", "dest_name", "known_name", "known_id")
    plain = named.where("dest_name = '' or dest_name is null").select(
        "message_id", "dest_name", F.lit(None).cast("string").alias("known_name"), F.lit(None).cast("string").alias("known_id"))
    return found.unionByName(plain).select(
        "message_id", "dest_name", F.coalesce("known_name", F.lit("")).alias("mentioned_name"),
        F.coalesce("known_id", F.lit("")).alias("mentioned_id"))
