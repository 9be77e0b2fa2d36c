from golden import NAME_IDS
from pyspark.sql import functions as F

from murmuration.functions import text as t
from murmuration.functions.ids import name_id
from murmuration.functions.ranking import with_dense_index


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_name_ids(spark):
    rows = spark.createDataFrame([(n,) for n in NAME_IDS] * 2 + [(None,)], "name string")
    ids = {r["name"]: r["id"] for r in rows.select("name", name_id("name").alias("id")).collect()}
    assert ids == {**NAME_IDS, None: None}


def test_mentions(spark):
    text = "Hey @bob and @LongerName_17, mail a@example.org"
    assert value(spark, t.all_mentions, text) == ["bob", "LongerName_17", "example"]
    bounded = t.mention_pattern(require_boundary=True)
    assert value(spark, lambda c: t.all_mentions(c, bounded), text) == ["bob", "LongerName_17"]
    assert value(spark, t.first_mention, text) == "bob"
    assert value(spark, t.first_mention, "hi @ab") == ""
    assert value(spark, lambda c: t.first_mention(c, t.SHORT_MENTION_PATTERN), "hi @ab") == "ab"
    assert t.mention_pattern() == t.MENTION_PATTERN and t.mention_pattern(1) == t.SHORT_MENTION_PATTERN


def test_cleaning(spark):
    assert value(spark, t.clean_text, "x :) http://t.co/ab1 y") == "x   y"
    assert value(spark, t.clean_text, "a;-D b:O c=3 d:x") == "a b c d:x"
    assert value(spark, t.punctuation_to_space, "a!b?c.d,e:f;g<h>i)j(k") == "a b c d e f g h i j k"


def test_topic_words(spark):
    text = "I think that well-known étés are time; thats éthat don't"
    assert value(spark, t.topic_words, text) == ["étés", "thats", "éthat"]
    assert len(t.STOP_WORDS) == 49


def test_hashtags_and_track(spark):
    assert value(spark, t.hashtags, "#a b #c x#d") == ["#a", "#c"]
    assert value(spark, lambda c: t.contains_any(c, [" @", "zz"]), "hi @bob") is True
    assert value(spark, lambda c: t.contains_any(c, [" @"]), "@bob") is False


def test_dense_index_follows_the_order_over_many_partitions(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as v").repartition(7)
    indexed = with_dense_index(rows, [F.desc("v")], "n")
    got = sorted((r["n"], r["v"]) for r in indexed.collect())
    assert got == [(i, 999 - i) for i in range(1000)]
    assert with_dense_index(rows.where("false"), [F.col("v")], "n").count() == 0
