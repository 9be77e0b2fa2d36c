"""Documents to training sequences: each stage takes what the one before it kept, stored as Parquet."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import toxicity
from murmuration.llm.common import Tables, table
from murmuration.llm.decontaminate import clean_documents
from murmuration.llm.dedup import kept_rows
from murmuration.llm.jaccard import superseded, text_key
from murmuration.llm.packing import packed
from murmuration.llm.python_queries import tokenizer_path
from murmuration.session import configure

MARK = "_pipeline_mark"  # columns a stage adds for itself and takes away again
SCORE = "_pipeline_score"


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage also runs alone, in a session that somebody else built."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(configure(spark), docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; a row without text is kept or not by the classifier's bias."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model, SCORE, MARK).where(F.col(MARK) == 0).select(*docs.columns)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; one of several rows that repeat that id and the text."""
    return kept_rows(docs)


@stage
def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked texts the document with the smallest id, and of its texts one; rows without an id are in no group."""
    moved = Tables(spark).put("moved", superseded(docs.select("doc_id", "text")))
    same = (docs["doc_id"] == moved["moved_id"]) & (text_key(docs["text"]) == moved["moved_text"])
    return docs.join(moved, same, "left_anti").select(*docs.columns)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    return packed(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_similar),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None  # the classifier, edit distances and tokens are beyond SQL; tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all ``documents``; a stage's table goes once the next is stored."""
    tables, docs, stored = Tables(spark), table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        docs = tables.put(name.replace(" ", "-"), function(spark, docs, sf_dir))
        if stored is not None:
            tables.drop(stored)
        stored = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
