"""Queries of the operators whose work is done in Arrow batches; the tests hold them against brute force or held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuration.llm import language, toxicity
from murmuration.llm.common import query, table
from murmuration.llm.decontaminate import leaks
from murmuration.llm.html_text import extract_main_text
from murmuration.llm.jaccard import similar_groups
from murmuration.llm.packing import packed


def tokenizer_path() -> str:
    """The installed byte-level vocabulary; it is a parameter of ``packed``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, folder, "pages"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by a model of the labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scores(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op5_harmonic_packing")
def op5_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1024 ids."""
    return packed(table(spark, folder, "documents"), tokenizer_path())


@query("op7_language_spans")
def op7_language_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by a model of the documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    return (language.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score", "lang_spans"))


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item found in a document, with its edit distance."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every document among those linked by shared five-word shingles."""
    return similar_groups(table(spark, folder, "documents"))
