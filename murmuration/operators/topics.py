"""Vocabulary, document vectors, LDA topics and the similarity of topics and communities.

Tokens stay rows ``(doc_id, term)``; they are counted before any shuffle that a frequent term could overload.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from murmuration.functions.ranking import with_dense_index
from murmuration.functions.text import is_topic_word, split_words
from murmuration.operators import lda
from murmuration.session import durable

# Settings of the topic model.
N_TOPICS = 10
DOC_CONCENTRATION = 1.2
TOPIC_CONCENTRATION = 1.2
EM_ITERATIONS = 20
ONLINE_ITERATIONS = 50
WORDS_PER_TOPIC = 12


def document_words(documents: DataFrame, doc: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """``doc_id, term``: the topic words of whole texts, one row per occurrence."""
    words = documents.select(F.col(doc).alias("doc_id"), F.explode(split_words(F.col(text))).alias("term"))
    return words.where(is_topic_word(F.col("term"), **rule))


def as_token_documents(words: DataFrame) -> DataFrame:
    """Every single token its own document; for parity with a corpus that was built that way."""
    return words.select(F.monotonically_increasing_id().alias("doc_id"), "term")


def term_counts(words: DataFrame) -> DataFrame:
    """``term, cnt``, from tokens or from tokens already counted per document."""
    counted = F.sum("cnt") if "cnt" in words.columns else F.count("*")
    return words.groupBy("term").agg(counted.alias("cnt"))


def vocabulary(words: DataFrame, drop_most_frequent: int = 0) -> DataFrame:
    """``term, term_id, cnt``: terms numbered by falling count, then alphabetically, without the first few."""
    ranked = with_dense_index(term_counts(words), [F.desc("cnt"), F.col("term")], "place")
    return (ranked.where(F.col("place") >= drop_most_frequent)
            .select("term", (F.col("place") - drop_most_frequent).cast("int").alias("term_id"), "cnt"))


def doc_term_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"))


def term_vectors(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, features``: sparse counts over the vocabulary, from ``doc_term_counts``.

    Terms come counted per document, so that a row is bounded by the number of distinct terms, however long the
    document. The vocabulary is joined, never brought to the driver. The vectors are stored in the form in which Spark
    keeps sparse vectors and read back as such, so no row passes through Python.
    """
    size = terms.count()
    known = counts.join(terms.select("term", "term_id"), "term")
    entries = F.sort_array(F.collect_list(F.struct("term_id", F.col("cnt").cast("double").alias("cnt"))))
    stored = durable(known.groupBy("doc_id").agg(entries.alias("e")).select("doc_id", F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
        F.col("e.term_id").alias("indices"), F.col("e.cnt").alias("values")).alias("features")))
    schema = StructType([stored.schema["doc_id"], StructField("features", VectorUDT())])
    vectors = stored.sparkSession.read.schema(schema).parquet(stored.stored_at)
    vectors.stored_at = stored.stored_at
    return vectors


def fit_topics(vectors: DataFrame, optimizer: str = "em", k: int = N_TOPICS, iterations: int | None = None,
               seed: int = 7) -> lda.TopicModel:
    """LDA by expectation maximisation (``em``) or online variational Bayes (``online``).

    Both keep the topics as a table, see ``lda``; the driver holds sums per topic.
    """
    default = EM_ITERATIONS if optimizer == "em" else ONLINE_ITERATIONS
    return lda.fit(vectors, optimizer, k, iterations or default, DOC_CONCENTRATION, TOPIC_CONCENTRATION, seed)


def describe_topics(model: lda.TopicModel, terms: DataFrame, n_words: int = WORDS_PER_TOPIC) -> DataFrame:
    """``n_topic, position, term, weight``: the heaviest words of each topic, looked up in the vocabulary."""
    rows = model.describeTopics(n_words).select(
        F.col("topic").alias("n_topic"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("position", "t"))
    return (rows.select("n_topic", "position", F.col("t.termIndices").alias("term_id"),
                        F.col("t.termWeights").alias("weight"))
            .join(terms.select("term", "term_id"), "term_id")
            .select("n_topic", "position", "term", "weight"))


def topic_cosines(topics: DataFrame, words: DataFrame, cumulative: bool = False) -> DataFrame:
    """``com_id, n_topic, cosine`` for every community that uses a word of the topic.

    ``topics(n_topic, term, weight)``; ``words(com_id, term)``. The cosine is between the weights of a topic's terms
    and the community's counts of these terms. ``cumulative`` compares each topic together with all earlier ones.
    Pairs without a row have the cosine 0; ``cosine_arrays`` fills them in.
    """
    counts = words.groupBy("com_id", "term").agg(F.count("*").alias("cnt"))
    parts = (topics.join(counts, "term").groupBy("com_id", "n_topic")
             .agg(F.sum(F.col("weight") * F.col("cnt")).alias("dot"),
                  F.sum(F.col("cnt") * F.col("cnt")).cast("double").alias("counted")))
    norms = topics.groupBy("n_topic").agg(F.sum(F.col("weight") * F.col("weight")).alias("weighed"))
    if cumulative:
        return _cumulative_cosines(parts, norms)
    size = F.sqrt("weighed") * F.sqrt("counted")
    return (parts.join(norms, "n_topic")
            .select("com_id", "n_topic", F.when(size > 0, F.col("dot") / size).otherwise(0.0).alias("cosine")))


def _cumulative_cosines(parts: DataFrame, norms: DataFrame) -> DataFrame:
    """Running sums over the topic numbers; the groups hold one row per topic."""
    by_topic = F.map_from_entries(F.collect_list(F.struct("n_topic", F.struct("dot", "counted"))))
    weights = norms.agg(F.map_from_entries(F.collect_list(F.struct("n_topic", "weighed")))).first()[0] or {}
    numbers = sorted(weights)
    running, total = [], 0.0
    for number in numbers:
        total += weights[number]
        running.append((number, total))
    gathered = parts.groupBy("com_id").agg(by_topic.alias("parts"))
    rows = []
    for position, (number, weighed) in enumerate(running):
        dot, counted = F.lit(0.0), F.lit(0.0)
        for earlier in numbers[:position + 1]:
            part = F.element_at("parts", F.lit(earlier))
            dot = dot + F.coalesce(part["dot"], F.lit(0.0))
            counted = counted + F.coalesce(part["counted"], F.lit(0.0))
        size = F.sqrt(F.lit(weighed)) * F.sqrt(counted)
        rows.append(F.struct(F.lit(number).alias("n_topic"), F.when(size > 0, dot / size).otherwise(0.0).alias("cosine")))
    return gathered.select("com_id", F.explode(F.array(*rows)).alias("r")).select("com_id", "r.*")


def cosine_arrays(cosines: DataFrame, com_ids: DataFrame, n_topics: int) -> DataFrame:
    """``com_id, cosines``: one array per community in topic order, 0.0 where they share no word."""
    by_topic = F.map_from_entries(F.collect_list(F.struct("n_topic", "cosine")))
    gathered = cosines.groupBy("com_id").agg(by_topic.alias("found"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n_topics - 1)),
                         lambda i: F.coalesce(F.element_at("found", i), F.lit(0.0)))
    nothing = F.array_repeat(F.lit(0.0), n_topics)
    return (com_ids.select("com_id").join(gathered, "com_id", "left")
            .select("com_id", F.when(F.col("found").isNull(), nothing).otherwise(filled).alias("cosines")))


def topic_model(words: DataFrame, optimizer: str = "em", k: int = N_TOPICS, iterations: int | None = None,
                drop_most_frequent: int = 0, n_words: int = WORDS_PER_TOPIC) -> DataFrame:
    """Topics of a corpus: vocabulary, vectors, fit and description in one call.

    The texts are read once; the vocabulary and the vectors both come from the stored counts per document.
    """
    counts = durable(doc_term_counts(words))
    return topic_model_of_counts(counts, counts, optimizer, k, iterations, drop_most_frequent, n_words)


def topic_model_of_counts(counts: DataFrame, term_totals: DataFrame, optimizer: str = "em", k: int = N_TOPICS,
                          iterations: int | None = None, drop_most_frequent: int = 0, n_words: int = WORDS_PER_TOPIC) -> DataFrame:
    """``topic_model`` of a corpus that is kept as ``counts(doc_id, term, cnt)`` and ``term_totals(term, cnt)``.

    Totals of several periods add up, so the vocabulary is made of one row per term and period, not of tokens.
    """
    terms = durable(vocabulary(term_totals, drop_most_frequent))
    vectors = term_vectors(counts, terms)
    if vectors.isEmpty():
        return counts.sparkSession.createDataFrame([], "n_topic int, position int, term string, weight double")
    return describe_topics(fit_topics(vectors, optimizer, k, iterations), terms, n_words)
