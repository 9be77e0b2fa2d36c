import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmuration.functions.text import topic_words
from murmuration.operators import topics as t
from murmuration.sources import export as x


@pytest.fixture(scope="module")
def words(spark, sf):
    return t.document_words(spark.read.parquet(f"{sf}/documents.parquet")).cache()


def test_vocabulary_is_dense_and_ordered(spark, words):
    counts = Counter(r["term"] for r in words.collect())
    order = sorted(counts, key=lambda term: (-counts[term], term))
    got = {r["term"]: (r["term_id"], r["cnt"]) for r in t.vocabulary(words, 20).collect()}
    assert got == {term: (i, counts[term]) for i, term in enumerate(order[20:])}
    assert t.vocabulary(t.doc_term_counts(words), 20).count() == len(got)


def test_vectors_hold_every_token_of_the_vocabulary(spark):
    rows = [("a", "ships"), ("a", "ships"), ("a", "ocean"), ("b", "ocean"), ("c", "other")]
    words = spark.createDataFrame(rows, "doc_id string, term string")
    terms = spark.createDataFrame([("ships", 0), ("ocean", 1)], "term string, term_id int")
    vectors = {r["doc_id"]: r["features"].toArray().tolist()
               for r in t.term_vectors(t.doc_term_counts(words), terms).collect()}
    assert vectors == {"a": [2.0, 1.0], "b": [0.0, 1.0]}


def test_token_documents(spark):
    words = spark.createDataFrame([("a", "ships"), ("a", "ships"), ("b", "ocean")], "doc_id string, term string")
    single = t.doc_term_counts(t.as_token_documents(words))
    assert sorted(r["cnt"] for r in single.collect()) == [1, 1, 1]


@pytest.mark.parametrize("optimizer", ["em", "online"])
def test_lda_topics(spark, words, optimizer):
    some = words.where("length(term) <= 5")
    counts = t.doc_term_counts(some)
    terms = t.vocabulary(counts)
    model = t.fit_topics(t.term_vectors(counts, terms), optimizer, k=3, iterations=5)
    weights = model.topicsMatrix().toArray().sum(axis=0)
    assert all(w > 0 for w in weights)
    if optimizer == "online":
        everything = model.describeTopics(terms.count()).collect()
        assert all(math.isclose(sum(r["termWeights"]), 1.0, rel_tol=1e-6) for r in everything)
    topics = t.describe_topics(model, terms, 4).collect()
    assert len(topics) == 12 and {r["n_topic"] for r in topics} == {0, 1, 2}
    for number in range(3):
        ordered = [r["weight"] for r in sorted(topics, key=lambda r: r["position"]) if r["n_topic"] == number]
        assert ordered == sorted(ordered, reverse=True)


def test_lda_repeats_with_its_seed(spark, words):
    some = words.where("length(term) <= 4")
    first, second = (sorted(map(tuple, t.topic_model(some, "online", k=2, iterations=3).collect())) for _ in range(2))
    assert [r[:3] for r in first] == [r[:3] for r in second]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-6) for a, b in zip(first, second))


def test_vectors_need_no_python(words):
    counts = t.doc_term_counts(words)
    plan = t.term_vectors(counts, t.vocabulary(counts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Scan parquet" in plan


def test_empty_corpus_has_no_topics(spark, words):
    assert t.topic_model(words.where("false")).count() == 0


TOPICS = [(0, "ship", 0.6), (0, "sail", 0.8), (1, "corn", 1.0), (2, "none", 0.5)]
WORDS = [(7, "ship")] * 3 + [(7, "sail")] * 4 + [(7, "corn"), (8, "corn"), (9, "idle")]


def cosines(spark, cumulative=False):
    topics = spark.createDataFrame(TOPICS, "n_topic int, term string, weight double")
    words = spark.createDataFrame(WORDS, "com_id long, term string")
    ids = spark.createDataFrame([(7,), (8,), (9,)], "com_id long")
    arrays = t.cosine_arrays(t.topic_cosines(topics, words, cumulative), ids, 3)
    return {r["com_id"]: r["cosines"] for r in arrays.collect()}


def test_cosines(spark):
    got = cosines(spark)
    assert got[7] == pytest.approx([1.0, 1.0, 0.0])
    assert got[8] == pytest.approx([0.0, 1.0, 0.0])
    assert got[9] == [0.0, 0.0, 0.0]


def test_cumulative_cosines(spark):
    got = cosines(spark, cumulative=True)
    both = (3 * 0.6 + 4 * 0.8 + 1.0) / (math.sqrt(2.0) * math.sqrt(26))
    three = (3 * 0.6 + 4 * 0.8 + 1.0) / (math.sqrt(2.25) * math.sqrt(26))
    assert got[7] == pytest.approx([1.0, both, three])
    assert got[8] == pytest.approx([0.0, 1 / math.sqrt(2.0), 1 / math.sqrt(2.25)])


def test_topic_words_column_and_rows_agree(spark, words, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    arrays = documents.agg(F.sum(F.size(topic_words(F.col("text"))))).first()[0]
    assert arrays == words.count()


def test_export(spark):
    rows = spark.createDataFrame(
        [(1, 3, 5, 5, 6, [0.2, 0.9]), (1, 3, 5, 6, 9, [0.2, 0.9]), (1, 2, 7, 7, 8, [0.4, 0.4]), (2, 2, 7, 7, 8, [0.1, 0.0])],
        "period int, nbv long, com_id long, src long, dst long, cosines array<double>")
    topics = spark.createDataFrame([(1, 0, 0, "sea"), (1, 0, 1, "ship"), (1, 1, 0, "corn")],
                                   "period int, n_topic int, position int, term string")
    shown = x.period_communities(rows, 1, 0)
    nodes = x.export_nodes(shown)
    assert [tuple(r) for r in nodes.orderBy("node_index").collect()] == [(0, 5, 5), (1, 6, 5), (2, 7, 7), (3, 8, 7), (4, 9, 5)]
    links = {tuple(r) for r in x.export_links(shown, nodes).collect()}
    assert links == {(0, 1, 5, 6, 1), (1, 4, 6, 9, 1), (2, 3, 7, 8, 1)}
    assert x.period_communities(rows, 1, 3).count() == 2
    assert {tuple(r) for r in x.export_cosines(shown).collect()} == {(1, 5, "0.2;0.9"), (1, 7, "0.4;0.4")}
    assert {tuple(r) for r in x.export_topics(topics).collect()} == {(1, 0, "sea;ship"), (1, 1, "corn")}
    assert {r["group"]: r["n_nodes"] for r in x.nodes_per_group(nodes).collect()} == {5: 3, 7: 2}
    ranked = [tuple(r) for r in x.ranked_topics(shown, topics).orderBy("com_id", "rank").collect()]
    assert ranked == [(1, 5, 1, 1, 0.9, "corn"), (1, 5, 2, 0, 0.2, "sea;ship"),
                      (1, 7, 1, 0, 0.4, "sea;ship"), (1, 7, 2, 1, 0.4, "corn")]
    numbered = shown.withColumn("sg", F.when(F.col("com_id") == 5, 0).otherwise(1))
    assert {(r["name"], r["sg"]) for r in x.export_nodes(numbered).collect()} == {(5, 0), (6, 0), (9, 0), (7, 1), (8, 1)}
    scores = spark.createDataFrame([(1, 5, 0, [0.2, 0.9]), (1, 7, 1, [0.4, 0.4])], "period int, com_id long, sg long, cosines array<double>")
    assert {tuple(r) for r in x.export_cosines(scores).collect()} == {(1, 5, 0, "0.2;0.9"), (1, 7, 1, "0.4;0.4")}
    assert [tuple(r) for r in x.ranked_topics(scores, topics).orderBy("com_id", "rank").collect()] == ranked
    assert x.export_json(nodes.where("name = 5")).first()[0] == '{"node_index":0,"name":5,"group":5}'


def test_topics_are_counted_in_blocks(spark, monkeypatch):
    """EM over many blocks equals the same rounds on whole matrices; the topics are a table of one row per term."""
    import numpy as np

    from murmuration.operators import lda

    rng = np.random.default_rng(3)
    rows = [(d, t_, int(c)) for d in range(30) for t_ in range(12) if (c := rng.integers(0, 4))]
    counts = spark.createDataFrame([(d, f"w{t_}", c) for d, t_, c in rows], "doc_id long, term string, cnt long")
    terms = spark.createDataFrame([(f"w{t_}", t_) for t_ in range(12)], "term string, term_id int")
    monkeypatch.setattr(lda, "ENTRIES_PER_BLOCK", 20)
    model = lda.fit(t.term_vectors(counts, terms), "em", 2, 4, 1.2, 1.2, 7)
    assert model.weights.count() == 12 and "block" not in model.weights.columns

    seeds = {r["doc_id"]: r["s"] for r in spark.range(30).selectExpr("id as doc_id", "xxhash64(id) as s").collect()}
    doc, term, cnt = (np.array(c) for c in zip(*rows))
    shares = lda._uniforms(np.array([seeds[d] for d in doc]), term, 2, 7)
    for done in range(5):
        if done:
            shares = (by_term[term] + 0.2) * (by_doc[doc] + 0.2) / (by_term.sum(axis=0) + 12 * 0.2)
        shares = shares / shares.sum(axis=1)[:, None] * cnt[:, None]
        by_term = np.column_stack([np.bincount(term, shares[:, i], 12) for i in range(2)])
        by_doc = np.column_stack([np.bincount(doc, shares[:, i], 30) for i in range(2)])
    assert model.topicsMatrix().toArray() == pytest.approx(by_term, abs=1e-9)


def test_special_functions():
    import numpy as np

    from murmuration.operators import lda

    assert lda.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649015329, -1.9635100260214235], abs=1e-10)
    assert lda.trigamma(np.array([1.0, 0.5])) == pytest.approx([math.pi ** 2 / 6, math.pi ** 2 / 2], abs=1e-9)


@pytest.mark.parametrize("optimizer", ["em", "online"])
def test_slices_of_a_block_change_nothing(spark, words, monkeypatch, optimizer):
    """Whole documents in every slice; counts that are no whole numbers are kept too."""
    from murmuration.operators import lda

    counts = t.doc_term_counts(words).withColumn("cnt", F.col("cnt") + 0.25)
    vectors = t.term_vectors(counts, t.vocabulary(t.doc_term_counts(words)))
    monkeypatch.setattr(lda, "SHARE", 0.5)
    found = []
    for at_once in (3, 1_000_000):
        monkeypatch.setattr(lda, "ENTRIES_AT_ONCE", at_once)
        found.append(lda.fit(vectors, optimizer, 2, 3, 1.2, 1.2, 7).topicsMatrix().toArray())
    assert found[0] == pytest.approx(found[1], rel=1e-9)


def test_documents_are_read_once_for_several_rounds(spark, words, monkeypatch):
    """Every round's sample is that of its own hash, and twelve rounds take two passes over the documents."""
    from murmuration.operators import lda

    counts = t.doc_term_counts(words)
    docs = lda.sparse_rows(t.term_vectors(counts, t.vocabulary(counts)))
    seeds = {r["doc"]: r["seed"] for r in docs.collect()}
    monkeypatch.setattr(lda, "SHARE", 0.3)
    made, new_folder = [], lda.new_folder
    monkeypatch.setattr(lda, "new_folder", lambda spark, purpose: made.append(purpose) or new_folder(spark, purpose))
    ids = spark.createDataFrame([*seeds.items()], "doc long, seed long")
    for done, (batch, n, entries) in enumerate(lda._batches(docs, 12, 7), 1):
        share = F.pmod(F.xxhash64("seed", F.lit(f"7 {done}")), F.lit(1 << 30)) / float(1 << 30)
        rows = batch.collect()
        assert sorted(r["doc"] for r in rows) == sorted(r["doc"] for r in ids.where(share < 0.3).collect())
        assert n == len(rows) and entries == sum(len(r["indices"]) for r in rows)
    assert done == 12 and made == ["sampled"] * 2
