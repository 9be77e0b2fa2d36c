import re

import corpus_pipeline
from murmuration.llm import decontaminate
from murmuration.llm.common import Tables

from test_llm_python import check_packed, groups_brute


def test_toxic_documents_go(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    kept = {r.doc_id for r in kept.select("doc_id").collect()}
    slurs = re.compile(r"\b(idiot|moron|clown|scum|loser|trash|worthless|pathetic)\b")
    english = [(r.doc_id, len(slurs.findall(r.text))) for r in docs.where("lang = 'en'").collect()]
    toxic, clean = [d for d, n in english if n >= 3], [d for d, n in english if n == 0]
    assert len(toxic) > 100 and sum(d not in kept for d in toxic) > 0.95 * len(toxic)
    assert sum(d in kept for d in clean) > 0.97 * len(clean)


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept, tables = docs.columns, {}, Tables(spark)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = tables.put("stage", stage(spark, docs, sf))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and after.items() <= before.items()
        kept[name] = (before, after)
    before, after = kept["exact dedup"]
    largest = {}
    for doc_id, text in before.items():
        key = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        largest[key] = max(doc_id, largest.get(key, -1))
    assert set(after) == set(largest.values())
    before, after = kept["n-gram Jaccard join"]
    assert set(after) == {component for _, _, component in groups_brute(sorted(before.items()))}
    before, after = kept["benchmark decontamination"]
    items = [decontaminate.normal_form(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {d for d, t in before.items() if any(i in decontaminate.normal_form(t) for i in items)}
    assert set(before) - set(after) == dirty
    check_packed(corpus_pipeline.pack(spark, docs, sf).collect(), after)


def test_run_returns_the_last_stage(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[:2] == ["doc_id", "start"] and rows.count() > 0


def test_stages_keep_clashing_columns_and_odd_rows(spark, sf):
    rows = [(1, "Some words that are said here", "a"), (1, "Some words that are said here", "a"), (None, "other words said there", "b"),
            (3, None, None), (4, "some words that are SAID here", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "kept"]
    got = sorted((tuple(r) for r in docs.collect()), key=str)
    assert got == sorted([rows[2], rows[3], rows[4]], key=str)
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_texts_under_one_id_are_judged_apart(spark, sf):
    base = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(base), " ".join(base[:-1] + ["x"]), " ".join(f"u{i}" for i in range(60))
    spaced = a.replace(" ", "  ")  # the same shingles in another text
    docs = spark.createDataFrame([(1, a, 0), (2, near, 1), (2, other, 2), (1, spaced, 3), (3, None, 4)], "doc_id long, text string, moved_id int")
    got = corpus_pipeline.drop_similar(spark, docs, sf).collect()
    assert sorted(r.moved_id for r in got if r.moved_id not in (0, 3)) == [2, 4] and sum(r.moved_id in (0, 3) for r in got) == 1
    assert docs.columns == got[0].__fields__


def test_kept_rows_are_whole_rows(spark, sf):
    rows = [(1, "A b", {"k": 1}), (2, "a B", {"k": 2}), (None, "a b", {"k": 3}), (None, "c", None), (5, None, None), (6, "", {"k": 4})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>")
    got = corpus_pipeline.drop_copies(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[5]], key=str)
