from datetime import datetime, timedelta

import pytest
from golden import CORES, MESSAGES
from pyspark.sql import functions as F

from murmuration.operators.graph import mention_graph, mention_rows
from murmuration.schemas import MESSAGE_SCHEMA
from murmuration.session import new_folder
from murmuration.sources import messages as m
from murmuration.sources.keyed import KeyedTable
from murmuration.sources.tables import read_table, scan, write_period
from murmuration.streaming import pipeline as p
from murmuration.streaming import windows as w

START = datetime(2024, 1, 1)


def message(number, sender, text, lang="en"):
    user = (sum(map(ord, sender)), sender.title(), sender, lang, 1, 2, number)
    return (number, START + timedelta(minutes=number), number, text, user, None)


def all_messages():
    """The golden graph's messages, with the words of two themes, and one that mentions only its author."""
    rows, number = [], 0
    for sender, receiver, count in MESSAGES:
        for _ in range(count):
            number += 1
            theme = "harbour vessel sailing" if number % 2 else "orchard harvest barley"
            rows.append(message(number, sender, f"hello @{receiver} {theme} :) http://t.co/x{number} #tag{number % 3}"))
    rows.append(message(number + 1, "Solo", "just me @Solo"))
    return rows


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(all_messages(), MESSAGE_SCHEMA).cache()


def rows(df):
    return sorted(map(str, df.collect()))


def run_to_end(writer):
    query = writer.start()
    query.awaitTermination()
    assert query.exception() is None


def test_mention_graph_keeps_senders_without_edges(messages):
    graph = mention_graph(mention_rows(messages))
    assert graph.edges.count() == 34
    assert {r["name"] for r in graph.vertices.collect()} == {n for s, d, _ in MESSAGES for n in (s, d)} | {"Solo"}
    assert mention_graph(mention_rows(messages), keep_self=True).edges.count() == 35


def test_source_stream_equals_batch(spark, messages):
    source, sink, checkpoint = (new_folder(spark, n) for n in ("in", "out", "cp"))
    for part in range(3):
        messages.where(F.col("message_id") % 3 == part).coalesce(1).write.mode("append").json(source)
    stream = m.stream_messages(spark, source, "json", words=["vessel"], max_files=1)
    run_to_end(stream.select("message_id").writeStream.format("parquet").option("path", sink)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    assert rows(spark.read.parquet(sink)) == rows(m.track(messages, ["vessel"]).select("message_id"))
    assert m.read_messages(spark, source, "json").count() == messages.count()


def test_projections(spark, messages):
    users = m.latest_users(messages)
    assert {r["screen_name"]: r["statuses"] for r in users.where("screen_name = 'Harold'").collect()} == {
        "Harold": messages.where("user.screen_name = 'Harold'").agg(F.max("message_id")).first()[0]}
    first = m.export_messages(messages).where("message_id = '1'").first()
    assert first["created_at"] == "2024-01-01T00:01:00"
    assert first["text"] == "hello @David harbour vessel sailing   #tag1"
    place = spark.createDataFrame([(1, START, 0, "x", None, (6.5, -7.25)), (2, START, 0, "x", None, None)], MESSAGE_SCHEMA)
    assert rows(m.project_geo(place)) == ["Row(message_id=1, lon='6.5', lat='-7.25')", "Row(message_id=2, lon='', lat='')"]
    mixed = spark.createDataFrame([message(1, "ann", "x", "en-GB"), message(2, "bea", "x", "en"),
                                   message(3, "cas", "x", "fr")], MESSAGE_SCHEMA)
    assert m.filter_language(mixed).count() == 2
    told = m.enrich_mentions(messages, users).where("message_id = 1").first()
    assert (told["dest_name"], told["mentioned_name"]) == ("David", "David")
    assert m.enrich_mentions(messages, users.where("false")).first()["mentioned_id"] == ""
    renamed = users.unionByName(users.withColumn("user_id", F.concat(F.lit("0"), "user_id")))
    assert m.enrich_mentions(messages, renamed).count() == messages.count()


def test_period_table_replay_and_scan(spark):
    path = new_folder(spark, "table")
    assert read_table(spark, path, "v int, period int").count() == 0
    for period in (1, 2, 3, 2):
        write_period(spark.range(period).selectExpr("cast(id as int) as v"), path, period)
    write_period(spark.range(5).selectExpr("cast(id as int) as v"), path, 4)
    write_period(spark.range(0).selectExpr("cast(id as int) as v"), path, 4)
    table = read_table(spark, path, "v int, period int")
    assert table.groupBy("period").count().orderBy("period").collect() == [(1, 1), (2, 2), (3, 3)]
    one = scan(table, ["v"], period=2)
    assert one.columns == ["v"] and one.count() == 2
    assert "PartitionFilters: [isnotnull(period" in one._jdf.queryExecution().executedPlan().toString()


def test_late_rows_are_dropped_and_windows_match_batch(spark):
    source, sink, checkpoint = (new_folder(spark, n) for n in ("in", "out", "cp"))
    schema = "ts timestamp, k string"
    batches = [[(START + timedelta(seconds=s), "a") for s in (1, 12, 25)],
               [(START + timedelta(seconds=s), "b") for s in (70, 90)],
               [(START + timedelta(seconds=2), "late"), (START + timedelta(seconds=300), "a")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        stream = w.windowed_counts(arriving, "ts", "k", "60 seconds", "10 seconds", delay="10 seconds")
        run_to_end(stream.writeStream.outputMode("append").format("parquet").option("path", sink)
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    got = spark.read.parquet(sink)
    assert got.where("k = 'late'").count() == 0
    on_time = spark.createDataFrame(batches[0] + batches[1], schema)
    expected = w.windowed_counts(on_time, "ts", "k", "60 seconds", "10 seconds")
    assert rows(got) == rows(expected)


def test_top_keys(spark):
    data = [(START, k) for k in "aaabbc"] + [(START + timedelta(seconds=11), "z")]
    counts = w.windowed_counts(spark.createDataFrame(data, "ts timestamp, k string"), "ts", "k", "10 seconds", "10 seconds")
    got = {(r["k"], r["cnt"], r["rank"], r["n_keys"]) for r in w.top_keys(counts, "k", 2).collect()}
    assert got == {("a", 3, 1, 3), ("b", 2, 2, 3), ("z", 1, 1, 1)}


def test_top_keys_of_a_stream_in_two_window_sizes(spark):
    """Batches with late rows, rows too late, and a batch taken in twice; equal to counting each row in every window."""
    source, folder, checkpoint = (new_folder(spark, n) for n in ("in", "top", "cp"))
    schema = "ts timestamp, k string"
    top = w.TopKeys(spark, folder, "k", [60, 10], 10, n=2)
    batches = [[(1, "a"), (2, "a"), (3, "b"), (12, "c"), (25, "a")], [(70, "b"), (71, "b"), (64, "c"), (15, "c")],
               [(9, "late"), (75, "a"), (66, "c"), (300, "z")]]
    for batch in batches:
        rows_ = [(START + timedelta(seconds=s), k) for s, k in batch]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(source)
        query = top.start(spark.readStream.schema(schema).parquet(source), "ts", checkpoint, delay="60 seconds")
        query.awaitTermination()
        assert query.exception() is None
    taken = [x for batch in batches for x in batch if x[1] != "late"]
    expected = set()
    for size in (60, 10):
        windows = {}
        for s, k in taken:
            for start in range(s // 10 * 10 - size + 10, s // 10 * 10 + 1, 10):
                windows.setdefault(start, []).append(k)
        for start, keys in windows.items():
            counts = {k: keys.count(k) for k in keys}
            for rank, k in enumerate(sorted(counts, key=lambda k: (-counts[k], k))[:2], start=1):
                expected.add((size, START + timedelta(seconds=start), k, counts[k], rank, len(counts)))

    def got():
        return {(r["size"], r["window_start"], r["k"], r["cnt"], r["rank"], r["n_keys"]) for r in top.read().collect()}

    assert got() == expected
    again = spark.read.parquet(f"{folder}/panes").where("batch = 2").select("pane_start", "k", "cnt")
    top.update(spark.createDataFrame(again.collect(), again.schema), 2)
    assert got() == expected
    with pytest.raises(ValueError):
        w.TopKeys(spark, folder, "k", [15], 10)


def test_keyed_table(spark):
    table = KeyedTable(spark, new_folder(spark, "keyed"), ["k"], 4)
    schema = "k string, v int"

    def put(rows_, version, **more):
        table.upsert(spark.createDataFrame(rows_, schema), version, **more)

    assert table.read(schema=schema).count() == 0 and table.versions() == []
    put([("a", 1), ("b", 1), ("c", 1), (None, 1)], 1)
    put([("b", 2), ("d", 2), ("d", 3)], 2)
    second = rows(table.read())
    assert second == rows(spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), (None, 1), ("d", 2), ("d", 3)], schema))
    put([("b", 2), ("d", 2), ("d", 3)], 2)
    assert rows(table.read()) == second and table.versions() == [1, 2]
    untouched = {b for b, v in table.manifest().items() if v == 1}
    put([("b", 5), (None, 5)], 3, replaced=spark.createDataFrame([("a",)], "k string"))
    assert rows(table.read()) == rows(spark.createDataFrame([("b", 5), ("c", 1), (None, 5), ("d", 2), ("d", 3)], schema))
    assert rows(table.read(2)) == second and untouched
    assert rows(table.lookup(spark.createDataFrame([("d",), ("x",)], "k string"))) == rows(
        spark.createDataFrame([("d", 2), ("d", 3)], schema))
    one = table.get(k="d")
    assert rows(one) == rows(spark.createDataFrame([("d", 2), ("d", 3)], schema))
    assert len({f.rsplit("/", 1)[0] for f in one.inputFiles()}) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "k,d" in plan.replace(" ", "").split("PushedFilters")[1][:80]
    assert table.get(schema, k="absent").count() == 0
    put([], 4)
    assert table.read().count() == 5
    put([], 1)  # a replay of the first version with nothing: it and all after it are made anew by their own replays
    assert table.read(1, schema).count() == 0


def test_word_counts_per_batch(spark):
    source, sink, checkpoint = (new_folder(spark, n) for n in ("in", "out", "cp"))
    for text in ("to be  or", "not to be"):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(source)
        lines = m.stream_lines(spark, source)
        query = w.start_batch_word_counts(lines, lambda counts, batch: write_period(counts, sink, batch), checkpoint,
                                          available_now=True)
        query.awaitTermination()
    got = {(r["period"], r["word"]): r["cnt"] for r in read_table(spark, sink).collect()}
    assert got == {(0, "to"): 1, (0, "be"): 1, (0, ""): 1, (0, "or"): 1, (1, "not"): 1, (1, "to"): 1, (1, "be"): 1}


def test_line_counts(spark):
    lines = spark.createDataFrame([("abc",), ("a",), ("x",)], "value string")
    assert tuple(m.line_counts(lines).first()) == (2, 1)


def test_pipeline_stream_equals_batches_and_replay_changes_nothing(spark, messages):
    settings = p.Settings(k=3, min_size=2, prune_every=2, n_topics=2, iterations=3)
    parts = [messages.where("message_id <= 20"), messages.where("message_id > 20")]
    batch = p.PeriodTables(spark, new_folder(spark, "batch"))
    for period, part in enumerate(parts, start=1):
        p.run_period(batch, part, period, settings)
    names = ("users", "messages", "communications", "graph_vertices", "graph_edges", "tokens", "topics", "communities")
    before = {n: rows(spark.read.parquet(batch.path(n))) for n in names}
    assert len(before["communications"]) == 34
    # The second period prunes to the 2-core before it looks for communities in the 3-core.
    pruned = spark.read.parquet(batch.path("graph_edges")).where("period = 2").count()
    assert pruned == CORES[2][1]
    found = batch.communities().where("period = 2")
    assert found.count() == CORES[3][1] and {r["nbv"] for r in found.collect()} == {6}
    assert all(len(r["cosines"]) == 2 and all(0 <= c <= 1 + 1e-9 for c in r["cosines"]) for r in found.collect())
    p.run_period(batch, parts[1], 2, settings)
    assert {n: rows(spark.read.parquet(batch.path(n))) for n in names} == before

    stream = p.PeriodTables(spark, new_folder(spark, "stream"))
    source, checkpoint = new_folder(spark, "in"), new_folder(spark, "cp")
    for part in parts:
        part.write.mode("append").parquet(source)
        query = p.start_pipeline(m.stream_messages(spark, source), stream, checkpoint, settings)
        query.awaitTermination()
    exact = [n for n in names if n not in ("topics", "communities")]
    assert {n: rows(spark.read.parquet(stream.path(n))) for n in exact} == {n: before[n] for n in exact}
    assert rows(stream.communities().drop("cosines")) == rows(batch.communities().drop("cosines"))
    assert stream.users().count() == messages.select("user.id").distinct().count()


@pytest.mark.parametrize("doc_level", ["community", "token"])
def test_pipeline_options(spark, messages, doc_level):
    tables = p.PeriodTables(spark, new_folder(spark, "options"))
    settings = p.Settings(k=2, min_size=2, n_topics=2, iterations=2, doc_level=doc_level, stored_texts=True,
                          languages=("en",), optimizer="em")
    p.run_period(tables, messages, 1, settings)
    assert tables.communities().count() == CORES[2][1]
    assert tables.topics().count() > 0


@pytest.mark.parametrize("stored", [False, True])
def test_repeated_messages_and_stored_texts_count_once(spark, messages, stored):
    """Every message is delivered in two periods; edges and words are counted as if it came once."""
    settings = p.Settings(k=2, min_size=2, n_topics=2, iterations=2, prune_every=9, stored_texts=stored)
    tables = p.PeriodTables(spark, new_folder(spark, "twice"))
    p.run_period(tables, messages, 1, settings)
    once = rows(tables.tokens().groupBy("doc_id", "term").count())
    p.run_period(tables, messages, 2, settings)
    assert tables.graph_of(2, 9).edges.count() == 34
    assert tables.messages().count() == messages.count() and tables.communications().count() == 34
    assert rows(tables.tokens().groupBy("doc_id", "term").count()) == once and once
    p.run_period(tables, messages.where("false"), 1, settings)
    assert tables.tokens().where("period = 1").count() == 0 and tables.communities().where("period = 1").count() == 0


def test_message_delivered_again_with_other_mentions(spark):
    """Its old edges leave the graph and the communities, however the periods between them pruned."""
    def ring(first, names):
        return [message(first + i, a, f"hello @{b}") for i, (a, b) in enumerate(zip(names, names[1:] + names[:1]))]

    start = ring(1, ["anna", "bert", "carl"]) + ring(11, ["dora", "emil", "fred"]) + [message(21, "anna", "hello @dora")]
    again = [message(21, "anna", "hello @nobody"), message(1, "anna", "hello @bert"), message(12, "emil", "nothing")]
    settings = p.Settings(k=2, min_size=2, topics=False, prune_every=2)
    tables = p.PeriodTables(spark, new_folder(spark, "again"))
    for period, batch in enumerate([start, again, [message(30, "emil", "hello @fred")]], start=1):
        p.run_period(tables, spark.createDataFrame(batch, MESSAGE_SCHEMA), period, settings)
    sizes = {period: sorted(r["nbv"] for r in tables.edges().where(f"period = {period}").select("com_id", "nbv").distinct().collect())
             for period in (1, 2, 3)}
    assert sizes == {1: [6], 2: [3], 3: [3]}  # without its second message the second ring is none; pruning took the rest of it
    assert tables.graph_of(3, 2).edges.where("attr in ('21', '12')").count() == 0
    assert {r["message_id"] for r in tables.communications().collect()} >= {"1", "2", "3", "11", "13", "21", "30"}
    assert tables.communications().where("message_id = '12'").count() == 0
    p.run_period(tables, spark.createDataFrame(again, MESSAGE_SCHEMA), 2, settings)
    assert tables.edges().where("period = 2").count() == 3


def test_bootstrap_from_stored_messages(spark, messages):
    """Stored messages make the corpus of period 0 and a first model; they count once, and add nothing to the graph."""
    settings = p.Settings(k=2, min_size=2, n_topics=2, iterations=2, prune_every=9)
    tables = p.PeriodTables(spark, new_folder(spark, "boot"))
    stored = messages.where("message_id <= 10")
    for _ in range(2):
        p.bootstrap(tables, stored, settings)
    words = {r["term"]: r["cnt"] for r in tables.terms().where("period = 0").collect()}
    assert words["harbour"] == words["orchard"] == 5 and tables.topics().where("period = 0").count() > 0
    p.run_period(tables, messages, 1, settings)
    assert tables.graph_of(1, 9).edges.count() == 34
    assert tables.tokens().where("period = 1").join(tables.tokens().where("period = 0"), "doc_id").count() == 0
    total = {r["term"]: r["n"] for r in tables.terms().groupBy("term").agg(F.sum("cnt").alias("n")).collect()}
    by_document = {r["term"]: r["n"] for r in tables.tokens().groupBy("term").agg(F.sum("cnt").alias("n")).collect()}
    assert total == by_document
    scores = tables.scores().where("period = 1").collect()
    assert sorted(r["sg"] for r in scores) == list(range(len(scores))) and all(len(r["cosines"]) == 2 for r in scores)


def test_periods(spark):
    moments = spark.createDataFrame([(START + timedelta(seconds=s),) for s in (0, 59, 60, 200)], "ts timestamp")
    got = [r[0] for r in moments.select(w.period_number(F.col("ts"), 60, START)).collect()]
    assert got == [1, 1, 2, 4]
