"""Streams over files, windowed counts, periods and the whole pipeline."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmuration.operators import community as c
from murmuration.operators import graph as g
from murmuration.plans import inputs
from murmuration.plans.registry import query
from murmuration.plans.sql import clean_sql, components_sql, kcore_sql, punctuation_sql, topic_words_sql
from murmuration.session import durable, new_folder
from murmuration.sources import messages as m
from murmuration.sources.keyed import KeyedTable
from murmuration.sources.tables import read_table, write_period
from murmuration.streaming import pipeline as p
from murmuration.streaming import windows as w

MSG = f"with {inputs.MESSAGES_SQL}\n"
ORIGIN = datetime(2024, 1, 1)
DAY = 86_400


def _finish(stream):
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


@query("stream_source", MSG + "select message_id, screen_name, created_at, text from msg where contains(text, ' @')")
def stream_source(spark, folder):
    """Message files read as a stream with a keyword, written by a streaming sink, read back."""
    source, sink, checkpoint = (new_folder(spark, name) for name in ("messages", "tracked", "stream"))
    inputs.messages(spark, folder).write.parquet(source)
    stream = m.stream_messages(spark, source, words=m.TRACK_WORDS)
    tracked = stream.select("message_id", "user.screen_name", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                            "text")
    _finish(tracked.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    return read_table(spark, sink)


@query("word_count", """
with lines as (select unnest(string_split(text, chr(10))) as value from documents),
words as (select unnest(string_split(value, ' ')) as word from lines)
select word, count(*) as cnt from words group by word""")
def word_count(spark, folder):
    """All lines of all documents as one batch of a line stream."""
    source, sink, checkpoint = (new_folder(spark, name) for name in ("lines", "counts", "stream"))
    inputs.table(spark, folder, "documents").select("text").write.text(source)
    lines = m.stream_lines(spark, source)
    _finish(w.start_batch_word_counts(lines, lambda counts, batch: write_period(counts, sink, batch), checkpoint,
                                      available_now=True))
    return read_table(spark, sink).select("word", "cnt")


COUNTS = """
slot as (
  select event_type, unnest(range(0, 6)) as back, date_trunc('hour', ts) as hour from events
),
counted as (
  select hour - to_hours(cast(back as int)) as window_start, event_type, count(*) as cnt from slot group by 1, 2
)"""


@query("windowed_topk", """
with slot as (select user_id, unnest(range(0, 6)) as back, date_trunc('hour', ts) as hour from events),
counted as (
  select hour - to_hours(cast(back as int)) as window_start, user_id, count(*) as cnt from slot group by 1, 2
),
ranked as (
  select window_start, user_id, cnt, row_number() over (partition by window_start order by cnt desc, user_id) as rank,
         count(*) over (partition by window_start) as n_keys
  from counted
)
select window_start, user_id, cnt, rank, n_keys from ranked where rank <= 10""")
def windowed_topk(spark, folder):
    """Ten most active users of every six hours, hourly."""
    counts = durable(w.windowed_counts(inputs.events(spark, folder), "ts", "user_id", "6 hours", "1 hour"))
    return (w.top_keys(counts, "user_id")
            .select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "cnt", "rank", "n_keys"))


@query("windowed_hashtags", MSG + """,
word as (select created_at, unnest(string_split(text, ' ')) as tag from msg),
slot as (
  select tag, unnest(range(0, 6)) as back, date_trunc('hour', created_at) as hour from word where starts_with(tag, '#')
)
select hour - to_hours(cast(back as int)) as window_start, tag, count(*) as cnt from slot group by 1, 2""")
def windowed_hashtags(spark, folder):
    from murmuration.functions.text import hashtags

    tags = inputs.messages(spark, folder).select("created_at", F.explode(hashtags(F.col("text"))).alias("tag"))
    counts = w.windowed_counts(tags, "created_at", "tag", "6 hours", "1 hour")
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tag", "cnt")


@query("stream_windowed_counts", f"with {COUNTS} select window_start, event_type, cnt from counted")
def stream_windowed_counts(spark, folder):
    """The same sliding counts from a stream of event files, state kept until the watermark passes."""
    source, sink, checkpoint = (new_folder(spark, name) for name in ("events", "counts", "stream"))
    inputs.events(spark, folder).select("ts", "event_type").write.parquet(source)
    rows = spark.readStream.schema("ts timestamp, event_type string").parquet(source)
    counts = w.windowed_counts(rows, "ts", "event_type", "6 hours", "1 hour", delay="1 hour")

    def keep(batch, batch_id):
        write_period(batch, sink, batch_id)

    _finish(counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    updates = read_table(spark, sink)
    last = updates.groupBy("window_start", "event_type").agg(F.max_by("cnt", "period").alias("cnt"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "cnt")


def _topk_sql(sizes: dict[int, int]) -> str:
    """Top ten of windows of several lengths (seconds: hours), hourly."""
    return "\nunion all".join(f"""
select * from (
  select {seconds} as size, window_start, user_id, cnt,
         row_number() over (partition by window_start order by cnt desc, user_id) as rank, count(*) over (partition by window_start) as n_keys
  from (select hour - to_hours(cast(back as int)) as window_start, user_id, count(*) as cnt
        from (select user_id, unnest(range(0, {hours})) as back, date_trunc('hour', ts) as hour from events) group by 1, 2)
) where rank <= 10""" for seconds, hours in sizes.items())


@query("stream_topk", _topk_sql({21_600: 6, 3_600: 1}))
def stream_topk(spark, folder):
    """Most active users of every six hours and of every hour, from a stream in whose later files everything comes late."""
    source, tables, checkpoint = (new_folder(spark, name) for name in ("events", "topk", "stream"))
    rows = inputs.events(spark, folder).select("ts", "user_id", F.pmod("event_id", F.lit(3)).alias("part"))
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema("ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(source)
    top = w.TopKeys(spark, tables, "user_id", [21_600, 3_600], 3_600)
    _finish(top.start(arriving, "ts", checkpoint, delay="60 days"))
    return top.read().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("sink_upsert", f"""
with numbered as (
  select user_id, event_id, event_type, cast(floor(date_diff('second', timestamp '2024-01-01', ts) / {10 * DAY}) + 1 as int) as period from events
),
last as (select user_id, max(event_id) as event_id from numbered group by user_id)
select n.user_id as user_id, n.event_id as event_id, n.event_type as event_type, n.period as period
from numbered n join last l on l.event_id = n.event_id and l.user_id = n.user_id""")
def sink_upsert(spark, folder):
    """Every user's last event, replaced by key period by period; the second period is delivered twice."""
    rows = inputs.events(spark, folder).withColumn("period", w.period_number(F.col("ts"), 10 * DAY, ORIGIN))
    rows = durable(rows.groupBy("user_id", "period").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type")))
    table = KeyedTable(spark, new_folder(spark, "users"), ["user_id"], 16)
    periods = rows.agg(F.max("period")).first()[0] or 0
    for period in [*range(1, periods + 1), 2]:
        table.upsert(rows.where(F.col("period") == period).select("user_id", "event_id", "event_type", "period"), period)
    return table.read(schema="user_id long, event_id long, event_type string, period int")


@query("tumbling_periods", f"""
select cast(floor(date_diff('second', timestamp '2024-01-01', ts) / {DAY}) + 1 as int) as period, count(*) as n_events,
       min(event_id) as first_event, count(distinct user_id) as n_users from events group by 1""")
def tumbling_periods(spark, folder):
    rows = inputs.events(spark, folder).withColumn("period", w.period_number(F.col("ts"), DAY, ORIGIN))
    return rows.groupBy("period").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"),
                                      F.countDistinct("user_id").alias("n_users"))


PERIOD_DAYS = 10
SETTINGS = p.Settings(k=3, prune_every=2, topics=False)


def _period_sql(ts: str, before: int = 0) -> str:
    return f"cast(floor(date_diff('second', timestamp '2024-01-01', {ts}) / {PERIOD_DAYS * DAY}) + {1 - before} as int)"


def _period_tables_sql(periods: int, before: int = 0) -> str:
    """Tables of periods of ten days, ``before`` of which come before the first; the second is a pruning period.

    Of period i: g the graph, c the k-core's edges, l its components, s those that are large enough.
    """
    parts = [f"""with recursive {inputs.scoped_mentions_sql(inputs.DAY)},
link as (
  select m.src as src, m.dst as dst, m.message_id as attr, {_period_sql("e.ts", before)} as period
  from mention m join events e on cast(e.event_id as varchar) = m.message_id
  where m.src <> m.dst
),
g0 as (select src, dst, attr from link where false)"""]
    for i in range(1, periods + 1):
        pruned = i % SETTINGS.prune_every == 0
        merged = f"m{i}" if pruned else f"g{i}"
        parts.append(f"""
{merged} as materialized (
  select src, dst, attr from g{i - 1} union all select src, dst, attr from link where period = {i}
)""")
        if pruned:
            parts.append(kcore_sql(f"g{i}", merged, SETTINGS.prune_k, 10))
        parts.append(kcore_sql(f"c{i}", f"g{i}", SETTINGS.k, 16))
        parts.append(components_sql(f"l{i}", f"c{i}"))
        parts.append(f"""
s{i} as (select component as com_id, count(*) as nbv from l{i} group by component having count(*) >= {SETTINGS.min_size})""")
    return ",".join(parts)


def _periods_sql(periods: int = 3) -> str:
    selects = [f"""
select {i} as period, s.nbv as nbv, s.com_id as com_id, e.src as src, e.dst as dst, e.attr as attr
from c{i} e join l{i} l on l.id = e.src join s{i} s on s.com_id = l.component""" for i in range(1, periods + 1)]
    return _period_tables_sql(periods) + "\nunion all".join(selects)


def _run_pipeline(spark, folder, settings, before=0):
    """Messages land period by period; each run of the stream takes what is new and ends.

    The messages of the first ``before`` periods are stored ones, from which the corpus is built before the first.
    """
    tables = p.PeriodTables(spark, new_folder(spark, "state"))
    source, checkpoint = new_folder(spark, "messages"), new_folder(spark, "stream")
    rows = inputs.scoped_messages(spark, folder, inputs.DAY)
    rows = durable(rows.withColumn("period", w.period_number(F.col("created_at"), PERIOD_DAYS * DAY, ORIGIN)))
    periods = rows.agg(F.max("period")).first()[0] or 0
    if before:
        p.bootstrap(tables, rows.where(F.col("period") <= before).drop("period"), settings)
    for period in range(before + 1, periods + 1):
        rows.where(F.col("period") == period).drop("period").write.mode("append").parquet(source)
        _finish(p.start_pipeline(m.stream_messages(spark, source), tables, checkpoint, settings))
    return tables


@query("community_periods", _periods_sql())
def community_periods(spark, folder):
    tables = _run_pipeline(spark, folder, SETTINGS)
    return tables.edges().select("period", "nbv", "com_id", "src", "dst", "attr")


@query("community_numbers", _period_tables_sql(3) + "\nunion all".join(f"""
select {i} as period, com_id, row_number() over (order by com_id) - 1 as sg, 0 as n_cosines from s{i}""" for i in (1, 2, 3)))
def community_numbers(spark, folder):
    """The table of scores of a pipeline without topics: every kept community of a period with its number."""
    tables = _run_pipeline(spark, folder, SETTINGS)
    return tables.scores().select("period", "com_id", "sg", F.size("cosines").alias("n_cosines"))


def _corpus_sql(periods: int = 2) -> str:
    words = [f"""
select 0 as period, unnest({topic_words_sql(clean_sql("text"))}) as term from msg where {_period_sql("created_at", 1)} = 0"""]
    words += [f"""
select {i} as period, unnest({topic_words_sql(punctuation_sql("m.text"))}) as term
from c{i} e join l{i} l on l.id = e.src join s{i} s on s.com_id = l.component join msg m on cast(m.message_id as varchar) = e.attr
where {_period_sql("m.created_at", 1)} = {i}""" for i in range(1, periods + 1)]
    return _period_tables_sql(periods, 1) + f""",
word as ({" union all ".join(words)}),
counted as (select period, term, count(*) as n from word group by period, term)
select cast(p.period as int) as period, c.term as term, cast(sum(c.n) as bigint) as cnt
from (select unnest(range(0, {periods + 1})) as period) p join counted c on c.period <= p.period group by p.period, c.term"""


@query("corpus_periods", _corpus_sql())
def corpus_periods(spark, folder):
    """The vocabulary after every period: a corpus of ten days of stored messages, and what two periods add to it."""
    tables = _run_pipeline(spark, folder, p.Settings(k=3, prune_every=2, fit=False), before=1)
    terms = tables.terms()
    last = terms.agg(F.max("period")).first()[0] or 0
    return (terms.select(F.explode(F.sequence("period", F.lit(last))).alias("period"), "term", "cnt")
            .groupBy("period", "term").agg(F.sum("cnt").alias("cnt")))


N_PERIOD_TOPICS = 5


@query("period_topics", _period_tables_sql(3) + "\nunion all".join(f"""
select {i} as period, com_id, cast({N_PERIOD_TOPICS} as bigint) as n_topics, true as ranked, true as falling, true as scored from s{i}""" for i in (1, 2, 3)))
def period_topics(spark, folder):
    """The pipeline with topics: every community's topics of a period, ranked by their scores.

    What an optimiser finds is not the same everywhere, so the rows say what must hold: every topic once, in ranks without
    gaps, scores that fall and lie in 0 to 1, and words.
    """
    from murmuration.sources.export import ranked_topics

    tables = _run_pipeline(spark, folder, p.Settings(k=3, prune_every=2, n_topics=N_PERIOD_TOPICS, iterations=10))
    ranked = ranked_topics(tables.scores(), tables.topics())
    before = F.lag("cosine").over(Window.partitionBy("period", "com_id").orderBy("rank"))
    rows = ranked.withColumn("falls", F.coalesce(F.col("cosine") <= before, F.lit(True)))
    scored = F.col("cosine").between(0, 1 + 1e-9) & (F.length("words") > 0)
    return rows.groupBy("period", "com_id").agg(
        F.countDistinct("n_topic").alias("n_topics"), (F.max("rank") == F.count("*")).alias("ranked"),
        F.min("falls").alias("falling"), F.min(scored).alias("scored"))


@query("flagship", f"""
with recursive {inputs.scoped_mentions_sql(inputs.HOUR)},
link as (select src, dst, message_id as attr from mention where src <> dst),{kcore_sql("core", "link", 2)},{components_sql("comp", "core")},
edges as (select component as com_id, count(*) as n_edges from core join comp on comp.id = core.src group by component)
select c.component as com_id, count(*) as nbv, max(e.n_edges) as n_edges
from comp c join edges e on e.com_id = c.component group by c.component""")
def flagship(spark, folder):
    """All messages to communities of users within an hour: one row per community of the 2-core."""
    messages = inputs.scoped_messages(spark, folder, inputs.HOUR)
    found = c.communities(g.mention_graph(durable(g.mention_rows(messages))), 2)
    edges = found.edges.groupBy("com_id").agg(F.count("*").alias("n_edges"))
    return found.sizes.join(edges, "com_id").select("com_id", "nbv", "n_edges")
