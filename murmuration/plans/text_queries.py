"""Sources, projections and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.functions import text as t
from murmuration.functions.ids import name_id
from murmuration.operators.topics import document_words
from murmuration.plans import inputs
from murmuration.plans.registry import query
from murmuration.plans.sql import clean_sql, topic_words_sql
from murmuration.session import new_folder
from murmuration.sources import messages as m
from murmuration.sources.tables import read_table, scan, write_period, write_periods

MSG = f"with {inputs.MESSAGES_SQL}\n"
MENTIONS = f"with recursive {inputs.MENTIONS_SQL}\n"


@query("track_filter", MSG + "select message_id, screen_name, text from msg where contains(text, ' @')")
def track_filter(spark, folder):
    return m.track(inputs.messages(spark, folder)).select("message_id", "user.screen_name", "text")


@query("table_scan", "select * from orders")
def table_scan(spark, folder):
    return inputs.table(spark, folder, "orders")


@query("projected_scan", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def projected_scan(spark, folder):
    return scan(inputs.table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"], o_orderstatus="F")


@query("sink_roundtrip", """
select user_id, count(*) as n_events, max(event_id) as last_event, cast(date_trunc('month', ts) as date) as month,
       cast(day(ts) as int) as period
from events group by user_id, date_trunc('month', ts), day(ts)""")
def sink_roundtrip(spark, folder):
    """Written by period with other rows first, then replaced: by all rows, and twice by fewer and by none on the way."""
    rows = (inputs.events(spark, folder)
            .groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month"), F.dayofmonth("ts").alias("period"))
            .agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event")))
    path = new_folder(spark, "roundtrip")
    for period in (1, 40):
        write_period(rows.unionByName(rows), path, period)
        write_period(rows.where("false"), path, period)
    write_periods(rows, path)
    return read_table(spark, path)


@query("project_users", f"""
with recursive {inputs.MESSAGES_SQL},
{inputs.ids_sql("select screen_name as name from msg")},
numbered as (
  select m.*, row_number() over (partition by user_id order by created_at desc, message_id desc) as rn from msg m
)
select cast(n.user_id as varchar) as user_id, i.id as local_id, n.user_name as name, n.lang as lang,
       n.followers as followers, n.friends as friends, n.screen_name as screen_name, n.statuses as statuses
from numbered n join ids i on i.name = n.screen_name where n.rn = 1""")
def project_users(spark, folder):
    return m.latest_users(inputs.messages(spark, folder))


@query("project_messages", f"""
with recursive {inputs.MESSAGES_SQL},
{inputs.ids_sql("select screen_name as name from msg")}
select cast(message_id as varchar) as message_id, cast(user_id as varchar) as user_id, i.id as local_id,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, retweet_count as retweets,
       {clean_sql("text")} as text
from msg join ids i on i.name = msg.screen_name""")
def project_messages(spark, folder):
    return m.export_messages(inputs.messages(spark, folder))


@query("project_comms", MSG + """
select cast(message_id as varchar) as message_id, cast(user_id as varchar) as sender_user_id,
       screen_name as sender_name, regexp_extract(text, '@(\\w{3,})', 1) as dest_name, text from msg""")
def project_comms(spark, folder):
    return m.project_communications(inputs.messages(spark, folder))


@query("project_geo", MSG + """
select message_id, coalesce(cast(lon as varchar), '') as lon, coalesce(cast(lat as varchar), '') as lat from msg""")
def project_geo(spark, folder):
    return m.project_geo(inputs.messages(spark, folder))


@query("language_filter", MSG + "select message_id, lang from msg where lower(lang) in ('en', 'en-gb')")
def language_filter(spark, folder):
    return m.filter_language(inputs.messages(spark, folder)).select("message_id", "user.lang")


@query("format_created", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as created from events")
def format_created(spark, folder):
    return inputs.events(spark, folder).select("event_id", t.format_timestamp(F.col("ts")).alias("created"))


@query("first_mention", "select doc_id, regexp_extract(text, '@(\\w{3,})', 1) as mention from documents")
def first_mention(spark, folder):
    return inputs.table(spark, folder, "documents").select("doc_id", t.first_mention(F.col("text")).alias("mention"))


@query("mentions", MSG + "select message_id, unnest(regexp_extract_all(text, '@(\\w{3,})', 1)) as mention from msg")
def mentions(spark, folder):
    return inputs.messages(spark, folder).select("message_id", F.explode(t.all_mentions(F.col("text"))).alias("mention"))


@query("clean_text", MSG + f"select message_id, {clean_sql('text')} as text from msg")
def clean_text(spark, folder):
    return inputs.messages(spark, folder).select("message_id", t.clean_text(F.col("text")).alias("text"))


@query("tokenize", f"""
with words as (select doc_id, unnest({topic_words_sql('text')}) as term from documents)
select doc_id, term, count(*) as cnt from words group by doc_id, term""")
def tokenize(spark, folder):
    words = document_words(inputs.table(spark, folder, "documents"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"))


@query("murmur_id", f"""
with recursive names as (
  select c_name as name from customer union all select p_name from part union all select p_brand from part
  union all select concat('member', cast(user_id as varchar)) from events),
{inputs.ids_sql("select name from names")}
select name, id from ids""")
def murmur_id(spark, folder):
    customers = inputs.table(spark, folder, "customer").select(F.col("c_name").alias("name"))
    parts = inputs.table(spark, folder, "part").select(F.explode(F.array("p_name", "p_brand")).alias("name"))
    users = (inputs.table(spark, folder, "events")
             .select(F.concat(F.lit("member"), F.col("user_id").cast("string")).alias("name")))
    names = customers.union(parts).union(users).distinct()
    return names.select("name", name_id("name").alias("id"))


@query("hashtags", MSG + """,
words as (select message_id, unnest(string_split(text, ' ')) as tag from msg)
select message_id, tag from words where starts_with(tag, '#')""")
def hashtags(spark, folder):
    return inputs.messages(spark, folder).select("message_id", F.explode(t.hashtags(F.col("text"))).alias("tag"))


@query("mention_enrich", MSG + """,
named as (select message_id, regexp_extract(text, '@(\\w+)', 1) as dest_name from msg),
users as (
  select screen_name, arg_max(user_name, user_id) as user_name, max(user_id) as user_id from (
    select screen_name, user_name, user_id from msg
    union all select concat('member', cast(c_custkey as varchar)), 'renamed', 0 from customer
  ) group by screen_name
)
select n.message_id as message_id, n.dest_name as dest_name, coalesce(u.user_name, '') as mentioned_name,
       coalesce(cast(u.user_id as varchar), '') as mentioned_id
from named n left join users u on u.screen_name = n.dest_name""")
def mention_enrich(spark, folder):
    """Every screen name belongs to a second, renamed account too; no message is told twice."""
    messages = inputs.messages(spark, folder)
    users = (messages.select(F.col("user.id").cast("string").alias("user_id"), "user.name", "user.screen_name")
             .distinct())
    renamed = inputs.table(spark, folder, "customer").select(
        F.lit("0").alias("user_id"), F.lit("renamed").alias("name"),
        F.concat(F.lit("member"), F.col("c_custkey").cast("string")).alias("screen_name"))
    return m.enrich_mentions(messages, users.unionByName(renamed))


@query("line_counts", """
with lines as (select unnest(string_split(text, chr(10))) as value from documents)
select count(*) filter (where contains(value, 'a')) as lines_with_a,
       count(*) filter (where contains(value, 'b')) as lines_with_b from lines""")
def line_counts(spark, folder):
    path = new_folder(spark, "lines")
    inputs.table(spark, folder, "documents").select("text").write.text(path)
    return m.line_counts(m.read_lines(spark, path))
