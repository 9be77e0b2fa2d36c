"""Messages and graphs derived from the given tables, as DataFrames and as the same text in SQL.

A message is an event: it is written by the event's user and mentions the user of the next event. There are about ten
events per document, so document n is the rest of message 10 n; the other messages are short. Next events and documents
are found by equi-joins, not by a window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators.graph import PropertyGraph, endpoints, mention_rows
from murmuration.session import durable

# A vertex of the event graphs is a user within a stretch of time, one of the part graph a part within a ship year.
HOUR, DAY = 3_600, 86_400
ORIGIN_SECONDS = 1_704_067_200  # 2024-01-01
STRETCHES = 100_000  # places for the number of the stretch in a vertex id
YEARS = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _next_users(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("nxt"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder)
    documents = table(spark, folder, "documents").select((F.col("doc_id") * 10).alias("event_id"), "text", "lang")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_name", "c_nationkey", F.floor("c_acctbal").alias("followers"))
    # The texts come last, so that they are shuffled once.
    joined = (rows.join(_next_users(rows), "event_id", "left").join(customers, "user_id", "left")
              .join(documents, "event_id", "left"))
    signup = F.col("event_type") == "signup"
    text = F.concat(
        F.lit("hi @member"), F.coalesce("nxt", "user_id").cast("string"),
        F.lit(" #"), "event_type", F.lit(" http://t.example/"), F.col("event_id").cast("string"), F.lit(" :) "),
        F.when(signup, F.concat(F.lit("@member"), F.col("user_id").cast("string"), F.lit(" "))).otherwise(""),
        F.coalesce("text", F.lit("")))
    user = F.struct(
        F.col("user_id").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("member"), F.col("user_id").cast("string")).alias("screen_name"),
        F.coalesce("lang", F.when(signup, F.lit("en-GB")).otherwise(F.lit("en"))).alias("lang"),
        F.col("followers").alias("followers_count"), F.col("c_nationkey").cast("long").alias("friends_count"),
        F.col("event_id").alias("statuses_count"))
    geo = F.when(F.col("event_type") == "view",
                 F.struct(F.col("value").alias("lon"), (-F.col("value")).alias("lat")))
    return joined.select(F.col("event_id").alias("message_id"), F.col("ts").alias("created_at"),
                         F.floor("value").alias("retweet_count"), text.alias("text"), user.alias("user"),
                         geo.alias("geo"))


MESSAGES_SQL = """
msg as (
  select e.event_id as message_id, e.ts as created_at, cast(floor(e.value) as bigint) as retweet_count,
         concat('hi @member', cast(coalesce(n.user_id, e.user_id) as varchar), ' #', e.event_type,
                ' http://t.example/', cast(e.event_id as varchar), ' :) ',
                case when e.event_type = 'signup' then concat('@member', cast(e.user_id as varchar), ' ') else '' end,
                coalesce(d.text, '')) as text,
         e.user_id as user_id, c.c_name as user_name, concat('member', cast(e.user_id as varchar)) as screen_name,
         coalesce(d.lang, case when e.event_type = 'signup' then 'en-GB' else 'en' end) as lang,
         cast(floor(c.c_acctbal) as bigint) as followers, cast(c.c_nationkey as bigint) as friends,
         e.event_id as statuses,
         case when e.event_type = 'view' then e.value end as lon,
         case when e.event_type = 'view' then -e.value end as lat
  from events e
  left join events n on n.event_id = e.event_id + 1
  left join documents d on d.doc_id * 10 = e.event_id
  left join customer c on c.c_custkey = e.user_id
)"""


def stretch(ts: str, seconds: int) -> Column:
    return F.floor((F.unix_timestamp(ts) - ORIGIN_SECONDS) / seconds).cast("long")


def stretch_sql(ts: str, seconds: int) -> str:
    return f"cast(floor((epoch({ts}) - {ORIGIN_SECONDS}) / {seconds}) as bigint)"


def flow_edges(spark: SparkSession, folder: str, seconds: int = HOUR, step: int = 1) -> DataFrame:
    """One directed edge per event, from its user to the user of the ``step``-th next event, both within its stretch of time."""
    rows = events(spark, folder)
    after = rows.select((F.col("event_id") - step).alias("event_id"), F.col("user_id").alias("nxt"))
    when = stretch("ts", seconds)
    return (rows.join(after, "event_id").where("nxt <> user_id")
            .select((F.col("user_id") * STRETCHES + when).alias("src"), (F.col("nxt") * STRETCHES + when).alias("dst"),
                    F.col("event_id").cast("string").alias("attr")))


def flow_sql(name: str, seconds: int = HOUR, step: int = 1) -> str:
    when = stretch_sql("e.ts", seconds)
    return f"""
{name} as materialized (
  select e.user_id * {STRETCHES} + {when} as src, n.user_id * {STRETCHES} + {when} as dst,
         cast(e.event_id as varchar) as attr
  from events e join events n on n.event_id = e.event_id + {step} where e.user_id <> n.user_id
)"""


def part_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line as ``order, year, id``: the vertex of its part in the year it is shipped."""
    year = F.year("l_shipdate").cast("long")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order"), year.alias("year"), (F.col("l_partkey") * YEARS + year).alias("id"))


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of an order shipped in one year, each linked to the lowest of them: as many edges as lines, not as pairs."""
    lines = part_lines(spark, folder)
    lowest = durable(lines.groupBy("order", "year").agg(F.min("id").alias("dst")))
    return (lines.join(lowest, ["order", "year"]).where("id <> dst")
            .select(F.col("id").alias("src"), "dst", F.col("order").cast("string").alias("attr")))


def part_sql(name: str) -> str:
    return f"""
{name}_lines as (
  select l_orderkey, year(l_shipdate) as y, l_partkey * {YEARS} + year(l_shipdate) as id from lineitem
),
{name}_lowest as (select l_orderkey, y, min(id) as dst from {name}_lines group by l_orderkey, y),
{name} as materialized (
  select l.id as src, m.dst as dst, cast(l.l_orderkey as varchar) as attr
  from {name}_lines l join {name}_lowest m on l.l_orderkey = m.l_orderkey and l.y = m.y where l.id <> m.dst
)"""


def graph_of(edges: DataFrame) -> PropertyGraph:
    """Graph of edges whose vertices are named by their ids."""
    edges = durable(edges)
    ids = endpoints(edges).distinct()
    return PropertyGraph(durable(ids.withColumn("name", F.col("id").cast("string"))), edges)


def flow_graph(spark: SparkSession, folder: str, seconds: int = HOUR, step: int = 1) -> PropertyGraph:
    return graph_of(flow_edges(spark, folder, seconds, step))


def part_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The part graph, its vertices named by their parts."""
    graph = graph_of(part_edges(spark, folder))
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    named = (graph.vertices.select("id", F.floor(F.col("id") / YEARS).cast("long").alias("part"))
             .join(names, "part", "left").select("id", "name"))
    return PropertyGraph(durable(named), graph.edges)


def scoped_messages(spark: SparkSession, folder: str, seconds: int) -> DataFrame:
    """``messages`` in which a screen name stands for a user within the message's stretch of time."""
    when = stretch("created_at", seconds).cast("string")
    return (messages(spark, folder)
            .withColumn("text", F.regexp_replace("text", F.lit(r"@member(\d+)"), F.concat(F.lit("@member$1t"), when)))
            .withColumn("user", F.col("user").withField("screen_name", F.concat("user.screen_name", F.lit("t"), when))))


def message_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return mention_rows(messages(spark, folder))


def ids_sql(names: str) -> str:
    """CTEs that end in ``ids(name, id)``: MurmurHash64A of the names selected by ``names``, in 128-bit arithmetic."""
    multiplier, modulus = "14313749767032793493::uhugeint", "18446744073709551616::uhugeint"

    def times(x: str) -> str:
        return f"(({x}) * {multiplier}) % {modulus}"

    return f"""
hash_names as (select distinct name, hex(name) as hx, length(hex(name)) // 2 as len from ({names}) where name is not null),
hash_steps(name, hx, len, i, h) as (
  select name, hx, len, 0, xor(2915580697::uhugeint, {times("len::uhugeint")}) from hash_names
  union all
  select name, hx, len, i + 1,
         {times("xor(h, case when len - i * 8 >= 8 then " + times("xor(k1, k1 >> 47::uhugeint)") + " else k end)")}
  from (select *, {times("k")} as k1 from (
    select *, list_reduce(list_transform(range(0, least(8, len - i * 8)),
        lambda j: ('0x' || substr(hx, 2 * cast(i * 8 + j as int) + 1, 2))::utinyint::uhugeint << (8 * j)::uhugeint),
        lambda a, b: a + b) as k
    from hash_steps where i * 8 < len) a) b
),
hash_mixed as (select name, {times("xor(h, h >> 47::uhugeint)")} as h from hash_steps where i * 8 >= len),
hash_done as (select name, xor(h, h >> 47::uhugeint) as h from hash_mixed),
ids as (
  select name, cast(case when h >= 9223372036854775808::uhugeint then {modulus} - h else h end as bigint) as id
  from hash_done
)"""


def _mentions_sql(messages_sql: str) -> str:
    return f"""{messages_sql},
found as (
  select message_id, user_id, screen_name, unnest(regexp_extract_all(text, '@(\\w{{3,}})', 1)) as dest_name from msg
),
{ids_sql("select screen_name as name from found union select dest_name from found")},
mention as (
  select cast(f.message_id as varchar) as message_id, cast(f.user_id as varchar) as sender_user_id,
         f.screen_name as sender_name, f.dest_name as dest_name, s.id as src, d.id as dst
  from found f join ids s on s.name = f.screen_name join ids d on d.name = f.dest_name
)"""


def scoped_mentions_sql(seconds: int) -> str:
    """``MENTIONS_SQL`` over ``scoped_messages``."""
    when = stretch_sql("created_at", seconds)
    return _mentions_sql(f"""{MESSAGES_SQL.replace("msg as (", "msg_base as (", 1)},
msg as (
  select * replace (concat(screen_name, 't', cast({when} as varchar)) as screen_name,
                    regexp_replace(text, '@member(\\d+)', concat('@member\\1t', cast({when} as varchar)), 'g') as text)
  from msg_base
)""")


MENTIONS_SQL = _mentions_sql(MESSAGES_SQL)
