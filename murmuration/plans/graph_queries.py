"""Graph building, joins, lookups and graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.operators import community as c
from murmuration.operators import graph as g
from murmuration.operators.components import connected_components
from murmuration.operators.kcore import core_numbers, kcore, kcore_stats, prune
from murmuration.operators.labelprop import label_propagation
from murmuration.operators.pagerank import pagerank
from murmuration.operators.scc import strongly_connected_components
from murmuration.operators.triangles import triangle_count, triangle_total
from murmuration.plans import inputs
from murmuration.plans.registry import query
from murmuration.plans.sql import components_sql, ends_sql, kcore_sql, punctuation_sql, topic_words_sql
from murmuration.session import durable

MSG = f"with {inputs.MESSAGES_SQL}\n"
MENTIONS = f"with recursive {inputs.MENTIONS_SQL}"
LINKS = """link as (select src, dst, message_id as attr from mention where src <> dst)"""
VERTEX = """vertex as (
  select id, min(name) as name
  from (select src as id, sender_name as name from mention union all select dst, dest_name from mention) group by id
)"""
FLOW = "with recursive " + inputs.flow_sql("edge")
DAILY = "with recursive " + inputs.flow_sql("edge", inputs.DAY)
PART = "with recursive " + inputs.part_sql("edge")
DEGREE = """degree as (
  select id, sum(is_in) as in_degree, sum(1 - is_in) as out_degree, count(*) as degree
  from (select src as id, 0 as is_in from edge union all select dst, 1 from edge) group by id
)"""


def _mention_graph(spark, folder):
    return g.mention_graph(durable(inputs.message_mentions(spark, folder)))


@query("mention_edges", f"{MENTIONS}, {LINKS} select src, dst, attr from link")
def mention_edges(spark, folder):
    return g.mention_edges(inputs.message_mentions(spark, folder))


@query("mention_vertices", f"{MENTIONS}, {VERTEX} select id, name from vertex")
def mention_vertices(spark, folder):
    return g.mention_graph(inputs.message_mentions(spark, folder)).vertices


@query("id_collisions", f"""{MENTIONS}
select id, min(name) as first_name, max(name) as last_name from ids group by id having min(name) <> max(name)""")
def id_collisions(spark, folder):
    rows = inputs.message_mentions(spark, folder)
    return g.id_collisions(rows.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("sender_name").alias("name")),
        F.struct(F.col("dst").alias("id"), F.col("dest_name").alias("name")))).alias("e")).select("e.*"))


@query("graph_from_tables", """
select n.n_nationkey as id, n.n_name as name, count(s.s_suppkey) as n_edges
from nation n left join supplier s on s.s_nationkey = n.n_nationkey group by n.n_nationkey, n.n_name""")
def graph_from_tables(spark, folder):
    """Nations as users, each supplier a message sent by its nation: messages sent per user, none included."""
    users = inputs.table(spark, folder, "nation").select(F.col("n_nationkey").alias("local_id"),
                                                         F.col("n_name").alias("screen_name"))
    comms = inputs.table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"), F.col("s_suppkey").alias("message_id"))
    return g.degrees(g.graph_from_tables(users, comms)).select("id", "name", F.col("out_degree").alias("n_edges"))


@query("label_vertices", f"""{MENTIONS}, {LINKS}, {VERTEX},
sent as (select src as id, count(*) as n_sent from link group by src)
select v.id as id, v.name as name, s.n_sent as n_sent from vertex v join sent s on s.id = v.id""")
def label_vertices(spark, folder):
    graph = _mention_graph(spark, folder)
    sent = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_sent"))
    return g.label_vertices(graph.vertices, sent)


@query("triplets", f"""{MENTIONS}, {LINKS}, {VERTEX}
select l.src as src, s.name as src_name, l.dst as dst, d.name as dst_name, l.attr as attr
from link l left join vertex s on s.id = l.src left join vertex d on d.id = l.dst""")
def triplets(spark, folder):
    return g.triplets(_mention_graph(spark, folder))


@query("induced_subgraph", f"""{PART}, {DEGREE}
select e.src as src, e.dst as dst, e.attr as attr from edge e
where e.src in (select id from degree where degree >= 3) and e.dst in (select id from degree where degree >= 3)""")
def induced_subgraph(spark, folder):
    graph = inputs.part_graph(spark, folder)
    busy = g.degrees(graph).where("degree >= 3").select("id")
    return g.induced_subgraph(graph, busy).edges


@query("degrees", f"""{FLOW}, {DEGREE}
select id, cast(id as varchar) as name, cast(in_degree as bigint) as in_degree,
       cast(out_degree as bigint) as out_degree, degree from degree""")
def degrees(spark, folder):
    return g.degrees(inputs.flow_graph(spark, folder))


@query("degree_distribution", f"""{FLOW}, {DEGREE}
select degree, count(*) as n_vertices from degree group by degree""")
def degree_distribution(spark, folder):
    return g.degree_distribution(inputs.flow_graph(spark, folder))


@query("degree_sample", f"""{PART}, {DEGREE}
select degree, count(*) as n_vertices from degree group by degree order by degree limit 10""")
def degree_sample(spark, folder):
    return g.degree_sample(inputs.part_graph(spark, folder))


@query("graph_stats", f"""{PART},{ends_sql("vertex", "edge")}
select (select count(*) from vertex) as n_vertices, count(*) as n_edges, count(distinct src) as n_senders,
       count(distinct dst) as n_receivers from edge""")
def graph_stats(spark, folder):
    return g.graph_stats(inputs.part_graph(spark, folder))


@query("graph_union", f"""with {inputs.flow_sql("a")},
{inputs.flow_sql("b", step=2)},
edge as (select src, dst, attr from a union all select src, dst, attr from b), {DEGREE}
select id, cast(id as varchar) as name, cast(in_degree as bigint) as in_degree,
       cast(out_degree as bigint) as out_degree, degree from degree""")
def graph_union(spark, folder):
    """Degrees after merging two graphs: edges add up, vertices do not."""
    return g.degrees(g.graph_union(inputs.flow_graph(spark, folder), inputs.flow_graph(spark, folder, step=2)))


@query("kcore_2", f"{PART},{kcore_sql('core', 'edge', 2)} select src, dst, attr from core")
def kcore_2(spark, folder):
    return kcore(inputs.part_graph(spark, folder), 2).edges


@query("kcore_3", f"{DAILY},{kcore_sql('core', 'edge', 3)} select src, dst, attr from core")
def kcore_3(spark, folder):
    return kcore(inputs.flow_graph(spark, folder, inputs.DAY), 3).edges


@query("kcore_stats", f"""{DAILY},{kcore_sql('core', 'edge', 3)},
deg as (select id, count(*) as degree from (select src as id from core union all select dst from core) group by id)
select count(*) as n_vertices, (select count(*) from core) as n_edges, min(degree) as min_degree,
       max(degree) as max_degree, cast(sum(degree) as bigint) as sum_degree from deg""")
def kcore_stats_query(spark, folder):
    return kcore_stats(kcore(inputs.flow_graph(spark, folder, inputs.DAY), 3))


@query("core_numbers", f"""{DAILY}{"".join("," + kcore_sql(f"core{k}", "edge", k) for k in (1, 2, 3, 4))},
inside as ({" union all ".join(f"select {k} as k, src as id from core{k} union all select {k}, dst from core{k}" for k in (1, 2, 3, 4))})
select id, cast(max(k) as bigint) as core from inside group by id""")
def core_numbers_query(spark, folder):
    """Core number of every user within a day, up to 4."""
    numbers = core_numbers(inputs.flow_edges(spark, folder, inputs.DAY))
    return numbers.select("id", F.least("core", F.lit(4).cast("long")).alias("core"))


@query("connected_components", f"{PART},{components_sql('comp', 'edge')} select id, component from comp")
def components(spark, folder):
    graph = inputs.part_graph(spark, folder)
    return connected_components(graph.vertices, graph.edges)


COMMUNITIES = f"""{PART},{kcore_sql('core', 'edge', 2)},{components_sql('comp', 'core')},
size as (select component as com_id, count(*) as nbv from comp group by component)"""


@query("communities", f"""{COMMUNITIES}
select p.id as id, n.p_name as name, p.component as com_id, s.nbv as nbv
from comp p join size s on s.com_id = p.component left join part n on n.p_partkey = p.id // {inputs.YEARS}""")
def communities(spark, folder):
    found = c.communities(inputs.part_graph(spark, folder), 2)
    return found.members.join(found.sizes, "com_id").select("id", "name", "com_id", "nbv")


# In the 1-core every component of the graph is a community.
COMPONENTS = f"""{PART},{components_sql('comp', 'edge')},
size as (select component as com_id, count(*) as nbv from comp group by component)"""


@query("large_communities", f"""{COMPONENTS}
select s.nbv as nbv, s.com_id as com_id, e.src as src, e.dst as dst, e.attr as attr
from edge e join comp p on p.id = e.src join size s on s.com_id = p.component where s.nbv >= 6""")
def large_communities(spark, folder):
    return c.community_edges(c.communities(inputs.part_graph(spark, folder), 1, c.MIN_COMMUNITY_SIZE))


@query("prune_graph", f"{FLOW},{kcore_sql('core', 'edge', 2)} select src, dst, attr from core")
def prune_graph(spark, folder):
    """The flow graph as it is after a pruning period."""
    return prune(inputs.flow_graph(spark, folder), period=4).edges


@query("scc", f"""{FLOW},
pair as materialized (select distinct src, dst from edge),
reach(a, b) as (select src, dst from pair union select r.a, p.dst from reach r join pair p on p.src = r.b),
{ends_sql("vertex", "edge")}
select v.id as id, least(v.id, coalesce(min(r.b), v.id)) as component
from vertex v left join (
  select x.a, x.b from reach x join reach y on y.a = x.b and y.b = x.a
) r on r.a = v.id group by v.id""")
def scc(spark, folder):
    return strongly_connected_components(inputs.flow_graph(spark, folder))


TRIANGLES = """
pair as materialized (select distinct least(src, dst) as a, greatest(src, dst) as b from link where src <> dst),
tri as materialized (
  select x.a as a, x.b as b, y.b as c from pair x join pair y on y.a = x.b join pair z on z.a = x.a and z.b = y.b
)"""


@query("triangle_count", f"""{MENTIONS}, {LINKS}, {VERTEX}, {TRIANGLES},
corner as (select a as id from tri union all select b from tri union all select c from tri)
select v.id as id, count(k.id) as triangles from vertex v left join corner k on k.id = v.id group by v.id""")
def triangles(spark, folder):
    return triangle_count(_mention_graph(spark, folder))


@query("triangle_total", f"{MENTIONS}, {LINKS}, {TRIANGLES} select count(*) as n_triangles from tri")
def triangles_total(spark, folder):
    return triangle_total(triangle_count(_mention_graph(spark, folder)))


RANK_ROUNDS, CONVERGED_ROUNDS = 30, 150


def _pagerank_sql(graph: str, rounds: int) -> str:
    """Rounds of ranks over ``edge`` and ``vertex``, written out one after the other."""
    parts = [f"""{graph},
outdeg as materialized (select src as id, count(*) as d from edge group by src),
step as materialized (
  select e.src as src, e.dst as dst, count(*) / max(o.d) as share from edge e join outdeg o on o.id = e.src
  group by e.src, e.dst
),
rank_0 as (select id, 1.0::double as rank from vertex)"""]
    for i in range(rounds):
        parts.append(f"""
rank_{i + 1} as materialized (
  select v.id as id, 0.15 + 0.85 * coalesce(sum(r.rank * s.share), 0) as rank
  from vertex v left join step s on s.dst = v.id left join rank_{i} r on r.id = s.src group by v.id
)""")
    return ",".join(parts)


@query("pagerank", _pagerank_sql(f"{FLOW},{ends_sql('vertex', 'edge')}", RANK_ROUNDS) + f"""
select id, round(rank, 6) as rank from rank_{RANK_ROUNDS}""")
def pagerank_query(spark, folder):
    ranks = pagerank(inputs.flow_graph(spark, folder), rounds=RANK_ROUNDS)
    return ranks.select("id", F.round("rank", 6).alias("rank"))


@query("pagerank_converged", _pagerank_sql(f"{MENTIONS}, {LINKS}, edge as materialized (select src, dst from link), {VERTEX}", CONVERGED_ROUNDS) + f"""
select r.id as id, v.name as name, round(r.rank, 5) as rank from rank_{CONVERGED_ROUNDS} r join vertex v on v.id = r.id""")
def pagerank_converged(spark, folder):
    """Ranks of the whole mention graph until none moves any more, with names, highest first."""
    graph = _mention_graph(spark, folder)
    ranks = pagerank(graph, tolerance=1e-10)
    return g.label_vertices(graph.vertices, ranks).orderBy(F.desc("rank"), "id").withColumn("rank", F.round("rank", 5))


def _label_sql(rounds: int = 4) -> str:
    parts = [f"""{FLOW},{ends_sql("vertex", "edge")},
way as materialized (select src as id, dst as nbr from edge union all select dst, src from edge),
label_0 as (select id, id as label from vertex)"""]
    for i in range(rounds):
        parts.append(f"""
label_{i + 1} as materialized (
  select id, label from (
    select w.id as id, l.label as label,
           row_number() over (partition by w.id order by count(*) desc, l.label) as rn
    from way w join label_{i} l on l.id = w.nbr group by w.id, l.label
  ) t where rn = 1
)""")
    return ",".join(parts) + f"\nselect id, label from label_{rounds}"


@query("label_propagation", _label_sql())
def labels(spark, folder):
    return label_propagation(inputs.flow_graph(spark, folder))


@query("lookup_vertex", f"""
{PART},{ends_sql("vertex", "edge")},
named as (select v.id as id, p.p_name as name from vertex v left join part p on p.p_partkey = v.id // {inputs.YEARS})
select k.id as id, coalesce(n.name, 'user not found') as name
from (select distinct id from edge_lines) k left join named n on n.id = k.id""")
def lookup_vertex(spark, folder):
    """The vertex of every order line looked up in the graph; one without an edge is not in it."""
    keys = inputs.part_lines(spark, folder).select("id").distinct()
    return g.lookup_by_id(inputs.part_graph(spark, folder).vertices, keys)


@query("lookup_vertex_name", f"""{MENTIONS}, {VERTEX},
low as (select name, cast(min(id) as varchar) as id from vertex group by name)
select k.name as name, coalesce(l.id, '0') as id
from (select concat('member', cast(c_custkey as varchar)) as name from customer) k left join low l on l.name = k.name""")
def lookup_vertex_name(spark, folder):
    keys = inputs.table(spark, folder, "customer").select(
        F.concat(F.lit("member"), F.col("c_custkey").cast("string")).alias("name"))
    return g.lookup_by_name(g.mention_graph(inputs.message_mentions(spark, folder)).vertices, keys)


@query("message_lookup", """
select cast(o.o_orderkey as varchar) as message_id, coalesce(d.text, 'Tweet not found') as text
from orders o left join documents d on d.doc_id = o.o_orderkey""")
def message_lookup(spark, folder):
    """Every order number looked up as a message id; most are not stored."""
    keys = inputs.table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("message_id"))
    stored = inputs.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("message_id"), "text")
    return g.message_lookup(stored, keys)


@query("user_messages", """
select user_id, event_id as message_id from events
where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def user_messages(spark, folder):
    """Messages of every user in one market segment."""
    keys = (inputs.table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
            .select(F.col("c_custkey").alias("user_id")))
    sent = inputs.events(spark, folder).select("user_id", F.col("event_id").alias("message_id"))
    return g.user_messages(sent, keys)


@query("edge_texts", f"""with {inputs.flow_sql("edge")}
select e.src as src, e.dst as dst, e.attr as attr, d.text as text
from edge e join documents d on cast(d.doc_id as varchar) = e.attr""")
def edge_texts(spark, folder):
    """Stored documents of the flow edges' messages; most messages have none and drop out."""
    stored = inputs.table(spark, folder, "documents").select(F.col("doc_id").alias("message_id"), "text")
    return g.edge_texts(inputs.flow_edges(spark, folder), stored)


CURRENT_FROM = "2024-01-16"
FLOW_CORE = f"""{FLOW},{kcore_sql('core', 'edge', 2)},{components_sql('comp', 'core')},
{inputs.MESSAGES_SQL},
com_text as (
  select p.component as com_id, e.attr as attr, coalesce(m.text, '') as text
  from core e join comp p on p.id = e.src
  left join msg m on cast(m.message_id as varchar) = e.attr and m.created_at >= timestamp '{CURRENT_FROM}'
)"""


def _flow_texts(spark, folder):
    found = c.communities(inputs.flow_graph(spark, folder), 2)
    current = inputs.messages(spark, folder).where(F.col("created_at") >= F.lit(CURRENT_FROM).cast("timestamp"))
    return c.community_texts(found, current)


@query("community_text", f"{FLOW_CORE} select com_id, attr, text from com_text")
def community_text(spark, folder):
    """Texts behind the communities' edges; only the later half of the period counts as current."""
    return _flow_texts(spark, folder)


@query("community_tokens", f"""{FLOW_CORE},
words as (select com_id, attr, unnest({topic_words_sql(punctuation_sql('text'))}) as term from com_text)
select com_id, attr, term, count(*) as cnt from words group by com_id, attr, term""")
def community_tokens(spark, folder):
    words = c.community_words(_flow_texts(spark, folder))
    return words.groupBy("com_id", "attr", "term").agg(F.count("*").alias("cnt"))
