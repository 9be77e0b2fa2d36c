"""The property graph: building, merging, degrees, labels, triplets, induced subgraphs and lookups.

Edges form a directed multigraph: parallel edges are kept and count in degrees. Joins against edges use the vertex id; a
vertex with very many edges is split by adaptive skew-join handling. That needs a shuffle on both sides, and an aggregate
on the join key has none of its own, so vertices that come from one are stored first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions.ids import name_id
from murmuration.functions.text import MENTION_PATTERN, all_mentions
from murmuration.session import durable

UNKNOWN_NAME = "user not found"
UNKNOWN_ID = "0"
UNKNOWN_MESSAGE = "Tweet not found"


@dataclass(frozen=True)
class PropertyGraph:
    """``vertices(id, name)`` and ``edges(src, dst, attr)``."""

    vertices: DataFrame
    edges: DataFrame


def endpoints(edges: DataFrame) -> DataFrame:
    """One row ``id`` per edge end, in a single pass over the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def one_name_per_id(names: DataFrame) -> DataFrame:
    """Stored vertices of ``id, name`` rows; repeated rows are hashed away before the names are compared."""
    return durable(names.select("id", "name").distinct().groupBy("id").agg(F.min("name").alias("name")))


def mention_rows(messages: DataFrame, pattern: str = MENTION_PATTERN) -> DataFrame:
    """One row per message and mention with the ids of sender and mentioned user."""
    mentions = messages.select(
        F.col("message_id").cast("string").alias("message_id"),
        F.col("user.id").cast("string").alias("sender_user_id"),
        F.col("user.screen_name").alias("sender_name"),
        F.explode(all_mentions(F.col("text"), pattern)).alias("dest_name"),
    )
    return mentions.withColumns({"src": name_id("sender_name"), "dst": name_id("dest_name")})


def mention_graph(mentions: DataFrame, keep_self: bool = False) -> PropertyGraph:
    """Graph of ``mention_rows``: an edge per mention of somebody else, a vertex per sender and mentioned user.

    A sender who only mentions themselves still becomes a vertex.
    """
    ends = mentions.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("sender_name").alias("name")),
        F.struct(F.col("dst").alias("id"), F.col("dest_name").alias("name")),
    )).alias("end")).select("end.*")
    return PropertyGraph(one_name_per_id(ends), mention_edges(mentions, keep_self))


def mention_edges(mentions: DataFrame, keep_self: bool = False) -> DataFrame:
    """One edge per mention, its attribute the message id; mentions of oneself are left out unless asked for."""
    links = mentions if keep_self else mentions.where("src <> dst")
    return links.select("src", "dst", F.col("message_id").alias("attr"))


def id_collisions(names: DataFrame) -> DataFrame:
    """Ids that stand for more than one name; input has columns ``id, name``."""
    return (names.groupBy("id").agg(F.min("name").alias("first_name"), F.max("name").alias("last_name"))
            .where("first_name <> last_name"))


def graph_from_tables(users: DataFrame, communications: DataFrame) -> PropertyGraph:
    """Vertices from the users table, edges from the communications table; other columns are never read."""
    return PropertyGraph(
        users.select(F.col("local_id").cast("long").alias("id"), F.col("screen_name").alias("name")),
        communications.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"),
                              F.col("message_id").cast("string").alias("attr")),
    )


def with_missing_vertices(graph: PropertyGraph, default_name: str | None = None) -> PropertyGraph:
    """Add a vertex with a default name for every edge end that has none."""
    known = graph.vertices.select("id", "name", F.lit(1).alias("known"))
    ends = endpoints(graph.edges).distinct().select("id", F.lit(None).cast("string").alias("name"),
                                                    F.lit(0).alias("known"))
    merged = known.unionByName(ends).groupBy("id").agg(F.max("name").alias("name"), F.max("known").alias("known"))
    name = F.when(F.col("known") == 1, F.col("name")).otherwise(F.lit(default_name).cast("string"))
    return PropertyGraph(durable(merged.select("id", name.alias("name"))), graph.edges)


def graph_union(first: PropertyGraph, second: PropertyGraph) -> PropertyGraph:
    """Bag union of the edges; vertices with one id become one."""
    return PropertyGraph(one_name_per_id(first.vertices.unionByName(second.vertices)),
                         first.edges.unionByName(second.edges))


def degrees(graph: PropertyGraph) -> DataFrame:
    """``id, name, in_degree, out_degree, degree``; vertices without edges get zeros."""
    ends = graph.edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("is_in")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("is_in")),
    )).alias("end")).select("end.*")
    counts = ends.groupBy("id").agg(F.sum("is_in").alias("in_degree"), F.count("*").alias("degree"))
    zero = F.lit(0).cast("long")
    return (graph.vertices.join(counts, "id", "left")
            .select("id", "name",
                    F.coalesce("in_degree", zero).alias("in_degree"),
                    F.coalesce(F.col("degree") - F.col("in_degree"), zero).alias("out_degree"),
                    F.coalesce("degree", zero).alias("degree")))


def degree_distribution(graph: PropertyGraph) -> DataFrame:
    """How many vertices have each degree; vertices without edges are not counted."""
    return (endpoints(graph.edges).groupBy("id").agg(F.count("*").alias("degree"))
            .groupBy("degree").agg(F.count("*").alias("n_vertices")))


def degree_sample(graph: PropertyGraph, n: int = 10) -> DataFrame:
    """The ``n`` lowest rows of the degree distribution."""
    return degree_distribution(graph).orderBy("degree").limit(n)


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """One row: vertices, edges, distinct senders and receivers."""
    edge_counts = graph.edges.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_senders"),
                                  F.countDistinct("dst").alias("n_receivers"))
    vertex_count = graph.vertices.agg(F.count("*").alias("n_vertices"))
    one = F.lit(1).alias("one")
    return vertex_count.select("*", one).join(edge_counts.select("*", one), "one").drop("one")


def label_vertices(vertices: DataFrame, result: DataFrame) -> DataFrame:
    """Names of the vertices of a per-vertex result."""
    return vertices.join(result, "id")


def triplets(graph: PropertyGraph) -> DataFrame:
    """Every edge with the names of both ends; an end that is no known vertex has a null name."""
    names = graph.vertices
    return (graph.edges
            .join(names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src", "left")
            .join(names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
            .select("src", "src_name", "dst", "dst_name", "attr"))


def induced_subgraph(graph: PropertyGraph, keep: DataFrame) -> PropertyGraph:
    """Named vertices whose id is in ``keep``, and the edges between them."""
    vertices = durable(graph.vertices.where("name is not null").join(keep.select("id"), "id", "left_semi"))
    return PropertyGraph(vertices, edges_between(graph.edges, vertices.select("id")))


def edges_between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return (edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
            .join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
            .select("src", "dst", "attr"))


def lookup_by_id(vertices: DataFrame, keys: DataFrame) -> DataFrame:
    """Name of each ``id`` in ``keys``, or a fixed text."""
    return (keys.select("id").join(vertices, "id", "left")
            .select("id", F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("name")))


def lookup_by_name(vertices: DataFrame, keys: DataFrame) -> DataFrame:
    """Id, as text, of each ``name`` in ``keys``, or ``"0"``; the lowest id if a name occurs twice."""
    ids = vertices.groupBy("name").agg(F.min("id").cast("string").alias("id"))
    return (keys.select("name").join(ids, "name", "left")
            .select("name", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id")))


def vertex_name(vertices: DataFrame, vertex_id: int | Column) -> DataFrame:
    """One row with the name of one vertex; the id is pushed into the scan."""
    found = vertices.where(F.col("id") == vertex_id).agg(F.min("name").alias("name"))
    return found.select(F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("name"))


def vertex_id(vertices: DataFrame, name: str) -> DataFrame:
    """One row with the id of one name; the name is pushed into the scan."""
    found = vertices.where(F.col("name") == F.lit(name)).agg(F.min("id").cast("string").alias("id"))
    return found.select(F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id"))


def message_lookup(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Text of each ``message_id`` in ``keys``, or a fixed text."""
    return (keys.select("message_id").join(messages.select("message_id", "text"), "message_id", "left")
            .select("message_id", F.coalesce("text", F.lit(UNKNOWN_MESSAGE)).alias("text")))


def user_messages(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """All message ids sent by each ``user_id`` in ``keys``."""
    return messages.select("user_id", "message_id").join(keys.select("user_id"), "user_id", "left_semi")


def edge_texts(edges: DataFrame, messages: DataFrame) -> DataFrame:
    """Stored text of every edge's message; one row per edge, edges without a stored message dropped."""
    texts = messages.select(F.col("message_id").cast("string").alias("attr"), "text")
    return edges.join(texts, "attr").select("src", "dst", "attr", "text")


def window_texts(edges: DataFrame, messages: DataFrame) -> DataFrame:
    """Text of every edge's message among the current messages, or an empty text; all columns of the edge are kept."""
    texts = messages.select(F.col("message_id").cast("string").alias("attr"), "text")
    return edges.join(texts, "attr", "left").withColumn("text", F.coalesce("text", F.lit("")))
