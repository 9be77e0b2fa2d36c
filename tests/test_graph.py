import random
from collections import Counter

import pytest
from golden import CORES, EDGES, EXPECTED, IDS, LABELS, VERTICES

from pyspark.sql import functions as F

from murmuration.operators import community
from murmuration.operators import graph as g
from murmuration.operators.components import connected_components
from murmuration.operators.kcore import core_numbers, kcore, kcore_stats, prune
from murmuration.operators.labelprop import label_propagation
from murmuration.operators.pagerank import pagerank
from murmuration.operators import scc
from murmuration.operators.scc import strongly_connected_components
from murmuration.operators.triangles import triangle_count, triangle_total

SALTED = 2  # so few rows per neighbour that almost every vertex of the golden graph is treated as hot


def as_dict(df):
    return {row[0]: row[1] for row in df.collect()}


def test_degrees(golden):
    rows = {r["name"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in g.degrees(golden).collect()}
    assert rows == {name: (e[0], e[1], e[0] + e[1]) for name, e in EXPECTED.items()}


def test_degree_distribution(golden):
    expected = Counter(e[0] + e[1] for e in EXPECTED.values())
    assert as_dict(g.degree_distribution(golden)) == expected
    assert [r["degree"] for r in g.degree_sample(golden, 3).collect()] == sorted(expected)[:3]


@pytest.mark.parametrize("k, max_rows", [(1, 1_000_000), (2, SALTED), (3, 1_000_000), (6, SALTED), (7, 1_000_000)])
def test_kcore(golden, k, max_rows):
    n_vertices, n_edges, communities = CORES[k]
    core = kcore(golden, k, max_rows)
    assert core.vertices.count() == n_vertices
    assert core.edges.count() == n_edges
    labels = connected_components(core.vertices, core.edges)
    assert Counter(r["component"] for r in labels.collect()) == communities
    stats = kcore_stats(core).first()
    assert (stats["n_vertices"], stats["n_edges"]) == (n_vertices, n_edges)
    assert n_vertices == 0 or stats["min_degree"] >= k


def test_kcore_of_a_path_is_empty_and_a_cycle_is_kept(spark):
    path = [(i, i + 1, "m") for i in range(40)]
    ring = [(100 + i, 100 + (i + 1) % 7, "m") for i in range(7)]
    edges = spark.createDataFrame(path + ring, "src long, dst long, attr string")
    vertices = g.endpoints(edges).distinct().selectExpr("id", "string(id) as name")
    kept = kcore(g.PropertyGraph(vertices, edges), 2).vertices
    assert {r["id"] for r in kept.collect()} == set(range(100, 107))


@pytest.mark.parametrize("seed", [0, 5])
def test_components(golden, spark, seed):
    labels = as_dict(connected_components(golden.vertices, golden.edges, seed))
    small = {IDS["Fabien"], IDS["Nicolas"]}
    assert labels == {i: min(small) if i in small else 132988448 for i, _ in VERTICES}
    path = spark.createDataFrame([(i, i + 1, "m") for i in range(300)], "src long, dst long, attr string")
    lonely = spark.createDataFrame([(999, "x")], "id long, name string")
    labels = as_dict(connected_components(lonely, path, seed))
    assert labels == {**{i: 0 for i in range(301)}, 999: 999}


@pytest.mark.parametrize("max_rows", [1_000_000, SALTED])
def test_strong_components(golden, max_rows):
    labels = as_dict(strongly_connected_components(golden, max_rows=max_rows))
    assert labels == {IDS[name]: e[3] for name, e in EXPECTED.items()}


def test_strong_components_match_mutual_reachability(spark):
    edges = [(i, (i * 7 + 3) % 23) for i in range(23)] + [(i, i + 1) for i in range(30, 45)] + [(45, 40), (33, 31)]
    reach = {v: {v} for e in edges for v in e}
    for _ in range(len(reach)):
        for a, b in edges:
            reach[a] |= reach[b]
    expected = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    df = spark.createDataFrame([(a, b, "m") for a, b in edges], "src long, dst long, attr string")
    vertices = g.endpoints(df).distinct().selectExpr("id", "string(id) as name")
    assert as_dict(strongly_connected_components(g.PropertyGraph(vertices, df))) == expected


def brute_core_numbers(edges):
    core, k = {}, 0
    left = list(edges)
    while left:
        k += 1
        while True:
            ends = Counter(v for e in left for v in e)
            low = {v for v, n in ends.items() if n < k}
            if not low:
                break
            left = [e for e in left if e[0] not in low and e[1] not in low]
            core.update((v, k - 1) for v in low)
            for v in set(ends) - low - {v for e in left for v in e}:
                core[v] = k - 1
    return core


@pytest.mark.parametrize("max_rows", [1_000_000, SALTED])
def test_core_numbers(golden, max_rows):
    numbers = as_dict(core_numbers(golden.edges, max_rows=max_rows))
    for k, (n_vertices, _, _) in CORES.items():
        assert sum(core >= k for core in numbers.values()) == n_vertices
    bounds = core_numbers(golden.edges).select("id", (F.col("core") + 1).alias("bound"))
    assert as_dict(core_numbers(golden.edges, bounds)) == numbers


def test_core_numbers_of_a_multigraph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(60)] + [(i, i + 1) for i in range(20, 30)] + [(40, 40)]
    df = spark.createDataFrame([(a, b, "m") for a, b in edges], "src long, dst long, attr string")
    assert as_dict(core_numbers(df)) == brute_core_numbers(edges)


def test_grown_components_contract_only_what_is_new(spark, monkeypatch):
    """Components found period by period equal those found at once, from links to new edges and newcomers alone."""
    rng, seen, counted = random.Random(6), [], []
    whole = community.connected_components
    monkeypatch.setattr(community, "connected_components", lambda v, e: counted.append(e.count()) or whole(v, e))
    before = spark.createDataFrame([], "id long, com_id long")
    for _ in range(3):
        fresh = [(rng.randrange(60), rng.randrange(60)) for _ in range(14)]
        seen += fresh
        edges = spark.createDataFrame([(a, b, "m") for a, b in seen], "src long, dst long, attr string")
        vertices = g.endpoints(edges).distinct().selectExpr("id", "string(id) as name")
        df = spark.createDataFrame([(a, b, "m") for a, b in fresh], "src long, dst long, attr string")
        before = community.grown_components(g.PropertyGraph(vertices, edges), before, df)
        assert as_dict(before) == as_dict(whole(vertices, edges))
    assert max(counted) <= 14


def test_chain_of_strong_components_needs_few_passes(spark, monkeypatch):
    """64 rings of three, each linked to the next, with rising ids: lowest ids as colours would settle one ring a pass."""
    edges = [(3 * r + i, 3 * r + (i + 1) % 3) for r in range(64) for i in range(3)] + [(3 * r, 3 * r + 3) for r in range(63)]
    df = spark.createDataFrame([(a, b, "m") for a, b in edges], "src long, dst long, attr string")
    vertices = g.endpoints(df).distinct().selectExpr("id", "string(id) as name")
    graph, passes = g.PropertyGraph(vertices, df), []
    prepare = scc.prepare_links
    monkeypatch.setattr(scc, "prepare_links", lambda *args: passes.append(1) or prepare(*args))
    assert as_dict(strongly_connected_components(graph)) == {i: i - i % 3 for i in range(192)}
    assert len(passes) <= 12
    few = as_dict(strongly_connected_components(graph, max_passes=1))
    assert all(label in (i, i - i % 3) for i, label in few.items()) and len(set(few.values())) > 64


def test_triangles(golden):
    counts = triangle_count(golden)
    assert as_dict(counts) == {IDS[name]: e[2] for name, e in EXPECTED.items()}
    assert triangle_total(counts).first()[0] == 1


def test_triangles_of_a_complete_graph(spark):
    edges = spark.createDataFrame([(i, j, "m") for i in range(7) for j in range(7) if i != j],
                                  "src long, dst long, attr string")
    vertices = g.endpoints(edges).distinct().selectExpr("id", "string(id) as name")
    assert as_dict(triangle_count(g.PropertyGraph(vertices, edges))) == {i: 15 for i in range(7)}


def test_pagerank(golden):
    ranks = as_dict(pagerank(golden))
    for name, e in EXPECTED.items():
        assert ranks[IDS[name]] == pytest.approx(e[4], abs=1e-4)
    salted = as_dict(pagerank(golden, rounds=2, normalize=True, max_rows=SALTED))
    plain = as_dict(pagerank(golden, rounds=2, normalize=True))
    assert salted == pytest.approx(plain)
    assert sum(plain.values()) == pytest.approx(12)


@pytest.mark.parametrize("max_rows", [1_000_000, SALTED])
def test_label_propagation(golden, max_rows):
    labels = as_dict(label_propagation(golden, max_rows=max_rows))
    assert labels == {IDS[name]: label for name, label in LABELS.items()}


def test_prune_only_every_nth_period(golden):
    assert prune(golden, 3).edges.count() == len(EDGES)
    assert prune(golden, 4).edges.count() == CORES[2][1]


def test_lookups(golden, spark):
    assert g.vertex_name(golden.vertices, 2732329846).first()[0] == "Michael"
    assert g.vertex_name(golden.vertices, 1).first()[0] == "user not found"
    assert g.vertex_id(golden.vertices, "Michael").first()[0] == "2732329846"
    assert g.vertex_id(golden.vertices, "nobody").first()[0] == "0"
    keys = spark.createDataFrame([(1,), (132988448,)], "id long")
    assert as_dict(g.lookup_by_id(golden.vertices, keys)) == {1: "user not found", 132988448: "David"}
    keys = spark.createDataFrame([("David",), ("x",)], "name string")
    assert as_dict(g.lookup_by_name(golden.vertices, keys)) == {"David": "132988448", "x": "0"}


def test_union_and_missing_vertices(golden, spark):
    extra = g.PropertyGraph(spark.createDataFrame([(1, "New"), (132988448, "David")], "id long, name string"),
                            spark.createDataFrame([(1, 2, "m")], "src long, dst long, attr string"))
    both = g.graph_union(golden, extra)
    assert (both.vertices.count(), both.edges.count()) == (13, 35)
    completed = g.with_missing_vertices(both, "John Doe")
    assert as_dict(completed.vertices)[2] == "John Doe" and completed.vertices.count() == 14
    named = {(r["src_name"], r["dst_name"]) for r in g.triplets(extra).collect()}
    assert named == {("New", None)}


def test_induced_subgraph_drops_unnamed_vertices(golden, spark):
    keep = spark.createDataFrame([(IDS["David"],), (IDS["Harold"],), (IDS["Zoe"],)], "id long")
    sub = g.induced_subgraph(golden, keep)
    assert (sub.vertices.count(), sub.edges.count()) == (3, 7)
    unnamed = golden.vertices.selectExpr("id", "nullif(name, 'Zoe') as name")
    assert g.induced_subgraph(g.PropertyGraph(unnamed, golden.edges), keep).edges.count() == 5


def test_stored_links_are_not_shuffled_again(golden, monkeypatch):
    from murmuration.operators import propagate as p

    monkeypatch.setattr(p, "LINKS_PER_PARTITION", 2)
    spark = golden.edges.sparkSession
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for max_rows in (1_000_000, SALTED):
            links = p.prepare_links(p.both_ways(golden.edges), max_rows)
            assert (links.hot is None) == (max_rows != SALTED)
            met = links.gather(golden.vertices.select("id"))
            assert len(met.collect()) == 24
            plan = met._jdf.queryExecution().executedPlan().toString()
            above_links = plan.split("SortMergeJoin")[1].split("InMemoryTableScan")[0]
            assert "Exchange" not in above_links, plan
            links.release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_every_hot_neighbour_is_split(spark):
    """Many hot vertices: none is left unsplit, and the values passed along do not change."""
    from murmuration.operators import propagate as p

    links = spark.range(30_000).selectExpr("id", "id % 5000 as nbr", "1L as w")
    split = p.prepare_links(links, max_rows=2)
    assert split.hot.count() == 5000
    assert split.rows.groupBy("nbr", "salt").count().where("count > 6").count() == 0
    assert split.rows.select("nbr").where("salt > 0").distinct().count() > 4500
    state = spark.range(5000).selectExpr("id", "id * 2 as v")
    assert split.gather(state).where("v = 2 * nbr").count() == 30_000
    split.release()


def test_a_loop_keeps_few_tables(spark):
    import os

    from murmuration.operators import propagate as p
    from murmuration.session import scratch

    with scratch(spark) as folder:
        def step(state):
            return state.selectExpr("id", "least(v + 1, 12) as v", "v as before")

        start = spark.range(10).selectExpr("id", "0L as v", "-1L as before")
        last = p.run_until(start, step, F.count_if(F.col("v") != F.col("before")), lambda n: n == 0, 1)
        assert last.where("v = 12").count() == 10
        assert len(os.listdir(folder.removeprefix("file://"))) == 1


def test_a_hub_is_split_in_joins_with_stored_vertices(spark):
    """Adaptive skew-join handling applies to edges joined with the vertices of a mention graph."""
    from murmuration.session import durable

    edges = durable(spark.range(60_000).selectExpr("if(id % 3 = 0, 1, id) as src", "id + 100000 as dst",
                                                   "string(id) as attr").repartition(8))
    names = g.one_name_per_id(edges.selectExpr("src as id", "'v' as name"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        kept = g.edges_between(edges.selectExpr("src", "src as dst", "attr"), names)
        assert len(kept.collect()) == 60_000
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _tables_made(monkeypatch):
    from murmuration import session

    made, new_folder = [], session.new_folder
    monkeypatch.setattr(session, "new_folder", lambda spark, purpose: made.append(purpose) or new_folder(spark, purpose))
    return made


def _graph(spark, edges):
    df = spark.createDataFrame([(a, b, str(i)) for i, (a, b) in enumerate(edges)], "src long, dst long, attr string")
    return g.PropertyGraph(g.endpoints(df).distinct().withColumn("name", F.col("id").cast("string")), df)


def test_long_tails_take_few_jobs(spark, monkeypatch):
    """A triangle with a tail of 600 vertices: a round takes one vertex off the tail, and the triangle keeps it connected."""
    tail = [(0, 1), (1, 2), (2, 0), *((i, i + 1) for i in range(2, 602))]
    graph = _graph(spark, tail)
    made = _tables_made(monkeypatch)
    assert sorted(r.id for r in kcore(graph, 2).vertices.collect()) == [0, 1, 2]
    assert len(made) < 60
    made.clear()
    # The numbers fall along the path of a ladder from its open end.
    ladder = [e for i in range(300) for e in ((2 * i, 2 * i + 1), (2 * i, 2 * i + 2), (2 * i + 1, 2 * i + 3), (2 * i, 2 * i + 3))]
    numbers = as_dict(core_numbers(_graph(spark, ladder).edges))
    assert numbers == brute_core_numbers(ladder)
    assert len(made) < 60
    made.clear()
    ring = [*tail, (602, 0)]
    assert set(as_dict(strongly_connected_components(_graph(spark, ring))).values()) == {0}
    assert len(made) < 60


@pytest.mark.parametrize("max_edges, at_once", [(0, 1000), (30, 1000), (30, 0)])
def test_small_and_large_components_agree(spark, max_edges, at_once):
    from murmuration.operators.kcore import kcore_ids

    rng = random.Random(5)
    edges = [(100 * c + rng.randrange(n), 100 * c + rng.randrange(n)) for c, n in enumerate((4, 12, 30, 60)) for _ in range(2 * n)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000), (2000, 2001)]
    graph = _graph(spark, edges)
    numbers = brute_core_numbers(edges)
    assert as_dict(core_numbers(graph.edges, max_edges=max_edges, at_once=at_once)) == numbers
    for k in (2, 3):
        assert sorted(r.id for r in kcore_ids(graph.edges, k, max_edges=max_edges, at_once=at_once).collect()) == sorted(v for v, n in numbers.items() if n >= k)
    reach = {v: {v} for v in numbers}
    for v in reach:
        todo = [v]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b not in reach[v]:
                    reach[v].add(b)
                    todo.append(b)
    expected = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    assert as_dict(strongly_connected_components(graph, max_edges=max_edges)) == expected


def test_one_core_needs_no_rounds(spark, monkeypatch):
    """Vertices with an edge, a loop or an edge whose other end is null; components are not looked for."""
    from murmuration.operators import kcore as module

    monkeypatch.setattr(module, "by_component", None)
    edges = spark.createDataFrame([(1, 2), (3, 3), (4, None), (None, None)], "src long, dst long")
    assert sorted(r["id"] for r in module.kcore_ids(edges, 1).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("max_in_task", [0, 30, 10_000])
def test_components_finished_by_a_task(spark, max_in_task):
    from murmuration.operators import components as module

    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1200)] + [(9, None)]
    label = {v: v for pair in pairs for v in pair if v is not None}
    for _ in label:
        for a, b in pairs:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    edges = spark.createDataFrame(pairs, "src long, dst long")
    ids = spark.createDataFrame([(v,) for v in label], "id long")
    got = {r["id"]: r["component"] for r in module.connected_components(ids, edges, max_in_task=max_in_task).collect()}
    assert got == label


def test_ranks_settle_in_few_rounds(spark, monkeypatch):
    """Groups of users that hardly mention each other: plain rounds take as many as the reset needs, about a hundred."""
    from murmuration.operators import pagerank as module

    rng = random.Random(1)
    pairs = [(10 * n + i, 10 * n + j) for n in range(4) for i in range(10) for j in rng.sample(range(10), 4) if i != j]
    pairs += [(10 * n, 10 * n + 10) for n in range(3)]
    edges = spark.createDataFrame([(*p, "") for p in pairs], "src long, dst long, attr string")
    vertices = spark.createDataFrame([(v, "") for v in range(40)], "id long, name string")
    jobs, store = [], module.durable_with
    monkeypatch.setattr(module, "durable_with", lambda *args, **kwargs: jobs.append(1) or store(*args, **kwargs))
    got = {r["id"]: r["rank"] for r in module.pagerank(g.PropertyGraph(vertices, edges), tolerance=1e-10).collect()}
    out, want = {}, {v: 1.0 for v in range(40)}
    for a, _ in pairs:
        out[a] = out.get(a, 0) + 1
    for _ in range(300):
        after = dict.fromkeys(want, 0.15)
        for a, b in pairs:
            after[b] += 0.85 * want[a] / out[a]
        want = after
    assert got == pytest.approx(want, abs=1e-8)
    assert len(jobs) <= 15


def test_triangle_lists_hold_small_numbers(spark, monkeypatch):
    from murmuration.operators import triangles as module

    tables, store = [], module.durable
    monkeypatch.setattr(module, "durable", lambda df: tables.append(df) or store(df))
    big = 1 << 60
    pairs = [(big + a, big + b) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 1), (4, 4), (2, 1)]] + [(None, big + 1)]
    edges = spark.createDataFrame([(*p, "") for p in pairs], "src long, dst long, attr string")
    vertices = spark.createDataFrame([(big + v, "") for v in range(1, 6)], "id long, name string")
    got = {r["id"] - big: r["triangles"] for r in module.triangle_count(g.PropertyGraph(vertices, edges)).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 1, 5: 0}
    assert dict(tables[-1].dtypes)["targets"] == "array<int>"


def test_hubs_that_hold_a_large_component_together(spark, monkeypatch):
    """Ladders, whose numbers fall along their path, linked by two hubs: without the hubs each is a block's, so rounds are few."""
    ladders = [(1000 * c + a, 1000 * c + b) for c in range(3) for i in range(100)
               for a, b in ((2 * i, 2 * i + 1), (2 * i, 2 * i + 2), (2 * i + 1, 2 * i + 3), (2 * i, 2 * i + 3))]
    edges = [*ladders, *((1000 * c + 2 * i, hub) for c in range(3) for i in range(50, 100) for hub in (9000, 9001)[:1 + i % 2]), (9000, 9001)]
    graph, numbers = _graph(spark, edges), brute_core_numbers(edges)
    made = _tables_made(monkeypatch)
    assert as_dict(core_numbers(graph.edges, max_edges=600)) == numbers
    assert len(made) < 40


@pytest.mark.parametrize("max_edges, hub_neighbours", [(0, 64), (10, 5), (1000, 5), (1000, 0)])
def test_core_numbers_in_blocks(spark, max_edges, hub_neighbours):
    from murmuration.operators.bounded import core_numbers_in_blocks
    from murmuration.operators.propagate import merged_edges

    rng = random.Random(8)
    edges = [(100 * c + rng.randrange(12), 100 * c + rng.randrange(12)) for c in range(6) for _ in range(30)]
    edges += [(rng.choice((7, 700, 701, 702)), 100 * rng.randrange(6) + rng.randrange(12)) for _ in range(90)] + [(700, 700), (700, 701)] * 3
    pairs, numbers = merged_edges(_graph(spark, edges).edges), brute_core_numbers(edges)
    assert as_dict(core_numbers_in_blocks(pairs, None, max_edges, hub_neighbours)) == numbers
    bounds = spark.createDataFrame([(v, n + v % 3) for v, n in numbers.items() if v % 4], "id long, bound long")
    assert as_dict(core_numbers_in_blocks(pairs, bounds, max_edges, hub_neighbours)) == numbers
