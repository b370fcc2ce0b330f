import random

import fixtures as X
import pytest
from pyspark.sql import functions as F

from strideway.operators import generators, spectral, traversal
from strideway.operators.graph import Graph


def test_edges_last_wins_and_canonical(spark):
    g = Graph.of(spark, [("b", "a", 1), ("a", "b", 5), ("a", "a", 2)])
    assert {(r["src"], r["dst"]): r["w"] for r in g.edges.collect()} == {("a", "b"): 5, ("a", "a"): 2}
    a = {(r["src"], r["dst"]): r["v"] for r in g.adjacency().collect()}
    assert sum(a.values()) == 3 and a["a", "a"] == 1
    d = Graph.of(spark, [("a", "b"), ("a", "a")], directed=True)
    assert d.adjacency().count() == 2
    u = (d + Graph.of(spark, [("a", "b", 7)], True)).remove_edge("a", "a")
    assert [(r["src"], r["dst"], r["w"]) for r in u.edges.collect()] == [("a", "b", 7)]
    assert g.remove_nodes(["b"]).vertices.count() == 1 and g.add_clique(["x", "y", "z"]).edges.count() == 5


def test_predicates(spark):
    e = spark.createDataFrame([("a", "b", {"c": "red"}), ("b", "c", {"c": "blue"})], "src string, dst string, attrs map<string,string>")
    v = spark.createDataFrame([("a", {"k": "1"}), ("b", {"k": "1"}), ("c", {})], "node string, attrs map<string,string>")
    g = Graph(e, True, v)
    assert g.find_edges(F.col("attrs")["k"] == "1", lambda a: a["c"] == "red").count() == 1
    assert g.find_nodes(lambda a: "k" not in a).first()["node"] == "c"
    assert {r["node"]: r["k"] for r in g.node_properties("k").collect()} == {"a": "1", "b": "1", "c": None}


def test_shortest_paths_and_components_against_brute_force(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(24)})
    g = Graph.of(spark, edges, directed=True)
    nodes = sorted({x for e in edges for x in e})
    dist = {(a, b): 0 if a == b else 10**9 for a in nodes for b in nodes}
    for a, b in edges:
        if a != b:
            dist[a, b] = 1
    for k in nodes:
        for a in nodes:
            for b in nodes:
                dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    got = {(r["src"], r["dst"]): r["dist"] for r in traversal.bfs(g.edges).collect()}
    assert got == {k: v for k, v in dist.items() if v < 10**9}
    weighted = {(r["src"], r["dst"]): r["dist"] for r in traversal.weighted_distances(g.edges).collect()}
    assert weighted == got
    scc = {r["node"]: r["component"] for r in traversal.strong_components(g.edges).collect()}
    assert scc == {a: min(b for b in nodes if dist[a, b] < 10**9 and dist[b, a] < 10**9) for a in nodes}
    sp = traversal.all_shortest_paths(g.edges).collect()
    assert all(len(r["path"]) - 1 == dist[r["src"], r["dst"]] for r in sp) and len({tuple(r["path"]) for r in sp}) == len(sp)
    sizes = {c: sum(x == c for x in scc.values()) for c in scc.values()}
    big = min(c for c in sizes if sizes[c] == max(sizes.values()))
    inside = {v for v in scc if scc[v] == big}
    assert {(r["src"], r["dst"]) for r in traversal.giant_component(g.edges).collect()} == {e for e in edges if set(e) <= inside}


def test_small_network(spark):
    g = Graph.of(spark, X.NETWORK)
    arcs = g.arcs()
    assert traversal.diameter(arcs).first()["value"] == 4 or traversal.diameter(arcs).first()["value"] == 3
    pr, ok = traversal.pagerank(arcs)
    assert ok and sum(X.pairs(pr).values()) == pytest.approx(1)
    assert traversal.weak_components(g.edges).select("component").distinct().count() == 1
    e = X.pairs(spectral.eigenvector_centrality(arcs))
    m, names = spectral.dense(g.adjacency())
    want = spectral.leading_vector(m)
    assert all(e[n] == pytest.approx(abs(w), abs=1e-6) for n, w in zip(names, want))
    assert spectral.algebraic_connectivity(g) > 0
    modules = g.vertices.select("node", F.when(F.col("node") < "D", "l").otherwise("r").alias("module"))
    q = g.modularity(modules).first()["value"]
    mod = {r["node"]: r["module"] for r in modules.collect()}
    deg = X.pairs(g.degrees())
    adj = {(r["src"], r["dst"]) for r in arcs.collect()}
    brute = sum(((a, b) in adj) - deg[a] * deg[b] / 22 for a in mod for b in mod if mod[a] == mod[b]) / 22
    assert q == pytest.approx(brute)
    best, value = generators.find_communities(g.edges, 400, seed=2)
    found = spark.createDataFrame(list(best.items()), "node string, module string")
    assert value == pytest.approx(g.modularity(found).first()["value"]) and value >= q - 0.2
    with pytest.raises(spectral.TooLarge):
        spectral.dense(g.adjacency(), most=3)


def test_generators(spark):
    n = spark.range(60).select(F.col("id").cast("string").alias("node"))
    e = generators.gnp(n, 0.1, seed=4)
    m = e.count()
    assert 110 < m < 250 and e.filter("src = dst").count() == 0 and e.distinct().count() == m
    assert generators.gnp(n, 0.1, seed=4).exceptAll(e).count() == 0
    assert len(generators.gnm(20, 30)) == 30 and len(generators.barabasi_albert(30, 2)) == 3 + 27 * 2
    r = generators.k_regular(3, 10)
    assert len(set(r)) == 15 and all(sum(str(v) in x for x in r) == 3 for v in range(10))
    cost = lambda m: sum(m[a] != m[b] for a, b in X.NETWORK)
    start = {v: v for e in X.NETWORK for v in e}
    assert generators.anneal(start, cost, 300)[1] < cost(start)
