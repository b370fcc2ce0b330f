import fixtures as X
import pytest
from pyspark.sql import functions as F

from strideway.operators import extract
from strideway.operators.graph import Graph
from strideway.operators.paths import PathSet
from strideway.operators.temporal import TemporalEdges


@pytest.fixture(scope="module")
def net(spark):
    return TemporalEdges.of(spark, X.TEMPORAL)


def test_times(net):
    assert {r["gap"] for r in net.inter_event_times().collect()} == {1}
    gaps = {}
    for r in net.inter_path_times().orderBy("t").collect():
        gaps.setdefault(r["node"], []).append(r["gap"])
    assert sorted(gaps["e"]) == [1] * 11 or sorted(gaps["e"]) == [1] * 10
    assert sorted(gaps["b"]) == [3, 4] and sorted(gaps["f"]) == [1, 5, 9]
    back = net.reverse_time().edges.orderBy("t").first()
    assert (back["src"], back["dst"], back["t"]) == ("f", "e", 1)
    assert net.filter_nodes(["e", "b"]).edges.count() == 3 and net.filter_edges(lambda a, b, t: t < 4).edges.count() == 3
    assert net.network(1, 3).edges.count() == 2


def test_rolling_windows(spark):
    n = TemporalEdges.of(spark, [("a", "b", 1), ("a", "b", 2), ("b", "c", 4), ("c", "d", 11)])
    for size, step in ((3, 1), (3, 3), (2, 4), (20, 1)):
        want = set()
        s = 1
        while s + size <= 11:
            inside = [(a, b) for a, b, t in [("a", "b", 1), ("a", "b", 2), ("b", "c", 4), ("c", "d", 11)] if s <= t < s + size]
            want |= {(s, a, b, float(inside.count((a, b)))) for a, b in inside} or {(s, None, None, None)}
            s += step
        assert {tuple(r) for r in n.rolling_windows(size, step).select("start", "src", "dst", "w").collect()} == want


def test_causal_paths(spark, net):
    p = extract.causal_paths(TemporalEdges.of(spark, X.CAUSAL), 2)
    assert X.freqs(p) == {"aba": 1, "dcd": 1, "dcb": 1, "abcd": 1}
    assert extract.causal_paths(net, 1).observation_count().first()["n"] == 10
    assert extract.sampled_causal_paths(net, 1, 3).observation_count().first()["n"] >= 3


def test_two_paths_and_single_continuation(spark, net):
    brute = sorted((a, b, d, t, u) for a, b, t in X.TEMPORAL for c, d, u in X.TEMPORAL if b == c and 0 < u - t <= 3)
    assert sorted(tuple(r) for r in net.two_paths(3).collect()) == brute
    n = TemporalEdges.of(spark, [("a", "b", 1), ("b", "c", 2), ("b", "d", 3), ("c", "e", 9), ("x", "b", 1)])
    assert X.freqs(extract.single_continuation_paths(n, 5)) == {"abc": 1, "xbc": 1, "bd": 1, "ce": 1}


def test_dag(spark):
    e = spark.createDataFrame(X.DAG, "src string, dst string")
    assert extract.is_acyclic(e) and not extract.is_acyclic(e.unionByName(spark.createDataFrame([("g", "a")], "src string, dst string")))
    p = extract.paths_from_dag(e)
    assert p.observation_count().first()["n"] == 7 and "acbfg" in X.freqs(p)
    assert sorted("".join(r["path"]) for r in extract.routes_to(e, "g").collect()) == ["abfg", "acbfg", "acg"]
    with pytest.raises(ValueError):
        extract.paths_from_dag(e.unionByName(spark.createDataFrame([("g", "a")], "src string, dst string")))
    level = {r["node"]: r["level"] for r in extract.topological_levels(e).collect()}
    assert all(level[a] < level[b] for a, b in X.DAG)
    many = {v: {"a"} if v in "abc" else {"x", "y"} for v in "abcefghij"}
    assert extract.paths_from_dag(e, many).observation_count().first()["n"] > 7
    order, kinds = extract.dfs([*X.DAG, ("g", "a")])
    assert kinds["g", "a"] == "back" and set(order) == set("abcefghij")
    cyc = spark.createDataFrame([*X.DAG, ("g", "a")], "src string, dst string")
    assert extract.is_acyclic(extract.make_acyclic(cyc))


def test_origin_destination(spark):
    arcs = Graph.of(spark, X.NETWORK).arcs()
    od = spark.createDataFrame(X.OD, "o string, d string, w double")
    got = X.freqs(extract.paths_from_origin_destination(od, arcs))
    assert {got.pop("ABFH"), got.pop("ACGH")} == {2, 3} and got == {"DBCE": 7, "ABF": 3, "BCE": 3}
    one = X.freqs(extract.paths_from_origin_destination(od, arcs, distribute=False))
    assert sum(one.get(k, 0) for k in ("ABFH", "ACGH")) == 5 and len(one) == 4


def test_random_operators(spark, net):
    t = Graph.of(spark, X.NETWORK).transitions()
    starts = spark.createDataFrame([(k, "A") for k in range(20)], "walker long, node string")
    walks = extract.random_walks(t, starts, 6, seed=3).collect()
    arcs = {(r["src"], r["dst"]) for r in t.collect()}
    assert len(walks) == 20 and all(len(r["path"]) == 7 and all(x in arcs for x in zip(r["path"], r["path"][1:])) for r in walks)
    p = PathSet.of(spark, X.NGRAMS)
    r = extract.random_paths(p, 0.5, seed=1)
    assert r.observation_count().first()["n"] == 6
    s = net.shuffle_times(seed=2)
    assert sorted(r["t"] for r in s.edges.collect()) == list(range(1, 22)) and s.aggregate().exceptAll(net.aggregate()).count() == 0
    seq = spark.createDataFrame(list(enumerate("abcab")), "pos long, s string").select("pos", F.col("s"))
    assert extract.activity_dag(seq, 1).count() == 4 and extract.activity_dag(seq).count() == 10


def test_trees_and_temporal_walks(spark):
    n = TemporalEdges.of(spark, X.CAUSAL)
    tree = {tuple(r) for r in extract.causal_tree(n, "a", 1, 2).collect()}
    assert ("a", 0, "b", 1) in tree and ("b", 1, "c", 2) in tree and len({r[2:] for r in tree}) == len(tree)
    starts = spark.createDataFrame([(1, "a"), (2, "z")], "walker long, node string")
    got = {r["walker"]: r["path"] for r in extract.temporal_walks(n, starts, 3, seed=1).collect()}
    assert got[2] == ["z"] and got[1][:2] == ["a", "b"] and len(got[1]) <= 4


def test_a_guard_that_ends_a_walk_is_an_error(spark):
    chain = TemporalEdges.of(spark, [(str(k), str(k + 1), k) for k in range(6)])
    assert extract.causal_paths(chain, 1, guard=10).longest.count() == 1
    with pytest.raises(ValueError):
        extract.causal_paths(chain, 1, guard=2)
