"""Queries on networks and time-stamped edges, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideway.operators import extract, traversal
from strideway.plans import inputs as I
from strideway.plans.path_queries import big, r6

Q: dict = {}
SQL: dict[str, str] = {}
_N, _U, _T = I.TRADE, I.TRADE_UNDIRECTED, I.HAND_OVERS
DELTA = 2


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@query("aggregate_network", f"WITH {_N} SELECT src, dst, CAST(w AS BIGINT) AS w FROM net")
def aggregate_network(spark, sf):
    return I.trade_network(spark, sf).edges.select("src", "dst", big("w"))


_DEG = "deg AS (SELECT node, CAST((SELECT count(*) FROM net WHERE src = node) + (SELECT count(*) FROM net WHERE dst = node) AS DOUBLE) AS d FROM nodes)"


@query("degrees", f"WITH {_N}, {_DEG} SELECT node, CAST(d AS BIGINT) AS value FROM deg")
def degrees(spark, sf):
    return I.trade_network(spark, sf).degrees().select("node", big("value"))


@query("weighted_degrees", f"WITH {_N} SELECT node, CAST(coalesce((SELECT sum(w) FROM net WHERE src = node), 0) AS BIGINT) AS outweight, CAST(coalesce((SELECT sum(w) FROM net WHERE dst = node), 0) AS BIGINT) AS inweight FROM nodes")
def weighted_degrees(spark, sf):
    g = I.trade_network(spark, sf)
    return g.degrees("outweight").select("node", F.col("value").cast("bigint").alias("outweight")).join(g.degrees("inweight").select("node", F.col("value").cast("bigint").alias("inweight")), "node")


@query("degree_distribution", f"WITH {_N}, {_DEG} SELECT CAST(d AS BIGINT) AS degree, round(count(*) / (SELECT count(*) FROM nodes), 6) AS p FROM deg GROUP BY d")
def degree_distribution(spark, sf):
    return I.trade_network(spark, sf).degree_distribution().select(big("degree"), r6("p", "p"))


@query("degree_moments", f"WITH {_N}, {_DEG} SELECT 1 AS k, round(avg(d), 6) AS value FROM deg UNION ALL SELECT 2, round(avg(d * d), 6) FROM deg UNION ALL SELECT 3, round(avg(d * d * d), 6) FROM deg")
def degree_moments(spark, sf):
    g = I.trade_network(spark, sf)
    one = lambda k: g.degree_moment(k).select(F.lit(k).alias("k"), r6("value", "value"))
    return one(1).unionByName(one(2)).unionByName(one(3))


@query("mean_degree", f"WITH {_N}, {_DEG} SELECT round(avg(d), 6) AS value FROM deg")
def mean_degree(spark, sf):
    return I.trade_network(spark, sf).mean_degree().select(r6("value", "value"))


@query("molloy_reed_fraction", f"WITH {_N}, {_DEG} SELECT round(avg(d * d) / avg(d), 6) AS value FROM deg")
def molloy_reed_fraction(spark, sf):
    return I.trade_network(spark, sf).molloy_reed_fraction().select(r6("value", "value"))


@query("degree_generating_function", f"WITH {_N}, {_DEG} SELECT round(avg(pow(0.5, d)), 6) AS value FROM deg")
def degree_generating_function(spark, sf):
    return I.trade_network(spark, sf).generating_function(0.5).select(r6("value", "value"))


_CC = "cc AS (SELECT node, CASE WHEN (SELECT count(*) FROM arcs WHERE src = node) < 2 THEN 0.0 ELSE (SELECT count(*) FROM arcs x JOIN arcs y ON x.src = y.src JOIN arcs z ON z.src = x.dst AND z.dst = y.dst WHERE x.src = node) / ((SELECT count(*) FROM arcs WHERE src = node) * ((SELECT count(*) FROM arcs WHERE src = node) - 1.0)) END AS v FROM nodes)"


@query("clustering_local", f"WITH {_U}, {_CC} SELECT node, round(v, 6) AS value FROM cc")
def clustering_local(spark, sf):
    return I.trade_network(spark, sf, False).clustering().select("node", r6("value", "value"))


@query("clustering_avg", f"WITH {_U}, {_CC} SELECT round(avg(v), 6) AS value FROM cc")
def clustering_avg(spark, sf):
    return I.trade_network(spark, sf, False).average_clustering().select(r6("value", "value"))


@query("adjacency_coo", f"WITH {_U} SELECT src, dst, CAST(w AS BIGINT) AS v FROM arcs")
def adjacency_coo(spark, sf):
    return I.trade_network(spark, sf, False).adjacency(True).select("src", "dst", big("v"))


@query("transition_coo", f"WITH {_N} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM net")
def transition_coo(spark, sf):
    return I.trade_network(spark, sf).transitions().select("src", "dst", r6("p", "p"))


@query("laplacian_coo", f"WITH {_U} SELECT src, dst, CAST(-1 AS BIGINT) AS v FROM arcs UNION ALL SELECT src, src, CAST(count(*) AS BIGINT) FROM arcs GROUP BY 1, 2")
def laplacian_coo(spark, sf):
    return I.trade_network(spark, sf, False).laplacian().select("src", "dst", big("v"))


def _regions(spark, sf):
    return I.table(spark, sf, "nation", F.col("n_nationkey").cast("string").alias("node"), F.col("n_regionkey").cast("string").alias("module"))


_MOD = "md AS (SELECT CAST(n_nationkey AS VARCHAR) AS node, CAST(n_regionkey AS VARCHAR) AS module FROM nation WHERE CAST(n_nationkey AS VARCHAR) IN (SELECT node FROM nodes))"


@query("modularity", f"WITH {_U}, {_MOD}, e AS (SELECT a.module, count(*) AS n FROM arcs JOIN md a ON a.node = src JOIN md b ON b.node = dst WHERE a.module = b.module GROUP BY 1), d AS (SELECT module, count(*) AS n FROM arcs JOIN md ON node = src GROUP BY 1), m AS (SELECT 2.0 * count(*) AS m2 FROM und) SELECT round(sum(coalesce(e.n, 0) / m2 - pow(d.n / m2, 2)), 6) AS value FROM d LEFT JOIN e USING (module), m")
def modularity(spark, sf):
    return I.trade_network(spark, sf, False).modularity(_regions(spark, sf)).select(r6("value", "value"))


@query("assortativity", f"WITH {_U}, {_MOD}, e AS (SELECT a.module, count(*) AS n FROM arcs JOIN md a ON a.node = src JOIN md b ON b.node = dst WHERE a.module = b.module GROUP BY 1), d AS (SELECT module, count(*) AS n FROM arcs JOIN md ON node = src GROUP BY 1), m AS (SELECT 2.0 * count(*) AS m2 FROM und) SELECT round(sum(coalesce(e.n, 0) / m2 - pow(d.n / m2, 2)) / (1 - sum(pow(d.n / m2, 2))), 6) AS value FROM d LEFT JOIN e USING (module), m")
def assortativity(spark, sf):
    return I.trade_network(spark, sf, False).assortativity(_regions(spark, sf)).select(r6("value", "value"))


@query("map_equation_network", f"""WITH {_U}, {_MOD}, e AS (SELECT src, dst, a.module AS ms, b.module AS me FROM und JOIN md a ON a.node = src JOIN md b ON b.node = dst),
x AS (SELECT src AS node, ms AS module, ms <> me AS o FROM e UNION ALL SELECT dst, me, ms <> me FROM e),
t AS (SELECT CAST(count(*) AS DOUBLE) AS total, CAST(sum(CASE WHEN ms <> me THEN 1 ELSE 0 END) AS DOUBLE) AS across FROM e),
m AS (SELECT module, CAST(count(*) AS DOUBLE) AS c, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS DOUBLE) AS ex, sum(CASE WHEN o THEN 0.0 ELSE 0.5 END) AS wi FROM x GROUP BY 1),
n AS (SELECT module, node, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY 1, 2),
h AS (SELECT n.module, sum(n.c / (2 * wi + ex) * log2(n.c / (2 * wi + ex))) AS h FROM n JOIN m USING (module) GROUP BY 1)
SELECT round(-sum(across / total * (c / (2 * total)) * log2(c / (2 * total))) - sum((wi + ex) / (total + across) * h), 6) AS value FROM m JOIN h USING (module), t""")
def map_equation_network(spark, sf):
    return I.trade_network(spark, sf, False).map_equation(_regions(spark, sf)).select(r6("value", "value"))


_BFS = "bfs AS (SELECT src, dst, min(dist) AS dist FROM reach GROUP BY 1, 2)"
_REACH = "WITH RECURSIVE {}, reach(src, dst, dist) AS (SELECT node, node, 0 FROM nodes UNION SELECT r.src, a.dst, r.dist + 1 FROM reach r JOIN {} a ON r.dst = a.src WHERE r.dist < 24), " + _BFS


@query("bfs_distance", _REACH.format(_N, "net") + " SELECT src, dst, CAST(dist AS BIGINT) AS dist FROM bfs")
def bfs_distance(spark, sf):
    return traversal.bfs(I.trade_network(spark, sf).edges).select("src", "dst", big("dist"))


@query("diameter", _REACH.format(_U, "arcs") + " SELECT CASE WHEN count(*) < (SELECT count(*) * count(*) FROM nodes) THEN CAST('inf' AS DOUBLE) ELSE CAST(max(dist) AS DOUBLE) END AS value FROM bfs")
def diameter(spark, sf):
    return traversal.diameter(I.trade_network(spark, sf, False).arcs())


@query("average_path_length", _REACH.format(_U, "arcs") + " SELECT CASE WHEN count(*) < (SELECT count(*) * count(*) FROM nodes) THEN CAST('inf' AS DOUBLE) ELSE round(sum(dist) / CAST(count(*) AS DOUBLE), 6) END AS value FROM bfs")
def average_path_length(spark, sf):
    return traversal.average_path_length(I.trade_network(spark, sf, False).arcs()).select(r6("value", "value"))


@query("closeness_network", _REACH.format(_N, "net") + ", c AS (SELECT dst AS node, ((SELECT count(*) FROM nodes) - 1) / CAST(sum(dist) AS DOUBLE) AS v FROM bfs WHERE src <> dst GROUP BY 1) SELECT node, round(coalesce(v, 0.0), 6) AS value FROM nodes LEFT JOIN c USING (node)")
def closeness_network(spark, sf):
    return traversal.closeness(I.trade_network(spark, sf).edges).select("node", r6("value", "value"))


_SP = ", sp(src, dst, path) AS (SELECT node, node, [node] FROM nodes UNION ALL SELECT s.src, a.dst, list_append(s.path, a.dst) FROM sp s JOIN {0} a ON s.dst = a.src JOIN bfs b ON b.src = s.src AND b.dst = a.dst AND b.dist = len(s.path))"


@query("all_shortest_paths", _REACH.format(_N, "net") + _SP.format("net") + " SELECT src, dst, array_to_string(path, ',') AS path FROM sp")
def all_shortest_paths(spark, sf):
    return traversal.all_shortest_paths(I.trade_network(spark, sf).edges).select("src", "dst", F.array_join("path", ",").alias("path"))


@query("betweenness_network", _REACH.format(_N, "net") + _SP.format("net") + ", m AS (SELECT *, count(*) OVER (PARTITION BY src, dst) AS m FROM sp), i AS (SELECT unnest(path[2:len(path) - 1]) AS node, m FROM m WHERE len(path) > 2), v AS (SELECT node, sum(1.0 / m) AS v FROM i GROUP BY 1) SELECT node, round(coalesce(v, 0.0), 6) AS value FROM nodes LEFT JOIN v USING (node)")
def betweenness_network(spark, sf):
    return traversal.betweenness(I.trade_network(spark, sf).edges).select("node", r6("value", "value"))


_PR = "pr AS (SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS v, 0 AS it FROM nodes UNION ALL SELECT n.node, 0.85 * (coalesce((SELECT sum(q.v * e.p) FROM pr q JOIN tr e ON e.src = q.node WHERE e.dst = n.node), 0.0) + (SELECT coalesce(sum(q.v), 0.0) FROM pr q WHERE q.node NOT IN (SELECT src FROM net)) / (SELECT count(*) FROM nodes)) + 0.15 / (SELECT count(*) FROM nodes), (SELECT max(it) FROM pr) + 1 FROM nodes n WHERE (SELECT max(it) FROM pr) < 60)"


@query("pagerank", f"WITH RECURSIVE {_N}, tr AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS p FROM net), {_PR} SELECT node, round(v, 5) AS value FROM pr WHERE it = 60")
def pagerank(spark, sf):
    values, _ = traversal.pagerank(I.trade_network(spark, sf).edges, tol=1e-9)
    return values.select("node", F.round("value", 5).alias("value"))


_CLOSE = "WITH RECURSIVE {}, reach(src, dst) AS (SELECT node, node FROM nodes UNION SELECT r.src, a.dst FROM reach r JOIN {} a ON r.dst = a.src)"


@query("wcc", _CLOSE.format(_U, "arcs") + " SELECT src AS node, min(dst) AS component FROM reach GROUP BY 1")
def wcc(spark, sf):
    return traversal.weak_components(I.trade_network(spark, sf).edges)


@query("scc", _CLOSE.format(_N, "net") + " SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
def scc(spark, sf):
    return traversal.strong_components(I.trade_network(spark, sf).edges)


@query("giant_component", _CLOSE.format(_N, "net") + ", c AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1), b AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), k AS (SELECT node FROM c WHERE component = (SELECT component FROM b)) SELECT src, dst, CAST(w AS BIGINT) AS w FROM net WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def giant_component(spark, sf):
    return traversal.giant_component(I.trade_network(spark, sf).edges).select("src", "dst", big("w"))


# --- time-stamped edges ---------------------------------------------------------------------------


@query("temporal_summary", f"WITH {_T} SELECT CAST(count(*) AS BIGINT) AS edges, CAST(max(t) - min(t) AS BIGINT) AS length, CAST(count(DISTINCT t) AS BIGINT) AS times, CAST((SELECT count(*) FROM (SELECT src FROM te UNION SELECT dst FROM te)) AS BIGINT) AS nodes FROM te")
def temporal_summary(spark, sf):
    return I.hand_overs(spark, sf).summary().groupBy().pivot("metric", ["edges", "length", "times", "nodes"]).agg(F.first("value").cast("bigint"))


@query("temporal_filter", f"WITH {_T} SELECT src, dst, t FROM te WHERE src <> dst")
def temporal_filter(spark, sf):
    return I.hand_overs(spark, sf).filter_edges(F.col("src") != F.col("dst")).edges.select("src", "dst", "t")


@query("temporal_network", f"WITH {_T} SELECT src, dst, CAST(count(*) AS BIGINT) AS w FROM te GROUP BY 1, 2")
def temporal_network(spark, sf):
    return I.hand_overs(spark, sf).aggregate().select("src", "dst", big("w"))


@query("inter_event_times", f"WITH {_T}, d AS (SELECT DISTINCT t FROM te) SELECT t, gap FROM (SELECT t, t - lag(t) OVER (ORDER BY t) AS gap FROM d) WHERE gap IS NOT NULL")
def inter_event_times(spark, sf):
    return I.hand_overs(spark, sf).inter_event_times()


@query("inter_path_times", f"WITH {_T} SELECT dst AS node, src, t, gap FROM (SELECT *, (SELECT min(b.t) FROM te b WHERE b.src = a.dst AND b.t > a.t) - t AS gap FROM te a) WHERE gap IS NOT NULL")
def inter_path_times(spark, sf):
    return I.hand_overs(spark, sf).inter_path_times()


@query("reverse_time", f"WITH {_T} SELECT dst AS src, src AS dst, (SELECT max(t) FROM te) - t + 1 AS t FROM te")
def reverse_time(spark, sf):
    return I.hand_overs(spark, sf).reverse_time().edges.select("src", "dst", "t")


@query("rolling_window_networks", f"WITH {_T}, r AS (SELECT min(t) AS lo, max(t) AS hi FROM te), s AS (SELECT unnest(generate_series(lo, hi - 1440, 720)) AS start FROM r) SELECT start, src, dst, CAST(count(src) AS BIGINT) AS w FROM s LEFT JOIN te ON t >= start AND t < start + 1440 GROUP BY 1, 2, 3")
def rolling_window_networks(spark, sf):
    return I.hand_overs(spark, sf).rolling_windows(1440, 720).select("start", "src", "dst", F.coalesce("w", F.lit(0)).cast("bigint").alias("w"))


@query("temporal_two_paths", f"WITH {_T} SELECT a.src, a.dst AS mid, b.dst, CAST(count(*) AS BIGINT) AS n FROM te a JOIN te b ON a.dst = b.src AND b.t > a.t AND b.t <= a.t + 15 GROUP BY 1, 2, 3")
def temporal_two_paths(spark, sf):
    return I.hand_overs(spark, sf).two_paths(15).groupBy("src", "mid", "dst").agg(F.count("*").alias("n"))


_UNF = f"unf AS (SELECT DISTINCT src AS v, t AS tv, dst AS w, t + x AS tw FROM te, (SELECT unnest(generate_series(1, {DELTA})) AS x) AS d)"


@query("unfolded_dag_edges", f"WITH {_T}, {_UNF} SELECT v, tv, w, tw FROM unf")
def unfolded_dag_edges(spark, sf):
    return I.hand_overs(spark, sf).unfolded(DELTA)


@query("dag_roots_leaves", f"WITH {_T}, {_UNF}, e AS (SELECT concat(v, '@', tv) AS src, concat(w, '@', tw) AS dst FROM unf), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, node NOT IN (SELECT dst FROM e) AS root, node NOT IN (SELECT src FROM e) AS leaf FROM n")
def dag_roots_leaves(spark, sf):
    u = I.hand_overs(spark, sf).unfolded(DELTA)
    return extract.roots_and_leaves(u.select(F.concat_ws("@", "v", F.col("tv").cast("string")).alias("src"), F.concat_ws("@", "w", F.col("tw").cast("string")).alias("dst")))


@query("dag_routes", """WITH RECURSIVE e AS (SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation UNION SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer UNION SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier),
r(path, last) AS (SELECT [src], src FROM (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)) UNION ALL SELECT list_append(path, dst), dst FROM r JOIN e ON last = src)
SELECT array_to_string(path, ',') AS path FROM r WHERE last NOT IN (SELECT src FROM e)""")
def dag_routes(spark, sf):
    n = I.table(spark, sf, "nation", F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    c = I.table(spark, sf, "customer", F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey")).alias("dst"))
    s = I.table(spark, sf, "supplier", F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"))
    return extract.routes(n.unionByName(c).unionByName(s)).select(F.array_join("path", ",").alias("path"))


@query("activity_dag", "WITH r AS (SELECT conv_id, turn, role FROM conversations) SELECT a.role AS src, b.role AS dst, CAST(count(*) AS BIGINT) AS n FROM (SELECT role, row_number() OVER (ORDER BY conv_id, turn) AS i FROM r) a JOIN (SELECT role, row_number() OVER (ORDER BY conv_id, turn) AS i FROM r) b ON b.i - a.i BETWEEN 1 AND 3 GROUP BY 1, 2")
def activity_dag(spark, sf):
    from pyspark.sql.window import Window

    # positions over all conversations: offsets from the conversations' sizes, so only that narrow table is ordered as a whole
    c = I.table(spark, sf, "conversations", "conv_id", "turn", "role")
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("o", F.coalesce(F.sum("n").over(Window.orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("conv_id", "o")
    seq = c.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).join(offsets, "conv_id").select((F.col("i") + F.col("o")).alias("pos"), F.col("role").alias("s"))
    return extract.activity_dag(seq, 3).groupBy("src", "dst").agg(F.count("*").alias("n"))


_NODE = "concat({0}, chr(1), {1})"


@query("causal_paths", f"""WITH RECURSIVE {_T}, {_UNF}, rt AS (SELECT DISTINCT v, tv FROM unf WHERE NOT EXISTS (SELECT 1 FROM unf b WHERE b.w = unf.v AND b.tw = unf.tv)),
fr(root, v, t, path, depth) AS (SELECT concat(v, '@', tv), v, tv, [v], 0 FROM rt
  UNION ALL SELECT DISTINCT root, w, tw, list_append(best, w), depth FROM (SELECT f.root, u.w, u.tw, f.depth + 1 AS depth, min(f.path) OVER (PARTITION BY f.root, u.w, f.depth) AS best FROM fr f JOIN unf u ON f.v = u.v AND f.t = u.tv) AS x),
p AS (SELECT DISTINCT root, path FROM fr), leaf AS (SELECT root, path FROM p WHERE (root, path) NOT IN (SELECT (root, path[1:len(path) - 1]) FROM p WHERE len(path) > 1)),
c AS (SELECT [path[i] for i in generate_series(1, len(path)) if i = 1 or path[i] <> path[i - 1]] AS path FROM leaf)
SELECT array_to_string(path, ',') AS path, CAST(count(*) AS BIGINT) AS freq FROM c GROUP BY path""")
def causal_paths(spark, sf):
    return extract.causal_paths(I.hand_overs(spark, sf), DELTA).longest.select(F.array_join("path", ",").alias("path"), big("freq"))


@query("single_continuation_paths", f"""WITH RECURSIVE {_T}, nx AS (SELECT a.src, a.dst, a.t, a.seq, (SELECT arg_min(b.seq, (b.t, b.seq)) FROM te b WHERE b.src = a.dst AND b.t > a.t AND b.t <= a.t + 30) AS n FROM te a),
w(path, times, n) AS (SELECT [src, dst], [t], n FROM nx WHERE seq NOT IN (SELECT n FROM nx WHERE n IS NOT NULL)
  UNION ALL SELECT list_append(path, x.dst), list_append(times, x.t), x.n FROM w JOIN nx x ON w.n = x.seq),
d AS (SELECT DISTINCT path, times FROM w WHERE n IS NULL)
SELECT array_to_string(path, ',') AS path, CAST(count(*) AS BIGINT) AS freq FROM d GROUP BY path""")
def single_continuation_paths(spark, sf):
    return extract.single_continuation_paths(I.hand_overs(spark, sf), 30).longest.select(F.array_join("path", ",").alias("path"), big("freq"))


@query("od_paths", _REACH.format(_N, "net") + _SP.format("net") + ", o AS (SELECT src AS o, dst AS d, w FROM pairs), m AS (SELECT src, dst, path, count(*) OVER (PARTITION BY src, dst) AS m, row_number() OVER (PARTITION BY src, dst ORDER BY path) - 1 AS i FROM sp), r AS (SELECT path, floor(w / m) + CASE WHEN i < w % m THEN 1 ELSE 0 END AS f FROM m JOIN o ON o = src AND d = dst) SELECT array_to_string(path, ',') AS path, CAST(sum(f) AS BIGINT) AS freq FROM r WHERE f > 0 GROUP BY path")
def od_paths(spark, sf):
    od = I.trade_pairs(spark, sf).select(F.col("src").alias("o"), F.col("dst").alias("d"), "w")
    return extract.paths_from_origin_destination(od, I.trade_network(spark, sf).edges).longest.select(F.array_join("path", ",").alias("path"), big("freq"))


# --- seeded random operators: no SQL --------------------------------------------------------------


@query("random_walk_paths", None)
def random_walk_paths(spark, sf):
    g = I.trade_network(spark, sf)
    starts = g.vertices.select(F.xxhash64("node").alias("walker"), "node")
    return extract.random_walks(g.transitions(), starts, 10).select("walker", F.array_join("path", ",").alias("path"))


@query("shuffle_edges", None)
def shuffle_edges(spark, sf):
    return I.hand_overs(spark, sf).shuffle_times(seed=1).edges


@query("sample_causal_paths", None)
def sample_causal_paths(spark, sf):
    return extract.sampled_causal_paths(I.hand_overs(spark, sf), DELTA, 50).longest.select(F.array_join("path", ",").alias("path"), big("freq"))


@query("gnp_graph", None)
def gnp_graph(spark, sf):
    from strideway.operators.generators import gnp

    return gnp(I.table(spark, sf, "nation", F.col("n_nationkey").cast("string").alias("node")), 0.2, seed=3)


@query("temporal_walks", None)
def temporal_walks(spark, sf):
    net = I.hand_overs(spark, sf)
    starts = net.edges.select(F.col("src").alias("node")).distinct().select(F.xxhash64("node").alias("walker"), "node")
    return extract.temporal_walks(net, starts, 5).select("walker", F.array_join("path", ",").alias("path"))


@query("eigenvector_centrality", None)
def eigenvector_centrality(spark, sf):
    from strideway.operators.spectral import eigenvector_centrality as values

    return values(I.trade_network(spark, sf, False).arcs()).select("node", r6("value", "value"))
