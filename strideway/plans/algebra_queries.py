"""Queries on what the other modules leave out: changes and filters of networks, order-k distances, flows, windows of grams, and files written and read back; with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strideway.functions import grams
from strideway.operators import entropy, traversal
from strideway.operators.graph import Graph
from strideway.operators.higher_order import HigherOrderNetwork
from strideway.operators.iterate import shared_folder
from strideway.operators.paths import PathSet, ranked, rendered
from strideway.plans import inputs as I
from strideway.plans.path_queries import big, r6
from strideway.sources import files

Q: dict = {}
SQL: dict[str, str] = {}
_N, _U, _T, _S, _ST = I.TRADE, I.TRADE_UNDIRECTED, I.HAND_OVERS, I.SESSIONS, I.stats_sql()
_EDGES = "SELECT src, dst, CAST(w AS BIGINT) AS w"
_PATHS = "array_to_string(path, ',') AS path, CAST(freq AS BIGINT) AS freq"


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


def _edges(g: Graph):
    return g.edges.select("src", "dst", big("w"))


def _paths(p: PathSet):
    return p.longest.select(rendered("path").alias("path"), big("freq"))


def _nations(spark, sf) -> Graph:
    """The trade network whose nodes know their region."""
    v = I.table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    v = v.select(F.col("n_nationkey").cast("string").alias("node"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("attrs"))
    return Graph(I.trade_network(spark, sf).edges, True, v)


# --- networks -----------------------------------------------------------------------------------


@query("find_nodes", "SELECT CAST(n_nationkey AS VARCHAR) AS node FROM nation WHERE n_regionkey IN (1, 3)")
def find_nodes(spark, sf):
    return _nations(spark, sf).find_nodes(F.col("attrs")["region"].isin("1", "3"))


@query("find_edges", f"WITH {_N} {_EDGES} FROM net WHERE src IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey < 3) AND dst IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey < 3)")
def find_edges(spark, sf):
    return _nations(spark, sf).find_edges(F.col("attrs")["region"].cast("int") < 3).select("src", "dst", big("w"))


@query("node_properties", "SELECT CAST(n_nationkey AS VARCHAR) AS node, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def node_properties(spark, sf):
    return _nations(spark, sf).node_properties("region")


@query("to_unweighted", f"WITH {_N} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM net")
def to_unweighted(spark, sf):
    return _edges(I.trade_network(spark, sf).to_unweighted())


@query("to_undirected", f"WITH {_N} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM net")
def to_undirected(spark, sf):
    return I.trade_network(spark, sf).to_undirected().edges.select("src", "dst")


@query("add_edges", f"WITH {_N}, more AS (SELECT 'hub' AS src, dst, CAST(1 AS DOUBLE) AS w FROM net UNION SELECT src, dst, 0.0 FROM net WHERE src = '3') {_EDGES} FROM more UNION ALL {_EDGES} FROM net WHERE src <> '3'")
def add_edges(spark, sf):
    g = I.trade_network(spark, sf)
    hub = g.edges.select(F.lit("hub").alias("src"), "dst", F.lit(1.0).alias("w"))
    return _edges(g.add_edges(hub.unionByName(g.edges.filter("src = '3'").select("src", "dst", F.lit(0.0).alias("w")))))


@query("add_nodes", f"WITH {_N} SELECT node FROM nodes UNION SELECT r_name FROM region")
def add_nodes(spark, sf):
    return I.trade_network(spark, sf).add_nodes(I.table(spark, sf, "region", "r_name").select(F.col("r_name").alias("node"))).vertices.select("node")


@query("add_clique", f"WITH {_N}, c AS (SELECT unnest(['x', 'y', 'z']) AS v) {_EDGES} FROM net UNION ALL SELECT a.v, b.v, 1 FROM c a, c b WHERE a.v <> b.v")
def add_clique(spark, sf):
    return _edges(I.trade_network(spark, sf).add_clique(["x", "y", "z"]))


@query("remove_nodes", f"WITH {_N} {_EDGES} FROM net WHERE src NOT IN ('1', '7') AND dst NOT IN ('1', '7')")
def remove_nodes(spark, sf):
    return _edges(I.trade_network(spark, sf).remove_nodes(["1", "7"]))


@query("remove_edge", f"WITH {_N} {_EDGES} FROM net WHERE NOT (src = '2' AND dst = '5')")
def remove_edge(spark, sf):
    return _edges(I.trade_network(spark, sf).remove_edge("2", "5"))


@query("network_union", f"WITH {_N}, rev AS (SELECT dst AS src, src AS dst, -w AS w FROM net) {_EDGES} FROM rev UNION ALL {_EDGES} FROM net ANTI JOIN rev USING (src, dst)")
def network_union(spark, sf):
    g = I.trade_network(spark, sf)
    return _edges(g + Graph(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("w")).alias("w")), True))


@query("network_summary", f"""WITH {_N}, deg AS (SELECT node, (SELECT count(*) FROM net WHERE src = node) + (SELECT count(*) FROM net WHERE dst = node) AS d FROM nodes)
SELECT 'nodes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM deg UNION ALL SELECT 'mean_degree', round(avg(d), 6) FROM deg UNION ALL SELECT 'max_degree', CAST(max(d) AS DOUBLE) FROM deg
UNION ALL SELECT 'edges', CAST(count(*) AS DOUBLE) FROM net UNION ALL SELECT 'total_weight', sum(w) FROM net""")
def network_summary(spark, sf):
    return I.trade_network(spark, sf).summary().select("metric", r6("value", "value"))


@query("network_of_paths", f"WITH {_S}, {_ST} SELECT g[1] AS src, g[2] AS dst, CAST(sub + lon AS BIGINT) AS w FROM stats WHERE k = 1")
def network_of_paths(spark, sf):
    return _edges(Graph.from_paths(I.sessions(spark, sf)))


@query("weighted_distances", f"""WITH RECURSIVE {_N}, far AS (SELECT node AS src, node AS dst, 0.0::DOUBLE AS dist, 0 AS n FROM nodes UNION SELECT far.src, net.dst, min(dist + w), n + 1 FROM far JOIN net ON far.dst = net.src WHERE n < 24 GROUP BY far.src, net.dst, n)
SELECT src, dst, CAST(min(dist) AS BIGINT) AS dist FROM far GROUP BY src, dst""")
def weighted_distances(spark, sf):
    return traversal.weighted_distances(I.trade_network(spark, sf).edges).select("src", "dst", big("dist"))


@query("rank_nodes", f"WITH {_N}, deg AS (SELECT node, (SELECT coalesce(sum(w), 0) FROM net WHERE dst = node) AS value FROM nodes) SELECT node, CAST(value AS BIGINT) AS value FROM deg ORDER BY value DESC, node LIMIT 5")
def rank_nodes(spark, sf):
    """The five nodes of largest ingoing weight: a top-k report."""
    return ranked(I.trade_network(spark, sf).degrees("inweight")).limit(5).select("node", big("value"))


# --- order-k networks ---------------------------------------------------------------------------

_HON = f"{_S}, {_ST}, hon AS (SELECT g[1:2] AS a, g[2:3] AS b, sub + lon AS w FROM stats WHERE k = 2 AND sub + lon > 0), one AS (SELECT g AS n FROM stats WHERE k = 1)"
_HON_FAR = f"""WITH RECURSIVE {_HON}, far AS (SELECT a AS x, b AS y, 1 AS d FROM hon UNION SELECT far.x, hon.b, d + 1 FROM far JOIN hon ON far.y = hon.a WHERE d < 12),
pairs AS (SELECT x[1] AS src, y[2] AS dst, d + 1 AS dist FROM far UNION ALL SELECT n[1], n[2], 1 FROM one),
dist AS (SELECT src, dst, min(dist) AS dist FROM pairs WHERE src <> dst GROUP BY src, dst), names AS (SELECT g[1] AS node FROM stats WHERE k = 0)"""


def _hon(spark, sf) -> HigherOrderNetwork:
    return HigherOrderNetwork(I.sessions(spark, sf), 2)


@query("hon_nodes_k2", f"WITH {_HON} SELECT array_to_string(n, ',') AS node FROM one")
def hon_nodes_k2(spark, sf):
    return _hon(spark, sf).nodes().select(rendered("node").alias("node"))


@query("hon_summary_k2", f"WITH {_S}, {_ST} SELECT 'edges' AS metric, count(*)::DOUBLE AS value FROM stats WHERE k = 2 UNION ALL SELECT 'weight_sub', sum(sub) FROM stats WHERE k = 2 UNION ALL SELECT 'weight_long', sum(lon) FROM stats WHERE k = 2 UNION ALL SELECT 'nodes', count(*)::DOUBLE FROM stats WHERE k = 1")
def hon_summary_k2(spark, sf):
    return _hon(spark, sf).summary()


@query("hon_laplacian_k2", f"""WITH {_HON}, t AS (SELECT a, b, -w / sum(w) OVER (PARTITION BY a) AS v FROM hon), every AS (SELECT a, b, v FROM t UNION ALL SELECT n, n, 1.0 FROM one)
SELECT array_to_string(a, ',') AS src, array_to_string(b, ',') AS dst, round(sum(v), 6) AS v FROM every GROUP BY a, b""")
def hon_laplacian_k2(spark, sf):
    return _hon(spark, sf).laplacian().select(rendered("src").alias("src"), rendered("dst").alias("dst"), r6("v", "v"))


@query("hon_log_likelihood_k2", f"""WITH {_HON}, t AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM hon), steps AS (SELECT path[i:i + 1] AS a, path[i + 1:i + 2] AS b, freq FROM (SELECT path, freq, unnest(generate_series(1, len(path) - 2)) AS i FROM longest WHERE len(path) > 2))
SELECT round(sum(freq * ln(p)), 3) AS value FROM steps JOIN t USING (a, b)""")
def hon_log_likelihood_k2(spark, sf):
    return spark.createDataFrame([(_hon(spark, sf).log_likelihood(),)], "value double").select(F.round("value", 3).alias("value"))


@query("hon_distances_k2", f"{_HON_FAR} SELECT src, dst, CAST(dist AS BIGINT) AS dist FROM dist UNION ALL SELECT node, node, 0 FROM names")
def hon_distances_k2(spark, sf):
    return _hon(spark, sf).distances().select("src", "dst", big("dist"))


@query("hon_closeness_k2", f"{_HON_FAR} SELECT node, round(coalesce((SELECT sum(1.0 / dist.dist) FROM dist WHERE dst = node), 0), 6) AS value FROM names")
def hon_closeness_k2(spark, sf):
    return _hon(spark, sf).closeness().select("node", r6("value", "value"))


# --- paths --------------------------------------------------------------------------------------


@query("kgram_windows", f"WITH {_S}, win AS (SELECT path[i:i + 2] AS g, freq FROM (SELECT path, freq, unnest(generate_series(1, len(path) - 2)) AS i FROM longest WHERE len(path) > 2)) SELECT array_to_string(g, ',') AS gram, CAST(sum(freq) AS BIGINT) AS n FROM win GROUP BY g")
def kgram_windows(spark, sf):
    return I.sessions(spark, sf).longest.select(F.explode(grams.kgrams("path", 3)).alias("g"), "freq").groupBy("g").agg(F.sum("freq").alias("n")).select(rendered("g").alias("gram"), big("n"))


@query("first_order_path", f"WITH {_S} SELECT {_PATHS} FROM longest WHERE len(path) > 1")
def first_order_path(spark, sf):
    """Paths as sequences of nodes of order 2, and back."""
    longest = I.sessions(spark, sf).longest.filter(F.size("path") > 1)
    return longest.select(rendered(grams.first_order_path(grams.higher_order_nodes("path", 2))).alias("path"), big("freq"))


@query("maximal_runs", f"""WITH {_S}, marked AS (SELECT row_number() OVER () AS id, path, freq FROM longest), each AS (SELECT id, freq, unnest(path) AS v, generate_subscripts(path, 1) AS i FROM marked),
keep AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM each WHERE v IN ('click', 'view')) SELECT CAST(n AS BIGINT) AS length, CAST(sum(freq) AS BIGINT) AS runs FROM (SELECT id, run, any_value(freq) AS freq, count(*) AS n FROM keep GROUP BY id, run) GROUP BY n""")
def maximal_runs(spark, sf):
    """How many runs of the two kinds of events there are, by length."""
    runs = I.sessions(spark, sf).longest.select(F.explode(grams.runs("path", ["click", "view"])).alias("run"), "freq")
    return runs.groupBy(F.size("run").cast("bigint").alias("length")).agg(F.sum("freq").cast("bigint").alias("runs"))


@query("expand_sets", "SELECT concat(r_name, ',', a, ',', b) AS path FROM region, (SELECT unnest(['x', 'y']) AS a), (SELECT unnest(['1', '2', '3']) AS b)")
def expand_sets(spark, sf):
    sets = F.array(F.array("r_name"), F.array(F.lit("x"), F.lit("y")), F.array(*map(F.lit, "123")))
    return I.table(spark, sf, "region", "r_name").select(F.explode(grams.expand_sets(sets)).alias("p")).select(rendered("p").alias("path"))


@query("path_sequence", f"WITH {_S} SELECT s, CAST(sum(n) AS BIGINT) AS n FROM (SELECT v AS s, sum(freq) AS n FROM (SELECT unnest(path) AS v, freq FROM longest) GROUP BY v UNION ALL SELECT '|', sum(freq) FROM longest) GROUP BY s")
def path_sequence(spark, sf):
    """Symbols of all paths concatenated; the positions have no gap, or there would be fewer."""
    s = I.sessions(spark, sf).sequence()
    return s.select("pos", "s").distinct().groupBy("s").agg(F.count("*").alias("n"))


@query("add_paths", f"WITH {_S} SELECT array_to_string(path, ',') AS path, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT path, freq FROM longest UNION ALL SELECT ['click', 'view'], 3 UNION ALL SELECT ['new'], 2) GROUP BY path")
def add_paths(spark, sf):
    return _paths(I.sessions(spark, sf).add_paths([(("click", "view"), 3), (("new",), 2)]))


_TWO = f"{_S}, {_ST}, c AS (SELECT g[2] AS node, g[1] AS s, g[3] AS d, sub + lon AS n FROM stats WHERE k = 2 AND sub + lon > 0)"


@query("preference_counts", f"WITH {_TWO} SELECT node, s, d, CAST(n AS BIGINT) AS n FROM c")
def preference_counts(spark, sf):
    return entropy.preference_counts(I.sessions(spark, sf)).select("node", "s", "d", big("n"))


@query("memory_flows", f"WITH {_TWO} SELECT concat('src_', s) AS src, concat('mem_', s, '_', node) AS dst, CAST(sum(n) AS BIGINT) AS w FROM c GROUP BY node, s UNION ALL SELECT concat('mem_', s, '_', node), concat('tgt_', d, '@', node), CAST(n AS BIGINT) FROM c")
def memory_flows(spark, sf):
    return entropy.memory_flows(I.sessions(spark, sf)).select("src", "dst", big("w"))


# --- time-stamped edges -------------------------------------------------------------------------


@query("temporal_node_filter", f"WITH {_T} SELECT src, dst, t FROM te WHERE src IN ('1', '2', '3', '4', '5', '6', '7', '8', '9') AND dst IN ('1', '2', '3', '4', '5', '6', '7', '8', '9')")
def temporal_node_filter(spark, sf):
    return I.hand_overs(spark, sf).filter_nodes(list("123456789")).edges.select("src", "dst", "t")


@query("temporal_add_edges", f"WITH {_T} SELECT src, dst, t FROM te UNION ALL SELECT dst, src, t + 1 FROM te")
def temporal_add_edges(spark, sf):
    te = I.hand_overs(spark, sf)
    return te.add_edges(te.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("t") + 1).alias("t"), "seq")).edges.select("src", "dst", "t")


# --- files, written and read back ---------------------------------------------------------------


def _file(spark, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


@query("ngram_file", f"WITH {_S} SELECT {_PATHS} FROM longest")
def ngram_file(spark, sf):
    files.write_ngrams(I.sessions(spark, sf), at := _file(spark, "ngrams"))
    return _paths(files.read_ngrams(spark, at))


@query("edge_file", f"WITH {_N} {_EDGES} FROM net")
def edge_file(spark, sf):
    files.write_graph(I.trade_network(spark, sf), at := _file(spark, "edges"), weighted=True)
    return _edges(files.read_graph(spark, at, weighted=True, directed=True))


@query("edge_file_as_paths", f"WITH {_N} SELECT concat(src, ',', dst) AS path, CAST(w AS BIGINT) AS freq FROM net")
def edge_file_as_paths(spark, sf):
    files.write_graph(I.trade_network(spark, sf), at := _file(spark, "edges"), weighted=True)
    return _paths(files.read_edge_paths(spark, at, weight=True))


@query("dag_file", f"WITH {_N} SELECT DISTINCT src, dst FROM net WHERE src IN ('1', '2', '3', '4', '5', '6', '7', '8') AND dst IN ('1', '2', '3', '4', '5', '6', '7', '8')")
def dag_file(spark, sf):
    files.write_dag(I.trade_network(spark, sf).edges, at := _file(spark, "dag"))
    return files.read_dag(spark, at, nodes=list("12345678"))


@query("origin_destination_file", f"WITH {_N} SELECT src AS o, dst AS d, CAST(w AS BIGINT) AS w FROM net")
def origin_destination_file(spark, sf):
    files.write_graph(I.trade_network(spark, sf), at := _file(spark, "od"), weighted=True)
    return files.read_origin_destination(spark, at).select("o", "d", big("w"))
