"""Queries on path sets and Markov models, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.operators.higher_order import HigherOrderNetwork
from strideway.operators.model import MarkovSequence, MultiOrderModel
from strideway.operators.paths import rendered
from strideway.plans import inputs as I

Q: dict = {}
SQL: dict[str, str] = {}
_S, _ST = I.SESSIONS, I.stats_sql()


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def big(c: str):
    return F.col(c).cast("bigint").alias(c)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def grams_out(df):
    return df.select(rendered("path").alias("gram"), F.col("k").cast("int").alias("k"), big("sub"), big("longest"))


_GRAMS = "SELECT array_to_string(g, ',') AS gram, k, CAST(sub AS BIGINT) AS sub, CAST(lon AS BIGINT) AS longest FROM stats"


@query("subpath_counts", f"WITH {_S}, {_ST} {_GRAMS}")
def subpath_counts(spark, sf):
    return grams_out(I.sessions(spark, sf).stats())


@query("subpath_counts_capped", f"WITH {I.CUSTOMER_ORDERS}, {I.stats_sql(2)} {_GRAMS} WHERE k <= 2")
def subpath_counts_capped(spark, sf):
    return grams_out(I.customer_orders(spark, sf, cap=2).stats(max_len=2))


@query("longest_path_counts", f"WITH {_S} SELECT array_to_string(path, ',') AS path, CAST(freq AS BIGINT) AS freq FROM longest")
def longest_path_counts(spark, sf):
    return I.sessions(spark, sf).longest.select(rendered("path").alias("path"), big("freq"))


@query("path_length_dist", f"WITH {_S}, {_ST} SELECT k, CAST(sum(sub) AS BIGINT) AS sub, CAST(sum(lon) AS BIGINT) AS longest FROM stats GROUP BY k")
def path_length_dist(spark, sf):
    return I.sessions(spark, sf).path_lengths().select(F.col("k").cast("int").alias("k"), big("sub"), big("longest"))


@query("unique_paths_by_length", f"WITH {_S} SELECT CAST(len(path) - 1 AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n FROM longest GROUP BY 1")
def unique_paths_by_length(spark, sf):
    return I.sessions(spark, sf).longest.groupBy((F.size("path") - 1).alias("k")).agg(F.count("*").alias("n"))


@query("observation_count", f"WITH {_S} SELECT CAST(sum(freq) AS BIGINT) AS n FROM longest")
def observation_count(spark, sf):
    return I.sessions(spark, sf).observation_count().select(big("n"))


@query("node_traversals", f"WITH {_S} SELECT v AS node, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT unnest(path) AS v, freq FROM longest) GROUP BY 1")
def node_traversals(spark, sf):
    return I.sessions(spark, sf).node_traversals().select("node", big("n"))


@query("visitation_probability", f"WITH {_S}, t AS (SELECT v, sum(freq) AS n FROM (SELECT unnest(path) AS v, freq FROM longest) GROUP BY 1) SELECT v AS node, round(n / sum(n) OVER (), 6) AS p FROM t")
def visitation_probability(spark, sf):
    return I.sessions(spark, sf).visitation_probabilities().select("node", r6("p", "p"))


@query("od_from_paths", f"WITH {_S} SELECT path[1] AS origin, path[-1] AS destination, CAST(sum(freq) AS BIGINT) AS n FROM longest GROUP BY 1, 2")
def od_from_paths(spark, sf):
    return I.sessions(spark, sf).origin_destination().select("origin", "destination", big("n"))


_KEEP = ["click", "view", "purchase"]
_RUNS = """
pos AS (SELECT path, freq, i, path[i] AS v, list_contains(['click', 'view', 'purchase'], path[i]) AS ok FROM longest, LATERAL (SELECT unnest(generate_series(1, len(path))) AS i) AS y),
grp AS (SELECT *, i - row_number() OVER (PARTITION BY path, ok ORDER BY i) AS run FROM pos),
cut AS (SELECT path, run, any_value(freq) AS freq, list(v ORDER BY i) AS p FROM grp WHERE ok GROUP BY path, run)"""


@query("paths_filter_nodes", f"WITH {_S}, {_RUNS} SELECT array_to_string(p, ',') AS path, CAST(sum(freq) AS BIGINT) AS freq FROM cut GROUP BY p")
def paths_filter_nodes(spark, sf):
    return I.sessions(spark, sf).filter_nodes(_KEEP).longest.select(rendered("path").alias("path"), big("freq"))


@query("paths_project", f"WITH {I.CUSTOMER_ORDERS}, m AS (SELECT list_transform(path, lambda x: CASE WHEN x IN ('1-URGENT', '2-HIGH') THEN 'hot' ELSE 'cold' END) AS p, freq FROM longest) SELECT array_to_string(p, ',') AS path, CAST(sum(freq) AS BIGINT) AS freq FROM m GROUP BY p")
def paths_project(spark, sf):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return I.customer_orders(spark, sf).project({n: "hot" if n < "3" else "cold" for n in names}).longest.select(rendered("path").alias("path"), big("freq"))


@query("paths_remove_repeats", f"WITH {_S}, m AS (SELECT [path[i] for i in generate_series(1, len(path)) if i = 1 or path[i] <> path[i - 1]] AS p, freq FROM longest) SELECT array_to_string(p, ',') AS path, CAST(sum(freq) AS BIGINT) AS freq FROM m GROUP BY p")
def paths_remove_repeats(spark, sf):
    return I.sessions(spark, sf).remove_repeats().longest.select(rendered("path").alias("path"), big("freq"))


@query("paths_union_scale", f"WITH a AS (WITH {_S} SELECT * FROM longest), b AS (WITH {I.CONVERSATIONS} SELECT * FROM longest) SELECT array_to_string(path, ',') AS path, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT path, freq FROM a UNION ALL SELECT path, 3 * freq FROM b) GROUP BY path")
def paths_union_scale(spark, sf):
    return (I.sessions(spark, sf) + 3 * I.conversations(spark, sf)).longest.select(rendered("path").alias("path"), big("freq"))


def _hon_sql(k: int) -> str:
    return f"WITH {_S}, {_ST} SELECT array_to_string(g[1:{k}], ',') AS src, array_to_string(g[2:{k + 1}], ',') AS dst, CAST(sub AS BIGINT) AS w_sub, CAST(lon AS BIGINT) AS w_long FROM stats WHERE k = {k}"


def _hon(k: int):
    return lambda spark, sf: HigherOrderNetwork(I.sessions(spark, sf), k).edges().select(rendered("src").alias("src"), rendered("dst").alias("dst"), big("w_sub"), big("w_long"))


def _transition_sql(k: int) -> str:
    return f"WITH {_S}, {_ST}, c AS (SELECT g[1:{k}] AS a, g[2:{k + 1}] AS b, sub + lon AS w FROM stats WHERE k = {k}) SELECT array_to_string(a, ',') AS src, array_to_string(b, ',') AS dst, round(w / sum(w) OVER (PARTITION BY a), 6) AS p FROM c"


def _transition(k: int):
    return lambda spark, sf: HigherOrderNetwork(I.sessions(spark, sf), k).transitions().select(rendered("src").alias("src"), rendered("dst").alias("dst"), r6("p", "p"))


for _k in (1, 2):
    query(f"hon_edges_k{_k}", _hon_sql(_k))(_hon(_k))
    query(f"transition_k{_k}", _transition_sql(_k))(_transition(_k))

_FIRST = "first AS (SELECT g[1] AS src, g[2] AS dst, sub + lon AS w FROM stats WHERE k = 1), t1 AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM first)"


@query("hon_null_k2", f"WITH {_S}, {_ST}, {_FIRST} SELECT concat(a.src, ',', a.dst) AS src, concat(b.src, ',', b.dst) AS dst, round(a.w * b.p, 6) AS w_long FROM first a JOIN t1 b ON a.dst = b.src")
def hon_null_k2(spark, sf):
    return HigherOrderNetwork(I.sessions(spark, sf), 2, null_model=True).edges().select(rendered("src").alias("src"), rendered("dst").alias("dst"), r6("w_long", "w_long"))


_WALKS = "ed AS (SELECT DISTINCT src, dst FROM first), w1 AS (SELECT dst AS v, count(*) AS n FROM ed GROUP BY 1), w2 AS (SELECT ed.dst AS v, sum(n) AS n FROM w1 JOIN ed ON v = src GROUP BY 1), w3 AS (SELECT ed.dst AS v, sum(n) AS n FROM w2 JOIN ed ON v = src GROUP BY 1), go AS (SELECT DISTINCT src FROM ed)"


@query("dof_paths_by_order", f"""WITH {_S}, {_ST}, {_FIRST}, {_WALKS}
SELECT 0 AS k, CAST((SELECT count(*) FROM stats WHERE k = 0) - 1 AS BIGINT) AS dof
UNION ALL SELECT 1, CAST((SELECT sum(n) FROM w1) - (SELECT count(*) FROM go) AS BIGINT)
UNION ALL SELECT 2, CAST((SELECT sum(n) FROM w2) - (SELECT sum(n) FROM w1 WHERE v IN (SELECT src FROM go)) AS BIGINT)
UNION ALL SELECT 3, CAST((SELECT sum(n) FROM w3) - (SELECT sum(n) FROM w2 WHERE v IN (SELECT src FROM go)) AS BIGINT)""")
def dof_paths_by_order(spark, sf):
    p = I.sessions(spark, sf).kept()
    return spark.createDataFrame([(k, HigherOrderNetwork(p, k).degrees_of_freedom()) for k in range(4)], "k int, dof bigint")


_TRANS = "trans AS (SELECT k, g, (sub + lon) / sum(sub + lon) OVER (PARTITION BY k, g[1:k]) AS p FROM stats)"


def _layer_sql(layer: int, low: int = 0) -> str:
    return f"(SELECT len(path) - 1 AS length, sum(freq * ln(p)) AS ll FROM (SELECT path, freq, path[greatest(j - {layer}, 1):j] AS g FROM longest, LATERAL (SELECT unnest(generate_series(1, len(path))) AS j) AS y WHERE len(path) > {low}) AS x JOIN trans USING (g) GROUP BY 1)"


@query("log_likelihood_by_order", f"WITH {_S}, {_ST}, {_TRANS} " + " UNION ALL ".join(f"SELECT {x} AS layer, CAST(length AS INTEGER) AS length, round(ll, 4) AS ll FROM {_layer_sql(x)}" for x in range(3)))
def log_likelihood_by_order(spark, sf):
    return MultiOrderModel(I.sessions(spark, sf), 2).likelihood_terms().select("layer", F.col("length").cast("int").alias("length"), F.round("ll", 4).alias("ll"))


_IC = f"""WITH {_S}, {_ST}, {_FIRST}, {_WALKS}, {_TRANS},
l0 AS (SELECT sum(ll) AS l, (SELECT sum(freq) FROM longest WHERE len(path) > 1) AS n FROM {_layer_sql(0, 1)}), l1 AS (SELECT sum(ll) AS l FROM {_layer_sql(1, 1)}),
d AS (SELECT (SELECT count(*) FROM stats WHERE k = 0) - 1 AS d0, (SELECT sum(n) FROM w1) - (SELECT count(*) FROM go) AS dd),
x AS (SELECT l0.l AS l0, l1.l AS l1, n, CAST(d0 AS DOUBLE) AS d0, CAST(d0 + dd AS DOUBLE) AS d1 FROM l0, l1, d)
SELECT 'AIC' AS method, round(2 * d0 - 2 * l0, 4) AS ic0, round(2 * d1 - 2 * l1, 4) AS ic1 FROM x
UNION ALL SELECT 'BIC', round(ln(n) * d0 - 2 * l0, 4), round(ln(n) * d1 - 2 * l1, 4) FROM x
UNION ALL SELECT 'AICc', round(2 * d0 - 2 * l0 + 2 * (d0 + 1) * (d0 + 2) / (n - d0 - 2), 4), round(2 * d1 - 2 * l1 + 2 * (d1 + 1) * (d1 + 2) / (n - d1 - 2), 4) FROM x"""


@query("aic_bic_network_hypothesis", _IC)
def aic_bic_network_hypothesis(spark, sf):
    m = MultiOrderModel(I.sessions(spark, sf), 1)
    rows = [(name, *map(float, m.test_network_hypothesis(method=name)[1:])) for name in ("AIC", "BIC", "AICc")]
    return spark.createDataFrame(rows, "method string, ic0 double, ic1 double").select("method", F.round("ic0", 4).alias("ic0"), F.round("ic1", 4).alias("ic1"))


@query("likelihood_ratio_order", None)
def likelihood_ratio_order(spark, sf):
    m = MultiOrderModel(I.sessions(spark, sf), 2)
    reject, p = m.likelihood_ratio_test(null=1, order=2)
    return spark.createDataFrame([(2 if reject else 1, float(p))], "selected_order int, p double").select("selected_order", r6("p", "p"))


_ENDS = "ends AS (SELECT g[1] AS src, g[-1] AS dst, g, k FROM stats)"


@query("observed_distance", f"WITH {_S}, {_ST}, {_ENDS} SELECT src, dst, CAST(min(k) AS BIGINT) AS dist FROM ends WHERE src <> dst GROUP BY 1, 2 UNION ALL SELECT g[1], g[1], 0 FROM stats WHERE k = 0")
def observed_distance(spark, sf):
    return I.sessions(spark, sf).distances().select("src", "dst", big("dist"))


_SHORT = f"WITH {_S}, {_ST}, {_ENDS}, sp AS (SELECT src, dst, g, k FROM ends QUALIFY rank() OVER (PARTITION BY src, dst ORDER BY k) = 1)"


@query("observed_shortest_paths", f"{_SHORT} SELECT src, dst, array_to_string(g, ',') AS path FROM sp")
def observed_shortest_paths(spark, sf):
    return I.sessions(spark, sf).shortest_paths().select("src", "dst", rendered("path").alias("path"))


@query("betweenness_paths", f"{_SHORT}, m AS (SELECT *, count(*) OVER (PARTITION BY src, dst) AS m FROM sp), inn AS (SELECT dst, m, unnest(g[2:len(g) - 1]) AS node FROM m WHERE src <> dst AND k > 1), b AS (SELECT node, sum(1.0 / m) AS v FROM inn WHERE node <> dst GROUP BY 1) SELECT g[1] AS node, round(coalesce(v, 0.0), 6) AS value FROM stats LEFT JOIN b ON node = g[1] WHERE k = 0")
def betweenness_paths(spark, sf):
    return I.sessions(spark, sf).betweenness().select("node", r6("value", "value"))


@query("closeness_paths", f"WITH {_S}, {_ST}, {_ENDS}, d AS (SELECT src, dst, min(k) AS k FROM ends WHERE src <> dst GROUP BY 1, 2), c AS (SELECT dst AS node, sum(1.0 / k) AS v FROM d GROUP BY 1) SELECT g[1] AS node, round(coalesce(v, 0.0), 6) AS value FROM stats LEFT JOIN c ON node = g[1] WHERE stats.k = 0")
def closeness_paths(spark, sf):
    return I.sessions(spark, sf).closeness().select("node", r6("value", "value"))


_TWO = "two AS (SELECT g[2] AS node, g[1] AS s, g[3] AS d, sub + lon AS n FROM stats WHERE k = 2)"
_BP = f"WITH {_S}, {_ST}, {_TWO}, q AS (SELECT node, s, d, n / sum(n) OVER (PARTITION BY node) AS p, sum(n) OVER (PARTITION BY node, s) / sum(n) OVER (PARTITION BY node) AS ps, sum(n) OVER (PARTITION BY node, d) / sum(n) OVER (PARTITION BY node) AS pd FROM two)"


@query("betweenness_preference", f"{_BP} SELECT node, round(sum(p * log2(p / (ps * pd))), 6) AS value FROM q GROUP BY node")
def betweenness_preference(spark, sf):
    from strideway.operators.entropy import betweenness_preferences

    return betweenness_preferences(I.sessions(spark, sf)).select("node", r6("value", "value"))


_MODULES = {"click": "a", "view": "a", "purchase": "b", "error": "b", "signup": "b"}
_MODULE_SQL = "CASE WHEN {} IN ('click', 'view') THEN 'a' ELSE 'b' END"


@query("map_equation_paths", f"""WITH {_S}, st AS (SELECT freq, path[i] AS x, {_MODULE_SQL.format('path[i]')} AS m, {_MODULE_SQL.format('path[i - 1]')} AS b FROM longest, LATERAL (SELECT unnest(generate_series(2, len(path))) AS i) AS y),
tot AS (SELECT sum(freq) AS t FROM st),
ex AS (SELECT m, sum(f) / (SELECT t FROM tot) AS q FROM (SELECT b AS m, freq AS f FROM st WHERE m <> b UNION ALL SELECT {_MODULE_SQL.format('path[-1]')}, freq FROM longest) GROUP BY m),
nd AS (SELECT m, x, sum(freq) / (SELECT t FROM tot) AS p FROM st GROUP BY 1, 2), a AS (SELECT m, sum(p) AS a FROM nd GROUP BY m),
per AS (SELECT ex.m, q, a, q / (q + a) * ln(q / (q + a)) + (SELECT sum(p / (q + a) * log2(p / (q + a))) FROM nd WHERE nd.m = ex.m) AS h FROM ex JOIN a USING (m))
SELECT round(-((SELECT sum(q) FROM ex) * (SELECT sum(q * log2(q)) FROM ex) + sum((q + a) * h)), 6) AS value FROM per""")
def map_equation_paths(spark, sf):
    from strideway.operators.entropy import map_equation_of_paths

    p = I.sessions(spark, sf)
    modules = p.nodes().withColumn("module", F.when(F.col("node").isin("click", "view"), "a").otherwise("b"))
    return map_equation_of_paths(p, modules).select(r6("value", "value"))


@query("memory_net", f"WITH {_S}, {_ST}, {_TWO}, m AS (SELECT node, s, sum(n) AS w FROM two GROUP BY 1, 2) SELECT concat('src_', s) AS src, concat('mem_', s, '_', node) AS dst, CAST(w AS BIGINT) AS w FROM m UNION ALL SELECT concat('mem_', s, '_', node), concat('tgt_', d, '@', node), CAST(n AS BIGINT) FROM two")
def memory_net(spark, sf):
    from strideway.operators.entropy import memory_flows

    return memory_flows(I.sessions(spark, sf)).select("src", "dst", big("w"))


def _roles(spark, sf):
    return I.table(spark, sf, "conversations", F.col("conv_id"), F.col("turn").alias("pos"), F.col("role").alias("s"))


_MC = "WITH c AS (SELECT lag(role) OVER w AS a, role AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), n AS (SELECT a, s, count(*) AS cnt FROM c WHERE a IS NOT NULL GROUP BY 1, 2), p AS (SELECT a, s, cnt, cnt / sum(cnt) OVER (PARTITION BY a) AS p FROM n)"


@query("markov_sequence_transitions", f"{_MC} SELECT a AS ctx, s, CAST(cnt AS BIGINT) AS cnt, round(p, 6) AS p FROM p")
def markov_sequence_transitions(spark, sf):
    return MarkovSequence(_roles(spark, sf), "conv_id").transitions(1).select(rendered("ctx").alias("ctx"), "s", "cnt", r6("p", "p"))


@query("markov_log_likelihood", f"{_MC} SELECT round(sum(cnt * ln(p)), 4) AS ll FROM p")
def markov_log_likelihood(spark, sf):
    return spark.createDataFrame([(float(MarkovSequence(_roles(spark, sf), "conv_id").log_likelihood(1)),)], "ll double").select(F.round("ll", 4).alias("ll"))


_MC2 = "c2 AS (SELECT lag(role, 2) OVER w AS a0, lag(role) OVER w AS a1, role AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), n2 AS (SELECT a0, a1, s, count(*) AS cnt FROM c2 WHERE a0 IS NOT NULL GROUP BY 1, 2, 3), p2 AS (SELECT cnt, cnt / sum(cnt) OVER (PARTITION BY a0, a1) AS p FROM n2)"


@query("markov_bic", f"{_MC}, {_MC2}, z AS (SELECT CAST(count(DISTINCT role) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM conversations) SELECT round(ln(n - 1) * (k - k * k) * (k - 1) - 2 * ((SELECT sum(cnt * ln(p)) FROM p) - (SELECT sum(cnt * ln(p)) FROM p2)), 4) AS bic FROM z")
def markov_bic(spark, sf):
    return spark.createDataFrame([(float(MarkovSequence(_roles(spark, sf), "conv_id").bic(1, 2)),)], "bic double").select(F.round("bic", 4).alias("bic"))


@query("path_summary", f"""WITH {_S}, x AS (SELECT sum(freq) AS o, CAST(count(*) AS DOUBLE) AS u, CAST(min(len(path) - 1) AS DOUBLE) AS lo, CAST(max(len(path) - 1) AS DOUBLE) AS hi, round(sum(freq * (len(path) - 1)) / sum(freq), 6) AS m FROM longest),
n AS (SELECT CAST(count(DISTINCT v) AS DOUBLE) AS n FROM (SELECT unnest(path) AS v FROM longest))
SELECT 'observations' AS metric, o AS value FROM x UNION ALL SELECT 'unique', u FROM x UNION ALL SELECT 'min_length', lo FROM x UNION ALL SELECT 'max_length', hi FROM x UNION ALL SELECT 'mean_length', m FROM x UNION ALL SELECT 'nodes', n FROM n""")
def path_summary(spark, sf):
    return I.sessions(spark, sf).summary().select("metric", r6("value", "value"))


@query("pagerank_order2", None)
def pagerank_order2(spark, sf):
    from strideway.operators.spectral import pagerank_of

    return pagerank_of(HigherOrderNetwork(I.sessions(spark, sf), 2)).select("node", r6("value", "value"))


@query("slow_down_factor", None)
def slow_down_factor(spark, sf):
    from strideway.operators.spectral import slow_down_factor as factor

    return spark.createDataFrame([(float(factor(I.sessions(spark, sf))),)], "value double").select(r6("value", "value"))
