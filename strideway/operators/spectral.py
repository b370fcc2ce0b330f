"""Spectral measures. Matrices come from (src, dst, v) tables; up to MOST nodes are solved densely on the driver, larger ones take power iteration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.operators.graph import Graph
from strideway.operators.higher_order import HigherOrderNetwork, count_walks
from strideway.operators.iterate import cut
from strideway.operators.paths import PathSet, filled

MOST = 3000


class TooLarge(ValueError):
    """A dense solution was asked for of a matrix that is too large for the driver."""


def dense(entries: DataFrame, nodes: DataFrame | None = None, most: int = MOST) -> tuple[np.ndarray, list]:
    """(matrix with m[target, source], names in order); entries: (src, dst, v). Sizes are checked before anything is collected."""
    names = (entries.select(F.explode(F.array("src", "dst")).alias("node")).distinct() if nodes is None else nodes.select("node").distinct()).limit(most + 1).collect()
    if len(names) > most:
        raise TooLarge(f"over {most} nodes")
    key = lambda x: tuple(x) if isinstance(x, list) else x
    order = sorted(key(r["node"]) for r in names)
    at = {n: i for i, n in enumerate(order)}
    m = np.zeros((len(order), len(order)))
    for r in entries.select("src", "dst", "v").collect():
        m[at[key(r["dst"])], at[key(r["src"])]] += r["v"]
    return m, order


def leading_vector(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(m)
    v = np.real(vectors[:, np.argmax(np.abs(values))])
    return v / v.sum()


def eigenvector_centrality(edges: DataFrame, max_iter: int = 200, tol: float = 1e-9) -> DataFrame:
    """(node, value) summing to 1: power iteration on shifted adjacency, as joins and sums."""
    e = cut(edges.select("src", "dst").distinct())
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    now = cut(nodes.withColumn("value", F.lit(1.0 / max(n, 1))))
    for _ in range(max_iter):
        got = now.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("value").alias("got"))
        # the shift keeps bipartite networks from swinging; it leaves the vectors as they are
        new = now.join(got, "node", "left").select("node", F.col("value").alias("old"), (F.col("value") + F.coalesce("got", F.lit(0.0))).alias("value"))
        total = new.agg(F.sum("value")).first()[0] or 1.0
        new = cut(new.withColumn("value", F.col("value") / F.lit(total)))
        change = new.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
        now = new.select("node", "value")
        if change < tol:
            break
    return now


def projected(values: DataFrame, how: str = "all") -> DataFrame:
    """(node, value) of first-order nodes from values of k-grams: all or scaled (each k-gram's value shared by its nodes), last, or first."""
    size = F.size("node")
    if how in ("last", "first"):
        one = values.select(F.element_at("node", -1 if how == "last" else 1).alias("v"), "value")
    elif how in ("all", "scaled"):
        one = values.select(F.explode("node").alias("v"), (F.col("value") / size).alias("value"))
    else:
        raise ValueError("how is all, scaled, last or first")
    out = one.groupBy("v").agg(F.sum("value").alias("value"))
    return out.crossJoin(F.broadcast(out.agg(F.sum("value").alias("t")))).select(F.col("v").alias("node"), (F.col("value") / F.col("t")).alias("value"))


def eigenvector_of(network: HigherOrderNetwork, how: str = "scaled", include_subpaths: bool = True) -> DataFrame:
    """(node, value) of first-order nodes: eigenvector centrality over k-grams, then projected."""
    sep = "\x01"
    w = network.weights(include_subpaths).select(F.array_join("src", sep).alias("src"), F.array_join("dst", sep).alias("dst"))
    values = eigenvector_centrality(w).select(F.split("node", sep).alias("node"), "value")
    out = projected(values, how) if network.k > 1 else values.select(F.element_at("node", 1).alias("node"), "value")
    return filled(out, network.paths.nodes())


def pagerank_of(network: HigherOrderNetwork, how: str = "scaled", include_subpaths: bool = True, weighted: bool = False, alpha: float = 0.85) -> DataFrame:
    """(node, value) of first-order nodes: PageRank over k-grams, isolated ones included, then projected."""
    sep = "\x01"
    w = network.weights(include_subpaths).select(F.array_join("src", sep).alias("src"), F.array_join("dst", sep).alias("dst"), "w")
    nodes = cut(network.nodes().select(F.array_join("node", sep).alias("node")))
    n = nodes.count()
    e = w if weighted else w.withColumn("w", F.lit(1.0))
    e = cut(e.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p"))
    now = cut(nodes.withColumn("value", F.lit(1.0 / n)))
    sources = e.select(F.col("src").alias("node")).distinct()
    for _ in range(100):
        lost = now.join(sources, "node", "left_anti").agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
        got = now.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("value") * F.col("p")).alias("got"))
        new = cut(now.join(got, "node", "left").select("node", F.col("value").alias("old"), (F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)).alias("value")))
        change = new.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0]
        now = new.select("node", "value")
        if change < n * 1e-6:
            break
    values = now.select(F.split("node", sep).alias("node"), "value")
    out = projected(values, how) if network.k > 1 else values.select(F.element_at("node", 1).alias("node"), "value")
    return filled(out, network.paths.nodes())


def _transition_entries(network: HigherOrderNetwork, include_subpaths: bool = True) -> DataFrame:
    return network.transitions(include_subpaths).select("src", "dst", F.col("p").alias("v"))


def eigenvalue_gap(network: HigherOrderNetwork) -> float:
    """The modulus of the second largest eigenvalue of the transition matrix."""
    m, _ = dense(_transition_entries(network), network.nodes())
    values = np.sort(np.abs(np.linalg.eigvals(m)))[::-1]
    return float(values[1]) if len(values) > 1 else 0.0


def fiedler_vector(network: HigherOrderNetwork | Graph) -> tuple[list, np.ndarray]:
    """(names, vector) of the second smallest eigenvalue of the Laplacian."""
    nodes = network.nodes() if isinstance(network, HigherOrderNetwork) else network.vertices
    m, names = dense(network.laplacian(), nodes)
    values, vectors = np.linalg.eig(m)
    return names, np.real(vectors[:, np.argsort(np.abs(values))[1]])


def algebraic_connectivity(network: HigherOrderNetwork | Graph) -> float:
    nodes = network.nodes() if isinstance(network, HigherOrderNetwork) else network.vertices
    m, _ = dense(network.laplacian(), nodes)
    return float(np.sort(np.abs(np.linalg.eigvals(m)))[1])


def slow_down_factor(paths: PathSet, k: int = 2) -> float:
    """How much slower diffusion is along the paths than in a Markov model of their edges."""
    real = eigenvalue_gap(HigherOrderNetwork(paths, k))
    null = eigenvalue_gap(HigherOrderNetwork(paths, k, null_model=True))
    return math.log(null) / math.log(real)


def entropy_growth_rate_ratio(paths: PathSet, method: str = "MLE", k: int = 2) -> float:
    """Entropy rate of order k over that of order 1."""
    if method not in ("MLE", "Miller"):
        raise ValueError("method is MLE or Miller")

    def rate(order: int) -> float:
        m, _ = dense(_transition_entries(HigherOrderNetwork(paths, order)), HigherOrderNetwork(paths, order).nodes())
        pi = leading_vector(m)
        with np.errstate(divide="ignore", invalid="ignore"):
            h = np.where(m > 0, m * np.log2(m), 0.0)
        return float(-(h @ pi).sum())

    high = rate(k)
    if method == "Miller":
        possible = count_walks(paths.edges(), k).agg(F.sum("n")).first()[0]
        seen = paths.stats(k, k).agg(F.sum(F.col("sub") + F.col("longest"))).first()[0]
        high += (possible - 1) / (2 * seen)
    return abs(high) / abs(rate(1))
