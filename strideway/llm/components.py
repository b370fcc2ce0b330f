"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a map-side-combined minimum by node and a join; the edges are written to the shared folder after each round, and rounds end
when the edges are stars, which a further round would leave as they are. No component, link list or node set reaches one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import written


def _minima(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    out = arcs.join(_minima(arcs), "u").filter("v > u")
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    minima = arcs.groupBy("u").agg(F.min("v").alias("m"))
    out = arcs.join(minima, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.unionByName(minima.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """No node of the distinct edges (a, b) is an a twice, or both an a and a b."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("up")), F.struct(F.col("b").alias("u"), F.lit(0).alias("up")))).alias("e"))
    return ends.groupBy("e.u").agg(F.sum("e.up").alias("up"), F.count("*").alias("n")).filter("up > 0 AND n > 1").isEmpty()


def stars(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b): every node with an edge in edges (a, b) but the least of its component, and that least node."""
    now = edges.filter("a <> b").select("a", "b").distinct()
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "components")
        if _are_stars(now):
            return now
    raise RuntimeError(f"not converged after {max_rounds} rounds")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge in edges (a, b); the component is its least node."""
    now = stars(edges, max_rounds)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
