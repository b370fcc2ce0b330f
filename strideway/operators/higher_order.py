"""Networks of order k: nodes are k-grams of observed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.operators.iterate import cut
from strideway.operators.paths import PathSet, PathsTooShort

START = "start"


def walks(edges: DataFrame, k: int) -> DataFrame:
    """(path): all walks of k edges over distinct edges (src, dst)."""
    e = edges.select("src", "dst").distinct()
    out = e.select(F.array("src", "dst").alias("path"))
    if k == 0:
        return e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().select(F.array("v").alias("path"))
    for _ in range(k - 1):
        out = out.withColumn("src", F.element_at("path", -1)).join(e, "src").select(F.concat("path", F.array("dst")).alias("path"))
    return out


def count_walks(edges: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(v, n): walks of k edges by their last node; walks are counted, never listed."""
    e = edges.select("src", "dst").distinct()
    now = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("n", F.lit(1).cast("double"))
    for _ in range(k):
        now = now.join(e, F.col("v") == F.col("src")).groupBy(F.col("dst").alias("v")).agg(F.sum("n").alias("n"))
    return now


class HigherOrderNetwork:
    """edges: (src, dst, w_sub, w_long), ends being arrays of k names; possible: also the k-grams that the first-order network allows."""

    def __init__(self, paths: PathSet, k: int = 1, null_model: bool = False, possible: bool = True) -> None:
        self.paths, self.k, self.null_model, self.possible = paths, k, null_model, possible
        if k > 1 and paths.max_length() < k:
            raise PathsTooShort(f"no path has {k} edges")

    def edges(self) -> DataFrame:
        k, paths = self.k, self.paths
        if self.null_model and k > 1:
            return self._null_edges()
        s = paths.stats(k, k) if k else paths.stats(0, 0)
        if k == 0:
            return s.select(F.array(F.lit(START)).alias("src"), F.col("path").alias("dst"), F.col("sub").alias("w_sub"), F.col("longest").alias("w_long"))
        return s.select(F.slice("path", 1, k).alias("src"), F.slice("path", 2, k).alias("dst"), F.col("sub").alias("w_sub"), F.col("longest").alias("w_long"))

    def _null_edges(self) -> DataFrame:
        """What first-order transitions make of the observed (k-1)-edge prefixes."""
        k, paths = self.k, self.paths
        first = paths.edges()
        t = first.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p")
        prefix = paths.stats(k - 1, k - 1).select("path", (F.col("sub") + F.col("longest")).alias("c")).filter("c > 0")
        # a prefix that was never observed has weight 0; such edges exist in the topology only
        every = walks(first, k - 1).join(prefix, "path", "left").withColumn("last", F.element_at("path", -1))
        grown = every.join(t, F.col("last") == F.col("src")).select("path", F.col("dst").alias("v"), (F.coalesce("c", F.lit(0.0)) * F.col("p")).alias("w_long"))
        return grown.select("path", F.concat(F.slice("path", 2, k - 1), F.array("v")).alias("dst"), F.lit(0.0).alias("w_sub"), "w_long").withColumnRenamed("path", "src")

    def nodes(self) -> DataFrame:
        e = self.edges()
        out = e.select(F.explode(F.array("src", "dst")).alias("node"))
        if self.k <= 1:
            out = out.unionByName(self.paths.nodes().select(F.array("node").alias("node")))
        elif self.possible:
            out = out.unionByName(walks(self.paths.edges(), self.k - 1).select(F.col("path").alias("node")))
        return out.distinct()

    def weights(self, include_subpaths: bool = True) -> DataFrame:
        w = F.col("w_sub") + F.col("w_long") if include_subpaths else F.col("w_long")
        return self.edges().select("src", "dst", w.alias("w")).filter("w > 0")

    def model_size(self) -> int:
        return self.weights().count()

    def transitions(self, include_subpaths: bool = True) -> DataFrame:
        """(src, dst, p)."""
        return self.weights(include_subpaths).withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p")

    def adjacency(self, include_subpaths: bool = True, weighted: bool = False) -> DataFrame:
        return self.weights(include_subpaths).select("src", "dst", (F.col("w") if weighted else F.lit(1.0)).alias("v"))

    def laplacian(self, include_subpaths: bool = True) -> DataFrame:
        """(src, dst, v) of I - T."""
        one = self.nodes().select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("v"))
        return one.unionByName(self.transitions(include_subpaths).select("src", "dst", (-F.col("p")).alias("v"))).groupBy("src", "dst").agg(F.sum("v").alias("v"))

    def summary(self) -> DataFrame:
        """(metric, value)."""
        e = self.edges().agg(F.count("*").cast("double").alias("edges"), F.coalesce(F.sum("w_sub"), F.lit(0.0)).alias("weight_sub"), F.coalesce(F.sum("w_long"), F.lit(0.0)).alias("weight_long"))
        row = e.crossJoin(self.nodes().agg(F.count("*").cast("double").alias("nodes")))
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns])).alias("x")).select("x.*")

    def degrees_of_freedom(self, assumption: str = "paths") -> int:
        """Free parameters: of all n-grams, or of the walks that the first-order network allows."""
        if self.k == 0:
            return self.paths.nodes().count() - 1
        if assumption == "ngrams":
            s = self.paths.nodes().count()
            return s**self.k * (s - 1)
        first = cut(self.paths.edges().select("src", "dst").distinct())
        # a walk of k - 1 edges that ends where d > 0 edges start is a context of d walks of k edges, d - 1 of them free
        go = first.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
        free = count_walks(first, self.k - 1).join(go, "v").agg(F.coalesce(F.sum(F.col("n") * (F.col("d") - 1)), F.lit(0.0)))
        return int(free.first()[0])

    def log_likelihood(self, paths: PathSet | None = None) -> float:
        """Of the order-k steps of all paths of k edges or more; steps before the k-th node say nothing."""
        rows = (paths or self.paths).longest.filter(F.size("path") > self.k)
        from strideway.functions.grams import kgrams

        k = self.k
        steps = rows.select("freq", F.explode(kgrams("path", k + 1)).alias("g")).groupBy("g").agg(F.sum("freq").alias("f"))
        steps = steps.select(F.slice("g", 1, k).alias("src"), F.slice("g", 2, k).alias("dst"), "f")
        return steps.join(self.transitions(), ["src", "dst"]).agg(F.coalesce(F.sum(F.col("f") * F.log("p")), F.lit(0.0))).first()[0]

    def distances(self) -> DataFrame:
        """(src, dst, dist) between first-order nodes along k-order paths."""
        from strideway.operators.traversal import bfs

        k, sep = self.k, "\x01"
        flat = self.weights().select(F.array_join("src", sep).alias("src"), F.array_join("dst", sep).alias("dst"))
        d = bfs(flat).select(F.element_at(F.split("src", sep), 1).alias("src"), F.element_at(F.split("dst", sep), -1).alias("dst"), (F.col("dist") + (k - 1)).alias("dist"))
        own = self.nodes().select(F.element_at("node", 1).alias("src"), F.element_at("node", -1).alias("dst"), F.lit(k - 1).cast("long").alias("dist"))
        both = d.unionByName(own).filter("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        return both.unionByName(self.paths.nodes().select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("dist")))

    def closeness(self, normalized: bool = False) -> DataFrame:
        from strideway.operators.paths import filled

        d = self.distances().filter("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.sum(1.0 / F.col("dist")).alias("value"))
        return filled(d, self.paths.nodes(), normalized)

    def betweenness(self, normalized: bool = False) -> DataFrame:
        """k-order shortest paths read as first-order paths, the shortest of each pair counted once; ways from a node back to itself count too."""
        from strideway.functions.grams import first_order_path
        from strideway.operators.paths import filled
        from strideway.operators.traversal import all_shortest_paths

        sep = "\x01"
        flat = self.weights().select(F.array_join("src", sep).alias("src"), F.array_join("dst", sep).alias("dst"))
        p = all_shortest_paths(flat).select(first_order_path(F.transform("path", lambda x: F.split(x, sep))).alias("path"))
        p = p.unionByName(self.nodes().select(F.col("node").alias("path"))).distinct()
        p = p.select(F.element_at("path", 1).alias("s"), F.element_at("path", -1).alias("d"), "path", F.size("path").alias("n"))
        p = p.withColumn("r", F.rank().over(Window.partitionBy("s", "d").orderBy("n"))).filter("r = 1").withColumn("m", F.count("*").over(Window.partitionBy("s", "d")))
        inner = p.filter("n > 2").select("s", "d", "m", F.explode(F.slice("path", 2, F.col("n") - 2)).alias("node")).filter("node <> s AND node <> d")
        return filled(inner.groupBy("node").agg(F.sum(1.0 / F.col("m")).alias("value")), self.paths.nodes(), normalized)
