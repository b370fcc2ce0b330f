"""Networks: node and edge tables with attributes, degrees, statistics, matrices and community measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from strideway.operators.paths import PathSet
from strideway.operators.traversal import both_ways

ATTRS = "map<string,string>"


class Graph:
    """edges: (src, dst, w, attrs); vertices: (node, attrs). An undirected edge is stored once, its lesser end first; a repeated edge's last row holds."""

    def __init__(self, edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None, order: str | None = None) -> None:
        self.directed = directed
        cols = set(edges.columns)
        e = edges.select(
            F.col("src").cast("string").alias("src"),
            F.col("dst").cast("string").alias("dst"),
            (F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in cols else F.lit(1.0)).alias("w"),
            (F.col("attrs") if "attrs" in cols else F.create_map().cast(ATTRS)).alias("attrs"),
            (F.col(order) if order else F.lit(0)).alias("__o"),
        )
        if not directed:
            e = e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        if order:
            e = e.groupBy("src", "dst").agg(F.max_by(F.struct("w", "attrs"), "__o").alias("x")).select("src", "dst", "x.w", "x.attrs")
        else:
            e = e.groupBy("src", "dst").agg(F.first("w").alias("w"), F.first("attrs").alias("attrs"))
        self.edges = e
        own = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        if vertices is None:
            self.vertices = own.withColumn("attrs", F.create_map().cast(ATTRS))
        else:
            given = vertices.select(F.col("node").cast("string").alias("node"), (F.col("attrs") if "attrs" in vertices.columns else F.create_map().cast(ATTRS)).alias("attrs")).dropDuplicates(["node"])
            self.vertices = given.unionByName(own.join(given, "node", "left_anti").withColumn("attrs", F.create_map().cast(ATTRS)))

    @classmethod
    def of(cls, spark: SparkSession, edges: list[tuple], directed: bool = False) -> Graph:
        rows = [(str(e[0]), str(e[1]), float(e[2]) if len(e) > 2 else 1.0, k) for k, e in enumerate(edges)]
        return cls(spark.createDataFrame(rows, "src string, dst string, w double, o int"), directed, order="o")

    @classmethod
    def from_paths(cls, paths: PathSet) -> Graph:
        return cls(paths.edges(), True, paths.nodes())

    # --- changes ------------------------------------------------------------------------------------

    def _with(self, edges: DataFrame | None = None, vertices: DataFrame | None = None, directed: bool | None = None) -> Graph:
        return Graph(self.edges if edges is None else edges, self.directed if directed is None else directed, self.vertices if vertices is None else vertices)

    def add_edges(self, edges: DataFrame) -> Graph:
        """Edges put in or put over."""
        both = self.edges.withColumn("o", F.lit(0)).unionByName(Graph(edges, self.directed).edges.withColumn("o", F.lit(1)))
        return Graph(both, self.directed, self.vertices, "o")

    def add_nodes(self, vertices: DataFrame) -> Graph:
        return self._with(vertices=self.vertices.unionByName(Graph(self.edges.limit(0), True, vertices).vertices.join(self.vertices, "node", "left_anti")))

    def add_clique(self, nodes: list[str]) -> Graph:
        spark = self.edges.sparkSession
        pairs = [(a, b) for a in nodes for b in nodes if (a != b if self.directed else a < b)]
        return self.add_edges(spark.createDataFrame(pairs, "src string, dst string"))

    def remove_nodes(self, nodes: list[str]) -> Graph:
        return self._with(self.edges.filter(~F.col("src").isin(nodes) & ~F.col("dst").isin(nodes)), self.vertices.filter(~F.col("node").isin(nodes)))

    def remove_edge(self, src: str, dst: str) -> Graph:
        a, b = (src, dst) if self.directed else sorted((src, dst))
        return self._with(self.edges.filter(~((F.col("src") == a) & (F.col("dst") == b))))

    def __add__(self, other: Graph) -> Graph:
        """Union; the other's edges hold where both have one."""
        both = self.edges.withColumn("o", F.lit(0)).unionByName(other.edges.withColumn("o", F.lit(1)))
        return Graph(both, self.directed or other.directed, self.vertices, "o")

    def to_unweighted(self) -> Graph:
        return self._with(self.edges.select("src", "dst"))

    def to_undirected(self) -> Graph:
        return self._with(directed=False)

    def find_nodes(self, condition: Column | Callable[[dict], bool]) -> DataFrame:
        return self.vertices.filter(_condition(condition, "attrs")).select("node")

    def find_edges(self, nodes: Column | Callable | None = None, edges: Column | Callable | None = None) -> DataFrame:
        """Edges whose ends both meet the node condition and that meet the edge condition."""
        e = self.edges if edges is None else self.edges.filter(_condition(edges, "attrs"))
        if nodes is not None:
            v = self.find_nodes(nodes)
            e = e.join(v.withColumnRenamed("node", "src"), "src", "left_semi").join(v.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return e.select("src", "dst", "w", "attrs")

    def node_properties(self, name: str) -> DataFrame:
        return self.vertices.select("node", F.try_element_at("attrs", F.lit(name)).alias(name))

    # --- degrees and statistics ---------------------------------------------------------------------

    def arcs(self) -> DataFrame:
        """(src, dst, w) in each direction that can be walked."""
        e = self.edges.select("src", "dst", "w")
        return e if self.directed else both_ways(e)

    def degrees(self, mode: str = "degree") -> DataFrame:
        """(node, value): degree, indegree, outdegree, weight, inweight or outweight."""
        value = F.sum("w") if "weight" in mode else F.count("*").cast("double")
        e = self.edges
        if mode.startswith("in"):
            got = e.groupBy(F.col("dst").alias("node")).agg(value.alias("value"))
        elif mode.startswith("out"):
            got = e.groupBy(F.col("src").alias("node")).agg(value.alias("value"))
        elif self.directed:
            got = e.select(F.explode(F.array("src", "dst")).alias("node"), "w").groupBy("node").agg(value.alias("value"))
        else:
            got = self.arcs().groupBy(F.col("src").alias("node")).agg(value.alias("value"))
        return self.vertices.select("node").join(got, "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value"))

    def summary(self) -> DataFrame:
        """(metric, value)."""
        d = self.degrees().agg(F.count("*").alias("nodes"), F.avg("value").alias("mean_degree"), F.max("value").alias("max_degree"))
        e = self.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total_weight"))
        row = d.crossJoin(e)
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("x")).select("x.*")

    def degree_distribution(self, mode: str = "degree") -> DataFrame:
        """(degree, p)."""
        d = self.degrees(mode)
        return d.groupBy(F.col("value").alias("degree")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).select("degree", (F.col("n") / F.col("all")).alias("p"))

    def degree_moment(self, k: int, mode: str = "degree") -> DataFrame:
        return self.degrees(mode).agg(F.avg(F.pow("value", F.lit(float(k)))).alias("value"))

    def mean_degree(self, mode: str = "degree") -> DataFrame:
        return self.degree_moment(1, mode)

    def generating_function(self, x: float, mode: str = "degree") -> DataFrame:
        return self.degree_distribution(mode).agg(F.sum(F.col("p") * F.pow(F.lit(float(x)), "degree")).alias("value"))

    def molloy_reed_fraction(self, mode: str = "degree") -> DataFrame:
        return self.degrees(mode).agg((F.avg(F.col("value") * F.col("value")) / F.avg("value")).alias("value"))

    def clustering(self) -> DataFrame:
        """(node, value): the linked share of ordered pairs of successors; 0 under degree two."""
        a = self.arcs().select("src", "dst")
        d = self.degrees("outdegree" if self.directed else "degree")
        x, y, e = a.alias("x"), a.alias("y"), a.alias("e")
        closed = x.join(y, F.col("x.src") == F.col("y.src")).join(e, (F.col("e.src") == F.col("x.dst")) & (F.col("e.dst") == F.col("y.dst")))
        k = closed.groupBy(F.col("x.src").alias("node")).agg(F.count("*").alias("k"))
        return d.join(k, "node", "left").select("node", F.when(F.col("value") < 2, 0.0).otherwise(F.coalesce("k", F.lit(0)) / (F.col("value") * (F.col("value") - 1))).alias("value"))

    def average_clustering(self) -> DataFrame:
        return self.clustering().agg(F.avg("value").alias("value"))

    # --- matrices, as (src, dst, v) -----------------------------------------------------------------

    def adjacency(self, weighted: bool = False) -> DataFrame:
        return self.arcs().select("src", "dst", (F.col("w") if weighted else F.lit(1.0)).alias("v"))

    def transitions(self) -> DataFrame:
        """(src, dst, p): the share of the source's weight; zero weights are left out."""
        return self.arcs().filter("w <> 0").withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p")

    def laplacian(self, weighted: bool = False) -> DataFrame:
        """D - A of an undirected network, or with `weighted` I - T."""
        if weighted:
            own = self.vertices.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("v"))
            off = self.transitions().select("src", "dst", (-F.col("p")).alias("v"))
        else:
            own = self.degrees().select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("value").alias("v"))
            off = self.adjacency().select("src", "dst", (-F.col("v")).alias("v"))
        return own.unionByName(off).groupBy("src", "dst").agg(F.sum("v").alias("v"))

    # --- communities --------------------------------------------------------------------------------

    def modularity(self, modules: DataFrame) -> DataFrame:
        """(value): sum over modules of (links inside / 2m - (degrees / 2m)^2); modules: (node, module). No pairs of nodes are made."""
        a = self.arcs().select("src", "dst")
        ms, md = modules.select(F.col("node").alias("src"), F.col("module").alias("ms")), modules.select(F.col("node").alias("dst"), F.col("module").alias("md"))
        inside = a.join(ms, "src").join(md, "dst").filter("ms = md").groupBy(F.col("ms").alias("module")).agg(F.count("*").cast("double").alias("inside"))
        degree = self.degrees().join(modules, "node").groupBy("module").agg(F.sum("value").alias("degree"))
        both = degree.join(inside, "module", "left").crossJoin(F.broadcast(self.edges.agg((2.0 * F.count("*")).alias("m2"))))
        return both.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), F.lit(2.0))).alias("value"))

    def assortativity(self, modules: DataFrame) -> DataFrame:
        """(value): modularity over its largest possible value for these modules."""
        degree = self.degrees().join(modules, "node").groupBy("module").agg(F.sum("value").alias("degree"))
        top = degree.crossJoin(F.broadcast(self.edges.agg((2.0 * F.count("*")).alias("m2")))).agg((1 - F.sum(F.pow(F.col("degree") / F.col("m2"), F.lit(2.0)))).alias("top"))
        return self.modularity(modules).crossJoin(top).select((F.col("value") / F.col("top")).alias("value"))

    def map_equation(self, modules: DataFrame) -> DataFrame:
        """(value): description length of random walks under a partition of an undirected, unweighted network."""
        ms, md = modules.select(F.col("node").alias("src"), F.col("module").alias("ms")), modules.select(F.col("node").alias("dst"), F.col("module").alias("md"))
        e = self.edges.select("src", "dst").join(ms, "src").join(md, "dst").withColumn("out", (F.col("ms") != F.col("md")).cast("double"))
        ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("ms").alias("module")), F.struct(F.col("dst").alias("node"), F.col("md").alias("module")))).alias("x"), "out").select("x.*", "out")
        total = e.agg(F.count("*").cast("double").alias("total"), F.sum("out").alias("across"))
        per_module = ends.groupBy("module").agg(F.count("*").cast("double").alias("count"), F.sum("out").alias("exits"), (F.sum(1 - F.col("out")) / 2).alias("within"))
        per_node = ends.groupBy("module", "node").agg(F.count("*").cast("double").alias("c"))
        x = F.col("c") / (2 * F.col("within") + F.col("exits"))
        h = per_node.join(per_module, "module").groupBy("module").agg(F.sum(x * F.log2(x)).alias("h"))
        m = per_module.join(h, "module").crossJoin(F.broadcast(total))
        y = F.col("count") / (2 * F.col("total"))
        share = (F.col("within") + F.col("exits")) / (F.col("total") + F.col("across"))
        return m.agg((-F.sum(F.col("across") / F.col("total") * y * F.log2(y)) - F.sum(share * F.col("h"))).alias("value"))


def _condition(condition: Column | Callable, column: str) -> Column:
    """A Column as it is; a function of the attributes as a row-wise UDF."""
    return condition if isinstance(condition, Column) else F.udf(lambda a: bool(condition(a)), BooleanType())(F.col(column))
