"""Time-stamped edges (src, dst, t[, seq]): filters, time differences, windows, unfolding, interval and as-of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from strideway.operators.graph import Graph
from strideway.operators.iterate import numbered


#: Ranges of time, a bound on the tables that are ordered as a whole.
BUCKETS = 4096


class TemporalEdges:
    """edges: (src string, dst string, t long, seq long); a multiset. seq is the input order, which breaks ties of t."""

    def __init__(self, edges: DataFrame, directed: bool = True) -> None:
        e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("t").cast("long").alias("t"), (F.col("seq") if "seq" in edges.columns else F.lit(0)).cast("long").alias("seq"))
        if not directed:
            e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "t", "seq"))
        self.edges = e

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple], directed: bool = True) -> TemporalEdges:
        return cls(spark.createDataFrame([(str(a), str(b), int(t), k) for k, (a, b, t) in enumerate(rows)], "src string, dst string, t long, seq long"), directed)

    def add_edges(self, other: DataFrame, directed: bool = True) -> TemporalEdges:
        return TemporalEdges(self.edges.unionByName(TemporalEdges(other, directed).edges))

    def filter_edges(self, condition: Column | Callable[[str, str, int], bool]) -> TemporalEdges:
        """A Column over src, dst and t, or a function of them (row by row in Python)."""
        if not isinstance(condition, Column):
            test = condition
            condition = F.udf(lambda a, b, t: bool(test(a, b, t)), BooleanType())("src", "dst", "t")
        return TemporalEdges(self.edges.filter(condition))

    def filter_nodes(self, nodes: list[str]) -> TemporalEdges:
        return TemporalEdges(self.edges.filter(F.col("src").isin(nodes) & F.col("dst").isin(nodes)))

    def summary(self) -> DataFrame:
        e = self.edges
        row = e.agg(F.count("*").alias("edges"), (F.max("t") - F.min("t")).alias("length"), F.count_distinct("t").alias("times")).crossJoin(e.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.count_distinct("v").alias("nodes")))
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("x")).select("x.*")

    def inter_event_times(self) -> DataFrame:
        """(t, gap) between consecutive distinct times. Times are cut into at most BUCKETS ranges; each one's first time meets the last one of
        the ranges before, which only the small table of ranges has to be ordered for."""
        times = self.edges.select("t").distinct()
        lo, hi = times.agg(F.min("t"), F.max("t")).first()
        if lo is None:
            return times.withColumn("gap", F.col("t")).limit(0)
        width = (hi - lo) // BUCKETS + 1
        rows = times.withColumn("b", F.expr(f"(t - {lo}) div {width}"))
        last = rows.groupBy("b").agg(F.max("t").alias("last"))
        before = last.select("b", F.lag("last").over(Window.orderBy("b")).alias("before"))
        rows = rows.withColumn("prev", F.lag("t").over(Window.partitionBy("b").orderBy("t"))).join(F.broadcast(before), "b")
        return rows.select("t", (F.col("t") - F.coalesce("prev", "before")).alias("gap")).filter("gap IS NOT NULL")

    def inter_path_times(self) -> DataFrame:
        """(node, src, t, gap): for each edge into a node the time until the next edge out of it."""
        rows = self.edges.select(F.col("dst").alias("node"), "src", "t", F.lit(None).cast("long").alias("leave"))
        rows = rows.unionByName(self.edges.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("src"), "t", F.col("t").alias("leave")))
        w = Window.partitionBy("node").orderBy("t").rangeBetween(1, Window.unboundedFollowing)
        nxt = rows.withColumn("next", F.min("leave").over(w)).filter("leave IS NULL AND next IS NOT NULL")
        return nxt.select("node", "src", "t", (F.col("next") - F.col("t")).alias("gap"))

    def reverse_time(self) -> TemporalEdges:
        top = self.edges.agg(F.max("t").alias("top"))
        return TemporalEdges(self.edges.crossJoin(F.broadcast(top)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("top") - F.col("t") + 1).alias("t"), "seq"))

    def aggregate(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """(src, dst, w): counts of edges with low <= t < high."""
        e = self.edges
        if low is not None:
            e = e.filter(F.col("t") >= low)
        if high is not None:
            e = e.filter(F.col("t") < high)
        return e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))

    def network(self, low: int | None = None, high: int | None = None, directed: bool = True) -> Graph:
        e = self.aggregate(low, high)
        if not directed:
            e = e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
        return Graph(e, directed)

    def rolling_windows(self, size: int, step: int = 1, empty: bool = True) -> DataFrame:
        """(start, src, dst, w) of each window [start, start + size), from the first time on while its end is at most the last time.

        Each edge names the windows that it is in, so there is no range join. Empty windows have a row without an edge.
        """
        span = self.edges.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        e = self.edges.crossJoin(F.broadcast(span))
        last = F.expr(f"least((t - lo) div {step}, (hi - lo - {size}) div {step})")
        first = F.greatest(F.expr(f"(t - lo - {size} + {step}) div {step}"), F.lit(0))
        # div truncates towards zero, so a negative numerator also gives window 0
        e = e.filter(F.col("hi") - F.col("lo") >= size).withColumns({"a": first, "b": last}).filter("a <= b")
        got = e.select("lo", "src", "dst", F.explode(F.sequence("a", "b")).alias("i")).groupBy((F.col("lo") + F.col("i") * step).alias("start"), "src", "dst").agg(F.count("*").cast("double").alias("w"))
        if not empty:
            return got
        spine = span.filter(F.col("hi") - F.col("lo") >= size).select("lo", F.explode(F.expr(f"sequence(0L, (hi - lo - {size}) div {step})")).alias("i")).select((F.col("lo") + F.col("i") * step).alias("start"))
        return spine.join(got, "start", "left")

    def two_paths(self, delta: int) -> DataFrame:
        """(src, mid, dst, t1, t2): edges u-v then v-w with 0 < t2 - t1 <= delta. The equi key holds the node and the time
        bucket of delta, so a node with many edges is spread over its buckets."""
        a = self.edges.select("src", F.col("dst").alias("mid"), F.col("t").alias("t1")).withColumn("bucket", F.explode(F.array(F.floor(F.col("t1") / delta), F.floor(F.col("t1") / delta) + 1)))
        b = self.edges.select(F.col("src").alias("mid"), "dst", F.col("t").alias("t2")).withColumn("bucket", F.floor(F.col("t2") / delta))
        return a.join(b, ["mid", "bucket"]).filter(f"t2 > t1 AND t2 - t1 <= {delta}").select("src", "mid", "dst", "t1", "t2")

    def unfolded(self, delta: int = 1) -> DataFrame:
        """(v, tv, w, tw): edges of the time-unfolded graph, v at t to w at t + 1 .. t + delta."""
        return self.edges.select(F.col("src").alias("v"), F.col("t").alias("tv"), F.col("dst").alias("w"), F.explode(F.sequence(F.col("t") + 1, F.col("t") + delta)).alias("tw")).distinct()

    def shuffle_times(self, seed: int = 0, window_splits: list[int] | None = None) -> TemporalEdges:
        """Times permuted over the edges, within each window between splits."""
        part = F.lit(0)
        for s in window_splits or []:
            part = part + (F.col("t") >= s).cast("int")
        e = self.edges.withColumn("__w", part)
        key = lambda salt: [F.xxhash64(F.lit(seed), F.lit(salt), "src", "dst", "t", "seq"), *map(F.col, ("src", "dst", "t", "seq"))]
        times = numbered(e, key("t"), "__n", "__w").select("__w", F.col("t").alias("new"), "__n")
        return TemporalEdges(numbered(e, key("e"), "__n", "__w").join(times, ["__w", "__n"]).select("src", "dst", F.col("new").alias("t"), "seq"))
