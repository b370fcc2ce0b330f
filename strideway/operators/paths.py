"""Path sets: a table of longest paths with frequencies, and what follows from it.

Only ``longest`` (path, freq) is kept. Sub-path statistics are an explode and one map-side-combined aggregation, made for just the lengths that a
consumer asks for. Lengths count edges: a single node has length 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.functions import grams
from strideway.functions.times import micros
from strideway.operators.iterate import cut

SCHEMA = "path array<string>, freq double"


class PathsTooShort(ValueError):
    """No path is as long as the order asks."""


class PathSet:
    """longest: DataFrame (path array<string>, freq double), one row a distinct path. cap bounds the sub-paths' length."""

    def __init__(self, longest: DataFrame, separator: str = ",", cap: int | None = None) -> None:
        self.longest, self.separator, self.cap = longest.select("path", F.col("freq").cast("double").alias("freq")), separator, cap
        self._kept = False

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[tuple], separator: str = ",", cap: int | None = None) -> PathSet:
        """From (path, frequency) pairs; a path is a sequence or a separated string. Equal paths add up."""
        data = []
        for path, freq in rows:
            nodes = path.split(separator) if isinstance(path, str) else [str(x) for x in path]
            if any(separator in x for x in nodes):
                raise ValueError(f"a node name contains the separator {separator!r}")
            data.append((nodes, float(freq)))
        return cls.collect_equal(spark.createDataFrame(data, SCHEMA), separator, cap)

    @classmethod
    def collect_equal(cls, rows: DataFrame, separator: str = ",", cap: int | None = None) -> PathSet:
        return cls(rows.groupBy("path").agg(F.sum("freq").alias("freq")), separator, cap)

    @classmethod
    def from_ordered(cls, rows: DataFrame, group: list[str], order: list[str], node: str, separator: str = ",", cap: int | None = None) -> PathSet:
        """One path for each group of rows, its nodes in the given order."""
        key = F.struct(*order, F.col(node).cast("string").alias("__node"))
        path = F.transform(F.sort_array(F.collect_list(key)), lambda x: x["__node"])
        return cls.collect_equal(rows.groupBy(*group).agg(path.alias("path")).select("path", F.lit(1.0).alias("freq")), separator, cap)

    @classmethod
    def from_sessions(cls, events: DataFrame, key: str, ts: str, tie: str, node: str, gap_seconds: float, separator: str = ",", cap: int | None = None) -> PathSet:
        """One path for each session: a run of a key's events without a gap of more than gap_seconds."""
        w = Window.partitionBy(key).orderBy(ts, tie)
        at = micros(ts)
        new = F.coalesce((at - F.lag(at).over(w) > int(gap_seconds * 1_000_000)).cast("int"), F.lit(1))
        rows = events.withColumn("__new", new).withColumn("__session", F.sum("__new").over(w))
        return cls.from_ordered(rows, [key, "__session"], [ts, tie], node, separator, cap)

    def kept(self) -> PathSet:
        """The same paths, made once and checkpointed, for consumers that read them more than once."""
        if self._kept:
            return self
        out = PathSet(cut(self.longest), self.separator, self.cap)
        out._kept = True
        return out

    # --- statistics ---------------------------------------------------------------------------------

    def stats(self, min_len: int = 0, max_len: int | None = None) -> DataFrame:
        """(path, k, sub, longest) of every gram of min_len..max_len edges."""
        low = F.size("path") - 1
        whole = self.longest.filter(low >= min_len if max_len is None else low.between(min_len, max_len))
        top = max_len if self.cap is None else self.cap if max_len is None else min(max_len, self.cap)
        subs = self.longest.select(F.explode(grams.subpaths("path", min_len, top)).alias("path"), F.col("freq").alias("sub"), F.lit(0.0).alias("longest"))
        rows = subs.unionByName(whole.select("path", F.lit(0.0).alias("sub"), F.col("freq").alias("longest")))
        return rows.groupBy("path").agg(F.sum("sub").alias("sub"), F.sum("longest").alias("longest")).withColumn("k", F.size("path") - 1)

    def path_lengths(self) -> DataFrame:
        """(k, sub, longest) by length."""
        # a path of n nodes holds n - k grams of k edges, so none of them is listed
        n = F.size("path")
        top = n - 2 if self.cap is None else F.least(n - 2, F.lit(self.cap))
        ks = F.when(top >= 0, F.sequence(F.lit(0), top)).otherwise(F.array().cast("array<int>"))
        subs = self.longest.select("freq", n.alias("n"), F.explode(ks).alias("k")).select("k", (F.col("freq") * (F.col("n") - F.col("k"))).alias("sub"), F.lit(0.0).alias("longest"))
        whole = self.longest.select((n - 1).alias("k"), F.lit(0.0).alias("sub"), F.col("freq").alias("longest"))
        return subs.unionByName(whole.filter("k >= 0")).groupBy("k").agg(F.sum("sub").alias("sub"), F.sum("longest").alias("longest"))

    def unique_paths(self, length: int = 0, longer: bool = True) -> DataFrame:
        k = F.size("path") - 1
        return self.longest.filter(F.col("freq") > 0).filter(k >= length if longer else k == length).agg(F.count("*").alias("n"))

    def observation_count(self) -> DataFrame:
        return self.longest.agg(F.coalesce(F.sum("freq"), F.lit(0.0)).alias("n"))

    def nodes(self) -> DataFrame:
        return self.longest.select(F.explode("path").alias("node")).distinct()

    def max_length(self) -> int:
        return self.longest.agg(F.max(F.size("path") - 1)).first()[0] or 0

    def node_traversals(self) -> DataFrame:
        """(node, n): how often paths visit a node."""
        return self.longest.select(F.explode("path").alias("node"), "freq").groupBy("node").agg(F.sum("freq").alias("n"))

    def visitation_probabilities(self) -> DataFrame:
        t = self.node_traversals()
        return t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("total")))).select("node", (F.col("n") / F.col("total")).alias("p"))

    def origin_destination(self) -> DataFrame:
        """(origin, destination, n) over longest paths."""
        return self.longest.groupBy(F.element_at("path", 1).alias("origin"), F.element_at("path", -1).alias("destination")).agg(F.sum("freq").alias("n"))

    def edges(self) -> DataFrame:
        """(src, dst, w) of the first-order network: traversals of each edge."""
        s = self.stats(1, 1)
        # get() and not element_at(): the optimizer may evaluate it on rows that a filter drops
        return s.select(F.get("path", F.lit(0)).alias("src"), F.get("path", F.lit(1)).alias("dst"), (F.col("sub") + F.col("longest")).alias("w"))

    def summary(self) -> DataFrame:
        """(metric, value)."""
        k = F.size("path") - 1
        row = self.longest.agg(
            F.coalesce(F.sum("freq"), F.lit(0.0)).alias("observations"),
            F.count("*").cast("double").alias("unique"),
            F.min(k).cast("double").alias("min_length"),
            F.max(k).cast("double").alias("max_length"),
            (F.sum(F.col("freq") * k) / F.sum("freq")).alias("mean_length"),
        ).crossJoin(self.nodes().agg(F.count("*").cast("double").alias("nodes")))
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns])).alias("x")).select("x.*")

    # --- algebra ------------------------------------------------------------------------------------

    def _like(self, rows: DataFrame) -> PathSet:
        return PathSet.collect_equal(rows, self.separator, self.cap)

    def add_paths(self, rows: Iterable[tuple]) -> PathSet:
        """With more (path, frequency) pairs."""
        return self + PathSet.of(self.longest.sparkSession, rows, self.separator)

    def __add__(self, other: PathSet) -> PathSet:
        return self._like(self.longest.unionByName(other.longest))

    def __mul__(self, factor: float) -> PathSet:
        return PathSet(self.longest.withColumn("freq", F.col("freq") * F.lit(float(factor))), self.separator, self.cap)

    __rmul__ = __mul__

    def filter_nodes(self, allowed: list[str], min_length: int = 0, max_length: int | None = None, split_paths: bool = True) -> PathSet:
        """Maximal runs of allowed nodes as paths; without split_paths only those of paths with a single run."""
        rows = self.longest.withColumn("runs", grams.runs("path", allowed))
        if not split_paths:
            rows = rows.filter(F.size("runs") == 1)
        rows = rows.select(F.explode("runs").alias("path"), "freq")
        k = F.size("path") - 1
        return self._like(rows.filter(k >= min_length if max_length is None else k.between(min_length, max_length)))

    def project(self, mapping: dict[str, str]) -> PathSet:
        return self._like(self.longest.select(grams.mapped("path", mapping).alias("path"), "freq"))

    def remove_repeats(self) -> PathSet:
        return self._like(self.longest.select(grams.remove_repeats("path").alias("path"), "freq"))

    def sequence(self, stop: str = "|") -> DataFrame:
        """(pos, s): all longest paths, each int(freq) times, concatenated, with the stop symbol after each."""
        one = self.longest.select(F.explode(F.array_repeat(F.concat("path", F.array(F.lit(stop))), F.col("freq").cast("int"))).alias("path"))
        # paths are ordered by a digest, whose first digits are buckets: offsets come from a table of at most 4096 sums
        numbered = one.select("path", F.size("path").cast("long").alias("n"), F.md5(F.concat_ws(self.separator, "path")).alias("key")).withColumn("b", F.substring("key", 1, 3))
        sums = numbered.groupBy("b").agg(F.sum("n").alias("n"))
        offsets = sums.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
        within = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = numbered.withColumn("w", within).join(F.broadcast(offsets), "b").select((F.col("o") + F.col("w")).alias("start"), F.posexplode("path").alias("i", "s"))
        return starts.select((F.col("start") + F.col("i")).alias("pos"), "s")

    # --- distances ----------------------------------------------------------------------------------

    def _ends(self) -> DataFrame:
        s = self.stats()
        return s.select(F.element_at("path", 1).alias("src"), F.element_at("path", -1).alias("dst"), "path", "k")

    def distances(self) -> DataFrame:
        """(src, dst, dist): the fewest edges of an observed path; 0 from a node to itself."""
        e = self._ends().filter("src <> dst").groupBy("src", "dst").agg(F.min("k").alias("dist"))
        return e.unionByName(self.nodes().select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("dist")))

    def shortest_paths(self) -> DataFrame:
        """(src, dst, path): all observed paths of least length between two nodes."""
        w = Window.partitionBy("src", "dst").orderBy("k")
        return self._ends().withColumn("r", F.rank().over(w)).filter("r = 1").select("src", "dst", "path", "k")

    def betweenness(self, normalized: bool = False) -> DataFrame:
        """(node, value): over pairs, the share of shortest observed paths through a node."""
        w = Window.partitionBy("src", "dst")
        inner = self.shortest_paths().withColumn("m", F.count("*").over(w)).filter("src <> dst AND k > 1")
        inner = inner.select("dst", "m", F.explode(F.slice("path", 2, F.size("path") - 2)).alias("node")).filter("node <> dst")
        return filled(inner.groupBy("node").agg(F.sum(1.0 / F.col("m")).alias("value")), self.nodes(), normalized)

    def closeness(self, normalized: bool = False) -> DataFrame:
        """(node, value): sum of 1 / distance from the other nodes."""
        d = self.distances().filter("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.sum(1.0 / F.col("dist")).alias("value"))
        return filled(d, self.nodes(), normalized)


def filled(values: DataFrame, nodes: DataFrame, normalized: bool = False) -> DataFrame:
    """(node, value) with 0 for nodes without a value; normalised by the largest value."""
    out = nodes.select("node").join(values, "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value"))
    if normalized:
        top = out.agg(F.max("value").alias("top"))
        out = out.crossJoin(F.broadcast(top)).select("node", F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(0.0).alias("value"))
    return out


def ranked(values: DataFrame) -> DataFrame:
    return values.orderBy(F.desc("value"), "node")


def rendered(path: Column | str, separator: str = ",") -> Column:
    return F.array_join(grams.col(path), separator)
