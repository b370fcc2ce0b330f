"""Distances, shortest paths, PageRank and components by iterative joins over edge tables (src, dst[, w])."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.operators.iterate import cut, frontier


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.select("src", "dst", *rest).unionByName(back).dropDuplicates(["src", "dst"])


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def bfs(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(src, dst, dist) of all reachable pairs, by a frontier of newly reached pairs."""
    e = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).filter("at <> to").distinct())
    start = nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("dist"))

    def step(now: DataFrame, seen: DataFrame) -> DataFrame:
        new = now.join(e, F.col("dst") == F.col("at")).select("src", F.col("to").alias("dst"), (F.col("dist") + 1).alias("dist")).distinct()
        return new.join(seen.select("src", "dst"), ["src", "dst"], "left_anti")

    return frontier(start, step, limit)


def weighted_distances(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(src, dst, dist) by relaxation until nothing gets shorter; weights must not be negative."""
    e = cut(edges.groupBy(F.col("src").alias("at"), F.col("dst").alias("to")).agg(F.min(weight).alias("w")))
    now = cut(nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("dist")))
    mark = None
    while True:
        grown = now.join(e, F.col("dst") == F.col("at")).select("src", F.col("to").alias("dst"), (F.col("dist") + F.col("w")).alias("dist"))
        now = cut(now.unionByName(grown).groupBy("src", "dst").agg(F.min("dist").alias("dist")))
        found = tuple(now.agg(F.count("*"), F.sum("dist")).first())
        if found == mark:
            return now
        mark = found


def all_shortest_paths(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(src, dst, path): every path of least length between each two nodes; one node is a path to itself."""
    e = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).filter("at <> to").distinct())
    start = nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.array("node").alias("path"))

    def step(now: DataFrame, seen: DataFrame) -> DataFrame:
        new = now.join(e, F.col("dst") == F.col("at")).select("src", F.col("to").alias("dst"), F.concat("path", F.array("to")).alias("path"))
        return new.join(seen.select("src", "dst").distinct(), ["src", "dst"], "left_anti")

    return frontier(start, step, limit)


def betweenness(edges: DataFrame, normalized: bool = False) -> DataFrame:
    """(node, value): for each ordered pair the share of shortest paths through a node."""
    from strideway.operators.paths import filled

    e = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).filter("at <> to").distinct())
    start = nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("dist"), F.lit(1.0).alias("ways"))

    def step(now: DataFrame, seen: DataFrame) -> DataFrame:
        new = now.join(e, F.col("dst") == F.col("at")).groupBy("src", F.col("to").alias("dst"), (F.col("dist") + 1).alias("dist")).agg(F.sum("ways").alias("ways"))
        return new.join(seen.select("src", "dst"), ["src", "dst"], "left_anti")

    # shortest paths are counted forwards, and the shares of the pairs behind a node are added up backwards, level by level: no path is listed
    pairs = cut(frontier(start, step))
    top = pairs.agg(F.max("dist")).first()[0] or 0
    below, parts = None, []
    for level in range(top, 0, -1):
        here = pairs.filter(F.col("dist") == level)
        if below is None:
            here = here.withColumn("share", F.lit(0.0))
        else:
            arcs = here.select("src", F.col("dst").alias("v"), F.col("ways").alias("mine")).join(e, F.col("v") == F.col("at"))
            got = arcs.join(below.select("src", F.col("dst").alias("to"), "ways", "share"), ["src", "to"]).groupBy("src", F.col("v").alias("dst")).agg(F.sum(F.col("mine") / F.col("ways") * (1 + F.col("share"))).alias("share"))
            here = here.join(got, ["src", "dst"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        below = cut(here.select("src", "dst", "ways", "share"))
        parts.append(below.select(F.col("dst").alias("node"), "share"))
    if not parts:
        return filled(nodes_of(edges).select("node", F.lit(0.0).alias("value")), nodes_of(edges), normalized)
    return filled(reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("share").alias("value")), nodes_of(edges), normalized)


def closeness(edges: DataFrame, normalized: bool = False) -> DataFrame:
    """(node, value): (n - 1) / sum of the distances to the node, over nodes that reach it."""
    from strideway.operators.paths import filled

    nodes = nodes_of(edges)
    n = nodes.agg(F.count("*").alias("n"))
    d = bfs(edges).filter("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.sum("dist").alias("total"))
    return filled(d.crossJoin(F.broadcast(n)).select("node", ((F.col("n") - 1) / F.col("total")).alias("value")), nodes, normalized)


def diameter(edges: DataFrame) -> DataFrame:
    """(value): the longest distance, infinite if a pair isn't connected."""
    n = nodes_of(edges).agg(F.count("*").alias("n"))
    d = bfs(edges).agg(F.count("*").alias("pairs"), F.max("dist").alias("longest"))
    return d.crossJoin(n).select(F.when(F.col("pairs") < F.col("n") * F.col("n"), F.lit(float("inf"))).otherwise(F.col("longest").cast("double")).alias("value"))


def average_path_length(edges: DataFrame) -> DataFrame:
    """(value): the mean over all pairs, a node with itself included; infinite if a pair isn't connected."""
    n = nodes_of(edges).agg(F.count("*").alias("n"))
    d = bfs(edges).agg(F.count("*").alias("pairs"), F.sum("dist").alias("total"))
    whole = F.col("n") * F.col("n")
    return d.crossJoin(n).select(F.when(F.col("pairs") < whole, F.lit(float("inf"))).otherwise(F.col("total") / whole).alias("value"))


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, weighted: bool = False) -> tuple[DataFrame, bool]:
    """((node, value), converged). Dangling mass is spread evenly; it ends when the L1 change is under n x tol."""
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w")) if weighted else edges.select("src", "dst").distinct().withColumn("w", F.lit(1.0))
    e = cut(e.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p"))
    nodes = cut(nodes_of(edges))
    n = nodes.count()
    sinks = cut(nodes.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
    now = cut(nodes.withColumn("value", F.lit(1.0 / max(n, 1))))
    for _ in range(max_iter):
        lost = now.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
        got = now.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("value") * F.col("p")).alias("got"))
        new = cut(now.join(got, "node", "left").select("node", F.col("value").alias("old"), (F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)).alias("value")))
        change = new.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
        now = new.select("node", "value")
        if change < n * tol:
            return now, True
    return now, False


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component), the component being its least node: least labels pass along edges, and labels of labels shorten long chains."""
    e = cut(both_ways(edges.select("src", "dst")).select(F.col("src").alias("at"), F.col("dst").alias("node")))
    now = cut(nodes_of(edges).withColumn("component", F.col("node")))
    mark = None
    while True:
        near = now.withColumnRenamed("node", "at").join(e, "at").select("node", "component")
        low = now.unionByName(near).groupBy("node").agg(F.min("component").alias("c"))
        jump = now.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        now = cut(low.join(jump, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component")))
        found = tuple(now.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first())
        if found == mark:
            return now
        mark = found


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component), the component being its least node: least labels pass forwards; nodes that their label reaches backwards within
    the label are that label's component and leave, and the rest goes again."""
    left = cut(edges.select("src", "dst").distinct())
    todo = cut(nodes_of(edges))
    done: DataFrame | None = None
    while not todo.isEmpty():
        label = cut(todo.withColumn("label", F.col("node")))
        mark = None
        while True:
            pushed = label.join(left, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label")
            label = cut(label.unionByName(pushed).groupBy("node").agg(F.min("label").alias("label")))
            found = tuple(label.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first())
            if found == mark:
                break
            mark = found
        a, b = label.alias("a"), label.alias("b")
        same = cut(left.join(a, F.col("src") == F.col("a.node")).join(b, F.col("dst") == F.col("b.node")).filter("a.label = b.label").select("src", "dst"))
        start = label.filter("node = label")

        def back(now: DataFrame, seen: DataFrame, same: DataFrame = same) -> DataFrame:
            new = now.join(same, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "label").distinct()
            return new.join(seen.select("node"), "node", "left_anti")

        found_now = frontier(start, back).select("node", F.col("label").alias("component"))
        done = cut(found_now if done is None else done.unionByName(found_now))
        todo = cut(todo.join(done.select("node"), "node", "left_anti"))
        left = cut(left.join(todo.select(F.col("node").alias("src")), "src", "left_semi").join(todo.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return done if done is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)


def giant_component(edges: DataFrame) -> DataFrame:
    """The edges inside the largest strong component; of equal ones that with the least node."""
    c = strong_components(edges)
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = c.join(F.broadcast(best), "component", "left_semi").select("node")
    e = edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi")
    return e.join(inside.select(F.col("node").alias("dst")), "dst", "left_semi")
