"""Information measures of path sets: betweenness preference, map equation, flows through memory nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.operators.paths import PathSet


def preference_counts(paths: PathSet) -> DataFrame:
    """(node, s, d, n): paths of two edges by middle, predecessor and successor."""
    two = paths.stats(2, 2)
    return two.select(F.get("path", F.lit(1)).alias("node"), F.get("path", F.lit(0)).alias("s"), F.get("path", F.lit(2)).alias("d"), (F.col("sub") + F.col("longest")).alias("n")).filter("n > 0")


def betweenness_preferences(paths: PathSet, normalized: bool = False, method: str = "MLE") -> DataFrame:
    """(node, value) of all nodes at once: mutual information in bits of predecessor and successor, plain or with Miller's correction."""
    c = preference_counts(paths)
    by = lambda *x: Window.partitionBy("node", *x)
    n = F.sum("n").over(by())
    q = c.select("node", "s", "d", "n", (F.col("n") / n).alias("p"), (F.sum("n").over(by("s")) / n).alias("ps"), (F.sum("n").over(by("d")) / n).alias("pd"), n.alias("total"))
    hs = q.select("node", "s", "ps").distinct().groupBy("node").agg((-F.sum(F.col("ps") * F.log2("ps"))).alias("hs"))
    hd = q.select("node", "d", "pd").distinct().groupBy("node").agg((-F.sum(F.col("pd") * F.log2("pd"))).alias("hd"))
    own = q.groupBy("node").agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("ps") * F.col("pd")))).alias("mi"), F.first("total").alias("total"), F.sum(F.lit(1)).alias("cells"))
    out = own.join(hs, "node").join(hd, "node")
    if method == "Miller":
        e = paths.edges()
        ks = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ks"))
        kd = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("kd"))
        seen = q.groupBy("node").agg(F.count_distinct("s").alias("ss"))
        # H(D) - H(D|S), each entropy raised by (cells - 1) / (2 samples); of the conditional ones the shares and samples cancel
        out = out.join(ks, "node").join(kd, "node").join(seen, "node")
        half = 2 * F.col("total")
        value = F.col("mi") + (F.col("kd") - 1) / half - F.col("ss") * (F.col("kd") - 1) / half
        hs_, hd_ = F.col("hs") + (F.col("ks") - 1) / half, F.col("hd") + (F.col("kd") - 1) / half
    elif method == "MLE":
        value, hs_, hd_ = F.col("mi"), F.col("hs"), F.col("hd")
    else:
        raise ValueError("method is MLE or Miller")
    return out.select("node", (value / F.least(hs_, hd_) if normalized else value).alias("value"))


def betweenness_preference(paths: PathSet, node: str, normalized: bool = False, method: str = "MLE") -> float | None:
    """Of one node: 0 without a path through it, None if it has no edge in or none out."""
    e = paths.edges()
    ends = e.agg(F.max((F.col("dst") == node).cast("int")), F.max((F.col("src") == node).cast("int"))).first()
    if not ends[0] or not ends[1]:
        return None
    row = betweenness_preferences(paths, normalized, method).filter(F.col("node") == node).first()
    return row["value"] if row else 0.0


def map_equation_of_paths(paths: PathSet, modules: DataFrame) -> DataFrame:
    """(value): description length of paths under a partition (node, module); a path's end exits its module. The exit term of a module's
    code uses natural logarithms, the others binary ones."""
    rows = paths.longest.withColumn("id", F.xxhash64("path")).select("id", "freq", F.posexplode("path").alias("i", "node")).join(modules, "node")
    w = Window.partitionBy("id", "freq").orderBy("i")
    st = rows.withColumns({"before": F.lag("module").over(w), "after": F.lead("i").over(w)})
    steps = st.filter("before IS NOT NULL")
    exits = steps.filter("before <> module").select(F.col("before").alias("module"), "freq").unionByName(st.filter("after IS NULL").select("module", "freq")).groupBy("module").agg(F.sum("freq").alias("e"))
    total = steps.agg(F.sum("freq").alias("t"))
    node = steps.groupBy("module", "node").agg(F.sum("freq").alias("n"))
    inside = node.groupBy("module").agg(F.sum("n").alias("a"))
    m = exits.join(inside, "module").crossJoin(F.broadcast(total)).select("module", (F.col("e") / F.col("t")).alias("q"), (F.col("a") / F.col("t")).alias("a"), "t")
    x = F.col("n") / F.col("t") / (F.col("q") + F.col("a"))
    c = node.join(m, "module").groupBy("module").agg(F.sum(x * F.log2(x)).alias("c"))
    b = F.col("q") / (F.col("q") + F.col("a"))
    out = m.join(c, "module")
    return out.agg((-(F.sum("q") * F.sum(F.col("q") * F.log2("q")) + F.sum((F.col("q") + F.col("a")) * (b * F.log(b) + F.col("c"))))).alias("value"))


def memory_flows(paths: PathSet) -> DataFrame:
    """(src, dst, w) around every node: src_u to mem_u_v by all that goes on, mem_u_v to tgt_w@v by the two-edge paths."""
    c = preference_counts(paths)
    mem = F.concat(F.lit("mem_"), "s", F.lit("_"), "node")
    into = c.groupBy("node", "s").agg(F.sum("n").alias("w")).select(F.concat(F.lit("src_"), "s").alias("src"), mem.alias("dst"), "w")
    return into.unionByName(c.select(mem.alias("src"), F.concat(F.lit("tgt_"), "d", F.lit("@"), "node").alias("dst"), F.col("n").alias("w")))


def memory_net(paths: PathSet, node: str, self_loops: bool = True) -> DataFrame:
    """(src, dst, w) around one node."""
    c = preference_counts(paths).filter(F.col("node") == node)
    c = c if self_loops else c.filter((F.col("s") != node) & (F.col("d") != node))
    mem = F.concat(F.lit("mem_"), "s", F.lit(f"_{node}"))
    into = c.groupBy("s").agg(F.sum("n").alias("w")).select(F.concat(F.lit("src_"), "s").alias("src"), mem.alias("dst"), "w")
    return into.unionByName(c.select(mem.alias("src"), F.concat(F.lit("tgt_"), "d").alias("dst"), F.col("n").alias("w")))


def memory_net_markov(edges: DataFrame, node: str, self_loops: bool = True) -> DataFrame:
    """(src, dst, w) around a node if flows leave it as their weights say, wherever they came from."""
    into = edges.filter(F.col("dst") == node).select(F.col("src").alias("s"), F.col("w").alias("wi"))
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("d"), (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("share"))
    if not self_loops:
        into, out = into.filter(F.col("s") != node), out.filter(F.col("d") != node)
    mem = F.concat(F.lit("mem_"), "s", F.lit(f"_{node}"))
    # a node's neighbours on both sides: at most its degree squared, for one node
    flows = into.crossJoin(out).select(mem.alias("src"), F.concat(F.lit("tgt_"), "d").alias("dst"), (F.col("wi") * F.col("share")).alias("w"))
    return into.select(F.concat(F.lit("src_"), "s").alias("src"), mem.alias("dst"), F.col("wi").alias("w")).unionByName(flows)


def diffusion(transitions: DataFrame, node: str, steps: int) -> DataFrame:
    """(step, node, p): where a walk from a node is after each of `steps` steps of transitions (src, dst, p)."""
    spark = transitions.sparkSession
    now = spark.createDataFrame([(node, 1.0)], "node string, p double")
    out = now.withColumn("step", F.lit(0))
    for k in range(1, steps + 1):
        now = now.join(transitions.withColumnRenamed("p", "q"), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        out = out.unionByName(now.withColumn("step", F.lit(k)))
    return out.select("step", "node", "p")
