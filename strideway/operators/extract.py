"""Path extraction: routes of acyclic graphs, causal paths of time-stamped edges, origin-destination paths, random walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.functions import grams
from strideway.operators.iterate import cut, frontier
from strideway.operators.paths import PathSet
from strideway.operators.temporal import TemporalEdges
from strideway.operators.traversal import all_shortest_paths, nodes_of


def roots_and_leaves(edges: DataFrame) -> DataFrame:
    """(node, root, leaf) of every node."""
    has_in, has_out = edges.select(F.col("dst").alias("node"), F.lit(True).alias("i")).distinct(), edges.select(F.col("src").alias("node"), F.lit(True).alias("o")).distinct()
    n = nodes_of(edges).join(has_in, "node", "left").join(has_out, "node", "left")
    return n.select("node", F.col("i").isNull().alias("root"), F.col("o").isNull().alias("leaf"))


def is_acyclic(edges: DataFrame) -> bool:
    """Whether peeling nodes without an incoming edge leaves none."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if (m := left.count()) == n:
            return False
        n = m
    return True


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest way from a root; sorting by it is a topological order."""
    e = cut(edges.select("src", "dst").distinct())
    start = roots_and_leaves(edges).filter("root").select("node", F.lit(0).alias("level"))
    got = frontier(start, lambda now, _: now.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("level")))
    return got.groupBy("node").agg(F.max("level").alias("level"))


def dfs(edges: list[tuple[str, str]]) -> tuple[list[str], dict[tuple[str, str], str]]:
    """(topological order, class of each edge) of a small graph by depth-first search in name order: tree, forward, back or cross."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    began, ended, kinds, order, clock = {}, {}, {}, [], 0
    for root in sorted(out):
        if root in began:
            continue
        stack = [(root, iter(out[root]))]
        began[root] = clock = clock + 1
        while stack:
            v, rest = stack[-1]
            for w in rest:
                if w not in began:
                    kinds[v, w] = "tree"
                    began[w] = clock = clock + 1
                    stack.append((w, iter(out[w])))
                    break
                kinds[v, w] = "back" if w not in ended else "forward" if began[v] < began[w] else "cross"
            else:
                ended[v] = clock = clock + 1
                order.append(v)
                stack.pop()
    return order[::-1], kinds


def make_acyclic(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges without the back edges of a depth-first search in name order, which is sequential: for graphs of up to `most` edges."""
    rows = edges.select("src", "dst").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} edges")
    _, kinds = dfs([(r["src"], r["dst"]) for r in rows])
    back = [e for e, k in kinds.items() if k == "back"]
    return edges if not back else edges.join(edges.sparkSession.createDataFrame(back, "src string, dst string"), ["src", "dst"], "left_anti")


def dag_edges(edges: DataFrame) -> DataFrame:
    """Without self-loops and repeats, as an acyclic graph has them."""
    return edges.select("src", "dst").filter("src <> dst").distinct()


def routes(edges: DataFrame, start: DataFrame | None = None, guard: int = 64) -> DataFrame:
    """(path) of all ways from roots (or the nodes of start) to leaves. Their number may grow exponentially: more than `guard` edges are an error."""
    e = cut(edges.select("src", "dst").distinct())
    first = (roots_and_leaves(edges).filter("root").select("node") if start is None else start).select(F.array("node").alias("path"))
    grown = frontier(first, lambda now, _: now.withColumn("src", F.element_at("path", -1)).join(e, "src").select(F.concat("path", F.array("dst")).alias("path")), guard + 1)
    if not grown.filter(F.size("path") > guard + 1).isEmpty():
        raise ValueError(f"ways of more than {guard} edges: a cycle, or raise the guard")
    return grown.withColumn("src", F.element_at("path", -1)).join(e.select("src").distinct(), "src", "left_anti").select("path")


def routes_to(edges: DataFrame, node: str, guard: int = 64) -> DataFrame:
    """(path) of all ways from roots to a node."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    return routes(back, start, guard).select(F.reverse("path").alias("path"))


def paths_from_dag(edges: DataFrame, mapping: dict | None = None, repetitions: bool = True, unique: bool = False, guard: int = 64) -> PathSet:
    """Root-to-leaf paths, each counted once; mapped by node -> label or node -> set of labels (all combinations)."""
    if not is_acyclic(edges):
        raise ValueError("the graph has a cycle")
    rows = routes(edges, guard=guard).withColumn("root", F.element_at("path", 1))
    if mapping:
        many = not isinstance(next(iter(mapping.values())), str)
        if many:
            pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in sorted(v)]))]
            table = F.create_map(*pairs)
            rows = rows.withColumn("path", F.explode(grams.expand_sets(F.transform("path", lambda x: table[x]))))
        else:
            rows = rows.withColumn("path", grams.mapped("path", mapping))
    if not repetitions:
        rows = rows.withColumn("path", grams.remove_repeats("path"))
    if unique:
        rows = rows.distinct()
    return PathSet.collect_equal(rows.select("path", F.lit(1.0).alias("freq")))


def activity_dag(seq: DataFrame, connect_prior: int = 0, self_loops: bool = True) -> DataFrame:
    """(src, dst, src_pos, dst_pos): each position linked from the m positions before it (0: from all)."""
    a, b = seq.select(F.col("pos").alias("src_pos"), F.col("s").alias("src")), seq.select(F.col("pos").alias("dst_pos"), F.col("s").alias("dst"))
    if connect_prior:
        near = a.withColumn("dst_pos", F.explode(F.sequence(F.col("src_pos") + 1, F.col("src_pos") + connect_prior)))
        out = near.join(b, "dst_pos")
    else:
        out = a.join(b, F.col("src_pos") < F.col("dst_pos"))
    return (out if self_loops else out.filter("src <> dst")).select("src", "dst", "src_pos", "dst_pos")


def causal_paths(tempnet: TemporalEdges, delta: int = 1, roots: DataFrame | None = None, guard: int = 10_000) -> PathSet:
    """Causal paths: for each root of the time-unfolded graph the leaves of its causal tree.

    A tree node is (label, depth) and has one parent path, the lexicographically least; a path counts if no other of its root's paths
    goes on from it. Each round joins the frontier's time-stamped nodes with the next edges and keeps one row of each, so trees stay polynomial.
    """
    sep = "\x01"
    e = cut(tempnet.unfolded(delta))
    n = e.select(F.col("v").alias("v"), F.col("tv").alias("t")).distinct()
    first = (n.join(e.select(F.col("w").alias("v"), F.col("tw").alias("t")).distinct(), ["v", "t"], "left_anti") if roots is None else roots).select(F.concat_ws(sep, "v", F.col("t").cast("string")).alias("root"), "v", "t", F.array("v").alias("path"), F.lit(0).alias("depth"))

    def step(now: DataFrame, _: DataFrame) -> DataFrame:
        grown = now.select("root", F.col("v").alias("v0"), F.col("t").alias("t0"), "path", "depth").join(e, (F.col("v0") == F.col("v")) & (F.col("t0") == F.col("tv")))
        grown = grown.select("root", F.col("w").alias("v"), F.col("tw").alias("t"), "path", (F.col("depth") + 1).alias("depth"))
        best = F.min("path").over(Window.partitionBy("root", "v", "depth"))
        return grown.withColumn("path", F.concat(best, F.array("v"))).distinct()

    rows = frontier(first, step, guard, True).select("root", "path").distinct()
    goes_on = rows.filter(F.size("path") > 1).select("root", F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
    leaves = rows.join(goes_on, ["root", "path"], "left_anti")
    return PathSet.collect_equal(leaves.select(grams.remove_repeats("path").alias("path"), F.lit(1.0).alias("freq")))


def causal_tree(tempnet: TemporalEdges, node: str, t: int, delta: int = 1, guard: int = 10_000) -> DataFrame:
    """(parent, parent_depth, node, depth): the causal tree of a node at a time; of several parents of a (node, depth) the least holds."""
    e = cut(tempnet.unfolded(delta))
    spark = e.sparkSession
    start = spark.createDataFrame([(None, node, t, 0)], "parent string, v string, t long, depth int")

    def step(now: DataFrame, _: DataFrame) -> DataFrame:
        near = now.select(F.col("v").alias("v0"), F.col("t").alias("t0"), "depth").join(e, (F.col("v0") == F.col("v")) & (F.col("t0") == F.col("tv")))
        grown = near.select(F.col("v0").alias("parent"), F.col("w").alias("v"), F.col("tw").alias("t"), (F.col("depth") + 1).alias("depth"))
        return grown.withColumn("parent", F.min("parent").over(Window.partitionBy("v", "depth"))).distinct()

    rows = frontier(start, step, guard, True).filter("parent IS NOT NULL")
    return rows.select("parent", (F.col("depth") - 1).alias("parent_depth"), F.col("v").alias("node"), "depth").distinct()


def temporal_walks(tempnet: TemporalEdges, starts: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """(walker, path): from (walker, node) each walker takes, up to `length` times, an edge of its node's next active time, one of several by a seeded choice."""
    e = cut(tempnet.edges.select("src", "dst", "t").distinct())
    now = starts.select("walker", F.array("node").alias("path"), F.lit(None).cast("long").alias("at"))
    for k in range(length):
        here = now.withColumn("src", F.element_at("path", -1))
        near = here.join(e, "src", "left").filter(F.col("t").isNull() | F.col("at").isNull() | (F.col("t") > F.col("at")))
        pick = F.min_by(F.struct("dst", "t"), F.struct("t", F.xxhash64(F.lit(seed), F.lit(k), "walker", "dst").alias("h")))
        step = near.filter("t IS NOT NULL").groupBy("walker").agg(pick.alias("x"))
        now = cut(now.join(step, "walker", "left").select("walker", F.when(F.col("x").isNull(), F.col("path")).otherwise(F.concat("path", F.array("x.dst"))).alias("path"), F.coalesce("x.t", "at").alias("at")))
    return now.select("walker", "path")


def sampled_causal_paths(tempnet: TemporalEdges, delta: int, num_roots: int, seed: int = 0) -> PathSet:
    """Causal paths of a seeded sample of roots."""
    e = tempnet.unfolded(delta)
    n = e.select("v", F.col("tv").alias("t")).distinct().join(e.select(F.col("w").alias("v"), F.col("tw").alias("t")).distinct(), ["v", "t"], "left_anti")
    return causal_paths(tempnet, delta, n.orderBy(F.xxhash64(F.lit(seed), "v", "t"), "v", "t").limit(num_roots))


def next_edges(tempnet: TemporalEdges, delta: int) -> DataFrame:
    """(id, next): each edge's first continuation within delta, by an as-of window over a node's arrivals and departures."""
    e = tempnet.edges.withColumn("id", F.concat_ws("\x01", "src", "dst", F.col("t").cast("string"), F.col("seq").cast("string")))
    arrive = e.select(F.col("dst").alias("node"), "t", "id", F.lit(None).cast("struct<t:bigint,seq:bigint,id:string>").alias("leave"))
    leave = e.select(F.col("src").alias("node"), "t", F.lit(None).cast("string").alias("id"), F.struct("t", "seq", "id").alias("leave"))
    w = Window.partitionBy("node").orderBy("t").rangeBetween(1, delta)
    nxt = arrive.unionByName(leave).withColumn("nx", F.min("leave").over(w)).filter("id IS NOT NULL")
    return nxt.select("id", F.col("nx.id").alias("next"))


def single_continuation_paths(tempnet: TemporalEdges, delta: int = 1, guard: int = 100_000) -> PathSet:
    """Paths where each edge is continued by the first later edge within delta only; edges that continue none begin a path."""
    e = tempnet.edges.withColumn("id", F.concat_ws("\x01", "src", "dst", F.col("t").cast("string"), F.col("seq").cast("string")))
    nx = cut(next_edges(tempnet, delta).join(e.select("id", "src", "dst", "t"), "id").distinct())
    follow = nx.select(F.col("id").alias("at"), F.col("dst").alias("to"), F.col("next").alias("then"), F.col("t").alias("when"))
    begins = nx.join(nx.select(F.col("next").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_anti")
    start = begins.select(F.array("src", "dst").alias("path"), F.array("t").alias("times"), "next")
    rows = frontier(start, lambda now, _: now.filter("next IS NOT NULL").join(follow, F.col("next") == F.col("at")).select(F.concat("path", F.array("to")).alias("path"), F.concat("times", F.array("when")).alias("times"), F.col("then").alias("next")), guard, True)
    # equal node sequences at equal times are one path
    whole = rows.filter("next IS NULL").select("path", "times").distinct()
    return PathSet.collect_equal(whole.select("path", F.lit(1.0).alias("freq")))


def paths_from_origin_destination(od: DataFrame, edges: DataFrame, distribute: bool = True, seed: int = 0) -> PathSet:
    """od: (o, d, w). The weight is dealt over all shortest paths in units, the first ones in order taking what is left; else one seeded choice takes it."""
    sp = all_shortest_paths(edges).select(F.col("src").alias("o"), F.col("dst").alias("d"), "path")
    order = F.col("path") if distribute else F.xxhash64(F.lit(seed), "path")
    w = Window.partitionBy("o", "d")
    rows = sp.withColumn("m", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy(order)) - 1).join(od, ["o", "d"])
    if distribute:
        share = F.floor(F.col("w") / F.col("m")) + (F.col("i") < F.col("w") % F.col("m")).cast("int")
    else:
        share = F.when(F.col("i") == 0, F.col("w")).otherwise(0.0)
    return PathSet.collect_equal(rows.select("path", share.cast("double").alias("freq")).filter("freq > 0"))


def random_walks(transitions: DataFrame, starts: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """(walker, path): each walker of starts (walker, node) makes up to `length` steps by transitions (src, dst, p); it ends at a sink."""
    w = Window.partitionBy("src").orderBy("dst")
    t = cut(transitions.withColumn("hi", F.sum("p").over(w)).withColumn("lo", F.col("hi") - F.col("p")).withColumn("last", F.lead("dst").over(w).isNull()).select("src", "dst", "lo", "hi", "last"))
    now = starts.select("walker", F.array(F.col("node")).alias("path"))
    for k in range(length):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "walker"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        at = now.withColumns({"src": F.element_at("path", -1), "u": u})
        moved = at.join(t, (at["src"] == t["src"]) & (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | F.col("last")), "left")
        now = moved.select("walker", F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"))
        if k % 8 == 7:
            now = cut(now)
    return now


def random_paths(paths: PathSet, fraction: float = 1.0, seed: int = 0) -> PathSet:
    """A fraction of the observations replaced by random walks from the same start and of the same length."""
    one = paths.longest.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("freq").cast("int"), F.lit(1)))))
    one = one.withColumn("walker", F.xxhash64(F.lit(seed), "path", "copy"))
    swap = F.pmod(F.xxhash64(F.lit(seed + 1), "walker"), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30)))
    kept = one.filter(~swap).select("path", F.lit(1.0).alias("freq"))
    moved = cut(one.filter(swap))
    e = paths.edges()
    t = e.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p")
    walks = random_walks(t, moved.select("walker", F.element_at("path", 1).alias("node")), paths.max_length(), seed)
    new = walks.join(moved.select("walker", F.size("path").alias("n")), "walker").select(F.slice("path", 1, F.col("n")).alias("path"), F.lit(1.0).alias("freq"))
    return PathSet.collect_equal(kept.unionByName(new), paths.separator, paths.cap)
