"""Readers and writers of text formats. All go through Spark's text source, so files of any size are split; order-dependent readers carry
the line's place as (file, offset in the partition's order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions.times import epoch
from strideway.operators.graph import Graph
from strideway.operators.paths import PathSet
from strideway.operators.temporal import TemporalEdges


def _lines(spark: SparkSession, path: str, separator: str, strip: bool = True, header: bool = False) -> DataFrame:
    """(fields, seq): non-empty lines split; seq rises in reading order."""
    rows = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    if header:
        rows = rows.filter(F.col("seq") > 0)
    rows = rows.filter(F.trim("value") != "")
    fields = F.split(F.rtrim("value"), _quoted(separator))
    return rows.select((F.transform(fields, lambda x: F.trim(x)) if strip else fields).alias("fields"), "seq")


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def read_ngrams(spark: SparkSession, path: str, separator: str = ",", frequency: bool = True, max_lines: int | None = None, max_nodes: int | None = None, cap: int | None = None) -> PathSet:
    """Lines of nodes, the last field being the frequency if there is one; rows of frequency 0 or less are left out, longer ones cut to max_nodes."""
    rows = _lines(spark, path, separator)
    if max_lines is not None:
        rows = rows.filter(F.col("seq") < max_lines)
    fields = F.filter(F.col("fields"), lambda x: x != "")
    rows = rows.select(fields.alias("f")).filter(F.size("f") > (1 if frequency else 0))
    freq = F.element_at("f", -1).try_cast("double") if frequency else F.lit(1.0)
    nodes = F.slice("f", 1, F.size("f") - 1) if frequency else F.col("f")
    out = rows.select((F.slice(nodes, 1, max_nodes) if max_nodes else nodes).alias("path"), freq.alias("freq")).filter("freq > 0")
    return PathSet.collect_equal(out, separator, cap)


def read_edge_paths(spark: SparkSession, path: str, separator: str = ",", weight: bool = False, undirected: bool = False, max_lines: int | None = None) -> PathSet:
    """Each edge as a path of one edge, its frequency in the third field if weight is set."""
    rows = _lines(spark, path, separator, strip=False)
    if max_lines is not None:
        rows = rows.filter(F.col("seq") <= max_lines)
    bad = F.raise_error(F.lit("a line has fewer than two fields")).cast("string")
    get = lambda i: F.when(F.size("fields") >= 2, F.get("fields", F.lit(i))).otherwise(bad)
    one = rows.select(get(0).alias("a"), get(1).alias("b"), (F.get("fields", F.lit(2)).cast("double") if weight else F.lit(1.0)).alias("freq"))
    out = one.select(F.array("a", "b").alias("path"), "freq")
    if undirected:
        out = out.unionByName(one.select(F.array("b", "a").alias("path"), "freq"))
    return PathSet.collect_equal(out, separator)


def read_graph(spark: SparkSession, path: str, separator: str = ",", weighted: bool = False, directed: bool = False, header: bool = False) -> Graph:
    """An edge list; malformed lines are left out, of repeated edges the last holds."""
    rows = _lines(spark, path, separator, header=header).filter(F.size("fields") >= 2)
    w = F.coalesce(F.get("fields", F.lit(2)).try_cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    return Graph(rows.select(F.get("fields", F.lit(0)).alias("src"), F.get("fields", F.lit(1)).alias("dst"), w.alias("w"), "seq"), directed, order="seq")


def read_dag(spark: SparkSession, path: str, separator: str = ",", nodes: list[str] | None = None, header: bool = False, max_lines: int | None = None) -> DataFrame:
    """(src, dst) without self-loops and repeats; with `nodes` only edges between those."""
    rows = _lines(spark, path, separator, header=header)
    if max_lines is not None:
        rows = rows.filter(F.col("seq") < max_lines)
    e = rows.filter(F.size("fields") >= 2).select(F.get("fields", F.lit(0)).alias("src"), F.get("fields", F.lit(1)).alias("dst")).filter("src <> dst").distinct()
    return e if nodes is None else e.filter(F.col("src").isin(nodes) & F.col("dst").isin(nodes))


def read_temporal(spark: SparkSession, path: str, separator: str = ",", directed: bool = True, timestamp_format: str = "yyyy-MM-dd HH:mm:ss", max_lines: int | None = None, rescale: int = 1) -> TemporalEdges:
    """A header names source|node1, target|node2 and time|timestamp in any order; without a time column the row's number is the time. Rows with a time under 0,
    without an end or malformed are left out. Node names keep their leading blanks."""
    first = spark.read.text(path).first()
    names = [x.strip() for x in (first[0] if first else "").split(separator)]
    at = {k: next((i for i, n in enumerate(names) if n in v), None) for k, v in {"src": ("source", "node1"), "dst": ("target", "node2"), "t": ("time", "timestamp")}.items()}
    if at["src"] is None or at["dst"] is None:
        raise ValueError("the header names no source and target")
    rows = _lines(spark, path, separator, strip=False, header=True)
    if max_lines is not None:
        rows = rows.filter(F.col("seq") <= max_lines)
    get = lambda k: F.get("fields", F.lit(at[k]))
    t = F.col("seq") - 1 if at["t"] is None else epoch(F.trim(get("t")), timestamp_format)
    e = rows.select(get("src").alias("src"), get("dst").alias("dst"), t.alias("t"), "seq").filter("t >= 0 AND src <> '' AND dst <> ''")
    return TemporalEdges(e.withColumn("t", F.expr(f"t div {rescale}")), directed)


def read_origin_destination(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(o, d, w)."""
    rows = _lines(spark, path, separator)
    return rows.select(F.get("fields", F.lit(0)).alias("o"), F.get("fields", F.lit(1)).alias("d"), F.get("fields", F.lit(2)).cast("double").alias("w"))


def read_jdbc_edges(spark: SparkSession, **options: str) -> DataFrame:
    """(src, dst[, t]) of a database table with columns source, target and perhaps time, by any JDBC driver."""
    rows = spark.read.format("jdbc").options(**options).load()
    names = {c.lower(): c for c in rows.columns}
    out = rows.select(F.col(names["source"]).cast("string").alias("src"), F.col(names["target"]).cast("string").alias("dst"), *([F.col(names["time"]).alias("t")] if "time" in names else []))
    return out


def from_networkx(spark: SparkSession, graph) -> Graph:
    """A simple networkx graph; needs no import of the library."""
    rows = [(str(a), str(b), float(d.get("weight", 1.0)), {k: str(v) for k, v in d.items()}) for a, b, d in graph.edges(data=True)]
    nodes = [(str(n), {k: str(v) for k, v in d.items()}) for n, d in graph.nodes(data=True)]
    return Graph(spark.createDataFrame(rows, "src string, dst string, w double, attrs map<string,string>"), graph.is_directed(), spark.createDataFrame(nodes, "node string, attrs map<string,string>"))


def to_networkx(graph: Graph):
    import networkx as nx

    out = nx.DiGraph() if graph.directed else nx.Graph()
    out.add_nodes_from((r["node"], r["attrs"]) for r in graph.vertices.collect())
    out.add_edges_from((r["src"], r["dst"], {"weight": r["w"], **r["attrs"]}) for r in graph.edges.collect())
    return out


# --- writers ----------------------------------------------------------------------------------------


def _number(c: Column) -> Column:
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def write_ngrams(paths: PathSet, path: str, separator: str = ",") -> None:
    paths.longest.filter("freq > 0").select(F.concat_ws(separator, F.array_join("path", separator), _number(F.col("freq")))).write.text(path)


def write_graph(graph: Graph, path: str, separator: str = ",", weighted: bool = False, header: bool = False) -> None:
    graph.edges.select("src", "dst", *([_number(F.col("w")).alias("weight")] if weighted else [])).write.csv(path, sep=separator, header=header)


def write_dag(edges: DataFrame, path: str, separator: str = ",") -> None:
    edges.select("src", "dst").write.csv(path, sep=separator)


def write_temporal(edges: TemporalEdges, path: str, separator: str = ",") -> None:
    """Ordered by time, with a header in each part."""
    edges.edges.orderBy("t", "seq").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("t").alias("time")).write.csv(path, sep=separator, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_state_file(model, layer: int, path: str) -> None:
    """The state network of one layer of a multi-order model, as one local file."""
    with open(path, "w") as f:
        f.write("\n".join(model.state_file_lines(layer)) + "\n")
