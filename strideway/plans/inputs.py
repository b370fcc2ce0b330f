"""How the driver's tables become path sets, networks and time-stamped edges; each with the SQL of the same input. All read their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.functions.times import micros
from strideway.operators.graph import Graph
from strideway.operators.iterate import cut
from strideway.operators.paths import PathSet
from strideway.operators.temporal import TemporalEdges

SESSION_GAP = 43_200


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def sessions(spark: SparkSession, sf_dir: str, cap: int | None = None) -> PathSet:
    """Event types of a user's sessions."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type")
    return PathSet.from_sessions(e, "user_id", "ts", "event_id", "event_type", SESSION_GAP, cap=cap)


SESSIONS = f"""
e0 AS (SELECT user_id, event_type, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {SESSION_GAP}000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS brk
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e1 AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e0),
longest AS (SELECT path, CAST(count(*) AS DOUBLE) AS freq FROM (SELECT list(event_type ORDER BY ts, event_id) AS path FROM e1 GROUP BY user_id, sid) GROUP BY path)"""


def conversations(spark: SparkSession, sf_dir: str) -> PathSet:
    return PathSet.from_ordered(table(spark, sf_dir, "conversations", "conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")


CONVERSATIONS = "longest AS (SELECT path, CAST(count(*) AS DOUBLE) AS freq FROM (SELECT list(role ORDER BY turn, role) AS path FROM conversations GROUP BY conv_id) GROUP BY path)"


def customer_orders(spark: SparkSession, sf_dir: str, cap: int | None = None) -> PathSet:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return PathSet.from_ordered(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", cap=cap)


CUSTOMER_ORDERS = "longest AS (SELECT path, CAST(count(*) AS DOUBLE) AS freq FROM (SELECT list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS path FROM orders GROUP BY o_custkey) GROUP BY path)"


def stats_sql(cap: int | None = None) -> str:
    """CTE stats (g, k, sub, lon) after longest."""
    top = "len(path) - 2" if cap is None else f"least({cap}, len(path) - 2)"
    return f"""
subs AS (SELECT path[i:i + k] AS g, k, freq FROM (SELECT path, freq, unnest(generate_series(0, {top})) AS k FROM longest) AS x, LATERAL (SELECT unnest(generate_series(1, len(path) - k)) AS i) AS y),
stats AS (SELECT g, CAST(k AS INTEGER) AS k, sum(sub) AS sub, sum(lon) AS lon FROM (SELECT g, k, freq AS sub, 0.0 AS lon FROM subs
  UNION ALL SELECT path, len(path) - 1, 0.0, freq FROM longest) GROUP BY g, k)"""


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): items traded from supplier nation to customer nation."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return pairs.groupBy(F.col("s_nationkey").cast("string").alias("src"), F.col("c_nationkey").cast("string").alias("dst")).agg(F.count("*").cast("double").alias("w"))


def trade_network(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """The backbone of trade between nations: the quarter of all pairs with most items, whatever the size of the tables. Consumers join it with itself, so it is checkpointed once."""
    pairs = cut(trade_pairs(spark, sf_dir))
    strong = pairs.crossJoin(F.broadcast(pairs.agg(F.percentile("w", F.lit(0.75)).alias("upper")))).filter("w > upper AND src <> dst").select("src", "dst", "w")
    if not directed:
        strong = strong.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
    return Graph(cut(strong), directed)


TRADE = """
pairs AS (SELECT CAST(s_nationkey AS VARCHAR) AS src, CAST(c_nationkey AS VARCHAR) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
net AS (SELECT src, dst, w FROM pairs WHERE w > (SELECT quantile_cont(w, 0.75) FROM pairs) AND src <> dst),
nodes AS (SELECT src AS node FROM net UNION SELECT dst FROM net)"""

TRADE_UNDIRECTED = TRADE + """,
und AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w) AS w FROM net GROUP BY 1, 2),
arcs AS (SELECT src, dst, w FROM und UNION ALL SELECT dst, src, w FROM und)"""


def hand_overs(spark: SparkSession, sf_dir: str) -> TemporalEdges:
    """Consecutive events as an edge from one user to the next, at the minute of the second event."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    # the next event of a global order: hours are the window's key, and each hour's first event meets the last one before it
    hour = F.floor(micros("ts") / 3_600_000_000)
    rows = e.withColumn("h", hour)
    w = Window.partitionBy("h").orderBy("ts", "event_id")
    inner = rows.withColumn("before", F.lag("user_id").over(w))
    last = rows.groupBy("h").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("u"))
    # one row an hour, so this window is small
    prev = last.select("h", F.lag("u").over(Window.orderBy("h")).alias("prev"))
    out = inner.join(prev, "h").withColumn("src", F.coalesce("before", "prev")).filter("src IS NOT NULL")
    return TemporalEdges(out.select(F.col("src").cast("string").alias("src"), F.col("user_id").cast("string").alias("dst"), F.floor(micros("ts") / 60_000_000).alias("t"), F.col("event_id").alias("seq")))


HAND_OVERS = """
te AS (SELECT CAST(lag(user_id) OVER (ORDER BY ts, event_id) AS VARCHAR) AS src, CAST(user_id AS VARCHAR) AS dst,
  CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS t, event_id AS seq FROM events QUALIFY src IS NOT NULL)"""
