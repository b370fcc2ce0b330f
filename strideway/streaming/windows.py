"""Streams of time-stamped edges: sliding-window networks and continuing paths.

Both take a streaming (or batch) DataFrame with src, dst and a time stamp ts; lateness is bounded by a watermark, so state is dropped in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS = "root string, path string, started timestamp, ended timestamp"


def window_networks(edges: DataFrame, size: str, step: str, late: str = "1 minute") -> DataFrame:
    """(start, end, src, dst, w) of each sliding window, emitted when the watermark has passed it."""
    w = edges.withWatermark("ts", late).groupBy(F.window("ts", size, step), "src", "dst").agg(F.count("*").alias("w"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "src", "dst", "w")


def degree_stream(edges: DataFrame, size: str, late: str = "1 minute") -> DataFrame:
    """(start, node, degree) of each tumbling window."""
    ends = edges.withWatermark("ts", late).select("ts", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(F.window("ts", size), "node").agg(F.count("*").alias("degree")).select(F.col("window.start").alias("start"), "node", "degree")


def session_paths(events: DataFrame, gap_seconds: float, late: str = "1 minute") -> DataFrame:
    """(root, path, started, ended): for each key its events' nodes, as a path that ends when gap_seconds pass without one.

    events: key, node, ts. The open path of a key is its only state; a timeout closes it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        nodes, first, last = state.get if state.exists else ([], None, None)
        nodes = list(nodes)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], ",".join(nodes), pd.Timestamp(first), pd.Timestamp(last))], columns=["root", "path", "started", "ended"])
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        for node, ts in zip(rows["node"], rows["ts"]):
            now = ts.value
            if last is not None and (now - last) / 1e9 > gap_seconds:
                out.append((key[0], ",".join(nodes), pd.Timestamp(first), pd.Timestamp(last)))
                nodes, first = [], None
            first, last = (now if first is None else first), max(now, last or now)
            nodes.append(node)
        state.update((nodes, first, last))
        state.setTimeoutTimestamp(max(int(last / 1e6 + gap_seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["root", "path", "started", "ended"])

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("node").cast("string").alias("node"), "ts").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, PATHS, "nodes array<string>, first long, last long", "append", "EventTimeTimeout")
