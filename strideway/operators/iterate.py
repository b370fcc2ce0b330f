"""The one loop of iterative operators: a step on a table, with its lineage cut by checkpoints that outlive executors."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir; only where it is unset and there is one machine, a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="strideway-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, key: list[Column], to: str, within: str | None = None, buckets: int = 4096) -> DataFrame:
    """df with column `to`: 0, 1, .. in a reproducible order of the key (per value of column `within`), without a global sort: rows are numbered in buckets of
    the key's hash, and a table of one count a bucket gives the buckets' offsets. Rows of equal keys take consecutive numbers."""
    own = [within] if within else []
    rows = df.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    counts = rows.groupBy(*own, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*own).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*own, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inner = F.row_number().over(Window.partitionBy(*own, "__bucket").orderBy(*key)) - 1
    return rows.withColumn("__i", inner).join(offsets, [*own, "__bucket"]).withColumn(to, F.col("__o") + F.col("__i")).select(*df.columns, to)


def frontier(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], limit: int | None = None, strict: bool = False) -> DataFrame:
    """All rows of start and of step(frontier, all so far), step after step, until a step adds none or limit steps were made; strict: then rows left to go on from are an error."""
    seen = now = cut(start)
    done = 0
    while limit is None or done < limit:
        now = cut(step(now, seen))
        done += 1
        if now.isEmpty():
            break
        seen = cut(seen.unionByName(now)) if done % 4 == 0 else seen.unionByName(now)
    else:
        if strict and not cut(step(now, seen)).isEmpty():
            raise ValueError(f"not over after {limit} steps: raise the guard")
    return seen
