"""What the operators of this subpackage share: the shared folder, written tables, text hashing in numpy."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
#: Rows of a table that may be broadcast, times the bytes of a row; a larger side takes the shuffled join.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only where it is unset, a local one."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not (own := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strideway-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strideway/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing will read again."""
    fs, at = local_fs(table.written_to)
    fs.delete_dir(at)


def local_fs(uri: str):
    """(pyarrow filesystem, path) of a URI or plain path; works in executors too."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer, elementwise, on uint64 (a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.n = base, 0
        self.up = self.down = np.ones(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16, self.n * 2)
            inverse = pow(self.base, -1, 1 << 64)
            for name, base in (("up", self.base), ("down", inverse)):
                a = np.full(self.n, base, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


def prefix_hash(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(c, down): the polynomial hash of data[i:j] is (c[j] - c[i]) * down[i], modulo 2**64."""
    up, down = powers.get(len(data) + 1)
    c = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=c[1:])
    return c, down


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches in pieces of some rows, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int | Column, name: str = "side") -> DataFrame:
    """big joined with small, which is written and counted first: broadcast if it is proven to stay under
    BROADCAST_BYTES, else the shuffled join that AQE can split by skew."""
    small = written(small, name)
    size = small.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)
