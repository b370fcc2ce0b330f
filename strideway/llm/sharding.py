"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Native: every step is a DataFrame or SQL expression. Rows get a global number 0..n-1 in the order of a digest of (id, whole row); the number
goes through a keyed bijection of 0..n-1; the permuted
position p gives shard p % shards and slot p // shards. So shard sizes differ by one row at most (law
``rows``), slots have no gaps, and shard and slot of a row number can be computed without any table
(``permute_int``).

Numbering needs no global sort: the first hex digits of the digest are a bucket, a table of at most
16**DIGITS counts gives each bucket its offset, and a window numbers the rows of one bucket. The digest covers all columns, so rows that share an id
(or its absence) spread over all buckets; rows that are equal in every column are folded into one row with a count
before the window and unfolded after it, so a hot group of copies costs one row.

Cases. Null id: the other columns tell such rows apart. Null text: size 1, crc32 of the empty string. Repeated rows take consecutive numbers; which is
which cannot be seen. Long texts are never shuffled by the query, which carries their size and crc32.
An empty table gives an empty result. Other columns of any type are carried, whatever their names; one named like a result raises
ValueError.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideway.llm.common import written

ROUNDS = 6
#: Hex digits of the bucket: 4096 buckets, so some 17 million rows each at 7e10 rows.
DIGITS = 3
#: Walks that every row may take at once; the few rows that are still outside walk on to the proven bound.
INLINE_WALKS = 4
#: Rows that one step of the unfolding makes of a group of equal rows.
UNFOLD = 10_000
SEED = 20_240_229
_P = 2_147_483_647
_RESULTS = ("law", "shard", "slot", "grown_shard")


def isqrt_up(n: int) -> int:
    """The least a >= 1 with a * a >= n."""
    a = max(1, math.isqrt(max(n, 1)))
    return a if a * a >= n else a + 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, 1 << 29), rng.randrange(1, 1 << 29), rng.randrange(1, 1 << 30)) for _ in range(rounds)]


def permute_int(x: int, n: int, seed: int = SEED) -> int:
    """The position of row number x among n; what ``permuted`` computes, without Spark."""
    a, keys = isqrt_up(n), round_keys(seed)
    while True:
        left, right = divmod(x, a)
        for k, m, c in keys:
            left, right = right, (left + ((right * right % _P) * k + right * m + c) % _P) % a
        x = left * a + right
        if x < n:
            return x


def _pass_sql(x: str, a: int, keys: list[tuple[int, int, int]]) -> str:
    """SQL of one pass of the network over 0..a*a-1. Sides stay below 2**31, so no product overflows a long."""
    rows = ", ".join(f"struct({k}L AS k, {m}L AS m, {c}L AS c)" for k, m, c in keys)
    f = f"((s.r * s.r % {_P}L) * q.k + s.r * q.m + q.c) % {_P}L"
    return (
        f"aggregate(array({rows}), struct({x} div {a}L AS l, {x} % {a}L AS r), "
        f"(s, q) -> struct(s.r AS l, (s.l + {f}) % {a}L AS r), s -> s.l * {a}L + s.r)"
    )


def permuted(df: DataFrame, number: str, n: int, to: str, seed: int = SEED) -> DataFrame:
    """df with column `to`: the position of row number `number` under the permutation of 0..n-1.

    The network works on a square of side a = ceil(sqrt(n)); a walk from inside 0..n-1 is back inside after
    at most a*a - n + 1 passes, since each pass outside visits another of the a*a - n outer places.
    """
    a, keys = isqrt_up(n), round_keys(seed)
    if a >= 1 << 31:
        raise ValueError("more than 2**62 rows")
    step = f"(y, i) -> if(y < {n}L, y, {_pass_sql('y', a, keys)})"
    df = df.withColumn("__walk", F.expr(f"aggregate(sequence(1, {INLINE_WALKS}), {_pass_sql(number, a, keys)}, {step})"))
    rest = f"aggregate(sequence(1L, {a * a - n + 1}L), __walk, {step})"
    return df.withColumn(to, F.expr(f"CASE WHEN __walk < {n}L THEN __walk ELSE {rest} END")).drop("__walk")


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """((row: a struct of df's columns, number: 0..n-1) of every row, n)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # JSON tells null from empty and takes every type; map entries in their given order
    digest = F.md5(F.concat_ws("\0", F.col(id_col).cast("string"), F.to_json(whole, {"ignoreNullFields": "false"})).cast("binary"))
    keyed = df.select(whole.alias("row"), digest.alias("h"))
    # counts of copies, combined on the map side, as a narrow table; rows join their numbers by digest, so whole rows are shuffled once
    sizes = written(keyed.groupBy("h").agg(F.count("*").alias("c")), "row-digests").withColumn("b", F.substring("h", 1, DIGITS))
    counts = sizes.groupBy("b").agg(F.sum("c").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    # 16**DIGITS rows at most, so one partition and a broadcast hold them at any size of df
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    within = Window.partitionBy("b").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    numbers = sizes.withColumn("e", F.sum("c").over(within)).join(F.broadcast(offsets), "b").select("h", "c", (F.col("o") + F.col("e") - F.col("c")).alias("s"))
    out = keyed.groupBy("h").agg(F.first("row").alias("row")).join(numbers, "h")
    out = out.withColumn("k", F.explode(F.expr(f"sequence(0L, (c - 1) div {UNFOLD}L)")))
    last = F.least(F.col("c") - 1, F.col("k") * UNFOLD + (UNFOLD - 1))
    out = out.withColumn("i", F.explode(F.sequence(F.col("k") * UNFOLD, last)))
    return out.select("row", (F.col("s") + F.col("i")).alias("number")), n


def feistel_shards(df: DataFrame, id_col: str = "doc_id", shards: int = 8, seed: int = SEED) -> DataFrame:
    """Every row of df with law, shard, slot and grown_shard (null under this law)."""
    if clash := set(_RESULTS) & set(df.columns):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    rows, n = numbered(df, id_col)
    rows = permuted(rows, "number", n, "p", seed)
    return rows.select(
        *[F.col("row")[c].alias(c) for c in df.columns],
        F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): what the sharding query carries of a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
