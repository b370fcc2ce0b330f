"""Near-duplicate classes: ProbMinHash sketches, banding, exact verification.

A text is its multiset of WORDS-word shingles (lower-cased, split at ASCII white space); the weight of a shingle is its count. ProbMinHash: each
shingle is a Poisson process whose rate is its weight; an arrival takes a random slot of the sketch, the earliest arrival of a slot wins it, and a
process ends as soon as its next arrival is later than all slots' winners. The chance that two texts agree in a slot is their probability
Jaccard similarity. SLOTS = BANDS x ROWS slots: two texts of similarity 0.8 share no band with probability 7e-5.

Texts that share a band are candidates. They are linked if, exactly, the probability Jaccard or the Jaccard similarity of their shingles is SIMILARITY or more. Classes
are the connected components of the links.

A bucket first tests its leader against its members; after the components are known, only members outside the leader's
component are tested against the bucket's members of other components, so that no link between two classes is missed. LEADERS such leader rounds
(each with a new leader) go before that last step. So copies cost one pair each, however many they are; members of a bucket that stay unlinked to all others are compared with
each other in that last step, whose pairs grow as the square of their number: bands of 5 slots make such buckets small, but pages of one layout at a similarity of 0.5 to 0.7
may fill one. Copies (equal texts) are one node. Texts travel only for candidates, the
leader's joined last, where AQE splits a hot leader.

Cases. Null text, or one without a word: a class of its own. Fewer than WORDS words: one shingle of all words. Null id: counts
in its class, whose id is the least id in it (null only if all are). Repeated rows and ids: each row is returned. Ties: the least id. Long texts: whole, one at a time.
Empty table: no rows. Other columns are ignored, or kept by ``keep_one``, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import U64, Powers, join_small, mix64, prefix_hash, slices, written
from strideway.llm.components import stars

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
LEADERS = 2
_POWERS = Powers()
_Q = 0x9FB21C651E98DF25
_GOLD = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Shingles that are sketched at once.
_BATCH = 200_000


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, their counts)."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(data)]])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    c, down = prefix_hash(data, _POWERS)
    w = mix64((c[end] - c[start]) * down[start])
    n = min(words, len(w))
    s = np.zeros(len(w) - n + 1, U64)
    for k in range(n):
        s += w[k : len(w) - n + 1 + k] * U64(pow(_Q, k + 1, 1 << 64))
    return np.unique(mix64(s), return_counts=True)


def sketch(hashes: np.ndarray, weights: np.ndarray, texts: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash of n weighted sets at once: the winning element of each slot, an n x slots array. texts: each element's set number."""
    if slots > 2048:
        raise ValueError("at most 2048 slots")
    times = np.full(n * slots, np.inf)
    winners = np.zeros(n * slots, U64)
    latest = np.full(n, np.inf)
    h, rate = np.zeros(len(hashes)), weights.astype(np.float64)
    seed = mix64(hashes + _GOLD)
    step = 0
    while len(seed):
        step += 1
        x = mix64(seed + U64(int(_GOLD) * step % (1 << 64)))
        # 53 bits for the waiting time, the other 11 for the slot
        h = h - np.log1p(-((x >> U64(11)).astype(np.float64) * 2.0**-53)) / rate
        alive = h < latest[texts]
        if not alive.all():
            seed, h, rate, texts, hashes, x = seed[alive], h[alive], rate[alive], texts[alive], hashes[alive], x[alive]
            if not len(seed):
                break
        at = texts * slots + ((x & U64(2047)) * U64(slots) >> U64(11)).astype(np.int64)
        np.minimum.at(times, at, h)
        won = times[at] == h
        winners[at[won]] = hashes[won]
        latest = times.reshape(n, slots).max(1)
    return winners.reshape(n, slots)


def band_hashes(winners: np.ndarray) -> np.ndarray:
    """One hash for each band of a sketch, the band's number in it."""
    parts = winners.reshape(len(winners), BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=U64)[None] * _GOLD
    for k in range(ROWS):
        out = mix64(out * U64(_Q) + parts[:, :, k])
    return out.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum over common elements d of 1 / sum over all e of max(x_e / x_d, y_e / y_d)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    both = (x > 0) & (y > 0)
    # elements of a ratio up to d's count by x, the others by y
    upto = np.searchsorted(ratio, ratio[both], side="right")
    left, right = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return float((1 / (left[upto] / x[both] + (right[-1] - right[upto]) / y[both])).sum())


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> bool:
    if not len(a[0]) or not len(b[0]):
        return False
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    if common >= least * (len(a[0]) + len(b[0]) - common) - 1e-9:
        return True
    if common == 0 or (a[1].max() == 1 and b[1].max() == 1):
        return False
    return probability_jaccard(a, b) >= least - 1e-12


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list) -> pa.RecordBatch:
        some = [r for r in rows if len(r[2][0])]
        bands: dict[int, np.ndarray] = {}
        if some:
            size = [len(r[2][0]) for r in some]
            got = band_hashes(sketch(np.concatenate([r[2][0] for r in some]), np.concatenate([r[2][1] for r in some]), np.repeat(np.arange(len(some)), size), len(some)))
            bands = {id(r): got[i] for i, r in enumerate(some)}
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([bands.get(id(r)) for r in rows], pa.list_(pa.int64()))],
            names=["doc_id", "key", "bands"],
        )

    rows: list = []
    size = 0
    for batch in slices(batches):
        for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            rows.append((doc_id, key, shingles(text)))
            size += len(rows[-1][2][0])
            if size > _BATCH or len(rows) >= 2000:
                yield flush(rows)
                rows, size = [], 0
    if rows:
        yield flush(rows)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, tuple] = {}
    for batch in slices(batches):
        keep = []
        for key, one, other in zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                known[key] = shingles(one)
            keep.append(similar(known[key], shingles(other)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; texts has key and text of every candidate, once."""
    pairs = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return pairs.select("a", "text_a", "b", "text_b").mapInArrow(_verify, "a binary, b binary")


def linked(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Stars (a, b) of the keys of different texts that are connected by similarity in any bucket; b is the least key."""
    nodes = sketches.filter("bands IS NOT NULL").groupBy("key").agg(F.first("bands").alias("bands"))
    banded = written(nodes.select("key", F.explode("bands").alias("h")), "bands")
    buckets = banded.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    members = written(join_small(banded, buckets, ["h"], "left_semi", 24, "buckets").withColumn("rank", F.xxhash64("key")), "members")
    keys = members.select("key").distinct()
    texts = join_small(docs.select("key", "text"), keys, ["key"], "left_semi", 40, "candidates")
    texts = written(texts.groupBy("key").agg(F.first("text").alias("text")), "candidate-texts")
    comps, tested = None, members.filter("false").select("h", "rank")
    grouped = members.withColumn("comp", F.col("key"))
    for _ in range(LEADERS):
        # a leader that no earlier round of its bucket had, outside the component of the first one
        free = grouped.join(tested, ["h", "rank"], "left_anti")
        leads = free.groupBy("h").agg(F.min("rank").alias("lead"))
        named = free.join(leads, "h").filter("rank = lead").select("h", F.col("key").alias("a"), F.col("comp").alias("comp_a"), "lead")
        pairs = grouped.join(named, "h").filter("comp <> comp_a").select("a", F.col("key").alias("b")).distinct()
        new = written(_verified(pairs, texts), "links")
        tested = tested.unionByName(named.select("h", F.col("lead").alias("rank")))
        # earlier stars stand for the links that made them
        comps = stars(new if comps is None else comps.unionByName(new))
        named = comps.select(F.col("a").alias("key"), F.col("b").alias("component"))
        grouped = join_small(members, named, ["key"], "left", 56, "bucket-components").withColumn("comp", F.coalesce("component", "key")).drop("component")
        sizes = grouped.groupBy("h").agg(F.min(F.xxhash64("comp")).alias("c1"), F.max(F.xxhash64("comp")).alias("c2"))
        active = sizes.filter("c1 <> c2").select("h")
        grouped = written(join_small(grouped, active, ["h"], "left_semi", 24, "active"), "active-members")
        if grouped.isEmpty():
            return comps
        tested = written(tested, "tested")
    # the rest, exactly: members outside the component that is met first, against all of other components
    first = grouped.groupBy("h").agg(F.min("rank").alias("lead"))
    major = grouped.join(first, "h").filter("rank = lead").select("h", F.col("comp").alias("major"))
    minors = grouped.join(major, "h").filter("comp <> major").select("h", F.col("key").alias("a"), F.col("rank").alias("rank_a"), F.col("comp").alias("comp_a"))
    rest = minors.join(grouped, "h").filter("comp <> comp_a").select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
    return stars(comps.unionByName(written(_verified(rest, texts), "links")))


def _classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, class key; classes of two or more rows: class key, least id, size)."""
    docs = _keyed(df, id_col, text_col)
    sketches = written(docs.select("doc_id", "key", "text").mapInArrow(_sketches, "doc_id long, key binary, bands array<long>"), "sketches")
    comps = linked(docs, sketches).select(F.col("a").alias("key"), F.col("b").alias("ck"))
    plain = sketches.select("doc_id", "key", F.col("bands").isNotNull().alias("some"))
    rows = join_small(plain, comps, ["key"], "left", 56, "classes").select("doc_id", "key", F.when(F.col("some"), F.coalesce("ck", "key")).alias("ck"))
    sizes = rows.filter("ck IS NOT NULL").groupBy("ck").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1")
    return rows, sizes


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, is_first) of every row; class_id is the least id of the class."""
    rows, sizes = _classes(df, id_col, text_col)
    out = join_small(rows, sizes, ["ck"], "left", 48, "class-sizes")
    class_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"), F.coalesce(class_id.eqNullSafe(F.col("doc_id")), F.lit(False)).alias("is_first"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns: one of each class, that of the least id (null last), and of its texts the least by hash."""
    rows, _ = _classes(df, id_col, text_col)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    best = written(rows.filter("ck IS NOT NULL").groupBy("ck").agg(F.min(own).alias("x"), F.count("*").alias("n")).filter("n > 1"), "kept")
    away = rows.join(best, "ck").filter(~own.eqNullSafe(F.col("x"))).select("doc_id", "key").distinct()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # the rows as one struct, so that no name of theirs can clash
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    # null ids: equal texts of one class are told apart by a flag, as a join doesn't match nulls
    keys = ["i", "absent", "key"]
    mark = lambda d, *more: d.select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("absent"), "key", *more)
    left = join_small(mark(named, "row"), mark(away), keys, "left_anti", 56, "away")
    back = lambda d: d.select(*[F.col("row")[c].alias(c) for c in df.columns])
    # rows with one id and one text: only where there are some are they told apart
    twice = rows.filter("ck IS NOT NULL").groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
    twice = written(mark(twice), "repeated-rows")
    if twice.isEmpty():
        return back(left)
    single = left.join(twice, keys, "left_anti")
    # the first one met of equal rows: a map column allows no order
    return back(single).unionByName(back(left.join(twice, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row"))))
