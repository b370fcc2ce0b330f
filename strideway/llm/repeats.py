"""Exact repeated-substring removal: a depth-limited most-significant-digit radix sort of suffixes.

Two positions belong together when the DEPTH bytes that start there are equal; the sort orders suffixes only so deep. A
digit is a stretch of those bytes, a pass splits the groups by one more digit, and a group of one drops out:

1. First digit: the window's anchor, the least (by a hash) of its GRAM-byte strings. It is a function of the window's bytes, so equal windows have
   equal anchors at equal offsets. Neighbouring windows share theirs: a run of windows is one row, some 140 times fewer rows than suffixes.
   Runs that are equal in all their bytes are equal windows throughout: their group is finished, with one row a run.
2. Second digit, for runs that share an anchor and not all bytes: a run is cut into buckets of WIDTH offsets; the digit is the
   DEPTH - WIDTH + 1 bytes that all windows of a bucket contain. Equal buckets are finished like equal runs.
3. Last digit, for what is left: each window through its full depth.

Digits are compared by 64-bit hashes of two bases, each pass within the groups of the one before. After the last pass the groups of two or more are
exactly the repeated windows; their bytes are merged into maximal removed runs. Overlapping windows of one document count as repeats of each other, and all
is judged on the input.

The same passes run over word tokens (50 of them, WORDS) for ``n_shared_words``: the words covered by a 50-word stretch that another document holds too. Such
passages are mostly shorter than DEPTH bytes, so they are reported and not removed. There a group counts as repeated only if it has two different texts; copies
are found by their row count.

Scale: passes are group counts combined on the map side and shuffled joins back with the groups that repeat, split by AQE where skewed. No group is
collected: a passage that a third of all documents share is one count. Rows go by the hash of their text, so copies share their intervals. Only a document's own
intervals meet in one row. Python reads the texts up to seven times in pieces of CHUNK windows; the later readings of a unit take only documents with open runs.

Cases. Null or empty text: 0 bytes, nothing removed. Texts under DEPTH bytes: kept. Null or repeated ids: each row has its own result. Copies of DEPTH bytes or
more lose all bytes. Words are split at ASCII white space, case and marks count; fewer than 50 share nothing. Ties between equal anchors: the leftmost. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import U64, Powers, discard, join_small, mix64, prefix_hash, written

DEPTH, GRAM, WIDTH = 400, 128, 32
#: Words of a passage that is reported where two documents share it.
PASSAGE = 50
CHUNK = 1 << 19
_POS = U64((1 << 20) - 1)
RUNS = "k1 long, k2 int, g long, p int, o_lo int, o_hi int, span long"
#: Pieces of a run have the same columns; solo: no equal run was found for it so far.
PIECES = RUNS + ", solo boolean"
INTERVALS = "k1 long, k2 int, spans array<int>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, shares_passage boolean"
_ONE, _TWO = Powers(), Powers(0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_tokens(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of a text's bytes."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    c, down = prefix_hash(data, _TWO)
    return mix64((c[edge[1::2]] - c[edge[::2]]) * down[edge[::2]])


@dataclass(frozen=True)
class Unit:
    """What a suffix is made of, and how deep it is sorted. across: repeats inside one text don't count."""

    depth: int
    gram: int
    width: int
    across: bool
    least_bytes: int
    tokens: Callable[[np.ndarray], np.ndarray]


BYTES = Unit(DEPTH, GRAM, WIDTH, False, DEPTH, lambda data: data)
WORDS = Unit(PASSAGE, 16, 8, True, 2 * PASSAGE - 1, word_tokens)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(rows, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def runs(data: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """For each piece of a text: (anchor hash, anchor position, first and last window start, hash of the run's bytes) of its runs."""
    w = depth - gram + 1
    for base in range(0, len(data) - depth + 1, CHUNK):
        part = data[base : base + CHUNK + depth - 1]
        c, down = prefix_hash(part, _ONE)
        h = mix64((c[gram:] - c[:-gram]) * down[: len(part) - gram + 1])
        least = sliding_min((h & ~_POS) | np.arange(len(h), dtype=U64), w) & _POS
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        p = least[first].astype(np.int64)
        span = mix64((c[last + depth] - c[first]) * down[first])
        yield h[p], p + base, first + base, last + base, span


def _scan(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RUNS.split(", ")]
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in names]
            size = 0

            def flush() -> pa.RecordBatch:
                out = [np.concatenate(c) if c else np.zeros(0) for c in cols]
                for c in cols:
                    c.clear()
                kinds = [np.int64, np.int32, np.int64, np.int32, np.int32, np.int32, np.int64]
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == U64 else a.astype(k)) for a, k in zip(out, kinds)], names=names)

            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text")):
                if (buffer := text.as_buffer()) is None or buffer.size < unit.least_bytes:
                    continue
                for g, p, first, last, span in runs(unit.tokens(np.frombuffer(buffer, np.uint8)), unit.depth, unit.gram):
                    for c, a in zip(cols, (np.full(len(g), k1, np.int64), np.full(len(g), k2, np.int32), g, p, p - last, p - first, span)):
                        c.append(a)
                    size += len(g)
                if size > 200_000:
                    yield flush()
                    size = 0
            yield flush()

    return run


def _split(unit: Unit, width: int):
    """Pieces of runs: the windows whose offsets to the anchor share a quotient by width.

    The core of such a bucket, the depth - width + 1 tokens that all its windows contain, is a function of any of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, todo in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), batch.column("todo")):
                data = unit.tokens(np.frombuffer(text.as_buffer(), np.uint8))
                fields = todo.values
                g, p, o_lo, o_hi = (fields.field(x).to_numpy().astype(np.int64) for x in ("g", "p", "o_lo", "o_hi"))
                solo = fields.field("solo").to_numpy(zero_copy_only=False)
                order = np.argsort(p - o_hi, kind="stable")
                g, p, o_lo, o_hi, solo = g[order], p[order], o_lo[order], o_hi[order], solo[order]
                pieces = (p - o_hi) // CHUNK
                for at in np.split(np.arange(len(p)), np.flatnonzero(pieces[1:] != pieces[:-1]) + 1):
                    low, high = int((p[at] - o_hi[at]).min()), int((p[at] - o_lo[at]).max()) + unit.depth
                    c, down = prefix_hash(data[low:high], _TWO)
                    first, last = o_lo[at] // width, o_hi[at] // width
                    counts = last - first + 1
                    which = np.repeat(at, counts)
                    j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - first, counts)
                    lo, hi = np.maximum(o_lo[which], j * width), np.minimum(o_hi[which], j * width + width - 1)
                    here = p[which] - low

                    def hashed(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
                        return mix64((c[end] - c[begin]) * down[begin])

                    begin = here - j * width
                    core = mix64(hashed(begin, begin + unit.depth - width + 1) + g[which].view(U64) * U64(0xD1342543DE82EF95) + j.astype(U64) * U64(0x9E3779B97F4A7C15))
                    span = hashed(here - hi, here - lo + unit.depth)
                    n = len(which)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, k1, np.int64)),
                            pa.array(np.full(n, k2, np.int32)),
                            pa.array(core.view(np.int64)),
                            pa.array(p[which].astype(np.int32)),
                            pa.array(lo.astype(np.int32)),
                            pa.array(hi.astype(np.int32)),
                            pa.array(span.view(np.int64)),
                            pa.array(solo[which]),
                        ],
                        names=[x.split()[0] for x in PIECES.split(", ")],
                    )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted starts and ends of the maximal runs, as one flat array a text."""
    for batch in batches:
        spans = []
        for parts in batch.column("parts").to_pylist():
            out: list[int] = []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in parts):
                if out and lo <= out[-1]:
                    out[-1] = max(out[-1], hi)
                else:
                    out += [lo, hi]
            spans.append(out)
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(spans, pa.list_(pa.int32()))], names=["k1", "k2", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans, shared, copied in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("shared").to_pylist(), batch.column("copied").to_pylist()):
            data = memoryview(text.as_buffer() or b"")
            spans = spans or []
            sha, at, removed = hashlib.sha256(), 0, 0
            for lo, hi in zip(spans[::2], spans[1::2]):
                sha.update(data[at:lo])
                removed += hi - lo
                at = hi
            sha.update(data[at:])
            words = sum((shared or [])[1::2]) - sum((shared or [])[::2])
            if copied and len(data) >= WORDS.least_bytes and (n := len(word_tokens(np.frombuffer(data, np.uint8)))) >= PASSAGE:
                words = n
            out.append((len(data), removed, len(spans) // 2, sha.hexdigest(), words, words > 0))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[c.split()[0] for c in RESULT.split(", ")])


def _repeated(unit: Unit) -> Column:
    """Of a group with n pieces, of texts from `low` to `high`: whether it is a repeat."""
    return F.col("low") < F.col("high") if unit.across else F.col("n") > 1


def _counted(pieces: DataFrame, by: list[str], *more: Column) -> DataFrame:
    return pieces.groupBy(*by).agg(F.count("*").alias("n"), F.min("k1").alias("low"), F.max("k1").alias("high"), *more)


def _bounds(unit: Unit) -> tuple[Column, Column]:
    return (F.col("p") - F.col("o_hi")).alias("lo"), (F.col("p") - F.col("o_lo") + unit.depth).alias("hi")


def _digit(pieces: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """One pass over pieces (PIECES): (their intervals that are finished as repeats, what the next pass has to split by text)."""
    key = ["k1", "k2"]
    shared = _counted(pieces, ["g"]).filter(_repeated(unit)).select("g")
    left = written(pieces.join(shared, "g", "left_semi"), "open-pieces")
    discard(pieces)
    same = ["g", "span", "o_lo", "o_hi"]
    member = F.struct("k1", "k2", "p")
    groups = written(_counted(left, same, *[F.first(c).alias(c) for c in ("k1", "k2", "p", "solo")], F.min(member).alias("one"), F.max(member).alias("other")), "piece-groups")
    done = left.filter("solo").join(groups.filter(_repeated(unit)).select(*same), same, "left_semi").select(*key, *_bounds(unit))
    piece = lambda solo: F.struct("g", "p", "o_lo", "o_hi", solo.alias("solo")).alias("x")
    if unit.across:
        # pieces that only their own text repeats go on one by one; of the others a member from each of two texts, so that a piece of either meets another text
        alone = left.join(groups.filter(~_repeated(unit)).select(*same), same, "left_semi")
        wanted = alone.filter("solo").select("g").distinct()
        todo = alone.select("g", *key, piece(F.col("solo"))).distinct()
        two = groups.filter(_repeated(unit)).select("g", "o_lo", "o_hi", F.explode(F.array("one", "other")).alias("m")).select("g", "m.k1", "m.k2", "m.p", "o_lo", "o_hi")
        todo = todo.unionByName(two.select("g", *key, piece(F.lit(False)))).join(wanted, "g", "left_semi").select(*key, "x")
    else:
        # one member of each group of equal pieces goes on, where the core has a piece of its own
        lone = (F.col("n") == 1) & F.col("solo")
        todo = groups.join(groups.filter(lone).select("g").distinct(), "g", "left_semi").select(*key, piece(lone))
    # a text has at most one piece for each of its tokens, so its list is bounded by its length
    return done, todo.groupBy(*key).agg(F.collect_list("x").alias("todo"))


def repeated_spans(texts: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """INTERVALS: (k1, k2, spans) of each text with a repeated window; texts has k1, k2, text."""
    key = ["k1", "k2"]
    runs_ = texts.filter(F.octet_length("text") >= unit.least_bytes).mapInArrow(_scan(unit), RUNS).withColumn("solo", F.lit(True))
    found, pieces = [], written(runs_, "runs")
    for width in (unit.width, 1):
        done, todo = _digit(pieces, unit)
        found.append(done)
        again = join_small(texts, todo, key, "inner", F.size("todo") * 40 + 32, "open-texts")
        pieces = written(again.select(*key, "text", "todo").mapInArrow(_split(unit, width), PIECES), "pieces")
    # of width 1 a piece is a window and its core all of it: equal cores are the end
    twice = _counted(pieces, ["g"]).filter(_repeated(unit)).select("g")
    found.append(pieces.filter("solo").join(twice, "g", "left_semi").select(*key, *_bounds(unit)))
    # copies repeat each other's rows; distinct before anything is collected
    parts = found[0].unionByName(found[1]).unionByName(found[2]).distinct().groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    return parts.mapInArrow(_merge, INTERVALS)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text (RESULT)."""
    docs = _keyed(df, id_col, text_col)
    key, texts = ["k1", "k2"], docs.select("k1", "k2", "text")
    spans = written(repeated_spans(texts), "spans")
    shared = repeated_spans(texts, WORDS).withColumnRenamed("spans", "shared")
    copies = docs.groupBy(*key).agg((F.count("*") > 1).alias("copied")).filter("copied")
    marks = spans.join(shared, key, "full").join(copies, key, "full")
    row = F.coalesce(F.size("spans"), F.lit(0)) * 4 + F.coalesce(F.size("shared"), F.lit(0)) * 4 + 64
    rows = join_small(docs, marks, key, "left", row, "marks")
    return rows.select("doc_id", "text", "spans", "shared", F.coalesce("copied", F.lit(False)).alias("copied")).mapInArrow(_cut, RESULT)
