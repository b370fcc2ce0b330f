"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts and items are sequences of words (lower-cased, split at ASCII white space). A document holds an item if some stretch of its words is within
``max_edits`` word edits of the whole item (SHARE of its words, rounded down).

CGK: a walk copies the word it stands on and steps on or stays, as a random bit for (repeat, step, word) says; sequences at a small edit distance then
agree in most steps, since walks that have met stay together until the next edit. A repeat samples SAMPLES steps of the walk over an
item-sized window; equal samples make window and item a candidate. REPEATS repeats find an item at the limit of its edits with probability TARGET or more (the tests
measure it by length). Walks drift further apart the longer they are, so items of more than TILE words are looked up by tiles of equal length: of t tiles at least one
has at most a t-th of the edits, and it is found as an item of its length is. Tiles are taken in classes of similar length, so that samples spread over the whole
window. A candidate is verified by the exact edit distance of the whole item to the best stretch near where the tile's window puts it.

Windows start at every word of a document that can be the start of a match at all: a stretch within k edits of an item of L words
has at least L - 2 - 3k of its three-word grams (the q-gram lemma; the same for a tile and its share of the edits), so windows with fewer benchmark grams are passed over without loss.

Items of fewer than MIN_WORDS words, such as "yes" or "the second one", stand in most documents by chance. They are matched exactly, by whole lines: a line of a
document, or all of it, that has just the item's words.

The benchmark is the stated query set: it goes to the executors in blocks of at most BLOCK items, one document at a
time, so neither hot sources nor copies matter and nothing is shuffled. Of one block all documents are read. Of more, the documents are read once against a bitmap of the grams and short items of all
blocks, which loses no match, and only what is left, written, is read for each block.

Cases. Null or empty text: clean. Null items and those without a word: never matched. Equal items: each reported. Null ids: reported as null. Repeated rows:
each reported. Ties between stretches: the first of the least distance. Empty tables: no rows. Long texts: whole. Other columns are ignored by the
report and kept by the filter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import U64, Powers, mix64, prefix_hash, slices, written

SHARE, MIN_WORDS, GRAM = 0.15, 5, 3
SAMPLES, REPEATS, TARGET = 4, 32, 0.95
#: Words of an item that are looked up as one; up to this length SAMPLES and REPEATS hold TARGET.
TILE = 60
BLOCK = 20_000
#: Bits (as a power of two) of the bitmap of several blocks: 16 MB, with under 4 % of all grams let through by chance for 5 million of them.
SIEVE_BITS = 27
MATCHES = "doc_id long, item_id long, n_edits long, start_word long, n_words long"
_Q = U64(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = Powers()
_BITS = 20
#: Characters that are scanned at once, and windows that walk at once.
_CHARS, _WINDOWS = 1 << 20, 20_000


def words_of(text: str) -> np.ndarray:
    """A 64-bit hash for each word."""
    return words_at(text)[0]


def words_at(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a 64-bit hash for each word, the byte where it starts, the text's bytes)."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), data
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(data)]])
    if not len(edge):
        return np.zeros(0, U64), np.zeros(0, np.int64), data
    c, down = prefix_hash(data, _POWERS)
    return mix64((c[edge[1::2]] - c[edge[::2]]) * down[edge[::2]]), edge[::2], data


def max_edits(n: int) -> int:
    """Word edits allowed for an item of n words: few enough that the q-gram lemma asks for two grams at least."""
    return max(0, min(int(n * SHARE), (n - GRAM - 1) // GRAM))


def grams(w: np.ndarray) -> np.ndarray:
    if len(w) < GRAM:
        return np.zeros(0, U64)
    s = w[: len(w) - GRAM + 1].copy()
    for k in range(1, GRAM):
        s = s * _Q + w[k : len(w) - GRAM + 1 + k]
    return mix64(s)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edits between item and any stretch of text, end of the first such stretch): Sellers' recurrence, a row an item word."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # insertions from the left
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class SizeClass:
    """Tiles of similar length with the LSH tables of each repeat."""

    least: int
    most: int
    need: int
    reach: int
    seeds: np.ndarray  # repeats x steps
    picks: np.ndarray  # sampled steps by repeat
    tables: list[tuple[np.ndarray, np.ndarray]]  # sorted keys, tile numbers


def walk_keys(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The keys (repeats x windows) of windows w[start:end]: CGK's walks, hashed at the sampled steps; past its end a window is blank."""
    at = np.repeat(starts[None], len(seeds), 0)
    key = np.zeros(at.shape, U64)
    last = len(w) - 1
    wanted = np.zeros((len(seeds), int(picks.max()) + 1), bool)
    for r, steps in enumerate(picks):
        wanted[r, steps] = True
    for step in range(wanted.shape[1]):
        inside = at < ends
        word = w[np.minimum(at, last)] * inside
        rows = np.flatnonzero(wanted[:, step])
        if len(rows):
            key[rows] = mix64(key[rows] * _Q + word[rows] + U64(step + 1))
        at += ((word * seeds[:, step, None]) >> U64(63)).view(np.int64) & inside
    return key


class Benchmark:
    """Items prepared for scanning: gram table, tiles and size classes of tiles."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        words = [(i, words_of(t)) for i, t in items if t is not None]
        self.items = [(i, w) for i, w in words if len(w)]
        # items that are looked up by line: their words' bytes to their numbers
        self.short: dict[bytes, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) < MIN_WORDS:
                self.short.setdefault(w.tobytes(), []).append(k)
        all_grams = [grams(w) for _, w in self.items if len(w) >= MIN_WORDS]
        self.grams = np.unique(np.concatenate(all_grams)) if all_grams else np.zeros(0, U64)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.grams >> U64(64 - _BITS)] = True
        # (item number, first word, words, edits) of each tile
        self.tiles: list[tuple[int, int, np.ndarray, int]] = []
        for i, (_, w) in enumerate(self.items):
            if len(w) < MIN_WORDS:
                continue
            t = -(-len(w) // TILE)
            cuts = [len(w) * j // t for j in range(t + 1)]
            self.tiles += [(i, low, w[low:high], max_edits(len(w)) // t) for low, high in zip(cuts, cuts[1:])]
        self.tile_item = np.array([x[0] for x in self.tiles], np.int64)
        self.tile_first = np.array([x[1] for x in self.tiles], np.int64)
        self.classes: list[SizeClass] = []
        order = sorted(range(len(self.tiles)), key=lambda k: len(self.tiles[k][2]))
        while order:
            least = len(self.tiles[order[0]][2])
            most = max(least, int(least * 1.2))
            mine = [k for k in order if len(self.tiles[k][2]) <= most]
            order = order[len(mine) :]
            # a walk of 2 n steps has come to about the end of n words
            steps = 2 * least
            seeds = rng.integers(0, 1 << 63, (REPEATS, steps), dtype=np.uint64) * U64(2) + U64(1)
            picks = np.array([np.sort(rng.choice(steps, min(SAMPLES, steps), replace=False)) for _ in range(REPEATS)])
            lengths = [len(self.tiles[k][2]) for k in mine]
            edits = [self.tiles[k][3] for k in mine]
            need = min(n - GRAM + 1 - GRAM * e for n, e in zip(lengths, edits))
            flat = np.concatenate([self.tiles[k][2] for k in mine])
            ends = np.cumsum(lengths)
            tables = []
            # tiles and windows are cut to the class's least length, so that both end alike
            for keys in walk_keys(flat, ends - lengths, ends - lengths + least, seeds, picks):
                by = np.argsort(keys, kind="stable")
                tables.append((keys[by], np.array(mine)[by]))
            self.classes.append(SizeClass(least, max(lengths), need, max(n + e for n, e in zip(lengths, edits)), seeds, picks, tables))

    def candidates(self, w: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
        """Rows (item number, where it would start, window's start) of windows that share a sample with a tile; doc_ends: each word's document's end."""
        none = np.zeros((0, 3), np.int64)
        g = grams(w)
        at = np.flatnonzero(self.bitmap[g >> U64(64 - _BITS)])
        if len(at) and len(self.grams):
            at = at[self.grams[np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)] == g[at]]
        if not len(at):
            return none
        out = [none]
        for k in self.classes:
            if len(at) < k.need:
                continue
            # a window holds `need` grams if, from its first one, the need-th lies within reach; it starts up to reach before the last of them
            close = at[k.need - 1 :] - at[: len(at) - k.need + 1] <= k.reach - GRAM
            first, last = at[: len(close)][close], at[k.need - 1 :][close]
            low, high = np.maximum(last - (k.reach - GRAM), 0), first
            edge = np.zeros(len(w) + 1, np.int64)
            np.add.at(edge, low, 1)
            np.add.at(edge, high + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            for base in range(0, len(starts), _WINDOWS):
                some = starts[base : base + _WINDOWS]
                for keys, (table, tile) in zip(walk_keys(w, some, np.minimum(some + k.least, doc_ends[some]), k.seeds, k.picks), k.tables):
                    lo, hi = np.searchsorted(table, keys), np.searchsorted(table, keys, side="right")
                    met = np.flatnonzero(hi > lo)
                    if len(met):
                        counts = (hi - lo)[met]
                        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - lo[met], counts)
                        which, start = tile[inner], np.repeat(some[met], counts)
                        out.append(np.stack([self.tile_item[which], start - self.tile_first[which], start], 1))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item number, edits, start word, words) of each item that it holds; the best stretch of each."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        lowered = [(t or "").lower() for t in texts]
        w, at, data = words_at("\n".join(lowered))
        if not len(w):
            return out
        sizes = np.array([len(t.encode("utf-8", "replace")) + 1 for t in lowered])
        first = np.searchsorted(at, np.cumsum(sizes) - sizes)  # each text's first word
        ends = np.concatenate([first[1:], [len(w)]])
        found = self.candidates(w, np.repeat(ends, ends - first))
        docs = np.searchsorted(first, found[:, 2], side="right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for (i, s, _), d in zip(found.tolist(), docs.tolist()):
            item = self.items[i][1]
            k = max_edits(len(item))
            if s <= done.get((d, i), s - 1):
                continue  # the stretch that was compared before holds all that starts here
            done[d, i] = s + k
            low, high = max(int(first[d]), s - 2 * k), min(int(ends[d]), s + len(item) + 3 * k + 1)
            part = w[low:high]
            if np.isin(item, part).sum() < len(item) - k:
                continue
            edits, end = edit_distance(item, part)
            if edits <= k and ((d, i) not in best or edits < best[d, i][0]):
                _, begin = edit_distance(item[::-1], part[:end][::-1])
                best[d, i] = (edits, low + end - begin - int(first[d]), begin)
        if self.short:
            for d, text in enumerate(lowered):
                for i, x in self.by_line(text).items():
                    best[d, i] = x
        for (d, i), x in sorted(best.items()):
            out[d].append((i, *x))
        return out

    def by_line(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Of each short item that is a line of the text, or all of it: (0 edits, start word, words) of the first such line."""
        found: dict[int, tuple[int, int, int]] = {}
        start = 0
        lines = text.split("\n")
        for line in lines:
            w = words_of(line)
            for i in self.short.get(w.tobytes(), []) if len(w) < MIN_WORDS else []:
                found.setdefault(i, (0, start, len(w)))
            start += len(w)
        if len(lines) > 1 and start < MIN_WORDS:
            for i in self.short.get(words_of(text).tobytes(), []):
                found.setdefault(i, (0, 0, start))
        return found

    def matches_in(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, int]]]:
        """matches_of, some texts at a time."""
        held: list[str | None] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= _CHARS:
                yield from self.matches_of(held)
                held, size = [], 0
        yield from self.matches_of(held)


class Sieve:
    """What documents must have to hold an item of any block: two grams of some item, or a line that a short item is."""

    def __init__(self, bits: int = SIEVE_BITS) -> None:
        self.shift, self.bitmap, self.short = U64(64 - bits), np.zeros((1 << bits) // 8, np.uint8), False

    def add(self, bench: Benchmark) -> None:
        at = np.unique(bench.grams >> self.shift)
        np.bitwise_or.at(self.bitmap, at >> U64(3), U64(1).astype(np.uint8) << (at & U64(7)).astype(np.uint8))
        self.short = self.short or bool(bench.short)

    def holds(self, text: str | None) -> bool:
        w = words_of((text or "").lower())
        if self.short and len(w):
            return True  # lines are cheap to look up, so all documents go on
        at = grams(w) >> self.shift
        # an item has at most max_edits edits, which leave two grams or more; an item of five or six words allows none and has three
        return int((self.bitmap[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1).sum()) >= 2


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> Iterator[Benchmark]:
    """The benchmark in prepared blocks of about `block` items; one of them is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    n = max(1, -(-rows.count() // block))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield Benchmark(sorted(((r["i"], r["t"]) for r in rows.filter(part == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


def _filtered(df: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of df for whose texts, some at a time, keep gives true values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(list(keep(batch.column(text_col).to_pylist())), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _sieved(df: DataFrame, benchmark: DataFrame, text_col: str, block: int) -> Sieve | None:
    """The sieve of a benchmark of several blocks."""
    if benchmark.count() <= block:
        return None
    sieve = Sieve()
    for bench in blocks(benchmark, block=block):
        sieve.add(bench)
    return sieve


def find_items(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """MATCHES: one row for each document and benchmark item that it holds."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if sieve := _sieved(docs, benchmark, "text", block):
        docs = written(_filtered(docs, "text", lambda texts: map(sieve.holds, texts)), "sieved")

    def scan(bench: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for doc_id, found in zip(batch.column("doc_id").to_pylist(), bench.matches_in(batch.column("text").to_pylist())):
                    rows += [(doc_id, bench.items[i][0], edits, start, n) for i, edits, start, n in found]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in MATCHES.split(", ")])

        return run

    out = None
    for bench in blocks(benchmark, block=block):
        part = docs.mapInArrow(scan(bench), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of df, all columns, that hold no benchmark item."""
    clean = lambda bench: lambda texts: (not m for m in bench.matches_in(texts))
    if (sieve := _sieved(df, benchmark, text_col, block)) is None:
        for bench in blocks(benchmark, block=block):
            df = _filtered(df, text_col, clean(bench))
        return df
    doubtful = written(_filtered(df, text_col, lambda texts: map(sieve.holds, texts)), "sieved")
    for bench in blocks(benchmark, block=block):
        doubtful = _filtered(doubtful, text_col, clean(bench))
    return _filtered(df, text_col, lambda texts: (not sieve.holds(t) for t in texts)).unionByName(doubtful)
