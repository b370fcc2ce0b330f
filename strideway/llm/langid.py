"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a binary classifier a bit (logistic regression on hashed byte
trigrams of the lower-cased text, letters and spaces only) predicts which side of the bit's split of
the languages a text is on. Decoding is loss-weighted: the language whose codeword has the least
logistic loss against the margins, bits weighted by how well their classifier did in training. A
text whose two nearest codewords are close is flagged as ambiguous.

Up to EXHAUSTIVE languages take the exhaustive code (every split once), more take the best of some seeded random codes.
Classifiers are fitted on a bounded sample: about TRAIN_DOCS different labelled texts in all, the same number a language,
chosen by a hash of the text; only their sparse counts reach the driver. Prediction
reads whole texts, once, with a model of some hundred kB.

Cases. Null text, or one without a letter: ``und``, score 0. No labelled row: all ``und``. One learned language: it, score 1.
Null lang: not learned from. Null id: in the held-out fifth. Equal texts have equal predictions; ties of loss go to the first
language in order. Long texts: read in pieces of CHUNK bytes. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import slices

#: Labelled texts that the classifiers are fitted on, in expectation; the seed of their choice.
TRAIN_DOCS, TRAIN_SEED = 3000, 5
DIMS, TRAIN_DIMS = 1 << 13, 2048
EXHAUSTIVE = 5
STEPS = 60
CHUNK = 1 << 20
#: Least difference of the decoding losses (per bit weight) of the two nearest codewords.
AMBIGUOUS = 0.5
UND = "und"
PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"

#: Word characters that aren't decimal digits: letters, and some numbers that str.isalpha tells from letters.
_MAYBE = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1; each column splits the languages."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        bits = (1 << (n - 1)) - 1
        return np.array([[1 if i == 0 else 1 - 2 * ((b + 1) >> (i - 1) & 1) for b in range(bits)] for i in range(n)], np.int8)
    rng = np.random.default_rng(seed)
    bits, best = max(15, int(np.ceil(10 * np.log2(n)))), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        same = np.abs(code.sum(0)) == n
        code[0, same] *= -1
        near = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or near > best[0]:
            best = (near, code)
    return best[1]


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's categories L* occurs; digits of any kind (superscripts, fractions, circled ones) aren't letters."""
    return text is not None and any(m[0].isalpha() for m in _MAYBE.finditer(text))


def _clean(text: str) -> np.ndarray:
    """Bytes of the lower-cased text: letters, and one space for whatever lies between them."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_PLAIN), np.uint8)
    space = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return raw[keep]


def _grams(b: np.ndarray) -> np.ndarray:
    """Hashed trigram numbers, one by position."""
    x = b[:-2].astype(np.uint32) << np.uint32(16)
    x |= b[1:-1].astype(np.uint32) << np.uint32(8)
    x |= b[2:]
    x *= np.uint32(2654435761)
    x >>= np.uint32(32 - DIMS.bit_length() + 1)
    return x


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(trigram numbers, their shares) of a whole text."""
    b = _clean(text)
    c = np.zeros(DIMS, np.int64)
    for k in range(0, max(1, len(b) - 2), CHUNK):
        c += np.bincount(_grams(b[k : k + CHUNK + 2]), minlength=DIMS)
    at = np.flatnonzero(c)
    return at, (c[at] / c.sum()).astype(np.float32)


@dataclass
class Ecoc:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    alpha: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """Margin of each text and bit, one row a text."""
        out = np.zeros((len(texts), self.code.shape[1]), np.float64)
        held: list[np.ndarray] = []
        first = size = 0

        def flush(to: int) -> None:
            nonlocal held, first, size
            if held:
                lens = np.array([len(b) for b in held])
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                scores = self.weights[_grams(np.concatenate(held))]
                cross = np.concatenate([starts[1:] - 1, starts[1:] - 2])
                scores[cross] = 0
                out[first:to] = np.add.reduceat(scores, starts, axis=0, dtype=np.float64) / (lens - 2)[:, None]
            held, first, size = [], to, 0

        for i, text in enumerate(texts):
            b = _clean(text)
            if len(b) > CHUNK:
                flush(i)
                total = np.zeros(out.shape[1])
                for k in range(0, len(b) - 2, CHUNK):
                    total += self.weights[_grams(b[k : k + CHUNK + 2])].sum(0, dtype=np.float64)
                out[i], first = total / (len(b) - 2), i + 1
                continue
            if size + len(b) > CHUNK:
                flush(i)
            held.append(b)
            size += len(b)
        flush(len(texts))
        return out + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each row of margins."""
        n = len(self.langs)
        if n == 1:
            return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.alpha).sum(2)
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        share = np.exp(-(loss - ordered[:, :1]))
        return best, 1 / share.sum(1), ordered[:, 1] - ordered[:, 0] < AMBIGUOUS

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        some = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        langs, scores, flags = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if some:
            best, score, ambiguous = self.decode(self.margins([texts[i] for i in some]))
            for i, b, s, a in zip(some, best.tolist(), score.tolist(), ambiguous.tolist()):
                langs[i], scores[i], flags[i] = self.langs[b], s, a
        return langs, scores, flags


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Ecoc:
    """The classifiers from (trigram numbers, shares, lang) by accelerated gradient descent, on the TRAIN_DIMS trigrams whose shares vary most."""
    langs = sorted({r[2] for r in rows})
    code = codebook(len(langs))
    bits = code.shape[1]
    if not bits:
        return Ecoc(langs, code, np.zeros((DIMS, 0), np.float32), np.zeros(0), np.zeros(0))
    sums, squares = np.zeros(DIMS), np.zeros(DIMS)
    for at, share, _ in rows:
        sums[at] += share
        squares[at] += share.astype(np.float64) ** 2
    mean = sums / len(rows)
    deviation = np.sqrt(np.maximum(squares / len(rows) - mean**2, 0))
    used = np.sort(np.argsort(-deviation, kind="stable")[:TRAIN_DIMS])
    place = np.full(DIMS, -1)
    place[used] = np.arange(len(used))
    scale = (1 / (deviation[used] + 1e-4)).astype(np.float32)
    mean = mean[used].astype(np.float32)
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, (at, share, _) in enumerate(rows):
        known = place[at] >= 0
        x[i, place[at[known]]] = share[known]
    x -= mean
    x *= scale
    target = code[[langs.index(r[2]) for r in rows]].astype(np.float32)
    # each language weighs the same
    weight = np.array([1 / sum(r[2] == lang for r in rows) for lang in langs], np.float32)[[langs.index(r[2]) for r in rows]] / len(langs)
    norms = np.einsum("ij,ij->i", x, x)
    step = np.float32(4 / float(norms.mean() + 1))
    w, b = np.zeros((len(used), bits), np.float32), np.zeros(bits, np.float32)
    vw, vb = w.copy(), b.copy()
    for _ in range(STEPS):
        f = x @ vw + vb
        g = -target / (1 + np.exp(np.clip(target * f, -30, 30))) * weight[:, None]
        nw, nb = vw - step * (x.T @ g + np.float32(1e-3) * vw), vb - step * g.sum(0)
        vw, vb = nw + np.float32(0.9) * (nw - w), nb + np.float32(0.9) * (nb - b)
        w, b = nw, nb
    f = x @ w + b
    right = (weight[:, None] * (f * target > 0)).sum(0)
    spread = np.float32(2) / (np.abs(f).mean(0) + np.float32(1e-6))  # margins of a size that the loss can tell apart
    weights = np.zeros((DIMS, bits), np.float32)
    weights[used] = (w * scale[:, None]) * spread
    bias = (b - (mean * scale) @ w) * spread
    alpha = np.clip(2 * right - 1, 0.01, 1).astype(np.float64)
    return Ecoc(langs, code, weights, bias.astype(np.float64), alpha / alpha.sum() * bits)


def held_out(id_col: Column) -> Column:
    """The fifth of the ids that is never learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        pairs = [(*counts(t), lang) for t, lang in zip(texts, langs) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32())), pa.array([p[2] for p in pairs], pa.string())], names=["at", "share", "lang"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Ecoc:
    """Classifiers from the labelled rows outside the held-out fifth."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([])
    each = train_docs / len(sizes)
    share = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, each / n))])[F.col("lang")]
    # by the hash of the text, and each chosen text once: the sample is the same for any plan, and a hot group of copies is one row
    rows = rows.withColumn("h", F.xxhash64(F.lit(TRAIN_SEED), "text"))
    chosen = rows.filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = chosen.select("text", "lang").mapInArrow(_count_rows, "at array<int>, share array<float>, lang string").toArrow()
    at, share = got.column("at").combine_chunks(), got.column("share").combine_chunks()
    if isinstance(at, pa.ChunkedArray):
        at, share = pa.concat_arrays(at.chunks), pa.concat_arrays(share.chunks)
    ends = at.offsets.to_numpy()
    numbers, shares = at.values.to_numpy().astype(np.int32), share.values.to_numpy()
    parts = [(numbers[a:b], shares[a:b], lang) for a, b, lang in zip(ends[:-1], ends[1:], got.column("lang").to_pylist())]
    return fit(sorted(parts, key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes())))


def predict(df: DataFrame, model: Ecoc, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PREDICTIONS of every row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores, flags = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PREDICTIONS)


def keep_identified(df: DataFrame, model: Ecoc, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose language is recognised: those predicted ``und`` and those whose nearest codewords are ambiguous go.

    Null texts and texts without a letter go, repeated rows and ties are judged alike, long texts by the whole, an empty table stays empty; other columns
    of any name and type are kept. Where no language was learned nothing can be ambiguous, and every text with a letter stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else str(t) for t in batch.column(text_col).to_pylist()]
            if model.langs:
                langs, _, ambiguous = model.predict(texts)
                keep = [x != UND and not a for x, a in zip(langs, ambiguous)]
            else:
                keep = [has_letter(t) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(df, train(df, id_col, text_col, lang_col), id_col, text_col)
