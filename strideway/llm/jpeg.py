"""Baseline JPEG media columns.

``decode`` parses markers, Huffman-decodes the baseline scan, dequantises the luminance DC coefficients and
gives the DC-only luminance thumbnail (one pixel per 8x8 block) in numpy, with the image's dimensions; chroma
components are decoded and skipped. ``encode`` stores bytes losslessly: one greyscale block a byte, all of
whose energy is its DC coefficient (the quantiser is 8, so the coefficient is the byte minus 128), hence the
thumbnail is the payload.

The decoder is general for baseline greyscale or interleaved scans with restart markers. Where the stream's own tables
give every DC category the same total width and AC only an end-of-block, each block has one width, and numpy
unpacks all blocks at once; ``encode`` writes such tables (9 bits a difference, 1 for the end of block).

Cases. Null or empty text: 64 bytes 0. A payload over MAX_BLOCKS is stored as several images, one after another.
Equal texts give equal values. Null id, ties and repeated rows: each row has its own result. Empty table: no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
#: Blocks across, and rows of blocks that one image holds at most (a side has 65,535 pixels).
ACROSS, DOWN = 64, 8191
MAX_BLOCKS = ACROSS * DOWN
#: DC categories 0..8 with code lengths 9..1, so code and magnitude bits make 9 together.
_DC_LENGTHS = {cat: 9 - cat for cat in range(9)}
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


# --- tables -------------------------------------------------------------------------------------


def canonical(counts: list[int], symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a DHT segment."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    by = sorted(lengths, key=lambda s: (lengths[s], s))
    return _segment(0xC4, bytes([kind]) + bytes(sum(lengths[s] == n for s in by) for n in range(1, 17)) + bytes(by))


def _code_values() -> np.ndarray:
    """The 10 bits of a block for each difference -255..255: code, magnitude, end of block."""
    by = sorted(_DC_LENGTHS, key=lambda s: (_DC_LENGTHS[s], s))
    table = {sym: (length, code) for (length, code), sym in canonical([sum(_DC_LENGTHS[s] == n for s in by) for n in range(1, 17)], bytes(by)).items()}
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        _, code = table[cat]
        out[d + 255] = (((code << cat) | (d if d >= 0 else d + (1 << cat) - 1)) << 1) | 0
    return out


_CODES = _code_values()


def _image(data: np.ndarray) -> bytes:
    """One image of a multiple of 64 bytes, MAX_BLOCKS at most."""
    down = len(data) // ACROSS
    dc = data.astype(np.int16) - 128
    diff = np.empty_like(dc)
    diff[0], diff[1:] = dc[0], dc[1:] - dc[:-1]
    codes = _CODES[diff + 255].astype(np.uint64).reshape(-1, 4)
    # four blocks are 40 bits
    word = (codes[:, 0] << np.uint64(30)) | (codes[:, 1] << np.uint64(20)) | (codes[:, 2] << np.uint64(10)) | codes[:, 3]
    raw = np.ascontiguousarray(word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
    scan = raw.replace(b"\xff", b"\xff\x00")
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
            _segment(0xDB, bytes([0]) + bytes([8]) * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, down * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0])),
            _dht(0x00, _DC_LENGTHS),
            _dht(0x10, {0: 1}),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            scan,
            b"\xff\xd9",
        ]
    )


def encode(payload: bytes) -> bytes:
    """payload (a positive multiple of 64 bytes) as one image, or several in a row."""
    data = np.frombuffer(payload, np.uint8)
    if not len(data) or len(data) % UNIT:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    return b"".join(_image(data[k : k + MAX_BLOCKS]) for k in range(0, len(data), MAX_BLOCKS))


# --- decoding -----------------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def read(self, n: int) -> int:
        value = 0
        for b in self.data[self.at : self.at + n].tolist():
            value = value << 1 | b
        if self.at + n > len(self.data):
            raise ValueError("the scan ends early")
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.read(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")


def _magnitude(bits: int, cat: int) -> int:
    return bits if not cat or bits >> (cat - 1) else bits - (1 << cat) + 1


def _scan_general(parts: list[bytes], comps: list[dict], mcus: int, across: int, restart: int) -> None:
    done = 0
    for part in parts:
        bits, last = _Bits(part), [0] * len(comps)
        for mcu in range(done, min(mcus, done + (restart or mcus))):
            for i, c in enumerate(comps):
                for v in range(c["v"]):
                    for h in range(c["h"]):
                        cat = bits.symbol(c["dc"])
                        last[i] += _magnitude(bits.read(cat), cat)
                        k = 1
                        while k < 64:
                            s = bits.symbol(c["ac"])
                            if s == 0:
                                break
                            bits.read(s & 15)
                            k += (s >> 4) + 1
                        c["plane"][mcu // across * c["v"] + v, mcu % across * c["h"] + h] = last[i]
        done += restart or mcus


def _fixed_width(c: dict) -> tuple[int, np.ndarray] | None:
    """(bits a block, difference by those bits), if the tables make all blocks of one width."""
    widths = {length + sym for (length, _), sym in c["dc"].items()}
    ac = c["ac"]
    if len(widths) != 1 or len(ac) != 1 or next(iter(ac.values())) != 0 or next(iter(ac))[1] != 0:
        return None
    width, end = widths.pop(), next(iter(ac))[0]
    if width > 12:
        return None
    table = np.full(1 << width, 1 << 14, np.int16)
    for (length, code), cat in c["dc"].items():
        for bits in range(1 << cat):
            table[code << cat | bits] = _magnitude(bits, cat)
    return width + end, table


def _scan_fixed(part: bytes, c: dict, blocks: int, fixed: tuple[int, np.ndarray]) -> None:
    total, table = fixed
    need = -(-blocks * total // 8)
    if len(part) < need:
        raise ValueError("the scan ends early")
    end = next(iter(c["ac"]))[0]
    if total == 10 and blocks % 4 == 0:
        data = np.zeros((blocks // 4, 8), np.uint8)
        data[:, 3:] = np.frombuffer(part, np.uint8, need).reshape(-1, 5)
        word = data.view(">u8").ravel().astype(np.uint64)
        values = np.empty((blocks // 4, 4), np.uint64)
        for k in range(4):
            values[:, k] = (word >> np.uint64(30 - 10 * k)) & np.uint64(1023)
        values = values.ravel()
    else:
        bits = np.unpackbits(np.frombuffer(part, np.uint8, need))[: blocks * total].reshape(blocks, total)
        values = bits.astype(np.int64) @ (1 << np.arange(total - 1, -1, -1, dtype=np.int64))
    diff = table[(values >> type(values[0])(end)).astype(np.int64)]
    if (diff == 1 << 14).any():
        raise ValueError("no such code")
    c["plane"].ravel()[:] = np.cumsum(diff, dtype=np.int64)


def decode_one(data: bytes, at: int = 0) -> tuple[int, int, np.ndarray, int]:
    """(width, height, luminance thumbnail as uint8, where the next image may begin)."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    quant: dict[int, int] = {}
    huff: dict[int, dict] = {}
    comps: dict[int, dict] = {}
    width = height = restart = 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            raise ValueError("no scan")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 129 if wide else 65
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("8 bits a sample only")
            for k in range(n):
                cid, hv, q = body[6 + 3 * k : 9 + 3 * k]
                comps[cid] = {"h": hv >> 4, "v": hv & 15, "q": q, "first": k == 0}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = list(body[k + 1 : k + 17])
                huff[body[k]] = canonical(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            names = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            break
    # the entropy-coded part ends at the first marker that is neither a stuffed byte nor a restart
    end, parts, begin = at, [], at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise ValueError("no end of image")
        if data[end + 1] == 0:
            end += 2
        elif 0xD0 <= data[end + 1] <= 0xD7:
            parts.append(data[begin:end])
            end += 2
            begin = end
        elif data[end + 1] == 0xFF:
            end += 1
        else:
            parts.append(data[begin:end])
            break
    if len(names) != len(comps):
        raise ValueError("interleaved scans only")
    parts = [p.replace(b"\xff\x00", b"\xff") for p in parts]
    scan = []
    for cid, tables in names:
        scan.append(comps[cid] | {"dc": huff[tables >> 4], "ac": huff[0x10 | (tables & 15)]})
    if len(scan) == 1:
        scan[0]["h"] = scan[0]["v"] = 1
    hmax, vmax = max(c["h"] for c in scan), max(c["v"] for c in scan)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    for c in scan:
        c["plane"] = np.zeros((down * c["v"], across * c["h"]), np.int64)
    fixed = _fixed_width(scan[0]) if len(scan) == 1 and not restart else None
    if fixed:
        _scan_fixed(parts[0], scan[0], across * down, fixed)
    else:
        _scan_general(parts, scan, across * down, across, restart)
    luma = next(c for c in scan if c["first"])
    pixels = np.clip(np.floor_divide(luma["plane"] * quant[luma["q"]] + 4, 8) + 128, 0, 255).astype(np.uint8)
    rows, cols = -(-height * luma["v"] // (8 * vmax)), -(-width * luma["h"] // (8 * hmax))
    if data[end : end + 2] == b"\xff\xd9":
        end += 2
    return width, height, pixels[:rows, :cols], end


def decode(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, thumbnail) of each image in data."""
    out, at = [], 0
    while at < len(data):
        width, height, thumb, at = decode_one(data, at)
        out.append((width, height, thumb))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which cells of an 8x8 grid of means lie above the mean of the grid."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)[:8].clip(0, thumb.shape[0] - 1)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)[:8].clip(0, thumb.shape[1] - 1)
    if thumb.shape[0] >= 8 and thumb.shape[1] >= 8:
        sums = np.add.reduceat(np.add.reduceat(thumb, rows, axis=0, dtype=np.int64), cols, axis=1)
        areas = np.outer(np.diff([*rows, thumb.shape[0]]), np.diff([*cols, thumb.shape[1]]))
        grid = sums * 1_000_000 // areas
    else:
        grid = thumb[np.ix_(rows, cols)].astype(np.int64) * 1_000_000
    bits = (grid * 64 > grid.sum()).ravel()
    return np.packbits(bits).tobytes().hex()


# --- operator -----------------------------------------------------------------------------------


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(t) for t in texts], "media": [encode(padded(t)) for t in texts]})


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for n, media in zip(pdf["n_bytes"], pdf["media"]):
            images = decode(media)
            payload = b"".join(t.tobytes() for _, _, t in images)
            width, height = images[0][0], sum(h for _, h, _ in images)
            feature = f"{width}x{height}:" + "".join(thumbnail_hash(t) for _, _, t in images)
            out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, width, height))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")[1:]])
        frame.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
        yield frame


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a JPEG."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(_store, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, digests and thumbnail hash of what each media value holds (FEATURES)."""
    return media.mapInPandas(_features, FEATURES)
