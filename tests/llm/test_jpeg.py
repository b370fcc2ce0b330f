import hashlib
import struct
import zlib

import numpy as np
import pytest

from strideway.llm import jpeg


@pytest.mark.parametrize("n", [64, 128, 640, 6400, 64 * 8191 * 2 + 64])
def test_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    images = jpeg.decode(jpeg.encode(data))
    assert b"".join(t.tobytes() for *_, t in images) == data
    assert images[0][0] == 512


def write_general(planes, sampling, quants, restart=0, full=True):
    """A baseline image with standard-like variable tables; planes hold quantised DC, one random AC run a block."""
    dc_len = {0: 2, 1: 3, 2: 3, 3: 3, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: 8, 10: 9, 11: 10}
    ac_len = {0x00: 2, 0x01: 2, 0x12: 3, 0xF0: 4, 0x23: 5}

    def codes(lengths):
        by = sorted(lengths, key=lambda s: (lengths[s], s))
        return {s: (n, c) for (n, c), s in jpeg.canonical([sum(lengths[s] == n for s in by) for n in range(1, 17)], bytes(by)).items()}

    dc, ac = codes(dc_len), codes(ac_len)
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    down, across = planes[0].shape[0] // sampling[0][1], planes[0].shape[1] // sampling[0][0]
    rng, chunks, bits, last = np.random.default_rng(1), [], [], [0] * len(planes)

    def put(value, n):
        bits.extend((value >> k) & 1 for k in range(n - 1, -1, -1))

    def flush():
        while len(bits) % 8:
            bits.append(1)
        chunks.append(np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00"))
        bits.clear()

    for mcu in range(down * across):
        if restart and mcu and mcu % restart == 0:
            flush()
            last = [0] * len(planes)
        for i, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    d = int(planes[i][mcu // across * v + y, mcu % across * h + x]) - last[i]
                    last[i] += d
                    cat = abs(d).bit_length()
                    put(dc[cat][1], dc[cat][0])
                    put(d if d >= 0 else d + (1 << cat) - 1, cat)
                    for s in rng.choice([0x01, 0x12, 0xF0, 0x23], rng.integers(0, 3)):
                        put(ac[int(s)][1], ac[int(s)][0])
                        put(1, int(s) & 15)
                    put(ac[0][1], ac[0][0])
    flush()
    seg = jpeg._segment
    out = b"\xff\xd8" + b"".join(seg(0xDB, bytes([k]) + bytes([q]) * 64) for k, q in enumerate(quants))
    out += seg(0xC0, struct.pack(">BHHB", 8, down * vmax * 8 - 3, across * hmax * 8 - 5, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, i]) for i, (h, v) in enumerate(sampling)))
    out += jpeg._dht(0, dc_len) + jpeg._dht(0x10, ac_len)
    if restart:
        out += seg(0xDD, struct.pack(">H", restart))
    out += seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    return out + b"".join(c + (bytes([0xFF, 0xD0 + k % 8]) if k < len(chunks) - 1 else b"") for k, c in enumerate(chunks)) + b"\xff\xd9"


@pytest.mark.parametrize("sampling,restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_general_baseline_images(sampling, restart):
    rng = np.random.default_rng(5)
    planes = [rng.integers(-60, 60, (4 * v, 6 * h)) for h, v in sampling]
    quants = [7, 11, 3][: len(planes)]
    (image,) = jpeg.decode(write_general(planes, sampling, quants, restart))
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    assert image[:2] == (6 * hmax * 8 - 5, 4 * vmax * 8 - 3)
    want = np.clip((planes[0] * 7 + 4) // 8 + 128, 0, 255)
    assert (image[2] == want[: image[2].shape[0], : image[2].shape[1]]).all() and image[2].shape[0] >= 4


def test_broken_streams():
    data = jpeg.encode(bytes(range(64)))
    for bad in (b"", data[:40], data[:-6], b"x" + data):
        if bad:
            with pytest.raises((ValueError, IndexError, struct.error)):
                jpeg.decode(bad)
    with pytest.raises(ValueError):
        jpeg.decode(data.replace(b"\xff\xc0", b"\xff\xc2", 1))


def test_query_against_brute_force(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "a" * 65), (5, "long " * 200_000), (6, "a" * 65), (None, "\x00ÿ" * 9), (1, "dup")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, media int")
    got = sorted(jpeg.media_features(jpeg.stored(df)).collect(), key=str)
    brute = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        brute.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute, key=str)
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert jpeg.media_features(jpeg.stored(df.limit(0))).count() == 0
