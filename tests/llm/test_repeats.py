import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strideway.llm import repeats


def brute(texts, depth=repeats.DEPTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    hot, long = text(150), text(300)
    out = [None, "", "short", "x" * 399, "x" * 400, "y" * 401, "ab" * 700, "z" * 3000]
    out += [text(rng.randint(1, 60)) + " " + hot + " " + text(rng.randint(1, 60)) for _ in range(12)]
    out += [long, long, long[:700], long[300:900] + text(50), text(20) + long[100:520]]
    base = text(400)
    for _ in range(8):
        words = base.split()
        for _ in range(4):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    for n in (398, 399, 400, 401, 402):
        same = text(300)[:n]
        out += [text(70) + "#" + same + "#" + text(70), text(70) + "!" + same + "!" + text(70)]
    out.append(base[:500] + base[:500])
    return out


def test_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i if i % 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, g int").repartition(5)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = repeats.remove_repeats(df).select(columns).collect()
    want = [(i if i % 5 else None, *b) for i, b in enumerate(brute(texts))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [500, 1000, 1 << 19])
def test_runs_cover_all_windows_and_are_functions_of_their_bytes(monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 3000, dtype=np.uint8)
    data[1700:2700] = data[200:1200]
    anchors = {}
    for g, p, first, last, _ in repeats.runs(data):
        for gi, pi, lo, hi in zip(g.tolist(), p.tolist(), first.tolist(), last.tolist()):
            for s in range(lo, hi + 1):
                anchors[s] = (gi, pi - s)
    assert sorted(anchors) == list(range(3000 - 400 + 1))
    assert all(anchors[s] == anchors[s + 1500] for s in range(200, 800))


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 100).astype(np.uint64)
    for w in (1, 3, 100):
        assert (repeats.sliding_min(x, w) == [x[i : i + w].min() for i in range(101 - w)]).all()


def brute_shared(texts, n=repeats.PASSAGE):
    words = [(t or "").split() for t in texts]
    owners = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            owners.setdefault(tuple(w[i : i + n]), set()).add(d)
    out = []
    for w in words:
        hit = set()
        for i in range(len(w) - n + 1):
            if len(owners[tuple(w[i : i + n])]) > 1:
                hit |= set(range(i, i + n))
        out.append(len(hit))
    return out


def shared_corpus():
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(n))
    hot, own, lone = text(55), text(60), text(120)
    out = [text(rng.randint(1, 90)) + " " + hot + " " + text(rng.randint(1, 90)) for _ in range(15)]
    out += [f"{own} {text(5)} {own}", f"{own} {own}", text(30) + " " + own[:200] + " " + text(9), None, "", "w " * 49, "v " * 49, "w " * 50, "u " * 400]
    out += [lone, lone, lone + " and more", "\n".join(lone.split()), text(49), text(300)]
    for n in (49, 50, 51):
        same = text(n)
        out += [f"{text(3)} {same} {text(4)}", f"{text(60)} {same}"]
    out += [out[-1], f"{hot} {hot} {hot}"]
    # the same words over and over, in stretches of many lengths that texts share in part
    for _ in range(25):
        out.append(" ".join(" ".join([rng.choice("pqrst")] * rng.choice([30, 49, 50, 51, 57, 64, 90])) for _ in range(rng.randint(2, 9))))
    return out


def test_shared_passages_against_brute_force(spark):
    texts = shared_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    want = brute_shared(texts)
    assert [got[i]["n_shared_words"] for i in range(len(texts))] == want
    assert all(got[i]["shares_passage"] == (n > 0) for i, n in enumerate(want))
    # a text that repeats only itself shares nothing; a passage of 55 words under 400 bytes is found, not removed
    assert want[15] > 0 and want[23] == 0 and sum(w > 0 and got[i]["n_removed"] == 0 for i, w in enumerate(want)) > 10
