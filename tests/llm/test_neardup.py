import random
from collections import Counter

import numpy as np
import pytest

from strideway.llm import neardup
from strideway.llm.components import components


def weighted(d):
    keys = np.array(sorted(d), np.uint64)
    return keys, np.array([d[int(k)] for k in keys])


def test_sketch_estimates_probability_jaccard():
    rng = random.Random(1)
    for _ in range(4):
        a = {rng.randrange(1 << 60): rng.randint(1, 5) for _ in range(60)}
        b = dict(list(a.items())[:45])
        b = {k: v if rng.random() < 0.7 else rng.randint(1, 5) for k, v in b.items()} | {rng.randrange(1 << 60): 2 for _ in range(10)}
        brute = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
        (ka, wa), (kb, wb) = weighted(a), weighted(b)
        assert neardup.probability_jaccard((ka, wa), (kb, wb)) == pytest.approx(brute)
        m = 2000
        s = neardup.sketch(np.concatenate([ka, kb]), np.concatenate([wa, wb]), np.repeat([0, 1], [len(ka), len(kb)]), 2, m)
        assert abs((s[0] == s[1]).mean() - brute) < 4 * (brute * (1 - brute) / m) ** 0.5 + 0.01
        alone = neardup.sketch(ka, wa, np.zeros(len(ka), int), 1, m)
        assert (alone[0] == s[0]).all()


def brute_shingles(t):
    w = t.lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def test_shingles():
    for t in ("", "  ", "one", "a b c d", "A b  c\td\ne f", " x y z x y z x y z x y z ", "é " * 40):
        got = neardup.shingles(t)
        assert sorted(got[1].tolist()) == sorted(brute_shingles(t).values())
    assert (neardup.shingles("a b c d e f")[0] == neardup.shingles(" A  B c\nd e  f ")[0]).all()


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(80, 200))]
        texts.append(" ".join(base))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(50)) for _ in range(20)]
    texts += [None, "", " ", "two words", "two words", "Two  Words", "other", "spam " * 300, "spam " * 300 + "end", "x" * 100_000]
    return texts


def brute_classes(texts):
    sets = [brute_shingles(t or "") for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if not a or not b:
                continue
            ok = len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys()) - 1e-9
            ok = ok or sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys()) >= 0.8 - 1e-12
            if ok:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_query_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, b"k", i) for i, t in enumerate(texts)], "doc_id long, text string, key binary, a int").repartition(4)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(got[i]["class_size"] == sizes[want[i]] and got[i]["is_first"] == (want[i] == i) for i in got)
    kept = neardup.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns


def test_null_and_repeated_ids(spark):
    t = "one two three four five six seven eight"
    rows = [(None, t), (None, t), (5, t + " "), (7, "lone words here"), (7, "lone words here"), (8, None), (8, None), (None, "only nulls here"), (None, "only nulls here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 5, 3), (None, 5, 3), (5, 5, 3), (7, 7, 2), (7, 7, 2), (8, 8, 1), (8, 8, 1), (None, None, 2), (None, None, 2)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(df).collect()), key=str)
    assert kept == sorted([(5, t + " "), (7, "lone words here"), (8, None), (8, None), (None, "only nulls here")], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(200, 200 + k) for k in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


@pytest.fixture
def rounds(monkeypatch):
    """The tables that rounds of components write, as they are written."""
    from strideway.llm import components as C

    names = []
    monkeypatch.setattr(C, "written", lambda df, name, own=C.written: names.append(name) or own(df, name))
    return names


def test_components_end_without_a_round_that_changes_nothing(spark, rounds):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([(7, 3), (3, 9), (5, 5), (12, 11)], "a long, b long")).collect()}
    assert got == {3: 3, 7: 3, 9: 3, 11: 11, 12: 11} and len(rounds) == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0 and len(rounds) == 2


def test_classes_come_from_the_last_components(spark, rounds):
    """One leader round links all; its components are not computed again for the classes."""
    t = "one two three four five six seven eight nine ten"
    rows = [(k, t + " " * k) for k in range(6)] + [(10, "lone words that no other text has"), (11, None)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 10: 10, 11: 11} and 1 <= len(rounds) <= 2
