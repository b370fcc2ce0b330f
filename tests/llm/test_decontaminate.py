import random

import numpy as np
import pytest

from strideway.llm import decontaminate as D

RNG = random.Random(8)
COMMON = "the of and a to in is that for it".split()


def word():
    return RNG.choice(COMMON) if RNG.random() < 0.4 else "".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8)))


def passage(n):
    return [word() for _ in range(n)]


def edited(words, k):
    w = list(words)
    for _ in range(k):
        kind, at = RNG.randrange(3), RNG.randrange(len(w))
        if kind == 0:
            w[at] = word()
        elif kind == 1:
            del w[at]
        else:
            w.insert(at, word())
    return w


def levenshtein_in(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance():
    for _ in range(200):
        a, b = [RNG.choice("abc") for _ in range(RNG.randint(1, 9))], [RNG.choice("abc") for _ in range(RNG.randint(0, 15))]
        code = lambda s: np.array([ord(c) for c in s], np.uint64)
        assert D.edit_distance(code(a), code(b))[0] == levenshtein_in(a, b)


def test_recall_at_the_limit_of_edits():
    items = [(i, " ".join(passage(RNG.randint(12, 60)))) for i in range(60)]
    bench = D.Benchmark(items)
    found = total = 0
    for i, t in items:
        w = t.split()
        for _ in range(5):
            text = passage(80) + edited(w, D.max_edits(len(w))) + passage(80)
            total += 1
            found += i in {bench.items[k][0] for k, *_ in bench.matches(" ".join(text))}
    assert found / total >= D.TARGET, found / total


def test_query_against_brute_force(spark):
    items = [(k, " ".join(passage(RNG.randint(8, 40)))) for k in range(25)] + [(100, None), (101, "too short"), (102, ""), (None, "an item that has no number but six words more")]
    items.append((103, items[0][1]))
    docs = []
    for k in range(60):
        t = passage(RNG.randint(5, 150))
        if k % 3 == 0:
            item = items[RNG.randrange(25)][1].split()
            at = RNG.randrange(len(t))
            t[at:at] = edited(item, RNG.choice([0, 0, 1, D.max_edits(len(item))]))
        docs.append((k, " ".join(t).upper() if k % 2 else " ".join(t)))
    docs += [(900, None), (901, ""), (None, "x " + items[3][1]), (902, items[28][1] + " tail"), (902, items[28][1] + " tail"), (903, ("z " * 100_000) + items[5][1])]
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, item_id int, extra string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_items(df, bench).collect()
    want, fewest = [], {}
    for d, t in docs:
        for i, item in items:
            w = (item or "").lower().split()
            if len(w) < D.MIN_WORDS:
                continue
            text = (t or "").lower().split()[-400:]
            if (e := levenshtein_in(w, text)) <= D.max_edits(len(w)):
                want.append((d, i))
                fewest[d, i] = e
    have = [(r["doc_id"], r["item_id"]) for r in got]
    assert set(have) <= set(want) and len(set(have)) >= 0.95 * len(set(want))
    assert sum(h == (902, None) for h in have) == 2 and (903, 5) in have and (None, 3) in have
    assert all(r["n_edits"] == fewest[r["doc_id"], r["item_id"]] for r in got)
    kept = D.keep_clean(df, bench)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in {h for h, _ in have}), key=str)
    small = D.find_items(df, bench, block=7)
    assert sorted((r["doc_id"], r["item_id"]) for r in small.filter("doc_id IS NOT NULL AND item_id IS NOT NULL").collect()) == sorted((a, b) for a, b in have if a is not None and b is not None)
    assert D.find_items(df.limit(0), bench).count() == 0 and D.find_items(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [15, 30, 60, 61, 120, 200, 300, 500])
def test_recall_by_length(n):
    rng = random.Random(n)
    RNG.seed(n)
    items = [(i, " ".join(rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))) for i in range(20)]
    bench = D.Benchmark(items)
    found = total = 0
    for i, t in items:
        for k in range(5):
            w = t.split()
            part = edited(w, D.max_edits(n))
            # also at either end of a document
            text = passage(80 * (k > 0)) + part + passage(80 * (k < 4))
            got = {bench.items[m[0]][0]: m for m in bench.matches(" ".join(text))}
            total += 1
            found += i in got
            assert set(got) <= {i} and all(m[1] == levenshtein_in(w, text[m[2] : m[2] + m[3]]) <= D.max_edits(n) for m in got.values())
    assert found / total >= D.TARGET, found / total


def test_short_items_are_matched_by_whole_lines(spark):
    items = [(1, "red blue green old"), (2, "Yes"), (3, "a b\nc"), (4, ""), (5, " yes "), (6, "one two three four five")]
    bench = D.Benchmark(items)
    name = lambda t: sorted((bench.items[i][0], e, s, n) for i, e, s, n in bench.matches(t))
    assert name("red blue green old") == [(1, 0, 0, 4)] and name("x\n  Red  blue green OLD\ny") == [(1, 0, 1, 4)]
    assert name("so red blue green old it is") == [] and name("yes it is") == [] and name("q\nYES\nz") == [(2, 0, 1, 1), (5, 0, 1, 1)]
    assert name("a b c") == [(3, 0, 0, 3)] == name("a\nb c") and name("a\nb c\nd e f") == [] and name("the one two three four five") == [(6, 0, 1, 5)]
    docs = spark.createDataFrame([(1, "yes"), (2, "no\nyes"), (3, "oh yes"), (4, None), (5, "I say one two three four five")], "doc_id long, text string")
    for block in (2, 100):
        got = D.find_items(docs, spark.createDataFrame(items, "item_id long, text string"), block=block)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 2), (1, 5), (2, 2), (2, 5), (5, 6)]
        assert sorted(r["doc_id"] for r in D.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()) == [3, 4]


@pytest.mark.parametrize("n", [5, 6, 7, 12, 40])
def test_the_sieve_loses_no_match(n):
    items = [(i, " ".join(passage(n))) for i in range(30)]
    bench, sieve = D.Benchmark(items), D.Sieve(20)
    sieve.add(bench)
    for _, t in items:
        text = " ".join(passage(30) + edited(t.split(), D.max_edits(n)) + passage(30))
        assert sieve.holds(text) or not bench.matches(text)
    assert sum(sieve.holds(" ".join(passage(60))) for _ in range(50)) < 15 and not sieve.holds(None)
