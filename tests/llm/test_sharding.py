from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strideway.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = {r["id"]: r["p"] for r in sharding.permuted(spark.range(n), "id", n, "p").collect()}
    assert sorted(got.values()) == list(range(n))
    assert got == {x: sharding.permute_int(x, n) for x in range(n)}


ROWS = [(1, "a"), (1, "a"), (1, "a"), (2, None), (None, ""), (None, ""), (3, "x" * 200_000), (4, "é")] + [(9, "copy")] * 50


def shards_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    return by


def test_rows_law_slots_and_digests(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = sharding.feistel_shards(sharding.measured(df)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t in ROWS)
    by = shards_of(rows)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(8))


def test_whole_rows_are_carried_and_order_of_input_is_irrelevant(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", {"k": 1}) for i in range(40)], "doc_id long, text string, extra map<string,int>")
    one = sharding.feistel_shards(df)
    two = sharding.feistel_shards(df.repartition(5, "text"))
    key = lambda d: sorted((r["doc_id"], r["shard"], r["slot"]) for r in d.collect())
    assert key(one) == key(two) and one.columns[:3] == df.columns


def test_empty_and_clash(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.feistel_shards(df).count() == 0
    with pytest.raises(ValueError):
        sharding.feistel_shards(df.withColumn("slot", F.lit(1)))


def test_shards_against_brute_force(spark):
    """The digest, the numbers in its order and the walk, row by row in Python."""
    import hashlib
    import json

    rows = [(i % 9 if i % 4 else None, ["a", None, "", "\u00e9"][i % 4]) for i in range(60)] + [(5, "hot")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def digest(i, t):
        whole = json.dumps({"doc_id": i, "text": t}, ensure_ascii=False, separators=(",", ":"))
        return hashlib.md5("\0".join([*([] if i is None else [str(i)]), whole]).encode()).hexdigest()

    order = sorted(rows, key=lambda r: digest(*r))
    want = Counter()
    for x, r in enumerate(order):
        p = sharding.permute_int(x, len(rows))
        want[(*r, p % 8, p // 8)] += 1
    assert Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.feistel_shards(df).collect()) == want


def test_rows_without_ids_spread_and_clashing_names_stay(spark):
    rows = [(None, f"t{k}", k, {"m": k}) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `h` int, `a.b` map<string,int>")
    numbered, n = sharding.numbered(df, "doc_id")
    assert n == 300 and sorted(r["number"] for r in numbered.collect()) == list(range(300))
    got = sharding.feistel_shards(df)
    assert got.columns[:4] == df.columns and sorted(r["h"] for r in got.collect()) == list(range(300)) and all(r["a.b"]["m"] == r["h"] for r in got.collect())
    heads = df.select(F.substring(F.md5(F.to_json(F.struct("text")).cast("binary")), 1, 2).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert heads < 20
