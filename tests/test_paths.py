import fixtures as X
import pytest
from pyspark.sql import functions as F

from strideway.functions import grams
from strideway.operators.paths import PathSet, ranked


@pytest.fixture(scope="module")
def paths(spark):
    return PathSet.of(spark, X.NGRAMS)


def test_counts(paths):
    assert {r["node"] for r in paths.nodes().collect()} == set("abcde") and paths.max_length() == 5
    assert paths.observation_count().first()["n"] == 6
    got = {r["k"]: (r["sub"], r["longest"]) for r in paths.path_lengths().collect()}
    assert got == {0: (32, 0), 1: (26, 0), 2: (20, 0), 3: (14, 0), 4: (4, 4), 5: (0, 2)}
    assert paths.unique_paths().first()["n"] == 2 and paths.unique_paths(5, longer=False).first()["n"] == 1
    assert max(r["p"] for r in paths.visitation_probabilities().collect()) == 0.3125
    capped = PathSet(paths.longest, cap=1).path_lengths()
    assert {r["k"]: r["sub"] for r in capped.collect()} == {0: 32, 1: 26, 4: 0, 5: 0}


def test_filter_project_and_algebra(paths, spark):
    assert X.freqs(paths.filter_nodes(["a", "b", "c"], min_length=1)) == {"ab": 6, "abc": 2}
    assert X.freqs(paths.filter_nodes(["a", "b", "c"], min_length=1, split_paths=False)) == {"ab": 4}
    assert X.freqs(paths.project(dict(zip("abcde", "xxyyy")))) == {"yyyxx": 4, "xxyyxx": 2}
    with pytest.raises(Exception, match="no label"):
        paths.project({"a": "x"}).longest.collect()
    assert X.freqs(paths * 3) == X.freqs(paths + paths + paths)
    seq = [r["s"] for r in paths.sequence().orderBy("pos").collect()]
    assert sorted("".join(seq).strip("|").split("|")) == ["abcdab"] * 2 + ["dedab"] * 4
    one = spark.createDataFrame([(list("abcdefg"),), (["a"],), ([],)], "path array<string>")
    got = [r[0] for r in one.select(grams.runs("path", list("abdfg"))).collect()]
    assert got == [[["a", "b"], ["d"], ["f", "g"]], [["a"]], []]
    sets = spark.createDataFrame([([["a", "b"], ["c"], ["d", "e"]],)], "s array<array<string>>")
    assert sorted("".join(x) for x in sets.select(grams.expand_sets("s")).first()[0]) == ["acd", "ace", "bcd", "bce"]
    rep = spark.createDataFrame([(list("122333"),), (["1"],)], "path array<string>").select(grams.remove_repeats("path"))
    assert [r[0] for r in rep.collect()] == [["1", "2", "3"], ["1"]]
    hon = spark.createDataFrame([(list("abcd"),)], "path array<string>").select(grams.higher_order_nodes("path", 2).alias("g"))
    assert hon.first()["g"] == [["a", "b"], ["b", "c"], ["c", "d"]] and hon.select(grams.first_order_path("g")).first()[0] == list("abcd")
    with pytest.raises(ValueError):
        PathSet.of(spark, [(["a,b", "c"], 1)])


def test_distances_and_centralities(paths):
    assert X.pairs(paths.betweenness()) == {"b": 2, "a": 3, "e": 0, "c": 3, "d": 5}
    assert sum(X.pairs(paths.closeness()).values()) == pytest.approx(9.8333, abs=1e-3)
    assert ranked(paths.betweenness()).first()["node"] == "d"
    assert max(X.pairs(paths.betweenness(normalized=True)).values()) == 1
    sp = paths.shortest_paths().filter("src = 'd' AND dst = 'b'").collect()
    assert ["".join(r["path"]) for r in sp] == ["dab"]


def test_seeded(spark):
    p = X.random_paths(spark, 90, 90)
    assert p.observation_count().first()["n"] == 193 and p.unique_paths().first()["n"] == 87
    assert {r["node"] for r in X.random_paths(spark, 3, 9).nodes().collect()} == set("bouvwy")


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, "a"), (1, "2024-01-01 00:10:00", 2, "b"), (1, "2024-01-02 00:00:00", 3, "c"), (2, "2024-01-01 00:00:00", 4, "a"), (2, "2024-01-01 00:00:00", 5, "b")]
    e = spark.createDataFrame(rows, "u long, ts string, id long, x string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert X.freqs(PathSet.from_sessions(e, "u", "ts", "id", "x", 3600)) == {"ab": 2, "c": 1}
    assert PathSet.from_sessions(e.limit(0), "u", "ts", "id", "x", 3600).stats().count() == 0
