import fixtures as X
import pytest

from strideway.operators.paths import PathSet
from strideway.operators.render import to_html, to_tikz
from strideway.operators.temporal import TemporalEdges
from strideway.sources import files


def put(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines))
    return str(tmp_path / name)


def test_ngrams(spark, tmp_path):
    path = put(tmp_path, "a.ngram", ["a,b,c,d,a,b,2", "d, e,d,a,b,4", "", "x,y,0"])
    p = files.read_ngrams(spark, path)
    assert X.freqs(p) == {"abcdab": 2, "dedab": 4}
    assert X.freqs(files.read_ngrams(spark, path, max_nodes=2)) == {"ab": 2, "de": 4}
    assert X.freqs(files.read_ngrams(spark, path, max_lines=1)) == {"abcdab": 2}
    files.write_ngrams(p, str(tmp_path / "out"))
    assert X.freqs(files.read_ngrams(spark, str(tmp_path / "out"))) == X.freqs(p)


def test_edges(spark, tmp_path):
    path = put(tmp_path, "a.edge", ["1,2,45,0", "1,3,2,0", "1,5,5,0", "3,5,2,0", "5,3,4,0", "5,2,1,0", "bad"])
    good = put(tmp_path, "b.edge", ["1,2,45", "1,3,2", "1,2,7"])
    assert X.freqs(files.read_edge_paths(spark, good, weight=True)) == {"12": 52, "13": 2}
    assert X.freqs(files.read_edge_paths(spark, good, undirected=True)) == {"12": 2, "13": 1, "21": 2, "31": 1}
    with pytest.raises(Exception, match="fewer than two"):
        files.read_edge_paths(spark, path).longest.collect()
    g = files.read_graph(spark, good, weighted=True, directed=True)
    assert {(r["src"], r["dst"]): r["w"] for r in g.edges.collect()} == {("1", "2"): 7, ("1", "3"): 2}
    assert files.read_graph(spark, path).edges.count() == 5
    assert files.read_dag(spark, path, nodes=["1", "2", "3"]).count() == 2
    files.write_graph(g, str(tmp_path / "g"), weighted=True)
    back = files.read_graph(spark, str(tmp_path / "g"), weighted=True, directed=True)
    assert sorted(tuple(r)[:3] for r in back.edges.collect()) == sorted(tuple(r)[:3] for r in g.edges.collect())
    od = files.read_origin_destination(spark, put(tmp_path, "od.csv", ["A, H,5", "B,E,3"]))
    assert [tuple(r) for r in od.collect()] == [("A", "H", 5.0), ("B", "E", 3.0)]


def test_temporal(spark, tmp_path):
    path = put(tmp_path, "a.tedges", ["source,target,time", " 1,2,0", " 1,2,2", " 1,3,5", " 3,2,6", " 2,1,8", " 4,5,2", " 5,3,4", " 9,9,-1", " 7,,3"])
    t = files.read_temporal(spark, path)
    assert sorted({r["t"] for r in t.edges.collect()}) == [0, 2, 4, 5, 6, 8]
    assert t.edges.selectExpr("explode(array(src, dst)) AS v").distinct().count() == 9
    stamps = put(tmp_path, "b.tedges", ["source,target,time", "1,4,2000-03-04 12:45", "2,4,2000-03-04 15:45", "5,2,2000-03-04 19:56", "8,2,2000-03-07 21:32"])
    s = files.read_temporal(spark, stamps, timestamp_format="yyyy-MM-dd HH:mm")
    assert [r["gap"] for r in s.inter_event_times().orderBy("t").collect()] == [10800, 15060, 264960]
    assert sorted(r["t"] for r in files.read_temporal(spark, put(tmp_path, "c.tedges", ["node2,node1", "a,b", "c,d"])).edges.collect()) == [0, 1]
    files.write_temporal(t, str(tmp_path / "t"))
    assert "tikzpicture" in to_tikz(t) and "svg" in to_html(t)
    assert '"weight"' in to_html(PathSet.of(spark, X.NGRAMS))


def test_pictures_of_too_many_edges_raise(spark, monkeypatch):
    monkeypatch.setattr("strideway.operators.render.MOST", 2)
    t = TemporalEdges(spark.createDataFrame([("a", "b", 1, 1), ("b", "c", 2, 2), ("c", "d", 3, 3)], "src string, dst string, t long, seq long"))
    for draw in (to_html, to_tikz):
        with pytest.raises(ValueError):
            draw(t)
        assert draw(TemporalEdges(t.edges.limit(2)))
