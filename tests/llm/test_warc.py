import gzip
import io

from strideway.llm import warc
from strideway.llm.common import fresh_path, local_fs


def test_round_trip_against_brute_force(spark):
    rows = [(5, "a"), (3, "a"), (9, "a"), (4, None), (1, ""), (2, "é" * 70_000), (7, "x\r\n\r\nWARC/1.1\r\n"), (None, "lone"), (8, "a")] + [(100 + i, "hot") for i in range(60)]
    df = spark.createDataFrame([(i, h, "r", 1) for i, h in rows], "page_id long, html string, record_type string, id int").repartition(3)
    got = sorted((tuple(r) for r in warc.through_archives(df).collect()), key=str)
    want = []
    for i, h in rows:
        h = (h or "").encode()
        first = min((j for j, g in rows if (g or "").encode() == h and j is not None), default=None)
        revisit = first is not None and i != first
        want.append((i, len(h), warc.digest(h), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_members_and_index(spark):
    df = spark.createDataFrame([(i, "page %d " % (i // 2) * 5000) for i in range(12)], "page_id long, html string").coalesce(2)
    folder = fresh_path(spark, "t")
    files = warc.write_monolithic(df, folder + "/m")
    index = warc.normalise(files, folder + "/n").collect()
    assert len(index) == 12
    whole = b"".join(local_fs(r["file"])[0].open_input_file(local_fs(r["file"])[1]).read() for r in files.collect())
    plain = gzip.decompress(whole)
    members = {}
    for r in index:
        fs, at = local_fs(r["file"])
        data = fs.open_input_file(at).read()
        members[r["file"]] = data
        one = gzip.decompress(data[r["member_offset"] : r["member_offset"] + r["member_bytes"]])
        assert one.startswith(b"WARC/1.1") and one in plain
    assert sum(len(gzip.decompress(d)) for d in members.values()) == len(plain)


def test_streams_of_many_members_and_truncation():
    recs = [warc.record(f"u{i}", "response", bytes([65 + i]) * (3 << 20 if i == 1 else i), "D", None) for i in range(4)]
    data = b"".join(gzip.compress(r) for r in recs)
    assert [w for _, w, _ in warc.records(warc.inflated(io.BytesIO(data)))] == recs
    try:
        list(warc.records(iter([recs[0][:-1]])))
        raise AssertionError
    except ValueError:
        pass


def test_empty(spark):
    assert warc.through_archives(spark.createDataFrame([], "page_id long, html string")).count() == 0
