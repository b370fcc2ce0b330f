"""WARC archives: writing, normalising monolithic gzip files, reading by offset index.

``write_monolithic`` writes each partition as one gzip stream around all its records, the form that
cannot be read at an offset. ``normalise`` is the operator: it inflates each such file once, as a
stream in bounded pieces, rewrites every record as a gzip member of its own, and writes a sidecar index
(offset, length, uri, type, digest) beside each new file and as one table. ``read_records`` fetches members
by their offsets, a slice of the index per task.

Files are named by a random token and only the names that finished tasks return are used, so a lost executor
or a second attempt leaves at most an unused file. All paths go through pyarrow's filesystems.

Cases. Null or empty payload: a record of 0 bytes. Equal payloads: the row of smallest id is the response and the others
are revisits that name it and hold no payload; ids that tie with each other are both responses of the same number.
Null id: written as the uri ``urn:page:``; sorts last, so it is a response only where no other row has its payload.
Long payloads: the normaliser holds one record at a time, the reader one record. Empty table: no files, no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import fresh_path, join_small, local_fs, written

INDEX = "file string, member_offset long, member_bytes long, uri string, record_type string, payload_digest string, refers_to string"
RECORDS = "uri string, record_type string, payload_digest string, header_digest string, payload_bytes long, refers_to string"
_PIECE = 1 << 20
_DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(uri: str, kind: str, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit's block is empty."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {_DATE}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {payload_digest} {kind}')}>",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(_PIECE):
        while data:
            if out := unzip.decompress(data, _PIECE):
                yield out
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
        # a member may end with its piece; what is left of the last one is flushed below
    if rest := unzip.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, the whole record's bytes, its block) of each record in an inflated stream."""
    held = bytearray()

    def fill(n: int) -> None:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("the archive ends inside a record")
            held.extend(piece)

    while True:
        if not held:
            piece = next(pieces, None)
            if piece is None:
                return
            held.extend(piece)
        while (end := held.find(b"\r\n\r\n")) < 0:
            fill(len(held) + 1)
        headers = parse_head(bytes(held[:end]))
        size = int(headers["content-length"])
        total = end + 4 + size + 4
        fill(total)
        yield headers, bytes(held[:total]), bytes(held[end + 4 : end + 4 + size])
        del held[:total]


def plan_records(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(id, payload, first): first is the smallest id of the rows with this payload, null where no other row has it.

    Only (digest, smallest id) is aggregated, combined on the map side, so a payload that a third of
    the rows share costs one row a task. Payloads are shuffled only if the digests that repeat are too many to broadcast.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = keyed.filter(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    groups = groups.filter(F.col("n") > 1).select("sha", "first")
    return join_small(keyed, groups, ["sha"], "left", 64, "warc-repeats").select("id", "payload", "first")


def _write_monolithic(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, zipped, n = None, None, None, 0
        for pdf in batches:
            for is_null, id_, payload, first in zip(pdf["id"].isna(), pdf["id"], pdf["payload"], pdf["first"]):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, at = local_fs(path)
                    out, zipped = fs.open_output_stream(at, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                payload = bytes(payload)
                revisit = not pd.isna(first) and (is_null or int(id_) != int(first))
                uri = "urn:page:" + ("" if is_null else str(int(id_)))
                refers = f"urn:page:{int(first)}" if revisit else None
                out.write(zipped.compress(record(uri, "revisit" if revisit else "response", payload, digest(payload), refers)))
                n += 1
        if out is not None:
            out.write(zipped.flush())
            out.close()
            yield pd.DataFrame({"file": [path], "records": [n]})

    return run


def make_folder(path: str) -> str:
    fs, at = local_fs(path)
    fs.create_dir(at, recursive=True)
    return path


def write_monolithic(df: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives; the table of (file, records) that were written."""
    rows = plan_records(df, id_col, payload_col, min_revisit_bytes)
    make_folder(folder)
    return written(rows.mapInPandas(_write_monolithic(folder), "file string, records long"), "warc-files")


def _normalise(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_folder(folder)
        for pdf in batches:
            for file in pdf["file"]:
                fs, at = local_fs(file)
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                to_fs, to = local_fs(target)
                index: list[tuple] = []
                offset = 0
                with fs.open_input_stream(at, compression=None) as source, to_fs.open_output_stream(to, compression=None) as out, to_fs.open_output_stream(to + ".idx", compression=None) as side:
                    for headers, whole, _ in records(inflated(source)):
                        zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = zipped.compress(whole) + zipped.flush()
                        out.write(member)
                        row = (target, offset, len(member), headers["warc-target-uri"], headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), headers.get("warc-refers-to-target-uri"))
                        side.write(("\t".join("-" if x is None else str(x) for x in row[1:]) + "\n").encode())
                        index.append(row)
                        offset += len(member)
                        if len(index) >= 5000:
                            yield pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
                            index = []
                if index:
                    yield pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])

    return run


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """The operator: each monolithic file of column ``file`` rewritten member by record; the written index table (INDEX)."""
    n = max(1, files.count())
    # one file a task: the work of a file is a stream that cannot be split
    spread = files.select("file").repartition(min(n, 10_000), "file")
    return written(spread.mapInPandas(_normalise(folder), INDEX), "warc-index")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, stream = None, None
    for pdf in batches:
        out = []
        for file, offset, size in zip(pdf["file"], pdf["member_offset"], pdf["member_bytes"]):
            if file != at:
                if stream is not None:
                    stream.close()
                fs, path = local_fs(file)
                at, stream = file, fs.open_input_file(path)
            stream.seek(int(offset))
            head, _, block = next(records(iter([zlib.decompress(stream.read(int(size)), 31)])))
            response = head["warc-type"] == "response"
            claimed = head["warc-payload-digest"].removeprefix("sha1:")
            out.append((head["warc-target-uri"], head["warc-type"], digest(block) if response else claimed, claimed, len(block) if response else None, head.get("warc-refers-to-target-uri")))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])
        frame["payload_bytes"] = frame["payload_bytes"].astype("Int64")
        yield frame
    if stream is not None:
        stream.close()


def read_records(index: DataFrame) -> DataFrame:
    """What each member says (RECORDS); payload_bytes is null for a revisit, whose payload is elsewhere."""
    return index.mapInPandas(_read, RECORDS)


def page_rows(read: DataFrame) -> DataFrame:
    """Per page, with the payload size of a revisit taken from the response that it names."""
    number = lambda c: F.when(F.length(c) > 9, F.substring(c, 10, 30).cast("long"))
    rows = read.withColumn("page_id", number(F.col("uri"))).withColumn("refers_to", number(F.col("refers_to")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses, revisits = rows.filter("refers_to IS NULL"), rows.filter("refers_to IS NOT NULL").drop("payload_bytes")
    named = revisits.select("refers_to").distinct()
    sizes = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("of")).join(named, "refers_to", "left_semi")
    # an id that several rows have may be a response of several payloads: the digest tells which
    sizes = sizes.groupBy("refers_to", "of").agg(F.max("payload_bytes").alias("payload_bytes"))
    found = revisits.join(sizes.withColumnRenamed("of", "payload_digest"), ["refers_to", "payload_digest"], "left")
    return responses.select(*out).unionByName(found.select(*out))


def through_archives(df: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Writes monolithic archives, normalises them, reads the records back by the index."""
    spark = df.sparkSession
    folder = fresh_path(spark, "warc")
    files = write_monolithic(df, folder + "/monolithic", id_col, payload_col)
    index = normalise(files, folder + "/records")
    fs, at = local_fs(folder + "/monolithic")
    fs.delete_dir(at)  # what the normaliser has replaced
    return page_rows(written(read_records(index), "warc-read"))


#: DuckDB SQL for the query's rows: base32 is spelt out, 5 hex digits making 4 letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - i % 4 * 5)) & 31 AS INTEGER), 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
