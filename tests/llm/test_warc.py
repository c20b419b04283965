import gzip
import hashlib
import zlib

from spanwarden.llm import warc
from spanwarden.llm.workspace import Workspace

ROWS = [
    (1, "http://a/1", "x" * 1000),
    (5, "http://a/5", "x" * 1000),
    (9, None, "x" * 1000),
    (2, "http://b\r\nX: y", "short"),
    (3, "http://b", "short"),
    (4, "", None),
    (6, "u", "é" * 600 + "\r\n\r\nWARC/1.1\r\n"),
    (7, "u", "é" * 600 + "\r\n\r\nWARC/1.1\r\n"),
    (8, "u", "z" * 2_500_000),
    (None, "u", "x" * 1000),
    (8, "again", "other"),
]
SCHEMA = "page_id long, url string, html string, digest string, n int"


def frame(spark):
    return spark.createDataFrame([(*r, "d", 1) for r in ROWS], SCHEMA)


def brute():
    out = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "") == (html or "") and j is not None]
        again = len(data) >= 1000 and i is not None and i != max(same)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return out


def test_round_trip(spark):
    got = warc.round_trip(spark, frame(spark)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(brute(), key=str)


def test_members_and_sidecar(spark):
    ws = Workspace(spark, "warc-test")
    written = ws.save(warc.write_archives(spark, frame(spark).coalesce(1), ws.path("mono"), archive_rows=4), "written")
    index = ws.save(warc.normalise(written, ws.path("normal")), "index")
    archives = {r.archive for r in index.collect()}
    assert sum(r.records for r in written.collect()) == len(ROWS) and len(archives) == written.count()
    for r in written.collect():
        inflate = zlib.decompressobj(31)
        inflate.decompress(open(r.archive.removeprefix("file://"), "rb").read())
        assert inflate.eof and not inflate.unused_data  # one member for the whole file
    for archive in archives:
        data = open(archive.removeprefix("file://"), "rb").read()
        lines = open(archive.removeprefix("file://") + ".index").read().split("\n")[:-1]
        at = 0
        for line in lines:
            offset, length, kind, _ = line.split(" ")
            assert int(offset) == at
            assert f"WARC-Type: {kind}".encode() in gzip.decompress(data[at : at + int(length)])
            at += int(length)
        assert at == len(data)
    some = index.filter("record_id = '<urn:page:8>'")
    assert sorted(len(r.payload) for r in warc.read_records(some).collect()) == [5, 2_500_000]


def test_stream_of_many_members_and_small_reads(tmp_path):
    whole = [warc.record(k, "u", b"p" * k, None, hashlib.sha1(b"p" * k).digest(), k) for k in range(50)]
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(b"".join(whole[:20])) + gzip.compress(b"".join(whole[20:])))
    assert [w for _, w in warc.split_records(warc.inflated(str(path), 7))] == whole


def test_a_repeated_task_leaves_its_archives_once(spark):
    """Attempts of one task write the same names, so what a failed one left is taken over."""
    ws = Workspace(spark, "warc-again")
    pages = frame(spark).coalesce(1)
    first = warc.write_archives(spark, pages, ws.path("mono"), archive_rows=4).collect()
    again = warc.write_archives(spark, pages, ws.path("mono"), archive_rows=4).collect()
    assert first == again
    import os

    left = sorted(f for f in os.listdir(ws.path("mono").removeprefix("file://")) if not f.startswith("."))
    assert left == sorted(r.archive.rpartition("/")[2] for r in again)
    index = ws.save(warc.normalise(ws.save(spark.createDataFrame(again), "written"), ws.path("normal")), "index")
    bare = warc.read_records(index, payloads=False).collect()
    assert len(bare) == len(ROWS) and all(r.payload is None for r in bare)


def test_one_payload_in_most_pages(spark):
    rows = [(i, "u", "same " * 300) for i in range(300)] + [(1000 + i, "u", f"own {i} " * 200) for i in range(20)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 320 and {r.refers_to for r in got if r.record_type == "revisit"} == {299} and sum(r.record_type == "response" for r in got) == 21


def test_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0
