"""WARC archives: writing, normalising monolithic gzip and reading back.

* ``write_archives`` writes records as whole-file gzip streams (one member for a whole archive, the
  form that cannot be read at random), named by the task's number. Payloads that an earlier record holds
  become ``revisit`` records without a payload.
* ``normalise`` inflates each such stream once, from front to back, and rewrites every record as a
  gzip member of its own, with a sidecar index of offsets. Archives are independent tasks; memory holds
  one record, one read buffer and a batch of index rows.
* ``read_records`` reads records by (archive, offset, length) of the index, in any order or subset.

Files go to the shared folder through the file system that the path's scheme names. Each is written
under a name of the attempt and renamed when complete, in place of that of an earlier attempt, so a lost
or repeated task leaves each of its archives once and whole.

Defined cases: a null payload is empty; null ids are written as an empty id and read back as null;
repeated ids are separate records; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

REVISIT_BYTES = 1000
CHUNK = 1 << 20
ARCHIVE_ROWS = 4000
SALTS = 32
#: Index rows or bytes of payload after which a batch of rows is handed on.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 23
#: Whole-file streams are read once, members are kept.
STREAM_LEVEL, MEMBER_LEVEL = 1, 6
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX_FIELDS = "archive string, offset long, length long, record_id string, record_type string"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: bytes, size: int) -> bytes:
    """One WARC record with an HTTP response of this payload, or a revisit of an earlier one."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    one_line = "".join(c for c in (url or "") if c not in "\r\n")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[3:3] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record at this place")
    out = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class _Whole:
    """A file that appears under its name when complete."""

    def __init__(self, path: str):
        self.fs, self.path = _store(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex[:8]}"
        self.out = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def done(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:  # of an earlier attempt
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, refers_to of the rows whose payload another row holds: of records with equal payloads of
    ``least`` bytes or more, the one with the largest id is the response."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    small = pages.select("page_id", F.sha1(body).alias("digest"), F.length(body).alias("n")).filter(F.col("n") >= least).filter("page_id is not null")
    groups = small.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # one payload may be that of a third of all pages
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = small.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(groups.hint("merge"), ["digest", "n", "salt"]).filter("page_id != refers_to").select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "refers_to").distinct()


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, *, least: int = REVISIT_BYTES, archive_rows: int = ARCHIVE_ROWS) -> DataFrame:
    """Writes the pages (page_id, url, html) and returns the archives' paths and record counts."""
    extra = [F.col("url")] if "url" in pages.columns else [F.lit("").alias("url")]
    rows = pages.select("page_id", *extra, "html")
    again = revisits(pages, least)
    joined = rows.join(again, (F.col("page_id") == F.col("of")) & (F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")) == F.col("of_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, paths, counts, part = None, [], [], TaskContext.get().partitionId()
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    paths.append(f"{folder}/{part:06d}-{len(paths):06d}.warc.gz")
                    counts.append(0)
                    out, deflate = _Whole(paths[-1]), zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, 31)
                payload = (html.as_py() or "").encode()
                out.write(deflate.compress(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), hashlib.sha1(payload).digest(), len(payload))))
                counts[-1] += 1
                if counts[-1] >= archive_rows:
                    out.write(deflate.flush())
                    out.done()
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.done()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return joined.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records long")


def inflated(path: str, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    fs, name = _store(path)
    with fs.open_input_stream(name, compression=None) as source:
        inflate = zlib.decompressobj(31)
        while data := source.read(size):
            while data:
                if piece := inflate.decompress(data, size):
                    yield piece
                data = inflate.unconsumed_tail
                if inflate.eof:
                    data, inflate = inflate.unused_data, zlib.decompressobj(31)
        if tail := inflate.flush():
            yield tail


def split_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) of each record of a stream."""
    buffer, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = next(stream, None)
        ended = piece is None
        if piece:
            buffer.extend(piece)
        return not ended

    while True:
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(buffer) - 3)
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends within a record")
                return
        head = parse_head(bytes(buffer[:end]))
        total = end + 4 + int(head["content-length"]) + 4
        while len(buffer) < total:
            if not more():
                raise ValueError("the archive ends within a record")
        whole = bytes(buffer[:total])
        del buffer[:total]
        yield head, whole


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["archive", "offset", "length", "record_id", "record_type"])


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive with a gzip member per record and its sidecar ``.index`` (one line per
    record: offset, length, type, id). Returns the index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                target = f"{folder}/{source.rpartition('/')[2]}"
                out, index, at = _Whole(target), _Whole(target + ".index"), 0
                rows: list[tuple] = []
                for head, whole in split_records(inflated(source)):
                    squeeze = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
                    member = squeeze.compress(whole) + squeeze.flush()
                    out.write(member)
                    rows.append((target, at, len(member), head["warc-record-id"], head["warc-type"]))
                    index.write(f"{at} {len(member)} {head['warc-type']} {head['warc-record-id']}\n".encode())
                    at += len(member)
                    if len(rows) == BATCH_ROWS:
                        yield _index_batch(rows)
                        rows = []
                out.done()
                index.done()
                if rows:
                    yield _index_batch(rows)

    return archives.select("archive").mapInArrow(run, INDEX_FIELDS)


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
FIELD_TYPES = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """page_id, url, payload (null for revisits and without ``payloads``), payload_bytes, payload_digest,
    record_type, refers_to of the indexed records, each fetched by its offset; digests of payloads are
    checked. Memory holds one record and about ``BATCH_BYTES`` of payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        out, held = {k: [] for k in FIELDS}, 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in FIELDS.items()], names=list(FIELDS))

        for batch in batches:
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive not in opened:
                    for f in opened.values():
                        f.close()
                    fs, name = _store(archive)
                    opened = {archive: fs.open_input_file(name)}
                whole = zlib.decompress(opened[archive].read_at(length, offset), 31)
                end = whole.index(b"\r\n\r\n")
                head = parse_head(whole[:end])
                block = whole[end + 4 : end + 4 + int(head["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                revisit = head["warc-type"] == "revisit"
                if not revisit and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
                    raise ValueError(f"damaged payload in {archive} at {offset}")
                shown = payload if payloads and not revisit else None
                values = (_page(head["warc-record-id"]), head["warc-target-uri"], shown, size, digest.hex(), head["warc-type"], _page(head.get("warc-refers-to")))
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
                held += len(shown or b"")
                if held >= BATCH_BYTES or len(out["page_id"]) >= BATCH_ROWS:
                    yield batch_of()
                    out, held = {k: [] for k in FIELDS}, 0
        yield batch_of()
        for f in opened.values():
            f.close()

    return index.mapInArrow(run, FIELD_TYPES)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages, normalises the archives and reads every record back by the index."""
    ws = Workspace(spark, "warc")
    written = ws.save(write_archives(spark, pages, ws.path("monolithic")), "written")
    # archives are the unit of work: each is dealt to a task of its own
    n = max(1, written.count())
    index = ws.save(normalise(written.repartition(n, "archive"), ws.path("normalised")), "index")
    ws.drop("monolithic")
    return read_records(index, payloads=False).drop("payload")
