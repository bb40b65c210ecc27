"""Operator 10: WARC writing, monolithic gzip normalising and reading back.

1. ``write_archives``: every partition writes one archive file, all its records
   in one whole-file gzip stream (the monolithic form that cannot be seeked).
2. ``normalise``: one task per archive inflates the stream once, cuts it into
   records and rewrites every record as a gzip member of its own, plus a
   sidecar index (uri, type, offset, length).
3. ``read_back``: seeks to every member by the sidecar and parses the record.

Files lie under ``spark.checkpoint.dir`` (shared by driver and executors) and
are written through ``pyarrow.fs``; a task writes an attempt-named file and
moves it into place, so a retried task leaves one whole file.

Equal payloads: a SHA-1 group's smallest page_id is the response, the others
are revisits.  Records smaller than ``min_revisit_bytes`` are all responses.
Cases: null html is an empty payload; a null url is written as an empty URI;
rows repeated with the same page_id as the response are responses too; a null
page_id sorts last and is written as the empty id.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import arrow_map, join_groups, table, written

MIN_REVISIT_BYTES = 0
GZIP_LEVEL = 1
CHUNK = 1 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.0 record.  A revisit keeps the HTTP head (with the full
    payload's length) and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    ident = "" if page_id is None else str(page_id)
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Target-URI: {' '.join((url or '').split())}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return fields, block[:int(fields["Content-Length"])]


def inflate(read, window: int = CHUNK) -> Iterator[bytes]:
    """Chunks of a gzip stream of any number of members, each of bounded size."""
    z = zlib.decompressobj(31)
    data = read(window)
    while data:
        out = z.decompress(data, window)
        if out:
            yield out
        if z.eof:
            data = z.unused_data or read(window)
            z = zlib.decompressobj(31)
        else:
            data = z.unconsumed_tail or read(window)


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of chunks; holds one record at a time."""
    buf, need = bytearray(), 0
    for chunk in chunks:
        buf += chunk
        while True:
            if not need:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = next(int(x.split(b":")[1]) for x in bytes(buf[:end]).split(b"\r\n") if x.startswith(b"Content-Length:"))
                need = end + 4 + size + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = 0
    if buf:
        raise ValueError("archive ends within a record")


class _Out:
    """A file written under an attempt's name and moved into place at the end."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.file, self.offset = self.fs.open_output_stream(self.temp, compression=None), 0

    def write(self, data: bytes) -> int:
        at, self.offset = self.offset, self.offset + len(data)
        self.file.write(data)
        return at

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.temp, self.path)


def write_archives(pages: DataFrame, folder: str, level: int = GZIP_LEVEL) -> DataFrame:
    """(archive, records) per partition of pages(page_id, url, html, digest, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = z = None
        name, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        for b in batches:
            for page_id, url, html, digest, ref in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out, z = _Out(name), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(record(page_id, url, html, base64.b32encode(digest).decode(), ref)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    return arrow_map(pages.select("page_id", "url", "html", "digest", "refers_to"), run, "archive string, records long")


def normalise(archives: DataFrame, folder: str, level: int = GZIP_LEVEL) -> DataFrame:
    """(member_file, index_file, records): every record as its own gzip member
    and a sidecar of lines ``offset length type uri``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                fs, path = open_fs(archive)
                base = f"{folder}/{archive.rsplit('/', 1)[1]}"
                out, index, n = _Out(base), _Out(base + ".idx"), 0
                with fs.open_input_stream(path, compression=None) as f:
                    for raw in split_records(inflate(f.read)):
                        head = raw[:raw.find(b"\r\n\r\n")].decode().split("\r\n")
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        at = out.write(member)
                        index.write(f"{at} {len(member)} {head[1][11:]} {head[3][17:]}\n".encode())
                        n += 1
                out.close()
                index.close()
                yield pa.RecordBatch.from_pydict({"member_file": [base], "index_file": [base + ".idx"],
                                                  "records": pa.array([n], pa.int64())})

    return arrow_map(archives.select("archive"), run, "member_file string, index_file string, records long")


READ_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
               "archive string, offset long, length long")


def read_back(files: DataFrame) -> DataFrame:
    """One row per record, read member by member through the sidecar index."""

    def ident(x: str | None):
        x = (x or "")[len("<urn:page:"):-1]
        return int(x) if x else None

    def rows(member_file: str, index_file: str) -> Iterator[tuple]:
        fs, path = open_fs(member_file)
        ifs, ipath = open_fs(index_file)
        with fs.open_input_file(path) as f, ifs.open_input_stream(ipath, compression=None) as lines:
            for line in io.TextIOWrapper(io.BufferedReader(lines)):
                offset, length = map(int, line.split(" ", 2)[:2])
                f.seek(offset)
                fields, block = parse(zlib.decompress(f.read(length), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest = fields["WARC-Payload-Digest"][5:]
                if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                    raise ValueError(f"record at {offset} of {member_file} does not hold its payload")
                yield (ident(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"],
                       ident(fields.get("WARC-Refers-To")), member_file, offset, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        pack = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)
        for b in batches:
            for member_file, index_file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part: list[tuple] = []
                for row in rows(member_file, index_file):
                    part.append(row)
                    if len(part) == 4096:
                        yield pack(part)
                        part = []
                if part:
                    yield pack(part)

    return arrow_map(files.select("member_file", "index_file"), run, READ_SCHEMA)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) plus digest (SHA-1, binary) and refers_to (the
    response's page_id; null: a response).  Hashing, grouping and the look-up
    of copies move (id, digest) rows only; the html is shuffled by the last
    join alone, and not even there while the revisits are few."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    src = src.withColumn("digest", F.unhex(F.sha1("html")))
    ids = written(src.select("page_id", "digest", F.octet_length("html").alias("size")), "page_digests")
    groups = written(ids.where(F.col("size") >= min_revisit_bytes).groupBy("digest")
                     .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "page_groups")
    copies = join_groups(ids, groups, "digest", "n", ids.count())
    # rows without an id revisit the one with the smallest id; if no row has one they are responses
    revisits = written(copies.where(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
                       .select(F.col("page_id").alias("id"), F.col("digest").alias("payload"), F.col("first_id").alias("refers_to")).distinct(), "page_revisits")
    same = src["page_id"].eqNullSafe(revisits["id"]) & (src["digest"] == revisits["payload"])
    return src.join(revisits, same, "left").select("page_id", "url", "html", "digest", "refers_to")


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, level: int = GZIP_LEVEL) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (plus
    archive, offset, length of the member) of every page, read back."""
    folder = scratch_path(pages.sparkSession, "warc")
    archives = written(write_archives(with_revisits(pages, min_revisit_bytes), f"{folder}/monolithic", level), "warc_files")
    n = max(1, archives.count())
    files = written(normalise(archives.repartition(n), f"{folder}/members", level), "warc_members")
    return read_back(files.repartition(n))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))
