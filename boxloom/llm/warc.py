"""WARC archives: write them as whole gzip streams, normalise them record by record, read them by offset.

A monolithic archive is one gzip stream over many records, so nothing in it can be reached without inflating all before
it. The normaliser inflates each file once, in small steps, writes every record as a gzip member of its own and a sidecar
index (offset, length, type, record id). Readers then take single members by their offsets. Files lie in the folder named
by spark.checkpoint.dir, reached through Arrow file systems; every attempt of a task writes names of its own, and only
those that a finished task returned are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, functions as F

from ..scale import shared_dir
from .common import cut, narrow

STEP = 1 << 18  # bytes inflated at a time
ARCHIVE = 64 << 20  # bytes of records in an archive, about
GZIP = 31
EARLY = 1 << 16


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri)


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def build_record(page_id, url: str | None, payload: bytes | None, digest: str, size: int, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit names the response it repeats and holds no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:] if x)}


def inflate(source, step: int = STEP) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or of many, in steps of bounded size."""
    engine = zlib.decompressobj(GZIP)
    while chunk := source.read(step):
        while chunk:
            if out := engine.decompress(chunk, 4 * step):
                yield out
            if engine.eof:
                chunk, engine = engine.unused_data, zlib.decompressobj(GZIP)
            else:
                chunk = engine.unconsumed_tail
    if out := engine.flush():
        yield out


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and whole bytes of each record of an inflated stream; one record is held at a time."""
    held = bytearray()

    def more(n: int) -> bool:
        while len(held) < n:
            piece = next(stream, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while more(1):
        at = held.find(b"\r\n\r\n")
        while at < 0:
            seen = max(len(held) - 3, 0)
            if not more(len(held) + 1):
                raise ValueError("an archive ends inside a record head")
            at = held.find(b"\r\n\r\n", seen)
        head = parse_head(bytes(held[:at]))
        size = at + 4 + int(head["content-length"]) + 4
        if not more(size):
            raise ValueError("an archive ends inside a record")
        yield head, bytes(held[:size])
        del held[:size]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE, level: int = 1) -> DataFrame:
    """Write monolithic archives of rows ``page_id, url, payload, refers_to, digest_hex, size``; one row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        out = engine = None
        names: list[str] = []
        counts: list[int] = []
        filled = 0
        for batch in batches:
            for page_id, url, payload, refers_to, digest, size in zip(*(batch.column(i) for i in range(6)), strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    counts.append(0)
                    system.create_dir(base, recursive=True)
                    out, engine, filled = system.open_output_stream(f"{base}/{names[-1]}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
                named = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                record = build_record(page_id.as_py(), url.as_py(), payload.as_py(), named, size.as_py(), refers_to.as_py())
                out.write(engine.compress(record))
                counts[-1] += 1
                filled += len(record)
                if filled >= archive_bytes:
                    out.write(engine.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    given = pages.select("page_id", "url", "payload", "refers_to", "digest_hex", "size")
    return given.mapInArrow(write, "archive string, records long")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite every archive with one gzip member per record, and a sidecar index; one row per file."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.members.warc.gz"
                offset = count = 0
                with system.open_input_stream(f"{base}/{archive}", compression=None) as source, \
                        system.open_output_stream(f"{base}/{name}", compression=None) as out, \
                        system.open_output_stream(f"{base}/{name}.index", compression=None) as index:
                    for head, whole in records(inflate(source)):
                        engine = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = engine.compress(whole) + engine.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": offset, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"]}).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["archive", "records"])

    return archives.select("archive").mapInArrow(rewrite, "archive string, records long")


def read_members(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, each member reached by its offset in the sidecar index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with system.open_input_stream(f"{base}/{archive}.index", compression=None) as f:
                    places = [json.loads(x) for x in f.read().splitlines()]
                with system.open_input_file(f"{base}/{archive}") as source:
                    for place in places:
                        source.seek(place["offset"])
                        whole = zlib.decompress(source.read(place["length"]), GZIP)
                        head = parse_head(whole[:whole.index(b"\r\n\r\n")])
                        block = whole[whole.index(b"\r\n\r\n") + 4:-4]
                        refers, digest, size = None, head["warc-payload-digest"].partition(":")[2], int(head["x-payload-length"])
                        if head["warc-type"] == "revisit":
                            refers = page_of(head["warc-refers-to"])
                        else:
                            payload = block[block.index(b"\r\n\r\n") + 4:]
                            if digest32(payload) != digest or len(payload) != size:
                                raise ValueError(f"payload of {head['warc-record-id']} in {archive} is not the one that was written")
                        rows.append((page_of(head["warc-record-id"]), size, digest, head["warc-type"], refers, archive, place["offset"], place["length"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names) if rows else \
                    pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
    return archives.select("archive").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long")


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to, digest_hex, size``: of equal payloads of ``least`` bytes or more the largest page_id
    is the response, the others refer to it. Pages without an id, and smaller payloads, are responses."""
    named = pages.withColumn("payload", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"))
    named = named.select("page_id", "url", "payload", F.sha1("payload").alias("digest_hex"), F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("second"))
    repeated = cut(
        named.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest_hex", "size", "second")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    joined = named.join(repeated, ["digest_hex", "size", "second"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("response_id"), F.col("response_id")).alias("refers_to"), "digest_hex", "size")


def warc_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row, normalise the archives, and read them back by offset; one row per input row.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and the place (``archive, offset, length``). A null
    html is an empty payload, a null url is about:blank, a page without an id is a response of its own. Rows that repeat
    id and payload are both responses when theirs is the largest id. An empty table gives no archive and no rows.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc_{uuid.uuid4().hex}"
    pages = mark_revisits(narrow(df, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long")), least)
    archives = cut(write_archives(pages, folder))
    tasks = max(archives.count(), 1)  # a file to a task
    members = cut(normalise(archives.repartition(tasks), folder))
    return read_members(members.repartition(tasks), folder)
