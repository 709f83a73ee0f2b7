"""WARC archives written from and read as a chunked record table.

A payload is cut where it is scanned into (record, chunk number) rows of at most
``CHUNK`` bytes.  A writer task appends them to its archive as they come, and a
reader task streams an archive back as such rows; both carry the SHA-1 of the
payload so far, and neither holds more than a chunk of a record.

Of records with equal payloads the one with the smallest page id is stored as
response; the others are revisit records that refer to it.

Records are gzip members of their own, as archives are commonly kept, so any record
can be read from its offset alone.

Each writer task writes one archive under a name of its own attempt in the
shared folder, and reports it in a manifest written by Spark: what a failed or
repeated attempt left is not in the manifest and never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import fresh_path, keep, map_arrow

CHUNK = 1 << 20
#: Digests of payloads that repeat are broadcast up to this many (60 bytes each).
BROADCAST_PAYLOADS = 500_000
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: High half of record ids; the low half is the page id.
_SPACE = 0x7469646D_6B00_4000 << 64
_LOW = (1 << 64) - 1


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_SPACE | (page_id & _LOW))}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & _LOW
    return low - (1 << 64) if low >> 63 else low


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunk_rows(pages: DataFrame, *, min_bytes: int = 0, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, n_bytes, sha1 (hex), refers_to, chunk_no, n_chunks, data: the
    chunk rows of every page; those of a page stand together, in order.

    A revisit (refers_to not null) has one row without data.  The smallest page id
    of each payload comes from a partial aggregate over digests, and only digests
    that repeat are joined back: broadcast when few by count, else first to page
    ids, so that a payload that many pages share is no join key of the payloads.
    Only chunk numbers are exploded; each row then cuts its own chunk.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    named = rows.where((F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1", "n_bytes")
    again = named.groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    again = keep(again.where("low < high").select("sha1", "n_bytes", "low"), "payloads")
    if again.count() <= BROADCAST_PAYLOADS:
        found = rows.join(F.broadcast(again), ["sha1", "n_bytes"], "left")
    else:
        revisits = named.join(again, ["sha1", "n_bytes"]).where("low < page_id").distinct()
        found = rows.join(revisits, ["page_id", "sha1", "n_bytes"], "left")
    found = found.withColumn("refers_to", F.when(F.col("low") < F.col("page_id"), F.col("low")))
    n = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk))).otherwise(1).cast("int")
    numbered = found.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return numbered.select("page_id", "url", "n_bytes", "sha1", "refers_to", "n_chunks", "chunk_no", data.alias("data"))


def _heading(page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    size = len(http) + (n_bytes if refers_to is None else 0)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, sha1)}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base32_digest(bytes.fromhex(sha1))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is None:
        fields.append(("X-Page", "none"))
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() else "%" + c.encode().hex() for c in url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(size)))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def write_archives(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write every page as a record and return the manifest (path, n_records, n_bytes).

    Null html is empty; a null page id is never a revisit nor referred to; rows
    that repeat an id become records each (equal ones all responses); payloads of
    any length go chunk by chunk; other columns are ignored; empty tables write no
    archive.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, records = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            names = [n for n in batch.schema.names if n != "data"]
            data = batch.column(batch.schema.names.index("data"))
            for i, row in enumerate(batch.select(names).to_pylist()):
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}")
                if row["chunk_no"] == 0:
                    member, so_far = zlib.compressobj(1, wbits=31), hashlib.sha1(usedforsecurity=False)
                    out.write(member.compress(_heading(row["page_id"], row["url"], row["n_bytes"], row["sha1"], row["refers_to"])))
                    records += 1
                part = data[i].as_buffer()
                so_far.update(part)
                out.write(member.compress(part))
                if row["chunk_no"] == row["n_chunks"] - 1:
                    if row["refers_to"] is None and so_far.hexdigest() != row["sha1"]:
                        raise BadArchive(f"page {row['page_id']}: the chunks are not the payload of its digest")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}"], pa.string()), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

    return keep(map_arrow(chunk_rows(pages, **options), run, "path string, n_records long, n_bytes long"), "warc-manifest")


class BadArchive(ValueError):
    """An archive that does not hold what its headers say."""


def _fields(stream: BinaryIO) -> dict[str, str] | None:
    """Header fields of the next record, None at the end."""
    line = stream.readline()
    if not line:
        return None
    if line.rstrip(b"\r\n") != VERSION:
        raise BadArchive(f"no record starts with {line[:40]!r}")
    out: dict[str, str] = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(": ")
        out[name.lower()] = value
    return out


def _exactly(stream: BinaryIO, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise BadArchive(f"{n - len(data)} bytes are missing")
    return data


def read_chunks(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one archive: page_id, url, record_id, record_type, refers_to,
    chunk_no, last, n_bytes (of the whole payload), digest (base32 SHA-1 of the
    payload up to here; of the whole payload for a revisit) and data."""
    while (fields := _fields(stream)) is not None:
        left = int(fields["content-length"])
        http: dict[str, str] = {}
        while True:
            line = stream.readline()
            left -= len(line)
            if not line.strip():
                break
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            http[name.lower()] = value
        kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        row = {
            "page_id": None if "x-page" in fields else page_of(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "record_id": fields["warc-record-id"],
            "record_type": kind,
            "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
            "n_bytes": int(http["content-length"]),
        }
        if kind == "revisit":
            yield row | {"chunk_no": 0, "last": True, "digest": stated, "data": b""}
        else:
            so_far, number = hashlib.sha1(usedforsecurity=False), 0
            while True:
                data = _exactly(stream, min(left, chunk))
                left -= len(data)
                so_far.update(data)
                digest = base32_digest(so_far.digest())
                if not left and digest != stated:
                    raise BadArchive(f"{row['record_id']}: payload digest {digest}, {stated} stated")
                yield row | {"chunk_no": number, "last": not left, "digest": digest, "data": data}
                number += 1
                if not left:
                    break
        if _exactly(stream, 4) != b"\r\n\r\n":
            raise BadArchive(f"{row['record_id']}: no record end")


_READ = "page_id long, url string, record_id string, record_type string, refers_to long, n_bytes long, chunk_no int, last boolean, digest string"


def read_archives(manifest: DataFrame, *, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives of a manifest, a task for each archive;
    with ``data=False`` the payloads are read and digested but not returned."""
    schema = _READ + (", data binary" if data else "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    rows: list[dict] = []
                    size = 0
                    for row in read_chunks(stream, chunk):
                        rows.append(row)
                        size += 200 + (len(row["data"]) if data else 0)
                        if size > 4 * CHUNK:
                            yield out(rows)
                            rows, size = [], 0
                    if rows:
                        yield out(rows)

    files = manifest.select("path")
    return map_arrow(files.repartition(max(1, files.count())), run, schema)


def last_chunks(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    digest: Column = F.col("digest").alias("payload_digest")
    return chunks.where("last").select("page_id", F.col("n_bytes").alias("payload_bytes"), digest, "record_type", "refers_to")
