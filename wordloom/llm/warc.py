"""WARC archives through a table of chunks.

Writing: a payload becomes rows (record, chunk number, at most ``CHUNK`` bytes). A task streams its rows
into gzip archives, one member per record, so that neither a record nor its compressed form is ever
whole in Python. Reading streams the same way: each archive yields chunk rows, and a record's last row
carries its payload size and SHA-256, carried on from chunk to chunk.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page_id is
written as a response, the others as revisits without a payload. Only digests that occur more than
once take part in the join that decides this; they are broadcast while small (measured), else joined
by digest, where Spark splits a hot digest. Payloads are not shuffled in the first case.

A task that is run again writes archives under new names; only those of the attempt that succeeded are
in the manifest, which is the table that reading starts from. Archives roll at ``ARCHIVE`` bytes.

Defined results: a null or empty payload is a response of 0 bytes; a null page_id is written as an
empty id, reads back as null, and is never referred to (its copies refer to the smallest id that is
not null; without any they are responses); a null URL is written as an empty one. Repeated rows are
records of their own: those that carry the response's page_id are responses too. An empty table writes
no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import broadcast_if_small, keep, scratch

CHUNK = 1 << 16
ARCHIVE = 256 << 20
MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def chunk_rows(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload_bytes, digest, record_type, refers_to, chunk, chunks, data.

    Rows of a record follow each other within a partition. A revisit is one row without data.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body, 256).alias("digest"),
        body.alias("_body"),
    )
    copies = keep(
        rows.where(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1 and _first is not null")
        .select("digest", "_first"),
        "copies",
    )
    typed = rows.join(broadcast_if_small(copies, 96), "digest", "left").withColumn(
        "_copy", F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    )
    chunks = F.when(F.col("_copy"), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / CHUNK))).cast("int")
    return (
        typed.withColumn("chunks", chunks)
        .select(
            "page_id",
            "url",
            "payload_bytes",
            "digest",
            F.when(F.col("_copy"), "revisit").otherwise("response").alias("record_type"),
            F.when(F.col("_copy"), F.col("_first")).alias("refers_to"),
            "chunks",
            F.when(~F.col("_copy"), F.col("_body")).alias("_body"),
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        )
        .withColumn("data", F.substring("_body", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)))
        .drop("_body")
    )


def _head(row: dict) -> bytes:
    """WARC headers, and the HTTP headers of a response."""
    page = "" if row["page_id"] is None else row["page_id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{ID}{page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(row['url'].split())}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = b""
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{row['refers_to']}>", "Content-Length: 0"]
    else:
        http = (
            f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
        ).encode()
        lines.append(f"Content-Length: {len(http) + row['payload_bytes']}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes ``chunks`` below ``folder``; returns the stored manifest (archive, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open_folder(folder)
        out, name, records, size, member = None, "", 0, 0, None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            data = batch.column("data")
            rows = batch.drop_columns(["data"]).to_pylist()
            for i, row in enumerate(rows):
                if row["chunk"] == 0:
                    if out is not None and size >= ARCHIVE:
                        yield closed()
                        out = None
                    if out is None:
                        files.create_dir(base, recursive=True)
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    size += out.write(member.compress(_head(row)))
                if data[i].is_valid:
                    size += out.write(member.compress(data[i].as_buffer()))
                if row["chunk"] == row["chunks"] - 1:
                    size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
        if out is not None:
            yield closed()

    return keep(chunks.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


class _Stream:
    """Bytes of an archive of gzip members, in bounded blocks."""

    def __init__(self, source):
        self.source, self.inflate, self.raw, self.held, self.over = source, None, b"", bytearray(), False

    def _more(self) -> None:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                self.over = True
                return
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``, which is passed over; empty at the end of the archive."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            if self.over:
                if self.held:
                    raise ValueError("an archive ends within a record")
                return b""
            seen = max(0, len(self.held) - len(mark))
            self._more()
        got = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return got

    def take(self, n: int) -> bytes:
        """At most ``n`` bytes, at least one."""
        while not self.held and not self.over:
            self._more()
        if not self.held:
            raise ValueError("an archive ends within a record")
        got = bytes(self.held[:n])
        del self.held[:n]
        return got


def _number(urn: str) -> int | None:
    digits = urn.strip().removeprefix(f"<{ID}").removesuffix(">")
    return int(digits) if digits else None


def read_chunks(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, stated (digest of the header), chunk, data, last, and on
    the last row payload_bytes, payload_digest of what was read."""
    archives = manifest.select("archive")
    count = archives.count()
    names = ["page_id", "url", "record_type", "refers_to", "stated", "chunk", "data", "last", "payload_bytes", "payload_digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.string()]

    def records(stream: _Stream) -> Iterator[tuple]:
        while head := stream.until(b"\r\n\r\n"):
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            left = int(fields["Content-Length"])
            record = (
                _number(fields["WARC-Record-ID"]),
                fields["WARC-Target-URI"],
                fields["WARC-Type"],
                _number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
                fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            )
            if left:
                http = stream.until(b"\r\n\r\n")
                left -= len(http) + 4
            digest, size, chunk = hashlib.sha256(), 0, 0
            while True:
                data = bytearray()
                while left and len(data) < CHUNK:
                    got = stream.take(min(left, CHUNK - len(data)))
                    data += got
                    left -= len(got)
                digest.update(data)
                size += len(data)
                last = left == 0
                yield (*record, chunk, bytes(data), last, size if last else None, digest.hexdigest() if last else None)
                chunk += 1
                if last:
                    break
            stream.until(b"\r\n\r\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for row in records(_Stream(source)):
                        rows.append(row)
                        held += len(row[6]) + 256
                        if held >= 16 * CHUNK:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = (
        "page_id long, url string, record_type string, refers_to long, stated string, chunk int, data binary, "
        "last boolean, payload_bytes long, payload_digest string"
    )
    return archives.repartition(max(1, count)).mapInArrow(run, schema)


def records_of(chunks: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact: one row per record.

    A revisit takes size and digest from the response it refers to.
    """
    ends = chunks.where("last").drop("chunk", "data", "last")
    ends = keep(ends, "records")
    responses = (
        ends.where("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"))
        .agg(F.first("payload_bytes").alias("_bytes"))
    )
    revisits = ends.where("record_type = 'revisit'")
    found = revisits.join(
        responses, (F.col("refers_to") == F.col("_page")) & (F.col("stated") == F.col("_digest")), "left"
    ).select(
        "page_id", "url", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"),
        "record_type", "refers_to", F.col("_digest").isNotNull().alias("intact"),
    )
    own = ends.where("record_type = 'response'").select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
        (F.col("stated") == F.col("payload_digest")).alias("intact"),
    )
    return own.union(found)


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write_archives(chunk_rows(pages, id_col, url, payload), folder)
    return records_of(read_chunks(manifest, folder))
