"""WARC records as a chunked table.

A record is rows (record, chunk, data): chunk 0 has the WARC and HTTP headers,
then come payload chunks of at most ``chunk_bytes`` and a closing row.  In order
of (record, chunk) the data are the bytes of a WARC 1.1 archive, so neither
writing nor reading needs a whole record in memory: digests are carried from
chunk to chunk, and the reader parses the header and streams the rest.

Payloads with equal digests (of at least ``min_bytes``) are stored once: the
record with the smallest page id is a ``response``, others are ``revisit``
records that name it and have no payload.

Defined results: a null html is an empty payload; a null url is an empty target;
rows that repeat a page id are separate records, and all that share the smallest page id of a
payload are responses; extra columns are ignored; no pages give no records.
"""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
BROADCAST_RECORDS = 200_000
FRAME_BYTES = 4 << 20
CHUNK = "record long, page_id long, url string, chunk int, data binary, payload_bytes long, payload_digest string"
READ = "record long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _chunks(chunk_bytes: int):
    """Cuts payloads; the last row of a record has its size and digest, which are carried from chunk to chunk."""
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    def run(frames):
        rows, held = [], 0
        for f in frames:
            for record, page, url, html in zip(f["record"], f["page_id"].astype("Int64"), f["url"], f["html"]):
                sha, size, chunk, text, rest = hashlib.sha1(), 0, 0, html or "", b""
                # at most ``chunk_bytes`` characters, that is four times as many bytes, are encoded at a time
                for a in range(0, max(len(text), 1), chunk_bytes):
                    rest += text[a : a + chunk_bytes].encode("utf-8", "surrogatepass")
                    end = a + chunk_bytes >= len(text)
                    while len(rest) > chunk_bytes or end:
                        data, rest = rest[:chunk_bytes], rest[chunk_bytes:]
                        sha.update(data)
                        size, chunk, held = size + len(data), chunk + 1, held + len(data)
                        last = end and not rest
                        rows.append((record, page, url if chunk == 1 else None, chunk, data, size if last else None, base64.b32encode(sha.digest()).decode() if last else None))
                        if held >= FRAME_BYTES:
                            yield frame(rows)
                            rows, held = [], 0
                        if last:
                            break
        if rows:
            yield frame(rows)

    return run


def payload_chunks(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of ``CHUNK``: the payload of each page in chunks from 1, size and digest on the last."""
    flat = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return flat.mapInPandas(_chunks(chunk_bytes), CHUNK)


def _headers(frames):
    """Chunk 0 and the closing row of each decided record."""
    for f in frames:
        rows = []
        for record, page, url, size, digest, kind, refers, first in f.itertuples(index=False, name=None):
            block = len(HTTP) + (size if kind == "response" else 0)
            target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
            lines = [
                "WARC/1.1",
                f"WARC-Type: {kind}",
                f"WARC-Record-ID: <urn:page:{'' if pd.isna(page) else int(page)}:{record}>",
                f"WARC-Target-URI: {target}",
                f"WARC-Date: {DATE}",
                f"WARC-Payload-Digest: sha1:{digest}",
                f"X-Payload-Length: {size}",
                "Content-Type: application/http; msgtype=response",
                f"Content-Length: {block}",
            ]
            if kind == "revisit":
                lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{int(refers)}:{int(first)}>"]
            rows.append((record, 0, "\r\n".join(lines).encode() + END + HTTP))
            rows.append((record, 2**31 - 1, END))
        yield pd.DataFrame(rows, columns=["record", "chunk", "data"])


def write_archive(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = 1 << 16) -> DataFrame:
    """The written archive table (record, chunk, data)."""
    scratch = Scratch(pages.sparkSession, "warc")
    chunks = scratch.save(payload_chunks(pages, chunk_bytes), "payload")
    ends = chunks.where("payload_digest is not null").select("record", "page_id", "payload_bytes", "payload_digest")
    urls = chunks.where("chunk = 1").select("record", "url")
    first = ends.groupBy("payload_digest", "payload_bytes").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record"))).alias("first"))
    first = first.select("payload_digest", "payload_bytes", F.col("first.page_id").alias("first_page"), F.col("first.record").alias("first_record"))
    repeats = (F.col("payload_bytes") >= min_bytes) & (F.col("page_id") > F.col("first_page"))
    decided = ends.join(first, ["payload_digest", "payload_bytes"]).withColumn("repeats", F.coalesce(repeats, F.lit(False)))
    decided = scratch.save(decided.join(urls, "record"), "decided")
    kind = F.when(F.col("repeats"), "revisit").otherwise("response")
    heads = decided.select("record", "page_id", "url", "payload_bytes", "payload_digest", kind.alias("kind"), F.when(F.col("repeats"), F.col("first_page")).alias("refers"), "first_record")
    left_out = decided.where("repeats").select("record")
    # few repeats are broadcast, so that payloads need no exchange here; many are joined by exchange
    few = left_out.count() <= BROADCAST_RECORDS
    stored = chunks.select("record", "chunk", "data").join(F.broadcast(left_out) if few else left_out, "record", "left_anti")
    archive = heads.mapInPandas(_headers, "record long, chunk int, data binary").unionByName(stored)
    out = scratch.save(archive, "archive")
    scratch.drop("payload")
    return out


class _Reader:
    """One record at a time, fed with its bytes."""

    def __init__(self, record: int):
        self.record, self.head, self.fields, self.left = record, b"", None, 0
        self.sha, self.size, self.tail = hashlib.sha1(), 0, b""

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            warc, found, rest = self.head.partition(END)
            http, found2, body = rest.partition(END)
            if not (found and found2):
                return
            lines = warc.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"record {self.record} has no WARC header")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"]) - len(http) - len(END)
            self.head, data = b"", body
        part = data[: self.left]
        self.sha.update(part)
        self.size += len(part)
        self.left -= len(part)
        self.tail += data[len(part) :]

    def row(self) -> tuple:
        f = self.fields
        if f is None or self.left or self.tail != END:
            raise ValueError(f"record {self.record} is cut")
        told = f["WARC-Payload-Digest"].removeprefix("sha1:")
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").partition(":")[0]) else None
        kind, page = f["WARC-Type"], number(f["WARC-Record-ID"])
        if kind == "revisit":
            return self.record, page, int(f["X-Payload-Length"]), told, kind, number(f["WARC-Refers-To"])
        digest = base64.b32encode(self.sha.digest()).decode()
        if digest != told:
            raise ValueError(f"record {self.record} does not match its digest")
        return self.record, page, self.size, digest, kind, None


def _read(frames):
    now: _Reader | None = None

    def table(rows):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    for f in frames:
        rows = []
        for record, data in zip(f["record"], f["data"]):
            if now is None or now.record != record:
                if now is not None:
                    rows.append(now.row())
                now = _Reader(record)
            now.feed(data)
        yield table(rows)
    if now is not None:
        yield table([now.row()])


def read_archive(archive: DataFrame) -> DataFrame:
    """One row of ``READ`` per record, with each response's digest verified."""
    return archive.repartition("record").sortWithinPartitions("record", "chunk").select("record", "data").mapInPandas(_read, READ)


def write_files(archive: DataFrame, folder: str, files: int) -> None:
    """Archive files part-NNNNN.warc in a folder that all executors can write by path."""

    def run(frames):
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc"
        with open(name, "wb") as out:
            for f in frames:
                for data in f["data"]:
                    out.write(data)
        yield pd.DataFrame({"name": [name]})

    archive.repartition(files, "record").sortWithinPartitions("record", "chunk").select("data").mapInPandas(run, "name string").collect()
