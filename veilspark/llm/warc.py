"""Web archives: a writer of gzip members, one for a record, and a splittable reader.

The reader's tasks take byte ranges. A task looks for gzip magic in its range, decodes the head of
each candidate and takes it as a member if a WARC version line comes out; it owns the records whose
members start in its range and reads past the end of the range where a member does. So any number
of tasks read one archive with neither an index nor a record lost or read twice.

Archives are read and written by pyarrow's file systems, so a path can be in any store that these
know; the folder must be shared by all executors.

Defined cases: a null html is an empty payload. Payloads below `revisit_bytes` are always
responses. Among rows with equal payloads that repeat a page_id, all rows with the largest page_id
are responses. A null page_id is kept as null. An empty table writes and reads nothing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import small
from .common import kept, salted_join, work_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
FILES = "path string, bytes long"
RECORD = "path string, member_at long, record_type string, page_id long, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"
#: Bytes of a reader's range, of a read, fed to a decoder at once, and decoded of a candidate to know it.
RANGE, READ, BITE, HEAD = 16 << 20, 1 << 20, 8192, 512
#: Tasks of a reader at most; beyond, a task takes several ranges.
TASKS = 50_000


def opened(path: str):
    """File system and path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def member(record_type: str, page_id: int | None, refers_to: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    """One record as a gzip member. A revisit has the response's head only; its Content-Length is
    that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if record_type == "response" else b"")
    lines = [f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def record(data: bytes) -> dict:
    """A decoded member's fields."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != told or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")

    def page(uri: str | None) -> int | None:
        number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return {
        "record_type": kind, "page_id": page(fields["warc-record-id"]), "refers_to": page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"),
        "payload_digest": digest, "payload_bytes": told, "payload": payload if kind == "response" else None,
    }


class Window:
    """A moving part of a file: forgets what lies before the place in use."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.at + len(self.data)
        if end > have:
            self.file.seek(have)
            self.data += self.file.read(max(end - have, min(READ, self.size - have)))

    def forget(self, at: int) -> None:
        if at - self.at >= READ:
            self.data, self.at = self.data[at - self.at :], at


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the members that start in [start, end)."""
    window, at = Window(file, size, start), start
    while at < min(end, size):
        window.forget(at)
        window.upto(at + READ)
        found = window.data.find(MAGIC, at - window.at)
        if found < 0:
            at = max(at + 1, window.at + len(window.data) - len(MAGIC) + 1)
            if window.at + len(window.data) >= size:
                return
            continue
        at = window.at + found
        if at >= end:
            return
        window.upto(at + 4 * HEAD)
        try:
            if not zlib.decompressobj(31).decompress(window.data[at - window.at : at - window.at + 4 * HEAD], HEAD).startswith(b"WARC/1."):
                raise zlib.error("no record")
        except zlib.error:
            at += 1
            continue
        inflate, parts, read = zlib.decompressobj(31), [], at
        while not inflate.eof:
            window.upto(read + 1)
            chunk = window.data[read - window.at : read - window.at + BITE]
            if not chunk:
                raise ValueError(f"cut member at {at}")
            parts.append(inflate.decompress(chunk))
            read += len(chunk)
        yield at, b"".join(parts)
        at = read - len(inflate.unused_data)


def typed(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to. Only digests meet in the aggregation. Pages are
    shuffled only if the repeated payloads are too many to broadcast, and then the rows of a hot payload
    are dealt over many tasks."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    groups = rows.filter(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    groups = kept(groups, "repeated")
    if small(groups):
        seen = rows.join(F.broadcast(groups), "digest", "left")
    else:
        seen = salted_join(rows, groups, ["digest"], F.struct("page_id", "url"), "left", salts=16)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return seen.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write an archive for each partition; returns path and bytes of each. A repeated task writes
    another name; only the names that are returned count."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        store, name = opened(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        size = 0
        with store.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for page_id, refers_to, url, html, digest, kind in zip(*(batch[c].astype("Int64") for c in ("page_id", "refers_to")), *(batch[c] for c in ("url", "html", "digest", "record_type")), strict=True):
                    data = member(kind, None if page_id is pd.NA else page_id, None if refers_to is pd.NA else refers_to, url, html.encode(), digest)
                    out.write(data)
                    size += len(data)
        yield pd.DataFrame({"path": [path], "bytes": [size]})

    return records.mapInPandas(write, FILES)


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Records of the archives in files (path, bytes), by byte ranges of at most range_bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"], strict=True):
                store, name = opened(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for at, data in members(file, size, start, start + range_bytes):
                        rows.append({"path": path, "member_at": at, **record(data)})
                        held += len(data)
                        if held >= READ:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    starts = files.filter("bytes > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))))
    # A number of partitions that is given isn't coalesced: a range is small as a row and large to read.
    tasks = min(TASKS, files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / range_bytes)), F.lit(0))).first()[0])
    return starts.repartition(max(1, tasks), "path", "start").mapInPandas(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, revisit_bytes: int = 1000, range_bytes: int = RANGE) -> DataFrame:
    """Write the pages as archives in the shared folder and read the archives back."""
    folder = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    files = kept(write_warc(typed(pages, revisit_bytes), folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"), "warc-files")
    return read_warc(spark, files, range_bytes)
