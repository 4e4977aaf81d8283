r"""WARC archives, index first.

Writing gives one gzip member per record and, for each record, a row of the index: file, offset, length, url, digest. The
index is stored before anything is read; reading sorts the selected rows by file and offset, coalesces neighbouring byte
ranges into bounded reads, and parses the records out of them. Equal payloads are stored once: the record with the
smallest page_id is the response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkseam.llm.common import scratch

#: Neighbouring records are read together up to so many bytes, over gaps of at most GAP bytes.
READ_BYTES, GAP = 8 << 20, 64 << 10
#: An archive file is closed after so many bytes.
FILE_BYTES = 512 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head only; the extension field WARC-Payload-Length keeps its size."""
    target = quote(url or "", safe="%/:?#[]@!$&'()*+,;=-._~")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if is_revisit else payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record and its payload (null for revisits); a payload that doesn't fit its digest raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    out = {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in fields else None,
        "payload": None,
    }
    if out["record_type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if digest(out["payload"]) != out["payload_digest"] or len(out["payload"]) != out["payload_bytes"]:
            raise ValueError(f"the payload of page {out['page_id']} doesn't fit its digest")
    return out


def assign_roles(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with wr_first, the smallest page_id with the same payload.

    Payloads are held equal by SHA-256. What is counted are digests, combined before the shuffle; then each page, payload
    included, is shuffled once by its digest, in a join that adaptive execution splits where a digest is hot.
    """
    keyed = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("wr_key"))
    first = keyed.groupBy("wr_key").agg(F.min("page_id").alias("wr_first"), F.count("*").alias("wr_n")).where("wr_n > 1")
    return keyed.join(first.drop("wr_n"), "wr_key", "left").drop("wr_key")


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html) under folder, then the index beside them; gives the index.

    A null html is an empty payload, a null url an empty target; rows without page_id are responses unless a row with one
    has the same payload; rows that repeat a payload's smallest page_id are responses as well. Extra columns, whatever their
    names, are ignored. A very long payload is one record, held in memory as a whole. An empty table gives an empty index.
    Each task attempt writes files of its own and only the index says which count, so a lost or repeated task leaves
    nothing but unused files. The folder must be one that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out = name = None
        number = offset = 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, first in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").cast(pa.binary()).to_pylist(), batch.column("wr_first").to_pylist()):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{stem}-{number}.warc.gz", 0
                        number += 1
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = html or b""
                    revisit = first is not None and page_id != first
                    raw = gzip.compress(record(page_id, url, payload, first, revisit), 1, mtime=0)
                    out.write(raw)
                    rows.append((page_id, url, "revisit" if revisit else "response", digest(payload), len(payload), first if revisit else None, name, offset, len(raw)))
                    offset += len(raw)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX_TYPES)], names=INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    index = assign_roles(pages).mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
INDEX_TYPES = [_KINDS[x.split()[1]] for x in INDEX.split(", ")]


def coalesced(rows: list[tuple[str, int, int]], read_bytes: int = READ_BYTES, gap: int = GAP) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (file, offset, length) rows as reads (file, offset, length, row numbers)."""
    held: tuple[str, int, int, list[int]] | None = None
    for i, (file, offset, length) in enumerate(rows):
        if held and held[0] == file and offset - (held[1] + held[2]) <= gap and offset + length - held[1] <= read_bytes:
            held = (file, held[1], max(held[2], offset + length - held[1]), [*held[3], i])
        else:
            if held:
                yield held
            held = (file, offset, length, [i])
    if held:
        yield held


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the index's rows (any selection of them); the payload column only if asked for."""
    names = [x for x in RECORD.split(", ") if payload or not x.startswith("payload binary")]
    kinds = [_KINDS[x.split()[1]] for x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        opened: tuple[str, pafs.NativeFile] | None = None
        for batch in batches:
            wanted = list(zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            urls = batch.column("url").to_pylist()
            for file, start, size, members in coalesced(wanted):
                if opened is None or opened[0] != file:
                    if opened:
                        opened[1].close()
                    opened = (file, fs.open_input_file(f"{base}/{file}"))
                raw = opened[1].read_at(size, start)
                rows = []
                for i in members:
                    _, offset, length = wanted[i]
                    got = parse(zlib.decompress(raw[offset - start : offset - start + length], 31)) | {"url": urls[i]}
                    rows.append([got[x.split()[0]] for x in names])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in names])
        if opened:
            opened[1].close()

    placed = index.select("file", "offset", "length", "url").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, ", ".join(names))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BIT = " + ".join(f"{2 ** (4 - k)} * CAST(substr(b, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(h) AS n, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS b, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + {_BIT} AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id IS DISTINCT FROM f AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to FROM q
"""
