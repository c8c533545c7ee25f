"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader's tasks get byte ranges of the files. A task looks for the gzip
magic from the start of its range, accepts a place as a member when what is decompressed there begins with whole WARC
headers, and owns the records that start inside its range, reading past the end for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.files import open_fs
from loomline.scratch import fresh_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, of a read, and of decompressed data within which headers must end.
SPLIT, READ, HEAD = 16 << 20, 1 << 18, 1 << 16
LEVEL = 6
#: The date written; archives made from a table carry no time of capture.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """Header-safe: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = LEVEL) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page ``refers_to`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    name = "unknown" if page is None else str(page)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write every row of ``df`` as a record below ``folder``; returns the table ``path, bytes, records`` of its files.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others
    revisit it; rows with that same id again, and rows without an id, are responses too. A null html is an
    empty payload. Other columns of ``df`` are not read. A task's file appears under its final name when whole,
    so a repeated attempt replaces it by the same bytes. Lazy: each run of the result writes again.
    """
    src = df.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    slim = src.select("page", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("size"))
    first = slim.where((F.col("size") >= least) & F.col("page").isNotNull()).groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last").drop("last")
    refs = slim.where(F.col("page").isNotNull()).select("page", "digest").join(first, "digest").where("page <> first").groupBy("page", "digest").agg(F.min("first").alias("refers"))
    # payloads move by page, which spreads them evenly however often one of them occurs
    rows = src.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).join(refs, ["page", "digest"], "left").select("page", "url", "html", "digest", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, base = open_fs(folder)
        final = f"{base}/part-{ctx.partitionId():06d}.warc.gz"
        part, out, size, records = f"{final}.{ctx.taskAttemptId()}.tmp", None, 0, 0
        for b in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = member(page, url, html.encode("utf-8", "replace"), base64.b32encode(bytes.fromhex(digest)).decode(), refers)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(part)
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            out.close()
            fs.move(part, final)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{ctx.partitionId():06d}.warc.gz"] if records else [], pa.string()), pa.array([size] if records else [], pa.int64()), pa.array([records] if records else [], pa.int64())], names=["path", "bytes", "records"])

    return rows.mapInArrow(run, "path string, bytes long, records long")


def _headers(data: bytes) -> dict[str, str] | None:
    """Headers at the start of decompressed data; None if they are not whole WARC headers."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    out = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            return None
        out[k.strip().lower()] = v.strip()
    return out if "warc-type" in out and out.get("content-length", "").isdigit() else None


def _valid(f, at: int) -> bool:
    """Whether a member with whole WARC headers, of any length, begins at ``at``; reads no further than they go."""
    f.seek(at)
    d, out, start = zlib.decompressobj(31), bytearray(), b"WARC/1."
    try:
        while not d.eof:
            data = d.unconsumed_tail or f.read(READ)
            if not data:
                break
            seen = max(0, len(out) - 3)
            out += d.decompress(data, HEAD)
            if out[: len(start)] != start[: len(out)]:
                return False
            if out.find(b"\r\n\r\n", seen) >= 0:
                break
    except zlib.error:
        return False
    return _headers(bytes(out)) is not None


def _next(f, at: int, end: int) -> int | None:
    """First place from ``at`` on, before ``end``, where a member begins."""
    while at < end:
        f.seek(at)
        data = f.read(min(READ, end - at) + len(MAGIC) - 1)
        k = data.find(MAGIC)
        while 0 <= k < end - at:
            if _valid(f, at + k):
                return at + k
            k = data.find(MAGIC, k + 1)
        at += max(1, len(data) - len(MAGIC) + 1)
        if len(data) < len(MAGIC):
            return None
    return None


def records_in(f, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Position, headers and block of the records that start in [start, end) of an open file."""
    at = _next(f, start, end)
    while at is not None:
        f.seek(at)
        d, out, used = zlib.decompressobj(31), [], 0
        try:
            while not d.eof:
                data = f.read(READ)
                if not data:
                    break
                out.append(d.decompress(data))
                used += len(data)
            whole = d.eof
        except zlib.error:
            whole = False
        data = b"".join(out)
        head = _headers(data) if whole else None
        if head is None:  # damaged: look for the next member after it
            at = _next(f, at + 1, end)
            continue
        body = data.index(b"\r\n\r\n") + 4
        yield at, head, data[body : body + int(head["content-length"])]
        at += used - len(d.unused_data)
        if at >= end:
            return
        at = _next(f, at, end)


def read(files: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """The records of archives listed in ``files`` (columns path and bytes), whoever wrote them.

    Returns page (from the record id, null if it is another), url, record_type, refers_to, payload_bytes,
    payload_digest, intact (the payload has that digest; true for revisits) and, if asked for, the payload (null for revisits).
    Damaged members are skipped. Ranges are dealt out evenly; a record is read by one task only.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    n = max(1, int(files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1))
    fields = "page long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean" + ", payload binary" * payload
    names = [x.split()[0] for x in fields.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def number(v: str | None) -> int | None:
        tail = (v or "").rpartition(":page:")[2].rstrip(">")
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, local = open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(local) as f:
                    for _, h, block in records_in(f, start, min(size, start + split)):
                        cut = block.find(b"\r\n\r\n")
                        http, data = (block[: cut + 4], block[cut + 4 :]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)
                        digest, revisit = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h["warc-type"] == "revisit"
                        length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(data))
                        rows.append((number(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), length if revisit else len(data), digest, revisit or digest is None or digest == base32_sha1(data), None if revisit else data))
                        held += len(data)
                        if held > SPLIT:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names=names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names=names)

    return ranges.repartition(n).mapInArrow(run, fields)


def archive(df: DataFrame, id_col: str = "page_id", least: int = 0, split: int = SPLIT, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to archives in the shared folder and read them back: a row per row of ``df``, without payloads.

    An empty table gives no archive and no rows.
    """
    spark = spark or df.sparkSession
    folder = fresh_path(spark, "warc")
    listing = fresh_path(spark, "warc-files") + "/t"
    write(df, folder, id_col, least=least).write.parquet(listing)
    return read(spark.read.schema("path string, bytes long, records long").parquet(listing), split, payload=False)
