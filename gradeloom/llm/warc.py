"""WARC archives: written as text files by Spark, read back by a reader that salvages what it can.

A record is one row of text: header lines, an empty line and the block; Spark's line separator is the two line ends that
close a record. The reader checks each record and, where a check fails, searches for the next version line (or the next
gzip member), goes on there and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, saved

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 1000
#: Bytes in one file, about; a reader task holds a file at a time.
FILE_BYTES = 8 << 20
#: Repeated payloads whose digests (some 60 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION = b"WARC/1.1\r\n"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; line ends in the value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(size, record): a WARC record per row.

    Of rows with equal payloads of at least `least_bytes` bytes that with the largest id is the response, the others revisit it.
    Null html: an empty payload; null ids are the smallest; rows that share the largest id are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1("html"))
    # Only payloads that occur again are looked up; counting them combines a hot payload before the shuffle.
    again = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = saved(again.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first"), "again")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    rows = rows.join(again, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(VERSION.decode()),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", name),
        _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        _header("X-Payload-Length", F.col("bytes")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    return rows.select(F.octet_length(block).cast("long").alias("size"), record.alias("record"))


def write(pages: DataFrame, path: str, *, file_bytes: int = FILE_BYTES, **columns) -> None:
    """Write the archives as Spark part files under `path`; a failed task's file never appears."""
    made = records(pages, **columns)
    sized = pages.agg(F.sum(F.octet_length(columns.get("html_col", "html"))).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    each = (sized["bytes"] or 0) // max(1, sized["n"]) + 700
    # files are cut by records where the rows lie: the payloads are not shuffled for it
    made.select("record").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, file_bytes // each)).text(path)


_NEXT = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record at `at`, or what is wrong with it."""
    if not (head := _NEXT.match(data, at)):
        return "no version line"
    stop = data.find(b"\r\n\r\n", head.end() - 2)
    if stop < 0:
        return "header not ended"
    headers = {}
    for line in data[head.end() : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return "header line without a colon"
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return "header incomplete"
    start = stop + 4
    end = start + int(headers["content-length"])
    if end > len(data):
        return "block cut short"
    if data[end : end + 4] != b"\r\n\r\n":
        return "record not closed"
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and hashlib.sha1(data[start:end]).hexdigest() != digest.lower():
        return "block digest differs"
    return headers, data[start:end], end + 4


def salvage(data: bytes) -> Iterator[tuple]:
    """Records and gaps of an archive, plain or of gzip members: ("record", offset, length, headers, block) or ("gap", offset, length, reason, None).

    After a failed check the search goes on one byte behind the failed start, so a record inside a damaged one's claimed
    length is still found. A gzip member may hold several records: each has the member's offset and length, and damage between them
    is a gap of its own. Empty data yields nothing.
    """
    step = _members if data[:2] == b"\x1f\x8b" or (_MEMBER in data and not _NEXT.search(data)) else _plain
    gap, why, at = None, "", 0
    while at < len(data):
        got = step(data, at)
        if isinstance(got, str):
            if gap is None:
                gap, why = at, got
            at = _resume(data, at + 1, step)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why, None
            gap = None
        parts, end = got
        for kind, what, block in parts:
            yield kind, at, end - at, what, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, why, None


def _resume(data: bytes, at: int, step) -> int:
    if step is _members:
        found = data.find(_MEMBER, at)
        return found if found >= 0 else len(data)
    found = _NEXT.search(data, at)
    return found.start() if found else len(data)


def _plain(data: bytes, at: int):
    """The record at `at`, as a list of one, and its end."""
    got = _parse(data, at)
    return got if isinstance(got, str) else ([("record", got[0], got[1])], got[2])


def _members(data: bytes, at: int):
    """The records and gaps of the gzip member at `at`, and its end; what is wrong with it if it holds no record."""
    if data[at : at + 3] != _MEMBER:
        return "no gzip member"
    inflate, content, end = zlib.decompressobj(31), bytearray(), at
    try:
        while not inflate.eof and end < len(data):  # by chunks: what is behind the member is not copied each time
            chunk = data[end : end + 65536]
            content += inflate.decompress(chunk)
            end += len(chunk)
    except zlib.error:
        return "gzip member damaged"
    if not inflate.eof:
        return "gzip member cut short"
    content, end = bytes(content), end - len(inflate.unused_data)
    found = list(salvage(content)) if _NEXT.search(content) else []
    if not any(kind == "record" for kind, *_ in found):
        return _parse(content, 0) if not found or isinstance(_parse(content, 0), str) else "no record in a gzip member"
    return [(kind, what if kind == "record" else f"{what}, {size} bytes from byte {inside} of the member", block) for kind, inside, size, what, block in found], end


ROWS = "file string, kind string, offset long, length long, reason string, record_type string, id string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read(spark, path: str) -> DataFrame:
    """Rows of all archives under `path`: kind 'record', or 'gap' with the place, length and reason of bytes that were passed over.

    A response's payload is checked against its digest; where they differ it is a gap too.
    """

    def parse(frames):
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                out = []
                for kind, at, size, head, block in salvage(bytes(data)):
                    if kind == "gap":
                        out.append((file, kind, at, size, head, *[None] * 7))
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and digest and hashlib.sha1(payload).hexdigest() != digest:
                        out.append((file, "gap", at, size, "payload digest differs", *[None] * 7))
                        continue
                    length = head.get("x-payload-length", "") if revisit else str(len(payload))
                    name, refers = (re.sub(r"^<urn:page:(.*)>$", r"\1", head[k]) if head.get(k) else None for k in ("warc-record-id", "warc-refers-to"))
                    out.append((file, kind, at, size, None, head["warc-type"], name, head.get("warc-target-uri"), refers, int(length) if length.isdigit() else None, digest or hashlib.sha1(payload).hexdigest(), None if revisit else payload))
                    if len(out) >= 200:
                        yield _frame(out)
                        out = []
                if out:
                    yield _frame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(parse, ROWS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in ROWS.split(", ")])
    frame["payload_bytes"] = frame["payload_bytes"].astype("Int64")
    return frame


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archive the pages and report what is read back: id, payload_bytes, payload_digest, record_type, refers_to.

    RuntimeError if any byte of the archives is passed over. Null html is an empty payload, null ids stay null, repeated rows are records
    each, an empty table gives no record; columns other than the three named are not read.
    """
    spark = pages.sparkSession
    path = new_dir(spark, "warc")
    write(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes)
    back = saved(read(spark, path).drop("payload"), "pages")
    gap = back.where("kind = 'gap'").select("file", "offset", "length", "reason").first()
    if gap:
        raise RuntimeError(f"{gap['length']} bytes of {gap['file']} from {gap['offset']} were passed over: {gap['reason']}")
    kind = pages.schema[id_col].dataType
    named = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return back.select(named("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"))
