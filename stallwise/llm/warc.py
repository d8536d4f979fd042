"""WARC archives: write one record per page, read them back, salvage what follows damage.

Writing: payloads of 100 bytes or more that are equal are stored once; the smallest page id becomes the
``response`` and the others ``revisit`` records that refer to it. Records are built by native expressions,
each becomes a gzip member of its own, and Spark's text sink writes the members: its committer copes with
lost executors and any file system. The line separator is a zero byte; it takes the place of a member's last
byte, which is zero for records under 16 MB (a larger member is followed by it, and the reader skips zeros
between members). The number of files follows from the bytes, so an archive holds about ``file_bytes`` before
compression and one task holds one archive.

Reading: each archive is one task's work and is parsed in order. A record must have a version line, headers,
a length that ends before a record end, and a block that matches its digest. At each place a gzip member or a
version line may follow, whatever the archive began with. After a failed check the reader looks for the nearest
member or version line that begins a valid record, goes on from there, and reports the bytes between as a
quarantined gap. Plain, gzip (one or more records per member) and mixed archives are read. What a damaged member
inflated before its error is read too; as its checksum vouches for nothing, a digest must prove each such record.

Edge cases: a null payload is empty, a null url too; a null page id is written as ``null`` and read back as
null, and is never the response of a group that has another id; rows that repeat the smallest page id are all
responses; an empty table writes no record; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import materialise, new_path
from .base import small_batches, text_of

SMALLEST_SHARED = 100
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
# fixed values of the WARC 1.1 format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_VERSIONS = b"WARC/1."
_START = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_EITHER = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_PIECE = 1 << 16


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, int]:
    """The pages with digest, size and the page to refer to (null for responses), and the bytes of all."""
    keyed = pages.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7F]", "%20"), F.lit("")).alias("_url"),
        text_of(html_col).alias("_html"),
    )
    keyed = keyed.select(
        "*", F.sha2(F.col("_html").cast("binary"), 256).alias("_digest"), F.octet_length("_html").cast("long").alias("_bytes")
    )
    sizes = keyed.groupBy("_digest").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.min("_bytes").alias("_bytes"))
    sizes = materialise(sizes, "warc_payloads")
    total = sizes.agg(F.sum(F.col("_bytes") + 700 * F.col("_n"))).first()[0] or 0
    shared = sizes.filter((F.col("_n") > 1) & (F.col("_bytes") >= SMALLEST_SHARED)).select("_digest", "_first")
    # written by itself, so that its own size decides how it is joined
    shared = materialise(shared, "warc_shared")
    joined = keyed.join(shared, "_digest", "left")
    revisits = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("_refers", F.when(revisits, F.col("_first"))).drop("_first"), total


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    file_bytes: int = FILE_BYTES,
) -> None:
    rows, total = marked(pages, id_col, url_col, html_col)

    def name(c: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    line = F.lit("\r\n")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), line, line
    )
    is_revisit = F.col("_refers").isNotNull()
    rows = rows.select("*", F.when(is_revisit, http).otherwise(F.concat(http, F.col("_html"))).alias("_block"))
    refers = F.when(
        is_revisit, F.concat(F.lit("WARC-Refers-To: "), name("_refers"), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\n"))
    ).otherwise(F.lit(""))
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        name("_id"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.col("_url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("_digest"),
        F.lit("\r\nWARC-Block-Digest: sha256:"),
        F.sha2(F.col("_block").cast("binary"), 256),
        line,
        refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("_block").cast("string"),
        line,
        line,
        F.col("_block"),
        F.lit("\r\n\r\n"),
    )
    files = max(1, -(-total // file_bytes))

    @F.pandas_udf("binary")
    def member(records: pd.Series) -> pd.Series:
        packed = [gzip.compress(r.encode(), 1, mtime=0) for r in records]
        return pd.Series([m[:-1] if m[-1] == 0 else m for m in packed], dtype=object)

    small_batches(rows.sparkSession)
    members = rows.select(member(record).alias("value")).repartition(files)
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


class Record(NamedTuple):
    kind: str
    record_id: str
    refers_to: str | None
    uri: str
    payload_digest: str | None
    payload_bytes: int
    payload: bytes


class Failure(NamedTuple):
    """Why no record begins at a place, and from where on to look for the next version line."""

    reason: str
    look_from: int


def _parse(data: bytes, at: int, proof: bool = False) -> tuple[Record, int] | Failure:
    """The record that begins at ``at`` and the place after it, or what is wrong; ``proof`` asks for a digest.

    After a failure no place before ``look_from`` can do better: version lines inside broken headers lead to the
    same broken line, and of those inside whole headers the last one is tried. So headers are not read again
    for every version line in them.
    """
    start = _START.match(data, at)
    if not start:
        return Failure("no version line", at + 1)
    headers, place = {}, start.end()
    while True:
        line_end = data.find(b"\r\n", place)
        if line_end < 0:
            return Failure("headers do not end", len(data))
        if line_end == place:
            break
        key, colon, value = data[place:line_end].partition(b":")
        if not colon:
            return Failure("malformed header", place)
        headers[key.strip().lower()] = value.strip().decode("utf-8", "replace")
        place = line_end + 2
    last = data.rfind(_VERSIONS, start.end(), place)
    found = _checked(data, headers, place + 2, proof)
    return Failure(found, max(last, at + 1) if last >= 0 else place) if isinstance(found, str) else found


def _checked(data: bytes, headers: dict[bytes, str], begin: int, proof: bool) -> tuple[Record, int] | str:
    """The record of these headers whose block begins at ``begin``, or what is wrong."""
    length = headers.get(b"content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    stop = begin + int(length)
    if data[stop : stop + len(END)] != END:
        return "length does not end at a record end"
    block = data[begin:stop]
    algorithm, _, digest = headers.get(b"warc-block-digest", "").partition(":")
    if algorithm == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        return "block digest differs"
    proven = algorithm == "sha256"
    http, _, payload = block.partition(END)
    algorithm, _, digest = headers.get(b"warc-payload-digest", "").partition(":")
    digest = digest if algorithm == "sha256" else None
    kind = headers.get(b"warc-type", "")
    size = len(payload)
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
        size = int(found[1]) if found else 0
    else:
        actual = hashlib.sha256(payload).hexdigest()
        if digest is not None and digest != actual:
            return "payload digest differs"
        proven = proven or digest is not None
        digest = actual
    if proof and not proven:
        return "no digest in a damaged member"
    record = Record(
        kind,
        headers.get(b"warc-record-id", ""),
        headers.get(b"warc-refers-to"),
        headers.get(b"warc-target-uri", ""),
        digest,
        size,
        payload,
    )
    return record, stop + len(END)


def _records(data: bytes, proof: bool = False) -> Iterator[tuple[int, int, Record | str]]:
    """(offset, length, record or reason) over plain data."""
    at = 0
    while at < len(data):
        parsed = _parse(data, at, proof)
        if not isinstance(parsed, Failure):
            yield at, parsed[1] - at, parsed[0]
            at = parsed[1]
            continue
        reason, begin = parsed.reason, at
        found = _START.search(data, parsed.look_from)
        while found and isinstance(failed := _parse(data, found.start(), proof), Failure):
            found = _START.search(data, failed.look_from)
        at = found.start() if found else len(data)
        yield begin, at - begin, reason


class Member(NamedTuple):
    """Content of a gzip member and the place after it; if damaged, what was inflated up to the reason, and of
    that only what ends with the last proven record."""

    content: bytes
    after: int
    reason: str | None


def _member(data: bytes, at: int) -> Member:
    view = memoryview(data)
    reader = zlib.decompressobj(31)
    parts, place, reason = [], at, "member does not end"
    try:
        while place < len(data) and not reader.eof:
            parts.append(reader.decompress(view[place : place + _PIECE]))
            place += len(view[place : place + _PIECE])
    except zlib.error as error:
        reason = str(error)
        # the failed piece again, byte by byte
        reader = zlib.decompressobj(31)
        parts = [reader.decompress(view[at:place])]
        try:
            while place < len(data):
                parts.append(reader.decompress(view[place : place + 1]))
                place += 1
        except zlib.error:
            pass
    content = b"".join(parts)
    if reader.eof:
        return Member(content, place - len(reader.unused_data), None)
    sound = max((begin + size for begin, size, found in _records(content, proof=True) if isinstance(found, Record)), default=0)
    if not sound:
        return Member(b"", at, reason)
    reader = zlib.decompressobj(31)
    reader.decompress(view[at:place], sound)
    return Member(content[:sound], place - len(reader.unconsumed_tail), reason)


def _next(data: bytes, at: int, look_from: int) -> int:
    """The nearest place from ``at`` on where a valid record begins in a gzip member, or from ``look_from`` on one
    as it is; or the end."""
    found = _EITHER.search(data, at)
    while found:
        place = found.start()
        if data.startswith(_MEMBER, place):
            member = _member(data, place)
            if any(isinstance(inside, Record) for *_, inside in _records(member.content, member.reason is not None)):
                return place
        elif place >= look_from:
            parsed = _parse(data, place)
            if not isinstance(parsed, Failure):
                return place
            look_from = parsed.look_from
        found = _EITHER.search(data, place + 1)
    return len(data)


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(offset, length, record or the reason of a quarantined gap) over a whole archive.

    For records in gzip members offset and length are those of the member, of a damaged one up to its last
    proven record.
    """
    at = 0
    padded = False  # zeros are padding only after a member
    while at < len(data):
        if padded and data[at] == 0:
            at += 1
            continue
        begin, look_from, padded = at, at, data.startswith(_MEMBER, at)
        if padded:
            content, after, reason = _member(data, at)
            for *_, found in _records(content, reason is not None):
                yield at, after - at, found
            if reason is None:
                at = after
                continue
            begin = after
        else:
            parsed = _parse(data, at)
            if not isinstance(parsed, Failure):
                yield at, parsed[1] - at, parsed[0]
                at = parsed[1]
                continue
            reason, look_from = parsed
        at = _next(data, max(begin, at + 1), look_from)
        padded = False
        yield begin, at - begin, reason


READ_SCHEMA = (
    "path string, offset long, length long, reason string, record_type string, record_id string, "
    "refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (``reason`` null) and quarantined gaps (``reason`` set) of all archives under ``path``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                held = 0
                for offset, length, found in salvage(bytes(content)):
                    if isinstance(found, str):
                        rows.append((source, offset, length, found, *[None] * 7))
                    else:
                        payload = found.payload if payloads else None
                        held += len(payload or b"")
                        rows.append(
                            (source, offset, length, None, found.kind, found.record_id, found.refers_to, found.uri)
                            + (found.payload_bytes, found.payload_digest, payload)
                        )
                    if held > 8 << 20 or len(rows) == 5000:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, READ_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    frame["payload_bytes"] = frame["payload_bytes"].astype("Int64")
    return frame


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write ``pages`` to a new archive folder in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col)
    read = read_archives(spark, path, payloads=False).filter("reason is null")
    kind = pages.schema[id_col].dataType

    def page(c: str):
        return F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(.*)>$', 1), 'null') as {kind.simpleString()})")

    return read.select(
        page("record_id").alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )
