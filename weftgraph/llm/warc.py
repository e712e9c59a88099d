"""WARC archives: writing with segmentation, and segment reassembly.

Writing makes one record per page, a ``response`` with an HTTP message whose
body is in chunked transfer framing, or a ``revisit`` that names the response
with an equal payload. A block longer than the segment size is cut: the first
segment keeps the record's type, the others are ``continuation`` records that
name it as their origin.

A record's identifier states the page, its payload's digest and the copy's
number, so that repeated rows, and rows that share a page_id with other html,
are records of their own. A null page_id is written as ``none`` and read as null.

Reading parses each file by the records' lengths, groups continuation records
by the origin's identifier, orders them by segment number, verifies the total
length, and decodes the chunked framing. Every record, cut or not, is verified:
its block must be as long as its header says, and the payload that comes out must
have the stated length and digest. A record that fails, a set of segments with a
gap, a double number or a wrong total, and a body whose framing is broken have
``whole`` false and null payload. Numbers, digests and identifiers that can't be
read count as not stated. A block whose stated length is unreadable, or isn't
followed by empty lines and the next record or the end of the file, ends where
the next record begins, and its record is not whole; what follows is read. Payloads
are bytes; null html is an empty payload.

Archives of any version are read (``WARC/1.0``, ``WARC/1.1``), plain or gzip, one
stream or a member for each record; of a damaged member what can be read counts, and
what follows is read. Chunked bodies may have trailers.

Files are text files of at most ``FILE_RECORDS`` records of ``SEGMENT_BYTES``,
so a reader holds some 130 MB however many pages there are; each is one gzip
stream. A page's payload is put together in one task: that is its size. Repeated
rows are records of their own; an empty table gives no record; other columns of
pages, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, hot_join, release, scratch, slices, stored

#: Smallest payload that is stored once only.
LEAST_REVISIT = 1000
SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
#: Records of a file, at most.
FILE_RECORDS = 16_000
_DATE = "2024-01-01T00:00:00Z"
_VERSION = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
_ANY_VERSION = rb"WARC/\d+\.\d+\r\n"
_START = re.compile(_ANY_VERSION)
#: What follows a block: empty lines, then another record or the end of the file.
_FOLLOWS = re.compile(rb"[\r\n]*(?:" + _ANY_VERSION + rb"|\Z)")
_NEXT = re.compile(rb"(?:\r\n)*" + _ANY_VERSION + rb"(?=[A-Za-z-]+:)")
#: Packed bytes that are unpacked at a time; what a member leaves of them is copied.
_PACKED_BYTES = 64 << 10
_TRAILER = re.compile(rb"[!#-'*+.^-z|~\w-]+:[^\r\n]*")


def record_id(page_id: int | None, digest: str, copy: int = 1, segment: int = 1) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}:{copy}:{segment}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _trailers(rest: bytes) -> bool:
    """Whether header lines, or none, and one empty line are all that follows the last chunk."""
    return rest == b"\r\n" or (rest.endswith(_END) and all(_TRAILER.fullmatch(line) for line in rest[: -len(_END)].split(b"\r\n")))


def dechunked(data: bytes) -> bytes | None:
    """The body of chunked framing; null if the framing is broken."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out) if _trailers(data[at:]) else None
        part = data[at : at + size]
        if len(part) != size or data[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(part)
        at += size + 2


def _head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [*fields, ("Content-Length", str(length))]
    return _VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int, copy: int = 1) -> Iterator[bytes]:
    """The record of a page, or its segments, each without the blank lines after it."""
    bare = base64.b32encode(sha1(payload).digest()).decode()
    digest = "sha1:" + bare
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")
    base = [("WARC-Target-URI", target), ("WARC-Date", _DATE), ("WARC-Payload-Digest", digest), ("WARC-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, bare, copy)), ("WARC-Refers-To", record_id(refers_to, bare)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *base, kind]
        yield _head(fields, len(http)) + http
        return
    block = http + chunked(payload)
    cuts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    for i, cut in enumerate(cuts, 1):
        fields = [("WARC-Type", "response" if i == 1 else "continuation"), ("WARC-Record-ID", record_id(page_id, bare, copy, i)), *base]
        if len(cuts) > 1:
            fields.append(("WARC-Segment-Number", str(i)))
        if i > 1:
            fields.append(("WARC-Segment-Origin-ID", record_id(page_id, bare, copy)))
        if 1 < i == len(cuts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        if i == 1:
            fields.append(kind)
        yield _head(fields, len(cut)) + cut


def _to_records(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[str] = Counter()  # copies so far of the keys that have several; all rows of a key are in one task
        for batch in batches:
            for part in slices(batch, "payload"):
                places, out = [], []
                for page_id, url, payload, refers_to, repeated in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "repeated")), strict=True):
                    if repeated is not None:
                        met[repeated] += 1
                    for i, x in enumerate(records(page_id, url, payload or b"", refers_to, segment_bytes, 1 if repeated is None else met[repeated])):
                        places.append(i)
                        out.append((page_id, x))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array(places, pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["page_id", "segment", "record"])

    return run


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least: int = LEAST_REVISIT) -> None:
    """Writes WARC files under ``path``.

    Of records with equal payloads of ``least`` bytes or more, those with the
    largest page_id are responses and the others, null page_ids among them,
    revisit the first of these. Copies meet as (digest, largest id) before any
    shuffle, ids of a digest with many by a broadcast; the pages themselves move
    once, by page_id and digest.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.unhex(F.sha1(payload))
    key = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.sha1(payload))
    keyed = pages.select("page_id", digest.alias("digest"), key.alias("key"), F.octet_length(payload).alias("length"))
    groups = stored(keyed.groupBy("key", "page_id", "digest", "length").agg(F.count(F.lit(1)).alias("n")), "page_keys")
    of_digest = groups.where(F.col("length") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.sum("n").alias("several"), F.count(F.lit(1)).alias("ids"))
    kept = stored(of_digest.where("several > 1 and kept is not null").select("digest", "kept", "ids"), "kept_pages")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    none = F.lit(None)
    again = hot_join(groups, kept, "digest", "ids").select(F.col("key").alias("of"), refers_to.alias("refers_to"), none.cast("string").alias("repeated"))
    twice = groups.where("n > 1").select(F.col("key").alias("of"), none.cast("long").alias("refers_to"), F.col("key").alias("repeated"))
    told = again.where("refers_to is not null").unionByName(twice).groupBy("of").agg(F.max("refers_to").alias("refers_to"), F.max("repeated").alias("repeated"))
    # An explicit repartition is never split, so a task has all rows of its keys.
    rows = pages.select("page_id", "url", payload.alias("payload"), key.alias("key")).repartition("key")
    made = rows.join(told.hint("shuffle_hash"), F.col("key") == F.col("of"), "left").select("page_id", "url", "payload", "refers_to", "repeated")
    made = made.mapInArrow(_to_records(segment_bytes), "page_id long, segment long, record binary")
    # A text file with the two blank lines as separator is a WARC file; the bytes are written as they are.
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_PARSED = "record_id string, page_id long, type string, origin string, cut boolean, segment int, total long, refers_to long, digest string, length long, complete boolean, block binary"
_PARSED_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("origin", pa.string()), ("cut", pa.bool_()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("complete", pa.bool_()), ("block", pa.binary())])


def _number(text: str | None, bits: int = 63) -> int | None:
    """A whole number that fits; null if there is none."""
    if not text or len(text) > 20 or not text.removeprefix("-").isascii() or not text.removeprefix("-").isdigit():
        return None
    n = int(text)
    return n if -(1 << bits) <= n < 1 << bits else None


def _page_of(identifier: str | None) -> int | None:
    if not identifier or not identifier.startswith("<urn:page:"):
        return None
    return _number(identifier[10:-1].split(":")[0])


def _sha1_of(digest: str) -> str | None:
    try:
        return base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    except ValueError:
        return None


def _block_end(data: bytes, start: int, length: int | None) -> tuple[int, bool]:
    """Where a block ends, and whether that is where its header says.

    The stated end holds if nothing but empty lines is between it and another
    record or the end of the file. A block may hold what looks like a record, so
    the next one is looked for only where the stated end doesn't hold.
    """
    if length is not None and 0 <= length <= len(data) - start and _FOLLOWS.match(data, start + length):
        return start + length, True
    found = _NEXT.search(data, start)
    return (found.start() if found else len(data)), False


def parse_records(data: bytes) -> Iterator[tuple]:
    """The records of one archive, found by their lengths, as ``_PARSED`` has them."""
    at = 0
    while version := _START.search(data, at):
        head_end = data.find(_END, version.end())
        if head_end < 0:
            return
        fields = {}
        for line in data[version.end() : head_end].split(b"\r\n"):
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        start = head_end + len(_END)
        stop, complete = _block_end(data, start, _number(fields.get("content-length")))
        own = fields.get("warc-record-id", "")
        number = lambda k, bits=63, f=fields: _number(f.get(k), bits)
        yield (
            own, _page_of(own), fields.get("warc-type", ""), fields.get("warc-segment-origin-id", own), "warc-segment-number" in fields,
            number("warc-segment-number", 31) or 1, number("warc-segment-total-length"), _page_of(fields.get("warc-refers-to")),
            _sha1_of(fields.get("warc-payload-digest", "")), number("warc-payload-length"), complete, data[start:stop],
        )
        at = stop


def unpacked(data: bytes) -> bytes:
    """The bytes of an archive, plain or of any number of gzip members; damaged members give what can be read."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while 0 <= at < len(data):
        member, end = zlib.decompressobj(31), at
        try:
            while not member.eof and end < len(data):
                out.append(member.decompress(data[end : end + _PACKED_BYTES]))
                end = min(end + _PACKED_BYTES, len(data))
            out.append(member.flush())
        except zlib.error:
            pass
        at = end - len(member.unused_data) if member.eof else data.find(b"\x1f\x8b\x08", at + 3)
    return b"".join(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        release()
        for content in batch.column("content"):
            rows, held = [], 0
            data = content.as_py()
            for row in parse_records(unpacked(data)):
                rows.append(row)
                held += len(row[-1])
                if held > SLICE_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARSED_ARROW, strict=True)], schema=_PARSED_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_type, refers_to, whole, payload (null for revisits), digest and length as stated."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc}*").load(path)
    # One file is one row; wide enough to be dealt out, its records go on in small batches.
    parsed = files.select("content").mapInArrow(_parse, _PARSED)
    single = parsed.where("not cut")
    cut = parsed.where("cut")
    piece = F.struct("segment", "total", "block", "type", "refers_to", "digest", "length", "page_id", "complete")
    grouped = cut.groupBy("origin").agg(F.sort_array(F.collect_list(piece)).alias("s"))
    first, n = F.col("s")[0], F.size("s")
    numbers = F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), n)
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    stated = F.element_at("s", -1)["total"]
    whole = F.coalesce(numbers & (total == stated) & F.forall("s", lambda x: x["complete"]), F.lit(False))
    joined = grouped.select(
        F.col("origin").alias("record_id"), first["page_id"].alias("page_id"), first["type"].alias("type"), first["refers_to"].alias("refers_to"),
        first["digest"].alias("digest"), first["length"].alias("length"), whole.alias("whole"), F.transform("s", lambda x: x["block"]).alias("blocks"),
    )
    every = joined.unionByName(single.select("record_id", "page_id", "type", "refers_to", "digest", "length", F.col("complete").alias("whole"), F.array("block").alias("blocks")))
    return every.mapInArrow(_decode, "page_id long, record_type string, refers_to long, whole boolean, digest string, length long, payload binary")


def _payload(blocks: list[bytes], length: int | None, digest: str | None) -> bytes | None:
    """What a response's segments hold; null unless it is as long as stated and has the stated digest."""
    head, _, body = b"".join(blocks).partition(_END)
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if payload is None or length not in (None, len(payload)) or digest not in (None, sha1(payload).hexdigest()):
        return None
    return payload


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        release()
        payloads, whole = [], []
        for i, (kind, ok, length, digest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("type", "whole", "length", "digest")), strict=True)):
            payload = None
            if kind == "response" and ok:
                payload = _payload(batch.column("blocks")[i].as_py(), length, digest)
                ok = payload is not None
            payloads.append(payload)
            whole.append(ok)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("type"), batch.column("refers_to"), pa.array(whole, pa.bool_()), batch.column("digest"), batch.column("length"), pa.array(payloads, pa.binary())],
            names=["page_id", "record_type", "refers_to", "whole", "digest", "length", "payload"],
        )


def report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back and describes each page's record.

    Length and digest of a response are those of the payload that was put
    together again; a revisit states those of the payload it stands for.
    """
    path = scratch(pages.sparkSession, "archives")
    write_archives(pages, path)
    read = read_archives(pages.sparkSession, path)
    response = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
