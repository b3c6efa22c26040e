"""WARC archives: writing segmented, chunk-framed records and putting them together again.

Writing. A payload is framed as a chunked HTTP response; a block longer than
``segment_bytes`` is cut into a first record and continuation records. Of equal
payloads of at least ``min_revisit`` bytes the one with the smallest id is the
response and the others are revisit records without a payload. Archives are written by
Spark's text sink with the record separator as line end, gzip-compressed.

Reading. Archives are cut at record starts by Spark's text source, so a file is never
held whole. Each piece must be as long as its Content-Length says; a payload that
itself holds the separator is put together from the next pieces, and anything else
fails the job. Continuations are grouped by the record they continue, ordered by
segment number, checked against the stated total length, and the chunked framing is
decoded. Digests are computed from the decoded payload and must equal those declared. A
record whose first, last or any other segment is lost fails the job, naming its origin.
Records of other kinds than response and revisit are passed over.

A null payload is an empty one. A null id is written as empty, reads back as null, and
is never the smallest while another id is there. Rows that repeat both id and payload
of a response are responses too. Line breaks and blanks in addresses are percent-
encoded. An empty table makes an empty archive.
"""

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.llm.common import emit, slices, workspace
from weblens.shipping import ship_package

VERSION = "WARC/1.1"
SEPARATOR = f"\r\n\r\n{VERSION}\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
MIN_REVISIT = 0
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# --- writing --------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; a chunk ends inside any record separator of the payload."""
    separator, parts, start = SEPARATOR.encode(), [], 0
    while start < len(payload):
        end = min(start + size, len(payload))
        at = payload.find(separator, start, end + len(separator))
        if 0 <= at < end:
            end = min(end, at + 6)
        parts.append(b"%x\r\n%b\r\n" % (end - start, payload[start:end]))
        start = end
    return b"".join(parts) + b"0\r\n\r\n"


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields if value is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _address(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "urn:none")


def _name(page_id, digest: str) -> str:
    """Record ID of the response that revisits refer to; its row is the only one of that id and payload."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def records(page_id, url: str | None, payload: bytes, first, digest: str, date: str, segment_bytes: int) -> list[bytes]:
    """The records of one row, each from its first header line to its block's end.

    ``first`` is the response of equal payloads, if there are any: its page_id, url and
    number of rows.
    """
    address, kind = _address(url), ("Content-Type", "application/http; msgtype=response")
    fresh = f"<{uuid.uuid4().urn}>"
    common = [("WARC-Date", date), ("WARC-Target-URI", address), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), kind]
    if first is not None and first["page_id"] != page_id:
        fields = [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", fresh), *common, ("X-Refers-To-Page-ID", first["page_id"]),
            ("WARC-Refers-To", _name(first["page_id"], digest) if first["rows"] == 1 else None),
            ("WARC-Refers-To-Target-URI", _address(first["url"])), ("WARC-Refers-To-Date", date),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
        return [_header(fields, _REVISIT)]
    name = _name(page_id, digest) if first is not None and first["rows"] == 1 else fresh
    block = _HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        return [_header([("WARC-Type", "response"), ("WARC-Record-ID", name), *common], block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_header([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        fields = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Target-URI", address),
            ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None),
        ]
        out.append(_header(fields, part))
    return out


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(date: str, segment_bytes: int):
    schema = pa.schema([("record", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = f"{VERSION}\r\n".encode()
        for batch in slices(batches, "payload", 4 << 20):
            rows = []
            for page_id, url, payload, first in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["payload"], batch["first"].to_pylist()):
                body = payload.as_buffer().to_pybytes()
                for record in records(page_id, url, body, first, base32_digest(body), date, segment_bytes):
                    rows.append((opening + record,))
            yield emit(rows, schema)

    return write


def write_archives(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = MIN_REVISIT, date: str | None = None
) -> None:
    """Archives of ``pages`` (page_id, url, payload as binary) in the new folder ``path``.

    ``date`` is every record's WARC-Date, the present moment by default.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("payload", F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    narrow = rows.select("digest", "page_id", "url", F.length("payload").alias("size")).groupBy("digest", "size", "page_id")
    by_id = narrow.agg(F.count("*").alias("rows"), F.min("url").alias("url"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "rows")))
    firsts = by_id.groupBy("digest", "size").agg(least.alias("first"), F.sum("rows").alias("copies"))
    firsts = firsts.where((F.col("copies") > 1) & (F.col("size") >= min_revisit)).select("digest", "first")
    firsts = workspace(pages.sparkSession, "warc-firsts").table("firsts", firsts)
    joined = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "first")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    made = joined.mapInArrow(_writer(date, segment_bytes), "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


# --- reading --------------------------------------------------------------

PARSED = pa.schema(
    [
        ("origin", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
        ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
    ]
)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if ":" in line)}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, from pieces cut at record separators.

    Lengths decide: a piece that ends too early goes on with the next one, and one in
    which a separator was not cut (it may straddle the text reader's buffers) holds more
    than one record.
    """
    separator, held = SEPARATOR.encode(), b""
    for piece in pieces:
        piece = held + separator + piece if held else piece.removeprefix(f"{VERSION}\r\n".encode())
        held = b""
        while piece.strip(b"\r\n"):
            head, found, rest = piece.partition(b"\r\n\r\n")
            fields = _fields(head)
            if not found or "content-length" not in fields:
                raise ValueError(f"no WARC record: {piece[:80]!r}")
            length = int(fields["content-length"])
            if len(rest) < length:
                held = piece
                break
            yield fields, rest[:length]
            piece = rest[length:]
            if piece.startswith(separator):
                piece = piece.removeprefix(separator)
            elif piece.strip(b"\r\n"):
                raise ValueError(f"{len(rest)} bytes in a record of {length}")
    if held:
        raise ValueError(f"archive ends inside a record: {held[:80]!r}")


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = (v.as_buffer().to_pybytes() for batch in batches for v in batch["value"])
    rows, size = [], 0
    for f, block in split_records(pieces):
        digest = (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
        rows.append((
            origin, f["warc-type"], _number(f.get("x-page-id")), f.get("warc-target-uri"), digest, _number(f.get("x-refers-to-page-id")),
            _number(f.get("warc-segment-number")), _number(f.get("warc-segment-total-length")), block,
        ))
        size += len(block)
        if size > 4 << 20:
            yield emit(rows, PARSED)
            rows, size = [], 0
    yield emit(rows, PARSED)


def dechunk(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            if not data[end:].endswith(b"\r\n\r\n"):  # the last chunk's line, perhaps trailers, and an empty line
                raise ValueError("chunked body without an end")
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) < size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def assemble(parts: list[tuple[int | None, int | None, bytes]]) -> bytes:
    """The whole block of (segment number, total length, block) records in any order."""
    if len(parts) == 1 and parts[0][0] is None:
        return parts[0][2]
    parts = sorted(parts)
    totals = [t for _, t, _ in parts if t is not None]
    block = b"".join(b for _, _, b in parts)
    if [n for n, _, _ in parts] != list(range(1, len(parts) + 1)) or totals != [len(block)]:
        raise ValueError(f"segments {[n for n, _, _ in parts][:9]} make {len(block)} bytes of {totals}")
    return block


WHOLE = pa.schema(
    [
        ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()),
        ("n_segments", pa.int32()), ("payload", pa.binary()),
    ]
)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            rows = []
            for r in batch.slice(start, 64).to_pylist():
                payload = None
                if r["kind"] is None:
                    raise ValueError(f"{r['origin']}: the first segment is missing")
                if r["kind"] == "response":
                    payload = http_payload(assemble([(p["segment"], p["total"], p["block"]) for p in r["parts"]]))
                    if r["digest"] not in (None, base32_digest(payload)):
                        raise ValueError(f"digest of page {r['page_id']} is not {r['digest']}")
                rows.append((r["kind"], r["page_id"], r["url"], r["digest"], r["refers_to"], len(r["parts"]), payload))
            yield emit(rows, WHOLE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record: kind, page_id, url, digest, refers_to, n_segments, payload."""
    ship_package()
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = "origin string, kind string, page_id long, url string, digest string, refers_to long, segment int, total long, block binary"
    parsed = pieces.mapInArrow(_parse, schema)
    part = F.struct("segment", "total", "block").alias("part")
    # Whole records need no shuffle of their blocks; only the segments of a record meet.
    fields = ("kind", "page_id", "url", "digest", "refers_to")
    kept = F.col("kind").isNull() | F.col("kind").isin("response", "revisit")
    whole = parsed.where("segment is null").where(kept).select("origin", *fields, F.array(part).alias("parts"))
    first = F.when((F.col("segment") == 1) & (F.col("kind") != "continuation"), F.struct(*fields))
    segments = parsed.where("segment is not null").groupBy("origin").agg(F.max(first).alias("f"), F.collect_list(part).alias("parts"))
    joined = whole.union(segments.select("origin", *[f"f.{c}" for c in fields], "parts").where(kept))
    out = "kind string, page_id long, url string, digest string, refers_to long, n_segments int, payload binary"
    return joined.mapInArrow(_decode, out)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("n_segments", pa.int32()), ("size", pa.int64())])
    for batch in batches:
        rows = []
        for kind, page_id, digest, refers_to, n, payload in zip(*[batch[c].to_pylist() for c in ("kind", "page_id", "digest", "refers_to", "n_segments")], batch["payload"]):
            body = payload.as_buffer().to_pybytes() if payload.is_valid else None
            rows.append((page_id, kind, digest if body is None else base32_digest(body), refers_to, n, None if body is None else len(body)))
        yield emit(rows, schema)


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, payload) and read them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to, n_segments. The
    length of a revisit's payload is that of the response it refers to.
    """
    spark = pages.sparkSession
    space = workspace(spark, "warc")
    write_archives(pages, space.file("archives"), segment_bytes, min_revisit)
    schema = "page_id long, kind string, digest string, refers_to long, n_segments int, size long"
    rows = space.table("rows", read_archives(spark, space.file("archives")).mapInArrow(_summaries, schema))
    sizes = rows.where("kind = 'response'").groupBy("digest").agg(F.max("size").alias("first_size"))
    return rows.join(sizes, "digest", "left").select(
        "page_id",
        F.coalesce("size", "first_size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to", "n_segments",
    )
