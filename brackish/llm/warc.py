"""WARC archives over a chunked record table.

A payload is never held as one record while it is written or read: it becomes chunk rows (record
identifier, chunk number), each written as a WARC segment of its own (the standard's response and
continuation records), and its SHA-256 is carried on from chunk to chunk. Archives are written and
read with Spark's text source, record by record, so they live in any store that Spark reaches and
a lost task is simply run again; files written without compression are also split when read.

The separator between records is ``CRLF CRLF WARC/1.1 CRLF``. A payload that contains it is cut
inside of it, so the separator never occurs within a segment.

1. Digests: one pass over the payloads, chunk by chunk.
2. The first page of each digest, by a count that combines map-side.
3. Records: the pages meet their decision by page and are written as segments.
4. Reading: segments are parsed in file order; the digest is carried along consecutive segments.
   Pieces of a record that a file split has torn apart are brought together by record, sorted, and
   digested in one stream.

A record's identifier is made of its page and digest, so a revisit names the record it refers to.

Defined results: a NULL payload is empty. Payloads under `LEAST` bytes are always responses. Of
equal payloads the smallest page_id is the response (NULL last); rows that repeat it are responses
too. Columns other than page, address and payload are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.llm.text import rows, utf8
from brackish.operators.keys import join_on
from brackish.operators.ordered import with_row_index
from brackish.session import scratch_path, settle

#: Smallest payload that a revisit may stand for, and the most bytes of a segment.
LEAST = 100
CHUNK = 1 << 20

_END = b"\r\n\r\n"
_VERSION = b"WARC/1.1\r\n"
SEPARATOR = (_END + _VERSION).decode()
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


_SEPARATOR = re.compile(re.escape(_END + _VERSION))


def cuts(block: memoryview, size: int) -> list[tuple[int, int]]:
    """Ends of segments of at most `size` bytes, none of which completes a separator.

    A header's blank line stands before each segment, so its start counts as well.
    """
    out, at = [], 0
    while at < len(block):
        end = min(at + size, len(block))
        if block[at : at + len(_VERSION)] == _VERSION:
            end = at + 1
        elif found := _SEPARATOR.search(block, at, end):
            end = found.start() + len(_END) + 1
        out.append((at, end))
        at = end
    return out or [(0, 0)]


def _digest(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        sizes, digests = [], []
        for value in batch.column("payload"):
            payload = memoryview(value.as_buffer())
            running = hashlib.sha256()
            for at in range(0, len(payload), chunk):
                running.update(payload[at : at + chunk])
            sizes.append(len(payload))
            digests.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["page_id", "url"]).columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
            ["page_id", "url", "bytes", "digest"],
        )


def _head(record: str, kind: str, number: int, count: int, fields: list[tuple[str, object]], length: int) -> bytes:
    """One segment's version line and header."""
    lines: list[tuple[str, object]] = [("WARC-Type", kind if number == 1 else "continuation")]
    lines.append(("WARC-Record-ID", f"<{record}>" if number == 1 else f"<{record}/{number}>"))
    if count > 1:
        lines.append(("WARC-Segment-Number", number))
        if number > 1:
            lines.append(("WARC-Segment-Origin-ID", f"<{record}>"))
    lines += fields
    lines.append(("Content-Length", length))
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


def _urn(page: object, digest: str, copy: int = 0) -> str:
    """A record's identifier: page, payload and, for rows that repeat both, a number.

    A revisit derives it for the record that it refers to. A NULL page is empty, an empty one "+".
    """
    name = "" if page is None else quote(str(page), safe="") or "+"
    return f"urn:page:{name}#{digest}" + (f".{copy}" if copy else "")


def _clean(url: str | None) -> str:
    """An address on one line."""
    return " ".join((url or "").split())


#: Bytes of segments that a task gathers before it passes them on.
_BUFFER = 8 << 20


def _segments(batches: Iterator[pa.RecordBatch], chunk: int, date: str) -> Iterator[pa.RecordBatch]:
    """Segments of the payloads, cut from Arrow's own buffer, a few megabytes at a time."""
    out: list[bytes] = []
    held = 0
    for batch in batches:
        for row in range(batch.num_rows):
            names = ("page_id", "url", "bytes", "digest", "copy", "refers", "refers_url", "is_revisit")
            page, url, size, digest, copy, refers, refers_url, revisit = (batch.column(c)[row].as_py() for c in names)
            payload = memoryview(batch.column("payload")[row].as_buffer())
            record = _urn(page, digest, copy)
            fields: list[tuple[str, object]] = [
                ("WARC-Date", date),
                ("WARC-Target-URI", _clean(url)),
                ("WARC-Payload-Digest", f"sha256:{digest}"),
                ("Payload-Length", size),
            ]
            if revisit:
                fields += [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<{_urn(refers, digest)}>"),
                    ("WARC-Refers-To-Target-URI", _clean(refers_url)),
                    ("WARC-Refers-To-Date", date),
                ]
                pieces, kind, head = [(0, 0)], "revisit", b""
            else:
                fields.append(("Content-Type", "application/http; msgtype=response"))
                pieces, kind, head = cuts(payload, chunk), "response", _HTTP + _END
            for number, (at, end) in enumerate(pieces, 1):
                more = fields if number == 1 else fields[:2]
                if number == len(pieces) > 1:
                    more = [*more, ("WARC-Segment-Total-Length", len(_HTTP + _END) + size)]
                start = head if number == 1 else b""
                header = _head(record, kind, number, len(pieces), more, len(start) + end - at)
                out.append(b"".join((header, start, payload[at:end])))
                held += len(out[-1])
                if held >= _BUFFER:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archive(
    pages: DataFrame,
    path: str,
    page: str = "page_id",
    url: str = "url",
    payload: str = "html",
    chunk: int = CHUNK,
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
) -> None:
    """Write one record per page under `path`; a payload already seen becomes a revisit."""
    plain = pages.select(
        F.col(f"`{page}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), utf8(payload).alias("payload")
    )
    kind = plain.schema["page_id"].dataType.simpleString()
    digests = plain.mapInArrow(partial(_digest, chunk=chunk), f"page_id {kind}, url string, bytes long, digest string")
    digests = settle(digests, "digests")
    order = F.struct(F.col("page_id").isNull().alias("x"), "page_id", "url")
    large = digests.where(F.col("bytes") >= LEAST)
    firsts = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", F.col("first.page_id").alias("refers"), F.col("first.url").alias("refers_url"))
    again = join_on(large, settle(firsts, "firsts"), ["digest"], "inner")
    again = again.where("NOT page_id <=> refers").select("page_id", "digest", "refers", "refers_url").distinct()
    # the digest is made again beside the payload: cheaper than moving it, and right for repeated page_ids
    marked = plain.mapInArrow(partial(_beside, chunk=chunk), f"page_id {kind}, url string, payload binary, bytes long, digest string")
    marked = _numbered(marked, settle(digests.groupBy("page_id", "digest").count().where("count > 1").drop("count"), "repeated"))
    records = join_on(marked, settle(again, "revisits").withColumn("is_revisit", F.lit(True)), ["page_id", "digest"], "left")
    schema = "record binary"
    segments = records.select(
        "page_id", "url", "payload", "bytes", "digest", "copy", "refers", "refers_url",
        F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"),
    ).mapInArrow(partial(_segments, chunk=chunk, date=date), schema)
    segments.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END.decode()).option(
        "compression", compression
    ).text(path)


def _numbered(marked: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds ``copy``: 0, 1, ... in the order of addresses for rows that repeat page and payload, else 0."""
    single = marked.withColumn("copy", F.lit(0).cast("long"))
    if repeated.isEmpty():
        return single
    keys = ["page_id", "digest"]
    # in ranges, so one page that a third of the rows repeat is spread over tasks
    copies = with_row_index(join_on(marked, repeated, keys, "left_semi"), keys, ["url"], "copy")
    return join_on(single, repeated, keys, "left_anti").unionByName(copies)


def _beside(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        made = next(_digest(iter([batch]), chunk)) if batch.num_rows else None
        if made is not None:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, made.column("bytes"), made.column("digest")], ["page_id", "url", "payload", "bytes", "digest"]
            )


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.removeprefix(_VERSION).partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ": " in line)
    length = int(fields["Content-Length"])
    if len(body) < length or body[length:].strip(b"\r\n"):
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: {len(body)} bytes, {length} declared")
    return fields, body[:length]


_CHUNKS = (
    "record_id string, chunk int, record_type string, refers_to string, declared_bytes long, declared_digest string, "
    "chunks int, payload binary"
)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches, 64):
        out: list[dict] = []
        for record in batch.column("record").to_pylist():
            if not record.strip(b"\r\n"):
                continue
            fields, body = _parse(record)
            number = int(fields.get("WARC-Segment-Number", 1))
            if number == 1 and fields["WARC-Type"] == "response":
                body = body.partition(_END)[2]
            total = fields.get("WARC-Segment-Total-Length")
            digest = fields.get("WARC-Payload-Digest")
            out.append(
                {
                    "record_id": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])[1:-1],
                    "chunk": number,
                    "record_type": fields["WARC-Type"],
                    "refers_to": fields["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in fields else None,
                    "declared_bytes": int(fields["Payload-Length"]) if digest else None,
                    "declared_digest": digest.removeprefix("sha256:") if digest else None,
                    # a record in one piece says so; of the others the last piece knows the number
                    "chunks": number if total or "WARC-Segment-Number" not in fields else None,
                    "payload": body,
                }
            )
        yield pa.RecordBatch.from_pylist(out, _CHUNK_SCHEMA)


_CHUNK_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("chunk", pa.int32()), ("record_type", pa.string()), ("refers_to", pa.string()),
        ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunks", pa.int32()), ("payload", pa.binary()),
    ]
)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives written by `write_archive`: one row per segment."""
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    return lines.select(F.col("value").cast("binary").alias("record")).mapInArrow(_chunk_rows, _CHUNKS)


_RECORDS = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def _check(row: dict, size: int, digest: str) -> dict:
    if row["record_type"] == "revisit":
        size, digest = row["declared_bytes"], row["declared_digest"]
    elif (size, digest) != (row["declared_bytes"], row["declared_digest"]):
        raise ValueError(f"record {row['record_id']}: its payload does not have the declared digest")
    return {k: row[k] for k in ("record_id", "record_type", "refers_to")} | {"payload_bytes": size, "payload_digest": digest}


_RECORD_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest consecutive chunks of a record, holding one chunk at a time."""
    first, running, size, at = None, None, 0, 0
    for batch in rows(batches, 64):
        out = []
        for row in batch.to_pylist():
            if row["chunk"] == 1:
                if first is not None:
                    raise ValueError(f"record {first['record_id']}: its last chunk is missing")
                first, running, size, at = row, hashlib.sha256(), 0, 0
            if first is None or row["record_id"] != first["record_id"] or row["chunk"] != at + 1:
                raise ValueError(f"record {row['record_id']}: chunk {row['chunk']} is out of order")
            at += 1
            running.update(row["payload"])
            size += len(row["payload"])
            if row["chunks"] == at:
                out.append(_check(first, size, running.hexdigest()))
                first = None
        yield pa.RecordBatch.from_pylist(out, _RECORD_SCHEMA)
    if first is not None:
        raise ValueError(f"record {first['record_id']}: its last chunk is missing")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record: record_id, record_type, refers_to, payload_bytes, payload_digest, checked."""
    chunks = read_chunks(spark, path)
    whole = chunks.where("chunk = 1 AND chunks = 1").mapInArrow(_stream, _RECORDS)
    torn = chunks.where("NOT (chunk = 1 AND chunks <=> 1)").repartition("record_id")
    return whole.unionAll(torn.sortWithinPartitions("record_id", "chunk").mapInArrow(_stream, _RECORDS))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages to archives, read them back, and tell what each page's record is."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()

    def page(column: str):
        name = F.substring_index(F.substring(column, 10, 1 << 30), "#", 1)  # between "urn:page:" and the digest
        decoded = F.when(name == "+", "").when(name != "", F.url_decode(name))
        return decoded.cast(kind) if kind == "string" else decoded.try_cast(kind)

    return read_records(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
