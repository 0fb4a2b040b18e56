"""Line dedup: lines that occur in many documents are dropped from all of them.

Lines are exploded with the 128-bit digest of their normalised form, documents are counted per
digest, and only the places of frequent lines travel back to their documents, where the other
lines are put together again by position. The count combines map-side, a line counts once per
document before it leaves the task, and the join of frequent digests with the places splits hot
digests at run time (adaptive execution). Texts move once, to meet their dropped places.

Defined results: a NULL text is one empty line. Lines whose key is shorter than `least_points` are
never dropped. Rows that repeat a doc_id are documents of their own. Columns other than the key
and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.llm.text import BLANKS, documents, rows
from brackish.operators.keys import join_on
from brackish.session import settle

#: A line is dropped if so many documents have it, and its key so many code points.
DOCUMENTS = 10
POINTS = 1


def _digests(text: bytes, least: int) -> dict[bytes, list[int]]:
    """The places of each line key's digest."""
    places: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(BLANKS).lower()  # bytes.lower() changes A-Z only
        if len(key) >= least and (least < 2 or len(key.decode("utf-8", "replace")) >= least):
            places.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(at)
    return places


def _explode(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        keys, texts, digests, places = [], [], [], []
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = _digests(text, least)
            keys += [key] * len(found)
            texts += [hashlib.blake2b(text, digest_size=16).digest()] * len(found)
            digests += found.keys()
            places += found.values()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, batch.schema.field("doc_id").type),
                pa.array(texts, pa.binary()),
                pa.array(digests, pa.binary()),
                pa.array(places, pa.list_(pa.int32())),
            ],
            ["doc_id", "whole", "line", "places"],
        )


def _reassemble(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        counts, dropped, digests, kept = [], [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist()):
            lines = text.split(b"\n")
            gone = set(places or ())
            rest = text if not gone else b"\n".join([x for at, x in enumerate(lines) if at not in gone])
            counts.append(len(lines))
            dropped.append(len(gone))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(arrays, names)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        whole = [hashlib.blake2b(x, digest_size=16).digest() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.binary())], ["doc_id", "text", "whole"])


def drop_common_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_documents: int = DOCUMENTS,
    least_points: int = POINTS,
    with_text: bool = True,
) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept_text."""
    texts = documents(docs, key, text)
    kind = texts.schema["doc_id"].dataType.simpleString()
    lines = texts.mapInArrow(
        lambda b: _explode(b, least_points), f"doc_id {kind}, whole binary, line binary, places array<int>"
    )
    lines = settle(lines, "lines")
    common = lines.groupBy("line").count().where(F.col("count") >= least_documents).select("line")
    hits = lines.join(settle(common, "common"), "line", "left_semi")
    # equal texts under one doc_id have the same places, so a set is enough
    dropped = hits.groupBy("doc_id", "whole").agg(F.flatten(F.collect_set("places")).alias("dropped"))
    marked = texts.mapInArrow(_with_digest, f"doc_id {kind}, text binary, whole binary")
    joined = join_on(marked, settle(dropped, "dropped"), ["doc_id", "whole"], "left")
    schema = f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("doc_id", "text", "dropped").mapInArrow(lambda b: _reassemble(b, with_text), schema)
