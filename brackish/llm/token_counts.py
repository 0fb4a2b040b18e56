"""Token counts by a map-side lookup in two tiers.

A byte-level BPE tokenizer splits a text into pre-tokens and encodes each by itself, so a text's
count is the sum of its pre-tokens' lengths.

* Tier 1: a compact table of the most frequent pre-tokens with their lengths, broadcast to all
  workers. It has at most `TABLE` entries of at most `LONGEST` bytes. It is found in one pass over
  all texts: each task keeps a bounded summary of what stands between blanks (counters that are
  halved and thinned when full) and splits only what is left in it into pre-tokens; the summaries,
  not the pre-tokens, are merged in two rounds.
* Tier 2: a pre-token that is not in the table is encoded with the tokenizers library, in batches,
  and its length stays in the worker's own cache, which starts anew when it is full and takes no
  pre-token of more than `CACHED` characters.

Which pre-tokens are in the table changes the speed only, never a count. No pre-token is shuffled.

The pre-token pattern is run here with Python's regex module. Its character classes and the
library's may follow different Unicode versions. A text with characters outside of long-settled
scripts, or with the tokenizer's own added tokens, is cut where every version has a boundary: before
a blank that follows a settled character other than a space. A piece with such a character goes to
the second tier as it is, the other pieces are split into pre-tokens.

Defined results: NULL is empty, with 0 tokens. Rows that repeat a doc_id are documents of their
own. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from brackish.llm.text import documents, rows

#: Entries of the broadcast table, bytes of its longest entry, and counters of a task's summary.
TABLE = 65_536
LONGEST = 64
COUNTERS = 16_384
#: Pre-tokens in a worker's cache, and characters of its longest one.
CACHE = 400_000
CACHED = 128
#: Tokens up to which a document is not over the limit.
LIMIT = 512

#: The byte-level pre-token pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin, Greek, Cyrillic, general punctuation, currency and letter-like signs without the code
#: points that were still free when Unicode 6 came out.
_SETTLED = r"\x00-\x1b\x20-\x84\x86-ɏɐ-˿Α-ΡΣ-ϿЀ-ҁҊ-ԣ‐-‧‰-⁞₠-₸"
_UNSETTLED = regex.compile(f"[^{_SETTLED}]")
#: A pre-token ends at a blank after a settled character other than a space, whatever else stands there.
_BOUNDARY = regex.compile(rf"(?<=[{_SETTLED}--\s])(?= )", regex.V1)


class Lengths:
    """The two tiers in a worker."""

    def __init__(self, path: str, table: dict[str, int], cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        #: an added token with a blank could be cut, so texts with one stay whole
        self.whole = any(" " in t for t in added)
        self.split = regex.compile(PATTERN).findall
        self.table = table
        self.cache: dict[str, int] = {}
        self.most = cache

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        return _UNSETTLED.search(text) is None and (self.added is None or self.added.search(text) is None)

    def pieces(self, text: str) -> list[str]:
        """The text in pieces that are encoded independently of each other: pre-tokens where those are certain."""
        if self.plain(text):
            return self.split(text)
        if self.whole and self.added.search(text):
            return [text]
        out: list[str] = []
        for piece in _BOUNDARY.split(text):
            if self.plain(piece):
                out += self.split(piece)
            else:
                out.append(piece)
        return out

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces(x) for x in texts]
        missed = {t for tokens in split for t in tokens if t not in self.table and t not in self.cache}
        if len(self.cache) + len(missed) > self.most:
            self.cache = {}
            missed = {t for tokens in split for t in tokens if t not in self.table}
        new = list(missed)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.cache.update(zip(part, self.encode(part)))
        table, cache = self.table.get, self.cache
        counts = [sum([n if (n := table(t)) is not None else cache[t] for t in tokens]) for tokens in split]
        for token in new:
            if len(token) > CACHED:
                del cache[token]
        return counts


def _thin(counts: Counter, size: int) -> Counter:
    """The larger half of `size` counters."""
    return Counter(dict(counts.most_common(size // 2)))


def _summarise(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """One bounded summary of a task's frequent pre-tokens."""
    from pyspark import TaskContext

    units: Counter = Counter()
    for batch in rows(batches):
        for text in batch.column("text").to_pylist():
            if text:
                units.update([u for u in text.split(b" ") if len(u) < LONGEST])
            if len(units) > 8 * size:
                units = _thin(units, 2 * size)
    if units:
        split = regex.compile(PATTERN).findall
        counts: Counter = Counter()
        for unit, n in units.most_common(size):
            for token in split(" " + unit.decode("utf-8", "replace")):
                counts[token] += n
        top = [(t, n) for t, n in counts.most_common(size) if len(t.encode()) <= LONGEST]
        yield _packed(TaskContext.get().partitionId() % buckets, top)


def _packed(bucket: int, top: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([[t for t, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))],
        ["bucket", "tokens", "counts"],
    )


def _merge(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One summary of the summaries in a partition."""
    counts: Counter = Counter()
    for batch in rows(batches, 1):
        for tokens, each in zip(batch.column("tokens").to_pylist(), batch.column("counts").to_pylist()):
            for token, n in zip(tokens, each):
                counts[token] += n
        if len(counts) > 8 * size:
            counts = _thin(counts, 2 * size)
    if counts:
        yield _packed(0, counts.most_common(size))


_SUMMARY = "bucket int, tokens array<string>, counts array<long>"


def frequent_pretokens(texts: DataFrame, size: int = TABLE, counters: int = COUNTERS, buckets: int = 64) -> list[str]:
    """Frequent pre-tokens of all texts, at most `size`: summaries merged in two rounds."""
    summaries = texts.mapInArrow(partial(_summarise, size=counters, buckets=buckets), _SUMMARY)
    merged = summaries.repartition(buckets, "bucket").mapInArrow(partial(_merge, size=size), _SUMMARY)
    best = merged.repartition(1).mapInArrow(partial(_merge, size=size), _SUMMARY).first()
    return list(best.tokens) if best else []


def pack_table(lengths: dict[str, int]) -> bytes:
    """Two arrays and one string: entry sizes, token counts, entries."""
    keys = [k.encode() for k in lengths]
    n = len(keys)
    return struct.pack(f"<I{n}B{n}B", n, *map(len, keys), *[min(v, 255) for v in lengths.values()]) + b"".join(keys)


@lru_cache(maxsize=1)
def unpack_table(packed: bytes) -> dict[str, int]:
    n = struct.unpack_from("<I", packed)[0]
    sizes, lengths = packed[4 : 4 + n], packed[4 + n : 4 + 2 * n]
    table, at = {}, 4 + 2 * n
    for size, length in zip(sizes, lengths):
        table[packed[at : at + size].decode()] = length
        at += size
    return table


def _count(batches: Iterator[pa.RecordBatch], path: str, table: Broadcast, limit: int) -> Iterator[pa.RecordBatch]:
    lengths = Lengths(path, unpack_table(table.value))
    for batch in rows(batches, 64):
        texts = batch.column("text").to_pylist()
        counts = lengths.count([x.decode("utf-8", "replace") for x in texts])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def count_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, table: int = TABLE
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. `path`: the tokenizer's .json file."""
    texts = documents(docs, key, text)
    tokens = frequent_pretokens(texts.select("text"), table)
    plain = Lengths(path, {})
    known = [t for t in tokens if plain.plain(t)]
    counted = dict(zip(known, plain.encode(known))) if known else {}
    packed = docs.sparkSession.sparkContext.broadcast(pack_table(counted))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return texts.mapInArrow(partial(_count, path=path, table=packed, limit=limit), schema)
