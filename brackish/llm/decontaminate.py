"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items form one automaton. The words of a document are streamed through it; at
each word it gives the length of the longest item passage that ends there. Where that length
reaches the window, the window's words are hit; items shorter than the window count only whole.
Only stretches of words that all occur in some item are streamed, the others cannot match.

The automaton holds the items, not the corpus, and is built for blocks of at most `BLOCK_WORDS`
item words, so what is broadcast is bounded. One block (the usual case) is a map over documents
without a shuffle; further blocks are further passes whose spans are joined by document.

Defined results: NULL, empty and wordless texts have no words and are never contaminated; items
without words never occur. Items that repeat an item_id count once; a NULL item_id is written
"null". Rows that repeat a doc_id are documents of their own. Other columns are ignored by
`find_contamination` and carried along by `drop_contaminated`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.llm.text import documents, rows, utf8, words
from brackish.operators.keys import join_on
from brackish.session import settle

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
COVERAGE = 20
#: Item words of one automaton.
BLOCK_WORDS = 200_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """All passages of all items, over words; `match` streams a text's words through it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text] for _, text in items]
        self.width = max(1, len(self.vocabulary))
        self.go: dict[int, int] = {}  # state * width + word -> state
        self.out: list[list[int]] | None = [[]]  # words that leave a state, while building
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
        self.out = None
        self.shortest = min([window, *(len(t) for t in texts if t)])
        self._accept(texts)

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.length) - 1

    def _set(self, state: int, word: int, to: int) -> None:
        key = state * self.width + word
        if key not in self.go:
            self.out[state].append(word)
        self.go[key] = to

    def _split(self, state: int, word: int, old: int) -> int:
        """The state for the passages of `old` that are one word longer than `state`'s longest."""
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._state(self.length[state] + 1, self.link[old])
        for w in self.out[old]:
            self._set(new, w, self.go[old * self.width + w])
        self.link[old] = new
        while state >= 0 and self.go.get(state * self.width + word) == old:
            self.go[state * self.width + word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int) -> int:
        known = self.go.get(last * self.width + word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0)
        state = last
        while state >= 0 and state * self.width + word not in self.go:
            self._set(state, word, new)
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.go[state * self.width + word])
        return new

    def _accept(self, texts: list[list[int]]) -> None:
        """Which items a state's window, or its short passages, belong to."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.top = list(range(len(self.length)))
        for v in order:
            if self.length[self.link[v]] >= self.window:
                self.top[v] = self.top[self.link[v]]
        windows: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for item, text in enumerate(texts):
            state = 0
            for at, word in enumerate(text):
                state = self.go[state * self.width + word]
                if at + 1 >= self.window:
                    windows.setdefault(self.top[state], set()).add(item)
            if 0 < len(text) < self.window:
                short.setdefault(state, {}).setdefault(len(text), set()).add(item)
        self.windows = {v: frozenset(x) for v, x in windows.items()}
        self.short: dict[int, tuple[tuple[int, frozenset[int]], ...]] = {}
        for v in order:
            own = tuple((n, frozenset(x)) for n, x in short.get(v, {}).items())
            if found := own + self.short.get(self.link[v], ()):
                self.short[v] = found

    def ids(self, text: list[bytes]) -> Iterator[int]:
        return map(self.vocabulary.get, text, repeat(-1))

    def match(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit windows as (first, end), items they belong to, longest match in words."""
        state = length = longest = 0
        spans, items = [], set()
        go, width, link, window = self.go, self.width, self.link, self.window
        for at, word in enumerate(ids):
            to = go.get(state * width + word)
            while to is None and state:
                state = link[state]
                length = self.length[state]
                to = go.get(state * width + word)
            if to is None:
                length = 0
                continue
            state, length = to, length + 1
            longest = max(longest, length)
            if length >= window:
                spans.append((at + 1 - window, at + 1))
                items |= self.windows[self.top[state]]
            for n, found in self.short.get(state, ()):
                if n <= length:
                    spans.append((at + 1 - n, at + 1))
                    items |= found
        return spans, items, longest


def _runs(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least `least` known words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


_FOUND = "n_words long, spans array<struct<first:int, end:int>>, items array<string>, longest long"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _find(batches: Iterator[pa.RecordBatch], automaton: Broadcast, only_hits: bool) -> Iterator[pa.RecordBatch]:
    sa: SuffixAutomaton = automaton.value
    for batch in rows(batches):
        split = [words(x) for x in batch.column("text").to_pylist()]
        flat: list[int] = []
        starts = []
        for text in split:
            starts.append(len(flat))
            flat += sa.ids(text)
            flat.append(-1)
        found: dict[int, tuple[list, set, int]] = {}
        begins = np.array(starts, dtype=np.int64)
        for a, b in _runs(np.array(flat, dtype=np.int64), sa.shortest):
            spans, items, longest = sa.match(flat[a:b])
            if spans:
                doc = int(np.searchsorted(begins, a, "right")) - 1
                old = found.setdefault(doc, ([], set(), 0))
                shift = a - starts[doc]
                old[0].extend((x + shift, y + shift) for x, y in spans)
                found[doc] = (old[0], old[1] | items, max(old[2], longest))
        at = sorted(found) if only_hits else range(len(split))
        none: tuple[list, set, int] = ([], set(), 0)
        hits = [found.get(i, none) for i in at]
        arrays = [
            pa.array([len(split[i]) for i in at], pa.int64()),
            pa.array([[{"first": a, "end": b} for a, b in merge(s)] for s, _, _ in hits], _SPANS),
            pa.array([sorted({sa.names[i] for i in x}) for _, x, _ in hits], pa.list_(pa.string())),
            pa.array([n for _, _, n in hits], pa.int64()),
        ]
        names = ["n_words", "spans", "items", "longest"]
        rest = batch.take(pa.array(list(at), pa.int64()))
        if only_hits:
            whole = [hashlib.blake2b(x, digest_size=16).digest() for x in rest.column("text").to_pylist()]
            arrays, names = [pa.array(whole, pa.binary()), *arrays], ["whole", *names]
            rest = rest.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *arrays], [*rest.schema.names, *names])


def _judge(batches: Iterator[pa.RecordBatch], coverage: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        n_words = batch.column("n_words").to_pylist()
        spans = [merge([(x["first"], x["end"]) for x in s or ()]) for s in batch.column("spans").to_pylist()]
        items = [sorted(set(x or ())) for x in batch.column("items").to_pylist()]
        hit = [sum(b - a for a, b in s) for s in spans]
        arrays = [
            batch.column("doc_id"),
            pa.array(n_words, pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            pa.array([h > 0 and coverage * h >= n for h, n in zip(hit, n_words)], pa.bool_()),
            batch.column("longest").fill_null(0),
        ]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"]
        if with_text:
            cleaned = [cut_spans(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans)]
            arrays.append(pa.array(cleaned, pa.binary()).cast(pa.string()))
            names.append("clean_text")
        yield pa.RecordBatch.from_arrays(arrays, names)


def _find_and_judge(batches: Iterator[pa.RecordBatch], automaton: Broadcast, coverage: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Both steps in one worker: chained as two of Spark's, every task would hold two workers."""
    return _judge(_find(batches, automaton, only_hits=False), coverage, with_text)


def _automata(items: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[Broadcast]:
    """One broadcast automaton per block of items."""
    context = items.sparkSession.sparkContext
    bare = items.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), utf8(text).alias("text"))
    # no word is shorter than a byte and its blank
    size = bare.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))
    for block in range(blocks):
        own = bare.where(F.expr(f"pmod(xxhash64(item, text), {blocks}) = {block}")) if blocks > 1 else bare
        yield context.broadcast(SuffixAutomaton([(r.item, words(bytes(r.text))) for r in own.toLocalIterator()], window))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage: int = COVERAGE,
    with_text: bool = True,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match.

    With `with_text` also clean_text, the text without its hit spans.
    """
    texts = documents(docs, key, text)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"
    schema += ", clean_text string" * with_text
    automata = list(_automata(items, item, item_text, window, block_words))
    if len(automata) == 1:
        return texts.mapInArrow(partial(_find_and_judge, automaton=automata[0], coverage=coverage, with_text=with_text), schema)
    hits = reduce(
        DataFrame.unionAll,
        [
            texts.mapInArrow(partial(_find, automaton=a, only_hits=True), f"doc_id {kind}, whole binary, {_FOUND}")
            for a in automata
        ],
    )
    hits = hits.groupBy("doc_id", "whole").agg(
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.flatten(F.collect_set("items")).alias("items"),
        F.max("longest").alias("longest"),
    )
    marked = texts.mapInArrow(_count, f"doc_id {kind}, text binary, whole binary, n_words long")
    found = join_on(marked, settle(hits, "hits"), ["doc_id", "whole"], "left")
    if not with_text:
        found = found.drop("text")
    return found.mapInArrow(partial(_judge, coverage=coverage, with_text=with_text), schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        texts = batch.column("text").to_pylist()
        whole = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary())
        count = pa.array([len(words(x)) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, whole, count], ["doc_id", "text", "whole", "n_words"])


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    judged = find_contamination(carried, items, "row", "text", with_text=False, **options)
    return judged.where("NOT contaminated").select("doc_id.*")
