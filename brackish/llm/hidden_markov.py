"""Language-model scores from a hidden Markov model over the whole corpus.

A text is its words and one end. Latent states emit symbols: each frequent word is one (a word with
at least one in SYMBOLS of the training tokens, so there are at most SYMBOLS), every other word
belongs to one of CLASSES by its last letters, and within its class has the exact smoothed share
(count + 0.5) / (tokens + 0.5 * (words + 1)) of the training counts. So each word that was ever
counted takes part, and unseen words share the last half count: the probabilities of all texts sum
to one.

Counting, encoding, training and scoring are passes over partitions:

1. training words are counted per task and summed by word; the whole count table is kept;
2. each text becomes an array of symbols, with the words that LOOKUP most frequent ones do not
   cover listed beside it; this table is written once;
3. Baum-Welch: each task runs the scaled forward-backward recursion over its training texts and
   returns expected counts, which are summed by symbol, in fixed point so that the order of the sum
   does not matter; the model (STATES * (SYMBOLS + CLASSES) numbers) goes back to the tasks;
4. the scaled forward recursion gives each text's exact likelihood; the listed words meet their
   counts in a join by word and are summed per text.

Only the LOOKUP words (at most that many, each a share of 1 / LOOKUP of the tokens and at most
LONGEST bytes) and the model are sent to the tasks, whatever the input. Recursions run step by step
over many texts at once; a text longer than BATCH tokens keeps one vector per block of steps.

Defined results: a NULL text is empty and has the end alone. NULL doc_id hashes as the empty string.
Rows that repeat a doc_id are documents of their own. Without training texts every base score is 0.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.llm.text import rows, utf8
from brackish.session import settle

STATES = 8
ITERATIONS = 5
SYMBOLS = 1 << 14
CLASSES = 256
LOOKUP = 1 << 18
LONGEST = 64
#: Tokens that are worked on at once, and words a task counts before it hands them on.
BATCH = 1 << 20
COUNTED = 1 << 19

_FIXED = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; the end is not among them."""
    return text.translate(_LOWER).split()


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _suffix_class() -> Column:
    """`suffix_class` of the binary column `word`."""
    tail = F.expr("substring(word, greatest(length(word) - 2, 1), 3)")
    return (F.crc32(tail) % CLASSES).cast("int")


class Chain:
    """Latent states: first (K), move (K x K) and emit (symbols x K)."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.first, self.move, self.emit = first, move, emit

    @classmethod
    def start(cls, share: np.ndarray, states: int = STATES) -> Chain:
        """States that hold on to themselves and emit the symbols' shares with fixed noise."""
        emit = share[:, None] * np.random.default_rng(7).gamma(1.0, size=(len(share), states))
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def updated(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Chain:
        """The chain of expected counts; one count is spread over each distribution."""
        states = len(first)
        first, move, emit = first + 1 / states, move + 1 / states, emit + share[:, None]
        return Chain(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def _forward(self, line: Line, begin: int, end: int, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Scaled vectors, scales and emissions of the steps begin..end."""
        low = line.at[begin]
        emitted = self.emit[line.symbols[low : line.at[end]]]
        vectors = np.empty_like(emitted)
        scale, ones = np.empty(len(emitted), emitted.dtype), np.ones(len(self.first), emitted.dtype)
        for step in range(begin, end):
            here = slice(line.at[step] - low, line.at[step + 1] - low)
            now = vectors[here]
            if before is None:
                np.multiply(emitted[here], self.first, out=now)
            else:
                np.matmul(before[: len(now)], self.move, out=now)
                now *= emitted[here]
            np.matmul(now, ones, out=scale[here])
            now /= scale[here, None]
            before = now
        return vectors, scale, emitted

    def log10(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Log10 likelihood of each text; texts are not empty."""
        line, before = Line(texts), None
        total = np.zeros(len(texts))
        for begin, end in line.blocks():
            vectors, scale, _ = self._forward(line, begin, end, before)
            before = vectors[line.at[end - 1] - line.at[begin] :]
            total += np.bincount(line.owners(begin, end), np.log10(scale), minlength=len(texts))
        out = np.empty(len(texts))
        out[line.order] = total
        return out

    def expect(self, texts: Sequence[np.ndarray], counts: Counts) -> None:
        """Add the expected counts of the texts (Baum-Welch) to `counts`."""
        line = Line(texts)
        blocks = line.blocks()
        entries: list[np.ndarray | None] = [None]
        for begin, end in blocks[:-1]:
            vectors, _, _ = self._forward(line, begin, end, entries[-1])
            entries.append(vectors[line.at[end - 1] - line.at[begin] :].copy())
        message = None  # per text of the next step: emission * backward vector / scale
        for (begin, end), before in zip(reversed(blocks), reversed(entries)):
            vectors, scale, emitted = self._forward(line, begin, end, before)
            emitted /= scale[:, None]
            low = line.at[begin]
            back = np.ones_like(vectors)
            if message is not None:
                last = vectors[line.at[end - 1] - low :][: len(message)]
                counts.move += self.move * (last.T @ message)
            for step in range(end - 1, begin - 1, -1):
                here = slice(line.at[step] - low, line.at[step + 1] - low)
                if message is not None:
                    np.matmul(message, self.move.T, out=back[here][: len(message)])
                message = emitted[here]
                message *= back[here]
            size = line.at[begin + 1] - low
            if len(vectors) > size:
                earlier = np.arange(size, len(vectors)) - np.repeat(line.sizes[begin : end - 1], line.sizes[begin + 1 : end])
                counts.move += self.move * (vectors[earlier].T @ emitted[size:])
            vectors *= back
            if begin == 0:
                counts.first += vectors[:size].sum(0)
            symbols = line.symbols[low : line.at[end]]
            for k in range(len(self.first)):
                counts.emit[:, k] += np.bincount(symbols, vectors[:, k], minlength=len(counts.emit))


class Counts:
    def __init__(self, symbols: int, states: int):
        self.first, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))


class Line:
    """Texts laid out step by step, the longest first: step t holds the texts with more than t tokens."""

    def __init__(self, texts: Sequence[np.ndarray]):
        length = np.array([len(t) for t in texts])
        self.order = np.argsort(-length, kind="stable")
        length = length[self.order]
        step = np.concatenate([np.arange(n) for n in length])
        self.symbols = np.concatenate([texts[k] for k in self.order])[np.argsort(step, kind="stable")]
        self.sizes = np.bincount(step)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))

    def blocks(self) -> list[tuple[int, int]]:
        """Ranges of steps with about BATCH tokens at most, one step at least."""
        edges, steps = [0], len(self.sizes)
        while edges[-1] < steps:
            stop = int(np.searchsorted(self.at, self.at[edges[-1]] + BATCH, "right")) - 1
            edges.append(min(max(stop, edges[-1] + 1), steps))
        return list(zip(edges, edges[1:]))

    def owners(self, begin: int, end: int) -> np.ndarray:
        """Place of each token's text."""
        return np.arange(self.at[begin], self.at[end]) - np.repeat(self.at[begin:end], self.sizes[begin:end])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def take() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
        )
        found.clear()
        return out

    for batch in rows(batches):
        for text in batch.column("text").to_pylist():
            found.update(tokens(text))
            if len(found) > COUNTED:
                yield take()
        found[b""] += batch.num_rows  # the end
    yield take()


class Vocabulary:
    """Counts of the LOOKUP words, and the symbols of frequent words, classes and the end."""

    def __init__(self, known: Mapping[bytes, int], total: int, distinct: int, classes: np.ndarray):
        self.total, self.distinct = total, distinct
        by_count = sorted((w for w in known if w), key=lambda w: (-known[w], w))
        self.symbol = {w: k for k, w in enumerate(w for w in by_count if known[w] * SYMBOLS >= total)}
        self.end = len(self.symbol) + CLASSES
        self.size = self.end + 1
        self.index = {w: k for k, w in enumerate(by_count)}
        self.symbol_of = np.array([self.symbol.get(w, len(self.symbol) + suffix_class(w)) for w in by_count] or [0], np.uint16)
        self.logs = np.log10(np.array([known[w] for w in by_count] or [0]) + 0.5)
        self.end_count = known.get(b"", 0)
        self.classes: dict[bytes, int] = {}  # symbol of each ending of three bytes at most
        # tokens and words of each class, without the frequent words in it
        tokens_, words_ = classes[:, 0].astype(float), classes[:, 1].astype(float)
        for w in self.symbol:
            tokens_[suffix_class(w)] -= known[w]
            words_[suffix_class(w)] -= 1
        self.within = tokens_ + 0.5 * (words_ + 1)
        share = np.concatenate(([known[w] for w in self.symbol], tokens_, [self.end_count])) + 0.5
        self.share = share / share.sum()

    def encode(self, text: bytes) -> tuple[np.ndarray, int, float, float, Counter[bytes]]:
        """Symbols, known words, sums of log10(count + 0.5) over looked-up words (all, those without
        a symbol of their own), and the other words."""
        words = tokens(text)
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        symbols = np.empty(len(words) + 1, np.uint16)
        symbols[:-1] = self.symbol_of[found]
        symbols[-1] = self.end
        missing = np.flatnonzero(found < 0)
        others = [words[at] for at in missing.tolist()]
        tails = [w[-3:] for w in others]
        for tail in {t for t in tails if t not in self.classes}:
            self.classes[tail] = len(self.symbol) + suffix_class(tail)
        symbols[missing] = [self.classes[t] for t in tails]
        there = found[found >= 0]
        logs = self.logs[there]
        return symbols, len(there), float(logs.sum()), float(logs[there >= len(self.symbol)].sum()), Counter(others)


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in rows(batches):
        symbols, n, known, logs, rare = [], [], [], [], []
        found_words, times, ends = [], [], [0]
        for text in batch.column("text").to_pylist():
            own, found, total, part, others = vocabulary.encode(text)
            symbols.append(own.tobytes())
            n.append(len(own))
            known.append(found + (vocabulary.end_count > 0))
            logs.append(total + float(np.log10(vocabulary.end_count + 0.5)))
            rare.append(part)
            found_words += others
            times += others.values()
            ends.append(len(found_words))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + len(n)), pa.int64()),
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(symbols, pa.binary()),
                pa.array(n, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(logs, pa.float64()),
                pa.array(rare, pa.float64()),
                pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(found_words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"]),
                ),
            ],
            ["row", "doc_id", "held_out", "symbols", "n_tokens", "known", "logs", "rare", "rest"],
        )
        row += len(n)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Encoded texts, about BATCH tokens at a time."""
    held: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in rows(batches, 32):
        own = [np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()]
        held.append(batch)
        texts += own
        size += sum(map(len, own))
        if size > BATCH:
            yield held, texts
            held, texts, size = [], [], 0
    if texts:
        yield held, texts


def _expect(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    """Expected counts of the task's texts: a row per symbol; -1: first; -2 - i: moves from i."""
    states = len(chain.first)
    counts = Counts(len(chain.emit), states)
    for _, texts in _texts(batches):
        chain.expect(texts, counts)
    seen = np.flatnonzero(counts.emit.any(1))
    names = np.concatenate(([-1], -2 - np.arange(states), seen))
    table = np.concatenate((counts.first[None], counts.move, counts.emit[seen]))
    fixed = np.rint(table * _FIXED).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()), *[pa.array(fixed[:, k]) for k in range(states)]], ["name", *[f"s{k}" for k in range(states)]]
    )


def _score(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for held, texts in _texts(batches):
        score, at = chain.log10(texts), 0
        for batch in held:
            own = pa.array(score[at : at + batch.num_rows])
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in _SCORED] + [own], [*_SCORED, "score"])


_SCORED = ("row", "doc_id", "held_out", "n_tokens", "known", "logs", "rare")


def train(encoded: DataFrame, vocabulary: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> Chain:
    """Baum-Welch over all rows of `encoded` (a column `symbols`)."""
    chain = Chain.start(vocabulary.share, states)
    names = [f"s{k}" for k in range(states)]
    schema = ", ".join(["name int", *[f"{s} long" for s in names]])
    for _ in range(iterations):
        small = Chain(*(x.astype(np.float32) for x in (chain.first, chain.move, chain.emit)))
        found = encoded.select("symbols").mapInArrow(partial(_expect, chain=small), schema)
        sums = found.groupBy("name").agg(*[F.sum(s).alias(s) for s in names]).toPandas()  # at most a row per symbol
        counts = Counts(vocabulary.size, states)
        for name, row in zip(sums["name"].tolist(), sums[names].to_numpy(float) / _FIXED):
            if name >= 0:
                counts.emit[name] = row
            elif name == -1:
                counts.first = row
            else:
                counts.move[-2 - name] = row
        chain = chain.updated(counts.first, counts.move, counts.emit, vocabulary.share)
    return chain


def score_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, iterations: int = ITERATIONS
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10 of the
    smoothed word shares), score (log10 of the model's probability).

    Documents whose crc32(doc_id) leaves 1 modulo 5 are held out, the others train the model.
    """
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    plain = docs.select(
        F.col(f"`{key}`").alias("doc_id"), utf8(text).alias("text"), (F.crc32(name.cast("binary")) % 5 == 1).alias("held_out")
    )
    found = plain.where("NOT held_out").select("text").mapInArrow(_count, "word binary, n long")
    counts = settle(found.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "word-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = total or 0, distinct or 0
    by_class = np.zeros((CLASSES, 2), np.int64)
    for kind, n, words in counts.where("word != X''").groupBy(_suffix_class()).agg(F.sum("n"), F.count("*")).collect():
        by_class[kind] = n, words
    often = (F.col("n") * LOOKUP >= total) & (F.length("word") <= LONGEST)
    frequent = counts.where(often | (F.length("word") == 0)).toPandas()  # at most LOOKUP words and the end
    vocabulary = Vocabulary(dict(zip(map(bytes, frequent["word"]), frequent["n"].tolist())), total, distinct, by_class)

    id_type = plain.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {id_type}, held_out boolean, symbols binary, n_tokens long, known long, logs double, rare double, "
        "rest array<struct<word: binary, n: long>>"
    )
    encoded = settle(plain.mapInArrow(partial(_encode, vocabulary=vocabulary), schema), "encoded")
    chain = train(encoded.where("NOT held_out"), vocabulary, states, iterations)

    listed = encoded.select("row", F.inline("rest"))
    met = listed.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    others = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known")
    )
    emit = chain.emit.copy()
    emit[len(vocabulary.symbol) : vocabulary.end] /= vocabulary.within[:, None]
    scored = encoded.select(*_SCORED, "symbols").mapInArrow(
        partial(_score, chain=Chain(chain.first, chain.move, emit)),
        f"row long, doc_id {id_type}, held_out boolean, n_tokens long, known long, logs double, rare double, score double",
    )
    more, smoothed = F.coalesce("more", F.lit(0.0)), float(np.log10(total + 0.5 * (distinct + 1)))
    return scored.join(settle(others, "listed"), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * smoothed).alias("base_score"),
        (F.col("score") + F.col("rare") + more).alias("score"),
    )
