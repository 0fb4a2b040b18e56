"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

1. Every labeller votes good, bad or nothing on every text, or finds it too short to judge. The votes of a text form a pattern;
   patterns are counted over the whole table (at most 4 to the number of labellers of them, so the
   counts are small whatever the table's size).
2. Expectation-maximisation on the counts estimates each labeller's rates of every vote on good
   and on bad texts, and with them the probability that a text of each pattern is good.
3. These posteriors are the targets of a logistic scorer over hashed token features. It is fitted
   on at most about `SAMPLE` distinct texts, chosen by the hash of the text, in one task; copies are
   one text with a weight, so they do not count against the bound. The bound is a parameter,
   everything else covers all rows.
4. Every text is scored: `good` if the score is at least one half.

Defined results: a text without tokens (NULL, empty, blanks) has score 0. Equal texts have equal
scores. Rows that repeat a doc_id are documents of their own. Other columns are ignored by
`score_quality` and carried along by `keep_good`. Languages that the labellers do not know are not
held against a text: without enough known function words, or in scripts without blanks between
words, the labellers concerned do not judge it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.llm.text import documents, rows, words

#: A vote; the last one says that a labeller cannot judge the text (too short, or of a language or
#: script it does not know), which tells nothing about it.
GOOD, BAD, NONE, SHORT = "g", "b", "-", "."
#: Texts that the scorer is fitted on, and its number of weights.
SAMPLE = 20_000
WEIGHTS = 1 << 16

#: Frequent function words of English, German, French and Spanish (fixed values).
FUNCTION_WORDS = frozenset(
    """the of and to in is that it for was with as be on by at this are from or an have not which
    der die das und in zu den von mit ist des sich auf für im dem nicht ein eine als auch
    le la les de des et un une en du que qui dans pour par sur au avec est pas
    el los las y del se con una su para es al lo como más o""".encode().split()
)
#: ASCII characters that prose seldom has: not letters, digits, blanks or common punctuation.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-!?")
_MARK_RUN = re.compile(b"[" + re.escape(_MARKS) + b"]+")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Bytes within a UTF-8 character, first bytes of any character above 127, and above U+07FF.
_WITHIN, _FIRST, _WIDE = bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)), bytes(range(0xE0, 0x100))
#: Sentence ends above 127: Armenian, Arabic, Syriac, Devanagari, Myanmar, Ethiopic, Khmer,
#: Mongolian, marks in pairs and dots, CJK, full and half width.
_ENDS = [x.encode() for x in "։؟۔܀܁܂।॥၊။።፧៕៖᠃‼⁇⁈⁉…。！．？｡"]
#: Scripts without blanks between words: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Kana and Han.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uaa60-\uaadf\uf900-\ufaff\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_VOTERS = 9


def _both(value: float, good: float, bad: float) -> str:
    """Good up to one bound, bad from the other."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def _only_bad(value: float, bad: float) -> str:
    """Bad from a bound; below it nothing is said."""
    return BAD if value >= bad else NONE


def _unspaced(text: bytes) -> bool:
    """Whether a tenth of the characters or more are of scripts without blanks between words."""
    wide = len(text) - len(text.translate(None, _WIDE))
    length = len(text.translate(None, _WITHIN))
    return 10 * wide >= length and 10 * len(_UNSPACED.findall(text.decode(errors="replace"))) >= length


def votes(text: bytes) -> str:
    """One letter per labeller: share of marks, runs of marks per word, capitals, immediate
    repeats, repeated triples, repeated lines, function words, word length, sentence length."""
    found = words(text)
    n = len(found)
    if n < 5:
        return SHORT * _VOTERS
    upper, lower, other = (len(text) - len(text.translate(None, x)) for x in (_UPPER, _LOWER, _FIRST))
    marks = len(text) - len(text.translate(None, _MARKS))
    runs = sum(1 for _ in _MARK_RUN.finditer(text)) if marks else 0
    same = sum(map(bytes.__eq__, found, found[1:]))
    triples = len(set(zip(found, found[1:], found[2:])))
    own = sum(map(FUNCTION_WORDS.__contains__, found)) / n
    size = len(b"".join(found).translate(None, _WITHIN)) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = text.count(b".") + text.count(b"!") + text.count(b"?")
    if other:
        ends += sum(map(text.count, _ENDS))
    parted = n >= 30 and not (other and _unspaced(text))
    return "".join(
        [
            _both(marks / len(text), 0.01, 0.04),
            _only_bad(runs / n, 0.2),
            _only_bad(upper / max(1, upper + lower + other), 0.5),
            _only_bad(same / (n - 1), 0.2) if n >= 10 else SHORT,
            _only_bad(1 - triples / (n - 2), 0.4) if n >= 10 else SHORT,
            _only_bad(1 - len(set(lines)) / len(lines), 0.4) if len(lines) > 3 else SHORT,
            (GOOD if own >= 0.1 else NONE) if n >= 30 and own > 0.02 else SHORT,
            _both(abs(size - 6), 3, 7) if parted else SHORT,
            _both(n / max(1, ends), 40, 90) if parted else SHORT,
        ]
    )


def fit_labellers(counts: dict[str, int], tolerance: float = 1e-9, most: int = 5_000) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of every pattern and each labeller's rates, by expectation-maximisation.

    Rates have shape (labellers, 2, 3): the share of good, bad and missing votes on bad (0) and on
    good (1) texts, of those long enough for the labeller. It ends when no posterior moves any more.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.full((_VOTERS, 2, 3), 1 / 3)
    n = np.array([counts[p] for p in patterns], float)
    votes_ = np.array([[[v == k for k in (GOOD, BAD, NONE)] for v in p] for p in patterns], float)
    # start from labellers that seldom call a good text bad, but miss most of the bad ones
    start = np.array([[[0.3, 0.4, 0.3]], [[0.68, 0.02, 0.3]]])
    odds = (votes_ @ np.log(start[1, 0] / start[0, 0])).sum(1)
    posterior = 1 / (1 + np.exp(np.clip(-odds, -500, 500)))
    rates = np.zeros((votes_.shape[1], 2, 3))
    for _ in range(most):
        share = np.stack([n * (1 - posterior), n * posterior])
        rates = np.einsum("yp,pjv->jyv", share, votes_) + 0.5
        rates /= rates.sum(2, keepdims=True)
        prior = (share.sum(1) + 0.5) / (n.sum() + 1)
        like = np.log(prior)[:, None] + np.einsum("pjv,jyv->yp", votes_, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < tolerance:
            break
    else:
        raise ValueError("the label model has not settled")
    return dict(zip(patterns, posterior.tolist())), rates


_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1+")


class Features:
    """Hashed features of a text: tokens, token shapes and immediate repeats, with shares as values."""

    def __init__(self, weights: int = WEIGHTS, cache: int = 400_000):
        self.mask, self.most = weights - 1, cache
        self.cache: dict[bytes, int] = {}
        self.repeat = zlib.crc32(b"\0repeat") & self.mask

    def _token(self, token: bytes) -> int:
        """Places of the token and of its shape, in one number: a worker keeps many of them."""
        if len(self.cache) >= self.most:
            self.cache = {}
        shape = _RUN.sub(rb"\1", token.translate(_SHAPE))
        pair = self.cache[token] = (zlib.crc32(token) & self.mask) << 32 | zlib.crc32(b"\0shape " + shape) & self.mask
        return pair

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        get = self.cache.get
        counts = Counter(tokens)
        pairs = [v if (v := get(t)) is not None else self._token(t) for t in counts]
        share = np.fromiter(counts.values(), np.float64, len(counts)) / len(tokens)
        same = sum(map(bytes.__eq__, tokens, tokens[1:])) / len(tokens)
        both = np.array(pairs, np.uint64)
        own, shape = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # the root keeps a frequent token from drowning the others; shapes add up
        index, place = np.unique(shape, return_inverse=True)
        shapes = np.bincount(place, share)
        return (
            np.concatenate([own.astype(np.int64), index, [self.repeat]]).astype(np.int32),
            np.concatenate([np.sqrt(share) * 0.3, np.sqrt(shapes), [same]]).astype(np.float32),
        )


def fit_scorer(
    features: Sequence[tuple[np.ndarray, np.ndarray]],
    target: np.ndarray,
    weights: int = WEIGHTS,
    rounds: int = 150,
    counts: np.ndarray | None = None,
) -> np.ndarray:
    """Logistic weights, the last one the constant; full-batch steps, so the order does not count.

    `counts` says how many texts each row of features stands for, one by default.
    """
    out = np.zeros(weights + 1)
    if not len(target):
        return out
    index = np.concatenate([x for x, _ in features]).astype(np.int64)
    value = np.concatenate([v for _, v in features]).astype(np.float64)
    row = np.repeat(np.arange(len(features)), [len(x) for x, _ in features])
    share = np.full(len(target), 1 / len(target)) if counts is None else counts / counts.sum()
    first, second = np.zeros_like(out), np.zeros_like(out)
    for step in range(1, rounds + 1):
        score = np.bincount(row, out[index] * value, len(features)) + out[-1]
        error = (1 / (1 + np.exp(-score)) - target) * share
        slope = np.append(np.bincount(index, error[row] * value, weights), error.sum()) + 1e-6 * out
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        out -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return out


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in rows(batches):
        counts.update(map(votes, batch.column("text").to_pylist()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"]
    )


def _train(batches: Iterator[pa.RecordBatch], posterior: dict[str, float], weights: int) -> Iterator[pa.RecordBatch]:
    """The scorer's weights, in one row; runs in one task, over the bounded sample."""
    features, target, counts, made = [], [], [], Features(weights)
    for batch in rows(batches):
        for text, n in zip(batch.column("text").to_pylist(), batch.column("n").to_pylist()):
            if text.split():
                features.append(made.of(text))
                target.append(posterior[votes(text)])
                counts.append(n)
    fitted = fit_scorer(features, np.array(target), weights, counts=np.array(counts, float))
    yield pa.RecordBatch.from_arrays([pa.array([fitted.astype(np.float32).tobytes()], pa.binary())], ["weights"])


def _score(batches: Iterator[pa.RecordBatch], weights: Broadcast) -> Iterator[pa.RecordBatch]:
    fitted = np.frombuffer(weights.value, np.float32).astype(np.float64)
    made = Features(len(fitted) - 1)
    for batch in rows(batches):
        scores = []
        for text in batch.column("text").to_pylist():
            index, value = made.of(text)
            scores.append(float(1 / (1 + np.exp(-(fitted[index] @ value + fitted[-1])))) if len(index) else 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([s >= 0.5 for s in scores], pa.bool_())],
            ["doc_id", "score", "good"],
        )


def pattern_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How many texts have each pattern of votes."""
    texts = documents(docs, text, text).select("text")
    counted = texts.mapInArrow(_patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r.pattern: r.n for r in counted.collect()}


def score_quality(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, weights: int = WEIGHTS
) -> DataFrame:
    """Per document: doc_id, score (0 to 1), good."""
    texts = documents(docs, key, text)
    counts = pattern_counts(docs, text)
    posterior, _ = fit_labellers(counts)
    total = sum(counts.values())
    part = min(1.0, sample / max(1, total))
    # a share of the hash's range, not of the rows: equal texts are in or out together
    chosen = texts.select("text").where(F.shiftrightunsigned(F.xxhash64("text"), 1) <= F.lit(min(int(part * 2**63), 2**63 - 1)))
    # copies combine map-side: a text that many rows repeat is one row of the task that fits
    distinct = chosen.groupBy("text").agg(F.count("*").alias("n"))
    fitted = distinct.repartition(1).mapInArrow(partial(_train, posterior=posterior, weights=weights), "weights binary").first()
    # a plan known to be empty has no task, and so no row
    none = np.zeros(weights + 1, np.float32).tobytes()
    shared = docs.sparkSession.sparkContext.broadcast(bytes(fitted.weights) if fitted else none)
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double, good boolean"
    return texts.mapInArrow(partial(_score, weights=shared), schema)


def keep_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The good documents, with all their columns."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return score_quality(carried, "row", "text", **options).where("good").select("doc_id.*")
