"""Hidden Markov scores against enumeration of state paths and a plain recount of the corpus."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from brackish.llm import hidden_markov
from brackish.llm.hidden_markov import CLASSES, SYMBOLS, Chain, Counts, score_texts, suffix_class
from brackish.llm.text import read
from tests.llm.naive import LOWER

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.encode() for w in WORDS.findall((text or "").translate(LOWER))] + [b""]


def chain(rng, symbols=5, states=3):
    def rows(*shape):
        x = rng.random(shape) + 0.01
        return x / x.sum(-1, keepdims=True)

    return Chain(rows(states), rows(states, states), rows(states, symbols).T.copy())


def paths(model, text):
    """(probability, states) of every state path of a text."""
    for path in product(range(len(model.first)), repeat=len(text)):
        p = model.first[path[0]] * model.emit[text[0], path[0]]
        for a, b, symbol in zip(path, path[1:], text[1:]):
            p *= model.move[a, b] * model.emit[symbol, b]
        yield p, path


@pytest.mark.parametrize("batch", [3, 1 << 20])
def test_likelihood_and_expected_counts(monkeypatch, batch):
    monkeypatch.setattr(hidden_markov, "BATCH", batch)
    rng = np.random.default_rng(1)
    model = chain(rng)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 7, 2, 7, 5)]
    want, logs = Counts(5, 3), []
    for text in texts:
        ways = list(paths(model, text))
        total = sum(p for p, _ in ways)
        logs.append(np.log10(total))
        for p, path in ways:
            want.first[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want.move[a, b] += p / total
            for symbol, state in zip(text, path):
                want.emit[symbol, state] += p / total
    assert np.allclose(model.log10(texts), logs, atol=1e-12)
    got = Counts(5, 3)
    model.expect(texts, got)
    for name in ("first", "move", "emit"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-12), name


def test_long_text_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    model = chain(rng)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (3000, 20, 1)]
    whole = model.log10(texts)
    expected = Counts(5, 3)
    model.expect(texts, expected)
    monkeypatch.setattr(hidden_markov, "BATCH", 100)
    assert np.allclose(model.log10(texts), whole, rtol=1e-12)
    again = Counts(5, 3)
    model.expect(texts, again)
    assert np.allclose(again.move, expected.move) and np.allclose(again.emit, expected.emit)
    assert abs(expected.emit.sum() - 3021) < 1e-6 and abs(expected.move.sum() - 3018) < 1e-6


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "r", 2.0) for d in docs], "doc_id long, text string, row long, word string, score double")


def corpus():
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("ab cd ef Gh ij".split() + [f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, " \t\n"), (153, "x" * 300 + " " + "é ü É"), (154, "never seen words " * 3), (154, "twice"), (None, "ab cd")]
    return docs + [(200, "ab ef\x0bgh " * 20_000)]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def plain_counts(docs):
    return Counter(t for i, text in docs if not is_held(i) for t in tokens(text))


def plain_scores(docs, iterations, states):
    """Whole training and scoring in plain loops over texts, over all words at once."""
    count = plain_counts(docs)
    total = sum(count.values())
    own = [w for w in sorted(count, key=lambda w: (-count[w], w)) if w and len(w) <= 64 and count[w] * SYMBOLS >= total]
    symbol = {w: k for k, w in enumerate(own)}
    classes = Counter()
    kinds = Counter()
    for w, n in count.items():
        if w and w not in symbol:
            classes[suffix_class(w)] += n
            kinds[suffix_class(w)] += 1

    def code(w):
        return len(own) + CLASSES if not w else symbol.get(w, len(own) + suffix_class(w))

    share = np.array([count[w] for w in own] + [classes[k] for k in range(CLASSES)] + [count[b""]]) + 0.5
    share /= share.sum()
    model = Chain.start(share, states)
    texts = [(i, tokens(t)) for i, t in docs]
    for _ in range(iterations):
        want = Counts(len(share), states)
        for i, text in texts:
            if not is_held(i):
                model.expect([np.array([code(w) for w in text], np.uint16)], want)
        model = model.updated(want.first, want.move, want.emit, share)
    out = []
    for i, text in texts:
        base = sum(np.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in text)
        score = model.log10([np.array([code(w) for w in text], np.uint16)])[0]
        for w in text:
            if w and w not in symbol:
                k = suffix_class(w)
                score += np.log10((count[w] + 0.5) / (classes[k] + 0.5 * (kinds[k] + 1)))
        out.append((i, is_held(i), len(text), sum(count[w] > 0 for w in text), total, base, score))
    return out


def rounded(rows):
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 2)) for r in rows), key=str)


@pytest.mark.parametrize(("lookup", "symbols"), [(1 << 18, 1 << 14), (300, 40)])
def test_whole_job(spark, monkeypatch, lookup, symbols):
    monkeypatch.setattr(hidden_markov, "LOOKUP", lookup)
    monkeypatch.setattr(hidden_markov, "SYMBOLS", symbols)
    monkeypatch.setattr("tests.llm.test_language_model.SYMBOLS", symbols)
    docs = corpus()
    got = score_texts(frame(spark, docs).repartition(3), states=3, iterations=2).collect()
    want = plain_scores(docs, 2, 3)
    a, b = rounded(map(tuple, got)), rounded(want)
    assert [r[:6] for r in a] == [r[:6] for r in b]
    assert np.allclose([r[6] for r in a], [r[6] for r in b], rtol=2e-3)


def test_training_raises_the_held_out_score(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    totals = [score_texts(docs, iterations=n).where("held_out").selectExpr("sum(score)", "sum(base_score)").first() for n in (0, 4)]
    assert totals[1][0] > totals[0][0] and totals[1][0] > totals[1][1]


def test_empty_and_no_training_text(spark):
    assert score_texts(frame(spark, []), iterations=1).count() == 0
    held = next(i for i in range(100) if is_held(i))
    got = score_texts(frame(spark, [(held, "a b")]), iterations=1).first()
    assert (got.train_tokens, got.n_tokens, got.n_known, got.base_score) == (0, 3, 0, 0.0)
    assert got.score < 0
