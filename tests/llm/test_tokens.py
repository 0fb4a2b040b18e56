"""Token counts and SentencePiece against the libraries and against enumeration."""

from __future__ import annotations

import random
import time
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from brackish.llm.sentencepiece import SPACE, Encoder, Model, cheapest_ways, decode_ids, encode_texts
from brackish.llm.text import read
from brackish.llm.token_counts import Lengths, count_tokens, frequent_pretokens, pack_table, unpack_table

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"

ODD = [
    None, "", " ", "a", "<|endoftext|> x<|endoftext|>", "漢字🤡 ͸", "it's  we'll\n\n  ok\t\t1234 ½", "\x1c\x85\xa0a", "▁ ▁a",
    "É́a", "a‍b", "  two   spaces \n", "x" * 50_000, "the cat " * 8_000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_bytes string")


def test_counts_are_the_library_s(spark):
    texts = ODD + [r.text for r in read(spark, FOLDER, "documents").collect()]
    want = [len(x) for x in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = sorted(count_tokens(frame(spark, texts), BPE, limit=300).collect())
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [n > 300 for n in want]


def test_counts_do_not_depend_on_the_tiers(spark):
    texts = [r.text for r in read(spark, FOLDER, "documents").collect()][:40]
    full = Lengths(BPE, {}).count(texts)
    assert Lengths(BPE, {}, cache=3).count(texts) == full
    assert Lengths(BPE, {" the": 1, ".": 1}).count(texts) == full
    assert count_tokens(frame(spark, []), BPE).count() == 0
    repeated = frame(spark, texts[:2]).unionAll(frame(spark, texts[:2]))
    assert [r.n_tokens for r in sorted(count_tokens(repeated, BPE, table=4).collect())] == [full[0], full[0], full[1], full[1]]


def test_mixed_scripts_use_the_tiers():
    """Only the pieces with unsettled characters or added tokens reach the library as they are."""
    rng = random.Random(4)
    parts = ["the", "cat", "it's", ",", "\n", " ", "  ", "\t", "🙂", "नमस्ते", "漢字", "\u3000", "\x85", "\x1c", "\u2028", "́", "‍", "͸", "\u180e",
             "<|endoftext|>", "12", "½", "٣", "é", "...", "\xa0", "'ll", "𝔘", "\ue000"]
    texts = ["good 🙂 text", "a <|endoftext|> b", " <|endoftext|>  x"]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", "", " ", "  "]) for _ in range(rng.randrange(1, 30))) for _ in range(3_000)]
    library = Tokenizer.from_file(BPE)
    lengths = Lengths(BPE, {" text": 1})
    assert lengths.pieces("good 🙂 text, it's") == ["good", " 🙂 text,", " it", "'s"]
    assert lengths.count(texts) == [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert lengths.count(["x" * 100_000 + " y"]) and max(map(len, lengths.cache)) <= 128


def test_table(spark):
    docs = spark.createDataFrame([(b"the cat the dog",), (b"on the end",)], "text binary")
    assert " the" in frequent_pretokens(docs, 2) and len(frequent_pretokens(docs, 2)) == 2
    table = {" the": 1, "é\n": 3, "x" * 60: 40}
    assert unpack_table(pack_table(table)) == table


def enumerate_all(model: Model, text: str) -> list[float]:
    """Scores of all segmentations of a text, best first."""
    written = SPACE + text.replace(" ", SPACE)

    def rest(at: int):
        if at == len(written):
            yield 0.0
            return
        lone = True
        for end in range(at + 1, len(written) + 1):
            piece = model.piece_of.get(written[at:end])
            if piece is not None:
                lone = lone and end > at + 1
                for score in rest(end):
                    yield model.scores[piece] + score
        if lone:
            for score in rest(at + 1):
                yield model.unknown_score + score

    return sorted(rest(0), reverse=True)


@pytest.fixture(scope="module")
def model():
    return Model(PIECES)


@pytest.mark.parametrize("text", ["a", "the cat", "hello", "a\nb", "ñandú", "漢x", "it is", " x ", "%%% a"])
@pytest.mark.parametrize("best", [1, 4, 7])
def test_n_best_is_complete(model, text, best):
    want = enumerate_all(model, text)[:best]
    score, ids, ways = next(Encoder(model, best).encode([text]))
    assert [s for s, _ in ways] == want and score == want[0] and ways[0][1] == ids
    assert len({w for _, w in ways}) == len(ways)


def _parts(data: bytes):
    """(field, payload, raw bytes) of a protocol buffer's length-delimited and number fields."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        start = at
        key, at = number(at)
        if key & 7 == 2:
            size, at = number(at)
            payload, at = data[at : at + size], at + size
        elif key & 7 == 0:
            payload, at = number(at)
        else:
            payload, at = None, at + (4 if key & 7 == 5 else 8)
        yield key >> 3, payload, data[start:at]


def as_lattice_model(path: str) -> bytes:
    """The same pieces and scores, with the model type that lets the library search its lattice."""
    out = b""
    for field, payload, raw in _parts(open(path, "rb").read()):
        if field == 2:  # trainer settings; their field 3 is the model type
            kept = b"".join(r for f, _, r in _parts(payload) if f != 3) + bytes([3 << 3, 1])
            size = len(kept)
            length = bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])
            raw = bytes([2 << 3 | 2]) + length + kept
        out += raw
    return out


def test_n_best_is_the_library_s(spark, model):
    library = SentencePieceProcessor(model_proto=as_lattice_model(PIECES))
    texts = [t[:60].split("\n")[0].strip() for t in (r.text for r in read(spark, FOLDER, "documents").collect())]
    encoder, tried = Encoder(model, 4), 0
    for text, (score, _, ways) in zip(texts, encoder.encode(texts)):
        if score < -1e8:  # the library's 32-bit sums are not exact there
            continue
        tried += 1
        want = [sum(model.scores[i] for i in ids) for ids in library.nbest_encode_as_ids(text, 4)]
        assert [s for s, _ in ways] == want
    assert tried > 100


def test_round_trip(spark):
    texts = ODD + [r.text for r in read(spark, FOLDER, "documents").collect()]
    encoded = encode_texts(frame(spark, texts), PIECES, with_n_best=True)
    rows = sorted(encoded.collect())
    assert [r.round_trip for r in rows] == ["▁" not in (t or "") for t in texts]
    assert all(r.n_best[0] == r.ids and r.n_pieces == len(r.ids) for r in rows)
    back = sorted(decode_ids(encoded, PIECES).collect())
    assert [r.text for r in back] == [(t or "").replace("▁", " ") for t in texts]
    assert rows[1].ids == [] and rows[1].scores == [0.0]
    for way in rows[6].n_best:
        assert Model(PIECES).decode(way).decode() == texts[6]


@pytest.mark.parametrize("text", ["x" * 20_000, "-" * 20_001, "ab" * 9_000, "A0+/" * 5_000])
def test_long_runs_end(model, text):
    begin = time.perf_counter()
    score, ids, ways = next(Encoder(model, 4).encode([text]))
    assert len({w for _, w in ways}) == len(ways) > 1 and ways[0] == (score, ids)
    assert all(a >= b - 1e-6 for (a, _), (b, _) in zip(ways, ways[1:]))
    assert all(model.decode(np.frombuffer(w, np.int32).tolist()).decode() == text for _, w in ways)
    assert time.perf_counter() - begin < 10


def test_many_alternatives(model):
    rng = random.Random(1)
    for _ in range(30):
        options = [[0.0, *sorted(rng.choice([0.0, 0.5, 1.5, rng.random()]) for _ in range(rng.randrange(4)))] for _ in range(rng.randrange(6))]
        every = sorted(sum(o[i] for o, i in zip(options, way)) for way in product(*[range(len(o)) for o in options]))
        found = cheapest_ways(options, 9)
        assert [c for c, _ in found] == pytest.approx(every[:9]) and len({w for _, w in found}) == len(found)
    begin = time.perf_counter()
    _, _, ways = next(Encoder(model, 16).encode(["every word has some other way to be cut " * 11]))
    assert len({w for _, w in ways}) == 16 and time.perf_counter() - begin < 1


def test_small_cache_changes_nothing(model):
    texts = ["the cat sat", "on the mat", "the cat sat", "xyzzy plugh"]
    assert list(Encoder(model, 4, cache=2).encode(texts)) == list(Encoder(model, 4).encode(texts))


def test_empty_and_null(spark):
    assert encode_texts(frame(spark, []), PIECES).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, decode_ids(ids, PIECES).collect())) == [(1, None), (2, "")]
