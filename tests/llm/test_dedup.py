"""Exact, near and line dedup against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from brackish.llm import near_dedup
from brackish.llm.bagminhash import Shingles, overlap, signatures
from brackish.llm.components import components
from brackish.llm.exact_dedup import drop_duplicates, duplicate_groups
from brackish.llm.line_dedup import drop_common_lines
from brackish.llm.near_dedup import drop_near_duplicates, near_duplicate_groups
from tests.llm import naive

SCHEMA = "doc_id long, text string, rid string, name string, kept string, n int"
LONG = "long text without end " * 4000


def frame(spark, docs):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "r", "n", "k", 7) for i, t in docs], SCHEMA)


EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "ab"), (6, "a  b "), (6, "a  b "), (7, "A b"), (None, "ab"), (8, LONG),
    (9, LONG.replace(" ", "")), (10, LONG + "x"), (11, "é\x0b"), (12, "é"), (13, "\x85"), (14, "\xa0"),
]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_exact_groups(spark, block):
    docs = EDGES if block > 1 else [d for d in EDGES if len(d[1] or "") < 100]
    got = sorted(map(tuple, duplicate_groups(frame(spark, docs), block=block).collect()), key=str)
    want = []
    for bare, group in naive.exact_groups(docs).items():
        best = naive.best_of(group)
        kept = False
        for i, t in group:
            keep = (i, t) == best and not kept
            kept |= keep
            want.append((i, best[0], len(group), keep, hashlib.sha256(bare.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_drop_keeps_columns_and_one_of_each(spark):
    kept = drop_duplicates(frame(spark, EDGES))
    assert kept.columns == ["doc_id", "text", "rid", "name", "kept", "n"]
    rows = kept.collect()
    assert {r.rid for r in rows} == {"r"} and {r.n for r in rows} == {7}
    assert sorted(naive.bare(r.text) for r in rows) == sorted(naive.exact_groups(EDGES))


def test_empty_tables(spark):
    none = frame(spark, [])
    for made in (
        duplicate_groups(none), drop_duplicates(none), near_duplicate_groups(none), drop_near_duplicates(none), drop_common_lines(none)
    ):
        assert made.count() == 0


def family(seed: int, size: int, copies: int) -> list[str]:
    """A text and edits of it, from slight to heavy."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = [" ".join(base)]
    for k in range(copies):
        edited = list(base)
        for _ in range(1 + k % 9):
            edited[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(edited))
    return out


def near_docs() -> list[tuple[int, str | None]]:
    texts = [t for seed in range(6) for t in family(seed, 60 + 40 * seed, 24)]
    texts += texts[:40] + ["one two", "One, two!", "one two three", None, "", "!!", "spam " * 300, "spam " * 310, "spam " * 900]
    random.Random(1).shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [128, 4])
def test_near_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "TOGETHER", 2)
    docs = near_docs()
    want = naive.near_classes(docs)
    got = near_duplicate_groups(frame(spark, docs)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = [list(want.values()).count(r.class_id) for r in got]
    assert [r.class_size for r in got] == sizes
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_drop(spark):
    docs = near_docs()
    docs += [(0, docs[0][1]), (0, docs[0][1])]  # rows that repeat doc_id and text
    kept = drop_near_duplicates(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "rid", "name", "kept", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(naive.near_classes(docs).values()))


def test_near_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = near_duplicate_groups(frame(spark, [(None, text), (5, text), (None, "other words here and there")])).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in got), key=str) == sorted(
        [(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True)], key=str
    )


@pytest.mark.parametrize("most", [2, 15, 200])
def test_signatures_estimate_weighted_jaccard(most):
    rng = np.random.default_rng(most)
    ids = np.sort(rng.integers(0, 2**63, 150).astype(np.uint64))
    left = rng.integers(0, most, 150)
    right = np.where(rng.random(150) < 0.7, left, rng.integers(0, most, 150))
    a, b = (ids[left > 0], left[left > 0]), (ids[right > 0], right[right > 0])
    both = signatures([a, b], 4096)
    least, total = overlap(a, b)
    assert abs((both[0] == both[1]).mean() - least / total) < 4 * 0.5 / 64
    assert (signatures([b], 4096)[0] == both[1]).all()  # whatever else is in the batch


def test_shingles_count_repeats():
    made = Shingles(5)
    assert made.of([b"a"] * 9)[1].tolist() == [5]
    assert made.of([b"a"] * 4)[1].tolist() == [1]
    assert made.of([b"a"] * 4)[0] != made.of([b"a"] * 3)[0]
    assert len(made.of([])[0]) == 0


def test_components_of_chain_star_and_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(0).shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 203)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_lines(spark):
    texts = ["Head \n" + f"own {i}\nfoot" for i in range(10)] + ["\thead\nfoot\n\nfoot", None, "", "HEAD", "É", "é", LONG]
    texts += [f"rare {i % 9}\nrare {i % 2}" for i in range(9)]
    docs = list(enumerate(texts))
    got = sorted(drop_common_lines(frame(spark, docs)).collect())
    for row, (n, gone, kept) in zip(got, naive.line_dedup(texts), strict=True):
        assert (row.n_lines, row.n_dropped, row.kept_text) == (n, gone, kept)
        assert row.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_common_lines_of_repeated_rows(spark):
    docs = [(1, "same\nline")] * 12 + [(None, "same\nother")] * 2
    got = drop_common_lines(frame(spark, docs)).collect()
    assert len(got) == 14
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got} == {(1, 2, 2, ""), (None, 2, 1, "other")}
