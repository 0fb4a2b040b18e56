"""Decontamination, license scan, quality classifier, archives and chats against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brackish.llm import warc
from brackish.llm.chat import render_conversations
from brackish.llm.decontaminate import SuffixAutomaton, cut_spans, drop_contaminated, find_contamination
from brackish.llm.license_scan import BASE, TEMPLATES, Scanner, compile_template, scan_licenses, template_regex
from brackish.llm.quality import Features, fit_labellers, fit_scorer, keep_good, score_quality, votes
from brackish.llm.text import read
from tests.llm import naive

FOLDER = "/root/testdata/sf0.01"


def frame(spark, docs, more="n_words long, row string, spans int"):
    return spark.createDataFrame([(i, t, 5, "r", 3) for i, t in docs], f"doc_id long, text string, {more}")


def test_many_base_places_in_linear_time():
    scanner = Scanner(BASE, {})
    text = b"x cc by all rights reserved " * 40_000
    begin = time.perf_counter()
    n, starts, labels, _ = scanner.scan(text)
    assert time.perf_counter() - begin < 1
    assert n == 240_000 and labels == {"cc-by", "reserved"}
    assert sorted(starts) == [k for at in range(0, 240_000, 6) for k in (at + 1, at + 3)]


# decontamination


def items_and_docs():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([40, 13, 14, 25, 5, 3, 30])] + [(7, None), (8, "!!"), (9, "w1"), (None, say(16))]
    items += [(3, items[0][1]), (20, items[1][1].upper()), (21, say(6) + " " + items[2][1])]
    docs = [(i, say(rng.randrange(1, 80))) for i in range(60)]
    for i, (_, text) in enumerate(items):
        w = naive.words(text)
        for cut in (0, 2):
            docs.append((100 + 10 * i + cut, f"{say(rng.randrange(30))}, {'-'.join(w[cut:])}! {say(rng.randrange(30))}"))
    return items, docs + [(900, None), (901, ""), (902, "..."), (903, "w1 " * 30_000), (903, "w1 w2"), (None, items[3][1])]


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_contamination(spark, block_words):
    items, docs = items_and_docs()
    got = find_contamination(
        frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words
    ).collect()
    want = []
    for i, text in docs:
        n, hit, names = naive.contamination(text, items)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((i, n, hit, len(names), digest, hit > 0 and 20 * hit >= n))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)


def test_clean_text_loses_the_spans():
    assert cut_spans("Say: one, Two three! four".encode(), [(1, 3)]) == b"Say:  three! four"
    assert cut_spans(b"a b", [(0, 2)]) == b""


def test_longest_match():
    sa = SuffixAutomaton([("x", [b"a", b"b", b"c", b"a", b"b", b"d"])], window=3)
    assert sa.match(list(sa.ids([b"c", b"a", b"b", b"c"])))[2] == 3
    assert sa.match(list(sa.ids([b"b", b"c", b"a", b"b", b"d"]))) == ([(0, 3), (1, 4), (2, 5)], {0}, 5)


def test_drop_contaminated(spark):
    items, docs = items_and_docs()
    table = spark.createDataFrame(items[:4], "item_id long, text string")
    kept = drop_contaminated(frame(spark, docs), table)
    assert kept.columns == ["doc_id", "text", "n_words", "row", "spans"]
    want = [d for d in docs if not (c := naive.contamination(d[1], items[:4]))[1] or 20 * c[1] < c[0]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert find_contamination(frame(spark, []), table).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert drop_contaminated(frame(spark, docs), none).count() == len(docs)


# licenses


def test_template_markup():
    a = compile_template("x", "one <<opt>>two three<<end>> <<var 1 2>> four")
    match = lambda text: a.match(text.encode().split(), 0)
    assert match("one two three x four") == 5 and match("one x y four z") == 4
    assert match("one four") is None and match("one two x y four") is None and match("one x four four") == 4
    assert a.anchor in (b" one ", b" four ")
    for bad in ("<<opt>>a", "<<var 1 2>>", ""):
        with pytest.raises(ValueError):
            compile_template("x", bad)
    with pytest.raises(ValueError):
        Scanner({}, {"x": "<<opt>>a<<end>> b", "y": "<<opt>>only<<end>>"})


def test_automata_accept_what_their_expressions_do():
    rng = random.Random(3)
    for label, template in TEMPLATES.items():
        scanner = Scanner({}, {label: template})
        vocabulary = [w for w in re.sub(r"<<[^>]*>>", " ", template).split()] + ["other"]
        for _ in range(300):
            text = re.sub(r"<<opt>>(.*?)<<end>>", lambda m: m[1] if rng.random() < 0.5 else "", template)
            text = re.sub(r"<<alt>>(.*?)<<end>>", lambda m: rng.choice(m[1].split("<<or>>")), text)
            text = re.sub(r"<<var (\d+) (\d+)>>", lambda m: "thing " * rng.randrange(int(m[1]) - 1, int(m[2]) + 2), text)
            w = text.split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            w = [rng.choice(vocabulary) for _ in range(3)] + w
            want = re.search(template_regex(template), f" {' '.join(w)} ") is not None
            assert bool(scanner.scan(" ".join(w).encode())[3]) == want


def test_license_scan(spark):
    docs = [
        (1, "CC BY; cc-by CC by cc BY"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."),
        (5, "All Rights\nReserved. GNU General Public License v3"), (5, "Copyright (c) 2020 A. Person. All rights reserved."),
        (None, "x " * 50_000 + "released under the MIT license"), (6, "éall rights reserved cc byé"),
    ]
    got = scan_licenses(frame(spark, docs)).collect()
    rows = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got), key=str)
    want = [
        (1, 8, 4, 0, 6, "cc-by", "cc-by", 0.5),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 0, 0, None, None, "", "", 0.0),
        (4, 8, 0, None, None, "", "apache-2.0", 1.0),
        (5, 8, 2, 0, 4, "gpl,reserved", "gpl,reserved", 0.5),
        (5, 8, 1, 5, 5, "reserved", "copyright,reserved", 1.0),
        (6, 5, 0, None, None, "", "", 0.0),
        (None, 50_005, 0, None, None, "", "mit", 1.0),
    ]
    assert rows == sorted(want, key=str)
    assert scan_licenses(frame(spark, [])).count() == 0


def test_verbs_and_long_holders():
    scan = lambda text: [(x, i, j) for x, i, j in Scanner({}, TEMPLATES).scan(text.encode())[3]]
    assert scan("Licensed under the MIT License") == [("mit", 0, 5)]
    assert scan("Released under the Apache License, Version 2.0") == [("apache-2.0", 0, 8)]
    regents = "Copyright 1996, 1999, 2000, 2007 The Regents of the University of California. All rights reserved."
    assert scan(regents) == [("copyright", 0, 15)]
    assert scan(f"{regents} Then more. {regents} end") == [("copyright", 0, 15), ("copyright", 17, 32)]
    assert scan("all rights reserved " + "copyright x " * 20_000) == []


def test_alternatives():
    a = compile_template("x", "one <<alt>>two <<opt>>three<<end>><<or>>four<<or>>five six<<end>> seven")
    match = lambda text: a.match(text.encode().split(), 0)
    assert [match(f"one {x} seven") for x in ("two", "two three", "four", "five six")] == [3, 4, 3, 4]
    assert [match(f"one {x} seven") for x in ("", "three", "two four", "five", "two three four")] == [None] * 5
    plain = re.compile(template_regex("one <<alt>>two <<opt>>three<<end>><<or>>four<<or>>five six<<end>> seven"))
    rng = random.Random(7)
    for _ in range(2_000):
        text = " ".join(rng.choice("one two three four five six seven".split()) for _ in range(6))
        assert bool(plain.search(f" {text} ")) == bool(Scanner({}, {"x": "one <<alt>>two <<opt>>three<<end>><<or>>four<<or>>five six<<end>> seven"}).scan(text.encode())[3])
    for bad in ("a <<or>> b", "a <<opt>>b<<or>>c<<end>>", "a <<alt>>b<<or>>c", "a b<<end>>", "<<alt>>a<<or>>b<<end>>"):
        with pytest.raises(ValueError):
            compile_template("x", bad)


@pytest.mark.parametrize(
    "text,labels",
    [
        ("This work is licensed under 4.0.", []),
        ("Licensed under CC BY 4.0", ["cc-by-4.0"]),
        ("Licensed under CC BY-NC 4.0", ["cc-by-nc-4.0"]),
        ("licensed under a Creative Commons Attribution 4.0 International License", ["cc-by-4.0"]),
        ("licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", ["cc-by-nc-4.0"]),
        ("SPDX-License-Identifier: MIT", ["spdx-mit"]),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", ["spdx-gpl-3.0"]),
        ("SPDX-License-Identifier: BSD-4-Clause", []),
    ],
)
def test_labels_written_by_hand(text, labels):
    assert sorted({x for x, _, _ in Scanner({}, TEMPLATES).scan(text.encode())[3]}) == labels


# quality


def test_label_model_finds_the_rates():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    counts: dict[str, int] = {}
    error = [0.02, 0.05, 0.1, 0.2, 0.05, 0.1, 0.3, 0.02, 0.1]
    for good in truth:
        vote = ["." if rng.random() < 0.1 else "-" if rng.random() < 0.2 else "g" if (rng.random() > e) == good else "b" for e in error]
        counts["".join(vote)] = counts.get("".join(vote), 0) + 1
    posterior, rates = fit_labellers(counts)
    assert abs(sum(posterior[p] * n for p, n in counts.items()) / len(truth) - 0.8) < 0.01
    assert np.allclose(rates[:, 1, 1] / rates[:, 1, :2].sum(1), error, atol=0.03)
    assert fit_labellers({})[0] == {} and list(fit_labellers({"." * 9: 4})[0]) == ["." * 9]


def test_quality_on_held_out_labels(spark):
    docs = read(spark, FOLDER, "documents")
    scores = {r.doc_id: r for r in score_quality(docs).collect()}
    labels = [(r.quality, scores[r.doc_id]) for r in read(spark, FOLDER, "labels").collect()]
    # the labels are never seen by the model
    assert all(s.good for q, s in labels if q == 1)
    assert sum(not s.good for q, s in labels if q == 0) >= 0.97 * sum(q == 0 for q, _ in labels)
    again = {r.doc_id: r.score for r in score_quality(docs.repartition(5)).collect()}
    assert all(abs(again[i] - s.score) < 1e-6 for i, s in scores.items())


def test_quality_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "fine words here"), (4, "fine words here"), (None, "%%% " * 9000)]
    got = sorted(((r.doc_id, r.score == 0, r.good) for r in score_quality(frame(spark, docs)).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, True, False), (2, True, False), (3, True, False)]
    assert len(got) == 6
    assert keep_good(frame(spark, docs)).columns == ["doc_id", "text", "n_words", "row", "spans"]
    assert score_quality(frame(spark, [])).count() == 0
    assert votes(b"short text") == "." * 9


#: Word stock, sentence end, and words from one blank to the next, of clean prose.
PROSE = {
    "hi": ("भारत एक विशाल देश है और यहाँ अनेक भाषाएँ बोली जाती हैं लोग अपने त्योहार मनाते नदी के किनारे बसे गाँव में सुबह काम शुरू होता बच्चे स्कूल जाते किसान खेत में गेहूँ उगाते", "।", 1),
    "ru": ("сегодня утром мы вышли из дома и пошли вдоль реки к старому мосту где рыбаки уже ждали первых лодок дети бежали впереди США смеялись USA", ".", 1),
    "pl": ("dzisiaj rano wyszliśmy z domu i poszliśmy wzdłuż rzeki do starego mostu gdzie rybacy już czekali na pierwsze łodzie dzieci biegły przodem śmiejąc się głośno", ".", 1),
    "zh": ("今天 天气 很 好 我们 一起 去 公园 散步 孩子 们 在 草地 上 玩耍 老人 坐 树下 聊天 河水 慢慢 流过 村庄 市场 里 有 新鲜 水果", " 。", 1),
    "th": ("เมื่อเช้านี้ ฝนตก หนักมาก เด็กนักเรียน เดินไป โรงเรียน แม่ค้า ขายผลไม้ อยู่ริมถนน ชาวนา กำลัง เกี่ยวข้าว ในทุ่ง น้ำ ในแม่น้ำ ไหลช้าลง ตลาด เปิด", "", 6),
    "ar": ("خرجنا في الصباح من البيت وسرنا على طول النهر إلى الجسر القديم حيث كان الصيادون ينتظرون القوارب الأولى هل رأيت الأطفال يركضون", "؟", 1),
}


def prose(rng, language, sentences=16):
    stock, end, joined = PROSE[language]
    said = ("".join(rng.choice(stock.split()) for _ in range(joined)) for _ in range(12 * sentences))
    return "".join(w + (f"{end} " if i % 12 == 11 else " ") for i, w in enumerate(said))


@pytest.mark.parametrize("language", PROSE)
def test_labellers_hold_no_language_against_a_text(language):
    rng = random.Random(2)
    for _ in range(20):
        assert "b" not in votes(prose(rng, language).encode())


def test_clean_texts_of_other_scripts_are_kept(spark):
    rng = random.Random(4)
    clean = [(i, prose(rng, language)) for i, language in enumerate(list(PROSE) * 20)]
    junk = [(1000 + i, " ".join(rng.choice(["%$#@", "BUY", "BUY", "{}<>", "NOW"]) for _ in range(120))) for i in range(40)]
    good = {r.doc_id: r.good for r in score_quality(frame(spark, clean + junk)).collect()}
    assert all(good[i] for i, _ in clean) and not any(good[i] for i, _ in junk)


def test_scorer_learns():
    made = Features(1 << 10)
    texts = [f"good text {i}".encode() for i in range(50)] + [f"bad BAD {i}".encode() for i in range(50)]
    target = np.repeat([1.0, 0.0], 50)
    features = [made.of(t) for t in texts]
    w = fit_scorer(features, target, 1 << 10)
    assert all((w[x] @ v + w[-1] > 0) == (t == 1) for (x, v), t in zip(features, target))


def test_copies_are_one_weighted_text(spark, monkeypatch):
    """The scorer's weights are those of the full table, from one row per distinct text."""
    rng = random.Random(6)
    texts = [prose(rng, "ru", 4) for _ in range(10)] + ["%% ## BUY NOW " * 30, "BUY {} <> NOW " * 30]
    docs = [t for i, t in enumerate(texts) for _ in range(1 + 7 * i)]
    posterior, _ = fit_labellers(dict(Counter(votes(t.encode()) for t in docs)))
    made = Features()
    want = fit_scorer([made.of(t.encode()) for t in docs], np.array([posterior[votes(t.encode())] for t in docs]))
    seen = []

    def train(self, function, schema):
        if schema == "weights binary":
            seen.append(sorted((bytes(r.text).decode(), r.n) for r in self.collect()))
        return original(self, function, schema)

    kind = type(spark.range(0))
    original = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", train)
    scores = score_quality(frame(spark, list(enumerate(docs)))).collect()
    assert seen == [sorted(Counter(docs).items())]
    for r in scores:
        index, value = made.of(docs[r.doc_id].encode())
        assert abs(r.score - 1 / (1 + np.exp(-(want[index] @ value + want[-1])))) < 1e-3


def test_shape_is_of_the_whole_token():
    made = Features()
    assert made._token(b"a-" * 40 + b"{")[1] != made._token(b"a-" * 40 + b"a")[1]


# archives


PAGES = [
    (5, "http://a/5", "x" * 150), (3, "http://a/3", "x" * 150), (9, "u r\r\nl", "x" * 150), (9, "again", "x" * 150), (1, None, "short"),
    (2, "s", "short"), (4, "", None), (6, "e", ""), (None, "n", "y" * 200), (7, "y", "y" * 200),
    (10, "w", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (11, "v", "WARC/1.1\r\n" * 30), (12, "é", "é漢" * 5000),
    (13, "z", "\r\n\r\n\r\n\r\n" * 40 + "WARC/1.1\r\n"), (14, "cr", "a\r\n" * 5000),
]


@pytest.mark.parametrize("chunk,compression,split", [(1 << 20, "gzip", "128m"), (64, "none", "1k"), (1000, "none", "3k"), (7, "gzip", "128m")])
def test_archive_round_trip(spark, tmp_path, chunk, compression, split):
    pages = spark.createDataFrame([(*p, "digest") for p in PAGES], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/warc"
    warc.write_archive(pages.repartition(3), path, chunk=chunk, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_records(spark, path).collect()
        chunks = warc.read_chunks(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = {}
    for page, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(html or "", page)
    want = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        again = len(payload) >= 100 and page != first[html or ""]
        want.append((page, "revisit" if again else "response", first[html or ""] if again else None, len(payload), hashlib.sha256(payload).hexdigest()))

    def page_of(urn):
        name = None if urn is None else urn.removeprefix("urn:page:").partition("#")[0]
        return int(name) if name else None

    rows = [(page_of(r.record_id), r.record_type, page_of(r.refers_to), r.payload_bytes, r.payload_digest) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert max(len(c.payload) for c in chunks) <= chunk
    assert len({r.record_id for r in got}) == len(PAGES)


def test_revisits_name_records_of_the_archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES + [(3, None, "x" * 150)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_archive(pages.repartition(4), path, compression="none")
    got = warc.read_records(spark, path).collect()
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got) == len(PAGES) + 1
    revisits = [r for r in got if r.record_type == "revisit"]
    assert len(revisits) == 4
    for r in revisits:
        assert ids[r.refers_to].record_type == "response" and ids[r.refers_to].payload_digest == r.payload_digest


def test_null_and_empty_pages_differ(spark):
    long = "z" * 200
    table = [("", "u", long), (None, "u", long), ("+", "u", "a"), ("a b#/ü", "u", long), ("", "v", "a")]
    got = warc.archive_pages(spark.createDataFrame(table, "page_id string, url string, html string")).collect()
    rows = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    want = [("", "response", None, 200), (None, "revisit", "", 200), ("+", "response", None, 1), ("a b#/ü", "revisit", "", 200), ("", "response", None, 1)]
    assert rows == sorted(want, key=str)


def test_segments_of_a_large_payload_come_in_small_batches():
    size = 40 << 20
    row = {"page_id": 1, "url": "u", "payload": b"ab" * (size // 2), "bytes": size, "digest": "d", "copy": 0, "refers": None, "refers_url": None}
    batch = pa.RecordBatch.from_pylist([row | {"is_revisit": False}])
    made = [b.nbytes for b in warc._segments(iter([batch]), 1 << 20, "2024-01-01T00:00:00Z")]
    assert max(made) < 10 << 20 and size < sum(made) < size + (1 << 20)


def test_archive_pages_and_damage(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.archive_pages(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got.count() == len(PAGES)
    assert warc.archive_pages(pages.limit(0)).count() == 0
    path = tmp_path / "damaged"
    warc.write_archive(pages.where("page_id = 5"), f"file://{path}", compression="none")
    part = next(p for p in path.iterdir() if p.name.startswith("part-"))
    part.write_bytes(part.read_bytes().replace(b"xxxx\r\n", b"xxxy\r\n"))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="declared digest"):
        warc.read_records(spark, f"file://{path}").collect()


# chats


def test_chats(spark):
    talk = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", None), (None, "bye")]
    logs = [(c, t, r, x, "k") for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t, (r, x) in enumerate(talk[:n])]
    logs += [(6, 0, "user", "hi", "k"), (6, 1, "assistant", "other", "k"), (7, None, "user", "hi", "k"), (7, 0, "user", "hi", "k")]
    logs += [(3, 0, "user", "hi", "k"), (None, 0, "user", "alone", "k"), (8, 0, "user", "x" * 100_000, "k"), (9, 0, "us", "erhi", "k")]
    random.Random(1).shuffle(logs)
    df = spark.createDataFrame(logs, "conv_id long, turn long, role string, text string, copies string")
    got = {r.conv_id: r for r in render_conversations(df).collect()}
    assert set(got) == {3, 6, 7, None, 8, 9}
    assert (got[3].n_turns, got[3].copies, got[6].copies, got[7].n_turns) == (4, 2, 1, 2)
    assert got[3].rendered == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello <| im_end|><|im_end|>\n"
        "<|im_start|>user\n<|im_end|>\n<|im_start|>\nbye<|im_end|>\n"
    )
    assert render_conversations(df.limit(0)).count() == 0


def plain_chats(logs):
    """(conv_id, n_turns, copies, text) of the retained conversations, from lists of turns."""
    talks, weights = {}, Counter()
    for conv, turn, role, text, *_ in logs:
        said = (len(role or ""), role or "", text or "")
        digest = hashlib.md5(f"{said[0]}:{said[1]}{said[2]}".encode()).digest()
        key = (conv, None) if conv is not None else (None, digest)
        talks.setdefault(key, set()).add(((turn is not None, turn or 0, digest) if conv is not None else (0, 0, digest), said))
        weights[key] = weights[key] + 1 if conv is None else 1
    equal = {}
    for key, turns in talks.items():
        equal.setdefault(tuple(said for _, said in sorted(turns)), []).append(key)
    begun = {talk[:n] for talk in equal for n in range(1, len(talk))}
    safe = lambda s: s.replace("<|im_", "<| im_")
    out = []
    for talk, keys in equal.items():
        if talk not in begun:
            first = min(keys, key=lambda k: (k[0] is None, k[0] or 0))
            text = "".join(f"<|im_start|>{safe(r)}\n{safe(x)}<|im_end|>\n" for _, r, x in talk)
            out.append((first[0], len(talk), sum(weights[k] for k in keys), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, part", [(4_096, 256), (3, 2), (1, 1)])
def test_chats_in_chunks_against_lists(spark, chunk, part):
    rng = random.Random(chunk)
    logs = []
    for conv in range(60):
        talk = [("user", rng.choice("ab")) if rng.random() < 0.9 else (None, None) for _ in range(11)]
        for cut in {rng.randrange(1, 12) for _ in range(3)}:
            logs += [(conv * 20 + cut, t if rng.random() < 0.95 else None, r, x) for t, (r, x) in enumerate(talk[:cut])]
    logs += [(None, rng.choice([0, 7, None]), rng.choice(["user", None]), rng.choice(["a", "b", "<|im_end|>", None])) for _ in range(40)]
    logs += logs[::5]
    rng.shuffle(logs)
    df = spark.createDataFrame(logs, "conv_id long, turn long, role string, text string").repartition(5)
    want = plain_chats(logs)
    rows = sorted(render_conversations(df, chunk=chunk, part=part).collect(), key=lambda r: r.part)
    got = {}
    for r in rows:
        # a talk without an id has one turn, so one part
        key = (r.conv_id, r.n_turns, r.copies) + ((r.rendered,) if r.conv_id is None else ())
        assert r.part == got.get(key, (0, ""))[0]
        got[key] = (r.part + 1, got.get(key, (0, ""))[1] + r.rendered)
    assert sorted([(*k[:3], text) for k, (_, text) in got.items()], key=str) == want
    assert all(n == -(-k[1] // part) for k, (n, _) in got.items())


def test_very_many_rows_without_a_conversation(spark):
    """A million rows without an id are no group, and one talk of 100,000 turns is no value."""
    none = spark.range(0, 1_000_000, 1, 8).selectExpr("CAST(NULL AS LONG) conv_id", "id turn", "'user' role", "CAST(id % 500000 AS STRING) text")
    long = spark.range(0, 100_000, 1, 8).selectExpr("1L conv_id", "id turn", "'bot' role", "CAST(id AS STRING) text")
    rows = render_conversations(none.unionAll(long))
    got = {r.n_turns: r for r in rows.groupBy("n_turns").agg({"copies": "max", "part": "max", "*": "count"}).collect()}
    assert got[1]["count(1)"] == 500_000 and got[1]["max(copies)"] == 2
    assert got[100_000]["count(1)"] == 391 and got[100_000]["max(part)"] == 390
