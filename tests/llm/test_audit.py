"""Filter interaction audit against a plain replay of every order."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from brackish.llm.filter_audit import FilterAudit, audit_filters

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(120))

DOCS = [
    (1, LONG, "en"),
    (2, LONG, "de"),  # repeats 1
    (2, LONG, "de"),
    (3, "short", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, "A B C $", "en"),
    (7, "word " * 150, "de"),
    (8, LONG + " #", "en"),
    (9, LONG.upper(), "fr"),
    (None, LONG, "en"),
    (10, "short", "fr"),
    (11, "x\x0by\u00a0z " * 40_000, "fr"),
    (12, "é" * 300, None),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (6, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1)]


def failed(docs):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, part in docs:
        text = text or ""
        words = WORDS.findall(text)
        names = set()
        if len(words) < 100:
            names.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            names.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            names.add("C")
        if any(c in "#$%&*|" for c in text):
            names.add("D")
        if i is not None and i > least[text]:
            names.add("E")
        out.append((i, part or "", names))
    return out


def replay(docs, labels):
    marks = [(i, part, names, {k for k in (1, 2) for lab in labels if i is not None and lab[0] == i and lab[k] == 1})
             for i, part, names in failed(docs)]
    rows, shares = {}, Counter()
    for part in {m[1] for m in marks}:
        own = [m for m in marks if m[1] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [m for m in left if name in m[2]]
                left = [m for m in left if name not in m[2]]
                failing = [m for m in own if name in m[2]]
                shares[part, name] += len(gone)
                rows[part, "".join(order), step] = (
                    len(left), len(gone), len(failing) - len(gone), sum(m[2] == {name} for m in own),
                    sum(1 in m[3] for m in gone), sum(2 in m[3] for m in gone),
                )
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def frames(spark, docs, labels):
    # columns with the operator's own names must not disturb it
    return (
        spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, lang string, row int, words string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_every_order(spark):
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in audit_filters(*frames(spark, DOCS, LABELS)).collect()}
    assert got == replay(DOCS, LABELS)
    assert len(got) == 600 * 4


def test_empty_tables(spark):
    assert audit_filters(*frames(spark, [], [])).count() == 0
    got = audit_filters(*frames(spark, [(None, None, None)], [])).where("step = 5").collect()
    assert len(got) == 120 and all(r.kept == 0 and r.toxic_lost == 0 for r in got)


def test_relations_of_a_prefix(spark):
    audit = FilterAudit.build(*frames(spark, DOCS, LABELS))
    names = [n for _, _, n in failed(DOCS)]
    assert audit.survivors("AC").count() == sum(not n & {"A", "C"} for n in names)
    assert audit.removed("AC", "E").count() == sum("E" in n and not n & {"A", "C"} for n in names)
    assert audit.redundant("AC", "E").count() == sum("E" in n and bool(n & {"A", "C"}) for n in names)
    assert audit.removed("", "B").count() == sum("B" in n for n in names)


def test_own_filters(spark):
    audit = FilterAudit.build(*frames(spark, DOCS, LABELS), filters={"x": "n_words > 100", "y": None, "z": "text = NULL"})
    rows = audit.table().where("part = 'en'").collect()
    assert len(rows) == 18
    assert {r.shapley for r in rows if r.filter_order[r.step - 1] == "z"} == {0}
