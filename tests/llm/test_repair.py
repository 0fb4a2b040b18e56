"""Structure repair against enumeration of all edits and a plain dynamic program."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from brackish.llm.structure_repair import Grammar, Rope, damage, finish, learn_rules, pair_counts, repair_conversations

LEGAL = re.compile(r"(s?(ua)+)?\Z")
STOPS = ".!?"


def faults(rows):
    """Per row: blank, duplicate, truncated or None."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in STOPS else None)
        seen.add((role, text))
    return out


def enumerate_repairs(rows, inserts=2):
    """Least (cost, audit, repaired lines) over every edit of every row and every short insert."""
    told = faults(rows)
    gaps = [w for n in range(inserts + 1) for w in product(("user", "assistant"), repeat=n)]
    per_row = []
    for (role, text), fault in zip(rows, told):
        extra = 3 if fault == "truncated" else 0
        ways = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            ways += [(extra, "K", [(role, text)])] + [(3 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
        per_row.append(ways)
    best = None
    for added in product(gaps, repeat=len(rows) + 1):
        for edits in product(*per_row):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                cost, audit = cost + 3 * len(added[k]), audit + "I" * len(added[k])
                lines += [(r, "") for r in added[k]]
                if k < len(rows):
                    cost, audit, lines = cost + edits[k][0], audit + edits[k][1], lines + edits[k][2]
            if (best is None or (cost, audit) < best[:2]) and LEGAL.match("".join(r[:1] or "?" for r, _ in lines)):
                best = (cost, audit, lines)
    return best


def plain_repair(rows):
    """The same by a dynamic program over rows, with whole strings."""
    states = {0: (0, "", [])}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def with_inserts(held):
        out = dict(held)
        for _ in range(2):
            for state, (cost, audit, lines) in list(out.items()):
                role, stop = ("assistant", 3) if state == 2 else ("user", 2)
                put(out, stop, (cost + 3, audit + "I", lines + [(role, "")]))
        return out

    for (role, text), fault in zip(rows, faults(rows)):
        after = {}
        extra = 3 if fault == "truncated" else 0
        for state, (cost, audit, lines) in with_inserts(states).items():
            put(after, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            wanted, stop = ("assistant", 3) if state == 2 else ("user", 2)
            put(after, stop, (cost + 3 + extra, audit + "R", lines + [(wanted, text)]))
            if role[:1] == wanted[0]:
                put(after, stop, (cost + extra, audit + "K", lines + [(role, text)]))
            if state == 0 and role[:1] == "s":
                put(after, 1, (cost + extra, audit + "K", lines + [(role, text)]))
        states = after
    ends = with_inserts(states)
    return min((ends[s] for s in (0, 3) if s in ends), key=lambda w: w[:2])


def record(rows, turns):
    told = faults(rows)
    initials = [r[:1] for r, _ in rows]
    cost, audit, lines = plain_repair(rows)
    known = [t for t in turns if t is not None]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        **{k: told.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    }


def talk(rng, size):
    roles = ["user", "assistant", "system", "tool", "", " ", "User", "ux"]
    return [(rng.choice(roles[: rng.choice((2, 3, 8))]), rng.choice(["Yes.", "No", " ", "", "Why?", "a\n", "b. \t", f"t{rng.random()}."])) for _ in range(size)]


def test_plain_version_is_the_cheapest():
    rng = random.Random(2)
    for _ in range(12):
        rows = talk(rng, rng.randrange(4))
        assert plain_repair(rows)[:2] == enumerate_repairs(rows)[:2]
        assert plain_repair(rows)[2] == enumerate_repairs(rows)[2]


def test_grammar_does_not_change_results():
    rng = random.Random(3)
    for _ in range(60):
        seq = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(1, 80)))
        plain, packed = Grammar([]), Grammar(["ua", "xx", "\ue000\ue000", "\ue002\ue002", "aU"])
        assert len(packed.parse(seq)) <= len(seq)
        a, b = finish(plain.vector(seq)), finish(packed.vector(packed.parse(seq)))
        assert (a[0], str(a[1])) == (b[0], str(b[1]))
        half = len(seq) // 2
        rest = packed.product(packed.parse(seq[half:]))
        row = packed.vector(packed.parse(seq[:half]))
        from brackish.llm.structure_repair import advance

        c = finish(advance(row, rest))
        assert (a[0], str(a[1])) == (c[0], str(c[1]))


def test_ropes():
    rng = random.Random(4)
    leaves = [Rope(rng.choice("DIK") * rng.randrange(1, 20)) for _ in range(5)]
    ropes = leaves + [Rope("")]
    for _ in range(200):
        ropes.append(rng.choice(ropes[-20:]) + rng.choice(ropes[-20:]))
        if ropes[-1].size > 5000:
            ropes.append(rng.choice(leaves))
    for _ in range(500):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (str(a) < str(b))
    whole = Rope("KR" * 8)
    for _ in range(60):  # 2 ** 64 letters
        whole = whole + whole
    assert not whole < whole and (Rope("D") + whole) < (Rope("K") + whole)


def test_pair_counts():
    assert pair_counts("ababa\naaaa\naaa\nb") == {"ab": 2, "ba": 2, "aa": 3}


def test_rules_cover_long_runs(spark):
    seqs = spark.createDataFrame([("ua" * 500,), ("u",), ("xx" * 40,)], "seq string")
    rules = learn_rules(seqs)
    grammar = Grammar(rules)
    assert len(grammar.parse("ua" * 500)) < 40 and rules[0] == "ua"
    assert learn_rules(spark.createDataFrame([], "seq string")) == []


ROWS = "conv_id long, turn long, role string, text string, i long, chunk string, cost int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], ROWS)


def in_order(rows):
    def key(r):
        said = r[2] + r[3]
        return (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{said}".encode()).digest())

    return sorted(rows, key=key)


@pytest.mark.parametrize("chunk_rows", [3, 4096])
def test_conversations(spark, chunk_rows):
    rng = random.Random(6)
    talks = {c: talk(rng, rng.randrange(1, 25)) for c in range(80)}
    talks[None] = talk(rng, 40)
    talks[500] = [("user" if k % 2 else "assistant", f"{k}.") for k in range(900)]
    rows = []
    for conv, said in talks.items():
        turns = [rng.choice([None, *range(len(said))]) for _ in said]
        rows += [(conv, t, r, x) for t, (r, x) in zip(turns, said)]
    got = {r.conv_id: r.asDict() for r in repair_conversations(frame(spark, rows), chunk_rows=chunk_rows).collect()}
    assert set(got) == set(talks)
    for conv in talks:
        own = in_order([r for r in rows if r[0] == conv])
        want = record([(r[2], r[3]) for r in own], [r[1] for r in own])
        assert {k: got[conv][k] for k in want} == want, conv


def test_damage_and_missing_rows(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Good. Yes!", None, "why"])) for c in [*range(60), None] for t in [None, 0, 1, 3]]
    rows += [(c, 0, "user", "One.") for c in range(100, 160)]  # some lose their only row
    damaged = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    logs = frame(spark, rows)
    assert sorted(map(str, damage(logs).collect())) == sorted(map(str, spark.createDataFrame(damaged, "conv_id long, turn long, role string, text string").collect()))
    got = {r.conv_id: r.asDict() for r in repair_conversations(damage(logs), ids=logs).collect()}
    assert set(got) == {r[0] for r in rows}
    none = 0
    for conv, row in got.items():
        own = in_order([r for r in damaged if r[0] == conv])
        none += not own
        want = record([(r[2], r[3]) for r in own], [r[1] for r in own])
        assert {k: row[k] for k in want} == want, conv
    assert none


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (1, 2, "user", ""), (1, 3, "assistant", "Well.")]
    got = repair_conversations(frame(spark, rows), as_rows=True).orderBy("place").collect()
    cost, audit, lines = plain_repair([(r[2], r[3]) for r in rows])
    assert [(r.role, r.text) for r in got] == lines
    assert "".join(r.edit for r in got) == audit.replace("D", "")


def test_empty(spark):
    assert repair_conversations(frame(spark, [])).count() == 0
