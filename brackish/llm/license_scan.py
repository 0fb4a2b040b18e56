"""License scan: template markup compiled to token automata.

A template is license wording over words, with optional regions and replaceable regions:

    copyright <<opt>>c<<end>> <<any>> all rights reserved

`<<alt>>cc by<<or>>creative commons<<end>>` is a mandatory region with several wordings. `<<var a b>>` stands for a to b words of any kind, `<<any>>` for one or more, up to the first place
where the wording after it is complete; what is not marked is mandatory and must match
word for word. The templates are compiled once per task; a text is tried against a template only
if the template's longest mandatory run occurs in it (a substring search), and only from the
places of a possible first word. No shuffle.

Defined results: NULL, empty and wordless texts have no places and no labels, and score 0. Score
is 1 if a template accepts, 0.5 if only base phrases stand in the text, else 0. Rows that repeat a
doc_id are documents of their own. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from brackish.llm.text import documents, rows, words

#: Phrases and the labels of the places where they stand (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording by label. Words are those of the normalised text: lower case, no punctuation.
TEMPLATES = {
    "apache-2.0": "<<opt>>licensed<<end>> <<opt>>released<<end>> under the apache license <<opt>>version 2 0<<end>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "cc-by-4.0": "licensed under <<opt>>a<<end>> <<opt>>the<<end>> <<alt>>creative commons attribution <<opt>>cc by<<end>>"
    "<<or>>cc by<<end>> 4 0 <<opt>>international<<end>>",
    "cc-by-nc-4.0": "licensed under <<opt>>a<<end>> <<opt>>the<<end>> <<alt>>creative commons attribution noncommercial "
    "<<opt>>cc by nc<<end>><<or>>cc by nc<<end>> 4 0 <<opt>>international<<end>>",
    "copyright": "copyright <<opt>>c<<end>> <<any>> all rights reserved",
    "gpl-3.0": "<<opt>>licensed<<end>> <<opt>>released<<end>> under the gnu general public license version 3",
    "gpl-any": "under the terms of the gnu general public license as published by the free software foundation "
    "<<opt>>either<<end>> version <<var 1 1>> <<opt>>of the license<<end>>",
    "mit": "<<opt>>licensed<<end>> <<opt>>released<<end>> under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "<<opt>>and associated documentation files the software<<end>> to deal in <<opt>>the<<end>> <<var 1 2>> "
    "without restriction",
    "spdx-apache-2.0": "spdx license identifier apache 2 0",
    "spdx-bsd": "spdx license identifier bsd <<alt>>2<<or>>3<<end>> clause",
    "spdx-cc-by-4.0": "spdx license identifier cc by 4 0",
    "spdx-gpl-3.0": "spdx license identifier gpl 3 0 <<alt>>only<<or>>or later<<end>>",
    "spdx-mit": "spdx license identifier mit",
}

_MARK = re.compile(r"<<opt>>|<<alt>>|<<or>>|<<end>>|<<any>>|<<var (\d+) (\d+)>>|[^\s<]+")


@dataclass(frozen=True)
class Automaton:
    """States 0..final. `steps[s]`: (word, or None for any word, next state); `skips[s]`: free moves."""

    label: str
    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    skips: tuple[frozenset[int], ...]
    final: int
    anchor: bytes
    open: frozenset[int] = frozenset()

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for to in self.skips[todo.pop()] - out:
                out.add(to)
                todo.append(to)
        return out

    def match(self, text: list[bytes], start: int) -> int | None:
        """End of the longest accepted wording that begins at `start`; once one is accepted, no
        region without a bound goes on."""
        states, end, at = self.closure({0}), None, start
        while states:
            if self.final in states and at > start:
                end = at
                states = states - self.open
            if at == len(text):
                break
            word = text[at]
            states = self.closure({to for s in states for w, to in self.steps[s] if w is None or w == word})
            at += 1
        return end


def compile_template(label: str, template: str) -> Automaton:
    steps: list[list[tuple[bytes | None, int]]] = [[]]
    skips: list[set[int]] = [set()]

    def step(word: bytes | None) -> int:
        steps[-1].append((word, len(steps)))
        steps.append([])
        skips.append(set())
        return len(steps) - 1

    opened: list[tuple[str, int, list[int]]] = []  # mark, state before the region, ends of its earlier wordings
    loops: set[int] = set()
    run: list[str] = []
    longest: list[str] = []
    for m in _MARK.finditer(template):
        mark = m.group()
        if mark.startswith("<<"):
            run = []
        if mark in ("<<opt>>", "<<alt>>"):
            opened.append((mark, len(steps) - 1, []))
        elif mark == "<<or>>":
            if not opened or opened[-1][0] != "<<alt>>":
                raise ValueError(f"template {label}: an alternative outside of its region")
            _, start, ends = opened[-1]
            ends.append(len(steps) - 1)
            steps.append([])
            skips.append(set())
            skips[start].add(len(steps) - 1)
        elif mark == "<<end>>":
            if not opened:
                raise ValueError(f"template {label}: a region ends that has not begun")
            kind, start, ends = opened.pop()
            for place in [start] if kind == "<<opt>>" else ends:
                skips[place].add(len(steps) - 1)
        elif m.group(1) is not None:
            least, most = int(m.group(1)), int(m.group(2))
            places = [len(steps) - 1, *(step(None) for _ in range(most))]
            for place in places[least:-1]:
                skips[place].add(places[-1])
        elif mark == "<<any>>":
            place = step(None)
            steps[place].append((None, place))
            loops.add(place)
        else:
            step(mark.encode())
            if not opened:
                run.append(mark)
                longest = max(longest, run, key=len).copy()
    if opened:
        raise ValueError(f"template {label}: a region is not closed")
    if not longest:
        raise ValueError(f"template {label}: no mandatory word")
    return Automaton(
        label,
        tuple(map(tuple, steps)),
        tuple(map(frozenset, skips)),
        len(steps) - 1,
        f" {' '.join(longest)} ".encode(),
        frozenset(loops - {len(steps) - 1}),
    )


class Scanner:
    def __init__(self, base: Mapping[str, str], templates: Mapping[str, str]):
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base.items()]
        self.automata = [compile_template(label, text) for label, text in templates.items()]
        for a in self.automata:
            if a.final in a.closure({0}):
                raise ValueError(f"template {a.label}: it accepts an empty text")

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], list[tuple[str, int, int]]]:
        """Number of words, base starts, base labels, accepted (label, first word, end)."""
        split = words(text)
        line = b" " + b" ".join(split) + b" "
        starts, labels = [], set()
        for phrase, label in self.base:
            at, word, told = line.find(phrase), 0, 0
            while at >= 0:
                word += line.count(b" ", told, at)  # each stretch of the text is counted once
                told = at
                starts.append(word)
                labels.add(label)
                at = line.find(phrase, at + 1)
        accepted = []
        for a in self.automata:
            if a.anchor in line:
                first = {w for s in a.closure({0}) for w, _ in a.steps[s]}
                # what is mandatory cannot follow a later start
                last = line.count(b" ", 0, line.rfind(a.anchor))
                end = 0
                for at, word in enumerate(split[: last + 1]):
                    if at >= end and (word in first or None in first) and (stop := a.match(split, at)):
                        accepted.append((a.label, at, stop))
                        end = stop
        return len(split), starts, labels, accepted


_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "accepted array<struct<label:string, first:int, end:int>>"
)
_ACCEPTED = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    base: Mapping[str, str] = BASE,
    templates: Mapping[str, str] = TEMPLATES,
) -> DataFrame:
    """Per document: the base places and labels, all labels, the score and the accepted wordings."""
    Scanner(base, templates)  # a bad template is an error here, not in a task

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for batch in rows(batches):
            found = [scanner.scan(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _, _, _ in found], pa.int64()),
                    pa.array([len(s) for _, s, _, _ in found], pa.int64()),
                    pa.array([min(s, default=None) for _, s, _, _ in found], pa.int64()),
                    pa.array([max(s, default=None) for _, s, _, _ in found], pa.int64()),
                    pa.array([",".join(sorted(b)) for _, _, b, _ in found], pa.string()),
                    pa.array([",".join(sorted(b | {x[0] for x in a})) for _, _, b, a in found], pa.string()),
                    pa.array([1.0 if a else 0.5 if s else 0.0 for _, s, _, a in found], pa.float64()),
                    pa.array([[{"label": x, "first": i, "end": j} for x, i, j in a] for _, _, _, a in found], _ACCEPTED),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "accepted"],
            )

    texts = documents(docs, key, text)
    return texts.mapInArrow(scan, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def template_regex(template: str) -> str:
    """The template as a regular expression over words that are each followed by one blank."""
    out, closing = [], []
    for m in _MARK.finditer(template):
        mark = m.group()
        if mark in ("<<opt>>", "<<alt>>"):
            out.append("(?:")
            closing.append(")?" if mark == "<<opt>>" else ")")
        elif mark == "<<or>>":
            out.append("|")
        elif mark == "<<end>>":
            out.append(closing.pop())
        elif m.group(1) is not None:
            out.append(f"(?:[^ ]+ ){{{m.group(1)},{m.group(2)}}}")
        elif mark == "<<any>>":
            out.append("(?:[^ ]+ )+")
        else:
            out.append(re.escape(mark) + " ")
    return " " + "".join(out)
