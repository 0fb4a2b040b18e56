"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from brackish.llm.bagminhash import overlap  # noqa: F401  (re-exported for tests)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def bare(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_groups(docs: list[tuple[int | None, str | None]]) -> dict[str, list[tuple[int | None, str | None]]]:
    groups = defaultdict(list)
    for doc in docs:
        groups[bare(doc[1])].append(doc)
    return groups


def best_of(group: list[tuple[int | None, str | None]]) -> tuple[int | None, str | None]:
    return min(group, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0))


def shingles(text: str | None) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_classes(docs: list[tuple[int, str | None]], least: int = 4, of: int = 5) -> dict[int, int]:
    """doc_id -> smallest doc_id it is linked to, through any number of links of similarity 0.8."""
    bags = {i: shingles(t) for i, t in docs}
    at = defaultdict(list)
    for i, bag in bags.items():
        for s in bag:
            at[s].append(i)
    root = {i: i for i in bags}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in bags:
        for b in {x for s in bags[a] for x in at[s] if x < a}:
            both = sum((bags[a] & bags[b]).values())
            if of * both >= least * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in bags}


def contamination(text: str | None, items: list[tuple[object, str | None]], window: int = 13) -> tuple[int, int, set[str]]:
    w = words(text)
    hit, names = set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add("null" if name is None else str(name))
    return len(w), len(hit), names


def line_key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def line_dedup(docs: list[str | None], least: int = 10) -> list[tuple[int, int, str]]:
    found = Counter(k for t in docs for k in {line_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[line_key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
