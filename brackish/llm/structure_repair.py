"""Cheapest repair of a conversation's structure, by dynamic programming over a grammar.

Every row becomes one of nine symbols: a row that must go (blank, or a repeat), or its role's class,
complete or truncated. A repair edits the rows so that their roles read `(s?(ua)+)?`, an automaton of
four states. An edit of one row is a 4 x 4 min-plus matrix of (cost, audit): from state to state at
the least cost, and of equally cheap ways the one whose edit letters are least. Matrices multiply, so
a conversation is cut into chunks of CHUNK rows that are worked on apart.

Re-Pair names the most frequent pair of neighbouring symbols again and again, over the distinct
chunks of the whole table: Spark counts the pairs, the driver picks a few that cannot overlap. Each
rule has one matrix, the product of its two symbols' matrices, computed once per task from the
bottom up. Its audits are ropes, which share their halves and are written out once per chunk. A
chunk is then the product of few rules, and is evaluated once however many conversations hold it.
Rules only save work: any grammar gives the same result, so their number is bounded (RULES).

Rows are put in order over range partitions, so a conversation that is a third of the table is many
tasks; repeats are found by an aggregate over (conversation, digest); a chunk has at most CHUNK
entries without texts. Only the last step streams a conversation's rows in order through one task, a
batch at a time, since its result is one digest of them; texts are shuffled there and nowhere else.
An audit, a letter a row, is one value.

Defined results: a NULL role, text, conv_id or turn is written as one space; rows stand in the order
of turn (NULL first), then role, then digest. NULL conv_id is a conversation of its own. A turn is a
whole number. A role with another initial than s, u or a, or with none, cannot be kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.llm.text import rows
from brackish.operators.keys import attach, join_on
from brackish.operators.ordered import with_row_index
from brackish.session import settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Rows of a chunk, rounds of pair counting, and rules in all.
CHUNK = 4096
ROUNDS = 6
RULES = 256
_FIRST_RULE = 0xE000

#: States: nothing yet, after "s", after "u", after "a". The first and the last may end.
STATES = range(4)
_USER, _ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}
_LEGAL = frozenset(("su", "ua", "au"))


class Rope:
    """Text as a tree whose halves may be shared."""

    __slots__ = ("size", "text", "left", "right")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if text is not None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not self.size:
            return other
        if not other.size:
            return self
        if self.size + other.size <= 16:
            return Rope(str(self) + str(other))
        return Rope(None, self, other)

    def __str__(self) -> str:
        if self.text is not None:
            return self.text
        parts, open_ = [], [self]
        while open_:
            node = open_.pop()
            if node.text is None:
                open_ += (node.right, node.left)
            else:
                parts.append(node.text)
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        """Whether this text is less. Halves that both share at the same place are not read."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y:
                continue
            if x.text is None and x.size >= y.size:
                a += (x.right, x.left)
                b.append(y)
            elif y.text is None:
                b += (y.right, y.left)
                a.append(x)
            elif x.text is None:
                a += (x.right, x.left)
                b.append(y)
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.size > n:
                    a.append(Rope(x.text[n:]))
                if y.size > n:
                    b.append(Rope(y.text[n:]))
        return bool(b) and not a


Way = tuple[int, Rope]
Matrix = list[dict[int, Way]]  # per state from which it starts: state it reaches -> way


def _put(row: dict[int, Way], state: int, cost: int, audit: Rope) -> None:
    held = row.get(state)
    if held is None or cost < held[0] or (cost == held[0] and audit < held[1]):
        row[state] = (cost, audit)


def advance(row: dict[int, Way], matrix: Matrix) -> dict[int, Way]:
    """A vector of ways, carried through a matrix."""
    out: dict[int, Way] = {}
    for middle, (cost, audit) in row.items():
        for state, (more, tail) in matrix[middle].items():
            total = cost + more
            held = out.get(state)
            if held is None or total < held[0]:
                out[state] = (total, audit + tail)
            elif total == held[0]:
                _put(out, state, total, audit + tail)
    return out


def compose(first: Matrix, second: Matrix) -> Matrix:
    return [advance(row, second) for row in first]


def _inserts() -> Matrix:
    """Rows inserted in a row: going round twice is never cheapest."""
    out: Matrix = []
    for start in STATES:
        row, state, cost, audit = {start: (0, Rope(""))}, start, 0, ""
        while (state := (_USER | _ASSISTANT)[state]) not in row:
            cost, audit = cost + INSERT, audit + "I"
            row[state] = (cost, Rope(audit))
        out.append(row)
    return out


def _edits(symbol: str) -> Matrix:
    """Edits of one row, without inserts."""
    out: Matrix = [{state: (DELETE, Rope("D"))} for state in STATES]
    if symbol == "x":
        return out
    extra = TRUNCATED if symbol.isupper() else 0
    kept = {"s": {0: 1}, "u": _USER, "a": _ASSISTANT}.get(symbol.lower(), {})
    for moves, cost, letter in ((kept, KEEP, "K"), (_USER, REROLE, "R"), (_ASSISTANT, REROLE, "R")):
        for start, stop in moves.items():
            _put(out[start], stop, cost + extra, Rope(letter))
    return out


INSERTS = _inserts()
SYMBOLS = "xsuaoSUAO"
START: dict[int, Way] = {0: (0, Rope(""))}


def finish(row: dict[int, Way]) -> Way:
    """The cheapest way to end."""
    last: dict[int, Way] = {}
    for state, (cost, audit) in advance(row, INSERTS).items():
        if state in (0, 3):
            _put(last, 0, cost, audit)
    return last[0]


class Grammar:
    """Re-Pair rules, in the order in which they were made, and their matrices."""

    def __init__(self, rules: Sequence[str]):
        self.rules = list(rules)
        self.matrix = {s: compose(INSERTS, _edits(s)) for s in SYMBOLS}
        for k, pair in enumerate(self.rules):
            self.matrix[chr(_FIRST_RULE + k)] = compose(self.matrix[pair[0]], self.matrix[pair[1]])

    def parse(self, text: str) -> str:
        for k, pair in enumerate(self.rules):
            text = text.replace(pair, chr(_FIRST_RULE + k))
        return text

    def vector(self, parsed: str) -> dict[int, Way]:
        row = START
        for symbol in parsed:
            row = advance(row, self.matrix[symbol])
        return row

    def product(self, parsed: str) -> Matrix:
        matrix: Matrix = [{state: (0, Rope(""))} for state in STATES]
        for symbol in parsed:
            matrix = compose(matrix, self.matrix[symbol])
        return matrix


def pair_counts(text: str) -> dict[str, int]:
    """Neighbouring symbols of each line; in a run of one symbol every other pair counts."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    a, b = codes[:-1], codes[1:]
    at = np.arange(len(a))
    since = np.maximum.accumulate(np.where(a != b, at, -1)) if len(a) else at
    good = (a != 10) & (b != 10) & ((a != b) | ((at - since) % 2 == 1))
    keys, n = np.unique(a[good] << 32 | b[good], return_counts=True)
    return {chr(k >> 32) + chr(k & 0xFFFFFFFF): c for k, c in zip(keys.tolist(), n.tolist())}


def _count(batches: Iterator[pa.RecordBatch], rules: Sequence[str]) -> Iterator[pa.RecordBatch]:
    grammar = Grammar(rules)
    for batch in rows(batches, 4096):
        found = pair_counts(grammar.parse("\n".join(batch.column("seq").to_pylist())))
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def learn_rules(seqs: DataFrame, rounds: int = ROUNDS, most: int = RULES) -> list[str]:
    """Re-Pair over the column `seq`: in each round the most frequent pairs that cannot overlap."""
    rules: list[str] = []
    for _ in range(rounds):
        counts = seqs.mapInArrow(partial(_count, rules=tuple(rules)), "pair string, n long")
        top = counts.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(64).collect()
        lefts: set[str] = set()
        rights: set[str] = set()
        found = []
        for pair in (r.pair for r in top):
            # an occurrence of another rule may end or begin inside of this pair
            if pair[0] in rights or pair[1] in lefts:
                continue
            lefts.add(pair[0])
            rights.add(pair[1])
            found.append(pair)
        rules += found[: most - len(rules)]
        if not found or len(rules) >= most:
            break
    return rules


_WAYS = "array<struct<start: int, stop: int, cost: long, audit: string>>"
_WAYS_ARROW = pa.list_(
    pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
)


def _evaluate(batches: Iterator[pa.RecordBatch], rules: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Per distinct chunk: its ways from the first state or, where a later chunk needs them, from all."""
    grammar = Grammar(rules)
    for batch in rows(batches):
        seqs = batch.column("seq").to_pylist()
        ways = []
        for parsed, later in zip(grammar.parse("\n".join(seqs)).split("\n"), batch.column("later").to_pylist()):
            matrix = grammar.product(parsed) if later else [grammar.vector(parsed)]
            ways.append(
                [
                    {"start": start, "stop": stop, "cost": cost, "audit": str(audit)}
                    for start, row in enumerate(matrix)
                    for stop, (cost, audit) in row.items()
                ]
            )
        yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(ways, _WAYS_ARROW)], ["seq", "ways"])


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its chunks, which come one after the other in order."""
    conv, open_ = None, False
    row: dict[int, Way] = START
    counts = dict.fromkeys(_COUNTS, 0)
    turns, low, high, role = 0, None, None, ""

    def close() -> dict:
        cost, audit = finish(row)
        gaps = 0 if low is None else high - low + 1 - turns
        return {**counts, "conv_id": conv, "gaps": gaps, "cost": cost, "audit": str(audit)}

    for batch in rows(batches):
        done = []
        for chunk in batch.to_pylist():
            if not open_ or chunk["chunk"] == 0:
                if open_:
                    done.append(close())
                conv, open_, row = chunk["conv_id"], True, START
                counts = dict.fromkeys(_COUNTS, 0)
                turns, low, high, role = 0, None, None, ""
            for name in ("blank", "duplicate", "truncated"):
                counts[name] += chunk[name]
            read = role + chunk["roles"]
            counts["illegal"] += sum(a + b not in _LEGAL for a, b in zip(read, read[1:]))
            role = read[-1]
            if chunk["low"] is not None:
                turns += chunk["turns"] - (high == chunk["low"])
                low, high = chunk["low"] if low is None else low, chunk["high"]
            matrix: Matrix = [{} for _ in STATES]
            for way in chunk["ways"]:
                matrix[way["start"]][way["stop"]] = (way["cost"], Rope(way["audit"]))
            row = advance(row, matrix)
        yield _as_batch(done, batch)
    if open_:
        yield _as_batch([close()], batch)


def _as_batch(done: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
    arrays = [pa.array([d["conv_id"] for d in done], like.schema.field("conv_id").type)]
    arrays += [pa.array([d[c] for d in done], pa.int64()) for c in _COUNTS]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([d["audit"] for d in done], pa.string())], ["conv_id", *_COUNTS, "audit"])


def _plain(logs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return logs.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), *said)


def damage(
    logs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows with planted faults, by crc32 of `conv:turn` modulo 20: 0 drops a row, 1 empties its text,
    2 removes its stops, 3 repeats it, 4 sets its role to user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.crc32(key.cast("binary")) % 20
    plain = logs.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
        kind.alias("_kind"),
    )
    k = F.col("_kind")
    return plain.where(k != 0).select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


_ORDER = ("turn", "role", "digest")


def find_repairs(
    logs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK
) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    slim = _plain(logs, conv, turn, role, text).select(
        "conv_id",
        "turn",
        "role",
        _digest().alias("digest"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
    )
    placed = with_row_index(slim, ["conv_id"], list(_ORDER), "i")
    repeated = placed.groupBy("conv_id", "digest").agg(F.min("i").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = attach(placed, repeated, ["conv_id", "digest"])
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    dup = F.coalesce(F.col("i") > F.col("first"), F.lit(False))
    gone = F.col("blank") | dup
    symbols = told.select(
        "conv_id",
        "i",
        "turn",
        kind.alias("kind"),
        F.when(gone, "x").when(F.col("open"), F.upper(kind)).otherwise(kind).alias("symbol"),
        F.col("blank"),
        (~F.col("blank") & dup).alias("duplicate"),
        (~gone & F.col("open")).alias("truncated"),
    )
    row = F.struct("i", "kind", "symbol", "turn")
    chunked = symbols.groupBy("conv_id", F.floor(F.col("i") / chunk_rows).alias("chunk")).agg(
        F.sort_array(F.collect_list(row)).alias("rows"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    chunks = settle(
        chunked.select(
            "conv_id",
            "chunk",
            F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("seq"),
            F.array_join(F.transform("rows", lambda r: r["kind"]), "").alias("roles"),
            "blank",
            "duplicate",
            "truncated",
            F.size(F.array_distinct(turns)).alias("turns"),
            F.array_min(turns).alias("low"),
            F.array_max(turns).alias("high"),
        ),
        "chunks",
    )
    seqs = settle(chunks.groupBy("seq").agg(F.max(F.col("chunk") > 0).alias("later")), "sequences")
    rules = tuple(learn_rules(seqs))
    ways = seqs.mapInArrow(partial(_evaluate, rules=rules), f"seq string, ways {_WAYS}")
    joined = attach(chunks, ways, ["seq"]).drop("seq")
    ordered = joined.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    id_type = slim.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_combine, f"conv_id {id_type}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")


def _apply(batches: Iterator[pa.RecordBatch], as_rows: bool) -> Iterator[pa.RecordBatch]:
    """Streams each conversation: first its audit, then its rows in order."""
    conv = counts = audit = hasher = None
    at = state = place = 0

    def say(edit: str, turn, role: str, text: str) -> None:
        nonlocal place
        if as_rows:
            out.append((conv, place, edit, turn, role, text))
        else:
            hasher.update(("\n" if place else "").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        place += 1

    def forced() -> str:
        """The role that the grammar asks for now."""
        nonlocal state
        state = (_USER | _ASSISTANT)[state]
        return "user" if state == 2 else "assistant"

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            say("I", None, forced(), "")

    def close() -> None:
        insert()
        if not as_rows:
            out.append((conv, *counts, audit, hasher.hexdigest()))

    like = None
    for batch in rows(batches):
        like = batch
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "tag", "turn", "role", "text", "audit", *_COUNTS)]
        for who, tag, turn, role, text, new_audit, *new_counts in zip(*columns):
            if tag == 0:
                if audit is not None:
                    close()
                conv, counts, audit, hasher = who, new_counts, new_audit, hashlib.sha256()
                at = state = place = 0
                continue
            insert()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                say("K", turn, role, text)
            elif edit == "R":
                say("R", turn, forced(), text)
        yield _written(out, batch, as_rows)
    if audit is not None:
        out = []
        close()
        yield _written(out, like, as_rows)


def _written(out: list[tuple], like: pa.RecordBatch, as_rows: bool) -> pa.RecordBatch:
    first = like.schema.field("conv_id").type
    if as_rows:
        names, kinds = ["conv_id", "place", "edit", "turn", "role", "text"], [first, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    else:
        names, kinds = ["conv_id", *_COUNTS, "audit", "repaired_sha256"], [first, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names)


def repair_conversations(
    logs: DataFrame,
    ids: DataFrame | None = None,
    as_rows: bool = False,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk_rows: int = CHUNK,
) -> DataFrame:
    """Per conversation the counts and audit of `find_repairs` and repaired_sha256, or with `as_rows`
    the repaired rows: conv_id, place, edit (K, R or I), turn, role, text.

    `ids` is a table whose conv_ids come back even if `logs` has no row for them.
    """
    found = settle(find_repairs(logs, conv, turn, role, text, chunk_rows), "repairs")
    if ids is not None:
        asked = ids.select(F.col(f"`{conv}`").alias("conv_id")).distinct()
        found = join_on(asked, found, ["conv_id"], "left").fillna(0, list(_COUNTS)).fillna("", ["audit"])
    spoken = _plain(logs, conv, turn, role, text).withColumn("digest", _digest()).withColumn("tag", F.lit(1))
    both = spoken.unionByName(found.withColumn("tag", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "tag", *_ORDER)
    first = f"conv_id {spoken.schema['conv_id'].dataType.simpleString()}"
    if as_rows:
        schema = f"{first}, place long, edit string, turn long, role string, text string"
    else:
        schema = f"{first}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return ordered.mapInArrow(partial(_apply, as_rows=as_rows), schema)
