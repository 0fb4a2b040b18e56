"""Chat formatting after collapsing cumulative snapshots.

A logger that writes a conversation after each turn leaves many prefixes of the same talk. Every
turn gets the rolling hash of the talk up to it: the exclusive-or of 128-bit hashes of (position,
turn digest). A conversation whose whole hash is the hash before some later turn of another one is a
prefix of it and goes, by an anti-join; of equal conversations the smallest conv_id stays. Only the
retained ones are rendered, so text moves once, and the hashes are made from 24 bytes a turn.

No group holds a conversation. Positions come from a range partition on (conversation, turn), the
rolling hash runs over chunks of `CHUNK` turns and takes over the chunks before it by one more
exclusive-or, and rendered text leaves in parts of `PART` turns. Equal conversations, shared openings
and repeated rows are combined map-side.

Defined results: turns stand in the order of turn (NULL first), then of their digest. NULL role or
text is empty. Rows that repeat a turn exactly count once. A row with a NULL conv_id belongs to no
conversation: it is a talk of one turn, whatever its turn says, and NULL comes last among ties. A
marker inside a text gets a blank after its "<|", so that it cannot open or close a turn. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.operators.keys import join_on
from brackish.operators.ordered import with_row_index
from brackish.session import settle

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation that one window hashes, and that one rendered row holds.
CHUNK = 4_096
PART = 256

#: A conversation's key: its id, and for rows without one the digest of their only turn.
_TALK = ["conv_id", "lone"]


def _turn_digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _turns(logs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    plain = logs.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.when(F.col(f"`{conv}`").isNotNull(), F.col(f"`{turn}`")).alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    ).withColumn("digest", _turn_digest())
    return plain.withColumn("lone", F.when(F.col("conv_id").isNull(), F.col("digest")))


def _half(hashed: Column, at: int) -> Column:
    """Sixteen hexadecimal digits as a long."""
    return F.conv(F.substring(hashed, at, 16), 16, -10).cast("long")


def rolling_hashes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distinct turns with their position `at` and the hash of the talk up to them (`a`, `b`).

    `x` and `y` are the turn's own share of the hash: without it, it is the hash before the turn.
    """
    distinct = turns.groupBy(*_TALK, "turn", "digest").agg(F.count(F.lit(1)).alias("n_rows"))
    placed = with_row_index(distinct, _TALK, ["turn", "digest"], "at")
    own = F.md5(F.concat(F.col("at").cast("string").cast("binary"), F.lit(b":"), "digest"))
    shares = settle(
        placed.withColumn("_own", own)
        .withColumns({"x": _half(F.col("_own"), 1), "y": _half(F.col("_own"), 17), "_chunk": F.floor(F.col("at") / chunk)})
        .drop("_own"),
        "turn-hashes",
    )
    earlier = Window.partitionBy(*_TALK).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations of more than one chunk have something to take over
    long_talks = shares.where(F.col("at") == chunk).select(*_TALK)
    carried = (
        join_on(shares, settle(long_talks, "long-talks"), _TALK, "left_semi")
        .groupBy(*_TALK, "_chunk")
        .agg(F.bit_xor("x").alias("_x"), F.bit_xor("y").alias("_y"))
        .select(*_TALK, "_chunk", *[F.bit_xor(c).over(earlier).alias(f"_before{c}") for c in ("_x", "_y")])
        .where(F.col("_chunk") > 0)
    )
    within = Window.partitionBy(*_TALK, "_chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    local = shares.withColumns({"_a": F.bit_xor("x").over(within), "_b": F.bit_xor("y").over(within)})
    joined = join_on(local, settle(carried, "carried-hashes"), [*_TALK, "_chunk"], "left")
    return joined.select(
        *_TALK, "turn", "digest", "at", "n_rows", "x", "y",
        F.col("_a").bitwiseXOR(F.coalesce("_before_x", F.lit(0))).alias("a"),
        F.col("_b").bitwiseXOR(F.coalesce("_before_y", F.lit(0))).alias("b"),
    )


def _maximal(hashes: DataFrame) -> DataFrame:
    """Keys of the retained conversations, n_turns, copies."""
    talks = hashes.groupBy(*_TALK).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.max_by(F.struct("a", "b"), "at").alias("last"),
        F.when(F.col("conv_id").isNull(), F.sum("n_rows")).otherwise(F.lit(1)).alias("_copies"),
    )
    order = F.struct(F.col("conv_id").isNull().alias("none"), *_TALK)
    equal = talks.groupBy("n_turns", "last.a", "last.b").agg(F.min(order).alias("first"), F.sum("_copies").alias("copies"))
    before = hashes.where(F.col("at") > 0).select(
        F.col("at").alias("n_turns"), *[F.col(c).bitwiseXOR(F.col(own)).alias(c) for c, own in (("a", "x"), ("b", "y"))]
    )
    kept = equal.join(before.distinct(), ["n_turns", "a", "b"], "left_anti")
    return kept.select(*[F.col(f"first.{c}").alias(c) for c in _TALK], "n_turns", "copies")


def maximal_conversations(
    logs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """The retained conversations: conv_id, n_turns, copies (equal ones, itself included)."""
    hashes = settle(rolling_hashes(_turns(logs, conv, turn, role, text), chunk), "rolling-hashes")
    return _maximal(hashes).drop("lone")


def render_conversations(
    logs: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk: int = CHUNK,
    part: int = PART,
) -> DataFrame:
    """Per retained conversation and part of it: conv_id, part (from 0), n_turns, copies, rendered.

    The parts of a conversation, joined in order, are its rendered text.
    """
    turns = _turns(logs, conv, turn, role, text)
    hashes = settle(rolling_hashes(turns, chunk), "rolling-hashes")
    kept = settle(_maximal(hashes), "maximal")
    places = join_on(hashes.select(*_TALK, "turn", "digest", "at"), kept, _TALK, "inner")
    found = join_on(turns, settle(places, "places"), [*_TALK, "turn", "digest"], "inner")
    once = found.dropDuplicates([*_TALK, "at"])
    parts = once.groupBy(*_TALK, F.floor(F.col("at") / part).alias("part"), "n_turns", "copies").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns")
    )

    def safe(said: Column) -> Column:
        return F.replace(said, F.lit("<|im_"), F.lit("<| im_"))

    one = F.transform(
        "turns", lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(f"{CLOSE}\n"))
    )
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(one, "").alias("rendered"))
