"""Exact dedup by deterministic block naming.

Each text, without its blanks, is cut into blocks of a fixed size. Equal blocks get the same
integer name: blocks are routed by hash, sorted, and numbered in sorted order. Adjacent names are
then paired, the pairs are named in the same way, and so on until one name is left for each
document. Documents with as many rounds and the same last name have equal texts, without trusting
any hash: routing decides only where blocks are compared.

A task names its own repeated blocks first, so the text of a block leaves a task once however many
copies it has there, and a group of copies that is a third of the table sends one block per task.
Names are written to the scratch folder before they are used, so a lost executor cannot renumber
them.

Defined results: a NULL text is an empty one; all empty texts are equal. Rows that repeat a doc_id
are rows of their own, and of fully tied rows exactly one stays. A NULL doc_id comes last among
ties. Columns other than the key and the text are carried along untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackish.llm.text import BLANKS, rows, utf8
from brackish.session import recording, remove_unread, settle

#: Bytes of a block, and of distinct blocks that a task remembers at most.
BLOCK = 4096
REMEMBERED = 64 << 20


def _blocks(text: bytes, size: int) -> list[bytes]:
    bare = text.translate(None, BLANKS)
    return [bare[i : i + size] for i in range(0, len(bare), size)] or [b""]


def _cut(batches: Iterator[pa.RecordBatch], size: int, remembered: int) -> Iterator[pa.RecordBatch]:
    """Per row: its blocks' task-local names, and which of them are the first with that name."""
    base = TaskContext.get().partitionId() << 40
    row = local = held = 0
    seen: dict[bytes, int] = {}
    for batch in rows(batches):
        ids, points, digests, names, fresh = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            own, new = [], []
            for at, block in enumerate(_blocks(text, size)):
                name = seen.get(block)
                if name is None:
                    if held > remembered:
                        seen, held = {}, 0
                    name = seen[block] = base + local
                    local += 1
                    held += len(block) + 100
                    new.append(at)
                own.append(name)
            ids.append(base + row)
            row += 1
            points.append(len(text.decode("utf-8", "replace")))
            digests.append(hashlib.sha256(text.translate(None, BLANKS)).hexdigest())
            names.append(own)
            fresh.append(new)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                batch.column("row"),
                pa.array(points, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(names, pa.list_(pa.int64())),
                pa.array(fresh, pa.list_(pa.int32())),
            ],
            ["rid", "row", "points", "text_sha256", "names", "fresh"],
        )


def _spell(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The text of each block that is the first with its task-local name."""
    for batch in rows(batches, 64):
        local, spelled = [], []
        columns = (batch.column(c).to_pylist() for c in ("text", "names", "fresh"))
        for text, names, fresh in zip(*columns):
            blocks = _blocks(text, size)
            local += [names[i] for i in fresh]
            spelled += [blocks[i] for i in fresh]
        yield pa.RecordBatch.from_arrays(
            [pa.array(local, pa.int64()), pa.array(spelled, pa.binary())], ["local", "block"]
        )


def _number(df: DataFrame, *key: str) -> DataFrame:
    """Equal keys get the same integer `name`, in sorted order within their partition."""
    numbered = df.sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id())
    return numbered.withColumn("name", F.min("at").over(Window.partitionBy(*key))).drop("at")


def _identify(docs: DataFrame, key: str, text: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The cut table, and per row of it ``(rid, level, name)``: the identity of its text."""
    # nullable fields only: what comes back from Arrow carries no promise of non-NULL values
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), utf8(text).alias("text"))
    schema = f"rid long, row {carried.schema['row'].dataType.simpleString()}, points long, text_sha256 string, names array<long>, fresh array<int>"
    cut = settle(carried.mapInArrow(lambda b: _cut(b, block, REMEMBERED), schema), "cut")
    first = cut.where(F.size("fresh") > 0).select(utf8(f"row`.`{text}").alias("text"), "names", "fresh")
    spelled = first.mapInArrow(lambda b: _spell(b, block), "local long, block binary")
    named = settle(_number(spelled.repartition("block"), "block").select("local", "name"), "names")
    refs = cut.select("rid", F.size("names").alias("n"), F.posexplode("names").alias("pos", "local"))
    level = settle(refs.join(named, "local").select("rid", "n", "pos", "name"), "level")
    done = [level.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    most = level.agg(F.max("n")).first()[0] or 1
    depth = 0
    while most > 1:
        depth += 1
        pairs = (
            level.where("n > 1")
            .groupBy("rid", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.expr("cast(ceil(max(n) / 2) as int)").alias("n"),
                F.expr("max(if(pos % 2 = 0, name, null))").alias("a"),
                F.expr("coalesce(max(if(pos % 2 = 1, name, null)), -1)").alias("b"),
            )
        )
        pairs = settle(pairs, "pairs")
        distinct = settle(_number(pairs.select("a", "b").distinct(), "a", "b"), "names")
        level = settle(pairs.join(distinct, ["a", "b"]).select("rid", "n", "pos", "name"), "level")
        done.append(level.where("n = 1").select("rid", F.lit(depth).alias("level"), "name"))
        most = -(-most // 2)
    return cut, reduce(DataFrame.unionAll, done)


def _decide(docs: DataFrame, key: str, text: str, block: int) -> tuple[DataFrame, DataFrame]:
    cut, identity = _identify(docs, key, text, block)
    facts = cut.select("rid", F.col(f"row.`{key}`").alias("doc_id"), "points", "text_sha256")
    facts = settle(facts.join(identity, "rid"), "identities")
    # the longest original stays, then the smallest doc_id (NULL last), then the first row
    order = F.struct(
        (-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("x"), "doc_id", F.col("rid").alias("keep_rid")
    )
    groups = facts.groupBy("level", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    groups = settle(groups.select("level", "name", "best.keep_rid", F.col("best.doc_id").alias("keep_id"), "group_size"), "groups")
    decided = facts.join(groups, ["level", "name"]).withColumn("kept", F.col("rid") == F.col("keep_rid"))
    return cut, decided


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: its key as doc_id, keep_id, group_size, kept, text_sha256."""
    decided = _decide(docs, key, text, block)[1]
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows that stay, with all their columns."""
    with recording() as made:
        cut, decided = _decide(docs, key, text, block)
        # fewer rows go than stay, so it is the rows that go which meet the texts
        gone = settle(decided.where("NOT kept").select("rid"), "gone")
    remove_unread(docs.sparkSession, made, cut, gone)
    return cut.join(gone, "rid", "left_anti").select("row.*")
