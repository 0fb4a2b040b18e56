"""MinHash near-dedup with BagMinHash signatures of five-word shingle multisets.

1. Texts with equal multisets are one class; the rest works on classes, so copies form no pairs.
2. Signatures of 128 entries are cut into 32 bands of four. Two texts of similarity 0.8 share none
   of them with a probability of 5e-8.
3. A bucket's smallest class leads it, and the classes that share a bucket with a leader are its
   family. First every member is held against its leader, on the whole multisets.
4. The links found so far give components. In a family that still has several, all members are held
   against all members outside of its largest component, again on whole multisets: this tests every
   pair that shares a bucket and is not connected yet. It is done block against block (a few hundred
   members each), so neither pairs nor families come together as rows; only links leave a task.
5. The components of all links are the groups.

The leaders' and the largest components' share of a family is never compared twice, so a family of
copies costs a pass over its members. Only members that are like their family's bucket but not
linked to it cost more.

Defined results: a text of one to four words has one shingle, all its words. A text without words
(NULL, empty) is alone. A group is named by its smallest doc_id (NULL only if it has no other). Rows
that repeat a doc_id are rows of their own; `drop_near_duplicates` keeps exactly one of rows that
repeat doc_id and text, but all rows without words. Other columns are ignored by
`near_duplicate_groups`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.llm.bagminhash import Shingles, bands, overlap, signatures
from brackish.llm.components import components
from brackish.llm.text import documents, rows, utf8, words
from brackish.operators.keys import join_on
from brackish.session import recording, remove_unread, settle

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 32, 4
#: Members of a block and their bytes, and blocks that one task holds against one block.
BLOCK, BLOCK_BYTES, TOGETHER = 128, 4 << 20, 16
#: Tasks that a family's members are dealt to when they meet its facts.
SALTS = 32

Bag = tuple[np.ndarray, np.ndarray]


def pack(bag: Bag) -> bytes:
    return bag[0].tobytes() + bag[1].astype(np.int64).tobytes()


def unpack(packed: bytes) -> Bag:
    half = len(packed) // 2
    return np.frombuffer(packed[:half], np.uint64), np.frombuffer(packed[half:], np.int64)


def _digest(bag: Bag) -> bytes:
    return hashlib.blake2b(pack(bag), digest_size=16).digest()


def _parts(items: list[int], sizes: list[int], most: int = 200_000) -> Iterator[list[int]]:
    """The items in runs of at most `most` shingles (a longer text is a run of its own)."""
    part, held = [], 0
    for item, size in zip(items, sizes):
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append(item)
        held += size
    if part:
        yield part


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, count: int, size: int) -> Iterator[pa.RecordBatch]:
    """Per text: its own digest, its multiset's digest (the node) and its bands."""
    made = Shingles(shingle)
    for batch in rows(batches, 512):
        texts = batch.column("text").to_pylist()
        bags = [made.of(words(x)) for x in texts]
        full = [i for i, (x, _) in enumerate(bags) if len(x)]
        band = {}
        for part in _parts(full, [len(bags[i][0]) for i in full]):
            made_now = signatures([bags[i] for i in part], count * size)
            band |= zip(part, bands(made_now, size).tolist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()),
                pa.array([_digest(b) if len(b[0]) else None for b in bags], pa.binary()),
                pa.array([band.get(i) for i in range(len(texts))], pa.list_(pa.int64())),
            ],
            ["doc_id", "whole", "node", "bands"],
        )


def _bags(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    made = Shingles(shingle)
    for batch in rows(batches, 64):
        bags = [pack(made.of(words(x))) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bags, pa.binary())], ["node", "bag"])


def alike(least: int, most: int, similarity: Fraction) -> bool:
    return least * similarity.denominator >= most * similarity.numerator


_LINKS = "a binary, b binary"


def _links(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _against_leader(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches, 64):
        a, b = [], []
        for node, bag, family, leader in zip(*(batch.column(c).to_pylist() for c in ("node", "bag", "family", "leader"))):
            if alike(*overlap(unpack(bag), unpack(leader)), similarity):
                a.append(node)
                b.append(family)
        yield _links(a, b)


class Block:
    """Multisets indexed by shingle: one search gives a text's overlap with all of them."""

    def __init__(self, bags: list[Bag]):
        shingle = np.concatenate([x for x, _ in bags])
        order = np.argsort(shingle, kind="stable")
        self.owner = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])[order]
        self.count = np.concatenate([w for _, w in bags])[order]
        self.keys, self.first, self.many = np.unique(shingle[order], return_index=True, return_counts=True)
        self.total = np.array([w.sum() for _, w in bags])

    def overlap(self, bag: Bag) -> tuple[np.ndarray, np.ndarray]:
        """Sums of minima and of maxima with each multiset of the block."""
        at = np.minimum(np.searchsorted(self.keys, bag[0]), len(self.keys) - 1)
        known = self.keys[at] == bag[0]
        at, weight = at[known], bag[1][known]
        many = self.many[at]
        place = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        least = np.bincount(self.owner[place], np.minimum(self.count[place], np.repeat(weight, many)), len(self.total))
        least = least.astype(np.int64)
        return least, self.total + int(bag[1].sum()) - least


def _block_links(members: list[dict], others: list[dict], similarity: Fraction) -> Iterator[tuple[bytes, bytes]]:
    """Links between members and others of different components, one per member and component."""
    block = Block([unpack(x["bag"]) for x in others])
    roots = [x["root"] for x in others]
    for member in members:
        least, most = block.overlap(unpack(member["bag"]))
        met = {member["root"]}
        for k in np.flatnonzero(least * similarity.denominator >= most * similarity.numerator).tolist():
            if roots[k] not in met:
                met.add(roots[k])
                yield member["node"], others[k]["node"]


def _against_others(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches, 1):
        for row in batch.to_pylist():
            found = list(_block_links(row["members"], row["others"], similarity))
            yield _links([a for a, _ in found], [b for _, b in found])


def _grouped(df: DataFrame, blocks: str, name: str) -> DataFrame:
    """A family's rows in blocks of bounded size, dealt out by hash."""
    dealt = df.withColumn(name, F.expr(f"cast(pmod(xxhash64(node), {blocks}) as int)"))
    return dealt.groupBy("family", name, "member_blocks", "other_blocks").agg(
        F.collect_list(F.struct("node", "root", "bag")).alias(f"{name}s")
    )


def _per_family(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Join facts of families to their members; a family's members go to several tasks."""
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.expr(f"cast(pmod(xxhash64(node), {SALTS}) as int)")).join(copies, ["family", "salt"]).drop("salt")


def _within_families(families: DataFrame, roots: DataFrame, bags: DataFrame, similarity: Fraction) -> DataFrame:
    """Links between members of one family that are in different components."""
    known = settle(
        families.join(roots, "node", "left").select("family", "node", F.coalesce("root", "node").alias("root")), "known"
    )
    parts = known.groupBy("family", "root").count()
    main = parts.groupBy("family").agg(
        F.max(F.struct("count", "root")).alias("main"), F.count("*").alias("parts"), F.sum("count").alias("members")
    )
    open_ = settle(main.where("parts > 1").select("family", "main.root", "members").withColumnRenamed("root", "main"), "open")
    rows_ = _per_family(known, open_).select("family", "node", "root", (F.col("root") != F.col("main")).alias("other"))
    rows_ = settle(rows_.join(bags, "node"), "members")
    sizes = rows_.groupBy("family").agg(
        *[
            F.expr(f"cast(greatest(ceil(count_if({c}) / {BLOCK}), ceil(sum(if({c}, length(bag), 0)) / {BLOCK_BYTES}), 1) as int)").alias(n)
            for n, c in (("member_blocks", "true"), ("other_blocks", "other"))
        ]
    )
    rows_ = _per_family(rows_, settle(sizes, "sizes"))
    # a block of others meets the members' blocks in bundles, so that a task's work is bounded too
    members = _grouped(rows_, "member_blocks", "member").select(
        "family", F.expr(f"member div {TOGETHER}").cast("int").alias("bundle"), "members", F.explode(F.expr("sequence(0, other_blocks - 1)")).alias("other")
    )
    others = _grouped(rows_.where("other"), "other_blocks", "other").select(
        "family", F.explode(F.expr(f"sequence(0, cast((member_blocks - 1) div {TOGETHER} as int))")).alias("bundle"), "others", "other"
    )
    met = members.join(others, ["family", "bundle", "other"]).select("members", "others")
    return met.mapInArrow(partial(_against_others, similarity=similarity), _LINKS)


def _classes(texts: DataFrame, similarity: float, shingle: int, count: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and ``(node, root)`` for every class that is linked to another."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    exact = Fraction(str(similarity))
    signed = texts.mapInArrow(
        partial(_sign, shingle=shingle, count=count, size=size), f"doc_id {kind}, whole binary, node binary, bands array<long>"
    )
    signed = settle(signed, "signed")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "whole")).alias("one")
    classes = settle(signed.where("node IS NOT NULL").groupBy("node").agg(one, F.first("bands").alias("bands")), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("family")).where("n > 1")
    families = settle(buckets.join(settle(shared.select("bucket", "family"), "shared"), "bucket").select("family", "node").distinct(), "families")
    wanted = classes.join(families.select("node").distinct(), "node", "left_semi").select("node", "one.doc_id", "one.whole")
    found = join_on(texts.withColumn("whole", F.unhex(F.md5("text"))), settle(wanted, "wanted"), ["doc_id", "whole"], "inner")
    bags = found.select("node", "text").mapInArrow(partial(_bags, shingle=shingle), "node binary, bag binary")
    if not signed.groupBy("doc_id", "whole").count().where("count > 1").isEmpty():
        bags = bags.dropDuplicates(["node"])
    bags = settle(bags, "bags")
    # the smallest class of a bucket leads it; it is a member too and needs no test against itself
    pairs = families.where("node <> family").join(bags, "node")
    pairs = pairs.join(bags.select(F.col("node").alias("family"), F.col("bag").alias("leader")), "family")
    links = settle(pairs.mapInArrow(partial(_against_leader, similarity=exact), _LINKS), "links")
    first = settle(components(links), "components")
    more = settle(_within_families(families, first, bags, exact), "links")
    return signed, settle(components(links.unionAll(more)), "components")


def near_duplicate_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    count: int = BANDS,
    size: int = ROWS,
) -> DataFrame:
    """One row per input row: its key as doc_id, class_id (smallest doc_id of its group),
    class_size (rows of the group), kept."""
    decided = _decided(documents(docs, key, text), similarity, shingle, count, size)
    return decided.select("doc_id", "class_id", "class_size", "kept")


def _decided(texts: DataFrame, similarity: float, shingle: int, count: int, size: int) -> DataFrame:
    signed, roots = _classes(texts, similarity, shingle, count, size)
    named = signed.select("doc_id", "whole", "node").join(roots, "node", "left")
    # texts without words are groups of their own
    alone = F.unhex(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.hex("whole"), F.monotonically_increasing_id().cast("string")), 256))
    worded = F.col("node").isNotNull().alias("worded")
    named = settle(named.select("doc_id", "whole", worded, F.coalesce("root", "node", alone).alias("root")), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "whole")).alias("first")
    groups = settle(named.groupBy("root").agg(first, F.count("*").alias("class_size")), "groups")
    joined = named.join(groups.select("root", "first.doc_id", "first.whole", "class_size").toDF("root", "class_id", "kept_whole", "class_size"), "root")
    return joined.withColumn("kept", F.expr("doc_id <=> class_id AND whole = kept_whole"))


def drop_near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    count: int = BANDS,
    size: int = ROWS,
) -> DataFrame:
    """One row of each group, with all its columns."""
    with recording() as made:
        decided = settle(_decided(documents(docs, key, text), similarity, shingle, count, size), "decided")
        # fewer rows go than stay, so it is the rows that go which meet the texts
        gone = settle(decided.where("NOT kept").select("doc_id", "whole").distinct(), "gone")
        twins = decided.where("kept AND worded").groupBy("doc_id", "whole").agg(F.count("*").alias("twins"))
        twins = settle(twins.where("twins > 1").select("doc_id", "whole"), "twins")
    remove_unread(docs.sparkSession, made, gone, twins)
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("doc_id"), F.unhex(F.md5(utf8(text))).alias("whole")
    )
    rest = join_on(marked, gone, ["doc_id", "whole"], "left_anti")
    if twins.isEmpty():
        return rest.select("row.*")
    single = join_on(rest, twins, ["doc_id", "whole"], "left_anti")
    repeated = join_on(rest, twins, ["doc_id", "whole"], "left_semi").groupBy("doc_id", "whole").agg(F.first("row").alias("row"))
    return single.select("row.*").unionAll(repeated.select("row.*"))
