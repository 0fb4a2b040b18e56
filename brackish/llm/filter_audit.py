"""Interaction audit of a set of filters, in every order in which they can be applied.

Each filter has one stored table: the row ids of the documents that fail it. Relations of ids are
then split filter by filter: `left_semi` with a filter's table gives those that fail it, `left_anti`
those that pass. After all filters every relation is named by the filters its ids fail, and the
relations of one name are counted by part and label. What a prefix leaves, removes, removes again
(redundantly) or costs in labelled documents is a union of such relations. It depends on the set of
the earlier filters only, so 2 joins per filter answer all orders, and no join runs over the text.

    audit = FilterAudit.build(docs, labels, FILTERS)
    audit.table()                    # every order, step by step
    audit.survivors("AC")            # ids, also `removed("AC", "B")` and `redundant("AC", "B")`

The texts are read once, into one row of flags and digest each; filters are SQL expressions, so
nothing leaves the JVM. Ids are unique, so no join has a hot key but the one of equal texts with the
smallest doc_id of their group: that table holds one row per repeated text, is settled, and is
broadcast when small; larger ones are sorted and adaptive execution splits hot digests.

Defined results: a NULL text is empty. A NULL `part` is the empty string. Each row is a document of
its own, also where a doc_id repeats; a NULL doc_id is neither a smaller one nor has one. A document
is good (toxic) if any row of `labels` with its doc_id says so. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.session import settle

#: Fewest words, distinct words per 100 words, and most upper-case letters per 100 code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10


def _words() -> Column:
    return F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


#: Failure conditions by name, as SQL over text, n_words and n_distinct. "E", repeated texts, is a
#: relation between documents and is found by digest.
FILTERS: dict[str, str | None] = {
    "A": f"n_words < {LEAST_WORDS}",
    "B": f"100L * n_distinct < {LEAST_DISTINCT}L * n_words",
    "C": f"100L * length(regexp_replace(text, '[^A-Z]', '')) > {MOST_UPPER}L * length(text)",
    "D": "text RLIKE '[#$%&*|]'",
    "E": None,
}


@dataclass
class FilterAudit:
    """The stored relations: `ids` (row, part, good, toxic) and one id table per filter."""

    ids: DataFrame
    failing: Mapping[str, DataFrame]

    @classmethod
    def build(
        cls,
        docs: DataFrame,
        labels: DataFrame,
        filters: Mapping[str, str | None] = FILTERS,
        key: str = "doc_id",
        text: str = "text",
        part: str = "lang",
    ) -> FilterAudit:
        """`filters` maps one-letter names to failure conditions; None stands for repeated texts."""
        if any(len(name) != 1 for name in filters):
            raise ValueError("filters are named by single letters")
        plain = docs.select(
            F.col(f"`{key}`").alias("doc_id"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
            F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        )
        counted = plain.withColumn("words", _words()).select(
            "*", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct")
        )
        tests = {name: test for name, test in filters.items() if test is not None}
        facts = settle(
            counted.select(
                F.monotonically_increasing_id().alias("row"),
                "doc_id",
                "part",
                F.unhex(F.sha2("text", 256)).alias("digest"),
                *[F.coalesce(F.expr(test), F.lit(False)).alias(f"fails_{name}") for name, test in tests.items()],
            ),
            "facts",
        )
        known = labels.select(
            F.col(f"`{key}`").alias("doc_id"),
            *[F.coalesce(F.col(c).cast("int") == 1, F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))],
        )
        known = known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).where("good OR toxic")
        labelled = facts.select("row", "doc_id", "part").join(settle(known, "labels"), "doc_id", "left")
        ids = settle(
            labelled.select("row", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]), "ids"
        )
        failing = {}
        for name in filters:
            bad = facts.where(f"fails_{name}") if name in tests else _repeated(facts)
            failing[name] = settle(bad.select("row"), f"failing-{name}")
        return cls(ids, failing)

    def survivors(self, prefix: Sequence[str]) -> DataFrame:
        """Rows that pass every filter of the prefix."""
        return reduce(lambda left, name: left.join(self.failing[name], "row", "left_anti"), prefix, self.ids)

    def removed(self, prefix: Sequence[str], name: str) -> DataFrame:
        """Rows that a filter removes after the prefix."""
        return self.survivors(prefix).join(self.failing[name], "row", "left_semi")

    def redundant(self, prefix: Sequence[str], name: str) -> DataFrame:
        """Rows that fail a filter but were removed by the prefix."""
        failing = self.ids.join(self.failing[name], "row", "left_semi")
        return failing.join(self.survivors(prefix), "row", "left_anti")

    def relations(self) -> DataFrame:
        """Per part and set of failed filters: n, good, toxic. `failed` is a bit per filter."""
        held = self.ids.withColumn("failed", F.lit(0))
        for at, name in enumerate(self.failing):
            bad = self.failing[name]
            fails = held.join(bad, "row", "left_semi").withColumn("failed", F.col("failed") + (1 << at))
            held = settle(fails.unionByName(held.join(bad, "row", "left_anti")), "split")
        return held.groupBy("part", "failed").agg(
            F.count("*").alias("n"),
            F.count_if("good").alias("good"),
            F.count_if("toxic").alias("toxic"),
        )

    def table(self) -> DataFrame:
        """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        shapley (removed by the step's filter, summed over all orders)."""
        bits = {name: 1 << at for at, name in enumerate(self.failing)}
        steps = [
            {
                "filter_order": "".join(order),
                "step": at + 1,
                "own": bits[name],
                "before": sum(bits[x] for x in order[:at]),
                "others": sum(bits.values()) - bits[name],
            }
            for order in permutations(bits)
            for at, name in enumerate(order)
        ]
        schema = "array<struct<filter_order string, step int, own int, before int, others int>>"
        each = settle(self.relations(), "relations").select(
            "part", "failed", "n", "good", "toxic", F.inline(F.from_json(F.lit(json.dumps(steps)), schema))
        )
        own, seen = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
        alone = F.col("failed").bitwiseAND(F.col("others")) == 0

        def total(column: str, where: Column) -> Column:
            return F.sum(F.when(where, F.col(column)).otherwise(0))

        counted = each.groupBy("part", "filter_order", "step", "own").agg(
            total("n", ~own & ~seen).alias("kept"),
            total("n", own & ~seen).alias("removed"),
            total("n", own & seen).alias("redundant"),
            total("n", own & alone).alias("unique_fails"),
            total("good", own & ~seen).alias("good_lost"),
            total("toxic", own & ~seen).alias("toxic_lost"),
        )
        of_filter = Window.partitionBy("part", "own")  # one row per order
        return counted.withColumn("shapley", F.sum("removed").over(of_filter)).drop("own")


def _repeated(facts: DataFrame) -> DataFrame:
    """Rows whose text a smaller doc_id has too."""
    least = facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return facts.join(settle(least, "repeated"), "digest").where("doc_id > least")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`FilterAudit.table` with the standard filters."""
    return FilterAudit.build(docs, labels).table()
