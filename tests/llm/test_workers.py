"""What a task holds in Python."""

from __future__ import annotations

from brackish.llm.decontaminate import find_contamination
from brackish.llm.quality import Features


def test_one_block_of_items_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "b c")], "item_id string, text string")
    found = find_contamination(docs, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated, r.clean_text) for r in found.collect()}
    assert got == {1: (3, 2, True, "a "), 2: (0, 0, False, "")}


def test_a_token_is_held_as_one_number():
    made = Features()
    made.of(b"some words and some More")
    assert len(made.cache) == 4 and all(type(v) is int for v in made.cache.values())
