"""Registered queries against SQL, and the pipeline's stages against plain versions."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from brackish.llm.queries import ORACLES, QUERIES
from brackish.llm.text import read
from tests.llm import naive
from tools.check_oracle import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {name.split("_")[0] for name in QUERIES} | {"pipeline"}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    out, docs = [], read(spark, FOLDER, "documents")
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).checkpoint()
        out.append(docs.collect())
    return out


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_columns(spark, stages):
    columns = read(spark, FOLDER, "documents").columns
    assert all(list(rows[0].asDict()) == columns for rows in stages[:-1])


def test_quality_keeps_good_labels(spark, stages):
    kept = {r.doc_id for r in stages[1]}
    for r in read(spark, FOLDER, "labels").collect():
        assert r.doc_id in kept or r.quality == 0


def test_exact(stages):
    want = [naive.best_of(g)[0] for g in naive.exact_groups(pairs(stages[1])).values()]
    assert sorted(r.doc_id for r in stages[2]) == sorted(want)


def test_near(stages):
    assert sorted(r.doc_id for r in stages[3]) == sorted(set(naive.near_classes(pairs(stages[2])).values()))


def test_decontaminated(spark, stages):
    items = [(r.item_id, r.text) for r in read(spark, FOLDER, "benchmark").collect()]
    grams = {tuple(w[i : i + 13]) for _, t in items for w in [naive.words(t)] for i in range(max(1, len(w) - 12)) if w}
    want = []
    for i, text in pairs(stages[3]):
        w, hit = naive.words(text), set()
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit.update(range(j, j + n))
        if not hit or 20 * len(hit) < len(w):
            want.append(i)
    assert sorted(r.doc_id for r in stages[4]) == sorted(want)


def test_encoded(spark, stages):
    assert sorted(r.doc_id for r in stages[5]) == sorted(r.doc_id for r in stages[4])
    assert all(r.round_trip and len(r.ids) == r.n_pieces for r in stages[5])
    assert corpus_pipeline.run(spark, FOLDER).count() == len(stages[5])
