"""From raw documents to encoded training text, in stages that are written and read again.

Each stage takes what the one before it kept and returns the columns of documents; the last one
returns the encoded documents. Null and empty texts, repeated rows and further columns have the
results that the operators state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brackish.llm.decontaminate import drop_contaminated
from brackish.llm.exact_dedup import drop_duplicates
from brackish.llm.near_dedup import drop_near_duplicates
from brackish.llm.quality import keep_good
from brackish.llm.sentencepiece import encode_texts
from brackish.llm.text import read
from brackish.session import recording, remove_unread, settle

MODEL = public_tokenizers.path("piece_bpe_32k.model")

#: SQL has no label model, signatures or lattices; the tests hold the stages against brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Derived tables of the stages so far; what the next stage's input does not read is removed.
_MADE: list[str] = []


def _stage(function: Stage) -> Stage:
    """A stage's input has been written, so the tables that it was made from can go."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        _MADE[:] = remove_unread(spark, _MADE, docs)
        with recording() as made:
            out = function(spark, docs, folder)
        _MADE.extend(made)
        return out

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier finds good."""
    return keep_good(docs)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The longest original of each group of equal texts."""
    return drop_duplicates(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return drop_near_duplicates(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which benchmark passages do not cover a twentieth."""
    return drop_contaminated(docs, read(spark, folder, "benchmark"))


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Encoded documents: doc_id, n_pieces, ids, digests, and whether decoding gives the text."""
    return encode_texts(docs, MODEL).drop("scores")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
