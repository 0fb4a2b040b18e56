"""Text helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that exact and line dedup ignore: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"

#: A-Z become a-z, every other ASCII character but 0-9 becomes a blank. Bytes above 127 stay, so
#: what `split` leaves are the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, with A-Z lower-cased."""
    return text.translate(_TO_WORDS).split()


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; NULL counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")


def documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and UTF-8 text alone, under fixed names, so that no other column can clash."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), utf8(text).alias("text"))


def rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most `size` rows, so that few long texts are in Python at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
