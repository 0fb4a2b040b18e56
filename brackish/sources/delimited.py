"""Delimited logger and sample files."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brackish.functions.nulls import to_number
from brackish.functions.times import parse_time
from brackish.operators.keys import join_on


def read_table(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, sep: str = ",") -> DataFrame:
    """Header-first delimited text with a declared schema.

    Columns are found by their header, file by file; one that a file does not have is NULL. A
    record is one line.
    """
    return _by_header(spark, path, _declared(schema), lambda c: F.trim(c), "*", sep).drop("_name")


def read_logger_folder(
    spark: SparkSession, path: str, schema: StructType | str, name: str = "filename", pattern: str = "*.csv"
) -> DataFrame:
    """Every matching file of a folder tree, each row tagged with the file it came from."""
    rows = _by_header(spark, path, _declared(schema), lambda c: F.trim(c), pattern, ",")
    return rows.withColumnRenamed("_name", name)


def _declared(schema: StructType | str) -> dict[str, str]:
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return {f.name: f.dataType.simpleString() for f in fields}


def clean_name(name: str) -> str:
    """``Radon In Water [Dpm/L]`` -> ``radon_in_water_dpm_l``."""
    text = name.strip().replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    return re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower() or "x"


def clean_names(names: Sequence[str]) -> list[str]:
    """Snake-case names, repeats numbered from 2."""
    seen: dict[str, int] = {}
    out = []
    for name in map(clean_name, names):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def _clean_name_column(name: Column) -> Column:
    text = F.replace(F.replace(F.trim(name), F.lit("%"), F.lit("_percent_")), F.lit("#"), F.lit("_number_"))
    text = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2")
    text = F.regexp_replace(text, r"[^0-9A-Za-z]+", "_")
    return F.lower(F.regexp_replace(text, r"^_+|_+$", ""))


def read_by_header(spark: SparkSession, path: str, wanted: Mapping[str, str], pattern: str = "*.csv") -> DataFrame:
    """Columns picked by cleaned header name from files whose layouts differ.

    `wanted` maps a cleaned header to a type (``timestamp``, ``double``, ``string``, ``int``).
    """
    return _by_header(spark, path, wanted, _clean_name_column, pattern, ",").drop("_name")


def _fields(line: str, sep: str) -> Column:
    """Cells of a line, however many: quoted ones lose their quotes, empty ones are NULL."""
    s = re.escape(sep)
    cells = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(f'("(?:[^"]|"")*"|[^{s}]*){s}'), F.lit(1))

    def bare(cell: Column) -> Column:
        inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(cell.rlike('^"(?:[^"]|"")*"$'), inner).otherwise(cell), F.lit(""))

    return F.transform(cells, bare)


def _by_header(
    spark: SparkSession,
    path: str | Sequence[str],
    wanted: Mapping[str, str],
    named: Callable[[Column], Column],
    pattern: str,
    sep: str,
) -> DataFrame:
    """The `wanted` columns, and each row's file name as ``_name``.

    Each file's first line is its header; lines meet their own header by file, so any mix of
    layouts is one scan and no file list passes through the driver.
    """
    lines = (
        spark.read.options(recursiveFileLookup=True, pathGlobFilter=pattern)
        .text(path)
        .select(
            F.regexp_replace("value", r"\r$", "").alias("value"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_name").alias("_name"),
            F.col("_metadata.file_block_start").alias("_start"),
        )
    )
    headers = (
        lines.where(F.col("_start") == 0)
        .withColumn("_line", F.monotonically_increasing_id())
        .groupBy("_file")
        .agg(F.min_by("value", "_line").alias("_header"))
        .withColumn("_names", F.transform(_fields("_header", sep), named))
    )
    rows = join_on(lines, headers, ["_file"], "inner").where((F.col("value") != F.col("_header")) & (F.trim("value") != ""))
    cut = rows.select("_name", "_names", _fields("value", sep).alias("_fields"))

    def pick(name: str) -> Column:
        at = F.array_position("_names", F.lit(name))
        return F.when(at > 0, F.try_element_at("_fields", at.cast("int")))

    return cut.select(*[_typed(pick(n), t).alias(n) for n, t in wanted.items()], "_name")


def _typed(col: Column, kind: str) -> Column:
    if kind.startswith("timestamp"):
        return parse_time(F.trim(col))
    if kind == "double":
        return to_number(col)
    return F.trim(col).try_cast(kind)


def mixed_dates(df: DataFrame, column: str, formats: Sequence[str], name: str | None = None) -> DataFrame:
    """One text column holding several date layouts, parsed in a single read."""
    return df.withColumn(name or column, parse_time(F.trim(F.col(column)), formats))


def unify_columns(df: DataFrame, name: str, alternatives: Sequence[str]) -> DataFrame:
    """One column out of several that mean the same; the others are dropped."""
    present = [c for c in alternatives if c in df.columns]
    return df.withColumn("_unified", F.coalesce(*present)).drop(*present).withColumnRenamed("_unified", name)
