"""Reading the tables and carrying rows whole through an operator."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space between words: space and the five ASCII controls.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: str) -> DataFrame:
    """Each row whole as the struct ``row``, beside the columns an operator reads.

    ``columns`` maps new names to column names. Whatever else the input holds,
    also under the names an operator uses for itself, stays inside ``row``.
    """
    return df.select(F.struct("*").alias("row"), *(F.col(f"`{c}`").alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def words_of(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+", -1))


def once(df: DataFrame, name: str, **values: Column) -> DataFrame:
    """Add the struct ``name`` so that later filters do not repeat its work.

    A filter is pushed below a projection by writing the projection's
    expressions into it again; it is not pushed below a generator.
    """
    made = F.struct(*(v.alias(k) for k, v in values.items()))
    return df.select("*", F.explode(F.array(made)).alias(name))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that a task holds Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
