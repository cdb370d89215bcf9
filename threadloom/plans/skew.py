"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so fewer than
# HOT_SHARE keys can be hot: that is the proven bound of the broadcast below.
HOT_SHARE = 500
# Keys with fewer rows than this are never worth splitting.
HOT_MIN_ROWS = 100_000


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def hot_keys(counts: DataFrame, keys: Sequence[str], min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Keys to split and into how many parts; fewer than ``HOT_SHARE`` rows."""
    share = counts.agg(F.sum("_n") / F.lit(HOT_SHARE)).scalar()
    size = F.greatest(share, F.lit(float(min_rows)))
    return counts.filter(F.col("_n") > size).select(
        *keys, F.ceil(F.col("_n") / size).cast("int").alias("_parts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Equi-join a large ``left`` with an N:1 ``right``, splitting hot keys.

    Rows of a hot key go to ``_parts`` salts by the hash of ``spread``; only the
    matching rows of ``right`` are repeated. Pass ``counts`` (see
    :func:`key_counts`) when it is already known, to save a pass over ``left``.
    ``how`` is ``inner`` or ``left``.
    """
    on = list(on)
    if counts is None:
        counts = key_counts(left, on)
    hot = F.broadcast(hot_keys(counts, on, min_rows))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    # A row without a key matches nothing, so it may go to any salt.
    salted = left.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.when(no_key, 4096).otherwise(parts)).cast("int"))
    repeated = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.drop("_parts").join(repeated.drop("_parts"), [*on, "_salt"], how).drop("_salt")
