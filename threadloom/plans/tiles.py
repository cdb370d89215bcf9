"""Work over pairs inside a group without ever making the pairs as rows.

A group is cut into blocks of bounded size by hash. One task gets one *tile*,
that is two blocks, and returns something small per row (a sum, the nearest
few, a spanning forest). A group of one block is one tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from threadloom.plans.skew import HOT_MIN_ROWS, key_counts, salted_join

BLOCK_ROWS = 2048


def with_blocks(
    df: DataFrame, keys: Sequence[str], row_id: str, block_rows: int = BLOCK_ROWS,
    min_hot_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Add ``_blocks`` (blocks in the group) and ``_block`` (own block)."""
    keys = list(keys)
    counts = key_counts(df, keys)
    large = counts.filter(F.col("_n") > block_rows).select(
        *keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
    out = salted_join(df, large, keys, [row_id], "left", counts, min_hot_rows)
    out = out.withColumn("_blocks", F.coalesce(F.col("_blocks"), F.lit(1)))
    return out.withColumn("_block", F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int"))


def to_tiles(blocked: DataFrame) -> DataFrame:
    """Send each row to every tile (``_lo``, ``_hi``) its block takes part in."""
    return (
        blocked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_lo", F.least("_block", "_other"))
        .withColumn("_hi", F.greatest("_block", "_other"))
        .drop("_other")
    )
