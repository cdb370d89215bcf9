"""Running totals and ranks inside groups of any size.

A window over a whole group runs in one task. Here rows are range-partitioned
by (keys, order) so that a large group spans many partitions, each partition
sums its own part, and the sums of earlier partitions are added afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.plans.skew import salted_join
from threadloom.session import cut_lineage, few_files


def ordered_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None, rows: int | None = None
) -> DataFrame:
    """Add ``_block``: consecutive runs of rows in (keys, order) order.

    Checkpointed, because range bounds are sampled anew in every job and all
    users of the blocks must see the same ones. ``rows``, if known, is how many
    rows there are at most: blocks of a few rows then share a file.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_block", F.spark_partition_id())
    return cut_lineage(ranged if rows is None else few_files(ranged, rows))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    partitions: int | None = None,
    keep_block: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``order``."""
    keys, order = list(keys), list(order)
    blocks = ordered_blocks(df.withColumn("_value", value), keys, order, partitions, rows)
    inside = blocks.withColumn(
        name, F.sum("_value").over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.sum("_sum").over(earlier))
        .filter(F.col("_before").isNotNull())
        .select(*keys, "_block", "_before")
    )
    # Blocks are consecutive, so at most one group crosses each block edge:
    # fewer offset rows than partitions.
    return (
        inside.join(F.broadcast(offsets), [*keys, "_block"], "left")
        .withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_before", "_value", *([] if keep_block else ["_block"]))
    )


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank",
              partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """``row_number`` from 1 for groups of any size; ``order`` must be total."""
    return running_total(df, keys, order, F.lit(1).cast("long"), name, partitions, rows=rows)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
    partitions: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles, one column per name.

    Equal values are counted first, so a frequent value is one row; the rank of
    each distinct value then comes from a running total.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counted, keys, [value], F.col("_n"), "_upto", partitions)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"))
    placed = salted_join(ranked, sizes, keys, spread=[value])
    aggs = []
    for name, p in probabilities.items():
        at = F.col("_size").cast("double").__sub__(1) * F.lit(p)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            # zero-based positions of this value: _upto - _n .. _upto - 1
            here = (pos >= F.col("_upto") - F.col("_n")) & (pos < F.col("_upto"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
    out = placed.groupBy(*keys).agg(*aggs)
    for name in probabilities:
        lo, hi, w = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "w"))
        out = out.withColumn(name, lo + (hi - lo) * w)
    return out.select(*keys, *probabilities)
