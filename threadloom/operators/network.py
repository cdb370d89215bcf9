"""Topic network: similarity edges and laid-out nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadloom.operators.topics import topic_centroids
from threadloom.plans.ordered import rank_rows
from threadloom.plans.skew import salted_join
from threadloom.plans.tiles import BLOCK_ROWS, to_tiles, with_blocks
from threadloom.session import written

MIN_SIMILARITY = 0.45


def topic_edges(centroids: DataFrame, min_sim: float = MIN_SIMILARITY,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Topic pairs of a thread with cosine above ``min_sim``, ``topic_a < topic_b``.

    Topics meet in tiles, so only the edges above the threshold become rows.
    """
    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster", ignore_index=True)
        unit = np.stack(pdf["centroid"].to_numpy()).astype(float)
        length = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = unit / np.where(length > 0, length, 1.0)
        block, lo, hi = pdf["_block"].to_numpy(), pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        ids = pdf["cluster"].to_numpy()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        sim = unit[left] @ unit[right].T
        keep = sim > min_sim
        if lo == hi:
            keep &= ids[left][:, None] < ids[right][None]
        i, j = np.nonzero(keep)
        a, b = ids[left[i]], ids[right[j]]
        return pd.DataFrame({
            "thread_id": pdf["thread_id"].iloc[0], "topic_a": np.minimum(a, b),
            "topic_b": np.maximum(a, b), "sim": sim[i, j]})

    topics = centroids.select("thread_id", "cluster", "centroid")
    tiles = to_tiles(with_blocks(topics, ["thread_id"], "cluster", block_rows))
    found = tiles.groupBy("thread_id", "_lo", "_hi").applyInPandas(
        edges, "thread_id STRING, topic_a INT, topic_b INT, sim DOUBLE")
    return found.withColumn("weight", F.round("sim", 2)).withColumn("width", F.col("sim") * 5)


def topic_network_edges(analysed: DataFrame, min_sim: float = MIN_SIMILARITY) -> DataFrame:
    return topic_edges(topic_centroids(analysed), min_sim)


def topic_network_nodes(summary: DataFrame) -> DataFrame:
    """Nodes on the unit circle in summary order (upvotes descending)."""
    summary = written(summary, "summary")  # read twice
    ordered = rank_rows(
        summary.withColumn("_down", -F.col("upvotes")), ["thread_id"], ["_down", "cluster"], "rank")
    sizes = summary.groupBy("thread_id").agg(F.count(F.lit(1)).alias("topics"))
    angle = F.lit(2.0) * F.pi() * (F.col("rank") - 1) / F.col("topics")
    return (
        salted_join(ordered, sizes, ["thread_id"], ["cluster"])
        .withColumn("size", F.greatest(F.lit(8.0), F.least(F.lit(60.0), F.sqrt("participants") * 5)))
        .withColumn("x", F.cos(angle)).withColumn("y", F.sin(angle))
        .select("thread_id", "cluster", "rank", "topics", "x", "y", "size", "keywords",
                "participants", "polarization"))
