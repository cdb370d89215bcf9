"""Two-camp polarization of a topic.

polarization = clamp(D / W * balance * confidence * 12, 0, 10), where D is the
distance of the camp centres, W the mean distance to the own centre, balance
the evenness of the camps and confidence the rescaled mean silhouette.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadloom.functions import vectors
from threadloom.plans.skew import salted_join
from threadloom.plans.tiles import BLOCK_ROWS, to_tiles, with_blocks
from threadloom.session import cut_lineage, written

TOPIC = ["thread_id", "cluster"]
MIN_ROWS = 10
RESTARTS = 10
TOLERANCE = 1e-4
# Rows of a block. A topic of one block is fitted in one task; the others do the
# same steps with sums over their blocks.
FIT_ROWS = 20_000


# --- fitting the two camps -------------------------------------------------

def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gaps = points[:, None, :] - centres[None, :, :]
    return np.einsum("nkd,nkd->nk", gaps, gaps)


def _race(keys: np.ndarray, restart: int, draw: int) -> np.ndarray:
    """Exponential waiting times fixed by the row key.

    The row with the smallest time / weight is a draw with probability
    proportional to weight, and a minimum can be taken in any order.
    """
    seed = np.uint64((restart * 2 + draw + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = keys.astype(np.uint64) + seed
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return -np.log((z >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _starts(keys, points, restart):
    """k-means++ start: one uniform draw, one weighted by squared distance."""
    first = points[np.argmin(_race(keys, restart, 0))]
    weight = _squared(points, first[None])[:, 0]
    if not weight.any():
        return np.stack([first, first])
    with np.errstate(divide="ignore"):
        second = points[np.argmin(_race(keys, restart, 1) / weight)]
    return np.stack([first, second])


def _fit_small(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("comment_key", ignore_index=True)
    points, keys = _matrix(pdf["embedding"]), pdf["comment_key"].to_numpy()
    stop = TOLERANCE * points.var(axis=0).mean()
    best, camps = np.inf, None
    for restart in range(RESTARTS):
        centres = _starts(keys, points, restart)
        while True:  # each round lowers the sum of squares, so it settles
            labels = _squared(points, centres).argmin(axis=1)
            moved = np.stack([
                points[labels == c].mean(axis=0) if (labels == c).any() else centres[c]
                for c in (0, 1)])
            shift = ((moved - centres) ** 2).sum()
            centres = moved
            if not shift > stop:  # also when a vector is not a number
                break
        dist = _squared(points, centres)
        inertia = dist.min(axis=1).sum()
        if inertia < best or camps is None:  # of equal ones the first restart
            best, camps = inertia, dist.argmin(axis=1)
    return pdf[[*TOPIC, "comment_key"]].assign(camp=camps.astype("int32"))


def packed_blocks(blocked: DataFrame) -> DataFrame:
    """(topic, _block, keys, points): a row for each block, its keys and vectors as bytes, written once."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("comment_key")
        return pdf[[*TOPIC, "_block"]].head(1).assign(
            keys=[pdf["comment_key"].to_numpy("int64").tobytes()], points=[_matrix(pdf["embedding"]).tobytes()])

    return written(blocked.groupBy(*TOPIC, "_block").applyInPandas(
        pack, "thread_id STRING, cluster INT, _block INT, keys BINARY, points BINARY"), "packed-vectors")


def meet(packed: DataFrame, centres: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(topic, keys, points, states)`` for each block, with the states of its topic's restarts.

    The states are written, so that Spark knows their size and sends them to
    the blocks; only when they are too many for that do blocks move.
    """
    own = [c for c in centres.columns if c not in TOPIC]
    states = written(centres.groupBy(*TOPIC).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("states")), "states")

    def each(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                keys = np.frombuffer(row.keys, "int64")
                points = np.frombuffer(row.points, float).reshape(len(keys), -1)
                yield fn((row.thread_id, row.cluster), keys, points, row.states)

    return packed.join(states, TOPIC).mapInPandas(each, schema)


def _fit_large(blocked: DataFrame) -> DataFrame:
    """The same fit with a topic's rows spread over many tasks.

    Vectors lie in packed blocks that stay where they are; in a round a block
    meets all restarts' centres and returns only sums. One round serves every
    topic, and restarts whose centres have settled leave it.
    """
    packed = packed_blocks(blocked)
    draws = "thread_id STRING, cluster INT, restart INT, wait DOUBLE, centre ARRAY<DOUBLE>"
    names = [*TOPIC, "restart", "wait", "centre"]

    def draw_first(topic, keys, points, states):
        waits = [(state["restart"], _race(keys, state["restart"], 0)) for state in states]
        return pd.DataFrame([(*topic, r, float(w.min()), points[int(np.argmin(w))].tolist()) for r, w in waits], columns=names)

    def draw_second(topic, keys, points, states):
        out = []
        for state in states:
            weight = _squared(points, np.asarray(state["first"])[None])[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                wait = np.where(weight > 0, _race(keys, state["restart"], 1) / weight, np.inf)
            i = int(np.argmin(wait))
            out.append((*topic, state["restart"], float(wait[i]), points[i].tolist()))
        return pd.DataFrame(out, columns=names)

    def earliest(drawn, name):
        return drawn.groupBy(*TOPIC, "restart").agg(F.min_by("centre", "wait").alias(name))

    restarts = packed.select(*TOPIC).distinct().withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(RESTARTS - 1))))
    first = cut_lineage(earliest(meet(packed, restarts, draw_first, draws), "first"))
    second = earliest(meet(packed, first, draw_second, draws), "second")
    centres = cut_lineage(first.join(second, [*TOPIC, "restart"]))

    spread = (  # mean variance per dimension, for the stopping rule
        blocked.groupBy(*TOPIC).agg(
            vectors.mean_vector("embedding").alias("_mean"),
            F.avg(vectors.dot(F.col("embedding"), F.col("embedding"))).alias("_sq"),
            F.max(F.size("embedding")).alias("_d"))
        .select(*TOPIC, ((F.col("_sq") - vectors.dot(F.col("_mean"), F.col("_mean")))
                         / F.col("_d") * TOLERANCE).alias("stop")))
    centres = cut_lineage(centres.join(spread, TOPIC))

    sums = ("thread_id STRING, cluster INT, restart INT, first ARRAY<DOUBLE>, second ARRAY<DOUBLE>, stop DOUBLE, "
            "n0 BIGINT, n1 BIGINT, total0 ARRAY<DOUBLE>, total1 ARRAY<DOUBLE>, inertia DOUBLE")

    def assign(topic, keys, points, states):
        out = []
        for state in states:
            dist = _squared(points, np.array([state["first"], state["second"]], float))
            near = dist.argmin(axis=1) == 0
            out.append((*topic, state["restart"], state["first"], state["second"], state["stop"],
                        int(near.sum()), int((~near).sum()), points[near].sum(axis=0).tolist(),
                        points[~near].sum(axis=0).tolist(), float(dist.min(axis=1).sum())))
        return pd.DataFrame(out, columns=[
            *TOPIC, "restart", "first", "second", "stop", "n0", "n1", "total0", "total1", "inertia"])

    def label(topic, keys, points, states):
        labels = _squared(points, np.array([states[0]["first"], states[0]["second"]], float)).argmin(axis=1)
        return pd.DataFrame({"thread_id": topic[0], "cluster": topic[1], "comment_key": keys, "camp": labels.astype("int32")})

    def moved(old, total, n):
        mean = F.transform(total, lambda v: v / F.col(n))
        return F.when(F.col(n) > 0, mean).otherwise(F.col(old))

    restart = [*TOPIC, "restart"]
    moving, still = centres, None
    while True:
        totals = meet(packed, moving, assign, sums).groupBy(*restart).agg(
            *[F.first(c).alias(c) for c in ("first", "second", "stop")],  # equal in all blocks
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
            vectors.sum_vector("total0").alias("total0"), vectors.sum_vector("total1").alias("total1"))
        new = totals.withColumn("_first", moved("first", "total0", "n0")).withColumn(
            "_second", moved("second", "total1", "n1"))
        shift = (F.pow(vectors.distance(F.col("first"), F.col("_first")), 2.0)
                 + F.pow(vectors.distance(F.col("second"), F.col("_second")), 2.0))
        step = cut_lineage(new.select(
            *restart, F.col("_first").alias("first"), F.col("_second").alias("second"), "stop",
            ((shift <= F.col("stop")) | F.isnan(shift)).alias("settled")))
        settled = step.filter("settled").drop("settled")
        still = settled if still is None else still.unionByName(settled)
        moving = step.filter("NOT settled").drop("settled")
        if moving.isEmpty():
            break
    ends = cut_lineage(still.unionByName(moving))
    inertia = meet(packed, ends, assign, sums).groupBy(*restart).agg(F.sum("inertia").alias("inertia"))
    best = inertia.groupBy(*TOPIC).agg(
        F.min_by("restart", F.struct("inertia", "restart")).alias("restart"))
    return meet(packed, ends.join(best, [*TOPIC, "restart"]), label,
                "thread_id STRING, cluster INT, comment_key BIGINT, camp INT")


def two_camps(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(topic, comment_key, camp): best 2-means split of 10 restarts per topic."""
    vecs = rows.select(*TOPIC, "comment_key", "embedding").filter(F.col("embedding").isNotNull())
    blocked = with_blocks(vecs, TOPIC, "comment_key", fit_rows)
    schema = "thread_id STRING, cluster INT, comment_key BIGINT, camp INT"
    small = (
        blocked.filter("_blocks = 1").select(*TOPIC, "comment_key", "embedding")
        .groupBy(*TOPIC).applyInPandas(_fit_small, schema))
    large = blocked.filter("_blocks > 1").drop("_blocks")
    if large.isEmpty():
        return small
    return small.unionByName(_fit_large(large))


def fixed_start_camps(rows: DataFrame, rounds: int = 3) -> DataFrame:
    """Two camps from a fixed start: lowest and highest key, ``rounds`` rounds.

    Centres and rows meet in a split-safe join; only sums are shuffled.
    """
    vecs = rows.select(*TOPIC, "comment_key", "embedding").filter(F.col("embedding").isNotNull())
    centres = vecs.groupBy(*TOPIC).agg(
        F.min_by("embedding", "comment_key").alias("first"),
        F.max_by("embedding", "comment_key").alias("second"),
        F.count(F.lit(1)).alias("_n"))
    counts = centres.select(*TOPIC, "_n")
    centres = centres.select(
        *TOPIC, *[F.col(c).cast("array<double>").alias(c) for c in ("first", "second")])

    def assigned(state):
        near = salted_join(vecs, state, TOPIC, ["comment_key"], counts=counts)
        d0 = vectors.distance(F.col("embedding"), F.col("first"))
        d1 = vectors.distance(F.col("embedding"), F.col("second"))
        return near.withColumn("camp", F.when(d0 <= d1, 0).otherwise(1))

    for _ in range(rounds):
        means = assigned(centres).groupBy(*TOPIC, "camp").agg(
            vectors.mean_vector("embedding").alias("mean"))
        moved = means.groupBy(*TOPIC).agg(
            F.first(F.when(F.col("camp") == 0, F.col("mean")), ignorenulls=True).alias("_a"),
            F.first(F.when(F.col("camp") == 1, F.col("mean")), ignorenulls=True).alias("_b"))
        centres = cut_lineage(centres.join(moved, TOPIC).select(
            *TOPIC, F.coalesce("_a", "first").alias("first"), F.coalesce("_b", "second").alias("second")))
    return assigned(centres).select(*TOPIC, "comment_key", "camp")


# --- measuring the split ---------------------------------------------------

def camp_balance(camps: DataFrame) -> DataFrame:
    """Camp sizes and 2 * min / total."""
    return camps.groupBy(*TOPIC).agg(
        F.count_if(F.col("camp") == 0).alias("n1"), F.count_if(F.col("camp") == 1).alias("n2"),
    ).withColumn("balance", 2 * F.least("n1", "n2") / (F.col("n1") + F.col("n2")))


def camp_separation(camps: DataFrame) -> DataFrame:
    """D: distance of the camp centres; W: mean of the camps' mean distances."""
    side = [*TOPIC, "camp"]
    centres = camps.groupBy(*side).agg(
        vectors.mean_vector("embedding").alias("centre"), F.count(F.lit(1)).alias("_n"))
    # One pass over the rows gives every camp's mean distance to its centre.
    within = (
        salted_join(camps.select(*side, "comment_key", "embedding"),
                    centres.select(*side, "centre"), side, ["comment_key"],
                    counts=centres.select(*side, "_n"))
        .groupBy(*side)
        .agg(F.avg(vectors.distance(F.col("embedding"), F.col("centre"))).alias("w")))

    def pick(camp, column):
        return F.max(F.when(F.col("camp") == camp, F.col(column)))

    joined = centres.join(within, side).groupBy(*TOPIC).agg(
        F.first(F.when(F.col("camp") == 0, F.col("centre")), ignorenulls=True).alias("_c1"),
        F.first(F.when(F.col("camp") == 1, F.col("centre")), ignorenulls=True).alias("_c2"),
        F.coalesce(pick(0, "w"), F.lit(0.0)).alias("w1"),
        F.coalesce(pick(1, "w"), F.lit(0.0)).alias("w2"))
    return joined.select(
        *TOPIC, F.coalesce(vectors.distance(F.col("_c1"), F.col("_c2")), F.lit(0.0)).alias("d"),
        ((F.col("w1") + F.col("w2")) / 2).alias("w"))


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per row of a tile: distance sums and row counts against each camp."""
    lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
    points = _matrix(pdf["embedding"])
    points = points - points.mean(axis=0)
    camp, block = pdf["camp"].to_numpy(), pdf["_block"].to_numpy()
    sums = np.zeros((len(pdf), 2))
    counts = np.zeros((len(pdf), 2), dtype="int64")
    for mine, other in {(lo, hi), (hi, lo)}:
        rows, cols = np.flatnonzero(block == mine), np.flatnonzero(block == other)
        sq = (points * points).sum(axis=1)
        for c in (0, 1):
            there = cols[camp[cols] == c]
            counts[rows, c] = len(there)
            for part in np.array_split(rows, max(1, len(rows) // 512)):
                gram = sq[part][:, None] + sq[there][None] - 2 * points[part] @ points[there].T
                if mine == other:  # a row is at distance 0 from itself, exactly
                    gram[part[:, None] == there[None]] = 0.0
                sums[part, c] = np.sqrt(np.maximum(gram, 0)).sum(axis=1)
    return pdf[[*TOPIC, "comment_key", "camp"]].assign(
        s0=sums[:, 0], s1=sums[:, 1], c0=counts[:, 0], c1=counts[:, 1])


def row_silhouettes(camps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette of each row; 0 in a camp of one.

    Every pair is compared inside a tile and leaves it only as a sum.
    """
    rows = camps.select(*TOPIC, "comment_key", "camp", "embedding")
    tiles = to_tiles(with_blocks(rows, TOPIC, "comment_key", block_rows))
    sums = tiles.groupBy(*TOPIC, "_lo", "_hi").applyInPandas(
        _pair_sums, "thread_id STRING, cluster INT, comment_key BIGINT, camp INT, "
                    "s0 DOUBLE, s1 DOUBLE, c0 BIGINT, c1 BIGINT")
    total = sums.groupBy(*TOPIC, "comment_key", "camp").agg(
        *[F.sum(c).alias(c) for c in ("s0", "s1", "c0", "c1")])
    own = F.col("camp") == 0
    a = F.when(own, F.try_divide("s0", F.col("c0") - 1)).otherwise(F.try_divide("s1", F.col("c1") - 1))
    b = F.when(own, F.try_divide("s1", "c1")).otherwise(F.try_divide("s0", "c0"))
    return (
        total.withColumn("a", a).withColumn("b", b)
        .withColumn("silhouette", F.coalesce(
            F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
        .select(*TOPIC, "comment_key", "camp", "silhouette"))


def camp_silhouette(camps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return row_silhouettes(camps, block_rows).groupBy(*TOPIC).agg(
        F.avg("silhouette").alias("silhouette"))


def polarization_from_camps(camps: DataFrame, min_rows: int = MIN_ROWS,
                            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Score and its parts for rows with a camp.

    0 for topics below ``min_rows`` and for topics whose rows are all equal.
    """
    parts = (
        camp_balance(camps).join(camp_separation(camps), TOPIC)
        .join(camp_silhouette(camps, block_rows), TOPIC))
    confidence = F.greatest(F.lit(0.0), (F.col("silhouette") + 1) / 2)
    raw = F.col("d") / (F.col("w") + 1e-9) * F.col("balance") * confidence * 12
    usable = (F.col("n1") + F.col("n2") >= min_rows) & (F.col("d") > 0)
    return (
        parts.withColumn("polarization_raw", F.when(
            usable, F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw))).otherwise(0.0))
        .withColumn("polarization", F.round("polarization_raw", 2)))


def with_camps(rows: DataFrame, camps: DataFrame) -> DataFrame:
    return rows.select(*TOPIC, "comment_key", "embedding").join(
        camps.select("comment_key", "camp"), "comment_key")


def polarization(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Fit the camps and score each topic."""
    fitted = cut_lineage(with_camps(rows, two_camps(rows)))
    return polarization_from_camps(fitted, min_rows)


def bands(df: DataFrame, column: str = "polarization") -> DataFrame:
    """Band (> 6 high, > 3 moderate), dissent label (> 5) and gauge zone (3, 7)."""
    value = F.col(column)
    return (
        df.withColumn("band", F.when(value > 6, "high").when(value > 3, "moderate").otherwise("low"))
        .withColumn("dissent_label", F.when(value > 5, "dissenting").otherwise("alternative"))
        .withColumn("gauge_zone", F.when(value < 3, "low").when(value < 7, "middle").otherwise("high")))
