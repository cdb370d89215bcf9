"""Report tables: key figures, cards, context for a text report, text chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.functions.text import NOT_WHITESPACE
from threadloom.operators.polarization import bands
from threadloom.plans.ordered import running_total
from threadloom.session import cut_lineage, written


def thread_kpis(analysed: DataFrame, summary: DataFrame) -> DataFrame:
    """Comments, topics, weighted mean polarization and mean sentiment.

    The weights are topic sizes, so noise does not count; the mean sentiment
    covers all comments. A thread without topics has a null polarization.
    """
    comments = analysed.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("comments"), F.avg("sentiment").alias("avg_sentiment"))
    topics = summary.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("topics"),
        F.try_divide(F.sum(F.col("polarization") * F.col("participants")),
                     F.sum("participants")).alias("avg_polarization"))
    return comments.join(topics, "thread_id", "left").withColumn(
        "topics", F.coalesce("topics", F.lit(0).cast("long")))


def topic_cards(summary: DataFrame) -> DataFrame:
    """Summary with its bands, in upvote order."""
    return bands(summary).select(
        "thread_id", "cluster", "keywords", "upvotes", "participants", "polarization",
        "sentiment", "band", "core").orderBy("thread_id", F.col("upvotes").desc(), "cluster")


def topic_context(summary: DataFrame, analysed: DataFrame, k: int = 6) -> DataFrame:
    """One JSON string per thread: its counts and its first ``k`` topics."""
    summary = written(summary, "summary")  # read twice
    order = Window.partitionBy("thread_id").orderBy(F.col("upvotes").desc(), "cluster")
    first = (
        summary.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct(
            "rank", F.col("cluster").alias("id"), "keywords", "participants", "polarization"))).alias("_t")))
    topics = F.transform("_t", lambda t: t.dropFields("rank"))
    counts = analysed.groupBy("thread_id").agg(F.count(F.lit(1)).alias("comments")).join(
        summary.groupBy("thread_id").agg(F.count(F.lit(1)).alias("clusters")), "thread_id", "left")
    shown = F.when(F.col("_t").isNull(), F.from_json(F.lit("[]"), "array<struct<id:int,keywords:string,participants:bigint,polarization:double>>")) \
        .otherwise(topics)
    return counts.join(first, "thread_id", "left").withColumn("clusters", F.coalesce("clusters", F.lit(0))).select(
        "thread_id", F.to_json(F.struct("clusters", "comments", shown.alias("topics"))).alias("context"))


# --- greedy text chunks ----------------------------------------------------

def _with_next(pdf: pd.DataFrame, limit: int):
    """Texts of a block in order, and where a chunk begun at each is full."""
    pdf = pdf.sort_values("comment_key", ignore_index=True)
    end, begin = pdf["end"].to_numpy(), (pdf["end"] - pdf["len"]).to_numpy()
    full = np.searchsorted(end, begin + limit, side="right")
    return pdf, begin, end, np.maximum(full, np.arange(len(end)) + 1).tolist()


def _block_steps(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """What a block does to the chunk that is open when the block begins.

    A chunk open since offset s is cut at the first text that ends beyond
    s + limit, and every later cut follows from that one. So the block is a
    step function of s: for s < ``below`` the chunk open at the block's end
    begins at ``exit``, and ``cuts`` chunks begin inside. For s past the last
    step nothing is cut. A text has at least one character, so at most
    limit + 1 texts can be the first cut.
    """
    pdf, begin, end, after = _with_next(pdf, limit)
    n = len(pdf)
    last, cuts = list(range(n)), [1] * n
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i], cuts[i] = last[after[i]], cuts[after[i]] + 1
    first = int(np.searchsorted(end, begin[0] + limit, side="right")) + 1
    first = min(first, n)
    return pd.DataFrame({
        "thread_id": pdf["thread_id"].iloc[0], "_block": pdf["_block"].iloc[0],
        "below": end[:first] - limit, "exit": begin[np.array(last[:first])],
        "cuts": cuts[:first]})


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The step function of a block after an earlier one: what both do to the chunk open before."""
    parts = [p.sort_values("below") for _, p in pdf.groupby("earlier", sort=False)]
    first, then = sorted(parts, key=lambda p: not p["earlier"].iloc[0]) if len(parts) == 2 else (None, parts[0])
    if first is not None:
        at = np.searchsorted(then["below"].to_numpy(), first["exit"].to_numpy(), side="right")
        cut = at < len(then)
        at = np.minimum(at, len(then) - 1)
        later = then[then["below"] > first["below"].iloc[-1]]
        then = pd.DataFrame({
            "below": np.concatenate([first["below"], later["below"]]),
            "exit": np.concatenate([np.where(cut, then["exit"].to_numpy()[at], first["exit"]), later["exit"]]),
            "cuts": np.concatenate([first["cuts"] + np.where(cut, then["cuts"].to_numpy()[at], 0), later["cuts"]])})
    return then[["below", "exit", "cuts"]].assign(thread_id=pdf["thread_id"].iloc[0], no=pdf["no"].iloc[0])[
        ["thread_id", "no", "below", "exit", "cuts"]]


def _entries(steps: DataFrame) -> DataFrame:
    """(thread_id, no, open_since, chunks_before): the state in which each block is entered.

    A parallel scan: in each round a block's function is composed with that of
    the block as far before as it already covers, so that twice as many blocks
    are covered; a task never holds more than two functions. What a thread's
    first blocks do to the state before its first text is the first step.
    """
    schema = "thread_id STRING, no BIGINT, below BIGINT, exit BIGINT, cuts BIGINT"
    last = steps.agg(F.max("no")).first()[0] or 0
    far = 1
    while far <= last:
        before = steps.withColumns({"no": F.col("no") + far, "earlier": F.lit(True)})
        there = steps.select("thread_id", "no").distinct()
        both = steps.withColumn("earlier", F.lit(False)).unionByName(before.join(there, ["thread_id", "no"], "left_semi"))
        steps = cut_lineage(both.groupBy("thread_id", "no").applyInPandas(_composed, schema))
        far *= 2
    return steps.groupBy("thread_id", "no").agg(F.min(F.struct("below", "exit", "cuts")).alias("first")).select(
        "thread_id", (F.col("no") + 1).alias("no"), F.col("first.exit").alias("open_since"), F.col("first.cuts").alias("chunks_before"))


def _mark(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    pdf, begin, end, after = _with_next(pdf, limit)
    since = pdf["open_since"].iloc[0]
    at = 0 if pd.isna(since) else int(np.searchsorted(end, int(since) + limit, side="right"))
    starts = np.zeros(len(pdf), dtype="int64")
    while at < len(pdf):
        starts[at] = 1
        at = after[at]
    chunk = pdf["chunks_before"].iloc[0] + np.cumsum(starts) - 1
    return pdf[["thread_id", "comment_key"]].assign(chunk_id=chunk.astype("int64"))


def chunk_ids(texts: DataFrame, max_chars: int = 8000, partitions: int | None = None) -> DataFrame:
    """(thread_id, comment_key, chunk_id) of greedy packing in key order.

    Packing is sequential, yet a thread of any size is spread over tasks: each
    block of consecutive texts is first summarised as a step function of its
    entry state, the functions of neighbouring blocks are composed in rounds,
    and then every block marks its own chunks. Blank texts belong to no chunk.
    """
    lengths = texts.filter(F.col("text").rlike(NOT_WHITESPACE)).select(
        "thread_id", "comment_key", F.length("text").cast("long").alias("len"))
    ends = cut_lineage(running_total(lengths, ["thread_id"], ["comment_key"], F.col("len"), "end",
                                     partitions, keep_block=True))
    blocks = ends.select("thread_id", "_block").distinct()
    long_threads = blocks.groupBy("thread_id").count().filter("count > 1").select("thread_id")
    # A thread with several blocks crosses a block edge: fewer than partitions.
    steps = (
        ends.join(F.broadcast(long_threads), "thread_id", "left_semi")
        .groupBy("thread_id", "_block").applyInPandas(
            lambda pdf: _block_steps(pdf, max_chars),
            "thread_id STRING, _block INT, below BIGINT, exit BIGINT, cuts BIGINT"))
    # blocks of a thread are numbered without gaps: the range bounds of equal (thread, key) rows are consecutive
    numbers = blocks.join(F.broadcast(long_threads), "thread_id", "left_semi").select(
        "thread_id", "_block", (F.row_number().over(Window.partitionBy("thread_id").orderBy("_block")) - 1).cast("long").alias("no"))
    numbers = cut_lineage(numbers)
    steps = cut_lineage(steps.join(numbers, ["thread_id", "_block"]).drop("_block"))
    entries = cut_lineage(_entries(steps).join(numbers, ["thread_id", "no"]).drop("no"))
    return (
        ends.join(F.broadcast(entries), ["thread_id", "_block"], "left")
        .withColumn("chunks_before", F.coalesce("chunks_before", F.lit(0).cast("long")))
        .groupBy("thread_id", "_block").applyInPandas(
            lambda pdf: _mark(pdf, max_chars),
            "thread_id STRING, comment_key BIGINT, chunk_id BIGINT"))


def text_chunks(texts: DataFrame, max_chars: int = 8000, partitions: int | None = None) -> DataFrame:
    """Chunks of newline-joined texts; a single longer text is its own chunk.

    ``texts``: thread_id, comment_key, text. Newlines do not count.
    """
    placed = texts.join(chunk_ids(texts, max_chars, partitions), ["thread_id", "comment_key"])
    return (
        placed.groupBy("thread_id", "chunk_id")
        .agg(F.array_sort(F.collect_list(F.struct("comment_key", "text"))).alias("_t"))
        .select("thread_id", "chunk_id", F.size("_t").cast("long").alias("n_texts"),
                F.array_join(F.col("_t.text"), "\n").alias("text")))


def topic_sample(analysed: DataFrame, n: int = 60, max_chars: int = 9000) -> DataFrame:
    """First chunk of the first ``n`` texts of each topic.

    Lengths are positive, so the first chunk is the run of texts whose running
    length fits, and at least the first one.
    """
    order = Window.partitionBy("thread_id", "cluster").orderBy("comment_key")
    first = (
        analysed.filter(F.col("cluster") != -1)
        .select("thread_id", "cluster", "comment_key", F.col("body_clean").alias("text"))
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
        .filter(F.col("text").rlike(NOT_WHITESPACE)))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        first.withColumn("_run", F.sum(F.length("text")).over(run))
        .withColumn("_at", F.row_number().over(order))
        .filter((F.col("_run") <= max_chars) | (F.col("_at") == 1))
        .groupBy("thread_id", "cluster")
        .agg(F.array_sort(F.collect_list(F.struct("comment_key", "text"))).alias("_t"))
        .select("thread_id", "cluster", F.size("_t").cast("long").alias("n_texts"),
                F.array_join(F.col("_t.text"), "\n").alias("text")))
