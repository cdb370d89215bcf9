"""Comment rows: body filters, cleaning, reply tree and expansion merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadloom.functions import text
from threadloom.plans.ordered import rank_rows
from threadloom.session import cut_lineage


def body_filters(comments: DataFrame) -> DataFrame:
    """Drop null, removed and white-space-only bodies."""
    return comments.filter(text.has_text(F.col("body")))


def sentinel_filter(comments: DataFrame) -> DataFrame:
    """Drop bodies whose text is a removal mark, ``nan`` or ``None``."""
    return comments.filter(text.not_sentinel(F.col("body")))


def preprocess(comments: DataFrame, min_words: int = 5) -> DataFrame:
    """Sentinel filter, ``body_clean``, ``word_count``; keep >= ``min_words``."""
    return (
        sentinel_filter(comments)
        .withColumn("body_clean", text.once(text.clean_text(F.col("body"))))
        .filter(F.col("body_clean") != "")
        .withColumn("word_count", text.word_count(F.col("body_clean")))
        .filter(F.col("word_count") >= min_words)
    )


def reply_depth(comments: DataFrame, key: str = "comment_key", parent: str = "parent_key") -> DataFrame:
    """(``key``, ``depth``, ``reason``) from parent pointers, 0 for roots.

    Pointer doubling: each round a row's ancestor jumps to its ancestor's
    ancestor, so a chain of length n needs log2(n) joins, not n. A row is
    settled once its ancestor is. Only rows that are not settled take part in a
    round, and of the settled ones those that such a row points to, so rounds
    become smaller. A row also carries the smallest key on the way it has come:
    the smallest row of a cycle meets itself there, and the others of the cycle
    meet that one, so a cycle ends after as many rounds as it is long. A row
    that hangs below no root has a null depth and a reason: ``no_parent`` if an
    ancestor is not in the table, ``cycle`` if its ancestors come round. Keys
    are unique.
    """
    up = F.col(parent)
    itself = F.col(key) == up
    settled = F.when(up.isNull(), 0).when(itself, -1)
    state = cut_lineage(comments.select(
        F.col(key).alias("key"), up.alias("up"), up.alias("least"), F.lit(1).alias("hops"),
        settled.alias("depth"), F.when(itself, "cycle").alias("reason")))
    columns = state.columns
    waiting = state.filter("depth is null")
    done = [state.filter("depth is not null").select("key", "depth", "reason")]
    known = done[0]
    while not waiting.isEmpty():
        targets = waiting.select(F.col("up").alias("key")).distinct()
        known = cut_lineage(known.join(targets, "key", "left_semi"))
        above = known.select(F.col("key").alias("up"), F.lit(None).cast(state.schema["up"].dataType).alias("next"),
                             F.lit(None).cast(state.schema["up"].dataType).alias("low"), F.lit(0).alias("more"),
                             F.col("depth").alias("its_depth"), F.col("reason").alias("its_reason")).unionByName(
            waiting.join(targets, "key", "left_semi").select(
                F.col("key").alias("up"), F.col("up").alias("next"), F.col("least").alias("low"), F.col("hops").alias("more"),
                F.lit(None).cast("int").alias("its_depth"), F.lit(None).cast("string").alias("its_reason")))
        # Nothing regroups the result, so Spark may split a hot parent at run
        # time (adaptive skew join).
        met = waiting.join(above, "up", "left").withColumn("low", F.least("least", "low"))
        on_cycle = F.col("its_depth").isNull() & (F.col("low") == F.col("key"))
        reason = F.when(F.col("more").isNull(), "no_parent").when(on_cycle, "cycle").otherwise(F.col("its_reason"))
        moved = met.select(
            "key", F.coalesce("next", "up").alias("up"), F.coalesce("low", "least").alias("least"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.when(reason.isNotNull(), -1).otherwise(F.col("hops") + F.col("its_depth")).alias("depth"), reason.alias("reason"))
        moved = cut_lineage(moved.select(*columns))
        rings = moved.filter("reason = 'cycle' and least = key").select(F.col("key").alias("least"), F.lit(True).alias("_ring"))
        if not rings.isEmpty():
            moved = cut_lineage(moved.join(rings, "least", "left").select(
                "key", "up", "least", "hops", F.when(F.col("_ring") & F.col("depth").isNull(), -1).otherwise(F.col("depth")).alias("depth"),
                F.when(F.col("_ring") & F.col("depth").isNull(), "cycle").otherwise(F.col("reason")).alias("reason")))
        found = moved.filter("depth is not null").select("key", "depth", "reason")
        done.append(found)
        known = known.unionByName(found)
        waiting = moved.filter("depth is null")
    out = done[0]
    for found in done[1:]:
        out = out.unionByName(found)
    return out.select(F.col("key").alias(key), F.when(F.col("reason").isNull(), F.col("depth")).alias("depth"), "reason")


def reply_counts(comments: DataFrame, key: str = "comment_key", parent: str = "parent_key") -> DataFrame:
    """Direct replies per comment, 0 when none.

    The counts are aggregated map-side first, so a comment with very many
    replies reaches the shuffle as one row per task; the join is 1:1.
    """
    counts = (
        comments.filter(F.col(parent).isNotNull())
        .groupBy(F.col(parent).alias(key)).agg(F.count(F.lit(1)).alias("replies_count"))
    )
    return comments.join(counts, key, "left").withColumn(
        "replies_count", F.coalesce("replies_count", F.lit(0).cast("long")))


def merge_expansions(base: DataFrame, expansions: DataFrame, dedupe: bool = False) -> DataFrame:
    """Append expanded comments, which carry their own depth (1 if absent).

    Duplicates stay unless ``dedupe``; then a comment of the base wins, and of
    two on one side the smaller by its columns. Comments without an id are no
    duplicates of each other.
    """
    extra = expansions.withColumn("depth", F.coalesce(F.col("depth"), F.lit(1)).cast("int"))
    if not dedupe:
        return base.unionByName(extra, allowMissingColumns=True)
    both = base.withColumn("_rank", F.lit(0)).unionByName(
        extra.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    columns = ["_rank", *(c for c in both.columns if c not in ("thread_id", "id", "_rank"))]
    first = both.filter("id IS NOT NULL").groupBy("thread_id", "id").agg(F.min(F.struct(*columns)).alias("_row"))
    named = first.select("thread_id", "id", "_row.*").select(*base.columns)
    return named.unionByName(both.filter("id IS NULL").select(*base.columns))


def continuation_batches(ids: DataFrame, batch_size: int = 20, max_batches: int | None = None) -> DataFrame:
    """Batches of continuation ids per thread, in walk order.

    All ids are batched; with ``max_batches`` only the first batches of a
    thread, and then the rank filter runs before the shuffle as well (window
    group limit).
    """
    if max_batches is None:
        ranked = rank_rows(ids, ["thread_id"], ["pos"], "rn")
    else:
        order = Window.partitionBy("thread_id").orderBy("pos")
        ranked = ids.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= batch_size * max_batches)
    return (
        ranked.withColumn("batch", F.floor((F.col("rn") - 1) / batch_size).cast("int"))
        .groupBy("thread_id", "batch")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "child_id"))).alias("_ids"))
        .select("thread_id", "batch", F.col("_ids.child_id").alias("child_ids"))
    )


def missing_continuations(ids: DataFrame, comments: DataFrame) -> DataFrame:
    """(thread_id, child_id) of continuation ids that no comment came back for."""
    back = comments.select("thread_id", F.col("id").alias("child_id")).distinct()
    return ids.select("thread_id", "child_id").distinct().join(back, ["thread_id", "child_id"], "left_anti")


def join_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Copy post columns onto every comment of the thread.

    Spark broadcasts the posts when they are few and splits the comments of a
    hot thread otherwise (adaptive skew join).
    """
    return comments.join(posts, "thread_id")


def thread_gate(posts: DataFrame, min_comments: int = 30) -> DataFrame:
    """Threads large enough to analyse."""
    return posts.filter(F.col("num_comments") >= min_comments)


def embed_join(comments: DataFrame, embeddings: DataFrame, key: str = "comment_key") -> DataFrame:
    """Comments that have a vector, aligned by key."""
    return comments.join(embeddings, key)
