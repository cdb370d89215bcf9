"""Topic tables for comments that already carry a ``cluster``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadloom.functions import vectors
from threadloom.operators import keywords as kw
from threadloom.operators import polarization as pol
from threadloom.plans.skew import salted_join
from threadloom.session import written

NOISE = -1
TOPIC = ["thread_id", "cluster"]


def topic_rows(analysed: DataFrame) -> DataFrame:
    return analysed.filter(F.col("cluster") != NOISE)


def topic_ids(analysed: DataFrame) -> DataFrame:
    return topic_rows(analysed).select(*TOPIC).distinct()


def topic_centroids(analysed: DataFrame) -> DataFrame:
    """Mean vector and number of vectors per topic."""
    rows = topic_rows(analysed).filter(F.col("embedding").isNotNull())
    return rows.groupBy(*TOPIC).agg(
        vectors.mean_vector("embedding").alias("centroid"), F.count(F.lit(1)).alias("n"))


def centroid_distances(analysed: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """(topic, comment_key, dist): how far each comment is from its centroid."""
    rows = topic_rows(analysed).filter(F.col("embedding").isNotNull()).select(
        *TOPIC, "comment_key", "embedding")
    if centroids is None:
        centroids = topic_centroids(analysed)
    counts = centroids.select(*TOPIC, F.col("n").alias("_n"))
    joined = salted_join(rows, centroids.select(*TOPIC, "centroid"), TOPIC, ["comment_key"],
                         counts=counts)
    return joined.withColumn("dist", vectors.distance(F.col("embedding"), F.col("centroid"))).select(
        *TOPIC, "comment_key", "dist")


def quotes(analysed: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Core, dissenting and most popular comment of each topic.

    Ties go to the lowest ``comment_key``; null scores never win.
    """
    dist = centroid_distances(analysed, centroids)
    ends = dist.groupBy(*TOPIC).agg(
        F.min_by("comment_key", F.struct("dist", "comment_key")).alias("core"),
        F.max_by("comment_key", F.struct(F.col("dist"), -F.col("comment_key"))).alias("dissent"))
    texts = analysed.select("comment_key", "body_clean")
    for end in ("core", "dissent"):
        ends = ends.withColumnRenamed(end, "comment_key").join(texts, "comment_key").drop(
            "comment_key").withColumnRenamed("body_clean", end)
    return ends.join(popular(analysed), TOPIC, "full")


def popular(analysed: DataFrame) -> DataFrame:
    scored = topic_rows(analysed).filter(F.col("score").isNotNull())
    return scored.groupBy(*TOPIC).agg(
        F.max_by("body_clean", F.struct(F.col("score"), -F.col("comment_key"))).alias("popular"))


def topic_stats(analysed: DataFrame) -> DataFrame:
    """Score sum, row count and mean sentiment.

    ``participants`` counts comments, not distinct authors.
    """
    return topic_rows(analysed).groupBy(*TOPIC).agg(
        F.sum("score").cast("long").alias("upvotes"),
        F.count(F.lit(1)).alias("participants"),
        F.avg("sentiment").alias("sentiment_raw"),
        F.round(F.avg("sentiment"), 3).alias("sentiment"))


def topic_summary(analysed: DataFrame, polarization: DataFrame | None = None,
                  stop_words=None) -> DataFrame:
    """One row per topic, with its ``rank`` by upvotes inside the thread.

    ``polarization`` is (thread_id, cluster, polarization); fitted when absent.
    """
    if polarization is None:
        polarization = pol.polarization(topic_rows(analysed).filter(F.col("embedding").isNotNull()))
    words = kw.topic_keywords(topic_rows(analysed), stop_words=stop_words)
    stats = topic_stats(analysed)
    summary = (
        stats.join(words, TOPIC, "left")
        .join(polarization.select(*TOPIC, "polarization"), TOPIC, "left")
        .join(quotes(analysed, written(topic_centroids(analysed), "centroids")), TOPIC, "left")
        .withColumn("keywords", F.coalesce("keywords", F.lit("misc")))
        .withColumn("polarization", F.coalesce("polarization", F.lit(0.0)))
    )
    order = Window.partitionBy("thread_id").orderBy(F.col("upvotes").desc_nulls_last(), "cluster")
    return summary.withColumn("rank", F.row_number().over(order)).select(
        *TOPIC, "rank", "keywords", "upvotes", "participants", "polarization", "sentiment",
        "popular", "core", "dissent",
    ).orderBy("thread_id", "rank")


def topic_drilldown(analysed: DataFrame, summary: DataFrame, cluster: int) -> DataFrame:
    """Comments of one topic per thread, beside the topic's summary row."""
    rows = analysed.filter(F.col("cluster") == cluster)
    # `cluster` is fixed, so the thread alone is the join key.
    head = summary.filter(F.col("cluster") == cluster).select(
        "thread_id", F.col("keywords").alias("topic_keywords"), F.col("upvotes").alias("topic_upvotes"),
        F.col("participants").alias("topic_participants"),
        F.col("polarization").alias("topic_polarization"))
    return rows.join(head, "thread_id")
