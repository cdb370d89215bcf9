"""Queries behind the engagement and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import tables as t
from threadloom.catalog.topic_queries import SUMMARY, given_summary
from threadloom.operators import comments as ops
from threadloom.operators import engagement as eng
from threadloom.operators import network, report
from threadloom.session import written

QUERIES, ORACLE = {}, {}
STAMP = "yyyy-MM-dd HH:mm:ss"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def _timeline_sql(source, keys):
    return f"""SELECT {keys}, strftime(make_timestamp(created_utc // 1800 * 1800 * 1000000), '%Y-%m-%d %H:%M:%S') AS bin,
  count(id) AS count, round(avg(score), 6) AS avg_score
FROM {source} WHERE created_utc > 0 GROUP BY ALL"""


@query(f"WITH {t.COMMENTS} {_timeline_sql('comments', 'thread_id')}")
def activity_timeline(spark, sf_dir):
    return eng.activity_timeline(t.comments(spark, sf_dir)).select(
        "thread_id", F.date_format("bin", STAMP).alias("bin"), "count",
        F.round("avg_score", 6).alias("avg_score"))


@query(f"WITH {t.ANALYSED} {_timeline_sql('topical', 'thread_id, cluster::INTEGER AS cluster')}")
def topic_activity(spark, sf_dir):
    rows = t.analysed(spark, sf_dir).filter("cluster <> -1")
    return eng.activity_timeline(rows, ["thread_id", "cluster"]).select(
        "thread_id", "cluster", F.date_format("bin", STAMP).alias("bin"), "count",
        F.round("avg_score", 6).alias("avg_score"))


@query(f"""WITH RECURSIVE {t.COMMENTS}, {t.DEPTHS}
SELECT thread_id, depth, round(avg(score), 6) AS avg_score, count(id) AS count
FROM comments JOIN all_depths USING (comment_key) GROUP BY thread_id, depth""")
def depth_engagement(spark, sf_dir):
    rows = t.comments(spark, sf_dir).select("comment_key", "id", "thread_id", "parent_key", "score")
    return eng.depth_engagement(t.with_depth(rows)).withColumn("avg_score", F.round("avg_score", 6))


@query(f"""WITH {t.COMMENTS}, totals AS (
  SELECT thread_id, author, CAST(sum(score) AS BIGINT) AS total_score, count(id) AS comments FROM comments
  WHERE author IS NOT NULL AND author NOT IN ('[deleted]', 'AutoModerator') GROUP BY thread_id, author),
ranked AS (SELECT *, CAST(row_number() OVER (
  PARTITION BY thread_id ORDER BY total_score DESC NULLS LAST, author) AS INTEGER) AS rank FROM totals)
SELECT * FROM ranked WHERE rank <= 10""")
def top_contributors(spark, sf_dir):
    return eng.top_contributors(t.comments(spark, sf_dir))


@query(f"""WITH {t.ANALYSED}, replies AS (
  SELECT parent_key AS comment_key, count(*) AS replies_count FROM comments
  WHERE parent_key IS NOT NULL GROUP BY parent_key)
SELECT thread_id, comment_key, cluster::INTEGER AS cluster, score, replies_count,
  least(greatest(replies_count, 1), 50) AS bubble, body_clean
FROM analysed JOIN replies USING (comment_key) WHERE score IS NOT NULL AND replies_count > 0""")
def controversy_map(spark, sf_dir):
    # Replies are counted over all comments, also those that cleaning drops.
    counted = ops.reply_counts(t.comments(spark, sf_dir)).select("comment_key", "replies_count")
    rows = t.analysed(spark, sf_dir).join(counted, "comment_key")
    return eng.controversy_map(rows).select(
        "thread_id", "comment_key", "cluster", "score", "replies_count", "bubble", "body_clean")


LABEL = """CASE WHEN sentiment <= -1.01 OR sentiment > 1.01 THEN NULL WHEN sentiment <= -0.05 THEN 'Negative'
  WHEN sentiment <= 0.05 THEN 'Neutral' WHEN sentiment IS NOT NULL THEN 'Positive' END"""


@query(f"""WITH {t.ANALYSED}, labelled AS (SELECT *, {LABEL} AS label FROM analysed)
SELECT thread_id, cluster::INTEGER AS cluster, label, count(*) AS n FROM labelled WHERE label IS NOT NULL GROUP BY ALL""")
def sentiment_classes(spark, sf_dir):
    return eng.sentiment_classes(t.analysed(spark, sf_dir)).groupBy("thread_id", "cluster", "label").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""WITH {t.ANALYSED}, labelled AS (SELECT *, {LABEL} AS label FROM analysed)
SELECT thread_id, cluster::INTEGER AS cluster, label, count(*) AS n, round(avg(sentiment), 6) AS mean,
  min(sentiment) AS min, max(sentiment) AS max, round(quantile_cont(sentiment, 0.25), 6) AS q1,
  round(quantile_cont(sentiment, 0.5), 6) AS median, round(quantile_cont(sentiment, 0.75), 6) AS q3
FROM labelled WHERE label IS NOT NULL GROUP BY ALL""")
def sentiment_distribution(spark, sf_dir):
    out = eng.sentiment_distribution(t.analysed_table(spark, sf_dir))
    for c in ("mean", "q1", "median", "q3"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(f"""WITH {SUMMARY}, k AS (
  SELECT thread_id, count(*) AS topics, sum(polarization * participants) / sum(participants) AS p
  FROM summary GROUP BY thread_id),
c AS (SELECT thread_id, count(*) AS comments, avg(sentiment) AS s FROM analysed GROUP BY thread_id)
SELECT thread_id, comments, coalesce(topics, 0) AS topics, round(p, 6) AS avg_polarization,
  round(s, 6) AS avg_sentiment FROM c LEFT JOIN k USING (thread_id)""")
def thread_kpis(spark, sf_dir):
    rows = t.analysed_table(spark, sf_dir)
    return report.thread_kpis(rows, given_summary(rows)).select(
        "thread_id", "comments", "topics", F.round("avg_polarization", 6).alias("avg_polarization"),
        F.round("avg_sentiment", 6).alias("avg_sentiment"))


@query(f"""WITH {SUMMARY} SELECT thread_id, cluster, keywords, upvotes, participants, polarization, sentiment,
  CASE WHEN polarization > 6 THEN 'high' WHEN polarization > 3 THEN 'moderate' ELSE 'low' END AS band, core
FROM summary""")
def topic_cards(spark, sf_dir):
    return report.topic_cards(given_summary(t.analysed_table(spark, sf_dir)))


@query(f"""WITH {SUMMARY}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY upvotes DESC, cluster) AS rk FROM summary),
js AS (SELECT thread_id, string_agg(concat('{{"id":', cluster, ',"keywords":"', keywords, '","participants":',
  participants, ',"polarization":', CAST(polarization AS VARCHAR), '}}'), ',' ORDER BY rk) AS topics
  FROM ranked WHERE rk <= 6 GROUP BY thread_id),
n AS (SELECT thread_id, count(*) AS clusters FROM summary GROUP BY thread_id),
c AS (SELECT thread_id, count(*) AS comments FROM analysed GROUP BY thread_id)
SELECT thread_id, concat('{{"clusters":', coalesce(clusters, 0), ',"comments":', comments, ',"topics":[', coalesce(topics, ''), ']}}') AS context
FROM c LEFT JOIN js USING (thread_id) LEFT JOIN n USING (thread_id)""")
def topic_context(spark, sf_dir):
    rows = t.analysed_table(spark, sf_dir)
    return report.topic_context(given_summary(rows), rows)


@query(f"""WITH {t.ANALYSED}, {t.CENTROIDS}, pairs AS (
  SELECT a.thread_id, a.cluster::INTEGER AS topic_a, b.cluster::INTEGER AS topic_b,
    list_cosine_similarity(a.centre, b.centre) AS sim
  FROM centroids a JOIN centroids b ON a.thread_id = b.thread_id AND a.cluster < b.cluster)
SELECT thread_id, topic_a, topic_b, round(sim, 6) AS sim, round(sim, 2) AS weight, round(sim * 5, 6) AS width
FROM pairs WHERE sim > 0.1""")
def topic_network_edges(spark, sf_dir):
    edges = network.topic_network_edges(t.analysed(spark, sf_dir), min_sim=0.1)
    return edges.withColumn("sim", F.round("sim", 6)).withColumn("width", F.round("width", 6))


@query(f"""WITH {SUMMARY}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY upvotes DESC, cluster) AS rank,
    count(*) OVER (PARTITION BY thread_id) AS topics FROM summary)
SELECT thread_id, cluster, rank, topics, round(cos(2 * pi() * (rank - 1) / topics), 6) + 0 AS x,
  round(sin(2 * pi() * (rank - 1) / topics), 6) + 0 AS y,
  round(greatest(8.0, least(60.0, 5 * sqrt(participants))), 6) AS size, keywords, participants, polarization
FROM placed""")
def topic_network_nodes(spark, sf_dir):
    nodes = network.topic_network_nodes(given_summary(t.analysed_table(spark, sf_dir)))
    return nodes.select(
        "thread_id", "cluster", "rank", "topics", (F.round("x", 6) + 0).alias("x"),
        (F.round("y", 6) + 0).alias("y"), F.round("size", 6).alias("size"), "keywords",
        "participants", "polarization")


# Greedy packing as a walk from text to text.
@query(f"""WITH RECURSIVE {t.CLEAN},
texts AS (SELECT thread_id, comment_key, body_clean AS text, length(body_clean) AS n,
  row_number() OVER (PARTITION BY thread_id ORDER BY comment_key) AS rn FROM clean),
walk AS (
  SELECT thread_id, comment_key, rn, 0::BIGINT AS chunk_id, n AS used, text FROM texts WHERE rn = 1
  UNION ALL
  SELECT x.thread_id, x.comment_key, x.rn,
    CASE WHEN w.used + x.n > 8000 THEN w.chunk_id + 1 ELSE w.chunk_id END,
    CASE WHEN w.used + x.n > 8000 THEN x.n ELSE w.used + x.n END, x.text
  FROM walk w JOIN texts x ON x.thread_id = w.thread_id AND x.rn = w.rn + 1)
SELECT thread_id, chunk_id, count(*) AS n_texts, string_agg(text, chr(10) ORDER BY rn) AS text
FROM walk GROUP BY thread_id, chunk_id""")
def text_chunks(spark, sf_dir):
    rows = t.clean(spark, sf_dir).select("thread_id", "comment_key", F.col("body_clean").alias("text"))
    return report.text_chunks(written(rows, "texts"))


@query(f"""WITH {t.ANALYSED},
texts AS (SELECT thread_id, cluster, comment_key, body_clean AS text,
  row_number() OVER w AS rn, sum(length(body_clean)) OVER w AS run FROM topical
  WINDOW w AS (PARTITION BY thread_id, cluster ORDER BY comment_key))
SELECT thread_id, cluster::INTEGER AS cluster, count(*) AS n_texts, string_agg(text, chr(10) ORDER BY rn) AS text
FROM texts WHERE rn <= 60 AND (run <= 9000 OR rn = 1) GROUP BY ALL""")
def topic_sample(spark, sf_dir):
    return report.topic_sample(t.analysed(spark, sf_dir))
