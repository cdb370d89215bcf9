"""Queries over comment rows: filters, cleaning, reply tree, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import tables as t
from threadloom.functions import text
from threadloom.functions.text import NOT_WHITESPACE
from threadloom.operators import comments as ops
from threadloom.sources import sink
from threadloom.session import scratch_path

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query(f"""WITH {t.COMMENTS} SELECT comment_key, thread_id, body FROM comments
WHERE body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]')
  AND regexp_matches(body, '{NOT_WHITESPACE}')""")
def body_filters(spark, sf_dir):
    return ops.body_filters(t.comments(spark, sf_dir)).select("comment_key", "thread_id", "body")


@query(f"""WITH {t.COMMENTS} SELECT comment_key, thread_id, body FROM comments
WHERE body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]', 'nan', 'None')""")
def sentinel_filter(spark, sf_dir):
    return ops.sentinel_filter(t.comments(spark, sf_dir)).select("comment_key", "thread_id", "body")


@query(f"WITH {t.COMMENTS} SELECT comment_key, {t.clean_sql('body')} AS body_clean FROM comments")
def clean_text(spark, sf_dir):
    return t.comments(spark, sf_dir).select(
        "comment_key", text.clean_text(F.col("body")).alias("body_clean"))


@query(f"""WITH {t.CLEAN} SELECT comment_key, id, thread_id, subreddit, author, score, created_utc,
  body_clean, word_count FROM clean""")
def preprocess(spark, sf_dir):
    return t.clean(spark, sf_dir).select(
        "comment_key", "id", "thread_id", "subreddit", "author", "score", "created_utc",
        "body_clean", "word_count")


@query(f"""WITH {t.CLEAN} SELECT comment_key, CAST(CASE WHEN body_clean = '' THEN 0
  ELSE len(string_split(body_clean, ' ')) END AS INTEGER) AS word_count FROM cleaned""")
def word_count(spark, sf_dir):
    rows = ops.sentinel_filter(t.comments(spark, sf_dir))
    return rows.select("comment_key", text.word_count(text.clean_text(F.col("body"))).alias("word_count"))


@query(f"WITH RECURSIVE {t.COMMENTS}, {t.DEPTHS} SELECT comment_key, depth, reason FROM all_depths")
def reply_depth(spark, sf_dir):
    return ops.reply_depth(t.comments(spark, sf_dir))


@query(f"""WITH {t.COMMENTS} SELECT c.comment_key, c.thread_id, count(r.comment_key) AS replies_count
FROM comments c LEFT JOIN comments r ON r.parent_key = c.comment_key GROUP BY ALL""")
def reply_counts(spark, sf_dir):
    return ops.reply_counts(t.comments(spark, sf_dir)).select("comment_key", "thread_id", "replies_count")


@query(f"""WITH {t.COMMENTS}, p AS (SELECT *, {t.PARENT_ID} AS parent_id FROM comments)
SELECT comment_key, thread_id, parent_id, starts_with(parent_id, 't3_') AS is_root_comment FROM p""")
def root_comments(spark, sf_dir):
    return t.with_parent_id(t.comments(spark, sf_dir)).select(
        "comment_key", "thread_id", "parent_id",
        text.is_root(F.col("parent_id")).alias("is_root_comment"))


@query(f"""WITH {t.COMMENTS} SELECT comment_key, CASE WHEN created_utc <> 0
  THEN strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d %H:%M') END AS created_at FROM comments""")
def created_at_fmt(spark, sf_dir):
    return t.comments(spark, sf_dir).select(
        "comment_key", text.minute_string(F.col("created_utc")).alias("created_at"))


# Every seventh comment arrives as an expansion; some of them are in the base
# as well, and some carry no depth of their own.
@query(f"""WITH {t.COMMENTS},
base AS (SELECT id, thread_id, author, score, 0 AS depth FROM comments
         WHERE comment_key % 7 <> 0 OR comment_key % 21 = 0),
extra AS (SELECT id, thread_id, author, score, CASE WHEN comment_key % 2 = 0 THEN 3 ELSE 1 END AS depth
          FROM comments WHERE comment_key % 7 = 0)
SELECT * FROM base UNION ALL SELECT * FROM extra""")
def merge_expansions(spark, sf_dir):
    base, extra = _expansion_parts(spark, sf_dir)
    return ops.merge_expansions(base, extra)


@query(f"""WITH {t.COMMENTS},
base AS (SELECT id, thread_id, author, score, 0 AS depth FROM comments
         WHERE comment_key % 7 <> 0 OR comment_key % 21 = 0),
extra AS (SELECT id, thread_id, author, score, CASE WHEN comment_key % 2 = 0 THEN 3 ELSE 1 END AS depth
          FROM comments WHERE comment_key % 7 = 0)
SELECT * FROM base UNION ALL
SELECT * FROM extra e WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.id = e.id AND b.thread_id = e.thread_id)""")
def merge_expansions_dedupe(spark, sf_dir):
    base, extra = _expansion_parts(spark, sf_dir)
    return ops.merge_expansions(base, extra, dedupe=True)


def _expansion_parts(spark, sf_dir):
    rows = t.comments(spark, sf_dir)
    keep = ["id", "thread_id", "author", "score"]
    k = F.col("comment_key")
    base = rows.filter((k % 7 != 0) | (k % 21 == 0)).select(*keep, F.lit(0).alias("depth"))
    extra = rows.filter(k % 7 == 0).select(*keep, F.when(k % 2 == 0, 3).alias("depth"))
    return base, extra


@query(f"""WITH {t.COMMENTS}, ranked AS (
  SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY comment_key) AS rn FROM comments)
SELECT thread_id, CAST(floor((rn - 1) / 20) AS INTEGER) AS batch, string_agg(id, ',' ORDER BY rn) AS child_ids
FROM ranked GROUP BY ALL""")
def continuation_batches(spark, sf_dir):
    ids = t.comments(spark, sf_dir).select(
        "thread_id", F.col("comment_key").alias("pos"), F.col("id").alias("child_id"))
    return ops.continuation_batches(ids, batch_size=20).withColumn(
        "child_ids", F.array_join("child_ids", ","))


# Every fifth comment was asked for; those whose key is even came back.
@query(f"""WITH {t.COMMENTS} SELECT thread_id, id AS child_id FROM comments WHERE comment_key % 5 = 0 AND comment_key % 2 = 1""")
def missing_continuations(spark, sf_dir):
    rows = t.comments(spark, sf_dir)
    asked = rows.filter("comment_key % 5 = 0").select("thread_id", F.col("id").alias("child_id"))
    return ops.missing_continuations(asked, rows.filter("comment_key % 2 = 0"))


@query("""SELECT concat('v', conv_id) AS thread_id, count(*) AS num_comments
FROM conversations GROUP BY conv_id HAVING count(*) >= 5""")
def thread_gate(spark, sf_dir):
    posts = t._load(spark, sf_dir, "conversations").groupBy(
        F.concat(F.lit("v"), "conv_id").alias("thread_id")).agg(F.count(F.lit(1)).alias("num_comments"))
    return ops.thread_gate(posts, min_comments=5)


@query(f"""WITH {t.COMMENTS}, posts AS (
  SELECT thread_id, count(*) AS num_comments, min(subreddit) AS post_subreddit FROM comments GROUP BY thread_id)
SELECT c.comment_key, c.thread_id, p.num_comments, p.post_subreddit FROM comments c JOIN posts p USING (thread_id)""")
def post_comment_join(spark, sf_dir):
    rows = t.comments(spark, sf_dir)
    posts = rows.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("num_comments"), F.min("subreddit").alias("post_subreddit"))
    return ops.join_posts(rows, posts).select("comment_key", "thread_id", "num_comments", "post_subreddit")


@query(f"""WITH {t.COMMENTS} SELECT comment_key, thread_id, len(embedding)::INTEGER AS dims,
  round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS squared_length
FROM comments WHERE embedding IS NOT NULL""")
def embed_join(spark, sf_dir):
    rows = t.comments(spark, sf_dir)
    vecs = t._load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("comment_key"), "embedding")
    squares = F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return ops.embed_join(rows, vecs).select(
        "comment_key", "thread_id", F.size("embedding").alias("dims"),
        F.round(squares, 6).alias("squared_length"))


@query(f"""WITH {t.ANALYSED} SELECT thread_id, comment_key, cluster::INTEGER AS cluster, score, sentiment,
  word_count, body_clean FROM analysed""")
def sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "analysed")
    rows = t.analysed(spark, sf_dir).select(
        "thread_id", "comment_key", "cluster", "score", "sentiment", "word_count", "body_clean")
    sink.write_result(rows, path)
    return sink.read_result(spark, path)
