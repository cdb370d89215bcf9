"""Queries over landed thread documents and over the comment stream.

Spark turns every conversation into a nested JSON document, lands it as files
and reads it back. A conversation becomes two reply chains: even turns below
the first, odd turns below the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.catalog import tables as t
from threadloom.operators import comments as ops
from threadloom.session import scratch_path
from threadloom.sources import threads
from threadloom.streaming import activity

QUERIES, ORACLE = {}, {}
MIN_COMMENTS = 4


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def _children_json(prefix, n):
    """JSON list of ``n`` made-up ids."""
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit('"'), prefix, i.cast("string"), F.lit('"')))
    return F.concat(F.lit("["), F.when(n > 0, F.array_join(ids, ",")).otherwise(""), F.lit("]"))


def documents(spark, sf_dir) -> DataFrame:
    """(payload): one nested document per conversation, some of them broken."""
    c = F.col("conv_id")
    turns = t._load(spark, sf_dir, "conversations").select(
        c, (F.col("turn") % 2).alias("side"), "turn",
        F.to_json(F.struct(
            F.concat(F.lit("c"), c, F.lit("_"), "turn").alias("id"),
            F.when(F.col("turn") < 2, F.concat(F.lit("t3_v"), c)).otherwise(
                F.concat(F.lit("t1_c"), c, F.lit("_"), F.col("turn") - 2)).alias("parent_id"),
            F.col("role").alias("author"), F.col("text").alias("body"),
            F.when(F.col("turn") % 5 != 4, F.col("turn") * 3 - c % 7).alias("score"),
            F.when(F.col("turn") % 4 != 3, 1700000000 + c * 60 + F.col("turn") * 30).alias("created_utc"),
        )).alias("fields"))
    hidden = F.concat(
        F.lit(',"replies":{"data":{"children":[{"kind":"more","data":{"count":'), (c % 6).cast("string"),
        F.lit(',"children":'), _children_json(F.concat(F.lit("h"), c, F.lit("_"), "side", F.lit("_")), (c % 4).cast("int")),
        F.lit("}}]}}"))
    last = F.when(c % 3 == 0, F.lit(',"replies":""')).when(c % 3 == 1, hidden).otherwise("")

    def nest(inner, fields):
        # `inner` is the replies field of this node; the node becomes that of its parent.
        node = F.concat(F.lit('{"kind":"t1","data":'), F.regexp_replace(fields, "}$", ""), inner, F.lit("}}"))
        return F.concat(F.lit(',"replies":{"data":{"children":['), node, F.lit("]}}"))

    chains = turns.groupBy("conv_id", "side").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "fields")), asc=False),
                    lambda s: s["fields"]).alias("_f"))
    chains = chains.withColumn("_tree", F.aggregate("_f", last, nest)).withColumn(
        "chain", F.regexp_extract("_tree", r'(?s)^,"replies":\{"data":\{"children":\[(.*)\]\}\}$', 1))
    more = F.when(c % 4 == 0, F.concat(
        F.lit(',{"kind":"more","data":{"children":'),
        _children_json(F.concat(F.lit("r"), c, F.lit("_")), (c % 5).cast("int")), F.lit("}}"))).otherwise("")
    header = F.to_json(F.struct(
        F.concat(F.lit("v"), c).alias("id"), F.when(c % 2 == 0, F.concat(F.lit("conversation "), c)).alias("title"),
        F.when(c % 3 == 0, c * 2).alias("score"), F.col("n").alias("num_comments"),
        F.lit("conv").alias("subreddit")))
    whole = chains.groupBy("conv_id").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("side", "chain"))).alias("_c"))
    post = F.concat(F.lit('{"data":{"children":[{"data":'), header, F.lit("}]}}"))
    body = F.concat(
        F.lit("["), post, F.lit(',{"data":{"children":['), F.array_join(F.col("_c.chain"), ","), more, F.lit("]}}]"))
    broken = (
        F.when(c % 17 == 5, F.concat(F.lit("{not json "), c)).when(c % 17 == 6, F.concat(F.lit('{"id":'), c, F.lit("}")))
        .when(c % 17 == 7, F.concat(F.lit("["), post, F.lit("]"))).otherwise(body))
    return whole.select(broken.alias("payload"))


def landed(spark, sf_dir) -> DataFrame:
    """The documents as files, one per line, read back."""
    path = scratch_path(spark, "landed")
    documents(spark, sf_dir).write.text(path)
    return threads.read_thread_documents(spark, path, one_per_line=True)


def nodes(spark, sf_dir) -> DataFrame:
    return threads.nodes_of(threads.parse(landed(spark, sf_dir), MIN_COMMENTS))


CONV = f"""
conv AS (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY conv_id),
good AS (SELECT * FROM conv WHERE n >= {MIN_COMMENTS} AND c % 17 NOT IN (5, 6, 7)),
turns AS (SELECT c, n, turn, role, text, turn % 2 AS side, turn // 2 AS depth, turn >= n - 2 AS is_last
  FROM good JOIN conversations ON conv_id = c)"""


@query(f"""WITH {CONV} SELECT concat('v', c) AS thread_id, n AS num_comments FROM good""")
def thread_documents(spark, sf_dir):
    return threads.accepted(landed(spark, sf_dir), MIN_COMMENTS).select("thread_id", "num_comments")


@query(f"""WITH {CONV}, q AS (SELECT CASE WHEN c % 17 = 5 THEN 'not_json' WHEN c % 17 = 6 THEN 'not_a_list'
    WHEN c % 17 = 7 THEN 'too_short' WHEN n < {MIN_COMMENTS} THEN 'too_small' END AS reason,
  CASE WHEN c % 17 NOT IN (5, 6) THEN concat('v', c) END AS thread_id FROM conv)
SELECT * FROM q WHERE reason IS NOT NULL""")
def thread_quarantine(spark, sf_dir):
    return threads.quarantine(landed(spark, sf_dir), MIN_COMMENTS).select("thread_id", "reason")


@query(f"""WITH {CONV} SELECT concat('v', c) AS thread_id,
  CASE WHEN c % 2 = 0 THEN concat('conversation ', c) ELSE '' END AS title, '' AS text, '' AS author,
  CASE WHEN c % 3 = 0 THEN c * 2 ELSE 0 END AS score, n AS num_comments, 'conv' AS subreddit FROM good""")
def post_header(spark, sf_dir):
    return threads.post_headers(landed(spark, sf_dir), MIN_COMMENTS).drop("url")


# Positions count continuation nodes too: one at the end of each chain of every
# third conversation.
@query(f"""WITH {CONV} SELECT concat('v', c) AS thread_id, concat('c', c, '_', turn) AS id, CAST(depth AS INTEGER) AS depth,
  depth + CASE WHEN side = 1 THEN (n + 1) // 2 + CASE WHEN c % 3 = 1 THEN 1 ELSE 0 END ELSE 0 END AS pos FROM turns""")
def comment_tree_flatten(spark, sf_dir):
    return threads.comment_records(nodes(spark, sf_dir)).select("thread_id", "id", "depth", "pos")


@query(f"""WITH {CONV} SELECT concat('c', c, '_', turn) AS id, concat('v', c) AS thread_id, 'conv' AS subreddit,
  CASE WHEN turn < 2 THEN concat('t3_v', c) ELSE concat('t1_c', c, '_', turn - 2) END AS parent_id,
  turn < 2 AS is_root_comment, role AS author, text AS body,
  CASE WHEN turn % 5 <> 4 THEN turn * 3 - c % 7 ELSE 0 END AS score, CAST(depth AS INTEGER) AS depth,
  CASE WHEN NOT is_last THEN 1 WHEN c % 3 = 1 THEN c % 6 ELSE 0 END AS replies_count,
  CASE WHEN turn % 4 <> 3 THEN 1700000000 + c * 60 + turn * 30 ELSE 0 END::DOUBLE AS created_utc,
  CASE WHEN turn % 4 <> 3 THEN strftime(make_timestamp((1700000000 + c * 60 + turn * 30) * 1000000),
    '%Y-%m-%d %H:%M') END AS created_at FROM turns""")
def comment_records(spark, sf_dir):
    return threads.comment_records(nodes(spark, sf_dir)).drop("pos")


CONTINUATIONS = f"""{CONV}, ids AS (
  SELECT c, side, k, CASE WHEN side = 0 THEN (n + 1) // 2 ELSE n + 1 END AS node, concat('h', c, '_', side, '_', k) AS child_id
  FROM (SELECT DISTINCT c, n, side FROM turns WHERE c % 3 = 1), range(1, 4) r(k) WHERE k <= c % 4
  UNION ALL
  SELECT c, 2, k, n + CASE WHEN c % 3 = 1 THEN 2 ELSE 0 END, concat('r', c, '_', k) FROM good, range(1, 5) r(k) WHERE c % 4 = 0 AND k <= c % 5),
ranked AS (SELECT concat('v', c) AS thread_id, CAST(row_number() OVER (PARTITION BY c ORDER BY side, k) AS BIGINT) AS rn,
  child_id FROM ids)"""


@query(f"""WITH {CONTINUATIONS} SELECT concat('v', c) AS thread_id, node, CAST(k - 1 AS INTEGER) AS place, child_id
FROM ids""")
def continuation_ids(spark, sf_dir):
    return threads.continuation_ids(nodes(spark, sf_dir)).select(
        "thread_id", F.col("pos._node").alias("node"), F.col("pos._i").alias("place"), "child_id")


@query(f"""WITH {CONTINUATIONS} SELECT thread_id, CAST((rn - 1) // 2 AS INTEGER) AS batch,
  string_agg(child_id, ',' ORDER BY rn) AS child_ids FROM ranked GROUP BY ALL""")
def landed_continuation_batches(spark, sf_dir):
    ids = threads.continuation_ids(nodes(spark, sf_dir))
    return ops.continuation_batches(ids, batch_size=2).withColumn(
        "child_ids", F.array_join("child_ids", ","))


# A landed continuation result per conversation: its turns as a flat list.
@query("""SELECT concat('c', conv_id, '_', turn) AS id, concat('v', conv_id) AS thread_id,
  concat('t3_v', conv_id) AS parent_id, TRUE AS is_root_comment, text AS body, 0::BIGINT AS score,
  CAST(CASE WHEN turn % 2 = 0 THEN turn ELSE 1 END AS INTEGER) AS depth FROM conversations""")
def expansion_comments(spark, sf_dir):
    c = F.col("conv_id")
    data = F.to_json(F.struct(
        F.concat(F.lit("c"), c, F.lit("_"), "turn").alias("id"), F.concat(F.lit("t3_v"), c).alias("parent_id"),
        F.col("text").alias("body"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("depth")))
    node = F.concat(F.lit('{"kind":"t1","data":'), data, F.lit("}"))
    results = t._load(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.concat(F.lit('[{"kind":"more","data":{"count":3}},'), F.array_join(F.collect_list(node), ","), F.lit("]"))
        .alias("payload")).select(
        F.concat(F.lit("v"), c).alias("thread_id"), F.lit("conv").alias("subreddit"), "payload")
    return threads.expansion_comments(results).select(
        "id", "thread_id", "parent_id", "is_root_comment", "body", "score", "depth")


# One micro-batch: the bins that end by the last event less the lateness.
@query(f"""WITH {t.COMMENTS}, bins AS (
  SELECT thread_id, created_utc // 1800 * 1800 AS b, count(id) AS count, round(avg(score), 6) AS avg_score
  FROM comments WHERE created_utc > 0 GROUP BY ALL)
SELECT thread_id, strftime(make_timestamp(b * 1000000), '%Y-%m-%d %H:%M:%S') AS bin, count, avg_score
FROM bins WHERE b + 1800 <= (SELECT max(created_utc) FROM comments) - 3600""")
def stream_activity_timeline(spark, sf_dir):
    """The comments arrive as files; the closed bins come out."""
    arrived = scratch_path(spark, "arrived")
    rows = t.comments(spark, sf_dir).select("id", "thread_id", "score", "created_utc")
    rows.write.parquet(arrived)
    stream = spark.readStream.schema(rows.schema).parquet(arrived)
    out = scratch_path(spark, "bins")
    activity.run_available(
        activity.stream_activity_timeline(stream), out, scratch_path(spark, "stream-state"))
    return spark.read.parquet(out).select(
        "thread_id", F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin"), "count",
        F.round("avg_score", 6).alias("avg_score"))
