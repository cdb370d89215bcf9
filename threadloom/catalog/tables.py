"""Thread tables derived from the driver's tables, in Spark and in SQL.

The SQL constants are common table expressions for the oracle; each Spark
function below builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.functions.text import NOT_WHITESPACE, WHITESPACE, WORD
from threadloom.operators import comments as ops
from threadloom.session import written

THREAD_SIZE = 250

STOP_WORDS = (
    "the", "of", "and", "is", "in", "on", "it", "by", "for", "with", "are", "was", "this", "that",
    "der", "die", "und", "das", "von", "zu", "la", "le", "de", "les", "que", "et", "en", "un", "el", "los",
)


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- comments --------------------------------------------------------------

COMMENTS = f"""
comments AS (
  SELECT d.doc_id AS comment_key, concat('c', d.doc_id) AS id,
    concat('t', CAST(floor(d.doc_id / {THREAD_SIZE}) AS BIGINT)) AS thread_id, d.source AS subreddit,
    CASE WHEN d.doc_id % 250 < 10 THEN NULL
         WHEN d.doc_id % 250 < 200 THEN d.doc_id - d.doc_id % 250 + CAST(floor((d.doc_id % 250 - 10) / 3) AS BIGINT)
         WHEN d.doc_id % 250 = 247 THEN d.doc_id + 1 WHEN d.doc_id % 250 = 249 THEN -1 - d.doc_id
         ELSE d.doc_id - 1 END AS parent_key,
    CASE WHEN e.event_type = 'error' AND e.user_id % 5 = 0 THEN '[deleted]'
         WHEN e.event_type = 'signup' AND e.user_id % 5 = 0 THEN 'AutoModerator'
         WHEN e.event_type = 'view' AND e.user_id % 5 = 0 THEN NULL
         ELSE concat('u', e.user_id) END AS author,
    CASE d.doc_id % 40 WHEN 7 THEN '[deleted]' WHEN 13 THEN '[removed]' WHEN 17 THEN NULL
         WHEN 19 THEN 'nan' WHEN 23 THEN '   '
         WHEN 29 THEN concat(d.text, ' see [link](http://x.co/a) b) by /u/some_user *now*')
         ELSE d.text END AS body,
    CAST(floor(e.value) AS BIGINT) - 30 AS score,
    CASE WHEN d.doc_id % 50 = 0 THEN 0 ELSE CAST(floor(epoch(e.ts)) AS BIGINT) END AS created_utc,
    v.embedding AS embedding,
    CASE WHEN v.label IS NULL OR v.label = 9 THEN -1 ELSE v.label END AS cluster
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id)"""


def comments(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """One comment per document; ``vectors`` adds ``embedding`` and ``cluster``."""
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    events = _load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    d = F.col("doc_id")
    place = d % 250
    person = F.col("user_id") % 5 == 0
    kind = F.col("event_type")
    pick = d % 40
    # Both sides grow with the data, so neither may be broadcast.
    rows = docs.join(events.hint("merge"), docs["doc_id"] == events["event_id"]).select(
        d.alias("comment_key"), F.concat(F.lit("c"), d).alias("id"),
        F.concat(F.lit("t"), F.floor(d / THREAD_SIZE)).alias("thread_id"),
        F.col("source").alias("subreddit"),
        F.when(place < 10, F.lit(None).cast("long"))
        .when(place < 200, d - place + F.floor((place - 10) / 3))
        .when(place == 247, d + 1).when(place == 249, -1 - d)  # a cycle of two, and a parent that is not there
        .otherwise(d - 1).alias("parent_key"),
        F.when((kind == "error") & person, "[deleted]")
        .when((kind == "signup") & person, "AutoModerator")
        .when((kind == "view") & person, F.lit(None))
        .otherwise(F.concat(F.lit("u"), "user_id")).alias("author"),
        F.when(pick == 7, "[deleted]").when(pick == 13, "[removed]").when(pick == 17, F.lit(None))
        .when(pick == 19, "nan").when(pick == 23, "   ")
        .when(pick == 29, F.concat("text", F.lit(" see [link](http://x.co/a) b) by /u/some_user *now*")))
        .otherwise(F.col("text")).alias("body"),
        (F.floor("value").cast("long") - 30).alias("score"),
        F.when(d % 50 == 0, F.lit(0).cast("long")).otherwise(F.unix_timestamp("ts")).alias("created_utc"))
    if not vectors:
        return rows
    vecs = _load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("comment_key"), "embedding",
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"))
    return rows.join(vecs.hint("merge"), "comment_key", "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(-1)))


DEPTHS = """
depths AS (
  SELECT comment_key, 0 AS depth FROM comments WHERE parent_key IS NULL
  UNION ALL
  SELECT c.comment_key, p.depth + 1 FROM comments c JOIN depths p ON c.parent_key = p.comment_key),
all_depths AS (SELECT c.comment_key, d.depth, CASE WHEN d.depth IS NULL THEN
    CASE WHEN c.comment_key % 250 = 249 THEN 'no_parent' ELSE 'cycle' END END AS reason
  FROM comments c LEFT JOIN depths d USING (comment_key))"""


def with_depth(rows: DataFrame) -> DataFrame:
    return rows.join(ops.reply_depth(rows).drop("reason"), "comment_key")


PARENT_ID = "CASE WHEN parent_key IS NULL THEN concat('t3_', thread_id) ELSE concat('t1_c', parent_key) END"


def with_parent_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("parent_id", F.when(
        F.col("parent_key").isNull(), F.concat(F.lit("t3_"), "thread_id")).otherwise(
        F.concat(F.lit("t1_c"), "parent_key")))


# --- cleaned and analysed comments -----------------------------------------

def clean_sql(body: str) -> str:
    out = f"coalesce({body}, '')"
    for pattern, new in (
        (f"http{NOT_WHITESPACE}+", ""),
        (r"\[([^\]]+)\]\([^\)]+\)", r"\1"),
        (r"[*_#~>]", ""),
        (r"/[ur]/[A-Za-z0-9_-]+", ""),
        (f"{WHITESPACE}+", " "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim({out}, ' ')"


CLEAN = f"""{COMMENTS},
cleaned AS (
  SELECT *, {clean_sql('body')} AS body_clean FROM comments
  WHERE body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]', 'nan', 'None')),
clean AS (
  SELECT *, CAST(len(string_split(body_clean, ' ')) AS INTEGER) AS word_count FROM cleaned
  WHERE length(body_clean) > 0 AND len(string_split(body_clean, ' ')) >= 5)"""

SENTIMENT = "greatest(-1.0::DOUBLE, least(1.0::DOUBLE, round((score % 21)::DOUBLE / 10.0, 2)))"

ANALYSED = f"""{CLEAN},
analysed AS (SELECT *, {SENTIMENT} AS sentiment FROM clean),
topical AS (SELECT * FROM analysed WHERE cluster <> -1),
vecs AS (SELECT thread_id, cluster, comment_key, CAST(embedding AS DOUBLE[]) AS embedding, body_clean
         FROM topical WHERE embedding IS NOT NULL)"""


def clean(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    return ops.preprocess(comments(spark, sf_dir, vectors))


def analysed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``analysed`` as a written table, for queries that read it several times."""
    return written(analysed(spark, sf_dir), "analysed")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned comments with a topic, a vector and a sentiment in [-1, 1]."""
    rate = F.round((F.col("score") % 21).cast("double") / 10.0, 2)
    return clean(spark, sf_dir, vectors=True).withColumn(
        "sentiment", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rate)))


def vecs(rows: DataFrame) -> DataFrame:
    """Topic members that have a vector."""
    return rows.filter("cluster <> -1 AND embedding IS NOT NULL")


CAMPS = ANALYSED + ",\ncamps AS (SELECT *, CAST(comment_key % 2 AS INTEGER) AS camp FROM vecs)"


def camps(rows: DataFrame) -> DataFrame:
    """Topic members with a given camp."""
    return vecs(rows).withColumn("camp", (F.col("comment_key") % 2).cast("int"))


def mean_vectors_sql(source: str, keys: str) -> str:
    """Element-wise mean of ``embedding`` per keys, as a list."""
    return f"""SELECT {keys}, list(m ORDER BY i) AS centre, max(n) AS n FROM (
      SELECT {keys}, i, avg(v) AS m, count(*) AS n FROM (
        SELECT {keys}, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM {source})
      GROUP BY {keys}, i) GROUP BY {keys}"""


CENTROIDS = f"centroids AS ({mean_vectors_sql('vecs', 'thread_id, cluster')})"

TOKENS = f"""
tokens AS (
  SELECT thread_id, cluster, comment_key, term FROM (
    SELECT thread_id, cluster, comment_key,
           unnest(regexp_extract_all(lower(body_clean), '{WORD}')) AS term FROM topical)
  WHERE term NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}))"""

# --- lexicons (made up over the words of the synthetic text) -----------------

SENTIMENT_LEXICON = (
    # term, polarity, intensity, negates
    ("rewh", 0.8, None, None), ("orre", -0.6, None, None), ("ononst", 0.4, None, None),
    ("inoran", -0.3, None, None), ("hehely", 0.15, None, None), ("orantion", -0.9, None, None),
    ("tion", 0.25, None, None), ("ther", -0.05, None, None), ("erin", 0.7, None, None),
    ("dans", -0.4, None, None), ("und", 0.1, None, None), ("the", 0.02, None, None),
    ("thth", None, 1.5, None), ("pour", None, 0.5, None), ("nicht", None, None, True),
    ("of", None, 1.3, None), ("not", None, None, True), ("is", None, None, True),
    # listed twice, and scored words that also change the next one
    ("rewh", 0.4, None, None), ("of", None, 1.1, None), ("and", 0.2, 1.5, None), ("to", -0.1, None, True),
)
EMOTION_LEXICON = (
    ("rewh", "joy"), ("rewh", "positive"), ("orre", "anger"), ("orre", "negative"), ("ononst", "trust"),
    ("inoran", "fear"), ("inoran", "negative"), ("hehely", "surprise"), ("orantion", "sadness"),
    ("tion", "anticipation"), ("ther", "disgust"), ("thth", "trust"), ("sich", "positive"),
    ("pour", "joy"), ("erin", "fear"), ("eren", "anticipation"), ("dans", "surprise"),
    ("nicht", "negative"), ("the", "positive"),
)


def sentiment_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SENTIMENT_LEXICON, "term STRING, polarity DOUBLE, intensity DOUBLE, negates BOOLEAN")


def emotion_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMOTION_LEXICON, "term STRING, emotion STRING")


def _sql_values(rows) -> str:
    def cell(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


SENTIMENT_LEXICON_SQL = (
    f"listed_terms(term, polarity, intensity, negates) AS (VALUES {_sql_values(SENTIMENT_LEXICON)}),\n"
    "sentiment_lexicon AS (SELECT term, avg(polarity::DOUBLE) AS polarity, max(intensity::DOUBLE) AS intensity,\n"
    "  coalesce(bool_or(negates), false) AS negates FROM listed_terms GROUP BY term)")
EMOTION_LEXICON_SQL = f"emotion_lexicon(term, emotion) AS (VALUES {_sql_values(EMOTION_LEXICON)})"
