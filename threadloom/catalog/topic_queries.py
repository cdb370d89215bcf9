"""Queries over topics: statistics, quotes, keywords, polarization, lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import tables as t
from threadloom.operators import keywords as kw
from threadloom.operators import lexicon as lex
from threadloom.operators import polarization as pol
from threadloom.operators import topics as ops

QUERIES, ORACLE = {}, {}
TOPIC = "thread_id, cluster::INTEGER AS cluster"
STOP = list(t.STOP_WORDS)


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


# --- statistics and quotes --------------------------------------------------

@query(f"WITH {t.ANALYSED} SELECT DISTINCT {TOPIC} FROM topical")
def topic_ids(spark, sf_dir):
    return ops.topic_ids(t.analysed(spark, sf_dir))


@query(f"""WITH {t.ANALYSED}, {t.CENTROIDS}
SELECT {TOPIC}, unnest(range(len(centre)))::INTEGER AS dim, round(unnest(centre), 6) AS value, n FROM centroids""")
def topic_centroids(spark, sf_dir):
    return ops.topic_centroids(t.analysed(spark, sf_dir)).select(
        "thread_id", "cluster", "n", F.posexplode("centroid").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


DIST = f"""{t.CENTROIDS},
dist AS (SELECT v.thread_id, v.cluster, v.comment_key, v.body_clean, list_distance(v.embedding, c.centre) AS dist
         FROM vecs v JOIN centroids c USING (thread_id, cluster))"""
CORE = "arg_min(body_clean, (dist, comment_key))"
DISSENT = "arg_max(body_clean, (dist, -comment_key))"
POPULAR = "arg_max(body_clean, (score, -comment_key)) FILTER (WHERE score IS NOT NULL)"


@query(f"WITH {t.ANALYSED}, {DIST} SELECT {TOPIC}, {CORE} AS core FROM dist GROUP BY ALL")
def topic_core(spark, sf_dir):
    return ops.quotes(t.analysed_table(spark, sf_dir)).select("thread_id", "cluster", "core")


@query(f"WITH {t.ANALYSED}, {DIST} SELECT {TOPIC}, {DISSENT} AS dissent FROM dist GROUP BY ALL")
def topic_dissent(spark, sf_dir):
    return ops.quotes(t.analysed_table(spark, sf_dir)).select("thread_id", "cluster", "dissent")


@query(f"WITH {t.ANALYSED} SELECT {TOPIC}, {POPULAR} AS popular FROM topical GROUP BY ALL")
def topic_popular(spark, sf_dir):
    return ops.popular(t.analysed(spark, sf_dir))


STATS = "CAST(sum(score) AS BIGINT) AS upvotes, count(*) AS participants, round(avg(sentiment), 3) AS sentiment"


@query(f"WITH {t.ANALYSED} SELECT {TOPIC}, {STATS} FROM topical GROUP BY ALL")
def topic_stats(spark, sf_dir):
    return ops.topic_stats(t.analysed(spark, sf_dir)).drop("sentiment_raw")


# --- keywords ----------------------------------------------------------------

VOCAB = f"""{t.TOKENS},
tf AS (SELECT thread_id, cluster, comment_key, term, count(*) AS tf FROM tokens GROUP BY ALL),
vocab AS (SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY thread_id, cluster ORDER BY total DESC, term) AS INTEGER) AS vocab_rank
  FROM (SELECT thread_id, cluster, term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tf GROUP BY ALL)))"""
TFIDF = f"""{VOCAB},
sizes AS (SELECT thread_id, cluster, count(*) AS n_docs FROM topical GROUP BY ALL),
raw AS (SELECT tf.thread_id, tf.cluster, comment_key, term, n_docs,
    tf.tf * (ln((1 + n_docs) / (1 + df)) + 1) AS raw
  FROM tf JOIN vocab USING (thread_id, cluster, term) JOIN sizes USING (thread_id, cluster)),
tfidf AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY thread_id, cluster, comment_key)) AS weight FROM raw),
weights AS (SELECT thread_id, cluster, term, sum(weight) / max(n_docs) AS weight FROM tfidf GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (
  PARTITION BY thread_id, cluster ORDER BY round(weight, 12) DESC, term) AS INTEGER) AS rank FROM weights)"""


@query(f"""WITH {t.ANALYSED}, {t.TOKENS}
SELECT {TOPIC}, comment_key, term, count(*) AS n FROM tokens GROUP BY ALL""")
def topic_tokens(spark, sf_dir):
    tokens = kw.topic_tokens(ops.topic_rows(t.analysed(spark, sf_dir)), STOP)
    return tokens.groupBy("thread_id", "cluster", "comment_key", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {t.ANALYSED}, {t.TOKENS}
SELECT {TOPIC}, term, count(*) AS n FROM tokens GROUP BY ALL""")
def topic_terms(spark, sf_dir):
    """The stop words as a table."""
    words = spark.createDataFrame([(w,) for w in [*STOP, STOP[0]]], "term STRING")
    tokens = kw.topic_tokens(ops.topic_rows(t.analysed(spark, sf_dir)), words)
    return tokens.groupBy("thread_id", "cluster", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {t.ANALYSED}, {VOCAB} SELECT {TOPIC}, term, total, df, vocab_rank FROM vocab")
def topic_vocab(spark, sf_dir):
    rows = ops.topic_rows(t.analysed(spark, sf_dir))
    return kw.topic_vocabulary(kw.term_counts(kw.topic_tokens(rows, STOP)))


@query(f"WITH {t.ANALYSED}, {TFIDF} SELECT {TOPIC}, comment_key, term, round(weight, 6) AS weight FROM tfidf")
def topic_tfidf(spark, sf_dir):
    return kw.tfidf(ops.topic_rows(t.analysed_table(spark, sf_dir)), STOP).select(
        "thread_id", "cluster", "comment_key", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {t.ANALYSED}, {TFIDF} SELECT {TOPIC}, rank, term, round(weight, 6) AS weight,
  round(weight / max(weight) OVER (PARTITION BY thread_id, cluster), 6) AS relative FROM best WHERE rank <= 15""")
def keyword_bar(spark, sf_dir):
    return kw.keyword_bar(ops.topic_rows(t.analysed_table(spark, sf_dir)), 15, STOP).select(
        "thread_id", "cluster", "rank", "term", F.round("weight", 6).alias("weight"),
        F.round("relative", 6).alias("relative"))


KEYWORDS = """keywords AS (SELECT s.thread_id, s.cluster, coalesce(k.keywords, 'misc') AS keywords FROM sizes s LEFT JOIN (
  SELECT thread_id, cluster, string_agg(term, ', ' ORDER BY rank) AS keywords
  FROM best WHERE rank <= 5 GROUP BY ALL) k USING (thread_id, cluster))"""


@query(f"WITH {t.ANALYSED}, {TFIDF}, {KEYWORDS} SELECT {TOPIC}, keywords FROM keywords")
def topic_keywords(spark, sf_dir):
    return kw.topic_keywords(ops.topic_rows(t.analysed_table(spark, sf_dir)), stop_words=STOP)


# --- polarization --------------------------------------------------------------

SEPARATION = f"""
ccent AS ({t.mean_vectors_sql('camps', 'thread_id, cluster, camp')}),
within AS (SELECT thread_id, cluster, camp, avg(list_distance(embedding, centre)) AS w
  FROM camps JOIN ccent USING (thread_id, cluster, camp) GROUP BY ALL),
sep AS (SELECT a.thread_id, a.cluster,
    coalesce(list_distance(max(CASE WHEN a.camp = 0 THEN centre END), max(CASE WHEN a.camp = 1 THEN centre END)), 0) AS d,
    (coalesce(max(CASE WHEN a.camp = 0 THEN w END), 0) + coalesce(max(CASE WHEN a.camp = 1 THEN w END), 0)) / 2 AS w
  FROM ccent a JOIN within USING (thread_id, cluster, camp) GROUP BY ALL)"""
BALANCE = """
sizes2 AS (SELECT thread_id, cluster, count(*) FILTER (WHERE camp = 0) AS n1, count(*) FILTER (WHERE camp = 1) AS n2
  FROM camps GROUP BY ALL),
balance AS (SELECT *, 2 * least(n1, n2) / (n1 + n2) AS balance FROM sizes2)"""
SILHOUETTE = """
mates AS (SELECT a.thread_id, a.cluster, a.comment_key, a.camp, b.camp AS other,
    sum(list_distance(a.embedding, b.embedding)) AS s, count(*) AS n
  FROM camps a JOIN camps b USING (thread_id, cluster) WHERE a.comment_key <> b.comment_key GROUP BY ALL),
ab AS (SELECT thread_id, cluster, comment_key,
    max(CASE WHEN camp = other THEN s / n END) AS a, max(CASE WHEN camp <> other THEN s / n END) AS b
  FROM mates GROUP BY ALL),
sil AS (SELECT c.thread_id, c.cluster,
    avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette
  FROM camps c LEFT JOIN ab USING (thread_id, cluster, comment_key) GROUP BY ALL)"""
POLARIZATION = f"""{BALANCE}, {SEPARATION}, {SILHOUETTE},
pol AS (SELECT thread_id, cluster, CASE WHEN n1 + n2 >= 10 AND d > 0 THEN
    greatest(0.0, least(10.0, d / (w + 1e-9) * balance * greatest(0.0, (silhouette + 1) / 2) * 12)) ELSE 0.0 END AS raw
  FROM balance JOIN sep USING (thread_id, cluster) JOIN sil USING (thread_id, cluster))"""


@query(f"WITH {t.CAMPS}, {BALANCE} SELECT {TOPIC}, n1, n2, round(balance, 6) AS balance FROM balance")
def camp_balance(spark, sf_dir):
    return pol.camp_balance(t.camps(t.analysed(spark, sf_dir))).withColumn("balance", F.round("balance", 6))


@query(f"WITH {t.CAMPS}, {SEPARATION} SELECT {TOPIC}, round(d, 6) AS d, round(w, 6) AS w FROM sep")
def camp_separation(spark, sf_dir):
    return pol.camp_separation(t.camps(t.analysed_table(spark, sf_dir))).select(
        "thread_id", "cluster", F.round("d", 6).alias("d"), F.round("w", 6).alias("w"))


@query(f"WITH {t.CAMPS}, {SILHOUETTE} SELECT {TOPIC}, round(silhouette, 6) AS silhouette FROM sil")
def camp_silhouette(spark, sf_dir):
    return pol.camp_silhouette(t.camps(t.analysed_table(spark, sf_dir))).withColumn("silhouette", F.round("silhouette", 6))


@query(f"""WITH {t.CAMPS}, {POLARIZATION}
SELECT {TOPIC}, round(raw, 6) AS polarization_raw, round(raw, 2) AS polarization FROM pol""")
def topic_polarization(spark, sf_dir):
    return pol.polarization_from_camps(t.camps(t.analysed_table(spark, sf_dir))).select(
        "thread_id", "cluster", F.round("polarization_raw", 6).alias("polarization_raw"), "polarization")


@query(f"""WITH {t.CAMPS}, {POLARIZATION}, p AS (SELECT thread_id, cluster, round(raw * 4, 2) AS polarization FROM pol)
SELECT {TOPIC}, polarization,
  CASE WHEN polarization > 6 THEN 'high' WHEN polarization > 3 THEN 'moderate' ELSE 'low' END AS band,
  CASE WHEN polarization > 5 THEN 'dissenting' ELSE 'alternative' END AS dissent_label,
  CASE WHEN polarization < 3 THEN 'low' WHEN polarization < 7 THEN 'middle' ELSE 'high' END AS gauge_zone FROM p""")
def polarization_bands(spark, sf_dir):
    # Scaled by 4, so that the random vectors of the test data reach all bands.
    scored = pol.polarization_from_camps(t.camps(t.analysed_table(spark, sf_dir))).select(
        "thread_id", "cluster", F.round(F.col("polarization_raw") * 4, 2).alias("polarization"))
    return pol.bands(scored)


# Topics of few rows, and of equal ones, beside others.
GUARDED = t.CAMPS.replace("vecs AS (SELECT thread_id, cluster, comment_key, CAST(embedding AS DOUBLE[]) AS embedding,", """\
vecs AS (SELECT thread_id, comment_key % 20 AS cluster, comment_key,
  CASE WHEN comment_key % 20 = 7 THEN [1.0, 2.0]::DOUBLE[] ELSE CAST(embedding AS DOUBLE[])[1:2] END AS embedding,""")


@query(f"""WITH {GUARDED}, {POLARIZATION}
SELECT thread_id, cluster::INTEGER AS cluster, round(raw, 6) AS polarization_raw FROM pol""")
def guarded_polarization(spark, sf_dir):
    part = F.col("comment_key") % 20
    vector = F.when(part == 7, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.slice("embedding", 1, 2).cast("array<double>"))
    rows = t.camps(t.analysed_table(spark, sf_dir)).withColumn("cluster", part.cast("int")).withColumn("embedding", vector)
    return pol.polarization_from_camps(rows).select(
        "thread_id", "cluster", F.round("polarization_raw", 6).alias("polarization_raw"))


@query()
def two_camps(spark, sf_dir):
    return pol.two_camps(t.vecs(t.analysed_table(spark, sf_dir)))


def _fixed_start_sql(rounds):
    text = f"""WITH {t.ANALYSED},
c0 AS (SELECT thread_id, cluster, arg_min(embedding, comment_key) AS first, arg_max(embedding, comment_key) AS second
  FROM vecs GROUP BY ALL)"""
    assign = """(SELECT v.thread_id, v.cluster, v.comment_key, v.embedding, CASE WHEN list_distance(v.embedding, c.first)
      <= list_distance(v.embedding, c.second) THEN 0 ELSE 1 END AS camp
    FROM vecs v JOIN c{n} c USING (thread_id, cluster))"""
    for n in range(rounds):
        text += f""",
a{n} AS {assign.format(n=n)},
m{n} AS ({t.mean_vectors_sql(f'a{n}', 'thread_id, cluster, camp')}),
c{n + 1} AS (SELECT c.thread_id, c.cluster, coalesce(x.centre, c.first) AS first, coalesce(y.centre, c.second) AS second
  FROM c{n} c LEFT JOIN m{n} x ON x.thread_id = c.thread_id AND x.cluster = c.cluster AND x.camp = 0
  LEFT JOIN m{n} y ON y.thread_id = c.thread_id AND y.cluster = c.cluster AND y.camp = 1)"""
    return text + f"""
SELECT {TOPIC}, comment_key, camp::INTEGER AS camp FROM {assign.format(n=rounds)}"""


@query(_fixed_start_sql(3))
def two_camps_fixed(spark, sf_dir):
    return pol.fixed_start_camps(t.vecs(t.analysed_table(spark, sf_dir)), rounds=3)


@query()
def fitted_polarization(spark, sf_dir):
    return pol.polarization(t.vecs(t.analysed_table(spark, sf_dir)))


# --- summary ---------------------------------------------------------------------

SUMMARY = f"""{t.CAMPS}, {DIST}, {TFIDF}, {KEYWORDS}, {POLARIZATION},
stats AS (SELECT thread_id, cluster, {STATS}, {POPULAR} AS popular FROM topical GROUP BY ALL),
ends AS (SELECT thread_id, cluster, {CORE} AS core, {DISSENT} AS dissent FROM dist GROUP BY ALL),
summary AS (SELECT s.thread_id, s.cluster::INTEGER AS cluster, CAST(row_number() OVER (
    PARTITION BY s.thread_id ORDER BY upvotes DESC NULLS LAST, s.cluster) AS INTEGER) AS rank, keywords, upvotes, participants,
    coalesce(round(raw, 2), 0.0) AS polarization, sentiment, popular, core, dissent
  FROM stats s LEFT JOIN keywords USING (thread_id, cluster) LEFT JOIN pol USING (thread_id, cluster)
  LEFT JOIN ends USING (thread_id, cluster))"""


def given_summary(rows):
    """Topic summary with the camps given instead of fitted."""
    return ops.topic_summary(rows, pol.polarization_from_camps(t.camps(rows)), stop_words=STOP)


@query(f"WITH {SUMMARY} SELECT * FROM summary")
def topic_summary(spark, sf_dir):
    return given_summary(t.analysed_table(spark, sf_dir))


@query(f"WITH {SUMMARY} SELECT * FROM summary".replace("WHERE cluster <> -1)", "WHERE cluster <> -1 AND thread_id <> 't0')"))
def noise_thread_summary(spark, sf_dir):
    """A thread of noise alone has no row, the others have theirs."""
    noise = F.when(F.col("thread_id") == "t0", -1).otherwise(F.col("cluster"))
    return given_summary(t.analysed_table(spark, sf_dir).withColumn("cluster", noise))


@query(f"""WITH {SUMMARY} SELECT a.thread_id, a.comment_key, a.cluster::INTEGER AS cluster, a.score, a.body_clean,
  s.keywords AS topic_keywords, s.upvotes AS topic_upvotes, s.participants AS topic_participants,
  s.polarization AS topic_polarization
FROM analysed a JOIN summary s ON s.thread_id = a.thread_id AND s.cluster = a.cluster WHERE a.cluster = 3""")
def topic_drilldown(spark, sf_dir):
    rows = t.analysed_table(spark, sf_dir)
    return ops.topic_drilldown(rows, given_summary(rows), 3).select(
        "thread_id", "comment_key", "cluster", "score", "body_clean", "topic_keywords",
        "topic_upvotes", "topic_participants", "topic_polarization")


# --- lexicons ----------------------------------------------------------------------

WORDS = f"""
listed AS (SELECT comment_key, regexp_extract_all(lower(body_clean), '{t.WORD}') AS ws FROM clean),
spread AS (SELECT comment_key, unnest(ws) AS term, generate_subscripts(ws, 1) AS i FROM listed),
placed AS (SELECT comment_key, term, lag(term, 1) OVER w AS prev, lag(term, 2) OVER w AS prev2
  FROM spread WINDOW w AS (PARTITION BY comment_key ORDER BY i))"""


@query(f"""WITH {t.CLEAN}, {t.SENTIMENT_LEXICON_SQL}, {WORDS},
scored AS (SELECT p.comment_key, greatest(-1.0, least(1.0, l.polarity::DOUBLE
    * CASE WHEN m.term IS NULL THEN 1.0 ELSE coalesce(m.intensity, 1.0) END
    * CASE WHEN coalesce(m.negates, false) OR (m.term IS NOT NULL AND NOT coalesce(m.negates, false)
        AND coalesce(m2.negates, false)) THEN -0.5 ELSE 1.0 END)) AS v
  FROM placed p JOIN sentiment_lexicon l ON l.term = p.term AND l.polarity IS NOT NULL
  LEFT JOIN sentiment_lexicon m ON m.term = p.prev AND (m.intensity IS NOT NULL OR m.negates)
  LEFT JOIN sentiment_lexicon m2 ON m2.term = p.prev2 AND (m2.intensity IS NOT NULL OR m2.negates))
SELECT comment_key, round(coalesce(avg(v), 0.0) + 1e-9, 6) AS sentiment
FROM clean LEFT JOIN scored USING (comment_key) GROUP BY comment_key""")
def comment_sentiment(spark, sf_dir):
    # Means of few decimals may lie half-way; the sum's order must not decide how they round.
    return lex.comment_sentiment(t.clean(spark, sf_dir), t.sentiment_lexicon(spark)).withColumn(
        "sentiment", F.round(F.col("sentiment") + 1e-9, 6))


EMOTIONS = f"""{t.EMOTION_LEXICON_SQL},
words AS (SELECT thread_id, cluster, unnest(regexp_extract_all(lower(body_clean), '{t.WORD}')) AS term FROM topical),

word_counts AS MATERIALIZED (SELECT thread_id, cluster, term, count(*) AS c FROM words GROUP BY ALL),
counts AS (SELECT w.thread_id, w.cluster, l.emotion, CAST(sum(w.c) AS BIGINT) AS n
  FROM word_counts w JOIN emotion_lexicon l ON l.term = w.term GROUP BY ALL)"""


def _emotions(spark, sf_dir):
    return lex.emotion_counts(ops.topic_rows(t.analysed(spark, sf_dir)), t.emotion_lexicon(spark))


@query(f"WITH {t.ANALYSED}, {EMOTIONS} SELECT {TOPIC}, emotion, n FROM counts")
def emotion_counts(spark, sf_dir):
    return _emotions(spark, sf_dir)


AXES = ", ".join(f"({i}, '{e}')" for i, e in enumerate(lex.EMOTIONS))


@query(f"""WITH {t.ANALYSED}, {EMOTIONS}, axes(position, emotion) AS (VALUES {AXES}),
totals AS (SELECT thread_id, cluster, sum(n) AS total FROM counts GROUP BY ALL),
radar AS (SELECT x.thread_id, x.cluster, a.position, a.emotion, coalesce(c.n, 0) * 100.0::DOUBLE / x.total AS percent
  FROM totals x CROSS JOIN axes a LEFT JOIN counts c
    ON c.thread_id = x.thread_id AND c.cluster = x.cluster AND c.emotion = a.emotion)
SELECT {TOPIC}, position::INTEGER AS position, emotion, round(percent, 6) AS percent,
  first_value(emotion) OVER (PARTITION BY thread_id, cluster ORDER BY percent DESC, position) AS peak,
  round(max(percent) OVER (PARTITION BY thread_id, cluster) + 8, 6) AS axis_max FROM radar""")
def emotion_radar(spark, sf_dir):
    radar = lex.emotion_radar(_emotions(spark, sf_dir))
    return radar.withColumn("percent", F.round("percent", 6)).withColumn("axis_max", F.round("axis_max", 6))


@query(f"""WITH {t.ANALYSED}, {EMOTIONS} SELECT {TOPIC}, emotion, n,
  round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY thread_id, cluster), 1) AS percent FROM counts""")
def emotion_distribution(spark, sf_dir):
    return lex.emotion_distribution(_emotions(spark, sf_dir)).drop("percent_raw")
