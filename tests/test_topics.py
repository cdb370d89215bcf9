"""Polarization, clusters, keywords, lexicons and summaries on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import clusters, engagement, keywords, lexicon, network, report, topics
from threadloom.operators import polarization as pol
from threadloom.operators import vectors as vec
from threadloom.plans.pipeline import Analysis, analyse

VECS = "thread_id STRING, cluster INT, comment_key LONG, embedding ARRAY<FLOAT>"


def vectors(spark, groups, schema=VECS):
    data, key = [], 0
    for (thread, cluster), points in groups.items():
        for p in points:
            data.append((thread, cluster, key, [float(np.float32(x)) for x in p]))
            key += 1
    return spark.createDataFrame(data, schema)


def blobs(rng, *specs):
    return np.vstack([rng.normal(c, s, (n, 6)) for c, s, n in specs])


def numpy_score(points, camp):
    points, camp = np.asarray(points, dtype="float32").astype(float), np.asarray(camp)
    centre = [points[camp == c].mean(axis=0) for c in (0, 1)]
    gap = np.linalg.norm(centre[0] - centre[1])
    w = np.mean([np.linalg.norm(points[camp == c] - centre[c], axis=1).mean() for c in (0, 1)])
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    sil = []
    for i in range(len(points)):
        own = (camp == camp[i]).sum() - 1
        if own == 0:
            sil.append(0.0)
            continue
        a, b = dist[i][camp == camp[i]].sum() / own, dist[i][camp != camp[i]].mean()
        sil.append((b - a) / max(a, b))
    sizes = [(camp == c).sum() for c in (0, 1)]
    balance = 2 * min(sizes) / sum(sizes)
    return min(10.0, max(0.0, gap / (w + 1e-9) * balance * max(0.0, (np.mean(sil) + 1) / 2) * 12)), np.mean(sil)


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_score_and_silhouette_equal_numpy(spark, block_rows):
    rng = np.random.default_rng(0)
    groups = {("a", 0): blobs(rng, (0, 1, 25), (0.4, 1, 15)), ("a", 1): blobs(rng, (0, 1, 13)),
              ("b", 0): blobs(rng, (0, .3, 9), (1, .3, 1))}
    df = vectors(spark, groups).withColumn("camp", (F.col("comment_key") % 3 == 0).cast("int"))
    got = {(r["thread_id"], r["cluster"]): r for r in pol.polarization_from_camps(df, block_rows=block_rows).collect()}
    key = 0
    for name, points in groups.items():
        camp = [int(k % 3 == 0) for k in range(key, key + len(points))]
        key += len(points)
        score, sil = numpy_score(points, camp)
        assert got[name]["polarization_raw"] == pytest.approx(score, abs=1e-6)
        assert got[name]["silhouette"] == pytest.approx(sil, abs=1e-6)


def test_score_needs_ten_rows_and_spread(spark):
    rng = np.random.default_rng(1)
    two = lambda n: np.vstack([rng.normal(0, .1, (n // 2, 4)), rng.normal(3, .1, (n - n // 2, 4))])
    df = vectors(spark, {("a", 0): two(9), ("a", 1): two(10), ("a", 2): np.ones((12, 4))})
    got = {r["cluster"]: r["polarization"] for r in pol.polarization(df).collect()}
    assert got[0] == 0.0 and got[2] == 0.0
    assert got[1] == 10.0


@pytest.mark.parametrize("fit_rows", [20_000, 16])
def test_two_camps_find_planted_camps(spark, fit_rows):
    rng = np.random.default_rng(2)
    groups = {("a", 0): blobs(rng, (0, .2, 30), (2, .2, 20)), ("a", 1): blobs(rng, (0, .2, 8), (1, .2, 6)),
              ("b", 0): blobs(rng, (-1, .1, 40), (1, .1, 40))}
    df = vectors(spark, groups)
    camps = {r["comment_key"]: r["camp"] for r in pol.two_camps(df, fit_rows).collect()}
    assert len(camps) == df.count()
    for lo, mid, hi in ((0, 30, 50), (50, 58, 64), (64, 104, 144)):
        first, second = {camps[k] for k in range(lo, mid)}, {camps[k] for k in range(mid, hi)}
        assert len(first) == len(second) == 1 and first != second


def test_split_fit_reaches_the_same_inertia(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (40, 3))
    df = vectors(spark, {("a", 0): points})

    def inertia(fit_rows):
        camp = np.array([r["camp"] for r in pol.two_camps(df, fit_rows).orderBy("comment_key").collect()])
        return sum(((points[camp == c] - points[camp == c].mean(axis=0)) ** 2).sum() for c in (0, 1))

    assert inertia(11) == pytest.approx(inertia(20_000), rel=1e-6)


def test_equal_inertia_is_decided_alike_at_every_size(spark):
    # a square: both ways to halve it are equally good
    corners = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    df = vectors(spark, {("a", 0): np.repeat(corners, 10, axis=0), ("b", 1): np.repeat(corners * 2, 6, axis=0)})
    one, many = ({(r["thread_id"], r["comment_key"]): r["camp"] for r in pol.two_camps(df, n).collect()} for n in (20_000, 7))
    assert one == many


def test_vectors_stay_where_they_are(spark):
    df = vectors(spark, {("a", 0): np.random.default_rng(1).normal(0, 1, (60, 3))})
    packed = pol.packed_blocks(df.withColumn("_block", F.col("comment_key").cast("int") % 4))
    states = packed.select("thread_id", "cluster").distinct().withColumn("restart", F.lit(0))
    met = pol.meet(packed, states, lambda topic, keys, points, states: None, "thread_id STRING")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def brute_clusters(points):
    """The clustering rule written plainly, from the widest group down, over all pairs of rows."""
    n = len(points)
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    core = np.array([np.sort(np.delete(dist[i], i))[clusters.MIN_SIZE - 1] for i in range(n)])
    meet = np.maximum(dist, np.maximum(core[:, None], core[None]))
    for k in range(n):  # the least distance at which two rows are in one group
        meet = np.minimum(meet, np.maximum(meet[:, k, None], meet[None, k]))
    per = lambda d: 1 / d if d > 0 else np.inf

    def run(rows, birth):
        """(best total, topics) of the run that begins below ``birth`` with these rows, and of the runs inside."""
        own = 0.0
        while True:
            inner = meet[np.ix_(rows, rows)]
            t = inner[~np.eye(len(rows), dtype=bool)].max() if len(rows) > 1 else 0.0
            label = np.array([np.flatnonzero((inner[i] < t) | (np.arange(len(rows)) == i))[0] for i in range(len(rows))])
            parts = [rows[label == x] for x in set(label.tolist())]
            large = [p for p in parts if len(p) >= clusters.MIN_SIZE]
            left = len(rows) - (len(large[0]) if len(large) == 1 else 0)
            own += left * (per(t) - per(birth)) if left else 0.0
            if len(large) == 1:
                own_rows, rows = rows, large[0]
                first = own_rows if "first" not in locals() else first
                continue
            whole = rows if "first" not in locals() else first
            below = [run(p, t) for p in large]
            total = sum(b for b, _ in below)
            if birth < np.inf and own >= total:
                return own, [frozenset(map(int, whole))]
            return max(own, total), [c for _, chosen in below for c in chosen]

    return set(run(np.arange(n), np.inf)[1])


def cluster_sets(df):
    found = {}
    for r in df.collect():
        if r["cluster"] >= 0:
            found.setdefault((r["thread_id"], r["cluster"]), set()).add(r["comment_key"])
    return found


@pytest.mark.parametrize("block_rows, range_edges", [(2048, 200_000), (23, 200_000), (2048, 17), (40, 30)])
def test_clusters_equal_brute_force(spark, block_rows, range_edges):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 0.6, (4, 5))
    points = np.round(np.vstack(
        [rng.normal(c, s, (n, 5)) for c, s, n in zip(centres, (.03, .05, .08, .02), (20, 15, 30, 6))]
        + [rng.uniform(-1, 1, (20, 5)), np.repeat(centres[:1] + .4, 9, axis=0)]), 6)
    data = [("a", i, p.tolist()) for i, p in enumerate(points)] + [("b", 1000 + i, p.tolist()) for i, p in enumerate(points[:4])]
    df = spark.createDataFrame(data, "thread_id STRING, comment_key LONG, coords ARRAY<DOUBLE>").repartition(5)
    out = clusters.density_clusters(df, block_rows, range_edges)
    assert out.count() == len(data)
    found = cluster_sets(out)
    assert {frozenset(v) for v in found.values()} == brute_clusters(points)
    assert all(len(v) >= clusters.MIN_SIZE for v in found.values())
    assert {k[0] for k in found} == {"a"} and {k[1] for k in found} == set(range(len(found)))


def test_planted_blobs_become_topics(spark):
    rng = np.random.default_rng(11)
    data, key = [], 0
    for centre in np.eye(5)[:3]:
        for _ in range(30):
            data.append(("t", key, (centre + rng.normal(0, .02, 5)).tolist()))
            key += 1
    df = spark.createDataFrame(data, "thread_id STRING, comment_key LONG, coords ARRAY<DOUBLE>")
    labels = {r["comment_key"]: r["cluster"] for r in clusters.density_clusters(df).collect()}
    for b in range(3):
        members = [labels[k] for k in range(30 * b, 30 * b + 30)]
        assert max(members.count(c) for c in set(members) - {-1}) >= 27


@pytest.mark.parametrize("inside, gap", [(.70, .95), (.72, .95), (.004, .010)])
def test_pairs_of_groups_at_any_distance_are_two_topics(spark, inside, gap):
    # six points of equal distances ``inside``, and the same again ``gap`` away
    corners = np.hstack([np.eye(6) * inside / np.sqrt(2), np.zeros((6, 1))])
    points = np.vstack([corners, corners + np.eye(7)[6] * gap])
    data = [("t", i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(data, "thread_id STRING, comment_key LONG, coords ARRAY<DOUBLE>")
    assert sorted(map(sorted, cluster_sets(clusters.density_clusters(df)).values())) == [list(range(6)), list(range(6, 12))]


def test_equal_distances_come_together_at_once(spark):
    grid = [(float(x), float(y)) for x in range(6) for y in range(6)]
    points = np.array(grid + [(x + 20, y) for x, y in grid] + [(100., 100.)])
    data = [("t", i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(data, "thread_id STRING, comment_key LONG, coords ARRAY<DOUBLE>")
    for block_rows, range_edges in ((2048, 200_000), (20, 10)):
        found = cluster_sets(clusters.density_clusters(df, block_rows, range_edges))
        assert {frozenset(v) for v in found.values()} == brute_clusters(points)


def test_a_thread_without_structure_is_noise(spark):
    data = [("t", i, [0.5] * 5) for i in range(40)] + [("u", 100 + i, [float(i), 0., 0., 0., 0.]) for i in range(4)]
    df = spark.createDataFrame(data, "thread_id STRING, comment_key LONG, coords ARRAY<DOUBLE>")
    assert {r["cluster"] for r in clusters.density_clusters(df).collect()} == {-1}
    assert clusters.density_clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [4096, 12])
def test_projection_equals_numpy(spark, block_rows):
    rng = np.random.default_rng(3)
    points = rng.normal(0, [4, 3, 2, 1, .5, .1], (40, 6)).astype("float32")
    df = vectors(spark, {("t", 0): points})
    got = np.array([r["coords"] for r in vec.project(df, k=3, block_rows=block_rows).orderBy("comment_key").collect()])
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    centred = unit - unit.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=2e-6)


def test_projection_pads_small_threads(spark):
    df = vectors(spark, {("t", 0): [[1, 0, 0], [0, 1, 0]]})
    assert all(len(r["coords"]) == 5 for r in vec.project(df).collect())


def docs(spark, texts, cluster=0):
    return spark.createDataFrame(
        [("t", cluster, i, x) for i, x in enumerate(texts)],
        "thread_id STRING, cluster INT, comment_key LONG, body_clean STRING")


def test_tfidf_weights_by_hand(spark):
    df = docs(spark, ["cat cat dog", "dog"])
    got = {(r["comment_key"], r["term"]): r["weight"] for r in keywords.tfidf(df, []).collect()}
    cat = 2 * (np.log(3 / 2) + 1)
    assert got[0, "cat"] == pytest.approx(cat / np.hypot(cat, 1))
    assert got[1, "dog"] == pytest.approx(1.0)
    mean = {r["term"]: r["weight"] for r in keywords.term_weights(df, []).collect()}
    assert mean["cat"] == pytest.approx(cat / np.hypot(cat, 1) / 2)


def test_vocabulary_cap_and_stop_words(spark):
    df = docs(spark, ["aa aa bb cc the", "bb dd a I x1 né"])
    terms = {r["term"] for r in keywords.topic_tokens(df, ["the"]).collect()}
    assert terms == {"aa", "bb", "cc", "dd", "x1", "né"}
    stop = spark.createDataFrame([("the",), ("aa",)], "term STRING")
    assert "aa" not in {r["term"] for r in keywords.topic_tokens(df, stop).collect()}
    vocab = keywords.topic_vocabulary(keywords.term_counts(keywords.topic_tokens(df, ["the"])), 2)
    assert {r["term"] for r in vocab.collect()} == {"aa", "bb"}


def test_keywords_are_misc_when_only_stop_words(spark):
    assert keywords.topic_keywords(docs(spark, ["the the"])).first()["keywords"] == "misc"


SENTIMENT = [("good", .7, None, None), ("bad", -.6, None, None), ("very", None, 1.5, None), ("not", None, None, True)]


@pytest.mark.parametrize("words, value", [
    ("good", .7), ("good bad", .05), ("very good", 1.0), ("very bad", -.9), ("not good", -.35),
    ("not very bad", .45), ("not so good", .7), ("plain words", 0.0), ("", 0.0), ("GOOD", .7)])
def test_sentiment_modifiers(spark, words, value):
    lex = spark.createDataFrame(SENTIMENT, "term STRING, polarity DOUBLE, intensity DOUBLE, negates BOOLEAN")
    assert lexicon.comment_sentiment(docs(spark, [words]), lex).first()["sentiment"] == pytest.approx(value)


def test_radar_percentages_cover_all_categories(spark):
    lex = spark.createDataFrame(
        [("a1", "fear"), ("a1", "negative"), ("b1", "joy"), ("b1", "positive"), ("c1", "joy")], "term STRING, emotion STRING")
    counts = lexicon.emotion_counts(docs(spark, ["a1 b1", "c1 zz"]), lex)
    radar = {r["emotion"]: r for r in lexicon.emotion_radar(counts).collect()}
    assert len(radar) == 8 and radar["joy"]["percent"] == 40.0 and radar["anger"]["percent"] == 0.0
    assert sum(r["percent"] for r in radar.values()) == 60.0
    assert radar["joy"]["peak"] == "joy" and radar["joy"]["axis_max"] == 48.0
    dist = {r["emotion"]: r["percent"] for r in lexicon.emotion_distribution(counts).collect()}
    assert dist == {"fear": 20.0, "negative": 20.0, "joy": 40.0, "positive": 20.0}


ANALYSED = ("thread_id STRING, cluster INT, comment_key LONG, id STRING, author STRING, body_clean STRING, score LONG, "
            "sentiment DOUBLE, embedding ARRAY<FLOAT>")


def analysed(spark):
    data = [("t", 0, 1, "a", "x", "first words here", 5, .2, [1., 0.]), ("t", 0, 2, "b", "x", "second words here", 5, .4, [1., .1]),
            ("t", 0, 3, "c", "x", "third words here", None, None, [0., 3.]), ("t", 1, 4, "d", "y", "other topic text", 50, .1, [1., 0.]),
            ("t", -1, 5, "e", "y", "noise text", 99, .3, [9., 9.]), ("u", -1, 6, "f", "y", "only noise", 1, .5, [1., 1.])]
    return spark.createDataFrame(data, ANALYSED)


def test_summary_semantics(spark):
    got = topics.topic_summary(analysed(spark)).collect()
    assert [r["cluster"] for r in got] == [1, 0]
    row = got[1]
    assert row["participants"] == 3 and row["upvotes"] == 10 and row["sentiment"] == 0.3
    assert row["popular"] == "first words here" and row["dissent"] == "third words here"
    assert row["core"] == "second words here" and row["polarization"] == 0.0


def test_all_noise_gives_an_empty_summary(spark):
    out = topics.topic_summary(analysed(spark).filter("cluster = -1"))
    assert out.count() == 0 and "polarization" in out.columns


def test_kpis_include_noise_in_sentiment_only(spark):
    df = analysed(spark)
    kpis = {r["thread_id"]: r for r in report.thread_kpis(df, topics.topic_summary(df)).collect()}
    assert kpis["t"]["comments"] == 5 and kpis["t"]["topics"] == 2
    assert kpis["t"]["avg_sentiment"] == pytest.approx(.25)
    assert kpis["u"]["topics"] == 0 and kpis["u"]["avg_polarization"] is None


def test_edges_use_the_default_threshold_and_tiles_agree(spark):
    rng = np.random.default_rng(4)
    data = [("t", i, rng.normal(0, 1, 4).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "thread_id STRING, cluster INT, centroid ARRAY<DOUBLE>")
    unit = np.array([d[2] for d in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if unit[i] @ unit[j] > .45}
    for block_rows in (2048, 9):
        got = [(r["topic_a"], r["topic_b"]) for r in network.topic_edges(df, block_rows=block_rows).collect()]
        assert len(got) == len(want) and set(got) == want


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 3.01, 5.0, 5.01, 6.0, 6.01, 7.0)], "polarization DOUBLE")
    rows = pol.bands(df).collect()
    assert [r["band"] for r in rows] == ["low", "moderate", "moderate", "moderate", "moderate", "high", "high"]
    assert [r["dissent_label"] for r in rows][2:4] == ["alternative", "dissenting"]
    assert rows[0]["gauge_zone"] == "middle" and rows[-1]["gauge_zone"] == "high"


def test_analysis_of_small_threads_and_reload(spark, tmp_path):
    words = {0: "apples pears plums cherries fruit", 1: "engines wheels brakes petrol cars", 2: "rivers lakes oceans water swimming"}
    rng = np.random.default_rng(9)
    data = []
    for i in range(90):
        pick = rng.permutation(words[i % 3].split())
        data.append((i, f"c{i}", "t", " ".join([*pick, pick[0]]), i, "u", 1700000000))
    df = spark.createDataFrame(
        data, "comment_key LONG, id STRING, thread_id STRING, body STRING, score LONG, author STRING, created_utc LONG")
    lex = spark.createDataFrame(SENTIMENT, "term STRING, polarity DOUBLE, intensity DOUBLE, negates BOOLEAN")
    result = analyse(df, lex)
    assert result.analysed.count() == 90
    assert engagement.opinion_map(result.analysed).count() == 90
    kinds = [set(r["keywords"].split(", ")) for r in result.summary.collect()]
    assert len(kinds) >= 3 and all(any(k <= set(w.split()) for w in words.values()) for k in kinds)
    result.save(str(tmp_path))
    again = Analysis.load(spark, str(tmp_path))
    assert again.summary.count() == len(kinds) and again.analysed.count() == 90


def test_comments_without_a_vector_stay_as_noise(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"c{i}", "t", f"word{i} of a longer text here", 1, "u", 0) for i in range(30)]
    df = spark.createDataFrame(
        rows, "comment_key LONG, id STRING, thread_id STRING, body STRING, score LONG, author STRING, created_utc LONG")
    lex = spark.createDataFrame(SENTIMENT, "term STRING, polarity DOUBLE, intensity DOUBLE, negates BOOLEAN")
    vecs = spark.createDataFrame(
        [(i, rng.normal(i % 2 * 10 - 5, 0.4, 6).tolist()) for i in range(24)], "comment_key LONG, embedding ARRAY<FLOAT>")
    got = {r["comment_key"]: r for r in analyse(df, lex, embeddings=vecs).analysed.collect()}
    assert sorted(got) == list(range(30))
    assert all(got[i]["cluster"] == -1 and got[i]["x"] is None for i in range(24, 30))
    assert {got[i]["cluster"] for i in range(24)} == {0, 1}


def test_a_scored_word_also_changes_the_next_and_repeats_count_once(spark):
    lex = spark.createDataFrame(
        [("good", 0.5, None, None), ("very", 0.2, 1.5, None), ("bad", -0.4, None, None), ("bad", -0.8, None, None)],
        "term STRING, polarity DOUBLE, intensity DOUBLE, negates BOOLEAN")
    df = spark.createDataFrame([(1, "very good"), (2, "bad thing"), (3, "nothing here")], "comment_key LONG, body_clean STRING")
    got = {r["comment_key"]: r["sentiment"] for r in lexicon.comment_sentiment(df, lex).collect()}
    assert got == pytest.approx({1: (0.2 + 0.75) / 2, 2: -0.6, 3: 0.0})


def counted(spark, df, column):
    """The rows with an accumulator that counts how often each is made."""
    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    return df.withColumn(column, F.udf(seen, "string").asNondeterministic()(column)), made


def given_summaries(spark):
    return spark.createDataFrame(
        [(f"t{i % 3}", i, "a, b", 10 * i, i + 1, 2.5) for i in range(12)],
        "thread_id STRING, cluster INT, keywords STRING, upvotes LONG, participants LONG, polarization DOUBLE")


def test_nodes_make_the_summary_once(spark):
    summary, made = counted(spark, given_summaries(spark), "thread_id")
    assert len(network.topic_network_nodes(summary).collect()) == 12 and made.value == 12


def test_context_makes_the_summary_once(spark):
    summary, made = counted(spark, given_summaries(spark), "thread_id")
    assert len(report.topic_context(summary, given_summaries(spark)).collect()) == 3 and made.value == 12


def test_weights_read_the_texts_once(spark):
    rows = spark.createDataFrame([(f"t{i % 2}", 1, i, f"red blue word{i}") for i in range(8)],
                                 "thread_id STRING, cluster INT, comment_key LONG, body_clean STRING")
    rows, made = counted(spark, rows, "body_clean")
    assert len(keywords.term_weights(rows).collect()) == 12 and made.value == 8


def test_terms_are_counted_again_only_for_large_topics(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 0, i, "red blue" if i % 2 else "red") for i in range(6)],
                                 "thread_id STRING, cluster INT, comment_key LONG, body_clean STRING")
    counted, joined = [], keywords.salted_join

    def seen(left, right, on, spread, how="inner", counts=None, **more):
        counted.append({r["term"]: r["_n"] for r in counts.collect()})
        return joined(left, right, on, spread, how, counts, 2, **more)

    monkeypatch.setattr(keywords, "salted_join", seen)
    found = [sorted((r["comment_key"], r["term"], round(r["weight"], 9)) for r in keywords.tfidf(rows, []).collect())]
    monkeypatch.setattr(keywords, "HOT_MIN_ROWS", 5)
    found.append(sorted((r["comment_key"], r["term"], round(r["weight"], 9)) for r in keywords.tfidf(rows, []).collect()))
    assert counted == [{}, {"red": 6, "blue": 3}] and found[0] == found[1] and len(found[0]) == 9


def test_words_before_a_scored_one_come_without_a_function_of_each_word(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "not very good"), (4, None), (5, "! ?"), (6, "very good not")],
                                 "comment_key LONG, body_clean STRING")
    terms = spark.createDataFrame([("good", .5, None, None), ("very", None, 1.5, None), ("not", None, None, True)],
                                  "term STRING, polarity DOUBLE, intensity DOUBLE, negates BOOLEAN")
    found = lexicon.comment_sentiment(rows, terms)
    assert "lambdafunction" not in found._jdf.queryExecution().toString()
    assert {r["comment_key"]: r["sentiment"] for r in found.collect()} == {1: .5, 2: -.25, 3: -.375, 4: 0, 5: 0, 6: .75}
