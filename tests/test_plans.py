"""Skew-safe joins, running totals, quantiles, components, chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import report
from threadloom.plans import components, ordered, skew, tiles
from threadloom.plans.components import connected_components


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    # Key 0 holds a third of the rows; some rows have no key or no partner.
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).alias("k"),
        F.col("id"))
    right = spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    hot = skew.hot_keys(skew.key_counts(left, ["k"]), ["k"], min_rows=10)
    assert 0 < hot.count() < skew.HOT_SHARE and hot.filter("k = 0").first()["_parts"] > 1
    got = skew.salted_join(left, right, ["k"], ["id"], how, min_rows=10).select("k", "id", "v")
    assert rows(got) == rows(left.join(right, "k", how).select("k", "id", "v"))


def test_running_total_and_rank_over_a_hot_group(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id").alias("o"), (F.col("id") % 11).alias("v"))
    got = {(r["k"], r["o"]): r["s"] for r in ordered.running_total(df, ["k"], ["o"], F.col("v"), "s", 16).collect()}
    totals, want = {}, {}
    for r in df.orderBy("o").collect():
        totals[r["k"]] = totals.get(r["k"], 0) + r["v"]
        want[r["k"], r["o"]] = totals[r["k"]]
    assert got == want
    ranks = sorted(r["rank"] for r in ordered.rank_rows(df, ["k"], ["o"], partitions=16).filter("k = 'hot'").collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_exact_quantiles(spark):
    rng = random.Random(3)
    data = [("a", rng.choice([0.0, 0.0, rng.random()])) for _ in range(501)] + [("b", 1.5)] + [("c", None)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE")
    got = {r["k"]: r for r in ordered.exact_quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}, 6).collect()}
    values = [v for k, v in data if k == "a"]
    for name, p in (("q1", 25), ("m", 50), ("q3", 75)):
        assert got["a"][name] == pytest.approx(np.percentile(values, p), abs=1e-12)
        assert got["b"][name] == 1.5
    assert "c" not in got


def test_every_pair_of_rows_meets_in_exactly_one_tile(spark):
    df = spark.range(60).select(F.when(F.col("id") < 50, "a").otherwise("b").alias("g"), F.col("id"))
    blocked = tiles.with_blocks(df, ["g"], "id", block_rows=8, min_hot_rows=5)
    met = {}
    for r in tiles.to_tiles(blocked).collect():
        met.setdefault((r["g"], r["_lo"], r["_hi"]), []).append((r["id"], r["_block"]))
    seen = {}
    for (g, lo, hi), members in met.items():
        for a, block_a in members:
            for b, block_b in members:
                if a < b and {block_a, block_b} == {lo, hi}:
                    seen[a, b] = seen.get((a, b), 0) + 1
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a < 50) == (b < 50)}
    assert set(seen) == want and set(seen.values()) == {1}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [("s", i, i + 1) for i in range(30)] + [("s", 100, 200 + i) for i in range(20)] + [("s", 500, 500)]
    edges += [("r", i + 1, i) for i in range(5)]
    rng.shuffle(edges)
    got = {(r["k"], r["node"]): r["label"] for r in connected_components(
        spark.createDataFrame(edges, "k STRING, u LONG, v LONG"), ["k"]).collect()}
    assert all(got["s", i] == 0 for i in range(31))
    assert all(got["s", 200 + i] == 100 for i in range(20))
    assert got["s", 500] == 500 and got["r", 5] == 0 and len(got) == 31 + 21 + 1 + 6


def test_small_tables_of_the_rounds_are_few_files(spark, monkeypatch):
    # Few links dealt over many partitions, which Spark is kept from joining again.
    held, keep = [], components.cut_lineage

    def counted(df):
        held.append(keep(df))
        return held[-1]

    monkeypatch.setattr(components, "cut_lineage", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components.connected_components(spark.range(60).selectExpr("id AS u", "id + 1 AS v"), [], most=60)
        found = {(r["node"], r["label"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {(i, 0) for i in range(61)}
    assert len(held) > 3 and all(len(df.inputFiles()) == 1 for df in held)


def test_blocks_in_order_share_a_file(spark, monkeypatch):
    held, keep = [], ordered.cut_lineage

    def counted(df):
        held.append(keep(df))
        return held[-1]

    monkeypatch.setattr(ordered, "cut_lineage", counted)
    got = ordered.rank_rows(spark.range(1000), [], ["id"], partitions=8, rows=1000)
    assert sorted(map(tuple, got.collect())) == [(i, i + 1) for i in range(1000)]
    assert held[0].select("_block").distinct().count() == 8 and len(held[0].inputFiles()) == 1


def packed(texts, limit):
    out, current, used = [], [], 0
    for value in texts:
        if not value.strip():
            continue
        if used + len(value) > limit and current:
            out.append("\n".join(current))
            current, used = [], 0
        current.append(value)
        used += len(value)
    return out + (["\n".join(current)] if current else [])


@pytest.mark.parametrize("limit", [1, 17, 60, 400])
@pytest.mark.parametrize("partitions", [1, 13])
def test_chunks_equal_sequential_packing(spark, limit, partitions):
    rng = random.Random(limit)
    data = []
    for key in range(700):
        thread = "hot" if key % 3 else f"t{key % 4}"
        size = rng.choice([0, 1, 1, 3, 8, 20, 90])
        data.append((thread, key, rng.choice(["x", "é", " x"])[-1] * size if size else "  "))
    df = spark.createDataFrame(data, "thread_id STRING, comment_key LONG, text STRING")
    got = {}
    for r in report.text_chunks(df, limit, partitions).collect():
        got.setdefault(r["thread_id"], {})[r["chunk_id"]] = r["text"]
    for thread in {d[0] for d in data}:
        want = packed([d[2] for d in data if d[0] == thread], limit)
        assert [got.get(thread, {})[i] for i in range(len(want))] == want
        assert len(got.get(thread, {})) == len(want)


def test_topic_sample_stops_at_the_first_text_that_does_not_fit(spark):
    data = [("t", 0, i, c * n) for i, (c, n) in enumerate([("a", 50), ("b", 60), ("c", 5)])]
    data += [("t", 1, 10, "z" * 200), ("t", 1, 11, "y")]
    df = spark.createDataFrame(data, "thread_id STRING, cluster INT, comment_key LONG, body_clean STRING")
    got = {r["cluster"]: r["text"] for r in report.topic_sample(df, n=60, max_chars=100).collect()}
    assert got == {0: "a" * 50, 1: "z" * 200}


def test_shuffles_do_not_stay_beside_a_written_table(spark):
    import time

    from threadloom import session

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, held = disk.getAllFiles().size(), spark.conf.get(session.DROP_SHUFFLES, None)
    df = spark.range(50_000).repartition(6).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s"))
    table = session.written(df, "kept")
    until = time.time() + 10
    while disk.getAllFiles().size() > before and time.time() < until:
        time.sleep(.1)
    assert disk.getAllFiles().size() <= before and spark.conf.get(session.DROP_SHUFFLES, None) == held
    assert table.count() == 997 == session.written(df, "again").count()  # the same frame may be written twice


def test_tables_of_a_step_go_once_its_result_is_written(spark):
    from pathlib import Path

    from threadloom import session

    files = lambda table: [Path(f.removeprefix("file:")) for f in table.inputFiles()]
    df = spark.range(10)
    with session.passing(spark) as lasting:
        a, b = session.written(df, "a"), session.written(df, "b")
        with session.passing(spark, opened=False) as inner:
            c0 = session.written(df, "c0")
            c = inner(c0.union(a), "c")
        held = {name: files(table) for name, table in (("a", a), ("b", b), ("c0", c0), ("c", c))}
        session.spent(a)
        assert {name: any(f.exists() for f in at) for name, at in held.items()} == {"a": False, "b": True, "c0": False, "c": True}
        out = lasting(b.union(c), "out")
    assert out.count() == 30 and not any(f.exists() for at in held.values() for f in at)
    with session.passing(spark, opened=False) as lasting:
        kept = session.written(df, "kept")
        session.spent(kept)
    assert lasting is session.written and kept.count() == 10
