"""Landed documents, the written result and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import comments as ops
from threadloom.operators import engagement as eng
from threadloom.plans.pipeline import read_comments
from threadloom.sources import sink, threads
from threadloom.streaming import activity


def comment(id, replies=None, **data):
    node = {"id": id, "parent_id": "t3_p", "author": "a", "body": f"body {id}", "score": 1, "created_utc": 60, **data}
    if replies is not None:
        node["replies"] = replies
    return {"kind": "t1", "data": node}


def listing(*children):
    return {"data": {"children": list(children)}}


def more(children=None, count=None):
    data = {} if children is None else {"children": children}
    return {"kind": "more", "data": data if count is None else {**data, "count": count}}


def thread(*children, num_comments=30, id="p", **post):
    return json.dumps([listing({"data": {"id": id, "num_comments": num_comments, "subreddit": "s", **post}}), listing(*children)])


TREE = thread(
    comment("a", listing(comment("b", listing(comment("c", parent_id="t1_b")), score=None), more(["m1", "m2"], 4))),
    comment("d", ""), more(["m3"]), more(), more([]),
    comment("e", listing(more(["m4"], 7), comment("f"), more(["m5"]))),
    {"kind": "t1", "data": {"id": "g"}})


def frame(spark, *payloads):
    return spark.createDataFrame([(p,) for p in payloads], "payload STRING")


def test_walk_depth_counts_and_defaults(spark):
    rows = {r["id"]: r for r in threads.comment_records(threads.nodes_of(threads.parse(frame(spark, TREE)))).collect()}
    order = sorted(rows, key=lambda i: rows[i]["pos"])
    assert order == list("abcdefg")
    assert [rows[i]["depth"] for i in order] == [0, 1, 2, 0, 0, 1, 0]
    assert [rows[i]["replies_count"] for i in order] == [5, 1, 0, 0, 8, 0, 0]
    assert rows["b"]["score"] is None and rows["g"]["score"] == 0
    assert rows["g"]["parent_id"] == "" and rows["g"]["is_root_comment"] is False and rows["g"]["created_at"] is None
    assert rows["a"]["is_root_comment"] is True and rows["c"]["is_root_comment"] is False
    assert rows["a"]["created_at"] == "1970-01-01 00:01"
    assert rows["a"]["thread_id"] == "p" and rows["a"]["subreddit"] == "s"


def test_continuation_ids_in_walk_order(spark):
    ids = threads.continuation_ids(threads.nodes_of(threads.parse(frame(spark, TREE))))
    assert [r["child_id"] for r in ids.orderBy("pos").collect()] == ["m1", "m2", "m3", "m4", "m5"]
    assert ops.continuation_batches(ids).first()["child_ids"] == ["m1", "m2", "m3", "m4", "m5"]


@pytest.mark.parametrize("levels", [150, 180, 1_000, 20_000])
def test_deep_tree(spark, levels):
    head, inner, tail = thread("@").split('"@"')[0], "", ""
    for i in range(levels):
        inner += '{"kind":"t1","data":{"id":"x%d","body":"b","replies":{"data":{"children":[' % i
        tail += "]}}}}"
    rows = threads.comment_records(threads.nodes_of(threads.parse(frame(spark, head + inner + tail + "]}}]"))))
    assert rows.agg(F.max("depth"), F.count("id")).first() == (levels - 1, levels)
    broken = frame(spark, head + inner + tail + "]}}")
    assert [r["reason"] for r in threads.quarantine(broken).collect()] == ["not_json"]


def test_the_deep_reader_reads_what_json_reads():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind < 6:
            return [None, True, False, rng.randrange(-9, 9), rng.random() * 1e9, 'a"\\\n\u00e9{[,'][kind]
        return {str(i): value(depth - 1) for i in range(rng.randrange(4))} if kind == 6 else [
            value(depth - 1) for _ in range(rng.randrange(4))]

    for _ in range(300):
        doc = value(4)
        assert threads._load_deep(json.dumps(doc, indent=rng.choice([None, 2]))) == doc
    for bad in ("", "[1,]", '{"a":}', "[1 2]", "{]", "1 2", "[", '{"a" 1}', "nul", '["x]', "{1:2}", "],", ",", '{"a":1,}'):
        with pytest.raises(ValueError):
            threads._load_deep(bad)


def test_half_surrogates_and_long_numbers(spark):
    odd = thread(comment("a", body="x\ud800y", author="\udfff"), comment("b", body="pair \ud83d\ude00", score=1 << 70), title="\ud800t")
    df = frame(spark, odd)
    assert "\\ud800" in odd
    rows = {r["id"]: r for r in threads.comment_records(threads.nodes_of(threads.parse(df))).collect()}
    assert (rows["a"]["body"], rows["a"]["author"]) == ("x\ufffdy", "\ufffd")
    assert (rows["b"]["body"], rows["b"]["score"]) == ("pair \U0001f600", None)
    assert threads.post_headers(df).first()["title"] == "\ufffdt"
    more_rows = spark.createDataFrame([("p", "s", json.dumps([comment("z", body="\udc00")]))], "thread_id STRING, subreddit STRING, payload STRING")
    assert threads.expansion_comments(more_rows).first()["body"] == "\ufffd"


def test_documents_are_read_by_one_python_node(spark):
    records = threads.comment_records(threads.nodes_of(threads.parse(frame(spark, TREE))))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan


def test_wrong_types_leave_the_node(spark):
    odd = thread(comment("a", listing(more(["m"], None), {"kind": "more", "data": {"count": None, "children": [1, None, "n"]}}),
                         score=3.5, body=7, created_utc="soon", author=["x"]),
                 comment(None, "", score="4", parent_id=None), {"kind": "t1", "data": "x"}, {"kind": "more", "data": {"children": "y"}})
    nodes = threads.nodes_of(threads.parse(frame(spark, odd)))
    rows = sorted(threads.comment_records(nodes).collect(), key=lambda r: r["pos"])
    assert [(r["id"], r["score"], r["body"], r["created_utc"], r["author"], r["replies_count"]) for r in rows] == [
        ("a", 3, "7", None, None, 0), (None, None, "body None", 60.0, "a", 0)]
    assert [r["child_id"] for r in threads.continuation_ids(nodes).orderBy("pos").collect()] == ["m", "1", "n"]


def test_odd_expansions(spark):
    rows = [("p", "s", "{}"), ("q", "s", "nope"), ("r", "s", None), ("t", "s", json.dumps([1, comment("x", depth="deep"), more()]))]
    df = spark.createDataFrame(rows, "thread_id STRING, subreddit STRING, payload STRING")
    assert [(r["id"], r["depth"]) for r in threads.expansion_comments(df).collect()] == [("x", 1)]
    bad = {r["thread_id"]: r["reason"] for r in threads.expansion_quarantine(df).collect()}
    assert bad == {"p": "not_a_list", "q": "not_json", "r": "not_json"}


def test_quarantine_and_gate(spark):
    df = frame(spark, thread(num_comments=29), thread(num_comments=30, id="ok"), "{}", "not json", "[1]", "[]", '"text"',
               json.dumps([listing({"data": {"id": "n"}}), listing()]), thread(id=None), None)
    bad = sorted(r["reason"] for r in threads.quarantine(df).collect())
    assert bad == ["no_id", "not_a_list", "not_a_list", "not_json", "not_json", "too_short", "too_short", "too_small", "too_small"]
    assert [r["thread_id"] for r in threads.accepted(df).collect()] == ["ok"]


def test_header_defaults(spark):
    row = threads.post_headers(frame(spark, thread())).first()
    assert (row["title"], row["text"], row["author"], row["score"]) == ("", "", "", 0)


def test_expansions_use_their_own_depth(spark):
    payload = json.dumps([comment("x", depth=3), comment("y", listing(comment("z"), more(["q"], 2))), more(["w"], 9)])
    df = spark.createDataFrame([("p", "s", payload)], "thread_id STRING, subreddit STRING, payload STRING")
    got = {r["id"]: (r["depth"], r["replies_count"]) for r in threads.expansion_comments(df).collect()}
    assert got == {"x": (3, 0), "y": (1, 3)}


def test_documents_to_comments(spark, tmp_path):
    (tmp_path / "one.json").write_text(TREE)
    (tmp_path / "two.json").write_text("broken")
    documents = threads.read_thread_documents(spark, str(tmp_path))
    expansion = spark.createDataFrame(
        [("p", "s", json.dumps([comment("a"), comment("new")])), ("small", "s", json.dumps([comment("no")]))], "thread_id STRING, subreddit STRING, payload STRING")
    rows = read_comments(documents, expansions=expansion).collect()
    again = read_comments(documents.repartition(3), expansions=expansion).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    assert sorted(r["id"] for r in rows) == ["a", "a", "b", "c", "d", "e", "f", "new"]
    assert len({r["comment_key"] for r in rows}) == 8


def test_result_is_typed_and_pruned_by_bucket(spark, tmp_path):
    df = spark.createDataFrame([("t1", 1, 0.5), ("t2", 2, None)], "thread_id STRING, cluster INT, x DOUBLE")
    sink.write_result(df, str(tmp_path / "r"))
    again = sink.read_result(spark, str(tmp_path / "r"))
    assert again.dtypes == df.dtypes and sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    one = sink.read_thread(spark, str(tmp_path / "r"), "t2")
    assert [tuple(r) for r in one.collect()] == [("t2", 2, None)]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_a_second_save_leaves_other_threads(spark, tmp_path):
    frame_of = lambda rows: spark.createDataFrame(rows, "thread_id STRING, n INT")
    path = str(tmp_path / "r")
    sink.save_threads(frame_of([("a", 1), ("a", 2), ("b", 3)]), path, 2)
    sink.save_threads(frame_of([("c", 4), ("a", 5), ("d", 6)]), path, 2)
    assert sorted(map(tuple, sink.read_result(spark, path).collect())) == [("a", 5), ("b", 3), ("c", 4), ("d", 6)]
    sink.save_threads(frame_of([]), path, 2)
    assert sink.read_result(spark, path).count() == 4
    assert [r["n"] for r in sink.read_thread(spark, path, "b", 2).collect()] == [3]


def test_stream_equals_batch_on_closed_bins(spark, tmp_path):
    schema = "id STRING, thread_id STRING, score LONG, created_utc LONG"
    batches = [
        [("a", "t", 1, 100), ("b", "t", 3, 1700), ("c", "u", 5, 2000)],
        [("d", "t", 7, 9000), ("e", "t", 2, 0)],
        [("h", "t", 6, 9100)],            # the watermark rules from the next batch on
        [("f", "t", 9, 200)],             # later than the watermark: dropped
        [("g", "t", 4, 20000)],
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "in")))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    activity.run_available(activity.stream_activity_timeline(stream), out, state)
    on_time = spark.createDataFrame([r for b in batches for r in b if r[0] != "f"], schema)
    closed = eng.activity_timeline(on_time).filter(F.unix_timestamp("bin") + 1800 <= 20000 - 3600)
    got = sorted((r["thread_id"], r["bin"], r["count"], r["avg_score"]) for r in spark.read.parquet(out).collect())
    assert got == sorted((r["thread_id"], r["bin"], r["count"], r["avg_score"]) for r in closed.collect()) and len(got) == 3


def test_late_rows_come_out_by_themselves(spark, tmp_path):
    schema = "id STRING, thread_id STRING, score LONG, created_utc LONG"
    batches = [
        [("a", "t", 1, 100), ("b", "t", 3, 1700), ("c", "u", 5, 2000), ("n", "u", None, 2100)],
        [("d", "t", 7, 9000), ("e", "t", 2, 0)],
        [("h", "t", 6, 9100)],
        [("f", "t", 9, 200), ("i", "u", 1, 2200), ("j", "u", 8, 9200)],  # f and i are late
        [("g", "t", 4, 20000)],
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "in")))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = str(tmp_path / "out")
        activity.run_available(activity.timeline_with_late_rows(stream), out, str(tmp_path / "state"))
    finally:
        spark.conf.unset(name)
    rows = spark.read.parquet(out).collect()
    assert {(r["thread_id"], r["id"], r["score"], r["created_utc"]) for r in rows if r["late"]} == {("t", "f", 9, 200.0), ("u", "i", 1, 2200.0)}
    # bins and late rows together are the batch table of the closed bins
    on_time = spark.createDataFrame([r for b in batches for r in b if r[0] not in "fi"], schema)
    closed = eng.activity_timeline(on_time).filter(F.unix_timestamp("bin") + 1800 <= 20000 - 3600)
    got = sorted((r["thread_id"], r["bin"], r["count"], r["avg_score"]) for r in rows if not r["late"])
    assert got == sorted((r["thread_id"], r["bin"], r["count"], r["avg_score"]) for r in closed.collect()) and len(got) == 4
