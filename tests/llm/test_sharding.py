"""Sharding: every row once, near-equal bytes, few slots moved."""

import zlib
from collections import Counter, defaultdict

from threadloom.llm import sharding as S
from threadloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def loads(rows, shards=S.SHARDS):
    out = dict.fromkeys(range(shards), 0)
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def check_places(rows):
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op9_virtual_slots"](spark, SF).collect()
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    check_places(rows)
    sizes = loads(rows).values()
    assert max(sizes) - min(sizes) <= 0.01 * max(sizes)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_a_record_keeps_its_slot(spark):
    a = {r["doc_id"]: r["virtual_slot"] for r in QUERIES["op9_virtual_slots"](spark, SF).collect()}
    df = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300").repartition(3)
    b = {r["doc_id"]: r["virtual_slot"] for r in S.shard(df, shards=5).collect()}
    assert b.items() <= a.items()


def test_copies_of_one_record_are_dealt_out(spark):
    rows = [(7, "x" * 100, "a")] * 600 + [(100 + i, "y" * (i % 50), "b") for i in range(600)]
    out = S.shard(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert len(out) == len(rows)
    check_places(out)
    sizes = loads(out).values()
    assert max(sizes) <= 1.35 * sum(sizes) / len(sizes)


def test_odd_inputs(spark):
    rows = [(None, None), (None, ""), (1, None), (1, None), (2, "é"), (3, "z" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = S.shard(df, shards=3).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 1, 1, 3, 100_001]
    check_places(out)
    assert S.shard(df.limit(0)).count() == 0


def test_edits_move_few_slots():
    sizes = {(i, 0): 1000 + (i * 7919) % 500 for i in range(S.SLOTS)}
    first = S.first_map(sizes, 16)
    total = sum(sizes.values())
    grown = S.edited_map(first, sizes, 17)
    moved = [s for s in sizes if grown[s] != first[s]]
    assert all(grown[s] == 16 for s in moved)
    assert sum(sizes[s] for s in moved) <= 1.02 * total / 17
    load = Counter()
    for s, k in grown.items():
        load[k] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 0.02 * total / 17
    changed = {s: n * (3 if s[0] % 16 == 3 else 1) for s, n in sizes.items()}
    after = S.edited_map(first, changed, 16)
    load = Counter()
    for s, k in after.items():
        load[k] += changed[s]
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(changed.values()) / 16
    fewer = S.edited_map(first, sizes, 15)
    assert set(fewer.values()) == set(range(15)) and fewer.keys() == sizes.keys()


def test_versions_are_stored(spark, tmp_path):
    sizes = {(0, 0): 5, (1, 0): 3}
    S.save_map(spark, str(tmp_path), 1, {(0, 0): 0, (1, 0): 1}, sizes)
    S.save_map(spark, str(tmp_path), 2, {(0, 0): 1, (1, 0): 1}, sizes)
    read = lambda v: {(r["virtual_slot"], r["part"]): r["shard"] for r in S.load_map(spark, str(tmp_path), v).collect()}
    assert read(1) == {(0, 0): 0, (1, 0): 1} and read(2) == {(0, 0): 1, (1, 0): 1}
