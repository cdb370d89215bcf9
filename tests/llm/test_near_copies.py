"""Near copies against every pair compared by hand."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import near_copies as N
from threadloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, rules):
    """component_id by row position: smallest id among the linked rows."""
    sets = []
    for _, text in rows:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in _split(text or "")]
        size = min(rules.shingle, len(words))
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            if s and t and 100 * len(s & t) >= rules.similar_percent * len(s | t):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    ids = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [len(s) for s in sets], [ids[find(i)] if sets[i] else rows[i][0] for i in range(len(rows))]


def _split(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def check(spark, rows, rules=N.NearCopyRules(shingle=4)):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"])
                 for r in N.report(df, rules).collect())
    sizes, parts = brute(rows, rules)
    want = sorted((k is None, k or 0, n, c or 0, k is not None and k == c)
                  for (k, _), n, c in zip(rows, sizes, parts))
    assert got == want


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sizes, parts = brute([tuple(r) for r in docs], N.NearCopyRules(shingle=4))
    got = {r["doc_id"]: r for r in QUERIES["op4_multi_index_minhash"](spark, SF).collect()}
    assert len(got) == len(docs)
    for (key, _), n, part in zip(docs, sizes, parts):
        row = got[key]
        assert (row["n_shingles"], row["component_id"], row["kept"]) == (n, part, key == part)


def test_edits_around_the_limit_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "DRAWS", 1)
    monkeypatch.setattr(N, "TILE_ROWS", 16)  # so that buckets are split
    monkeypatch.setattr(N, "BLOCK_TEXTS", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(10, " ".join(base))]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    passage = " ".join(base[:60])
    rows += [(300 + i, passage + " " + " ".join(f"y{i}_{k}" for k in range(90))) for i in range(40)]
    rows += [(500 + i, " ".join(base)) for i in range(30)]
    check(spark, rows)


def test_odd_inputs(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A B C"), (7, "a b c"),
            (8, "É a b c d"), (9, "é a b c d"), (None, "one"), (None, "alone here"), (12, long), (11, long + " end"),
            (13, "a b c d e"), (14, "a a a a a a a a"), (15, "a a a a a")]
    check(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.report(empty).count() == 0


def test_keep_one_leaves_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text, "a"), (1, text + " x", "b"), (1, text + " x", "c"), (None, text, "d"), (4, "", "e"), (5, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, no string")
    out = N.keep_one(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4, 5]


def test_tiles_alone_find_every_link(spark, monkeypatch):
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(N, "_star", lambda buckets, rank: none)
    monkeypatch.setattr(N, "TILE_ROWS", 8)
    rng = random.Random(9)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(80)]
        for i in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(words)))
    check(spark, rows)


def test_signature_distance_estimates_similarity():
    rules = N.NearCopyRules()
    a = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = a[400:]
    column = pa.array([N.signature(a, rules.symbols), N.signature(b, rules.symbols)])
    sig, fine = N._symbols(column, rules.symbols)
    near = (sig[0] != sig[1]).sum()
    assert near <= rules.max_distance and near + (fine[0] != fine[1]).sum() <= rules.max_fine_distance
    assert (near + (fine[0] != fine[1]).sum()) / (rules.symbols + N.FINE) == pytest.approx(0.1, abs=0.08)
