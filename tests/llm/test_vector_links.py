"""Links of embeddings against all pairs compared at once."""

import math

import numpy as np
import pytest

from threadloom.llm import vector_links as V
from threadloom.llm.queries import QUERIES


def brute(rows, cosine=0.93):
    """(links, component id) by row position."""
    def usable(v, label):
        return bool(v) and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = {}
    for i, (_, v, label) in enumerate(rows):
        if usable(v, label):
            groups.setdefault((label, len(v)), []).append(i)
    for members in groups.values():
        x = np.array([rows[i][1] for i in members], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        for i, n in zip(members, near.sum(axis=1)):
            links[i] = int(n)
        for p, q in zip(*np.nonzero(near)):
            root[find(members[p])] = find(members[q])
    ids = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            ids[find(i)] = min(k, ids.get(find(i), k))
    return links, [ids.get(find(i)) for i in range(len(rows))]


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    key = lambda t: tuple((x is None, x or 0) for x in t)
    got = sorted((tuple(r) for r in V.report(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=key)
    floats = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for k, v, g in rows]
    links, parts = brute(floats)
    want = sorted(((k, n, p, k is not None and k == p) for (k, _, _), n, p in zip(rows, links, parts)), key=key)
    assert got == want


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(V, "LEAF", 8)
    monkeypatch.setattr(V, "SMALL", 4)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    links, parts = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op1_cover_tree_links"](spark, sf).collect()}
    assert got == {k: (n, p, k == p) for (k, _, _), n, p in zip(rows, links, parts)}


def test_deep_trees(spark, small_leaves):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        centre = rng.normal(size=6)
        for i in range(25):
            rows.append((len(rows), (centre + rng.normal(size=6) * rng.choice([0.01, 0.2, 0.6])).tolist(), g % 2))
    check(spark, rows)


def test_a_large_label_of_groups_is_pruned(spark):
    """At the sizes of production: 50 groups of 100 in 64 dimensions, and as many vectors without groups."""
    rng = np.random.default_rng(5)
    grouped = [(1000 * g + i, (c + rng.normal(size=64) * 0.02).tolist(), 1)
               for g, c in enumerate(rng.normal(size=(50, 64))) for i in range(100)]
    check(spark, grouped)
    loose = [(10**6 + i, rng.normal(size=64).tolist(), 1) for i in range(1500)]
    share = {}
    for name, rows in (("grouped", grouped), ("loose", loose)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        levels, pairs = V.traversed(df)
        share[name] = V.compared_share(levels, pairs)
    assert share["grouped"] < 0.05 and 0.9 < share["loose"] <= 1


def test_copies_and_tight_groups(spark, small_leaves):
    rng = np.random.default_rng(2)
    base = rng.normal(size=5)
    rows = [(i, base.tolist(), 1) for i in range(40)]  # equal
    rows += [(100 + i, (base * 2.0 ** i).tolist(), 1) for i in range(1, 30)]  # same direction
    rows += [(200 + i, (base + rng.normal(size=5) * 1e-3).tolist(), 1) for i in range(60)]
    rows += [(300 + i, rng.normal(size=5).tolist(), 1) for i in range(40)]
    rows += [(400, (-base).tolist(), 1), (401, base.tolist(), 2)]
    check(spark, rows)


def test_odd_inputs(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1),
            (6, [float("inf"), 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [2.0, 0.1], 1),
            (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 3), (8, [1.0, 0.0], 1), (11, [1e-30, 0.0], 1), (12, [1e30, 1e30], 1)]
    check(spark, rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert V.report(df.limit(0)).count() == 0
    named = df.selectExpr("vec_id", "embedding", "label", "1 as no", "'x' as vec", "2 as node")
    assert V.report(named).count() == len(rows)
