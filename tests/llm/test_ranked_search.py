"""Ranked search against a plain computation of the formula, and its odd inputs."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from threadloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, limit=50):
    """(item, rank, doc, score) rows; documents without an id come after the others of a score."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for i, ts in wanted.items():
        rows = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        rows.sort(key=lambda r: r[:3])
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(rows[:limit], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **rules):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked_search.search(docs, items, **rules).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 30, 10_000])
def test_random_texts(spark, block):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "ÄRGER", "Don", "7", "日本"]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(i, text(rng.randrange(0, 25))) for i in rng.sample(range(10_000), 300)]
    docs += [(i, docs[0][1]) for i in range(20_000, 20_080)] + [(5, "w1-w2"), (6, "W2 w1")]
    items = [(i, text(rng.randrange(0, 12))) for i in range(12)]
    assert found(spark, docs, items, limit=7, block=block) == plain(docs, items, 7)


def test_ties_go_by_id_across_classes(spark):
    # equal scores in classes that differ in a word that no item asks for are one class; so are "a b" and "a c"
    docs = [(9, "a b"), (1, "a c"), (5, "a b"), (3, "a c"), (2, "d d"), (8, "a a b")]
    assert found(spark, docs, [(1, "a")], limit=3) == plain(docs, [(1, "a")], 3)
    docs = [(k, "a" if k % 2 else "b") for k in range(40)] + [(99, "c"), (98, "c")]
    assert found(spark, docs, [(1, "a b")], limit=10) == plain(docs, [(1, "a b")], 10)


def test_odd_inputs(spark):
    docs = [(1, None), (2, ""), (3, "  -- "), (4, "x y"), (4, "x y"), (None, "x y"), (7, "y " * 50_000), (8, "z z")]
    items = [(1, "x"), (2, None), (3, ""), (4, "Y"), (4, "Z"), (None, "z"), (6, "nowhere")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []
    frame = spark.createDataFrame([(4, "x y", 1, "n")], "doc_id long, text string, score long, bag string")
    asked = spark.createDataFrame([(1, "x", "t")], "item_id long, text string, term string")
    assert [tuple(r) for r in ranked_search.search(frame, asked).collect()] == plain([(4, "x y")], [(1, "x")])
