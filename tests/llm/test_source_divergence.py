"""The audit against exact integers over all terms, and its odd inputs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from threadloom.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(docs, top=200):
    docs = [((lang or ""), (source or ""), Counter(TERM.findall((text or "").translate(UPPER)))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, c in mine for t in c)
        kept = sorted(t for t in df if df[t] >= 3)
        groups = defaultdict(Counter)
        for _, source, c in mine:
            groups[source].update(c)
        whole = sum(groups.values(), Counter())

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        for s, count in groups.items():
            pairs = [(o, sum((p[s][t] - p[o][t])**2 // p[o][t] for t in kept)) for o in groups if o != s]
            best = [(t, (p[s][t] - q[t])**2 // q[t]) for t in kept if count[t] and p[s][t] > q[t]]
            for part, rows, cut in (("pair", pairs, None), ("term", best, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(rows[:cut], 1)]
    return sorted(out)


def audited(spark, rows, **rules):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(map(tuple, source_divergence.audit(df, **rules).collect()))


@pytest.mark.parametrize("sources", [3, 70])  # 70: three blocks of sources
def test_random_counts(spark, sources):
    rng = random.Random(sources)
    words = ["".join(rng.choices("abcdeéß日", k=4)) for _ in range(700)]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 60)))
    rows = [(rng.choice("uv"), f"s{int(rng.random() ** 2 * sources)}", text()) for _ in range(500)]
    assert audited(spark, rows, top_terms=15) == plain(rows, 15)


def test_odd_inputs(spark):
    rows = [(None, None, None), ("en", "a", ""), ("en", "b", "Same same 1same2same"), ("en", "b", "same x"), ("en", "b", "SAME y"),
            ("en", None, "other other " * 40_000), ("en", "c", "other"), ("en", "c", "other"), ("fr", "a", "rare"), ("fr", "b", "words"),
            ("fr", "c", None), ("de", "only", "ein ein"), ("de", "only", "ein"), ("de", "only", "ein")]
    got = audited(spark, rows)
    assert got == plain(rows)
    assert {r[4] for r in got if r[0] == "fr"} == {0} and len([r for r in got if r[0] == "fr"]) == 6
    assert audited(spark, []) == []
    extra = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n long, term string")
    assert sorted(map(tuple, source_divergence.audit(extra).collect())) == got


def test_counts_beyond_64_bits_of_products(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(source_divergence.share(
        F.lit(4 * 10**12).cast("long"), F.lit(9 * 10**12).cast("long"), F.lit(10**6).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**12 + 1) // (9 * 10**12 + 10**6)
