"""Quality rules against plain Python, and every odd input."""

import math
import random
import re
from collections import Counter

import pytest

from threadloom.llm import quality
from threadloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside), failed)


def counts(row):
    return (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"],
            row["base_failed"])


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = QUERIES["op8_distribution_divergence"](spark, SF).collect()
    assert len(got) == docs.count()
    for row in got:
        assert counts(row) == brute(texts[row["doc_id"]]), row["doc_id"]
        assert row["kept"] is (False if row["base_failed"] else row["kept"])


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op8_distribution_divergence"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = out.filter("not base_failed").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) <= 0.7 * len(junk)


def test_odd_inputs(spark):
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "x\ny\nx\n \n \n", "é" * 3 + "  z \x0b\x0c",
             "a a a a a a a", "# * $ % & | < >", "w " * 20_000, "tail\n"]
    rows = [(i, t, "en", 1, 2) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int, row int")
    out = quality.report(df).collect()
    assert len(out) == len(rows)
    for row in out:
        assert counts(row) == brute(texts[row["doc_id"]]), row
        assert row["kept"] is False
    none = spark.createDataFrame([], df.schema)
    assert quality.report(none).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)], df.schema)
    assert quality.report(nulls).collect()[0]["kept"] is False


def test_rows_come_back_whole_with_their_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, None, 7, "x"), (2, "short", "en", 8, "y")],
                               "doc_id long, text string, lang string, q int, row string")
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [(1, text, None, 7, "x")]


def test_distance_is_jensen_shannon(spark):
    rules = quality.QualityRules(common_words={"en": ["the", "of"]}, min_words_classes=1, min_words_common=1)
    texts = ["the of the Xx yy zz aa bb cc dd", "of Of ab cd ef gh ij kl mn op 12"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in quality.report(df, rules=rules).collect()}

    def shares(ts):
        words = [w for t in ts for w in WORD.findall(t)]
        n = Counter(w if w in ("the", "of") else "" for w in words)
        return [n[k] / len(words) for k in ("the", "of", "")]

    def distance(p, q):
        part = lambda a, m: a * math.log2(a / m) if a else 0
        return math.sqrt(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2)

    for i, t in enumerate(texts):
        assert out[i]["word_distance"] == pytest.approx(distance(shares([t]), shares(texts)))


def test_other_languages_are_held_against_themselves(spark):
    rng = random.Random(3)
    italian = "il di che la e un per non sono con le si da come ma".split()

    def words(common, start):
        return " ".join(rng.choice(common) if rng.random() < 0.3 else f"{start}{rng.choice('aeiou')}{rng.choice('bcdfg')}o"
                        + rng.choice("abcdefghil") for _ in range(150))

    rows = [(i, words(italian, "v"), "it") for i in range(20)] + [(i, words(["и", "в", "не", "на"], "ж"), "ru") for i in range(20, 40)]
    rows += [(i, words(quality.COMMON_WORDS["en"], "w"), "en") for i in range(40, 60)]
    rows += [(60, words(italian, "v"), None), (61, "# $ % & " + " ".join(f"{k}%$#&|" for k in range(150)), "it")]
    out = {r["doc_id"]: r for r in quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i]["kept"] for i in range(61)) and not out[61]["kept"]
    assert all(out[i]["word_distance"] is not None for i in range(60)) and out[60]["word_distance"] is None
