"""Token counts against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from threadloom.llm import token_counts as C
from threadloom.llm.agenda import merged
from threadloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(C.VOCABULARY))


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_finite_state_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        assert r["n_tokens"] == count(library, text)
        assert r["n_bytes"] == len((text or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048)


def test_odd_inputs(spark, library):
    texts = [None, "", " \n\t", "x", "It's we're I'LL 'S ''s !'t 'll'd they'RE", "<|startoftext|>a<|endoftext|><|x|>", "Σίσυφος ΟΔΟΣ",
             "日本語テキスト" * 500, "é ﬁ İ ǅ", "a\x85b c​d", "12,345.67½Ⅷ", "'", "'s", "x" * 5000, "word " * 30_000, "😀😀 ok\x00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None), (None, "a b")], "doc_id long, text string")
    rows = C.report(df, limit=10).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r["n_tokens"] == (2 if r["doc_id"] is None else count(library, texts[r["doc_id"]])), r
    assert C.report(df.limit(0)).count() == 0


def test_random_texts(library, monkeypatch):
    rng = random.Random(11)
    tokens = C.Counter(public_tokenizers.path(C.VOCABULARY))
    alphabet = ["'", "s", "t", "r", "e", "v", "l", "m", "d", "A", "z", "é", " ", "  ", "\n", "9", "!", "-", "日", "<|endoftext|>", "’"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) for _ in range(800)]
    assert tokens.count_all(texts).tolist() == [count(library, t) for t in texts]
    monkeypatch.setattr(C, "SLICE_CHARS", 50)  # long texts are cut, words are not
    assert tokens.count_all(texts).tolist() == [count(library, t) for t in texts]


def test_every_code_point(library):
    tokens = C.Counter(public_tokenizers.path(C.VOCABULARY))
    points = [*range(0x20000), *range(0x20000, 0x110000, 97)]
    texts = [f"a{chr(c)}b {chr(c)}9 !{chr(c)}" for c in points if not 0xD800 <= c < 0xE000]
    got = tokens.count_all(texts)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got.tolist(), want) if g != w] == []


def test_words_run_without_merges(library, monkeypatch):
    rng = random.Random(9)
    tokens = C.Counter(public_tokenizers.path(C.VOCABULARY))
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 30))) for _ in range(20_000)]
    want = [len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]
    assert tokens.count_all(words).tolist() == want
    monkeypatch.setattr(C.Merges, "alone", None)  # all that the words need is compiled
    assert tokens.count_all(words).tolist() == want
    monkeypatch.undo()
    monkeypatch.setattr(C, "TABLE_STATES", 500)  # a full table is dropped between slices
    monkeypatch.setattr(C, "SLICE_CHARS", 2000)
    assert tokens.count_all(words).tolist() == want and len(tokens.merges.places) < 10_000


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, n_tokens long, n_bytes long")
    assert tuple(C.report(df).first()) == (1, 3, 2, False)


def test_scan_equals_the_pattern():
    rng = random.Random(2)
    tokens = C.Counter(public_tokenizers.path(C.VOCABULARY))
    pattern = regex.compile(C.PATTERN)
    for _ in range(300):
        text = "".join(rng.choice("'strevlmd x9!é ") for _ in range(rng.randrange(0, 400)))
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        assert np.flatnonzero(C.word_starts(tokens.classes_of(points))).tolist() == [m.start() for m in pattern.finditer(text)]


def test_short_and_long_agenda_agree(monkeypatch):
    rng = random.Random(4)
    order = [a + b for a in ("a", "b", "ab", "aa", "ba") for b in ("a", "b", "ab")]
    for _ in range(300):
        priority = {p: k // 2 for k, p in enumerate(rng.sample(order, 8))}
        symbols = [rng.choice("ab") for _ in range(rng.randrange(1, 30))]
        short = merged(list(symbols), priority)
        monkeypatch.setattr("threadloom.llm.agenda.SHORT", 0)
        assert merged(list(symbols), priority) == short
        monkeypatch.undo()
