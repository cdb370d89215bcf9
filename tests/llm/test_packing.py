"""Packing: every token once, ids of the library, sequences full or a power of two."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadloom.llm import byte_ids, packing
from threadloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(byte_ids.VOCABULARY))


def check(pieces, rows, library, window=packing.WINDOW):
    ids = {k: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for k, t in rows}
    copies = Counter(k for k, _ in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for k, parts in by_doc.items():
        want = ids[k]
        assert all(p["doc_tokens"] == len(want) for p in parts)
        covered = np.zeros(len(want), int)
        for p in parts:
            part = want[p["start"]:p["start"] + p["length"]]
            covered[p["start"]:p["start"] + p["length"]] += 1
            assert len(part) == p["length"] > 0 and p["ids_crc32"] == zlib.crc32(part.tobytes())
        assert (covered == copies[k]).all()
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check(QUERIES["op3_nnls_packing"](spark, SF).collect(), docs, library) == 0


def test_odd_inputs(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b \n c   "), (5, "<|endoftext|> x"), (6, "wörter " * 9000),
            (7, "日本語 テキスト  x"), (8, "x" * 3000), (9, "same"), (9, "same"), (10, " lead\n\n tail ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(packing.pack(df).collect(), rows, library) == 0
    assert packing.pack(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (None, "c")], df.schema)
    assert sum(p["length"] for p in packing.pack(nameless).collect()) == 5


def test_small_window_uses_combinations(spark, library):
    rng = random.Random(1)
    rows = [(i, "a " * rng.randrange(1, 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df, window=32).collect()
    assert check(pieces, rows, library, 32) == 0
    cut = sum(1 for p in pieces if p["length"] != 32 and p["length"] != p["doc_tokens"] % 32)
    assert cut < len(rows) / 5  # most documents' remainders are packed whole


@pytest.mark.parametrize("seed", range(5))
def test_counts_near_the_histogram(seed):
    rng = np.random.default_rng(seed)
    window = 64
    counts = np.zeros(window + 1, np.int64)
    counts[1:window] = rng.integers(0, 500, window - 1)
    combos = packing.combinations(np.flatnonzero(counts), window)
    assert (combos.sum(axis=1) == window).all() and len(np.unique(combos, axis=0)) == len(combos)
    x = packing.solve_counts(combos, counts)
    assert (x >= 0).all()
    repeats = packing.rounded(combos, x, counts)
    used = np.bincount(combos.ravel(), np.repeat(repeats, 3), minlength=window + 1)[1:]
    assert (used <= counts[1:]).all()
    tokens = (counts[1:] * np.arange(1, window + 1)).sum()
    assert (used * np.arange(1, window + 1)).sum() >= 0.6 * tokens


def test_texts_cut_at_equal_and_other_places(spark, library):
    rng = random.Random(4)
    texts = ["a b c d e f g", "日本語 x", "word " * 9, ""]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, no long, h1 long, lengths string")
    pieces = packing.pack(df, window=16).collect()
    assert check(pieces, rows, library, 16) == 0
    assert any(p["length"] < p["doc_tokens"] % 16 for p in pieces)


def test_solver_settles():
    counts = np.array([0, 900, 500, 40, 0, 7, 800, 650, 3])
    combos = packing.combinations(np.flatnonzero(counts), 8)
    held = np.where(combos > 0, 1, 0)
    x = packing.solve_counts(combos, counts, 1e-6)
    error = lambda v: ((np.bincount(combos.ravel(), (held * v[:, None]).ravel(), 9)[1:] - counts[1:]) ** 2).sum()
    rng = np.random.default_rng(1)
    assert all(error(x) <= error(np.maximum(x + rng.normal(0, s, len(x)), 0)) * 1.01 + 1 for s in (0.5, 5, 50) for _ in range(200))


@pytest.mark.parametrize("part", [17, 1 << 18])
def test_encoder_equals_library_on_random_text(library, monkeypatch, part):
    monkeypatch.setattr(byte_ids, "PART_CHARS", part)
    rng = random.Random(3)
    enc = byte_ids.Encoder(public_tokenizers.path(byte_ids.VOCABULARY), public_tokenizers.path(byte_ids.RANKS))
    alphabet = "abcXYZ 0129  \n\t.,'!-éßñ日語 　 \x85\x1c'st're"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        got = np.frombuffer(enc.encode(text), enc.dtype).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)
