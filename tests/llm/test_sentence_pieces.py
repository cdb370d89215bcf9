"""Encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from threadloom.llm import sentence_pieces as P
from threadloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "  ", " a", "a ", "  a  b  ", "▁x ▁ y", "a\tb\r\nc", "日本語テキスト", "😀́é", "\x00x", "<s> </s><0x41>",
       "a b　c", "x" * 3000, "word " * 20_000, "don't (stop), 'ok'... 3.14", " " * 40 + "x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))


def digests(library, text):
    ids = library.encode(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_agenda_sentence_pieces"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(library, docs[r["doc_id"]])


def test_odd_inputs(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a", "y"), (3, "  ", "z")],
                               "doc_id long, text string, ids string")
    for r in P.report(df).collect():
        text = "a" if r["doc_id"] is None else ODD[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(library, text), text
    assert P.report(df.limit(0)).count() == 0


def test_round_trip(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in P.decoded(P.encoded(df)).collect():
        want = library.encode(ODD[r["doc_id"]] or "")
        assert (r["ids"], r["decoded"]) == (want, library.decode(want))


def test_random_texts(library):
    rng = random.Random(8)
    enc = P.Encoder(public_tokenizers.path(P.MODEL))
    alphabet = ["the", "ing", "a", "'s", ".", ",", "\n", " ", "  ", "(", "é", "ß", "日", "0", "12", "▁", "T", "​", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text), repr(text)
    enc.check()
    assert not enc.fresh


def test_a_difference_is_an_error():
    enc = P.Encoder(public_tokenizers.path(P.MODEL))
    enc.priority = {}
    enc.encode("the thing")
    with pytest.raises(ValueError):
        enc.check()
