"""Encoding with a merge-type sentencepiece vocabulary, and decoding.

Spaces become a mark and the text gets one in front. Symbols, at first single
characters, are merged by an agenda of adjacent pairs in order of the merged
piece's score, leftmost first. What is no piece in the end is written as bytes.
No piece holds two neighbouring characters that the vocabulary never has side
by side, nor a mark after another character, so a text falls into parts that
are encoded on their own; frequent parts are remembered.

Each Arrow batch is checked against the library: all parts that were encoded
anew are encoded there as well, and a difference is an error. Decoding is the
library's. The model must be of merge type with byte fallback, the identity
normalizer, and no user-defined pieces; another is refused.

Null and empty texts have no tokens and decode to the empty text. Every row is
returned, equal ones alike. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threadloom.llm.agenda import merged

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Remembered parts of a task and their longest; texts of a batch that are decoded together, in characters.
CACHE_PARTS, CACHE_CHARS, DECODE_CHARS = 700_000, 48, 1 << 21

_runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


class Encoder(dict):
    """Maps a part, without the one mark before it, to the packed ids of mark and part."""

    def __init__(self, model: str):
        import sentencepiece

        super().__init__()
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        pieces = {lib.id_to_piece(i): i for i in plain}
        scores = {p: lib.get_score(i) for p, i in pieces.items()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.priority = {p: rank[s] for p, s in scores.items() if len(p) > 1}
        self.ids = pieces
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.together = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        marks_first = all(MARK not in p.lstrip(MARK) for p in pieces)
        if not all(map(lib.is_byte, self.bytes)) or any(map(lib.is_unused, plain)) or not marks_first \
                or lib.encode("a  b ") != self._library_form("▁a▁▁b▁"):
            raise ValueError(f"{model} is not a plain merge-type model with byte fallback")
        self.inner: dict[str, bytes] = {}
        self.fresh: list[str] = []

    def _ids(self, text: str) -> list[int]:
        """The agenda over the characters of ``text``, which already has its marks."""
        out: list[int] = []
        for symbol in merged(list(text), self.priority):
            known = self.ids.get(symbol)
            if known is None:
                out += [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]
            else:
                out.append(known)
        return out

    def _library_form(self, text: str) -> list[int]:
        return [i for part in _runs(text) for i in self._ids(part)]

    def part(self, text: str) -> bytes:
        """Ids of a part with its marks, joined from stretches that no piece crosses."""
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.together]
        out = b""
        for i, j in zip([0, *cuts], [*cuts, len(text)]):
            stretch = text[i:j]
            ids = self.inner.get(stretch)
            if ids is None:
                ids = np.array(self._ids(stretch), "<u4").tobytes()
                if len(stretch) <= CACHE_CHARS:
                    if len(self.inner) >= CACHE_PARTS:
                        self.inner.clear()
                    self.inner[stretch] = ids
                self.fresh.append(stretch)
            out += ids
        return out

    def __missing__(self, rest: str) -> bytes:
        out = self.part(MARK + rest)
        if len(rest) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[rest] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if "  " in text or MARK in text or text[0] == " ":
            return b"".join(map(self.part, _runs(MARK + text.replace(" ", MARK))))
        return b"".join(map(self.__getitem__, text.split(" ")))

    def check(self) -> None:
        """Hold what was encoded since the last check against the library."""
        marked = [s.startswith(MARK) for s in self.fresh]
        # The library puts one mark in front; a stretch without one follows a character that no piece joins with it.
        texts = [s[1:] if m else "\n" + s for s, m in zip(self.fresh, marked)]
        lead = self.library.encode("\n")
        for stretch, text, m, ids in zip(self.fresh, texts, marked, self.library.encode(texts, num_threads=1)):
            if not text:
                continue  # one mark alone: the library leaves an empty text empty
            want = ids if m else ids[len(lead):]
            have = self._ids(stretch) if stretch not in self.inner else np.frombuffer(self.inner[stretch], "<u4").tolist()
            if have != want or not (m or ids[:len(lead)] == lead):
                raise ValueError(f"differs from the library: {stretch!r}")
        self.fresh.clear()


@lru_cache(maxsize=1)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def encoded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every row's text."""
    path = model or public_tokenizers.path(MODEL)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(enc.encode(t), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            enc.check()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(df: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """All columns and ``decoded``, the library's text for the ids; null ids are none."""
    path = model or public_tokenizers.path(MODEL)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(path).library
        for batch in batches:
            texts = [lib.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(decode, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Number of ids, their digest, and the digest of the text they decode to, in one pass over the texts."""
    path = model or public_tokenizers.path(MODEL)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        decimal = [str(i) for i in range(enc.library.get_piece_size())]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            n, of_ids, of_texts, waiting, size = [], [], [], [], 0
            for t in batch.column("text").to_pylist():
                ids = np.frombuffer(enc.encode(t), "<u4").tolist()
                n.append(len(ids))
                of_ids.append(sha(",".join(map(decimal.__getitem__, ids))))
                waiting.append(ids)
                size += len(ids)
                if size >= DECODE_CHARS:
                    of_texts += map(sha, enc.library.decode(waiting))
                    waiting, size = [], 0
            enc.check()
            of_texts += map(sha, enc.library.decode(waiting)) if waiting else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_texts)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
