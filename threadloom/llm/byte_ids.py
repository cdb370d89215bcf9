"""Token ids of a byte-level BPE vocabulary for whole texts, in Arrow batches.

Texts of Latin blocks are encoded whole by tiktoken with the same vocabulary,
long ones in parts. The pre-tokenizer of this vocabulary starts a piece at every
space before a non-space, so a text may be parted there. Pieces outside these
blocks, and texts that hold the vocabulary's special token, go to the tokenizers
library itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Characters encoded at once.
PART_CHARS = 1 << 18

_before_word = re.compile(r" (?=\S)").search
_latin = re.compile("[\x00-ɏ‐-‧]*").fullmatch
#: From a space before a non-space, or the start, up to the next such space, if a character beyond the blocks is there.
_beyond = re.compile("(?: (?=\\S)|^)(?:(?! (?=\\S))[\x00-ɏ‐-‧])*[^\x00-ɏ‐-‧](?:(?! (?=\\S)).)*", re.DOTALL).finditer


class Encoder:
    """The little-endian bytes of a text's ids."""

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken

        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as file:
            added = [(t["content"], t["id"]) for t in json.load(file)["added_tokens"]]
        self.specials = [content for content, _ in added]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        last = max([*table.values(), *(i for _, i in added)])
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.dtype = np.dtype("<u2" if last < 1 << 16 else "<u4")

    @cached_property
    def library(self):
        """Loaded when a text first needs it."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.vocabulary)

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _by_ranks(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), self.dtype).tobytes()

    def _part(self, text: str) -> Iterator[bytes]:
        if _latin(text):
            yield self._by_ranks(text)
            return
        at = 0
        for found in _beyond(text):
            if found.start() > at:
                yield self._by_ranks(text[at:found.start()])
            yield self._by_library(found[0])
            at = found.end()
        if at < len(text):
            yield self._by_ranks(text[at:])

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, packed as ``dtype``."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self._by_library(text)
        out, at = [], 0
        while len(text) - at > PART_CHARS and (cut := _before_word(text, at + PART_CHARS)):
            out += self._part(text[at:cut.start()])
            at = cut.start()
        return b"".join([*out, *self._part(text[at:])])


@lru_cache(maxsize=1)
def encoder(vocabulary: str, ranks: str) -> Encoder:
    """One a worker process."""
    return Encoder(vocabulary, ranks)
