"""Token counts of whole texts by a compiled finite-state tokenizer.

The vocabulary splits a normalised text into words by a pattern over letters,
numbers and other marks, and a word into tokens by ranked merges. Both are
compiled to deterministic transducers.

The pattern is one over six character classes and five states. A chunk of text
is a map from the state before it to the state after it; the maps of all chunks
are composed by a parallel prefix scan (each round joins maps twice as far
apart), which gives every chunk its entry state, and one more pass marks the
transitions that begin a word.

The merges are another, over the bytes of a word, its last byte apart. Tokens are
the merges' result if and only if every two neighbours are left as they are by
merging the two alone. So the last token of a word's beginning is the one suffix
that fits the last token of what lies before it, and a state needs to know, for
each place from which a token may still reach on, how far it has come, which
token ends there and how many tokens ago. A transition carries the change in the
number of tokens; a word's count is the sum along its path, and no merge is run
on it. States and transitions are compiled when first met and kept in a table of
bounded size; all words of a slice take their next step at once.

Character classes and normal forms are the library's own. Special strings inside
a text count as one token each, as the library has them by default. Null and
empty texts have no tokens and no bytes. Rows with equal text or id are all
returned. A text of any length is counted whole. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.tables import sliced

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048

SPACE, LETTER, NUMBER, OTHER, SHORT_FORM, LONG_FORM = range(6)
OUT, IN_LETTERS, IN_MARKS, ONE_MORE, TWO_MORE = range(5)
CHUNK = 64
#: Characters handled at once, and states a task keeps.
SLICE_CHARS, TABLE_STATES = 1 << 20, 150_000
#: Added to a word's last byte; the state before its first one.
LAST, START = 256, 0

# The pattern that the compiled transducer stands for; another one is refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether the character begins a word, by 6 * state + class."""
    fresh = {SPACE: (OUT, 0), LETTER: (IN_LETTERS, 1), NUMBER: (OUT, 1), OTHER: (IN_MARKS, 1),
             SHORT_FORM: (ONE_MORE, 1), LONG_FORM: (TWO_MORE, 1)}
    rows = {OUT: fresh,
            IN_LETTERS: fresh | {LETTER: (IN_LETTERS, 0)},
            IN_MARKS: fresh | dict.fromkeys((OTHER, SHORT_FORM, LONG_FORM), (IN_MARKS, 0)),
            ONE_MORE: dict.fromkeys(range(6), (OUT, 0)),
            TWO_MORE: dict.fromkeys(range(6), (ONE_MORE, 0))}
    cells = [rows[s][c] for s in range(5) for c in range(6)]
    return np.array([n for n, _ in cells], np.uint8), np.array([b for _, b in cells], np.bool_)


NEXT, BEGINS = _transducer()


def classes_of(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of every character; an apostrophe's class looks two characters ahead."""
    out = table[points]
    at = np.flatnonzero(points == ord("'"))
    ahead = np.concatenate([points, np.zeros(2, points.dtype)])
    one, two = ahead[at + 1], ahead[at + 2]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT_FORM
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    out[at[long]] = LONG_FORM
    return out


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """(states, chunks): the state after each chunk for every state before it. ``classes`` is (steps, chunks)."""
    maps = np.repeat(np.arange(5, dtype=np.uint8)[:, None], classes.shape[1], axis=1)
    for step in classes:
        maps = NEXT[maps * 6 + step]
    return maps


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of the maps, by doubling."""
    out, far = maps.copy(), 1
    while far < out.shape[1]:
        earlier = out[:, :-far]
        out[:, far:] = np.take_along_axis(out[:, far:], earlier.astype(np.intp), axis=0)
        far *= 2
    return out


def word_starts(classes: np.ndarray, state: int = OUT) -> np.ndarray:
    """Which characters begin a word."""
    n = len(classes)
    steps = np.zeros((-(-n // CHUNK), CHUNK), np.uint8)  # padded with spaces
    steps.reshape(-1)[:n] = classes
    steps = np.ascontiguousarray(steps.T)
    if not n:
        return np.zeros(0, bool)
    scan = composed(chunk_maps(steps))
    now = np.concatenate([np.array([state], np.uint8), scan[state, :-1]])
    begins = np.empty(steps.shape, bool)
    for k, step in enumerate(steps):
        cell = now * 6 + step
        begins[k] = BEGINS[cell]
        now = NEXT[cell]
    return begins.T.reshape(-1)[:n]


class Merges:
    """The transducer over the bytes of a word, compiled step by step.

    A state is a set of places, each as (node of the tree of tokens reached from
    there, the token that ends there, the number of tokens then less the number
    now). ``next`` and ``emits`` are indexed by state and column; a column is a
    byte, or a word's last byte, that has been met.
    """

    def __init__(self, merges: list[tuple[str, str]], byte_chars: dict[int, str], end: str):
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.end = end
        self.symbols = [byte_chars[b] for b in range(256)] + [byte_chars[b] + end for b in range(256)]
        numbers = {c: b for b, c in enumerate(self.symbols)}
        self.children: list[dict[int, int]] = [{}]
        self.tokens: list[str | None] = [None]
        for token in [*self.symbols, *(a + b for a, b in merges)]:
            node = 0
            for symbol in self.parts(token):
                below = self.children[node]
                node = below.setdefault(numbers[symbol], len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.tokens.append(None)
            self.tokens[node] = token
        self.fit: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {((0, "", 0),): START}
        self.places: list[tuple] = [((0, "", 0),)]
        self.column = np.full(2 * LAST, -1, np.int64)
        self.next = np.full((1024, 64), -1, np.int32)
        self.emits = np.zeros((1024, 64), np.int8)

    def parts(self, token: str) -> list[str]:
        """The symbols of a token."""
        if token.endswith(self.end) and len(token) > len(self.end):
            inner = token[:-len(self.end)]
            return [*inner[:-1], inner[-1] + self.end]
        return list(token)

    def alone(self, symbols: list[str]) -> list[str]:
        """What the merges make of the symbols of a token or two."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, before: str, token: str) -> bool:
        """Whether the two tokens, or the one at a word's start, stay as they are."""
        found = self.fit.get((before, token))
        if found is None:
            both = [before, token] if before else [token]
            found = self.fit[before, token] = self.alone([x for t in both for x in self.parts(t)]) == both
        return found

    def compile(self, state: int, symbol: int) -> None:
        """One transition; the state it leads to is made if it is new."""
        reached = [(self.children[node].get(symbol), before, n) for node, before, n in self.places[state]]
        token, now = next((self.tokens[node], n + 1) for node, before, n in reached
                          if node is not None and self.tokens[node] and self.fits(before, self.tokens[node]))
        places = tuple((node, before, n - now) for node, before, n in reached if node is not None and self.children[node])
        places = ((0, token, 0), *places) if symbol < LAST else ((0, "", 0),)
        to = self.states.setdefault(places, len(self.places))
        if to == len(self.places):
            self.places.append(places)
            if to == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        at = self.column[symbol]
        self.next[state, at], self.emits[state, at] = to, now

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        new = np.flatnonzero(np.bincount(symbols, minlength=2 * LAST)[:2 * LAST] * (self.column < 0))
        if len(new):
            first = int((self.column >= 0).sum())
            self.column[new] = np.arange(first, first + len(new))
            while first + len(new) > self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)], axis=1)
        return self.column[symbols]

    def counts(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of the words data[begin:begin + length]; every word takes its k-th step at the same time."""
        if len(self.places) > TABLE_STATES:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        emitted, state = np.zeros(len(order), np.int64), np.full(len(order), START, np.int64)
        longer = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for k, n in enumerate(longer.tolist()):  # the first n words have more than k bytes
            symbols = data[begins[:n] + k].astype(np.int64) + LAST * (lengths[:n] == k + 1)
            columns, here = self.columns(symbols), state[:n]
            to = self.next[here, columns]
            if (unknown := np.flatnonzero(to < 0)).size:
                for s, x in set(zip(here[unknown].tolist(), symbols[unknown].tolist())):
                    self.compile(s, x)
                to = self.next[here, columns]
            emitted[:n] += self.emits[here, columns]
            state[:n] = to
        out = np.empty_like(emitted)
        out[order] = emitted
        return out


class Counter:
    """Token counts of texts by a vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        patterns = json.dumps(spec["pre_tokenizer"])
        if json.dumps(PATTERN) not in patterns or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} splits text by another pattern")
        library = Tokenizer.from_file(path)
        self.split, self.normal_form = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        # Byte-level vocabularies write bytes that are not printable as characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = Merges(merges, chars, spec["model"]["end_of_word_suffix"])
        self.classes = np.full(0x110000, 255, np.uint8)

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        for point in np.unique(points[self.classes[points] == 255]).tolist():
            self.classes[point] = self.class_of(chr(point))
        return classes_of(points, self.classes)

    def class_of(self, char: str) -> int:
        """What the library's own pattern makes of a character between letters and before a mark."""
        pieces = self.split(f"a{char}a")
        if len(pieces) == 2:
            return SPACE
        if len(pieces) == 1:
            return LETTER
        return NUMBER if len(self.split(f"{char}!")) == 2 else OTHER

    def normal(self, text: str) -> str:
        """The library's normal form; white space of ASCII texts stays, as it only separates."""
        return text.lower() if text.isascii() else self.normal_form(text)

    def count_all(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, owners, size = [], [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            pieces = [text]
            if self.special is not None and "<" in text:
                pieces = self.special.split(text)
                out[k] += len(pieces) - 1
            for piece in pieces:
                for part in _slices(self.normal(piece)):
                    parts.append(part)
                    owners.append(k)
                    size += len(part) + 1
                    if size >= SLICE_CHARS:
                        self._add(out, parts, owners)
                        parts, owners, size = [], [], 0
        self._add(out, parts, owners)
        return out

    def _add(self, out: np.ndarray, parts: list[str], owners: list[int]) -> None:
        if not parts:
            return
        text = " ".join(parts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = self.classes_of(points)
        begins = word_starts(classes)
        bounds = np.flatnonzero(begins | (classes == SPACE))
        ends = np.append(bounds[1:], len(text))
        own = begins[bounds]
        starts, ends = bounds[own], ends[own]
        # where the characters lie in UTF-8
        at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF))])
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        emitted = self.merges.counts(data, at[starts], at[ends] - at[starts])
        firsts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        part_of = np.searchsorted(firsts, starts, side="right") - 1
        np.add.at(out, np.asarray(owners), np.bincount(part_of, emitted, len(parts)).astype(np.int64))


def _slices(text: str) -> Iterator[str]:
    """Parts of a long text, cut before a space, so that no word crosses a cut."""
    at = 0
    while len(text) - at > 2 * SLICE_CHARS:
        cut = text.find(" ", at + SLICE_CHARS)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def report(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, vocabulary: str | None = None,
) -> DataFrame:
    """Bytes, tokens and whether they are more than ``limit``, for every row."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in sliced(batches):
            n = tokens.count_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                     F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
