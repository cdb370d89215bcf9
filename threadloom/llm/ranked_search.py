"""Ranked lexical search: documents with equal bags are one class, scored once.

The vocabulary is that of the items. A document's bag is the sorted list of
(term, occurrences) for the terms of the vocabulary it holds, and its score for
any item follows from the bag and its length mark m alone. Documents with equal
bag and equal m are a class: they are brought together by a 64-bit hash and the
grouping compares bag and m themselves. Each class is scored against all items
in NumPy over Arrow batches; a task keeps the best classes of every item. No
more than ``limit`` classes can hold an item's ``limit`` best documents, as each
class is tried by its smallest id first; their members are then expanded by
ascending id, ``limit`` of a class at most.

Items are taken in blocks of about ``BLOCK`` (item, term) pairs, so that what a
task holds does not grow with their number; a block is one pass over the
documents. All numbers but the logarithm are 64-bit integers.

Null and empty texts have no terms: such documents count nowhere and are never
found, such items find nothing. Rows with the same item id are one item with the
terms of all of them; items without an id are one item. Repeated document rows
are documents of their own and each takes a rank. Documents without an id are
ranked after those of equal score with one. Empty tables give no rows. Other
columns of either table are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.tables import sliced
from threadloom.llm.terms import WORDS_AND_NUMBERS as TERMS
from threadloom.plans.ordered import running_total
from threadloom.session import written

#: (item, term) pairs of a block of items; a block ends with the item that reaches it.
BLOCK = 300_000
#: Classes scored at once by a task, and candidates it holds before it drops the worse ones.
CLASSES, CANDIDATES = 256, 400_000
# Length marks: m = MARK_BASE - MARK_SHARE + (MARK_SHARE * n * N) div L
MARK_BASE, MARK_SHARE = 100, 50

BAGS = "doc_id long, n long, bag binary"
CANDIDATE = "item_no long, score long, first long, hash long, m long, bag binary"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [sorted(set(TERMS(t))) for t in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(at)), pa.array([t for f in found for t in f], pa.binary())],
                ["item_id", "term"])

    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(split, f"item_id {kind}, term binary").distinct()


def item_blocks(terms: DataFrame, block: int) -> DataFrame:
    """(item_no, item_id, block): consecutive items share a block until it is full."""
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    filled = running_total(sizes, [], ["item_id"], F.col("size"), "upto")
    # the last number of an item's pairs tells the items apart
    return filled.select(F.col("upto").alias("item_no"), "item_id",
                         F.expr(f"(upto - size) div {block}").alias("block"))


def bags(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, bag): number of terms and the packed (term, occurrences) within the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in sliced(batches, 256):
            sizes, packed = [], []
            for body in batch.column("text").to_pylist():
                found = TERMS(body)
                sizes.append(len(found))
                held = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                packed.append(np.array(held, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "n", "bag"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(count, BAGS)


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and occurrences of all entries of some bags."""
    held = column.to_pylist()
    entries = np.frombuffer(b"".join(held), "<i4").reshape(-1, 2)
    return np.repeat(np.arange(len(held)), [len(b) // 8 for b in held]), entries[:, 0], entries[:, 1].astype(np.int64)


def document_counts(bagged: DataFrame, n_terms: int) -> np.ndarray:
    """Documents holding each term of the vocabulary; every task sends one sum per term."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in sliced(batches):
            total += np.bincount(_opened(batch.column("bag"))[1], minlength=n_terms)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], ["term", "df"])

    sums = bagged.select("bag").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(n_terms, np.int64)
    for row in sums.collect():  # at most one row a term of the block
        out[row["term"]] = row["df"]
    return out


def best_classes(classes: DataFrame, weights: np.ndarray, starts: np.ndarray, holders: np.ndarray,
                 numbers: np.ndarray, limit: int) -> DataFrame:
    """Candidates for each item's ``limit`` best classes, from every task.

    ``holders[starts[t]:starts[t + 1]]`` are the items that hold term t; ``numbers`` are their item_no.
    """
    n_items, degree = len(numbers), np.diff(starts)
    last = np.iinfo(np.int64).max

    def scores(column: pa.Array, m: np.ndarray) -> np.ndarray:
        row, term, tf = _opened(column)
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        times = degree[term]
        ends = np.cumsum(times)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times - starts[term], times)
        cell = np.repeat(row, times) * n_items + holders[at]
        part = np.repeat(part, times)
        # sums of halves below 2 ** 27 are exact in doubles
        high = np.bincount(cell, part >> 26, minlength=len(m) * n_items)
        low = np.bincount(cell, part & ((1 << 26) - 1), minlength=len(m) * n_items)
        return ((high.astype(np.int64) << 26) + low.astype(np.int64)).reshape(len(m), n_items)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.ones(n_items, np.int64)  # only scores above 0 count
        kept: list[tuple] = []  # item, score, first, hash, m, and the batch and row of the bag
        held = 0

        def best() -> list[np.ndarray]:
            cols = [np.concatenate(c) for c in zip(*kept)]
            cols = [c[np.lexsort((cols[3], cols[2], -cols[1], cols[0]))] for c in cols]
            begins = np.searchsorted(cols[0], np.arange(n_items))
            return [c[np.arange(len(cols[0])) - begins[cols[0]] < limit] for c in cols]

        for batch in sliced(batches, CLASSES):
            m = batch.column("m").to_numpy(zero_copy_only=False)
            found = scores(batch.column("bag"), m)
            row, item = np.nonzero(found >= floor)
            if not len(row):
                continue
            first = batch.column("first").fill_null(last).to_numpy(zero_copy_only=False)
            packed = np.array(batch.column("bag").to_pylist(), object)
            kept.append((item, found[row, item], first[row],
                         batch.column("hash").to_numpy(zero_copy_only=False)[row], m[row], packed[row]))
            held += len(row)
            if held > CANDIDATES + n_items * limit:
                kept = [tuple(best())]
                held = len(kept[0][0])
                full = np.bincount(kept[0][0], minlength=n_items) >= limit
                lowest = np.full(n_items, last)
                np.minimum.at(lowest, kept[0][0], kept[0][1])
                floor = np.where(full, lowest, floor)
        if kept:
            item, points, first, key, m, packed = best()
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[item]), pa.array(points), pa.array(first, mask=first == last), pa.array(key),
                 pa.array(m), pa.array(packed.tolist(), pa.binary())],
                ["item_no", "score", "first", "hash", "m", "bag"])

    return classes.mapInArrow(score, CANDIDATE)


def _block(docs: DataFrame, pairs: list, limit: int, doc_id: str, text: str, totals: tuple[int, int] | None):
    """(item_no, rank, doc_id, score) for the items of one block, and the totals N and L."""
    vocabulary = sorted({bytes(r["term"]) for r in pairs})
    numbers = np.array(sorted({r["item_no"] for r in pairs}), np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    held = sorted((number[bytes(r["term"])], r["item_no"]) for r in pairs)
    starts = np.searchsorted([t for t, _ in held], np.arange(len(vocabulary) + 1))
    holders = np.searchsorted(numbers, [i for _, i in held])

    bagged = written(bags(docs, vocabulary, doc_id, text), "bags")
    if totals is None:
        row = bagged.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        totals = row[0], row[1] or 0
    n_docs, n_terms = totals
    df = document_counts(bagged, len(vocabulary))
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)

    share = F.lit(MARK_SHARE).cast("long") * F.col("n") * F.lit(n_docs)
    marked = bagged.filter(F.length("bag") > 0).withColumn(
        "m", F.lit(MARK_BASE - MARK_SHARE) + F.call_function("div", share, F.lit(max(n_terms, 1)))).withColumn(
        "hash", F.xxhash64("bag", "m"))
    same = ["hash", "m", "bag"]
    classes = marked.groupBy(*same).agg(F.min("doc_id").alias("first"))
    found = best_classes(classes, weights, starts, holders, numbers, limit)
    order = [F.desc("score"), F.asc_nulls_last("first"), F.asc("hash")]
    top = written(
        found.withColumn("place", F.row_number().over(Window.partitionBy("item_no").orderBy(*order)))
        .filter(F.col("place") <= limit).drop("place", "first"), "best-classes")
    members = marked.join(top.select(*same).distinct(), same).select("doc_id", *same)
    in_class = Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("place", F.row_number().over(in_class)).filter(F.col("place") <= limit)
    by_score = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = top.join(members.drop("place"), same).select(
        "item_no", F.row_number().over(by_score).alias("rank"), "doc_id", "score")
    return ranked.filter(F.col("rank") <= limit), totals


def search(docs: DataFrame, items: DataFrame, limit: int = 50, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``limit`` best documents of each item with a score above 0."""
    pairs = written(item_terms(items, item_id, item_text), "item-terms")
    named = written(item_blocks(pairs, block), "items")
    n_blocks = (named.agg(F.max("block")).first()[0] or 0) + 1
    found, totals = None, None
    for b in range(n_blocks):
        mine = named.filter(F.col("block") == b)
        rows = mine.join(pairs, mine["item_id"].eqNullSafe(pairs["item_id"])).select("item_no", "term").collect()
        ranked, totals = _block(docs, rows, limit, doc_id, text, totals)
        found = ranked if found is None else found.unionByName(ranked)
    return found.join(named.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
