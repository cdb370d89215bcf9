"""Divergence of sources: joint cells of count-level bitmaps.

A language keeps the terms that occur in at least ``MIN_DOCS`` of its documents,
numbered by falling count. For every group (language, source), every count n > 0
and every ``CHUNK`` consecutive numbers, the terms that occur n times in the
group are the bits of two 64-bit words; what no count holds is the bitmap of
count 0, found by complement. Two sources' joint cell of counts a and b has the
popcount of the AND of two bitmaps as its size, and all its terms share the same
p, q and f, so a pair's value is the sum over cells of size times f. Chunks and
blocks of sources are dealt over tasks; a task returns one sum per pair.

Counts are added up inside each task before they are shuffled. p is found in
decimals of 38 digits; f and its sums fit 64 bits as long as a language keeps
fewer than 2 ** 31 terms.

Null text, language and source are empty strings. A group whose documents have
no term, or none that is kept, has count 0 everywhere; where nothing is kept all
pairs have value 0 and there are no terms. Repeated rows are documents of their
own. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.tables import sliced
from threadloom.llm.terms import WORDS as TERMS
from threadloom.plans.ordered import rank_rows
from threadloom.plans.skew import salted_join
from threadloom.session import written

MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Terms of a bitmap, bitmaps' chunks of a task, sources of a block.
CHUNK, CHUNKS, SOURCES = 128, 128, 32
#: Entries a task counts before it hands them on.
ENTRIES = 400_000
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs) with a row without term for every group."""
    names = ["lang", "source", "term", "n", "docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (in_lang, in_source), (n, of_docs) in held.items():
                found = list(n)
                size = len(found) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([in_lang] * size), pa.array([in_source] * size), pa.array([None, *found], pa.binary()),
                     pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(of_docs.__getitem__, found)], pa.int64())],
                    names)

        for batch in sliced(batches, 256):
            columns = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
            for in_lang, in_source, body in zip(*columns):
                n, of_docs = held.setdefault((in_lang, in_source), (Counter(), Counter()))
                found = TERMS(body)
                n.update(found)
                of_docs.update(set(found))
            if sum(len(n) for n, _ in held.values()) > ENTRIES:
                yield from rows()
                held.clear()
        yield from rows()

    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))),
                        F.col(f"`{text}`").cast("binary").alias("text"))
    counted = named.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(UNIT * (n + 1) / (total + kept)), exact."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", whole, F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)")).cast("long") + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def bitmaps(held: DataFrame) -> DataFrame:
    """(lang, source, chunk, n, w0, w1): the terms of a chunk that occur n times in the group."""
    at = F.col("no") % CHUNK
    bit = F.expr(f"shiftleft(1L, cast(no % {CHUNK} % 64 as int))")
    words = [F.coalesce(F.bit_or(F.when(F.floor(at / 64) == w, bit)), F.lit(0).cast("long")).alias(f"w{w}")
             for w in range(CHUNK // 64)]
    return held.groupBy(*GROUP, F.expr(f"no div {CHUNK}").alias("chunk"), "n").agg(*words)


def _popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint8)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] & b[None, :, w])
    return out


def _levels(rows: pd.DataFrame, heads: pd.DataFrame, universe: np.ndarray):
    """Place of the source, p and bits of all levels of a chunk, count 0 included."""
    ids = heads["s"].to_numpy()
    at = np.searchsorted(ids, rows["s"].to_numpy())
    bits = rows[[f"w{w}" for w in range(CHUNK // 64)]].to_numpy().astype(np.int64).view(np.uint64)
    some = np.zeros((len(ids), bits.shape[1]), np.uint64)
    np.bitwise_or.at(some, at, bits)
    return (np.concatenate([at, np.arange(len(ids))]), np.concatenate([rows["p"].to_numpy(), heads["p"].to_numpy()]),
            np.concatenate([bits, ~some & universe]))


def _cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of size times f over the joint cells of all pairs of two blocks of sources."""
    lo, hi, kept = pdf["lo"].iloc[0], pdf["hi"].iloc[0], int(pdf["kept"].iloc[0])
    heads = pdf[pdf["chunk"] < 0].sort_values("s")
    sides = [heads[heads["block"] == b] for b in (lo, hi)]
    there = np.zeros((len(sides[0]), len(sides[1])), np.int64)  # q of the second
    back = np.zeros_like(there)
    for chunk, rows in pdf[pdf["chunk"] >= 0].groupby("chunk"):
        size = min(CHUNK, kept - int(chunk) * CHUNK)
        universe = np.array([(1 << max(0, min(64, size - 64 * w))) - 1 for w in range(CHUNK // 64)], np.uint64)
        (at_a, p_a, bits_a), (at_b, p_b, bits_b) = (
            _levels(rows[rows["block"] == b], heads_b, universe) for b, heads_b in zip((lo, hi), sides))
        for begin in range(0, len(at_a), 512):
            size_of = _popcounts(bits_a[begin:begin + 512], bits_b)
            i, j = np.nonzero(size_of)
            n, i = size_of[i, j].astype(np.int64), i + begin
            gap = (p_a[i] - p_b[j]) ** 2
            np.add.at(there, (at_a[i], at_b[j]), n * (gap // p_b[j]))
            if lo != hi:
                np.add.at(back, (at_a[i], at_b[j]), n * (gap // p_a[i]))
    a, b = np.meshgrid(sides[0]["s"].to_numpy(), sides[1]["s"].to_numpy(), indexing="ij")
    ways = [(a, b, there)] if lo == hi else [(a, b, there), (b, a, back)]
    out = pd.concat([pd.DataFrame({"s": x.ravel(), "other": y.ravel(), "value": v.ravel()}) for x, y, v in ways])
    out = out[out["s"] != out["other"]]
    return out.assign(lang=pdf["lang"].iloc[0])[["lang", "s", "other", "value"]]


def pair_values(bits: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, s, other, value) for all ordered pairs of sources of a language, by their numbers."""
    per_source = groups.select(
        *GROUP, "s", F.expr(f"(s - 1) div {SOURCES}").alias("block"), "total", "kept",
        F.expr(f"(max(s) over (partition by lang) - 1) div {SOURCES}").alias("last"))
    parts = F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(kept - 1, 0) div {CHUNK * CHUNKS}"))
    heads = per_source.select(
        "lang", F.explode(parts).alias("part"), "s", "block", "last", "kept", F.lit(-1).cast("long").alias("chunk"),
        share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p"),
        *(F.lit(0).cast("long").alias(f"w{w}") for w in range(CHUNK // 64)))
    rows = salted_join(bits, per_source, GROUP, ["chunk", "n"]).select(
        "lang", F.expr(f"chunk div {CHUNKS}").alias("part"), "s", "block", "last", "kept", "chunk",
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), *(f"w{w}" for w in range(CHUNK // 64)))
    both = heads.unionByName(rows).withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    tiles = both.withColumn("lo", F.least("block", "side")).withColumn("hi", F.greatest("block", "side")).drop("side", "last")
    sums = tiles.groupBy("lang", "part", "lo", "hi").applyInPandas(_cells, "lang string, s long, other long, value long")
    return sums.groupBy("lang", "s", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources, and each group's most typical terms."""
    totals = written(term_counts(docs, text, lang, source), "term-counts")
    per_term = totals.filter("term is not null").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).filter(F.col("docs") >= min_docs)
    numbered = rank_rows(per_term.select("lang", "term", "in_lang", (-F.col("in_lang")).alias("falling")),
                         ["lang"], ["falling", "term"], "no")
    held = written(totals.filter("term is not null").drop("docs").join(
        numbered.select("lang", "term", "in_lang", (F.col("no") - 1).alias("no")), ["lang", "term"]), "kept-counts")

    sizes = numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("lang_total"))
    sums = held.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = rank_rows(totals.filter("term is null").select(*GROUP), ["lang"], ["source"], "s")
    groups = written(groups.join(sums, GROUP, "left").join(sizes, "lang", "left").select(
        *GROUP, "s", *(F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total"))), "groups")

    bits = written(bitmaps(held), "count-bitmaps")
    names = groups.select("lang", "s", "source")
    pairs = pair_values(bits, groups).join(names, ["lang", "s"]).join(
        names.select("lang", F.col("s").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    # salted, so that the best terms are cut down before a large group comes together
    typical = salted_join(held, groups, GROUP, ["term"]).select(
        *GROUP, F.col("term").cast("string").alias("item"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q")).filter("p > q")
    typical = typical.select(*GROUP, F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(typical)
