"""Near copies by MinHash signatures and a multi-index Hamming join.

A text's set is its distinct word shingles (ASCII lower case; a text with fewer
words than a shingle is one shingle). Equal sets are one class. A class has a
signature of ``chunks`` x ``CHUNK`` symbols of 16 bits. If two signatures differ
in at most ``max_distance`` symbols then, by the pigeonhole principle, some chunk
differs in at most ``max_distance // chunks`` = 1 symbol, so both have a key in
common: a chunk with one symbol left out. No pair within the distance is missed;
at the default sizes a pair of similarity 0.8 is beyond it about once in a
million. Links are confirmed on the whole sets.

Buckets of a common key are never turned into all their pairs. First every
member is tried against one member of its bucket, drawn by hash; then against
the one that most links were found for, which lies near the middle of a group.
What is linked becomes one component. What remains is compared by signature in
tiles of bounded size, where a longer signature with symbols of 8 bits is looked
at too. Rows with a near partner of another component bring their texts to the
tile, and only links that join components leave it.

Null and empty texts and texts without words have an empty set and link with
nothing. Repeated rows have equal sets; each is returned. A row without an id
takes part and is never the kept one if another row of its component has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.tables import packed, sliced, unpacked
from threadloom.plans.components import connected_components
from threadloom.plans.skew import salted_join
from threadloom.session import checkpointed, few_files, written

CHUNK = 4
#: Symbols of the longer signature; how many may differ is 0.2 of all plus 4.75 standard deviations.
FINE = 144
TILE_ROWS = 1024
#: Texts of a block when links are confirmed; draws that choose the first partner in a bucket.
BLOCK_TEXTS, DRAWS = 512, 6
#: Rows of a task that writes a table, at least: signatures, texts that are compared, whole documents.
CLASS_ROWS, COMPARED_ROWS, DOCUMENT_ROWS = 10_000, 2_000, 5_000


@dataclass(frozen=True)
class NearCopyRules:
    shingle: int = 5
    similar_percent: int = 80
    chunks: int = 12

    @property
    def max_distance(self) -> int:
        return 2 * self.chunks - 1

    @property
    def symbols(self) -> int:
        return self.chunks * CHUNK

    @property
    def max_fine_distance(self) -> int:
        n, p = self.symbols + FINE, 1 - self.similar_percent / 100
        return int(n * p + 4.75 * (n * p * (1 - p)) ** 0.5) + 1


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(size, len(words))):
        out = (out ^ hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    draw = rng.integers(0, 2**64, (2, n, 1), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def signature(hashes: np.ndarray, symbols: int) -> bytes:
    """``symbols`` symbols of 16 bits, then ``FINE`` of 8 bits."""
    a, b = _multipliers(symbols + FINE)
    least = np.full(symbols + FINE, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 2048):  # bounds the memory of a long text
        least = np.minimum(least, (hashes[start:start + 2048] * a + b).min(axis=1))
    mixed = least * np.uint64(0xD6E8FEB86659FD93)
    return (mixed[:symbols] >> np.uint64(48)).astype("<u2").tobytes() + (mixed[symbols:] >> np.uint64(56)).astype(np.uint8).tobytes()


def _symbols(column: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Both signatures of a column, one row each."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(rows[:, :2 * symbols]).view("<u2"), rows[:, 2 * symbols:]


def _marked(df: DataFrame, rules: NearCopyRules) -> DataFrame:
    """Add the set's size, a 128-bit digest in two longs, and the signature."""
    size, symbols = rules.shingle, rules.symbols

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, hi, lo, sig = [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, size)
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                n.append(len(hashes))
                hi.append(int.from_bytes(digest[:8], "big", signed=True))
                lo.append(int.from_bytes(digest[8:], "big", signed=True))
                sig.append(signature(hashes, symbols) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), pa.array(sig, pa.binary())], ["row", "id", "n", "hi", "lo", "sig"])

    schema = df.select("row", "id").schema.add("n", "long").add("hi", "long").add("lo", "long").add("sig", "binary")
    return df.select("row", "id", "text").mapInArrow(mark, schema).withColumn("no", F.monotonically_increasing_id())


def _keys(classes: DataFrame, rules: NearCopyRules) -> DataFrame:
    """(key, no): every chunk with one of its symbols left out; the key holds chunk, position and symbols."""
    chunks = rules.chunks

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _symbols(batch.column("sig"), chunks * CHUNK)[0].reshape(-1, chunks, CHUNK).astype(np.int64)
            keys = np.empty((len(sig), chunks, CHUNK), np.int64)
            for out in range(CHUNK):
                code = np.broadcast_to(np.arange(chunks) * CHUNK + out, sig.shape[:2]).copy()
                for k in range(CHUNK):
                    if k != out:
                        code = (code << 16) | sig[:, :, k]
                keys[:, :, out] = code
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column("no").to_numpy(), chunks * CHUNK))],
                ["key", "no"])

    return classes.select("no", "sig").mapInArrow(make, "key long, no long")


def _within(pairs: DataFrame, classes: DataFrame, rules: NearCopyRules) -> DataFrame:
    """Pairs (a, b) whose signatures are near."""
    symbols, most, most_fine = rules.symbols, rules.max_distance, rules.max_fine_distance

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, fine_a), (b, fine_b) = (_symbols(batch.column(c), symbols) for c in ("sig_a", "sig_b"))
            differ = (a != b).sum(axis=1)
            keep = (differ <= most) & (differ + (fine_a != fine_b).sum(axis=1) <= most_fine)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    sig = classes.select("no", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    return both.mapInArrow(near, "a long, b long")


class _Forest(dict):
    """Which nodes are joined so far."""

    def root(self, x: int) -> int:
        while x in self:
            x = self[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def _similar(s: np.ndarray, t: np.ndarray, rules: NearCopyRules) -> bool:
    if 100 * min(len(s), len(t)) < rules.similar_percent * max(len(s), len(t)):
        return False
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= rules.similar_percent * (len(s) + len(t) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, rules: NearCopyRules, most: int, every: bool = False) -> DataFrame:
    """Pairs, ``most`` at most, whose whole sets are similar enough.

    Texts are dealt to blocks, and a tile of two blocks gets each text once,
    however many of its pairs lie there. Unless ``every`` pair is asked for, one
    whose ends are joined by links of the same tile is passed over.
    """
    size = rules.shingle
    pairs = checkpointed(few_files(pairs, most))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct().count()
    blocks = F.lit(1 + ends // BLOCK_TEXTS)
    block = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    tiled = pairs.select(F.least(block("a"), block("b")).alias("lo"), F.greatest(block("a"), block("b")).alias("hi"), "a", "b")
    needed = tiled.select("lo", "hi", F.explode(F.array("a", "b")).alias("no")).distinct()
    rows = needed.join(texts, "no").select("lo", "hi", F.col("no").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(tiled.withColumn("text", F.lit(None).cast("string")))
    rows = rows.repartition("lo", "hi").sortWithinPartitions("lo", "hi", F.col("b").asc_nulls_first(), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets, forest = None, {}, _Forest()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for lo, hi, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "a", "b", "text"))):
                if tile != (lo, hi):
                    tile, sets, forest = (lo, hi), {}, _Forest()
                if b is None:
                    sets[a] = shingle_set(text, size)
                    continue
                if not every and forest.root(a) == forest.root(b):
                    continue
                if _similar(sets[a], sets[b], rules):
                    found.append((a, b))
                    forest.join(a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return few_files(rows.mapInArrow(check, "a long, b long"), ends, COMPARED_ROWS)


def _star(buckets: DataFrame, rank: Column) -> DataFrame:
    """Each member with the one member of its bucket that is first by ``rank``."""
    heads = buckets.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "no")).alias("head"))
    return buckets.join(heads, "key").filter("no <> head.no").select(
        F.least("no", "head.no").alias("a"), F.greatest("no", "head.no").alias("b")).distinct()


def _open_buckets(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, no, part, size) of the buckets that hold more than one component."""
    placed = buckets.join(parts, "no", "left").withColumn("part", F.coalesce("part", "no"))
    several = placed.groupBy("key").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("size"),
    ).filter("lo <> hi").select("key", "size")
    return placed.join(several, "key")


Rows = dict[str, np.ndarray]


def _near_in_tiles(rows: Rows, rules: NearCopyRules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers: of one tile, different components, near signatures, and this the first key they share.

    Rows are sorted by tile; row i is held against row i + d for each distance d inside its tile.
    """
    key, lo, hi, block, part, sig, fine = (rows[c] for c in ("key", "lo", "hi", "block", "part", "sig", "fine"))
    first = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
    end = np.r_[np.flatnonzero(first)[1:], len(key)][np.cumsum(first) - 1]  # where each row's tile ends
    live = np.flatnonzero(np.arange(len(key)) + 1 < end)
    d = 1
    while len(live):
        i, j = live, live + d
        use = (part[i] != part[j]) & ((lo[i] == hi[i]) | (block[i] != block[j]))
        i, j = i[use], j[use]
        for at in range(0, len(i), 4096):
            x, y = i[at:at + 4096], j[at:at + 4096]
            differ = sig[x] != sig[y]
            n = differ.sum(axis=1)
            near = np.flatnonzero(n <= rules.max_distance)
            near = near[n[near] + (fine[x[near]] != fine[y[near]]).sum(axis=1) <= rules.max_fine_distance]
            x, y, differ = x[near], y[near], differ[near].reshape(-1, rules.chunks, CHUNK)
            chunk = (differ.sum(axis=2) <= 1).argmax(axis=1)
            out = differ[np.arange(len(x)), chunk].argmax(axis=1)
            mine = (key[x] >> 48) == chunk * CHUNK + out
            if mine.any():
                yield x[mine], y[mine]
        d += 1
        live = live[live + d < end[live]]


def _by_tiles(batches: Iterator[pa.RecordBatch], rules: NearCopyRules, work, text: bool) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of whole tiles; a tile may go on in the next batch."""
    rest: Rows | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "no", "part")}
        rows["sig"], rows["fine"] = _symbols(batch.column("sig"), rules.symbols)
        if text:
            rows["set"] = np.empty(batch.num_rows, object)
            for i, t in enumerate(batch.column("text").to_pylist()):
                rows["set"][i] = shingle_set(t, rules.shingle)
        if rest is not None:
            rows = {c: np.concatenate([rest[c], rows[c]]) for c in rows}
        same = (rows["key"] == rows["key"][-1]) & (rows["lo"] == rows["lo"][-1]) & (rows["hi"] == rows["hi"][-1])
        cut = int(np.argmax(same))
        if cut:
            yield work({c: x[:cut] for c, x in rows.items()})
        rest = {c: x[cut:] for c, x in rows.items()}
    if rest is not None:
        yield work(rest)


def _tiled(opened: DataFrame, classes: DataFrame, texts: DataFrame, rules: NearCopyRules) -> DataFrame:
    """The links between components of a bucket, as far as they join something in their tile.

    First signatures alone tell which rows have a near partner in a tile; only
    those bring their texts to it, where the links are confirmed.
    """
    blocks = F.ceil(F.col("size") / TILE_ROWS).cast("int")
    rows = opened.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("no", F.lit("block")), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = ["key", "lo", "hi"]
    columns = [*tile, "block", "no", "part"]
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).select(columns)

    def in_tiles(df: DataFrame) -> DataFrame:
        return df.join(classes.select("no", "sig"), "no").repartition(*tile).sortWithinPartitions(*tile, "no")

    def mark(rows: Rows) -> pa.RecordBatch:
        met = np.zeros(len(rows["no"]), bool)
        for x, y in _near_in_tiles(rows, rules):
            met[x] = met[y] = True
        return pa.RecordBatch.from_arrays([pa.array(rows[c][met]) for c in columns], columns)

    def link(rows: Rows) -> pa.RecordBatch:
        forests: dict[tuple, _Forest] = {}
        found: list[tuple[int, int]] = []
        sets, part, no = rows["set"], rows["part"], rows["no"]
        for xs, ys in _near_in_tiles(rows, rules):
            for x, y in zip(xs.tolist(), ys.tolist()):
                forest = forests.setdefault((rows["key"][x], rows["lo"][x], rows["hi"][x]), _Forest())
                if forest.root(part[x]) != forest.root(part[y]) and _similar(sets[x], sets[y], rules):
                    forest.join(part[x], part[y])
                    found.append((no[x], no[y]))
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    marked = in_tiles(rows).mapInArrow(
        lambda batches: _by_tiles(batches, rules, mark, False), "key long, lo int, hi int, block int, no long, part long")
    return in_tiles(marked.join(texts, "no")).mapInArrow(
        lambda batches: _by_tiles(batches, rules, link, True), "a long, b long")


def _labels(links: DataFrame, most: int) -> DataFrame:
    return connected_components(links, [], "a", "b", most).select(F.col("node").alias("no"), F.col("label").alias("part"))


def _components(classes: DataFrame, texts: DataFrame, rules: NearCopyRules) -> DataFrame:
    """(no, part) of the classes that are linked with another; ``part`` is the smallest no."""
    keys = _keys(classes, rules)
    shared = keys.groupBy("key").agg(F.min("no").alias("lo"), F.max("no").alias("hi")).filter("lo <> hi")
    buckets = written(few_files(keys.join(shared.select("key"), "key"), classes.count() * rules.symbols), "buckets")
    most = buckets.count()  # a member is in one pair of its bucket at a time

    drawn = _star(buckets, F.xxhash64("no", F.pmod("key", F.lit(DRAWS))))
    first = written(_confirmed(_within(drawn, classes, rules), texts, rules, most, every=True), "links")
    degree = first.select(F.explode(F.array("a", "b")).alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("degree"))
    ranked = buckets.join(degree, "no", "left")
    middle = _star(ranked, -F.coalesce("degree", F.lit(0))).join(first, ["a", "b"], "left_anti")
    second = written(_confirmed(_within(middle, classes, rules), texts, rules, most), "links")
    linked = first.unionByName(second)
    parts = checkpointed(_labels(linked, linked.count()))

    opened = written(few_files(_open_buckets(buckets, parts), most), "opened")
    last = written(few_files(_tiled(opened, classes, texts, rules), opened.count(), COMPARED_ROWS), "links")
    if last.isEmpty():
        return parts
    known = parts.select(F.col("no").alias("a"), F.col("part").alias("u"))
    merged = last.join(known, "a", "left").join(known.toDF("b", "v"), "b", "left").select(
        F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b"))
    joined = _labels(merged, last.count()).toDF("part", "whole")  # of components and single classes
    moved = parts.join(joined, "part", "left").select("no", F.coalesce("whole", "part").alias("part"))
    alone = joined.join(parts.select(F.col("no").alias("part")), "part", "left_anti")
    return moved.unionByName(alone.toDF("no", "part"))


def grouped(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: NearCopyRules = NearCopyRules(),
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, id, no, n, component_id, first): every row with its component.

    ``component_id`` is the smallest id in the component, ``first`` marks the
    one row that stands for it. ``row`` holds the columns ``keep``, or all.
    """
    rows = packed(df, id=doc_id, text=text)
    columns = list(keep if keep is not None else df.columns)
    if text not in columns:  # the whole text is needed once more, for the links
        columns.append(text)
    rows = rows.withColumn("row", F.struct(*(F.col(f"row.`{c}`") for c in columns)))
    marks = written(_marked(rows, rules), "marks")
    owners = marks.filter("n > 0").groupBy("hi", "lo").agg(F.min("no").alias("no"))
    n = marks.count()
    classes = written(few_files(marks.select("no", "sig").join(owners.select("no"), "no"), n, CLASS_ROWS), "classes")
    texts = marks.select("no", F.col(f"row.`{text}`").alias("text"))
    parts = _components(classes, texts, rules)
    owners = owners.join(parts, "no", "left").select("hi", "lo", F.coalesce("part", "no").alias("part"))
    placed = marks.select("hi", "lo", "id", "no", "n").filter("n > 0").join(owners, ["hi", "lo"])
    heads = placed.groupBy("part").agg(
        F.min("id").alias("component_id"),
        F.min(F.struct(F.col("id").isNull().alias("late"), "id", "no")).alias("head"))
    placed = salted_join(placed, heads, ["part"], ["no"]).select("no", "component_id", (F.col("no") == F.col("head.no")).alias("first"))
    out = few_files(marks.select("row", "id", "no", "n").join(placed, "no", "left"), n, DOCUMENT_ROWS)
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))) \
        .withColumn("first", F.coalesce("first", F.lit(True)))


def report(df: DataFrame, rules: NearCopyRules = NearCopyRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size, component and whether the row's id is the component's, for every row."""
    return grouped(df, doc_id, text, rules, keep=[]).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, rules: NearCopyRules = NearCopyRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, and every row without words, with their own columns."""
    return unpacked(grouped(df, doc_id, text, rules).filter("first"))
