"""Packing token sequences: repeat counts of length combinations by non-negative least squares.

Whole windows are cut from the start of a long document. What is left of each
document is shorter than a window; the histogram of these lengths (at most as
many numbers as a window has tokens) goes to the driver. There, all combinations
of up to three lengths that fill a window exactly are enumerated, their repeat
counts are solved against the histogram by non-negative least squares, and
rounded without using a length more often than it occurs. In Spark the k-th
document of a length takes the k-th place that the combinations have for it.
The residuals are packed greedily, cut where a window is full; the last tokens
fill sequences whose sizes are powers of two. So no sequence is padded.

Null and empty texts are one token, the end mark. Repeated rows are packed as
often as they occur. Rows without an id are packed too. An empty table gives no
pieces. Each token lies in exactly one piece.

Ids are neither written nor shuffled: the pass that makes them returns the
checksums of the whole windows and of the rest. Only rests that were cut are
encoded once more, each different text once; a text is known by two 64-bit hashes.
Texts are shuffled for that only where the cut ones are too many for a broadcast
join of Spark's own choice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.byte_ids import RANKS, VOCABULARY, encoder
from threadloom.llm.tables import sliced
from threadloom.plans.ordered import rank_rows, running_total
from threadloom.session import few_files, written

WINDOW = 2048
END_ID = 1
#: The solver ends when CHECK_ROUNDS rounds lessen the squared error by less than this share of it.
SETTLED, CHECK_ROUNDS = 0.02, 25


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, ascending, that fill the window; 0 stands for no third."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    lengths = np.sort(lengths)
    found = [np.empty((0, 3), np.int64)]
    for a in [0, *lengths.tolist()]:
        b = lengths[(lengths >= max(a, 1)) & (2 * lengths <= window - a)]
        b = b[there[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def solve_counts(combos: np.ndarray, counts: np.ndarray, settled: float = SETTLED) -> np.ndarray:
    """Real repeat counts >= 0 that bring the used lengths near ``counts``.

    Multiplicative updates for least squares: no count turns negative and the
    squared error never grows, so the rounds end when it no longer falls by
    ``settled``. ``counts`` is indexed by length; index 0 is free.
    """
    size = len(counts)
    goal = counts.astype(float)
    goal[0] = 0
    held = (combos > 0)
    gather = lambda v: (v[combos] * held).sum(axis=1)
    used = lambda x: np.bincount(combos.ravel(), (held * x[:, None]).ravel(), minlength=size)
    x = np.full(len(combos), max(goal.sum(), 1.0) / (2.5 * max(len(combos), 1)))
    top = gather(goal)
    error = np.inf
    while True:
        for _ in range(CHECK_ROUNDS):
            x = x * (top / np.maximum(gather(used(x)), 1e-12))
        now = float(((used(x)[1:] - goal[1:]) ** 2).sum())
        if now >= error * (1 - settled) or now <= 1e-9 * float((goal ** 2).sum()):
            return x
        error = now


def rounded(combos: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeat counts that use no length more often than it occurs."""
    left = counts.astype(np.int64).copy()
    left[0] = np.iinfo(np.int64).max // 4
    out = np.zeros(len(combos), np.int64)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.05:  # the rest is left to the residuals
            break
        a, b, c = combos[i].tolist()
        need: dict[int, int] = {}
        for n in (a, b, c):
            if n:
                need[n] = need.get(n, 0) + 1
        most = min(int(left[n]) // k for n, k in need.items())
        out[i] = take = min(int(np.ceil(x[i])), most)
        for n, k in need.items():
            left[n] -= k * take
    return out


def places(counts: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, from_rank, to_rank, first sequence, offset), and the number of sequences they fill."""
    combos = combinations(np.flatnonzero(counts), window) if counts.any() else np.empty((0, 3), np.int64)
    if not len(combos):
        return [], 0
    repeats = rounded(combos, solve_counts(combos, counts), counts)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for i in np.flatnonzero(repeats):
        offset, n = 0, int(repeats[i])
        for length in combos[i].tolist():
            if length:
                at = used.get(length, 0)
                rows.append((length, at, at + n, sequence, offset))
                used[length] = at + n
                offset += length
        sequence += n
    return rows, sequence


def tail_bounds(total: int, window: int) -> list[int]:
    """Ends of the sequences after the last full window: descending powers of two."""
    at, rest, out = total - total % window, total % window, []
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
        out.append(at)
    return out


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, h1, h2): the hashes name a text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"),
                     F.xxhash64(body).alias("h1"), F.xxhash64(body, F.lit(1)).alias("h2"))


def _sums(ids: bytes, dtype: np.dtype, lengths: list[int]) -> list[int]:
    """Checksums of consecutive pieces of some ids, as 32-bit numbers."""
    wide = np.frombuffer(ids, dtype).astype("<u4").tobytes()
    ends = np.cumsum([0, *lengths]) * 4
    return [zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _summed(texts: DataFrame, window: int, vocabulary: str, ranks: str, end_id: int) -> DataFrame:
    """(no, doc_id, h1, h2, n, crcs): checksums of all whole windows of a row, then of its rest."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in sliced(batches, 256):
            sizes, crcs = [], []
            for body in batch.column("text").to_pylist():
                ids = enc.encode(body) + end
                n = len(ids) // width
                sizes.append(n)
                crcs.append(_sums(ids, enc.dtype, [window] * (n // window) + [n % window] * (n % window > 0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h1"), batch.column("h2"),
                 pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "n", "crcs"])

    made = texts.mapInArrow(encode, "doc_id long, h1 long, h2 long, n long, crcs array<long>")
    return made.withColumn("no", F.monotonically_increasing_id())


def _cut_sums(texts: DataFrame, cuts: DataFrame, most: int, window: int, vocabulary: str, ranks: str, end_id: int) -> DataFrame:
    """(h1, h2, lengths, cut_crcs) for the rests, ``most`` at most, that are cut into pieces of these lengths.

    Equal texts with equal cuts are one row. A text has fewer than ``window`` places to cut its rest at.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in sliced(batches, 64):
            rows: list[tuple] = []
            for h1, h2, body, ways in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "text", "ways"))):
                ids = enc.encode(body) + end
                rest = ids[len(ids) // width // window * window * width:]
                rows += [(h1, h2, way, _sums(rest, enc.dtype, way)) for way in ways]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), lists, lists))],
                ["h1", "h2", "lengths", "cut_crcs"])

    text_key = ["h1", "h2"]
    ways = cuts.groupBy(*text_key, "lengths").agg(F.lit(1)).groupBy(*text_key).agg(F.collect_list("lengths").alias("ways"))
    # written, so that Spark knows its size: texts are shuffled only when these keys are too many to send to all tasks
    keys = written(few_files(ways.select(*text_key), most), "cut-texts")
    once = texts.select("text", *text_key).join(keys, text_key, "left_semi").groupBy(*text_key).agg(
        F.first("text").alias("text"))
    return once.join(ways, text_key).mapInArrow(encode, "h1 long, h2 long, lengths array<long>, cut_crcs array<long>")


def pack(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
    vocabulary: str | None = None, ranks: str | None = None,
) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = ranks or public_tokenizers.path(RANKS)
    spark = df.sparkSession
    texts = _texts(df, doc_id, text)
    tokens = written(_summed(texts, window, vocabulary, ranks, end_id), "tokens")
    sizes = tokens.select("no", F.floor(F.col("n") / window).cast("long").alias("whole"),
                          (F.col("n") % window).cast("int").alias("rest"))

    # whole windows take the first sequence numbers
    most = tokens.count()
    long_ones = running_total(sizes.filter("whole > 0"), [], ["no"], F.col("whole"), "upto", rows=most).select(
        "no", (F.col("upto") - F.col("whole")).alias("window_sequence"))
    histogram = sizes.filter("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()  # < window rows
    counts = np.zeros(window + 1, np.int64)
    for row in histogram:
        counts[row["rest"]] = row["n"]
    slots, n_filled = places(counts, window)
    first_filled = sizes.agg(F.sum("whole")).first()[0] or 0

    taken: dict[int, list] = {}
    for length, start, end, sequence, offset in slots:
        taken.setdefault(length, []).append((start, end, sequence, offset))
    schema = "rest int, slots array<struct<start:long,end:long,sequence:long,offset:int>>, used long"
    by_length = spark.createDataFrame(
        [(length, rows, max(e for _, e, _, _ in rows)) for length, rows in taken.items()], schema)

    ranked = rank_rows(sizes.filter("rest > 0"), ["rest"], ["no"], "rank", rows=most)
    ranked = ranked.withColumn("k", F.col("rank") - 1).join(F.broadcast(by_length), "rest", "left")
    slot = F.filter("slots", lambda s: (s["start"] <= F.col("k")) & (F.col("k") < s["end"]))[0]
    fits = F.coalesce(F.col("k") < F.col("used"), F.lit(False))
    ranked = written(few_files(ranked.select("no", "rest", "k", F.when(fits, slot).alias("slot")), most), "ranked")
    filled = ranked.filter("slot is not null").select(
        "no", "rest", (F.col("slot.sequence") + F.col("k") - F.col("slot.start") + first_filled).alias("sequence"), "slot.offset")
    residual = running_total(ranked.filter("slot is null").select("no", "rest"), [], ["no"],
                             F.col("rest").cast("long"), "upto", rows=most)
    residual = residual.select("no", "rest", (F.col("upto") - F.col("rest")).alias("position"))

    used = sum(length * (end - start) for length, start, end, _, _ in slots)
    total = int((counts * np.arange(window + 1)).sum()) - used
    bounds, first_residual = tail_bounds(total, window), first_filled + n_filled
    full = total // window

    def cut(position: int, length: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the parts of a residual."""
        out, end = [], position + length
        while position < end:
            if position < full * window:
                index, begin = position // window, position // window * window
                stop = begin + window
            else:
                k = next(i for i, b in enumerate(bounds) if position < b)
                index, stop = full + k, bounds[k]
                begin = bounds[k - 1] if k else full * window
            take = min(end, stop) - position
            out.append((take, first_residual + index, position - begin))
            position += take
        return out

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut(p, n) for p, n in zip(batch.column("position").to_pylist(), batch.column("rest").to_pylist())]
            lists = [pa.array([[p[i] for p in f] for f in found], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("no"), *lists], ["no", "lengths", "sequences", "offsets"])

    residual = written(few_files(residual.select("no", "rest", "position").mapInArrow(
        parts, "no long, lengths array<long>, sequences array<long>, offsets array<long>").join(
        tokens.select("no", "h1", "h2"), "no"), most), "residual")
    cuts = residual.filter(F.size("lengths") > 1)
    cut_key = ["h1", "h2", "lengths"]
    sums = _cut_sums(texts, cuts, most, window, vocabulary, ranks, end_id)
    placed = filled.select(
        "no", *(F.array(F.col(c).cast("long")).alias(n) for c, n in (("rest", "lengths"), ("sequence", "sequences"), ("offset", "offsets"))),
    ).unionByName(residual.filter(F.size("lengths") == 1).drop("h1", "h2")).withColumn(
        "cut_crcs", F.lit(None).cast("array<long>")).unionByName(cuts.join(sums, cut_key).drop("h1", "h2"))

    whole = F.expr(f"n div {window}")
    windows = tokens.filter(whole > 0).join(long_ones, "no").select(
        "doc_id", "n", "window_sequence", F.posexplode(F.slice("crcs", F.lit(1), whole.cast("int")))).select(
        "doc_id", (F.col("pos").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("col").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.col("window_sequence") + F.col("pos")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = tokens.select("no", "doc_id", "n", F.array(F.element_at("crcs", -1)).alias("one")).join(placed, "no")
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda a, x: a + x)
    rests = rows.select("*", F.posexplode(F.arrays_zip(
        "lengths", "sequences", "offsets", F.coalesce("cut_crcs", "one").alias("crc")))).select(
        "doc_id", (whole * window + before).alias("start"), F.col("col.lengths").alias("length"),
        F.col("col.crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        F.col("col.sequences").alias("sequence_id"), F.col("col.offsets").alias("offset"))
    return windows.unionByName(rests)
