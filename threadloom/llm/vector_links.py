"""Links between embeddings by a dual traversal of cover trees.

Equal vectors of a label are one class. The classes of a label are the root of a
tree with nested levels on a ladder of halving radii (2, 1, 1/2, ...). A node is
split at the largest radius of the ladder below its own at which centres farther
apart than this radius, its own centre first, cover drawn classes of it with few
centres; each class goes to its nearest centre, what none covers is a child of
its own, and the radius that a child really covers is kept. A node that no radius
parts in this way (in many dimensions, vectors without groups), or whose classes
all link with each other, is a leaf; it is dealt into blocks of ``LEAF`` classes.
All labels grow level by level in the same Spark jobs.

Pairs of nodes then descend together, from every root paired with itself. A pair
whose centres are farther apart than both radii and the threshold holds no link
and is dropped; one that lies wholly within the threshold links all with all and
is only counted; the others are replaced by the pairs of their children. Pairs of
leaves that are left are compared exactly, in double precision. A node pair is
one row, a leaf one packed block, and a pair of leaves gives counts and a
spanning forest, so pairs of vectors never become rows. Where no node can be
parted all pairs of a label's blocks are compared: the work is then that of all
pairs, as for any exact method on such vectors.

Vectors that are null, empty, zero, or hold null or non-finite numbers, and rows
without a label, link with nothing. Vectors of different length do not link.
A repeated row is one more vector, linked with its equals. A row without an id
is linked like others; it is never kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.tables import packed
from threadloom.plans.components import connected_components
from threadloom.plans.skew import salted_join
from threadloom.session import cut_lineage, written

#: Classes of a leaf's block; a node of so few is not split; classes of a node that are drawn to find centres.
LEAF, SMALL, CANDIDATES = 512, 32, 1024
#: Most centres of a node, and drawn classes that a centre must stand for on average.
CHILDREN, COVERED = 256, 4
#: Bounds are loosened by this, as distances of rounded vectors are not exact.
SLACK = 1e-7


@dataclass(frozen=True)
class LinkRules:
    cosine: float = 0.93

    @property
    def distance(self) -> float:
        """Euclidean distance of unit vectors at that cosine."""
        return float(np.sqrt(max(0.0, 2 - 2 * self.cosine)))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Unit rows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # against overflow of the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _read(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(no, vec_id, label, dim, hi, lo, vec): the packed vector and its digest; null for one that cannot link."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, hi, lo, vec = [], [], [], []
            for values, named in zip(batch.column("vector").to_pylist(), batch.column("label").is_valid().to_pylist()):
                ok = bool(values) and named and None not in values
                array = np.array(values, "<f8") if ok else None
                if not ok or not np.isfinite(array).all() or not array.any():
                    for column in (dim, hi, lo, vec):
                        column.append(None)
                    continue
                data = array.tobytes()
                digest = xxhash.xxh3_128_digest(data)
                dim.append(len(array))
                hi.append(int.from_bytes(digest[:8], "big", signed=True))
                lo.append(int.from_bytes(digest[8:], "big", signed=True))
                vec.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dim, pa.int32()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), pa.array(vec, pa.binary())], ["vec_id", "label", "dim", "hi", "lo", "vec"])

    rows = packed(df, vec_id=vec_id, vector=vector, label=label)
    rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label string, dim int, hi long, lo long, vec binary"
    return rows.mapInArrow(read, schema).withColumn("no", F.monotonically_increasing_id())


def net(unit: np.ndarray, radius: float, most: int) -> list[int] | None:
    """Places of centres farther than ``radius`` apart that cover all rows, in row order; None if more than ``most``."""
    chosen, gap = [0], np.linalg.norm(unit - unit[0], axis=1)
    while (k := int((gap > radius).argmax())) or gap[0] > radius:
        if len(chosen) == most:
            return None
        chosen.append(k)
        gap = np.minimum(gap, np.linalg.norm(unit - unit[k], axis=1))
    return chosen


def centres_of(unit: np.ndarray, radius: float, least: float) -> tuple[list[int], float]:
    """Centres and their radius of the ladder; radius 0 where no radius down to ``least`` parts the node."""
    step = 2.0 ** np.ceil(np.log2(max(radius, 1e-300)) - 1)
    while step >= least:
        chosen = net(unit, step, max(2, min(CHILDREN, len(unit) // COVERED)))
        if chosen is None:
            break
        if len(chosen) > 1:
            return chosen, step
        step /= 2
    return [0], 0.0


def _centres(named: DataFrame, near: float) -> DataFrame:
    """(node, centres, n, spread, half): packed centres of the nodes to split.

    ``named``: the classes of these nodes with the node's size and radius.
    The first is the class that names the node, then some drawn by hash.
    ``spread`` > 0: no radius parts the node, so its classes are dealt into that
    many blocks. Classes farther than ``half`` from all centres form a child of
    their own.
    """
    drawn = Window.partitionBy("node").orderBy(F.xxhash64("no"), "no")
    named = named.withColumn("first", F.col("no") == F.col("node"))
    some = named.filter("not first").withColumn("k", F.row_number().over(drawn)).filter(F.col("k") <= CANDIDATES).drop("k")
    some = some.unionByName(named.filter("first"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(draw=[xxhash.xxh3_64_intdigest(int(n).to_bytes(8, "big")) for n in group["no"]])
        group = group.sort_values(["first", "draw"], ascending=[False, True])
        unit = _scaled(np.stack([np.frombuffer(v, "<f8") for v in group["vec"]]))
        size = int(group["size"].iloc[0])
        chosen, step = centres_of(unit, float(group["radius"].iloc[0]), near / 4)
        return pd.DataFrame({"node": [group["node"].iloc[0]], "centres": [unit[chosen].astype("<f8").tobytes()],
                             "n": [len(chosen)], "spread": [0 if step else -(-3 * size // (2 * LEAF))],
                             "half": [step or np.inf]})

    return some.select("node", "no", "first", "vec", "size", "radius").groupBy("node").applyInPandas(
        choose, "node long, centres binary, n int, spread int, half double")


def _dealt(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Add ``k``, the nearest centre of the class's node, and ``away``, the distance to it."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            ks, aways = [], []
            for no, node, vec, centre, n, spread, half in zip(*(
                    batch.column(c).to_pylist() for c in ("no", "node", "vec", "centres", "n", "spread", "half"))):
                if node not in held:
                    held[node] = np.frombuffer(centre, "<f8").reshape(n, -1)
                unit = _scaled(np.frombuffer(vec, "<f8")[None])[0]
                away = np.linalg.norm(held[node] - unit, axis=1)
                k = int(away.argmin())
                if spread:  # measured from the first centre, as the rest of a net is
                    ks.append(xxhash.xxh3_64_intdigest(no.to_bytes(8, "big")) % spread)
                else:
                    ks.append(k if away[k] <= half else n)
                aways.append(float(away[0 if spread or away[k] > half else k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("no"), batch.column("node"), batch.column("vec"), batch.column("copies"),
                 pa.array(ks, pa.int32()), pa.array(aways, pa.float64())], ["no", "node", "vec", "copies", "k", "away"])

    joined = points.join(centres, "node")
    return joined.select("no", "node", "vec", "copies", "centres", "n", "spread", "half").mapInArrow(
        deal, "no long, node long, vec binary, copies long, k int, away double")


def _grown(classes: DataFrame, near: float) -> tuple[list[DataFrame], DataFrame]:
    """The levels, each (parent, node, centre, radius, size, copies, open), and (no, level, node) of every class.

    A node is named by its smallest class. The centre of a node is one of its
    centres' unit vectors; a leaf stays in all later levels as its own child.
    An open node is still to be split: its classes need not all link, and they
    are not what was left when no radius parted a larger one, unless these are
    too many for a block.
    """
    def open_when(parted: Column) -> Column:
        return ((F.col("size") > SMALL) & parted & (F.col("radius") > near / 2)) | (F.col("size") > LEAF)

    roots = classes.groupBy("label", "dim").agg(F.min("no").alias("node"), F.count(F.lit(1)).alias("size"), F.sum("copies").alias("copies"))
    points = salted_join(classes, roots.select("label", "dim", "node"), ["label", "dim"], ["no"]).select("no", "node", "vec", "copies")
    points = written(points, "points")
    first = points.filter("no = node").select("node", F.col("vec").alias("centre"))
    level = roots.join(first, "node").select(
        F.col("node").alias("parent"), "node", "centre", F.lit(2.0).alias("radius"), "size", "copies").withColumn(
        "open", open_when(F.lit(True)))
    levels = [written(level, "level")]
    paths = [points.select("no", F.lit(0).alias("level"), "node")]
    while True:
        level = levels[-1]
        big = level.filter("open").select("node", "radius", "size")
        if big.isEmpty():
            break
        # The salts keep a label with a large share of the rows spread over many tasks.
        inside = salted_join(points, big, ["node"], ["no"])
        centres = written(_centres(inside, near), "centres")
        dealt = written(_dealt(inside.select("no", "node", "vec", "copies"), centres), "dealt")
        children = dealt.groupBy("node", "k").agg(
            F.min("no").alias("child"), F.max("away").alias("radius"), F.count(F.lit(1)).alias("size"),
            F.sum("copies").alias("copies"))
        children = written(children, "children")
        points = written(salted_join(dealt, children.select("node", "k", "child"), ["node", "k"], ["no"]).select(
            "no", F.col("child").alias("node"), "vec", "copies"), "points")
        spread = children.join(centres, "node")
        at = F.when((F.col("spread") > 0) | (F.col("k") >= F.col("n")), 0).otherwise(F.col("k"))
        width = F.length("centres") / F.col("n")
        centre = F.substring("centres", (at * width + 1).cast("int"), width.cast("int"))
        grown = spread.select(F.col("node").alias("parent"), F.col("child").alias("node"), centre.alias("centre"), "radius",
                              "size", "copies", open_when(F.col("spread") == 0).alias("open"))
        same = level.filter("not open").withColumn("parent", F.col("node"))
        levels.append(written(grown.unionByName(same), "level"))
        stays = paths[-1].join(big.select("node"), "node", "left_anti")
        paths.append(written(points.select("no", "node").unionByName(stays.select("no", "node")).select(
            "no", F.lit(len(levels) - 1).alias("level"), "node"), "path"))
    path = paths[0]
    for p in paths[1:]:
        path = path.unionByName(p)
    return levels, path


def _leaf_members(levels: list[DataFrame], path: DataFrame, classes: DataFrame) -> DataFrame:
    """(leaf, nos, copies, vecs): every leaf as one packed block."""
    last = path.groupBy("no").agg(F.max_by("node", "level").alias("leaf"))
    rows = classes.select("no", "copies", "vec").join(last, "no")
    grouped = rows.groupBy("leaf").agg(F.collect_list(F.struct("no", "copies", "vec")).alias("rows"))  # at most LEAF rows

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nos, copies, vecs = [], [], []
            for members in batch.column("rows").to_pylist():
                nos.append(np.array([m["no"] for m in members], "<i8").tobytes())
                copies.append(np.array([m["copies"] for m in members], "<i8").tobytes())
                vecs.append(b"".join(m["vec"] for m in members))
            yield pa.RecordBatch.from_arrays(
                [batch.column("leaf"), pa.array(nos, pa.binary()), pa.array(copies, pa.binary()), pa.array(vecs, pa.binary())],
                ["leaf", "nos", "copies", "vecs"])

    return grouped.mapInArrow(pack, "leaf long, nos binary, copies binary, vecs binary")


def _descended(levels: list[DataFrame], rules: LinkRules) -> tuple[DataFrame, DataFrame]:
    """Leaf pairs (a, b) to compare, and node pairs (level, a, b) that link all with all; a <= b."""
    near = rules.distance

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = []
            for x, y, r, s in zip(*(batch.column(c).to_pylist() for c in ("centre_a", "centre_b", "radius_a", "radius_b"))):
                u, v = (_scaled(np.frombuffer(z, "<f8")[None])[0] for z in (x, y))
                gap = float(np.linalg.norm(u - v))
                verdicts.append(-1 if gap > r + s + near + SLACK else 1 if gap + r + s < near - SLACK else 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(verdicts, pa.int32())], ["a", "b", "verdict"])

    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"))
    full = None
    for k, level in enumerate(levels):
        side = level.select("parent", "node", "centre", "radius")
        both = pairs.join(side.toDF("a", "child_a", "centre_a", "radius_a"), "a") \
            .join(side.toDF("b", "child_b", "centre_b", "radius_b"), "b")
        both = both.filter((F.col("a") != F.col("b")) | (F.col("child_a") <= F.col("child_b")))
        both = both.select(F.least("child_a", "child_b").alias("a"), F.greatest("child_a", "child_b").alias("b"),
                           "centre_a", "centre_b", "radius_a", "radius_b")
        seen = written(both.mapInArrow(judge, "a long, b long, verdict int"), "node-pairs")
        pairs = seen.filter("verdict = 0").select("a", "b")
        here = seen.filter("verdict = 1").select(F.lit(k).alias("level"), "a", "b")
        full = here if full is None else full.unionByName(here)
    return pairs, full


def _compared(pairs: DataFrame, blocks: DataFrame, rules: LinkRules) -> DataFrame:
    """(no, links, other): of each class with a link in a leaf pair, how many vectors it links, and a class it is joined to."""
    least = rules.cosine

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, links, other = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b, nos_a, copies_a, vecs_a, nos_b, copies_b, vecs_b in zip(*(batch.column(c).to_pylist() for c in (
                    "a", "b", "nos_a", "copies_a", "vecs_a", "nos_b", "copies_b", "vecs_b"))):
                i, j, m, n = (np.frombuffer(x, "<i8") for x in (nos_a, nos_b, copies_a, copies_b))
                x, y = (_scaled(np.frombuffer(v, "<f8").reshape(len(k), -1)) for v, k in ((vecs_a, i), (vecs_b, j)))
                linked = x @ y.T >= least
                if a == b:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                sides = [(i, linked, n)] if a == b else [(i, linked, n), (j, linked.T, m)]
                low_i, low_j = i.copy(), j.copy()
                while True:  # the smallest number of each linked group spreads
                    top = np.iinfo(np.int64).max
                    new_i = np.minimum(low_i, np.where(linked, low_j, top).min(axis=1))
                    new_j = new_i if a == b else np.minimum(low_j, np.where(linked.T, new_i, top).min(axis=1))
                    if (new_i == low_i).all() and (new_j == low_j).all():
                        break
                    low_i, low_j = new_i, new_j
                for (own, mask, weight), low in zip(sides, (low_i, low_j)):
                    has = mask.any(axis=1)
                    no.append(own[has])
                    links.append((mask[has] @ weight).astype(np.int64))
                    other.append(low[has])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in (no, links, other)], ["no", "links", "other"])

    side = lambda s: blocks.toDF(s, f"nos_{s}", f"copies_{s}", f"vecs_{s}")
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "no long, links long, other long")


def _full_links(full: DataFrame, levels: list[DataFrame], path: DataFrame, classes: DataFrame) -> DataFrame:
    """The same rows for the node pairs that link all with all."""
    sizes = None
    for k, level in enumerate(levels):
        here = level.select(F.lit(k).alias("level"), "node", F.col("copies").alias("all"))
        sizes = here if sizes is None else sizes.unionByName(here)
    ways = full.select("level", F.col("a").alias("node"), F.col("b").alias("with")).unionByName(
        full.filter("a <> b").select("level", F.col("b").alias("node"), F.col("a").alias("with")))
    ways = ways.join(sizes.withColumnRenamed("node", "with"), ["level", "with"])
    sums = ways.groupBy("level", "node").agg(
        F.sum("all").alias("all"), F.max(F.col("node") == F.col("with")).alias("itself"), F.min("with").alias("other"))
    owned = salted_join(path, sums, ["level", "node"], ["no"]).join(classes.select("no", "copies"), "no")
    inner = owned.select("no", (F.col("all") - F.when(F.col("itself"), F.col("copies")).otherwise(0)).alias("links"),
                         F.col("node").alias("other"))
    # classes are joined to their node's name above, nodes to each other here
    between = full.filter("a <> b").select(F.col("a").alias("no"), F.lit(0).cast("long").alias("links"), F.col("b").alias("other"))
    return inner.unionByName(between)


def compared_share(levels: list[DataFrame], leaf_pairs: DataFrame) -> float:
    """How many pairs of vectors of equal label are left to compare after the traversal, as a share of all."""
    def pairs(of: str) -> Column:
        return F.col(of) * (F.col(of) - 1) / 2

    every = levels[0].agg(F.sum(pairs("size"))).first()[0] or 0.0
    sizes = levels[-1].select("node", "size")
    left = leaf_pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b").agg(
        F.sum(F.when(F.col("a") == F.col("b"), pairs("size_a")).otherwise(F.col("size_a") * F.col("size_b")))).first()[0] or 0.0
    return left / every if every else 0.0


KEY = ["label", "dim", "hi", "lo"]


def _classes(df: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and the classes of equal vectors of a label, named by their smallest row."""
    rows = written(_read(df, vec_id, vector, label), "vectors")
    owners = rows.filter("vec is not null").groupBy(*KEY).agg(F.min("no").alias("no"), F.count(F.lit(1)).alias("copies"))
    return rows, written(rows.select("no", "vec").join(owners, "no"), "classes")


def traversed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
              rules: LinkRules = LinkRules()) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees and the leaf pairs that the traversal leaves, to see what it prunes."""
    levels, _ = _grown(_classes(df, vec_id, vector, label)[1], rules.distance)
    return levels, _descended(levels, rules)[0]


def report(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rules: LinkRules = LinkRules(),
) -> DataFrame:
    """Links, component and whether the row stands for it, for every vector."""
    rows, classes = _classes(df, vec_id, vector, label)
    key = KEY
    levels, path = _grown(classes, rules.distance)
    path = written(path, "path")
    leaf_pairs, full = _descended(levels, rules)
    found = written(_compared(leaf_pairs, _leaf_members(levels, path, classes), rules).unionByName(
        _full_links(full, levels, path, classes)), "found")
    counts = found.groupBy("no").agg(F.sum("links").alias("links"))
    parts = cut_lineage(connected_components(found.select(F.col("no").alias("u"), F.col("other").alias("v")), []))
    parts = parts.select(F.col("node").alias("no"), F.col("label").alias("part"))
    known = classes.select(*key, "no", "copies").join(counts, "no", "left").join(parts, "no", "left").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("part", "no").alias("part"))
    placed = rows.select("vec_id", F.col("no").alias("row"), *key).filter("dim is not null").join(known, key)
    heads = placed.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    linked = salted_join(placed, heads, ["part"], ["row"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
