"""WARC archives: writing them with Spark's text sink, reading them by boundary-chain verification.

Writing. A record's text is its headers and its block; the sink ends every row
with the blank lines that end a record. Pages of equal payloads (SHA-1, length
and a second 64-bit hash agree) have one ``response``, of the smallest id; the
others are ``revisit`` records with the HTTP head alone, which names the length.

Reading. Spark cuts the files at lines that begin with the magic, in any split of
bytes, so a piece is what lies between two such places, wherever they are; no
header can hold one. A piece that starts like a
record is a candidate: its length gives the offset of its successor. In the task
that reads a split, the candidates form a forest (each has one successor), kept
as intervals in depth-first order, and each knows the offset at which its chain
leaves the split. From the start of the file, pointer jumping over these exits
finds where the true chain enters each split; the records of the split on the
way from there are its candidates whose interval holds the entry's. A magic
inside a payload starts a candidate that no chain from the start reaches. A
payload cut by such a magic is put together from its pieces in a second pass.
Offsets count decompressed bytes: sums of the pieces of a split and of the splits
before it, so archives that Spark decompresses are read as well.

Null pages are empty payloads. Repeated rows with the smallest id of a payload
are all responses, as a record cannot revisit itself; a page without an id
revisits if another one of its payload has an id, else it is a response. Control
characters and spaces of a URL become %20 in the header. Payloads below
``min_bytes`` are all responses. An empty table gives no records. Other columns
of the pages are not looked at. Damaged files: the chain ends at the first record
that has no valid header, and what lies behind it is not returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threadloom.session import cut_lineage, scratch_path, written

# Fixed values of the format.
MAGIC, VERSION, LINE, END = "WARC/1.", "1", "\r\n", "\r\n\r\n"
CUT = "\n" + MAGIC
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_ID = "<urn:page:{}>"
#: Bytes of a cell in which cut payloads meet their pieces.
CELL = 1 << 20

FOUND = ("file string, split long, total long, rel long, next long, exit long, pre long, post long, whole boolean, "
         "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string")
NAMES = [c.split()[0] for c in FOUND.split(", ")]
RECORD = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]


# --- writing -------------------------------------------------------------------

def base32(sha1: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: eight letters for each ten digits."""
    letters = F.lit(BASE32)
    out = []
    for begin in range(1, 41, 10):
        bits = F.conv(F.substring(sha1, begin, 10), 16, 10).cast("long")
        out += [F.substr(letters, F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
                for k in range(8)]
    return F.concat(*out)


def typed_pages(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """(id, url, body, sha1, size, first): ``first`` is the page to revisit, null for responses."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("body"))
    rows = rows.select("*", F.sha1(F.col("body").cast("binary")).alias("sha1"), F.octet_length("body").cast("long").alias("size"),
                       F.xxhash64("body").alias("second"))
    same = ["sha1", "size", "second"]
    shared = written(
        rows.filter(F.col("size") >= min_bytes).groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n"), "shared-payloads")
    revisits = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(shared, same, "left").withColumn("first", F.when(revisits, F.col("first"))).drop("second")


def _urn(page_id: Column) -> Column:
    return F.format_string(RECORD_ID.format("%s"), F.coalesce(page_id.cast("string"), F.lit("none")))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          min_bytes: int = 0, compression: str = "none") -> None:
    """One record for each row, in as many archives as Spark has tasks, below ``path``."""
    rows = typed_pages(pages, page_id, url, html, min_bytes)
    revisit = F.col("first").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    length = F.octet_length(head) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("size"))
    address = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    lines = F.concat_ws(
        LINE, F.lit(f"{MAGIC}{VERSION}"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("first")))),
        F.when(revisit, F.lit(f"WARC-Profile: {IDENTICAL}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")))
    rows.select(F.concat(lines, F.lit(END), block).alias("value")).write.option("lineSep", END).option(
        "compression", compression).text(path)


# --- reading -------------------------------------------------------------------

_header = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)").fullmatch
_end, _magic, _cut = END.encode(), MAGIC.encode(), CUT.encode()


def fields(head: bytes) -> dict[bytes, bytes]:
    found = (_header(line) for line in head.split(b"\r\n")[1:])
    return {m[1].lower(): m[2].strip() for m in found if m}


def payload(record_type: str, named: dict[bytes, bytes], block: bytes) -> tuple[int | None, str | None]:
    """Length and digest of a record's full payload; of a revisit's, what it names."""
    if record_type == "revisit":
        size = fields(b"\r\n" + block.partition(_end)[0] if block else b"").get(b"content-length", b"")
        digest = named.get(b"warc-payload-digest", b"").decode("latin-1").partition("sha1:")[2]
        return int(size) if size.isdigit() else None, digest or None
    if named.get(b"content-type", b"").startswith(b"application/http"):
        block = block.partition(_end)[2]
    return len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()


def candidate(piece: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Header fields of a piece, where its block begins and the block's length."""
    if piece[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    stop = piece.find(_end)
    if stop < 0 and piece.endswith(_end[:-1]):  # a block that begins with the magic: its cut took the last character
        stop = len(piece) - len(_end) + 1
    named = fields(piece[:stop]) if stop > 0 else {}
    length = named.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in named or b"warc-record-id" not in named:
        return None
    return named, stop + len(_end), int(length)


def _described(named: dict[bytes, bytes], block: bytes | None) -> tuple:
    text = {k: v.decode("utf-8", "replace") for k, v in named.items()}
    kind = text[b"warc-type"]
    size, digest = payload(kind, named, block) if block is not None else (None, None)
    return text[b"warc-record-id"], kind, text.get(b"warc-refers-to"), size, digest


def chains(starts: list[int], nexts: list[int], last: int) -> list[tuple[int | None, int, int]]:
    """(exit, pre, post) of the candidates of a split, by ascending offset.

    ``exit`` is the first offset beyond ``last`` on the candidate's chain, null where the chain breaks.
    """
    at = {s: i for i, s in enumerate(starts)}
    follow = [at.get(n) for n in nexts]
    size = [1] * len(starts)
    for i, j in enumerate(follow):  # a successor lies behind
        if j is not None:
            size[j] += size[i]
    exits: list = [None] * len(starts)
    pre, free, roots = [0] * len(starts), [0] * len(starts), 0
    for i in range(len(starts) - 1, -1, -1):
        j = follow[i]
        if j is None:
            exits[i] = nexts[i] if nexts[i] > last else None
            pre[i], roots = roots, roots + size[i]
        else:
            exits[i], pre[i] = exits[j], free[j]
            free[j] += size[i]
        free[i] = pre[i] + 1
    return [(e, p, p + s) for e, p, s in zip(exits, pre, size)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string() if t == "string" else pa.bool_() if t == "boolean" else pa.int64()
             for t in (c.split()[1] for c in FOUND.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], NAMES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, split, bytes read, offset of the magic before it, piece); offsets count from the split's first piece."""
    here, offset = None, 0
    for batch in batches:
        for file, split, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value"))):
            if (file, split) != here:
                here, offset = (file, split), 0
            size = len(piece) + len(_cut)
            if split == 0 and offset == 0 and piece.startswith(_magic):
                yield file, split, size, 0, piece[len(_magic):]
            else:
                yield file, split, size, offset - len(_magic), piece
            offset += size


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each split and, in a row without an offset, its size."""
    here, total, last, held = None, 0, 0, []

    def finished() -> Iterator[pa.RecordBatch]:
        linked = chains([h[0] for h in held], [h[1] for h in held], last)
        rows = [(*here, None, rel, after, *link, *more) for (rel, after, *more), link in zip(held, linked)]
        rows.append((*here, total, *[None] * (len(NAMES) - 3)))
        for begin in range(0, len(rows), 10_000):
            yield _batch(rows[begin:begin + 10_000])

    for file, split, size, offset, piece in _pieces(batches):
        if (file, split) != here:
            if here:
                yield from finished()
            here, total, held = (file, split), 0, []
        total += size
        last = offset
        if found := candidate(piece):
            named, begin, length = found
            after = offset + len(_magic) + begin + length + len(_end)
            whole = len(piece) >= begin + length
            held.append((offset, after, whole, *_described(named, piece[begin:begin + length] if whole else None)))
    if here:
        yield from finished()


def _read_pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"))


def entries(found: DataFrame) -> DataFrame:
    """(file, off) of the candidates at which the chain from the file's start enters a split: pointer jumping."""
    at = ["file", "off"]
    jumps = found.filter("exit is not null").select("file", "off", F.col("exit").alias("to"))
    targets = jumps.select("file", F.col("to").alias("off")).distinct()
    nodes = cut_lineage(jumps.join(targets, at, "left_semi").unionByName(jumps.filter("off = 0")).distinct())
    # a last split's chain ends with the file, so only jumps to other candidates go on
    known = found.select("file", "off").join(targets, at, "left_semi")
    jump = cut_lineage(nodes.join(known.withColumnRenamed("off", "to"), ["file", "to"], "left_semi").select("file", "off", "to"))
    reached = cut_lineage(found.filter("off = 0").select("file", "off"))
    while not jump.isEmpty():
        new = reached.join(jump, at).select("file", F.col("to").alias("off"))
        new = cut_lineage(new.join(reached, at, "left_anti").distinct())
        if new.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(new))
        far = jump.select("file", F.col("off").alias("to"), F.col("to").alias("end"))
        jump = cut_lineage(jump.join(far, ["file", "to"]).select("file", "off", F.col("end").alias("to")))
    return reached


def _mended(spark: SparkSession, path: str, cut: DataFrame, bases: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, put together from their pieces."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, _, offset, piece in _pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([split], pa.int64()), pa.array([offset], pa.int64()), pa.array([piece], pa.binary())],
                ["file", "split", "rel", "value"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf.sort_values("off")
        piece = _cut.join(held["value"])
        named, begin, length = candidate(piece)
        return pd.DataFrame([(pdf["file"].iloc[0], pdf["start"].iloc[0], *_described(named, piece[begin:begin + length]))],
                            columns=["file", "start", *RECORD])

    cells = F.sequence(F.expr(f"off div {CELL}"), F.expr(f"(next - 1) div {CELL}"))
    spans = cut.select("file", F.col("off").alias("start"), F.col("next").alias("stop"), F.explode(cells).alias("cell"))
    scanned = _read_pieces(spark, path).mapInArrow(pieces, "file string, split long, rel long, value binary")
    placed = scanned.join(bases, ["file", "split"]).select("file", (F.col("rel") + F.col("base")).alias("off"), "value")
    inside = placed.withColumn("cell", F.expr(f"off div {CELL}")).join(spans, ["file", "cell"]).filter(
        (F.col("off") >= F.col("start")) & (F.col("off") < F.col("stop")))
    schema = "file string, start long, record_id string, record_type string, refers_to string, " \
             "payload_bytes long, payload_digest string"
    return inside.select("file", "start", "off", "value").groupBy("file", "start").applyInPandas(whole, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, record_id, record_type, refers_to, payload_bytes, payload_digest of all records on a chain."""
    scanned = written(_read_pieces(spark, path).mapInArrow(_scan, FOUND), "record-candidates")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = scanned.filter("rel is null").select(
        "file", "split", F.coalesce(F.sum("total").over(earlier), F.lit(0).cast("long")).alias("base"))
    found = scanned.filter("rel is not null").join(bases, ["file", "split"]).withColumns({
        "off": F.col("rel") + F.col("base"), "next": F.col("next") + F.col("base"), "exit": F.col("exit") + F.col("base")})
    entered = found.join(entries(found), ["file", "off"]).select("file", "split", F.col("pre").alias("entry"))
    reachable = found.join(entered, ["file", "split"]).filter("pre <= entry and entry < post")
    reachable = written(reachable.select("file", "off", "next", "whole", *RECORD), "records")
    cut = reachable.filter("not whole")
    columns = ["file", "offset", *RECORD]
    out = reachable.filter("whole").withColumnRenamed("off", "offset").select(*columns)
    if cut.isEmpty():
        return out
    return out.unionByName(_mended(spark, path, cut, bases).withColumnRenamed("start", "offset").select(*columns))


def report(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch_path(pages.sparkSession, "archives")
    write(pages, path, page_id, url, html, min_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':([^:>]*)>$', 1) as bigint)")
    return read(pages.sparkSession, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
