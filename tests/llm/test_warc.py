"""Archives: round trip, magic inside payloads, any splits, damaged files."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from threadloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            h = h or ""
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "") if len(raw) >= min_bytes else None
        to = None if to == i else to
        out.append((i, len(raw), digest(raw), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def reported(spark, rows, **rules):
    return sorted(map(tuple, warc.report(spark.createDataFrame(rows, SCHEMA), **rules).collect()), key=repr)


def false_record(size, body=b"<p>x</p>"):
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {size}\r\n\r\n"
            + body.decode() + "\r\n\r\n")


HOSTILE = ["WARC/1.1\r\n", "a WARC/1.1\r\nWARC-Type: response\r\n\r\nb", false_record(8), "x" + false_record(8) * 3 + "tail",
           false_record(10**9), false_record(0), "\r\n\r\n" + false_record(8), "WARC/1.", "W", "é日" * 900 + false_record(3)]


@pytest.mark.parametrize("split", [None, 2500])
def test_magic_inside_payloads(spark, split):
    rng = random.Random(5)
    rows = [(i, f"http://h/{i} \r\nWARC/1.1", rng.choice(HOSTILE) * rng.randrange(1, 4) + "p" * rng.randrange(0, 400))
            for i in range(120)]
    rows += [(1000 + i, None, h) for i, h in enumerate(HOSTILE)]
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert reported(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_inputs(spark):
    rows = [(5, "u", None), (3, "u", ""), (4, None, "same"), (2, "v", "same"), (2, "v", "same"), (None, "w", "same"),
            (None, "x", "nameless"), (None, "x", "nameless"), (7, "y", "z" * 3_000_000), (8, "y", "\r\n\r\n"), (9, "y", "\x00\x1c é")]
    assert reported(spark, rows) == plain(rows)
    assert reported(spark, rows, min_bytes=5) == plain(rows, 5)
    assert reported(spark, []) == []
    extra = spark.createDataFrame([(1, "u", "h", 2, "f")], SCHEMA + ", first long, sha1 string")
    assert [tuple(r) for r in warc.report(extra).collect()] == plain([(1, "u", "h")])


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_other_writers(spark, tmp_path, packed):
    record = lambda i, block, kind="resource": (
        f"WARC/1.0\r\nWARC-Record-ID: <urn:page:{i}>\r\nwarc-type:  {kind}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    bodies = [b"", bytes(range(256)) * 5, false_record(8).encode(), b"plain"]
    parts = [record(i, b) for i, b in enumerate(bodies)]
    opener = gzip.open if packed else open
    with opener(tmp_path / ("a.warc.gz" if packed else "a.warc"), "wb") as file:
        file.write(b"".join(parts))
    with opener(tmp_path / ("b.warc.gz" if packed else "b.warc"), "wb") as file:  # damaged after its first record
        file.write(parts[1] + b"noise" + parts[3])
    with opener(tmp_path / ("c.warc.gz" if packed else "c.warc"), "wb") as file:  # no record at its start
        file.write(b"noise" + parts[3])
    got = sorted((os.path.basename(r["file"])[0], r["offset"], r["record_id"], r["payload_bytes"], r["payload_digest"])
                 for r in warc.read(spark, str(tmp_path)).collect())
    offsets = [sum(map(len, parts[:i])) for i in range(4)]
    want = [("a", o, f"<urn:page:{i}>", len(b), digest(b)) for i, (o, b) in enumerate(zip(offsets, bodies))]
    assert got == want + [("b", 0, "<urn:page:1>", len(bodies[1]), digest(bodies[1]))]


def test_chains_are_paths():
    rng = random.Random(2)
    for _ in range(300):
        starts = sorted(rng.sample(range(0, 200), rng.randrange(1, 30)))
        nexts = [rng.choice([s for s in [*starts, 250, 199] if s > a] + [300]) for a in starts]
        linked = warc.chains(starts, nexts, starts[-1])
        for i, s in enumerate(starts):
            path, at = [], s
            while at in starts:
                path.append(at)
                at = nexts[starts.index(at)]
            assert linked[i][0] == (at if at > starts[-1] else None)
            assert path == [b for b, (_, pre, post) in zip(starts, linked) if pre <= linked[i][1] < post]


def test_archives_are_warc_files(spark, tmp_path):
    rows = [(1, "http://a/b c", "one"), (2, None, "one"), (3, "http://a/", "två")]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    (name,) = [f for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    data = (tmp_path / "w" / name).read_bytes()
    kinds = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        named = warc.fields(head)
        length = int(named[b"content-length"])
        assert rest[length:length + 4] == b"\r\n\r\n"
        kinds.append((named[b"warc-type"], named.get(b"warc-refers-to"), rest[:length].partition(b"\r\n\r\n")[2]))
        data = rest[length + 4:]
    assert kinds == [(b"response", None, b"one"), (b"revisit", b"<urn:page:1>", b""), (b"response", None, "två".encode())]
