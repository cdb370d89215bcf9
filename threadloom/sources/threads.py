"""Thread documents: landed JSON, validation, header and comment tree.

A document is ``[post listing, comment listing]``, one per file or row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom import schemas
from threadloom.functions import text

NODE_SCHEMA = """
    thread_id STRING, subreddit STRING, pos BIGINT, kind STRING, depth INT, id STRING,
    parent_id STRING, author STRING, body STRING, score BIGINT, created_utc DOUBLE,
    replies_count BIGINT, children ARRAY<STRING>
"""
# Nodes handed back to Spark at a time.
NODES_PER_BATCH = 20_000


def read_thread_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(source, payload) from a folder of JSON files."""
    raw = spark.read.text(path, wholetext=not one_per_line)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("payload"))


# --- values of a parsed document: what does not fit is null, the row stays -----

_LONG = 1 << 63
_scan_token = re.compile(r'[ \t\n\r]*([{}\[\],:"]|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null)').match
_WORDS = {"true": True, "false": False, "null": None}


def _no_constant(name: str):
    raise ValueError(name)


def _load(payload: str | None):
    """The parsed text; ValueError when it is not JSON. Nests to any depth."""
    if payload is None:
        raise ValueError("null")
    try:
        return json.loads(payload, parse_constant=_no_constant)
    except RecursionError:
        return _load_deep(payload)


def _load_deep(payload: str):
    """The same with a list of open containers instead of recursion."""
    root: list = []
    open_ones: list = [root]   # containers that still get values
    names: list = [None]       # the name that waits for a value in each of them
    at, wanted = 0, "value"
    while True:
        if payload[at:].strip(" \t\n\r") == "" if at + 64 > len(payload) else False:
            break
        m = _scan_token(payload, at)
        if m is None:
            raise ValueError(f"not JSON at {at}")
        token, at = m.group(1), m.end()
        top = open_ones[-1]
        if token == '"':
            value, at = scanstring(payload, at)
            if wanted in ("name", "name or end"):
                names[-1], wanted = value, ":"
                continue
        elif token == ":" and wanted == ":":
            wanted = "value"
            continue
        elif token == "," and wanted == ", or end" and len(open_ones) > 1:
            wanted = "name" if isinstance(top, dict) else "value"
            continue
        elif token in "]}":
            if wanted not in (", or end", "name or end", "value or end") or len(open_ones) == 1 \
                    or (token == "}") != isinstance(top, dict):
                raise ValueError(f"not JSON at {at}")
            open_ones.pop()
            names.pop()
            wanted = ", or end"
            continue
        elif token in "{[":
            value = {} if token == "{" else []
        elif token in (":", ","):
            raise ValueError(f"not JSON at {at}")
        else:
            value = _WORDS[token] if token in _WORDS else float(token) if re.search("[.eE]", token) else int(token)
        if wanted not in ("value", "value or end") or (top is root and root):
            raise ValueError(f"not JSON at {at}")
        if isinstance(top, dict):
            top[names[-1]] = value
        else:
            top.append(value)
        wanted = ", or end"
        if token in "{[":
            open_ones.append(value)
            names.append(None)
            wanted = "name or end" if token == "{" else "value or end"
    if len(open_ones) > 1 or not root:
        raise ValueError("not JSON: it ends early")
    return root[0]


_lone = re.compile("[\ud800-\udfff]")


def _string(value) -> str | None:
    """A string, or the text of a number. Half a surrogate pair becomes the replacement character."""
    if isinstance(value, str):
        return value if value.isascii() else _lone.sub("\ufffd", value)
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _whole(value) -> int | None:
    """A whole number of 64 bits; the fraction of another number is dropped."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not abs(value) < _LONG:
        return None
    return int(value)


def _real(value) -> float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not abs(value) < 1e300:
        return None
    return float(value)


def _at(value, *path):
    """The value at a path of names and places, or null."""
    for step in path:
        if isinstance(step, str) and isinstance(value, dict):
            value = value.get(step)
        elif isinstance(step, int) and isinstance(value, list) and step < len(value):
            value = value[step]
        else:
            return None
    return value


PARSED = NODE_SCHEMA.strip() + ", source STRING, reason STRING, title STRING, num_comments BIGINT"


def _header(payload: str | None) -> tuple:
    """The document; reason to reject, id and the other fields of the post."""
    try:
        doc = _load(payload)
    except ValueError:
        return None, ("not_json", None, "", "", "", 0, 0, "")
    reason = "not_a_list" if not isinstance(doc, list) else "too_short" if _at(doc, 1) is None else None
    post = _at(doc, 0, "data", "children", 0, "data")
    text_of = lambda name: _string(_at(post, name)) or ""
    number_of = lambda name: _whole(_at(post, name)) or 0
    thread_id = _string(_at(post, "id"))
    if reason is None and thread_id is None:
        reason = "no_id"
    return doc, (reason, thread_id, text_of("title"), text_of("selftext"), text_of("author"), number_of("score"),
                 number_of("num_comments"), text_of("subreddit"))


def _children(holder) -> list:
    """Child nodes of a listing; anything that is not a listing has none."""
    data = holder.get("data") if isinstance(holder, dict) else None
    found = data.get("children") if isinstance(data, dict) else None
    return [c for c in found if isinstance(c, dict) and isinstance(c.get("data"), dict)] \
        if isinstance(found, list) else []


def _fields(data: dict, depth) -> tuple:
    """Depth, id, parent, author, body, score, time and number of replies of a comment."""
    below = _children(data.get("replies"))
    replies = sum(c.get("kind") == "t1" for c in below) + sum(
        _whole(c["data"].get("count")) or 0 for c in below if c.get("kind") == "more")
    return (depth, _string(data.get("id")), _string(data.get("parent_id", "")), _string(data.get("author")),
            _string(data.get("body")), _whole(data.get("score", 0)), _real(data.get("created_utc", 0)), _whole(replies))


def _walk(doc: list) -> Iterator[tuple]:
    """Comments and continuation nodes in pre-order, with an explicit stack."""
    stack = [(child, 0) for child in reversed(_children(doc[1]))]
    pos = 0
    while stack:
        child, depth = stack.pop()
        kind, data = child.get("kind"), child["data"]
        if kind == "t1":
            yield (pos, kind, *_fields(data, depth), None)
            stack.extend((c, depth + 1) for c in reversed(_children(data.get("replies"))))
        elif kind == "more":
            ids = data.get("children")
            yield (pos, kind, depth, None, None, None, None, None, None, None,
                   [x for x in map(_string, ids) if x is not None] if isinstance(ids, list) else [])
        pos += 1


def parse(documents: DataFrame, min_comments: int = 30) -> DataFrame:
    """All rows of the documents, each read and walked once: posts, comments and continuation nodes.

    A document gives one row of kind ``post``, with a reason if it is not
    analysed; an accepted one also its nodes. The tree nests to any depth and
    lies inside one row, so it is walked where it is, without a shuffle or a
    pass per level. A field of the wrong type is null; its node stays.
    """
    names = [c.split()[0] for c in PARSED.split(",")]
    node_names = ["thread_id", "subreddit", "pos", "kind", "depth", "id", "parent_id", "author", "body", "score", "created_utc",
                  "replies_count", "children"]
    numbers = {"pos": "Int64", "depth": "Int32", "score": "Int64", "num_comments": "Int64", "replies_count": "Int64",
               "created_utc": "Float64"}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for batch in batches:
            for payload, source in zip(batch["payload"], batch["source"]):
                doc, (reason, thread_id, title, body, author, score, comments, subreddit) = _header(payload)
                if reason is None and comments < min_comments:
                    reason = "too_small"
                rows.append({"kind": "post", "source": source, "reason": reason, "thread_id": thread_id, "title": title, "body": body,
                             "author": author, "score": score, "num_comments": comments, "subreddit": subreddit})
                for node in _walk(doc) if reason is None else ():
                    rows.append(dict(zip(node_names, (thread_id, subreddit, *node))))
                    if len(rows) >= NODES_PER_BATCH:
                        yield _frame(rows)
                        rows = []
        if rows:
            yield _frame(rows)

    def _frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=numbers.get(n, object)) for n in names})

    source = F.col("source") if "source" in documents.columns else F.lit(None)
    return documents.select("payload", source.cast("string").alias("source")).mapInPandas(read, PARSED)


def nodes_of(parsed: DataFrame) -> DataFrame:
    """Comments and continuation nodes of parsed documents."""
    return parsed.filter("kind <> 'post'").select(*(c.split()[0] for c in NODE_SCHEMA.strip().split(",")))


def posts_of(parsed: DataFrame) -> DataFrame:
    """Headers of all documents, with the reason of those that are not analysed."""
    return parsed.filter("kind = 'post'").select(
        "source", "reason", "thread_id", "title", F.col("body").alias("text"), "author", "score", "num_comments", "subreddit",
        F.col("source").alias("url"))


def tree_nodes(documents: DataFrame) -> DataFrame:
    """Every comment and continuation node of documents, whatever the size of their threads."""
    return nodes_of(parse(documents, min_comments=-(1 << 62)))


def quarantine(documents: DataFrame, min_comments: int = 30) -> DataFrame:
    """(source, thread_id, reason) of documents that are not analysed."""
    return posts_of(parse(documents, min_comments)).filter("reason is not null").select("source", "thread_id", "reason")


def accepted(documents: DataFrame, min_comments: int = 30) -> DataFrame:
    """Headers of well-formed documents of large enough threads."""
    return posts_of(parse(documents, min_comments)).filter("reason is null").drop("reason")


def post_headers(documents: DataFrame, min_comments: int = 0) -> DataFrame:
    """One row per thread, with defaults for absent fields."""
    columns = [c.split()[0] for c in schemas.POST.strip().split(",")]
    return accepted(documents, min_comments).select(*columns)


def comment_records(nodes: DataFrame) -> DataFrame:
    """The twelve comment fields, in walk order position ``pos``."""
    return nodes.filter("kind = 't1'").select(
        "id", "thread_id", "subreddit", "parent_id",
        text.is_root(F.col("parent_id")).alias("is_root_comment"), "author", "body", "score",
        "depth", "replies_count", "created_utc",
        text.minute_string(F.col("created_utc")).alias("created_at"), "pos")


def continuation_ids(nodes: DataFrame) -> DataFrame:
    """(thread_id, pos, child_id) of comments that were left out, in walk order."""
    return (
        nodes.filter("kind = 'more'")
        .select("thread_id", F.col("pos").alias("_node"), F.posexplode("children").alias("_i", "child_id"))
        .select("thread_id", F.struct("_node", "_i").alias("pos"), "child_id"))


EXPANSION_SCHEMA = """
    thread_id STRING, subreddit STRING, reason STRING, depth INT, id STRING, parent_id STRING, author STRING,
    body STRING, score BIGINT, created_utc DOUBLE, replies_count BIGINT
"""


def _expansions(spark_rows: DataFrame) -> DataFrame:
    """One row a comment, and one with a reason for each payload that is no list of nodes."""
    names = ["thread_id", "subreddit", "reason", "depth", "id", "parent_id", "author", "body", "score", "created_utc",
             "replies_count"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for thread_id, subreddit, payload in zip(batch["thread_id"], batch["subreddit"], batch["payload"]):
                try:
                    doc = _load(payload)
                except ValueError:
                    doc = None
                if not isinstance(doc, list):
                    rows.append((thread_id, subreddit, "not_json" if doc is None else "not_a_list", *[None] * 8))
                    continue
                for node in doc:
                    if isinstance(node, dict) and node.get("kind") == "t1" and isinstance(node.get("data"), dict):
                        depth = _whole(node["data"].get("depth"))
                        fields = _fields(node["data"], 1 if depth is None or abs(depth) >= 1 << 31 else depth)
                        rows.append((thread_id, subreddit, None, *fields))
            frame = pd.DataFrame(rows, columns=names)
            for column in ("score", "replies_count", "depth"):
                frame[column] = frame[column].astype("Int64")
            frame["created_utc"] = frame["created_utc"].astype("Float64")
            yield frame

    return spark_rows.select("thread_id", "subreddit", "payload").mapInPandas(read, EXPANSION_SCHEMA)


def expansion_quarantine(spark_rows: DataFrame) -> DataFrame:
    """(thread_id, reason) of landed continuation results that are no list of nodes."""
    return _expansions(spark_rows).filter("reason IS NOT NULL").select("thread_id", "reason")


def expansion_comments(spark_rows: DataFrame) -> DataFrame:
    """Comments of landed continuation results; nested nodes are not walked.

    Input: thread_id, subreddit, payload, where the payload is a list of nodes
    with their own depth (1 when absent).
    """
    rows = _expansions(spark_rows).filter("reason IS NULL")
    return rows.select(
        "id", "thread_id", "subreddit", "parent_id",
        text.is_root(F.col("parent_id")).alias("is_root_comment"), "author", "body", "score",
        "depth", "replies_count", "created_utc",
        text.minute_string(F.col("created_utc")).alias("created_at"))
