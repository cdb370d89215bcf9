"""Column expressions for comment text. All run JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Python str pattern treats as white space.
WHITESPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_WHITESPACE = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
# Bodies that stand for a missing comment.
REMOVED_BODIES = ("[deleted]", "[removed]")
SENTINEL_BODIES = ("[deleted]", "[removed]", "nan", "None")
# Authors that are not people.
EXCLUDED_AUTHORS = ("[deleted]", "AutoModerator")
# A word is a run of two or more word characters.
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def clean_text(col: Column) -> Column:
    """Drop links, markdown marks and user or forum mentions; squeeze spaces.

    The order matters: a bare address goes first, so the markdown rule only
    sees links whose target is not an address.
    """
    out = F.coalesce(col.cast("string"), F.lit(""))
    out = F.regexp_replace(out, rf"http{NOT_WHITESPACE}+", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    out = F.regexp_replace(out, r"[*_#~>]", "")
    out = F.regexp_replace(out, r"/[ur]/[A-Za-z0-9_-]+", "")
    return F.trim(F.regexp_replace(out, rf"{WHITESPACE}+", " "))


def once(col: Column) -> Column:
    """Evaluate a costly expression once per row.

    Spark copies a projected expression into every filter above it. The output
    of a generator is not copied, and it makes exactly one row here.
    """
    return F.explode(F.array(col))


def word_count(clean: Column) -> Column:
    """Words in a cleaned text; 0 for the empty text."""
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " ")))


def words(col: Column) -> Column:
    """Lower-case words of two or more characters, in text order."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def has_text(body: Column) -> Column:
    """Body is present, not a removal mark, and not only white space."""
    return body.isNotNull() & ~body.isin(*REMOVED_BODIES) & body.rlike(NOT_WHITESPACE)


def not_sentinel(body: Column) -> Column:
    return body.isNotNull() & ~body.cast("string").isin(*SENTINEL_BODIES)


def is_person(author: Column) -> Column:
    return author.isNotNull() & ~author.isin(*EXCLUDED_AUTHORS)


def is_root(parent_id: Column) -> Column:
    return F.coalesce(F.startswith(parent_id, F.lit("t3_")), F.lit(False))


def minute_string(epoch: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` in the session zone; null for 0 or missing."""
    return F.when(
        epoch != 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"))
