"""Quality rules: word and line counts, and the distance from what a language looks like.

Two histograms of a document are compared with those of its language by
Jensen-Shannon distance (base 2, so 0 to 1): character classes, and common
words. The references are sums over all documents of the corpus in that language
that pass the base rules and are long enough. A language without a list of common
words gets the most frequent words of these documents. Columns and SQL functions
only.

Null text counts as empty. Empty texts have no words and fail the base rules.
Documents without a language, or in one without a reference (only short
documents), are judged by the base rules alone. Equal rows are judged
alike; every row is returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.session import written
from threadloom.llm.tables import SPACE, once, packed, unpacked, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Character classes in the order of their counts; "rest" is mostly lower-case letters.
CLASSES = ("space", "upper", "digit", "symbol", "mark", "rest")

# Bins of the word histogram: frequent function words, lower case.
COMMON_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}


@dataclass(frozen=True)
class QualityRules:
    """Limits. Texts shorter than the guard of a distance are not judged by it."""

    fewest_words: int = 10
    most_repeated_percent: int = 20
    window: int = 5
    min_words_classes: int = 40
    min_words_common: int = 100
    max_class_distance: float = 0.28
    max_word_distance: float = 0.30
    most_common: int = 32  # words of a language that has no list
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def _repeated(df: DataFrame, window: int) -> DataFrame:
    """``dup_at``: sorted starts of the windows that occur twice or more in the text."""
    n = F.size("words")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("keys", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("hashes", F.transform(
        starts, lambda i: F.xxhash64(*(F.col("keys")[i + k] for k in range(window)))))
    paired = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    # Most texts repeat nothing, which a hash set shows without sorting.
    df = df.withColumn("ranked", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), paired).otherwise(none))
    last = F.size("ranked") - 1

    def twice(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.col("ranked")[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]).otherwise(False)
        after = F.when(k < last, F.col("ranked")[F.least(k + 1, last)]["h"] == x["h"]).otherwise(False)
        return before | after

    at = F.sort_array(F.transform(F.filter("ranked", twice), lambda x: x["i"]))
    return df.withColumn("dup_at", at).drop("keys", "hashes", "ranked")


def _covered(window: int) -> Column:
    """Words in the windows that start at ``dup_at``."""
    at, last = F.col("dup_at"), F.size("dup_at") - 1
    each = F.transform(at, lambda p, k: F.when(
        k < last, F.least(F.lit(window), at[F.least(k + 1, last)] - p)).otherwise(window))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _without(text: Column, pattern: str) -> Column:
    """Characters of the text that the pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def word_lists(df: DataFrame, rules: QualityRules) -> dict[str, list[str]]:
    """The common words of every language: the listed ones, else the most frequent of the corpus.

    ``df`` has ``text`` and ``lang``. The result has ``most_common`` words for each language without a list.
    """
    others = df.filter(F.col("lang").isNotNull() & ~F.col("lang").isin(list(rules.common_words)))
    others = others.select("lang", words_of(F.col("text")).alias("words")).filter(F.size("words") >= rules.min_words_classes)
    others = once(_repeated(others, rules.window), "m", n=F.size("words"), repeated=_covered(rules.window))
    good = others.filter((F.col("m.n") >= rules.fewest_words) & (
        100 * F.col("m.repeated") <= rules.most_repeated_percent * F.col("m.n")))
    n = good.select("lang", F.explode("words").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    # The k-th best of each hash part, then of the language: no task holds a language's vocabulary.
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("w"), F.lit(64))).orderBy(F.desc("n"), "w")
    best = n.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= rules.most_common)
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    best = best.withColumn("k", F.row_number().over(last)).filter(F.col("k") <= rules.most_common)
    out = {lang: list(dict.fromkeys(words)) for lang, words in rules.common_words.items()}
    for row in best.orderBy("lang", "k").collect():
        out.setdefault(row["lang"], []).append(row["w"])
    return out


def measured(df: DataFrame, rules: QualityRules, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """Add struct ``q``: the counts, character classes and common words of ``text``."""
    bins = sorted({w for ws in (lists or rules.common_words).values() for w in ws})
    df = df.withColumn("body", F.coalesce("text", F.lit(""))).withColumn("words", words_of(F.col("text")))
    df = _repeated(df, rules.window)
    df = df.withColumn("common", F.sort_array(F.filter("words", lambda w: w.isin(bins))))
    last = F.size("common") - 1
    ends = F.filter(F.transform("common", lambda w, k: F.when(
        (k == last) | (F.col("common")[F.least(k + 1, last)] != w), k).otherwise(-1)), lambda k: k >= 0)
    df = df.withColumn("ends", ends)
    runs = F.transform("ends", lambda e, k: F.struct(
        F.col("common")[e].alias("w"),
        (e - F.when(k > 0, F.col("ends")[F.greatest(k - 1, F.lit(0))]).otherwise(-1)).cast("long").alias("n")))
    lines = F.filter(F.split("body", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.withColumn("lines", lines)
    body = F.col("body")
    df = once(
        df, "m",
        n_words=F.size("words").cast("long"),
        n_chars=F.length("body").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        upper=_without(body, r"\p{Lu}+").cast("long"),
        digits=_without(body, r"\p{Nd}+").cast("long"),
        n_symbols=_without(body, f"{SYMBOLS}+").cast("long"),
        marks=_without(body, r"[\p{P}&&[^#*%&]]+").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=_covered(rules.window).cast("long"),
        common=runs,
    ).drop("body", "words", "dup_at", "common", "ends", "lines")
    m = F.col("m")
    spaces = m["n_chars"] - m["word_chars"]
    rest = m["word_chars"] - m["upper"] - m["digits"] - m["n_symbols"] - m["marks"]
    failed = (m["n_words"] < rules.fewest_words) | (
        100 * m["n_repeat_words"] > rules.most_repeated_percent * m["n_words"])
    return df.withColumn("q", F.struct(
        m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"],
        m["n_repeat_words"], failed.alias("base_failed"), m["common"], m["n_chars"],
        F.array(spaces, m["upper"], m["digits"], m["n_symbols"], m["marks"], rest).alias("classes"),
    )).drop("m")


def language_references(
    df: DataFrame, rules: QualityRules, lists: dict[str, list[str]] | None = None,
) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Shares of character classes and of common words, per language, over all rows.

    The result has a fixed size for each language: classes and list lengths.
    ``df`` comes from :func:`measured` with the same ``lists``.
    """
    lists = lists or rules.common_words
    usable = df.filter(~F.col("q.base_failed") & (F.col("q.n_words") >= rules.min_words_classes) & F.col("lang").isNotNull())
    counts = F.concat(
        F.transform("q.classes", lambda n, k: F.struct(F.concat(F.lit("class "), k.cast("string")).alias("w"), n.alias("n"))),
        F.array(F.struct(F.lit("all words").alias("w"), F.col("q.n_words").alias("n"))),
        F.transform("q.common", lambda x: F.struct(F.concat(F.lit("word "), x["w"]).alias("w"), x["n"].alias("n"))))
    sums = usable.select("lang", F.explode(counts).alias("x")).groupBy("lang", "x.w").agg(F.sum("x.n").alias("n"))
    by: dict[str, dict[str, int]] = {}
    for row in sums.collect():
        by.setdefault(row["lang"], {})[row["w"]] = row["n"]
    out = {}
    for lang, n in sorted(by.items()):
        chars = [n[f"class {k}"] for k in range(len(CLASSES))]
        out[lang] = ([c / sum(chars) for c in chars],
                     {w: n.get(f"word {w}", 0) / n["all words"] for w in dict.fromkeys(lists.get(lang, ()))})
    return out


def _term(p: Column, q: Column) -> Column:
    """Contribution of one bin to twice the divergence."""
    mid = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    return part(p) + part(q)


def _class_distance(reference: Column) -> Column:
    total = F.greatest(F.col("q.n_chars"), F.lit(1)).cast("double")
    terms = [_term(F.col("q.classes")[k] / total, reference[k]) for k in range(len(CLASSES))]
    return F.when(reference.isNotNull(), F.sqrt(F.greatest(sum(terms[1:], terms[0]) / 2, F.lit(0.0))))


def _word_distance(listed: Column) -> Column:
    total = F.greatest(F.col("q.n_words"), F.lit(1)).cast("double")
    seen = F.filter("q.common", lambda x: F.map_contains_key(listed, x["w"]))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def add(a: Column, x: Column) -> Column:
        p, q = x["n"] / total, F.try_element_at(listed, x["w"])
        return F.struct((a["sum"] + _term(p, q)).alias("sum"), (a["p"] + p).alias("p"), (a["q"] + q).alias("q"))

    listed_share = F.aggregate(F.map_values(listed), F.lit(0.0), lambda a, x: a + x)

    def finish(a: Column) -> Column:
        other = _term(F.greatest(1 - a["p"], F.lit(0.0)), F.greatest(1 - listed_share, F.lit(0.0)))
        unseen = F.greatest(listed_share - a["q"], F.lit(0.0))  # bins the text lacks add their whole share
        return F.sqrt(F.greatest((a["sum"] + other + unseen) / 2, F.lit(0.0)))

    return F.when(F.size(listed) > 0, F.aggregate(seen, start, add, finish))


def _with_references(df: DataFrame, references: dict[str, tuple[list[float], dict[str, float]]]) -> DataFrame:
    """Add ``classes`` and ``listed`` of the row's language, null where it has none; one small row a language."""
    rows = df.sparkSession.createDataFrame(
        [(k, c, w) for k, (c, w) in references.items()], "lang string, classes array<double>, listed map<string,double>")
    return df.join(F.broadcast(rows), "lang", "left")


def judged(
    df: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules = QualityRules(),
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row as ``row`` (its columns ``keep``, or all), counts ``q``, distances ``d``, and ``kept``.

    Both the references and the verdicts need the counts. With ``keep`` they are
    written once in between; whole rows, with their texts, are counted twice
    instead, as a copy of the corpus costs more than the second pass.
    """
    rows = packed(df, text=text, lang=lang)
    lists = word_lists(rows.select("text", "lang"), rules)
    measures = measured(rows, rules, lists)
    if keep is None:
        measures = measures.select("row", "lang", "q")
    else:
        measures = measures.withColumn("row", F.struct(*(F.col(f"row.`{c}`") for c in keep)))
        measures = written(measures.select("row", "lang", "q"), "quality")
    references = language_references(measures, rules, lists)
    out = once(
        _with_references(measures, references), "d", q=F.col("q"),
        class_distance=_class_distance(F.col("classes")), word_distance=_word_distance(F.col("listed")))

    def far(distance: str, most: float, guard: int) -> Column:
        beyond = F.coalesce(F.col(distance) > most, F.lit(False))
        return beyond & (F.col("d.q.n_words") >= guard)

    kept = ~(F.col("d.q.base_failed")
             | far("d.class_distance", rules.max_class_distance, rules.min_words_classes)
             | far("d.word_distance", rules.max_word_distance, rules.min_words_common))
    return out.select("row", "d.q", "d", kept.alias("kept"))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that pass, with their own columns."""
    return unpacked(judged(df, text, lang, rules).filter("kept"))


def report(df: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Counts, distances and verdict of every document."""
    return judged(df, keep=[doc_id], **options).select(
        F.col(f"row.`{doc_id}`").alias("doc_id"), "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines",
        "q.n_repeat_words", "q.base_failed", "kept", "d.class_distance", "d.word_distance")
