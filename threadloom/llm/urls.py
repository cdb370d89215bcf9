"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the start of a path; it fits the host and all its
subdomains, and the longest rule that fits wins. URLs without a rule are judged
by boosted trees over length, depth, digits, entropy, parameters and statistics
of the host's suffix. The trees are trained on labelled URLs: those a rule
decides, and those whose host has a word of a seed list, or its plural, between dots and
hyphens (block). At most
``TRAIN_URLS`` distinct labelled URLs are used, the first by hash; that bounded
sample also gives the suffix statistics.

A null URL, or one without "://", has an empty host and path. It and any URL
without a rule is allowed when the labelled URLs lack one of the two verdicts.
Repeated rows are judged alike and all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.tables import once, packed

TRAIN_URLS = 20_000
#: Weight of the overall share in the share of a suffix.
PRIOR = 20.0

# Rules of the registered query: host and path start, verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

# Parts of a host that label a URL "block" for training.
SEED_WORDS = "adult casino cheap pills porn xxx bet loan viagra replica warez crack".split()

FEATURES = ("length", "host_length", "path_length", "depth", "host_parts", "hyphens", "digit_ratio", "host_digit_ratio",
            "entropy", "parameters", "query_length", "fragment", "secure", "extension", "suffix_share", "suffix_seen")


@dataclass(frozen=True)
class Trained:
    """The trees and the suffix statistics of their sample: suffix -> (share blocked, count)."""

    model: GBTClassificationModel
    share: float
    suffixes: dict[str, tuple[float, int]]


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(df: DataFrame) -> DataFrame:
    """Add struct ``u`` (host, path) for the column ``url``."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    df = df.withColumn("rest", rest)
    host = F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return once(df, "u", host=_lower_ascii(host), path=path).drop("rest")


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. A tie of length cannot occur: both would be one text."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, rule).otherwise(out)
    return out


def _suffix(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def features(df: DataFrame) -> DataFrame:
    """Add struct ``f``: the features of ``url`` and ``u`` that need no statistics."""
    url = F.coalesce("url", F.lit(""))
    df = df.withColumn("chars", F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    host_n = F.greatest(F.length("u.host"), F.lit(1)).cast("double")

    def part(c: Column) -> Column:
        p = (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
        return -p * F.log2(p)

    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    host, path = F.col("u.host"), F.col("u.path")
    return once(
        df, "f", length=F.length(url).cast("double"), host_length=F.length(host).cast("double"),
        path_length=F.length(path).cast("double"), depth=count(path, "/[^/]"), host_parts=count(host, r"\."),
        hyphens=count(host, "-"), digit_ratio=count(url, "[0-9]") / n, host_digit_ratio=count(host, "[0-9]") / host_n,
        entropy=F.aggregate(F.transform("chars", part), F.lit(0.0), lambda a, b: a + b),
        parameters=count(query, "[^&=]+=?[^&]*"), query_length=F.length(query).cast("double"),
        fragment=F.contains(url, F.lit("#")).cast("double"), secure=F.lower(url).startswith("https:").cast("double"),
        extension=path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"), suffix=_suffix(host)).drop("chars")


def _vector(df: DataFrame, share: float, suffixes: dict[str, tuple[float, int]]) -> DataFrame:
    """Add ``features``. The statistics are at most one row for each URL of the sample."""
    stats = df.sparkSession.createDataFrame(
        [(k, p, float(n)) for k, (p, n) in suffixes.items()], "suffix string, suffix_share double, suffix_seen double")
    out = df.withColumn("suffix", F.col("f.suffix")).join(F.broadcast(stats), "suffix", "left").drop("suffix")
    out = out.withColumn("suffix_share", F.coalesce("suffix_share", F.lit(share))) \
        .withColumn("suffix_seen", F.coalesce("suffix_seen", F.lit(0.0)))
    flat = out.withColumns({f"_f{i}": F.col(name if name.startswith("suffix") else f"f.{name}")
                            for i, name in enumerate(FEATURES)})
    assembled = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(FEATURES))], outputCol="features").transform(flat)
    return assembled.drop(*(f"_f{i}" for i in range(len(FEATURES))), "suffix_share", "suffix_seen")


def train(labelled: DataFrame, most: int = TRAIN_URLS, seed: int = 7) -> Trained | None:
    """Fit on rows (url, label 0.0 allow or 1.0 block); None when a label is absent."""
    sample = labelled.groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(most)
    rows = [(r["url"], r["label"]) for r in sample.collect()]  # at most ``most``
    labels = [y for _, y in rows]
    if len(set(labels)) < 2:
        return None
    spark = labelled.sparkSession
    urls = features(with_parts(spark.createDataFrame(rows, "url string, label double").coalesce(4)))
    share = sum(labels) / len(labels)
    suffixes = {r["suffix"]: ((r["blocked"] + PRIOR * share) / (r["n"] + PRIOR), r["n"])
                for r in urls.groupBy("f.suffix").agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n")).collect()}
    vectors = _vector(urls, share, suffixes).withColumn(
        "weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=seed, weightCol="weight")
    return Trained(trees.fit(vectors.select("features", "label", "weight")), share, suffixes)


def labelled_urls(urls: DataFrame, rules: dict[str, str], seeds: list[str]) -> DataFrame:
    """(url, label) of the rows of ``urls`` (url, u, rule) that a rule or a seed word decides."""
    seeded = F.col("u.host").rlike(rf"(?:^|[.\-@])(?:{'|'.join(seeds)})s?(?:$|[.\-:])") if seeds else F.lit(False)
    blocked = F.col("rule").isin([r for r, v in rules.items() if v == "block"])
    label = F.when(seeded, 1.0).when(blocked, 1.0).when(F.col("rule").isNotNull(), 0.0)
    return urls.select("url", label.alias("label")).filter("label is not null and url is not null")


def judged(
    df: DataFrame, rules: dict[str, str] = RULES, seeds: list[str] = SEED_WORDS, url: str = "url", most: int = TRAIN_URLS,
) -> DataFrame:
    """Each row as ``row`` with host, path, rule and verdict."""
    urls = with_parts(packed(df, url=url))
    urls = urls.withColumn("rule", matching_rule(F.col("u.host"), F.col("u.path"), rules))
    trained = train(labelled_urls(urls, rules, seeds), most)
    verdict = F.lit("allow")
    if trained is not None:
        urls = trained.model.transform(_vector(features(urls), trained.share, trained.suffixes))
        verdict = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    by_rule = F.element_at(F.create_map(*(F.lit(x) for item in rules.items() for x in item)), F.col("rule")) \
        if rules else F.lit(None).cast("string")
    return urls.select("row", F.col("u.host").alias("host"), F.col("u.path").alias("path"), "rule",
                       F.coalesce(by_rule, verdict).alias("verdict"))


def report(df: DataFrame, page_id: str = "page_id", url: str = "url", **options) -> DataFrame:
    out = judged(df.select(page_id, url), url=url, **options)
    return out.select(F.col(f"row.`{page_id}`").alias("page_id"), "host", "path", "rule", "verdict")
