"""The registered queries of this folder; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import (
    main_text, near_copies, packing, pseudonyms, quality, ranked_search, sentence_pieces, sharding, source_divergence,
    token_counts, urls, vector_links, warc,
)
from threadloom.llm.oracles import ORACLE  # noqa: F401
from threadloom.llm.tables import table

#: The key of the registered query, whose tables are invented. Real documents need one that is kept secret.
TRIAL_KEY = "invented documents only"


def op1_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.report(table(spark, sf_dir, "embeddings"))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(table(spark, sf_dir, "documents"), key=TRIAL_KEY)


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.report(table(spark, sf_dir, "documents"), near_copies.NearCopyRules(shingle=4))


def op5_agenda_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.report(table(spark, sf_dir, "documents"))


def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.report(table(spark, sf_dir, "pages"))


def op7_finite_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"))


def op8_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_boosted_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op11_bag_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_count_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_boundary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


QUERIES = {name: fn for name, fn in globals().items() if name.startswith("op")}
