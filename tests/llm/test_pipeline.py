"""The whole pipeline, stage by stage, against what each stage should leave."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_near_copies import brute as brute_groups
from test_packing import check as check_pieces
from test_quality import brute as brute_quality
from threadloom.llm import byte_ids, near_copies

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_copies", "personal_data", "packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        after[name] = {r["doc_id"]: r for r in docs.collect()}
    good = after["quality_rules"]
    assert all(not brute_quality(r["text"])[5] for r in good.values())
    assert all(r == before[k] for k, r in good.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(k in good for k, q in labels.items() if q == 1 and not brute_quality(before[k]["text"])[5])
    rows = [(k, r["text"]) for k, r in good.items()]
    _, groups = brute_groups(rows, near_copies.NearCopyRules())
    assert set(after["near_copies"]) == set(groups)
    assert set(after["personal_data"]) == set(after["near_copies"])
    library = Tokenizer.from_file(public_tokenizers.path(byte_ids.VOCABULARY))
    last = [(k, r["text"]) for k, r in after["personal_data"].items()]
    assert check_pieces(corpus_pipeline.STAGES[3][1](spark, docs, SF).collect(), last, library) == 0


def test_run_is_the_stages_in_a_row(spark):
    out = corpus_pipeline.run(spark, SF)
    assert "sequence_id" in out.columns and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
