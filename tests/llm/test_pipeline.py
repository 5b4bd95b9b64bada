"""The stages one by one against the operators they call, and the whole."""

import corpus_pipeline
from assetlens.llm import neardup, queries
from fixtures import SF, odd_documents


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, rules), (_, quality), (_, dedup), (_, pack) = corpus_pipeline.STAGES
    first = rules(spark, docs, SF)
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in queries.op5_quality_rules(spark, SF).where("kept").collect()}
    second = quality(spark, docs, SF)
    assert {r["doc_id"] for r in second.collect()} == {r["doc_id"] for r in queries.op6_quality_ranking(spark, SF).where("predicted = 1").collect()}
    third = dedup(spark, docs, SF)
    assert third.columns == docs.columns
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in neardup.near_duplicates(docs).where("kept").collect()}
    packed = corpus_pipeline.run(spark, SF)
    left = {r["doc_id"] for r in dedup(spark, quality(spark, first, SF), SF).collect()}
    assert {r["doc_id"] for r in packed.collect()} == left and 0 < len(left) < docs.count()


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark)
    rows = docs.count()
    left = {"quality_rules": 0, "near_dedup": 10}  # all texts are too short or repeat themselves; three rows repeat others
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "best_fit_packing":  # every document is there whole, the empty ones too
            assert out.where("piece = 0").count() == rows
        else:
            assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(map(tuple, docs.collect())), name
            assert out.count() == left.get(name, out.count()), name
        assert stage(spark, docs.limit(0), SF).count() == 0
