"""The pipeline's stages one by one on the smallest tables."""

import corpus_pipeline
from ashlar.llm.common import durable, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF), name)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() == len(now)
        if name == "secrets":
            assert now == ids
        if name != "mix":
            assert docs.columns == columns
        assert len(now) >= 0.5 * len(ids)
        ids = now
    assert docs.filter("taken > 2 * size or taken <= 0").count() == 0


def test_empty_documents_give_an_empty_mix(spark):
    docs = table(spark, SF, "documents").limit(0)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF), name)
        assert docs.count() == 0
        if name != "mix":
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "source", "size", "target", "taken"]
