"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from tests.llm import brute as B


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert 0 < after.count() <= before.count()
        if name != "mixing":
            assert after.columns == docs.columns
        if name == "decontamination":
            assert {r.doc_id for r in after.collect()} == {d for d, t in ((r.doc_id, r.text) for r in before.collect()) if not B.decontaminate([(d, t)], bench)[0][5]}
        if name == "pii":
            assert not any(B.pii(r.text) for r in after.collect()) and after.count() == before.count()
        before = after


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "taken"} <= set(out.columns)
