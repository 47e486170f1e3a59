import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES:
        docs = pipeline._work.table(stage(spark, docs, SF), "stage")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) <= before
        assert set(pipeline.COLUMNS) <= set(docs.columns)
        if name in ("near dedup", "decontamination"):
            assert len(ids) == len(set(ids))
        if name == "near dedup":
            assert docs.select("text").distinct().count() == len(ids)
        before = set(ids)
    assert before
