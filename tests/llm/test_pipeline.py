import corpus_pipeline
from tessera.llm.common import written


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, sf), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        if k < 3:
            assert 0.7 * seen <= out.count() <= seen
        docs = out
    assert docs.where("length > 0").count() == docs.count() > 0


def test_empty_corpus(spark, sf, none):
    docs = none.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
