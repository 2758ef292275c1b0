import corpus_pipeline as c


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = set(texts)
    for name, stage in c.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert tuple(docs.columns) == c.COLUMNS
        now = {r["doc_id"] for r in docs.collect()}
        assert now and now <= before, name
        before = now
    packed = c.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == before


def test_run(spark, sf):
    assert {r["doc_id"] for r in c.run(spark, sf).collect()} <= {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_odd(spark, odd_docs, sf):
    docs = odd_docs.select(*c.COLUMNS)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf)
        docs.count()
    empty = odd_docs.limit(0).select(*c.COLUMNS)
    for _, stage in c.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
