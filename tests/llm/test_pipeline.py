import corpus_pipeline

from quillon.llm import decontam, packing, registry


def test_stages_in_order_and_columns(spark, documents, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "packing"]
    docs, counts = documents, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert documents.count() > counts[0] >= counts[1] > counts[2] >= counts[3] > 0 and counts[1] == counts[0]
    clean = spark.read.parquet(str(tmp_path / "3"))
    assert decontam.leaked_items(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.select("doc_id", "piece", "ids_crc32").exceptAll(docs.select("doc_id", "piece", "ids_crc32")).count() == 0
    assert whole.agg({"length": "sum"}).first()[0] == packing.pieces(clean).agg({"length": "sum"}).first()[0]


def test_stages_take_empty_and_null_rows(spark, make, sf_dir):
    for df in (make([]), make([(1, None, None, None, None), (None, "", None, None, None), (1, None, None, None, None)])):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf_dir).count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
