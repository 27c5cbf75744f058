import glob

import pytest

from lodestone.plans import lineage


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())


def test_settle_collects_garbage(spark, monkeypatch):
    monkeypatch.setattr(lineage, "_collected", [-lineage.PAUSE_S - 1.0])
    before = full_collections(spark)
    lineage.settle(spark.range(3))
    assert full_collections(spark) > before


def test_a_stage_begins_with_memory_given_back(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    before = full_collections(spark)
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() > 0
    assert full_collections(spark) > before


def test_small_tables_have_few_files(spark):
    from lodestone.operators.components import connected_components

    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        labels = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {tuple(r) for r in labels.collect()} == {(i, 0) for i in range(41)}
    assert len(glob.glob(f"{labels.settled_at.removeprefix('file:')}/*.parquet")) == 1
