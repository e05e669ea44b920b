"""The pipeline keeps clean documents, and each stage's decisions take effect."""

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "pieces":
            assert docs.columns == columns
    assert counts[0] == 200 and counts[1] <= counts[0] and counts[2] < counts[1] and counts[4] == counts[3]
    assert docs.columns == ["doc_id", "n_pieces", "pieces_hash", "round_trip"] and docs.filter("not round_trip").isEmpty()


def test_empty_input(spark, empty):
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_the_driver_gives_memory_back(spark, monkeypatch):
    """Before each stage that follows another, and after each staged table, the driver's Python and JVM return what they freed."""
    import corpus_pipeline
    from weftnet.llm import base

    assert base.driver_gives_back(spark)
    calls = []
    monkeypatch.setattr(base, "driver_gives_back", lambda s: calls.append("staged"))
    monkeypatch.setattr(corpus_pipeline, "driver_gives_back", lambda s: calls.append("stage"))
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    corpus_pipeline.lines(spark, docs, "")
    base.staged(docs)
    assert calls == ["stage", "staged"]


def test_the_executors_give_memory_back(spark):
    """Full collections run where the tasks run: here in the driver's JVM."""
    from weftnet.llm import base

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = full()
    assert base.executors_give_back(spark)
    assert full() > before


def test_each_stage_begins_with_memory_given_back_and_bounded_batches(spark, empty, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    calls = []
    monkeypatch.setattr(P, "executors_give_back", lambda s: calls.append("executors"))
    monkeypatch.setattr(P, "bounded_batches", lambda s: calls.append("batches"))
    for _, stage in P.STAGES:
        stage(spark, empty, "")
    assert calls == ["executors", "batches"] * len(P.STAGES)

    monkeypatch.undo()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    try:
        P._begin(spark)

        def sizes(batches):
            for batch in batches:
                yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "b"])

        rows = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("t")).mapInArrow(sizes, "n long, b long").collect()
        assert sum(r["n"] for r in rows) == 6000 and max(r["b"] for r in rows) < 2 * (2 << 20)
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
