from helpers import SF, awkward, documents, nothing

import corpus_pipeline as pipeline
from tickloom.llm import queries
from tickloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark):
    """Every stage works on what the one before kept; all but the last keep the columns of documents."""
    docs = documents(spark)
    before = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = written(stage(spark, docs, SF), f"test-{name}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids and ids <= before, name
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS, name
        before = ids
    assert {"doc_id", "size", "shard", "slot"} <= set(docs.columns)


def test_stages_take_effect(spark):
    from test_decontaminate import brute as leaking
    from test_jaccard import brute as classes

    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in pipeline.one_of_each(spark, docs, SF).collect()}
    assert kept == {c for _, _, c in classes(rows)}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in pipeline.without_benchmark(spark, docs, SF).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in leaking(rows, items)}
    good = {r["doc_id"] for r in pipeline.good_quality(spark, docs, SF).collect()}
    assert good == {r["doc_id"] for r in queries.op8_quality_pu(spark, SF).where("predicted = 1").collect()}


def test_run(spark):
    out = queries.pipeline(spark, SF)
    assert out.count() > 0 and out.select("shard").distinct().count() <= 8


def test_empty_documents(spark):
    docs = nothing(spark)
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0


def test_awkward_rows_through_all_stages(spark):
    """Null and repeated ids, null, empty and very long texts and clashing names: no stage fails, and only decided rows go."""
    docs = awkward(spark)
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = written(stage(spark, docs, SF), f"awkward-{name}")
        rows = docs.collect()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            texts = {(r["doc_id"], r["text"]) for r in rows}
            assert before is None or texts <= before, name
            before = texts
    assert len(docs.columns) and {r["shard"] for r in rows} <= set(range(8))
    kept = pipeline.one_of_each(spark, awkward(spark), SF).collect()
    assert sum(r["text"] in (None, "") for r in kept) == 3 and sum((r["text"] or "").startswith("The same long") for r in kept) == 1
    assert pipeline.without_benchmark(spark, awkward(spark), SF).count() == 14
