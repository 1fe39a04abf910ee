"""The pipeline's stages against brute force, one after the other."""

from collections import Counter

import corpus_pipeline
from lithosift.llm import near_dedup, packing, toxicity
from lithosift.llm import queries as llm

from .test_operators import brute_near, norm


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = out["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in before.collect() if model.scores([r.text or ""])[0] < toxicity.CUT}
    assert {r.doc_id for r in after.collect()} == want and len(want) > 0.8 * before.count()
    before, after = out["exact_dedup"]
    assert Counter(norm(r.text) for r in after.collect()) == Counter({norm(r.text) for r in before.collect()})
    before, after = out["near_dedup"]
    groups = brute_near([tuple(r) for r in before.collect()])
    assert after.count() == sum(groups.values()) and set(near_dedup.near_classes(after).groupBy("class_id").count().toPandas()["count"]) == {1}
    before, after = out["mixing"]
    assert set(after.collect()) <= set(before.collect()) and max(Counter(r.doc_id for r in after.collect()).values()) <= 3
    before, after = out["packing"]
    encode = packing.encoder(packing.tokenizer_path(packing.TOKENIZER), None)
    assert sum(r.length for r in after.collect()) == sum(len(encode(r.text or "")) + 1 for r in before.collect())
    assert after.select("sequence_id").distinct().count() == after.count()


def test_run_and_queries(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for name, q in llm.queries().items():
        assert q(spark, sf).count() > 0, name


def test_media_query_is_a_round_trip(spark, sf):
    rows = llm.op3_media_columns(spark, sf).collect()
    assert len(rows) == 200 and all(r.payload_bytes % 192 == 0 and r.feature for r in rows)
