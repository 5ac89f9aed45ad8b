import math
import weakref
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rugosa.llm import common, mixing, tokens, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, cols = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in pipeline.STAGES:
        out = common.written(stage(spark, docs, sf), name)
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        if name == "packing":
            assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
        else:
            assert out.columns == cols
        if name in ("mixing", "packing"):
            assert after == before
        docs, before = out, after


def test_whole_run_of_nothing(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def odd_documents(spark, sf):
    """Documents with null, empty and repeated texts, null and repeated ids, and a column that stages could trip over."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = docs.orderBy("doc_id").first()
    more = [(None, "no id at all", "en", "s", 3), (900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, one.text, "en", "s", 1), (900_003, one.text, "en", "s", 1), (900_004, "\n \t", "", "", 2)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema)).selectExpr("*", "concat('s', n_chars) AS score")


def test_toxicity_stage_keeps_what_the_written_out_formula_keeps(spark, sf):
    docs, labels = odd_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model, h = toxicity.fit(docs, labels), toxicity.hasher(17)

    def score(text):
        t = h.terms(text).tolist()
        v = {i: model.v[i].astype(float) for i in t}
        pairs = sum(float(v[a] @ v[b]) for k, a in enumerate(t) for b in t[k + 1 :]) if len(t) <= 60 else (float(sum(v.values()) @ sum(v.values())) - sum(float(x @ x) for x in v.values())) / 2
        z = model.b + sum(float(model.w[i]) for i in t) + (pairs / math.sqrt(len(t)) if t else 0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    rows = [tuple(r) for r in docs.collect()]
    want = Counter(r for r in rows if score(r[1]) < 0.5)
    got = pipeline.toxic_stage(spark, docs, sf)
    assert got.columns == docs.columns
    assert Counter(tuple(r) for r in got.collect()) == want
    assert len(want) < len(rows)
    assert pipeline.toxic_stage(spark, docs.limit(0), sf).count() == 0


def test_mixing_stage_repeats_rows_whole_and_drops_none(spark, sf):
    docs = odd_documents(spark, sf)
    before, after = (Counter(tuple(r) for r in d.collect()) for d in (docs, pipeline.mixing_stage(spark, docs, sf)))
    assert set(after) == set(before)
    assert all(before[r] * pipeline.MIX_LOW <= after[r] <= before[r] * math.ceil(pipeline.MIX_HIGH) for r in before)


def test_fits_leave_the_training_rows_out_of_the_driver(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(type(docs), "toArrow", None)
    assert toxicity.fit(docs, labels).w.any()
    assert mixing.fit_classifier(docs, labels, ["good", "poor"]).w.any()
    assert not toxicity.fit(docs, labels.limit(0)).w.any()
    assert not mixing.fit_classifier(docs, labels.limit(0), ["good", "poor"]).w.any()
    rows = spark.range(50, numPartitions=3).orderBy(F.desc("id")).limit(40)
    assert common.made_by_task(rows, lambda t: t.column("id").to_pylist()) == list(range(49, 9, -1))
    assert common.made_by_task(rows.where("id < 0"), lambda t: 1) is None


def test_a_worker_keeps_one_stages_words():
    first = toxicity.hasher(17)
    assert toxicity.hasher(17) is first
    gone = [weakref.ref(first), weakref.ref(toxicity.hasher(16))]
    del first
    assert gone[0]() is None
    enc = tokens.encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    assert gone[1]() is None and tokens.encoder(tokens.vocabulary("word_bpe_49k.json"), False) is enc


def test_memory_is_given_back_after_each_batch(monkeypatch):
    done = []
    monkeypatch.setattr(common, "released", lambda: done.append(1))
    b = pa.RecordBatch.from_pydict({"text": ["a b", None, "c"]})
    assert [x.num_rows for x in common.pieces([b, b], 2)] == [2, 1, 2, 1] and len(done) == 2
    assert sum(x.num_rows for x in common.portions([b, b], "text")) == 6 and len(done) == 4
