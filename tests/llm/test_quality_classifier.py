import numpy as np
import zlib

from eventrates.llm import quality_classifier as q
from eventrates.llm import queries
from tests.llm import odd

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    rows = queries.op9_quality_classifier(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    seen = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in seen]) > 0.93
    again = {r["doc_id"]: r["score"] for r in queries.op9_quality_classifier(spark, SF).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in rows)


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, (2000, 3))
    u = np.r_[rng.normal(2, 1, (1200, 3)), rng.normal(-2, 1, (800, 3))]
    w, b = q.fit_risk(p, u, 0.6)
    assert 0.5 < q.estimate_prior(p @ w + b, u @ w + b) < 0.7
    g = u @ w + b
    assert (g[:1200] > 0).mean() > 0.97 and (g[1200:] < 0).mean() > 0.97


def test_odd_rows(spark):
    docs = odd.documents(spark).withColumnRenamed("at", "score")
    positives = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    model = q.train(docs, positives, positives)
    out = q.classify(docs, model)
    assert out.count() == len(odd.rows()) and out.where("score < 0 or score > 1 or score is null").count() == 0
    for none in (q.train(docs, positives.where("false"), positives), q.train(odd.empty(spark), positives, positives)):
        assert none is None
    assert {r["score"] for r in q.classify(docs, None).collect()} == {0.5}
    assert q.classify(odd.empty(spark), model).count() == 0
    everything = docs.select("doc_id")
    assert q.train(docs, positives, everything.where("doc_id is not null")) is not None


def test_one_unlabelled_row_does_not_decide(spark, monkeypatch):
    monkeypatch.setattr(q, "fit", lambda p, u: (len(p), len(u)))
    full = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    extra = full.union(spark.createDataFrame([(None, "text")], "doc_id long, text string"))
    labels = full.select("doc_id")
    positives = labels.where("doc_id < 20")
    assert q.train(full, positives, labels) == (20, 60)
    assert q.train(extra, positives, labels) == (20, 61)
    assert q.train(full, positives, positives) == (20, 60)


def test_one_key_of_many_rows_counts_once(spark, monkeypatch):
    monkeypatch.setattr(q, "fit", lambda p, u: (len(p), len(u)))
    docs = spark.range(3000).selectExpr("if(id < 2000, 7L, id) as doc_id", "concat('text ', id) as text")
    positives = spark.createDataFrame([(7,), (2500,)], "doc_id long")
    taken_p, taken_u = q.train(docs, positives, positives)
    assert (taken_p, taken_u) == (2, 1001)
