import re
from collections import Counter, defaultdict

from eventrates.llm import mixing, queries
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s: most * sizes[s] for s in open_ if share[s] >= most * sizes[s]}
        if not over:
            return full | share
        full |= over


def check(rows, ids):
    size = Counter()
    taken = defaultdict(int)
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", ids[r["doc_id"]] or "")) if ids else r["size"]
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n
        size[r["source"]] += n
        taken[r["source"]] += r["taken"]
    want = targets(dict(size))
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3


def test_query(spark):
    ids = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_mixing(spark, SF).collect()
    assert len(rows) == 200
    check(rows, ids)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op1_mixing(spark, SF).collect()))


def test_odd_rows(spark):
    docs = odd.documents(spark)
    out = mixing.mix(docs)
    assert out.columns == [c for c in docs.columns if c != "size"] + [
        "size", "source_size", "target", "repeats", "rest", "taken"
    ]
    rows = out.collect()
    assert len(rows) == len(odd.rows())
    check(rows, None)
    assert mixing.mix(odd.empty(spark)).count() == 0
    assert mixing.mix(docs.where("text is null")).agg({"taken": "sum"}).first()[0] == 0


def test_whole_rows(spark):
    docs = odd.documents(spark)
    out = mixing.mixed_rows(docs)
    assert out.schema == docs.schema
    taken = Counter(r["doc_id"] for r in out.collect())
    assert taken[8] <= 3


def test_empty_texts_at_the_cap(spark):
    rows = [(i, "" if i % 3 else f"word{i} x", "a" if i < 60 else "b") for i in range(70)]
    rows += [(i, "many words here " * 50, "b") for i in range(70, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = {r["doc_id"]: r["repeats"] for r in mixing.mix(docs).collect()}
    assert max(told.values()) == 3 and all(told[i] == 3 for i in range(60) if i % 3 == 0)
    taken = Counter(r["doc_id"] for r in mixing.mixed_rows(docs).collect())
    assert all(taken[i] <= 3 for i in range(60))


def test_smaller_mix_is_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("source = 'src3'")
    sizes = mixing.mix(docs).first()["source_size"]
    slim = docs.select(
        "source", mixing.word_count(docs["text"]).alias("size"), docs["doc_id"].cast("long").alias("hash")
    )
    ends = []
    for part in (0.2, 0.5, 0.9):
        t = spark.createDataFrame([("src3", sizes, part * sizes)], "source string, source_size long, target double")
        ends.append(mixing._thresholds(slim, t, 1).first()["prefix"])
    assert ends == sorted(ends)
