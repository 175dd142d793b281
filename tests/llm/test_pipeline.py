from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import odd
from tests.llm.test_mixing import targets
from tests.llm.test_near_copies import groups, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing to source weights", "sharding"
    ]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = stages["quality classifier"](spark, docs, SF).cache()
    assert good.columns == columns
    kept = {r["doc_id"] for r in good.collect()}
    told = [(q, int(k in kept)) for k, q in labels.items()]
    assert sum(a == b for a, b in told) >= 0.9 * len(told)

    single = stages["simhash near-dedup"](spark, good, SF).cache()
    assert single.columns == columns
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in good.collect()}
    least = groups(set(prints.values()))
    first = {}
    for k, p in prints.items():
        first[least[p]] = min(first.get(least[p], k), k)
    assert {r["doc_id"] for r in single.collect()} == set(first.values())

    clean = stages["benchmark decontamination"](spark, single, SF).cache()
    assert clean.columns == columns
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    hold = {k for k, t in before.items() if any(i in t for i in items)}
    after = {r["doc_id"] for r in clean.collect()}
    assert not after & hold and len(set(before) - hold - after) <= 2

    mixed = stages["mixing to source weights"](spark, clean, SF).cache()
    assert mixed.columns == columns
    size, taken = Counter(), defaultdict(int)
    words = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in clean.collect()}
    for s, n in words.values():
        size[s] += n
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 3
    for k, n in copies.items():
        taken[words[k][0]] += n * words[k][1]
    largest = {s: max(n for t, n in words.values() if t == s) for s in size}
    for s, t in targets(dict(size)).items():
        assert abs(taken[s] - t) <= largest[s]

    shards = stages["sharding"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in shards) == copies
    counts = Counter(r["shard"] for r in shards)
    assert max(counts.values()) - min(counts[i] for i in range(16)) <= 1


def test_run(spark):
    a = corpus_pipeline.run(spark, SF)
    assert a.count() > 50 and {"doc_id", "text", "shard", "slot"} <= set(a.columns)


def test_empty_and_odd_tables(spark):
    for docs in (odd.documents(spark), odd.empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "sharding":
                assert docs.columns == columns
        docs.count()
