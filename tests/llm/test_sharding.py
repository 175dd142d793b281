from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventrates.llm import queries, sharding
from tests.llm import odd

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 16, 100, 1000, 4099])
def test_permutes_and_inverts(spark, rows):
    at = F.col("id")
    out = spark.range(rows).select(
        at, sharding.permuted(at, rows).alias("to"), sharding.shard_of(at, rows, 16).alias("s")
    )
    out = out.withColumn("back", sharding.number_at(F.col("s.shard"), F.col("s.slot"), rows, 16)).collect()
    assert sorted(r["to"] for r in out) == list(range(rows))
    assert all(r["back"] == r["id"] for r in out)


def test_order_is_shuffled(spark):
    to = [r[0] for r in spark.range(2000).select(sharding.permuted(F.col("id"), 2000)).collect()]
    kept = sum(b == a + 1 for a, b in zip(to, to[1:]))
    assert kept < 20


def check(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min([counts[s] for s in range(shards)]) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_odd_rows(spark):
    out = sharding.shard_rows(odd.documents(spark), "doc_id", shards=4)
    rows = out.collect()
    assert len(rows) == len(odd.rows())
    assert out.columns == [c for c in odd.documents(spark).columns if c != "shard"] + ["row_number", "shard", "slot"]
    check(rows, 4)
    assert sharding.shard_rows(odd.empty(spark), "doc_id").count() == 0


def test_independent_of_files(spark):
    docs = odd.documents(spark)
    a = {tuple(r) for r in sharding.shard_rows(docs.repartition(5), "doc_id", 4).collect()}
    b = {tuple(r) for r in sharding.shard_rows(docs.coalesce(1), "doc_id", 4).collect()}
    assert a == b


def test_query(spark):
    rows = queries.op7_sharding(spark, SF).collect()
    assert len(rows) == 200
    check(rows, 16)
