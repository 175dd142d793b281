import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from eventrates.llm import near_copies, queries
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Least member reachable over differences of two bits, by comparing all."""
    least = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for p in prints:
            for q in prints:
                if (p ^ q).bit_count() <= 2 and least[q] < least[p]:
                    least[p], changed = least[q], True
    return least


def check(rows, texts):
    prints = [int(r["fingerprint"], 16) for r in rows]
    if texts:
        assert prints == [slow_fingerprint(texts[r["doc_id"]]) for r in rows]
    least = groups(set(prints))
    smallest = {}
    for p, r in zip(prints, rows):
        if r["doc_id"] is not None:
            smallest[least[p]] = min(smallest.get(least[p], r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in rows] == [smallest.get(least[p]) for p in prints]


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_simhash(spark, SF).collect()
    assert len(rows) == 200
    check(rows, texts)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    out = near_copies.near_copies(docs).withColumn("fingerprint", near_copies.hexadecimal(F.col("fingerprint")))
    rows = out.collect()
    assert len(rows) == len(odd.rows())
    assert [int(r["fingerprint"], 16) for r in rows] == [slow_fingerprint(r["text"]) for r in rows]
    check(rows, None)
    assert near_copies.near_copies(odd.empty(spark)).count() == 0
    assert near_copies.one_of_each(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("few", [1, 16])
def test_components_of_chains_and_crowds(spark, monkeypatch, few):
    monkeypatch.setattr(near_copies, "FEW", few)
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(40):  # a walk of one to three bits a step
            prints.add(p)
            for _ in range(rng.choice([1, 1, 2, 2, 2, 3])):
                p ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << i) for i in range(64)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = {r["node"]: r["root"] for r in near_copies.roots(near_copies.links(df)).collect()}
    want = groups(prints)
    unsigned = lambda x: x % (1 << 64)
    classes = {}
    for p in prints:
        classes.setdefault(want[p], set()).add(p)
    for members in classes.values():
        if len(members) > 1:
            signed_of = [p - (1 << 64) if p >> 63 else p for p in members]
            assert len({found.get(p, p) for p in signed_of}) == 1
    for p, r in found.items():
        assert want[unsigned(p)] == want[unsigned(r)]


def test_one_of_each(spark):
    docs = odd.documents(spark)
    out = near_copies.one_of_each(docs)
    assert out.schema == docs.schema
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids
    assert out.where("text like 'no id%'").count() == 1
