import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventrates.llm import decontamination as d
from eventrates.llm import queries
from tests.llm import odd

SF = "/root/testdata/sf0.01"


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length():
    rng = random.Random(2)
    idf = np.ones(d.FEATURES, np.float32)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))]
        b = [rng.choice("abcdefghxyz").encode() for _ in range(rng.randrange(0, 90))]
        item = d.item_of(1, " ".join(a), idf)
        assert d.common_length(item, b) == slow_common(item.words, b)
        first, last = d.common_span(item, b)
        assert slow_common(item.words, b[first : last + 1]) == slow_common(item.words, b)


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of one table with paraphrased items put into some of them, and the pairs planted."""
    rng = random.Random(4)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pool = " ".join(t for _, t in docs[:50]).split()
    pairs = set()
    for i, (key, text) in enumerate(items * 4):
        words = [rng.choice(pool) if rng.random() < 0.15 else w for w in text.split()]
        if i % 4 == 1:
            words = [w.upper() for w in words]
        at = rng.randrange(len(docs))
        host = docs[at][1].split(" ")
        cut = rng.randrange(len(host) + 1)
        docs[at] = (docs[at][0], " ".join(host[:cut] + words + host[cut:]))
        pairs.add((docs[at][0], key))
    return docs, items, pairs


def test_recall_against_brute_force(spark, planted):
    docs, items, pairs = planted
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(df, bench).select("doc_id", "item_id").collect()}
    flat = np.ones(d.FEATURES, np.float32)
    read = [d.item_of(k, t, flat) for k, t in items]
    some = docs[::10] + [x for x in docs if any(x[0] == p for p, _ in pairs)]
    want = set()
    for key, text in some:  # every passage against every item
        words = d.words_of(text)
        for item in read:
            for at in range(0, max(1, len(words) - d.BLOCK_WORDS), d.BLOCK_WORDS):
                hit = d.verified(item, words, at, at + 2 * d.BLOCK_WORDS)
                if hit and hit[0] >= 0.7:
                    want.add((key, item.key))
                    break
    assert len(want & found) / len(want) >= 0.97
    assert len(pairs & found) / len(pairs) >= 0.9
    of_some = {p for p in found if p[0] in {k for k, _ in some}}
    assert len(of_some - want) <= 0.1 * len(want)
    kept = {r["doc_id"] for r in d.clean(df, bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in found}


def test_odd_rows(spark):
    prose = odd.rows()[0][1]
    docs = odd.documents(spark).withColumn("cosine", F.lit("clash"))
    items = [(1, prose), (2, None), (3, ""), (4, "!!"), (1, prose), (None, "very long very long very long"), (5, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.leaks(docs, bench).collect()
    found = sorted((r["doc_id"], r["item_id"]) for r in rows if r["item_id"] == 1)
    assert found == sorted([(1, 1), (2, 1), (2, 1), (11, 1)] * 2)
    assert all(r["item_id"] in (1, 5, None) for r in rows)
    assert d.leaks(odd.empty(spark), bench).count() == 0
    assert d.leaks(docs, bench.where("false")).count() == 0
    assert d.clean(docs, bench.where("false")).count() == len(odd.rows())
    left = d.clean(docs, bench.where("item_id = 1"))
    assert left.schema == docs.schema and left.where("doc_id in (1, 2, 11)").count() == 0
    assert left.count() == len(odd.rows()) - 4


def test_query_finds_verbatim_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(a["doc_id"], b["item_id"]) for a in docs for b in items if b["text"] in a["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, SF).collect()}
    assert want <= found and len(found - want) <= max(2, len(want) // 10)


def test_items_outside_the_latent_space():
    """Copies are found at any number of items: here no vector reaches the cosine at all."""
    rng = random.Random(9)
    pool = [f"w{int(20 * rng.paretovariate(0.8))}" for _ in range(60_000)]
    idf = np.log(len(pool) / (1.0 + np.bincount(d.features_of(" ".join(pool).encode())[0], minlength=d.FEATURES)))
    idf = np.maximum(idf, 0).astype(np.float32)
    items, texts, want = [], [], set()
    for k, n in enumerate([1, 2, 4, 7, 8, 9, 12, 20, 40, 100, 300] * 60):
        words = [rng.choice(pool) for _ in range(n)]
        item = d.item_of(k, " ".join(words), idf)
        if k % 2 and n >= d.SHORT:  # a third of the words replaced
            for j in rng.sample(range(n), n // 3):
                words[j] = f"other{rng.random()}".replace(".", "")
        text = [rng.choice(pool) for _ in range(rng.choice([0, 3, 40, 700]))]
        cut = rng.randrange(len(text) + 1)
        text[cut:cut] = words
        items.append(item)
        texts.append(" ".join(text))
        if d.verified(item, d.words_of(texts[-1]), cut, cut + n, 0):
            want.add((k, k))
    index = d.Index(np.zeros((d.FEATURES + 1, 4), np.float32), np.zeros((len(items), 4), np.float32), tuple(items), idf)
    found = {(t, i) for t, f in enumerate(index.leaks(texts)) for i, *_ in f}
    assert len(want) > 500 and len(want & found) == len(want)


def test_space_comes_from_all_passages(spark):
    """The space is that of a dense decomposition of every passage of every text; copies of a passage count once."""
    rng = random.Random(11)
    pool = [f"w{int(30 * rng.paretovariate(0.9))}" for _ in range(4_000)]
    texts = [" ".join(rng.choice(pool) for _ in range(n)) for n in [32 * 20, 32 * 30 - 5, 32 * 12 + 20, 7] + [90]]
    items = [" ".join(rng.choice(pool) for _ in range(n)) for n in (12, 80)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], None, ""])), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    index = next(d._indexes(docs.repartition(3), bench, "text", "item_id", "text"))
    parts = [w[i : i + 32] for t in texts for w in [t.split()] for i in range(0, len(w), 32)]
    assert d.RANK < len(parts) + len(items) <= d.RANK + d.EXTRA
    rows = []
    for words, weight in [(p, 1.0) for p in parts] + [(i.split(), d.ITEM_WEIGHT) for i in items]:
        v = np.bincount(d.features_of(" ".join(words).encode())[0], minlength=d.FEATURES) * index.idf
        rows.append(weight * v / np.sqrt(v @ v))
    vectors = np.linalg.svd(np.array(rows), full_matrices=False)[2][d.COMMON : d.RANK].T * index.idf[:, None]
    used = np.unique(np.nonzero(rows)[1])
    assert np.allclose(index.projection[used] @ index.projection[used].T, vectors[used] @ vectors[used].T, atol=2e-3)
