import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from eventrates.llm import queries, ranked_search
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def slow(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    many, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counts:
            m = 100 - 90 + (90 * n * many) // length
            score = sum(
                math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert found(queries.op12_ranked_search(spark, SF)) == slow(docs, items)


@pytest.mark.parametrize("width,at_once", [(8, 2000), (1, 3)])
def test_any_width_and_block(spark, monkeypatch, width, at_once):
    monkeypatch.setattr(ranked_search, "ITEMS_AT_ONCE", at_once)
    monkeypatch.setattr(ranked_search, "LEAST_BITS", width)
    rng = random.Random(width)
    words = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(rng.choice(words[: rng.randrange(1, 120)]) for _ in range(rng.randrange(0, 400)))) for i in range(150)]
    docs += [(500 + i, "w3 w5 w3") for i in range(30)] + [(None, "w3 w5 w3")] * 3 + [(900, "w7 " * 700), (901, None), (902, "")]
    items = [(i, " ".join(rng.sample(words, 9))) for i in range(6)] + [(7, "w3 W5"), (8, None), (9, "unknown!"), (7, "w3 W5"), (None, "w7")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert found(ranked_search.search(d, q)) == slow(docs, items)
    assert found(ranked_search.search(d, q, k=2)) == slow(docs, items, 2)


def test_bounds_hold():
    rng = random.Random(4)
    words = [f"w{i}".encode() for i in range(300)]
    texts = [" ".join(w.decode() for w in rng.choices(words, k=rng.randrange(1, 500))) for _ in range(40)] + ["w1 " * 900]
    made = [ranked_search.sketch_of(t) for t in texts]
    of_item = [sorted(rng.sample(range(300), 20)) for _ in range(15)]
    q = ranked_search.Queries(words, ranked_search._hashes(words), of_item, np.arange(1, 301), 41, sum(n for n, _ in made))
    n = np.array([n for n, _ in made])
    seen = 0
    for docs, bound in q.bounds(n, [s for _, s in made]):
        for row, d in enumerate(docs):
            counts = Counter(ranked_search.terms_of(texts[d]))
            for i in range(15):
                assert bound[row, i] >= q.score(i, counts, int(q.damping(n)[d]))
                seen += 1
    assert seen == 41 * 15


def test_odd_rows(spark):
    docs = odd.documents(spark)
    items = spark.createDataFrame([(1, "cat mat"), (2, "漢字"), (3, "long"), (4, None), (5, "id")], "item_id long, text string")
    assert found(ranked_search.search(docs, items)) == slow([(r[0], r[1]) for r in odd.rows()], [tuple(r) for r in items.collect()])
    assert ranked_search.search(odd.empty(spark), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0
