import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from eventrates.llm import queries, repeated_bytes
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def slow(texts, length):
    """Per text: bytes, removed bytes, spans and the rest, by counting all strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        rest = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def found(df, key, length):
    out = repeated_bytes.repeats(df, length=length)
    out = out.withColumn("kept", repeated_bytes.kept_bytes(out["whole_text"], out["removed"]))
    return [
        (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
        for r in sorted(out.collect(), key=lambda r: r[key])
    ]


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_suffix_dedup(spark, SF).collect()}
    want = dict(zip([r["doc_id"] for r in rows], slow([r["text"] for r in rows], 400)))
    assert out == want
    assert sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize("length,piece", [(1, 1 << 20), (7, 37), (24, 37), (50, 1 << 20)])
def test_random_texts(spark, monkeypatch, length, piece):
    monkeypatch.setattr(repeated_bytes, "PIECE", piece)
    rng = random.Random(length)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 300))) for _ in range(12)]
    texts = [None, "", "x" * 200, "xy" * 90, "xyz" * 70]
    for _ in range(60):
        t = "".join(
            rng.choice(base)[(s := rng.randrange(0, 250)) : s + rng.randrange(0, 3 * length)] for _ in range(rng.randrange(0, 5))
        )
        texts.append(t)
    texts += rng.sample(texts, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(df, "doc_id", length) == slow(texts, length)


def test_pieces_join(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abcdefgh") for _ in range(20_000))
    whole = repeated_bytes.anchors(data)
    monkeypatch.setattr(repeated_bytes, "PIECE", 777)
    cut = repeated_bytes.anchors(data)
    for c in whole:
        if c not in ("u1", "u2"):
            assert (whole[c] == cut[c]).all(), c
    assert (whole["u1"] == cut["u1"])[whole["around"]].all()
    # Every string start has exactly one anchor.
    covered = sum(int(f - n + 1) for n, f in zip(whole["near"], whole["far"]))
    assert covered == len(data) - 399


def test_odd_rows(spark):
    docs = odd.documents(spark)
    out = repeated_bytes.repeats(docs)
    assert out.count() == len(odd.rows())
    assert set(docs.columns) <= set(out.columns)
    want = sorted(w[:3] for w in slow([r[1] for r in odd.rows()], 400))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out.collect()) == want
    assert repeated_bytes.repeats(odd.empty(spark)).count() == 0
    clash = docs.withColumnRenamed("row", "t1").withColumnRenamed("size", "removed").withColumnRenamed("at", "a")
    assert repeated_bytes.repeats(clash).count() == len(odd.rows())
