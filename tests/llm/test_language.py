from collections import Counter, defaultdict

import numpy as np

from eventrates.llm import language, queries
from eventrates.llm.splits import sampled
from tests.llm import odd

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    rows = queries.op4_language(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 1000
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.98


def by_sets(rows):
    """Sets of n-grams by language, by loops over all rows, copies once."""
    counts = defaultdict(Counter)
    for text, name in set(rows):
        padded = "".join(c if c.isalpha() else "\0" for c in f"\n{text.lower()}\n")
        counts[name].update(padded[i - 1 : i + 2] for i in range(1, len(padded) - 1) if padded[i] != "\0")
    share = {name: {g: n / sum(c.values()) for g, n in c.items()} for name, c in counts.items()}
    return {
        name: {g for g, n in c.items() if n >= 2 and share[name][g] >= 0.3 * max(s.get(g, 0) for s in share.values())}
        for name, c in counts.items()
    }


def test_filter_against_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    sets = by_sets([(r["text"], r["lang"]) for r in docs.where("text is not null and lang is not null").collect()])
    model = language.train(docs.union(docs))
    assert model.languages == tuple(sorted(name for name, grams in sets.items() if grams))
    for i, name in enumerate(model.languages):
        codes = np.array([[ord(c) for c in g] for g in sorted(sets[name])], np.uint64)
        grams = (codes[:, 0] << np.uint64(42)) | (codes[:, 1] << np.uint64(21)) | codes[:, 2]
        assert ((model.hits(grams)[:, 0] >> np.uint64(i)) & np.uint64(1)).all()
        slots = np.unique(np.concatenate([language._slot(grams, h) for h in language.HASHES]))
        set_bits = np.flatnonzero((model.masks[:, 0] >> np.uint64(i)) & np.uint64(1))
        assert (slots == set_bits).all()
    assert (model.false_hits < 0.2).all()


def test_sample_counts_copies_once(spark):
    rows = [("one text", "en")] * 600 + [(f"text {i}", "en") for i in range(400)] + [("ein Text", "de")] * 50
    docs = spark.createDataFrame(rows, "text string, lang string")
    taken = Counter((r["lang"], r["text"]) for r in sampled(docs, "lang", 100).collect())
    assert max(taken.values()) == 1 and ("de", "ein Text") in taken
    assert 60 < sum(name == "en" for name, _ in taken) < 140


def test_blocks_cover_long_texts(monkeypatch):
    texts = ["", "ab", "x" * 500, "día " * 300, "!!", "z"]
    whole = [list(g) for g in ([(int(a), int(b)) for a, b in zip(*p)] for p in language._blocks(texts))]
    monkeypatch.setattr(language, "BLOCK", 64)
    parts = [list(g) for g in ([(int(a), int(b)) for a, b in zip(*p)] for p in language._blocks(texts))]
    assert sorted(sum(whole, [])) == sorted(sum(parts, []))
    assert len(sum(whole, [])) == sum(c.isalpha() for t in texts for c in t)


def test_odd_rows(spark):
    docs = odd.documents(spark).withColumnRenamed("at", "score")
    model = language.train(docs)
    assert model.languages == ("de", "en", "fr") or set(model.languages) <= {"de", "en", "fr"}
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(odd.rows())
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language.identify(odd.empty(spark), model).count() == 0
    nothing = language.train(odd.empty(spark))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
