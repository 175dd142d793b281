import re
from collections import Counter

from pyspark.sql import functions as F

from eventrates.llm import quality_rules as q
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_matches_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = ["a b c d e a b c d e", "a a a a a a", "x\nx\n \n x", "a b c d e f a b c d e f g b c d e f", "a b c d"]
    docs = docs.union(spark.createDataFrame([(-i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in q.ledger(docs).collect():
        assert tuple(r[c] for c in COLUMNS) == slow(r["text"])


def test_odd_rows(spark):
    docs = odd.documents(spark).withColumn("failures", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    out = q.apply_policy(q.ledger(docs), ("web", 2))
    rows = out.collect()
    assert len(rows) == len(odd.rows())
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == slow(r["text"])
        assert r["kept"] == (r["failures"] == 0)
        if not (r["text"] or "").split():
            assert r["failures"] & 1
    assert q.ledger(odd.empty(spark)).count() == 0
    assert q.ablation(q.ledger(odd.empty(spark)), ("web", 2)).count() == 0


def test_policies_and_ablation(spark):
    table = q.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [r["failures"] for r in table.collect()]
    policy = ("web", 1)
    for r in q.ablation(table, policy).collect():
        bit, mask = q.BITS[r["rule"]], q.mask(policy)
        assert r["failed"] == sum(bool(f & bit) for f in rows)
        assert r["failed_alone"] == sum(f & mask == bit for f in rows)
        assert r["kept_without"] == sum(f & mask & ~bit == 0 for f in rows)
    assert q.apply_policy(table, policy).where("kept").count() == sum(f & q.mask(policy) == 0 for f in rows)
