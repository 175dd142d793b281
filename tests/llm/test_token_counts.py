import random

from pyspark.sql import functions as F

from eventrates.llm import queries
from eventrates.llm import token_counts as t
from tests.llm import odd

SF = "/root/testdata/sf0.001"
TEXT = "It's the cat's  hat; déjà vu at 12 345.\n\n  Don't stop—go on, I'll wait!! ünd 漢字 x's " * 40


def test_cuts_hold():
    for text in (TEXT, "", " ", "a" * 2000, "word " * 500, "1 2 3 " * 300, TEXT.replace(" ", " ")):
        leaves = t.cut(text)
        assert "".join(leaves) == text
        assert sum(map(t.count, leaves)) == t.count(text)


def test_random_edits(monkeypatch):
    rng = random.Random(6)
    for leaf in (4, 16, 64):
        monkeypatch.setattr(t, "LEAF_CHARACTERS", leaf)
        for _ in range(150):
            text = "".join(rng.choice(["ab ", "the", " cat", "'s", "'", "  ", "\n", "12", "é", "!", " x", "漢字", "。"]) for _ in range(rng.randrange(0, 60)))
            tree = t.Tree.of(text)
            for _ in range(3):
                edits = []
                for _ in range(rng.randrange(0, 5)):
                    a = rng.randrange(len(text) + 1)
                    b = min(len(text), a + rng.choice([0, 0, 1, 3, 20]))
                    edits.append((a, b, rng.choice(["", "", " ", "new", " a b", "'s", "\n\n", "9"])))
                want, at = [], 0
                for a, b, new in t.in_order(edits, len(text)):
                    want += [text[at:a], new]
                    at = b
                want = "".join([*want, text[at:]])
                text, again = t.edit(tree, text, edits)
                assert text == want
                assert tree.characters == len(text) and tree.tokens == t.count(text)
                assert again <= len(text)


def test_little_is_encoded_again():
    tree = t.Tree.of(TEXT * 20)
    _, again = t.edit(tree, TEXT * 20, [(40_000, 40_003, "new words"), (10, 12, "x")])
    assert again < 6 * t.LEAF_CHARACTERS


SCRIPTS = {
    "chinese": "天地玄黃，宇宙洪荒。日月盈昃，辰宿列張。寒來暑往，秋收冬藏。",
    "japanese": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "code": "for(i=0;i<n;i++){x[i]+=y[i]*2;if(x[i]>9)break;}",
    "numbers": "12,5;7,25;118,0;3,75;0,125;",
    "lines": "1\t22\t333\n4\t55\t666\n",
}


def test_little_without_spaces():
    for text in SCRIPTS.values():
        text = text * (14_000 // len(text))
        assert max(map(len, t.cut(text))) < 2 * t.LEAF_CHARACTERS
        tree = t.Tree.of(text)
        new, again = t.edit(tree, text, [(7_001, 7_003, "x1")])
        assert new == text[:7_001] + "x1" + text[7_003:]
        assert again < 4 * t.LEAF_CHARACTERS and tree.tokens == t.count(new)


def test_kinds_cut_at_every_place():
    """At each place that holds, the parts have as many tokens as the whole, in texts of all kinds of characters."""
    rng = random.Random(8)
    alphabet = ["a", "s", "'", "'s", "é", "漢", "1", "٣", "½", "!", "。", "\u0301", "\u200b", "\x1c", " ", "  ", "\n", "\t", "\u3000", "\x85", "\U00031350", "😀"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(24))
        for p in range(1, len(text)):
            if t.holds(text[:p], text[p:]):
                assert t.count(text[:p]) + t.count(text[p:]) == t.count(text)


def test_tree_finds_leaves():
    tree = t.Tree.of(TEXT)
    starts = [0]
    for leaf in t.cut(TEXT):
        starts.append(starts[-1] + len(leaf))
    for i, (a, b) in enumerate(zip(starts, starts[1:])):
        assert tree.leaf_at(a) == (i, a) and tree.leaf_at(b - 1) == (i, a)


def test_odd_rows(spark):
    docs = odd.documents(spark).withColumnRenamed("at", "leaves")
    trees = t.with_trees(docs)
    assert trees.columns == [c for c in docs.columns if c != "leaves"] + ["leaves", "n_tokens"]
    for r in trees.collect():
        assert r["n_tokens"] == t.count(r["text"] or "")
    kind = "array<struct<start: int, end: int, replacement: string>>"
    edits = "[{\"start\": 0, \"end\": 0, \"replacement\": \"New \"}, {\"start\": 1, \"end\": 2}, {\"start\": 9999999, \"end\": 2, \"replacement\": \"x\"}]"
    done = t.apply_edits(trees.withColumn("edits", F.from_json(F.lit(edits), kind))).collect()
    assert len(done) == len(odd.rows())
    before = sorted(x[1] or "" for x in odd.rows())
    assert sorted((r["text"] or "").removeprefix("New ") for r in done) == before
    for r in done:
        assert r["n_tokens"] == t.count(r["text"] or "") == sum(r["leaves"]["tokens"])
    assert t.with_trees(odd.empty(spark)).count() == 0
    none = t.with_trees(odd.empty(spark)).withColumn("edits", F.from_json(F.lit("[]"), kind))
    assert t.apply_edits(none).count() == 0


def test_query(spark):
    import re

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_token_counts(spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_before"] == t.count(text)
        found = [(m.start(), m.end(), new) for p, new in t.SCRUBBED for m in re.finditer(p, text)]
        assert r["n_edits"] == len(found)
        new, at = [], 0
        for a, b, x in t.in_order(found, len(text)):
            new += [text[at:a], x]
            at = b
        assert r["n_after"] == t.count("".join([*new, text[at:]]))
        assert r["n_again"] > 0 if found else r["n_again"] == 0
    assert any(r["n_edits"] for r in rows)
