import hashlib
import random
import re
import zlib

import pytest

from eventrates.llm import conversation_trie, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int"


def rebuilt(rows):
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            key = (r["turn"] is not None, r["turn"] or 0, r["role"] or "")
            own.setdefault(r["conv_id"], []).append((key, (r["role"] or "", r["text"] or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def slow(convs):
    """All nodes by the sets of their members."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    inner = {p[:-1] for p in nodes if p}
    out = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[: len(path)] == path]
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(len(q) == len(path) + 1 for q in below), sum(q not in inner for q in below),
            sum((len(nodes[q]) - 1) * words(q) for q in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


def build(df, counters=None):
    turns = conversation_trie.ordered_turns(df)
    return conversation_trie.trie(*conversation_trie.borrowed(turns), counters=counters)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert found(queries.op11_prefix_trie(spark, SF)) == slow(rebuilt(rows))


def random_rows(rng, convs=60):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a b", "c", "", None, "d e f"]), "clash", 1))
    rows += [(100, t, "user", "one two", "clash", 1) for t in range(5)]
    rows += [(c, t, "user", "one two", "clash", 1) for c in range(101, 119) for t in range(5)]
    rows += [(None, 0, "user", "nowhere", "clash", 1), (200, None, "user", "first", "clash", 1), (200, 0, "user", "next", "clash", 1)]
    rows += [(c, 0, "user", "short", "clash", 1) for c in range(301, 312)]  # no base; some lose all turns
    return rows


@pytest.mark.parametrize("counters", [4, None])
def test_random_conversations(spark, counters):
    df = spark.createDataFrame(random_rows(random.Random(counters or 9)), SCHEMA)
    assert found(build(df, counters)) == slow(rebuilt(df.collect()))


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(conversation_trie, "IDS_AT_ONCE", 3)
    rng = random.Random(2)
    rows = random_rows(rng, 25) + [(c, t, "user", f"w{t}" if t < 90 else f"w{c} x", "", 1) for c in (400, 401, 402, 420) for t in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(build(df)) == slow(rebuilt(df.collect()))


def test_repeats_and_empty(spark):
    rows = [(1, 0, "user", "same", "", 1)] * 6 + [(2, 0, "user", "same", "", 1)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(build(df)) == slow(rebuilt(df.collect()))
    assert build(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_never_counts_low(spark):
    df = spark.createDataFrame([(i % 700,) for i in range(1000)], "d1 long")
    table = conversation_trie.sketch(df, 1 << 10)
    rows = conversation_trie.screened(df, table).where("single").collect()
    assert all(300 <= r["d1"] < 700 for r in rows)
    wide = conversation_trie.screened(df, conversation_trie.sketch(df, 1 << 16)).where("single").count()
    assert 380 <= wide <= 400


def test_last_turns(spark):
    turns = conversation_trie.ordered_turns(spark.createDataFrame([(7, 0, "user", "hi you", "", 1), (7, 1, "bot", "yes", "", 1)], SCHEMA))
    out = conversation_trie.with_turns(conversation_trie.trie(turns), turns).orderBy("depth").collect()
    assert [(r["depth"], r["words"]) for r in out] == [(0, None), (1, 2), (2, 1)]
