"""Trie of conversation prefixes, screened by a count-min sketch of prefix digests.

A prefix's digest is the exclusive or of its turns' hashes, each taken with its position, so digests of long
conversations are put together from blocks. Every prefix is counted in a count-min sketch whose counters stop at two; an
estimate of one proves that a single conversation has the prefix, and then it alone has all longer ones. Those tails
become nodes where they are. Only prefixes that may be shared are grouped exactly, by digest. Sums over subtrees are
sums over a node's conversations: each conversation knows from which depth on it is the smallest member, so no level of
the tree is walked.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .mixing import word_count
from .sharding import numbered
from .storage import own, stored

# Rows of a sketch, and counters of a row: twice the prefixes, within these bounds. With more prefixes than half the upper
# bound the sketch proves fewer singletons, and more prefixes are grouped exactly; results are the same.
SKETCH_ROWS = 2
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 25
CHUNK = 1 << 15
# Turns of one conversation that one window holds; blocks of blocks are summed alike.
BLOCK_BITS = 12
LEVELS = 4
# Conversations whose ids are joined into one text before they are hashed in order.
IDS_AT_ONCE = 1 << 14
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NODE = ["d", "d1", "d2"]


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, t1, t2, words): turns numbered from 1 in each conversation, by turn, NULL first; NULL texts are empty.

    Turns of equal number stand in the order of their role, then of a hash of their text. Rows without a conversation
    are no part of any. One conversation may hold any share of the rows: rows are numbered over all conversations by a
    range partitioning, and from the least number of each conversation.
    """
    filled = [F.coalesce(own(c).cast("string"), F.lit("")) for c in (role, text)]
    slim = turns.where(own(conv).isNotNull()).select(
        own(conv).cast("long").alias("conv"),
        own(turn).alias("turn"),
        filled[0].alias("role"),
        F.xxhash64(F.lit(1), *filled).alias("t1"),
        F.xxhash64(F.lit(2), *filled).alias("t2"),
        word_count(filled[1]).alias("words"),
    )
    keyed = slim.select("conv", F.struct("conv", "turn", "role", "t1", "t2").alias("order"), "t1", "t2", "words")
    rows, _ = numbered(keyed, "order", "at")
    rows = stored(rows.select("conv", "at", "t1", "t2", "words"))
    first = stored(rows.groupBy("conv").agg(F.min("at").alias("first")))
    out = rows.join(first, "conv")
    return out.select("conv", (F.col("at") - F.col("first") + 1).alias("pos"), "t1", "t2", "words")


def borrowed(own_turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations whose first turns come from another: (conv, pos, t1, t2, words) and (conv).

    Conversation c begins with the first h turns of c - c % ``every``, all if it has fewer, none if it is absent, and
    goes on with its own turns after its first h; h is crc32 of c in decimal, modulo ``heads``.
    """
    own_turns = stored(own_turns)
    convs = own_turns.select("conv").distinct()
    share = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("long")
    base = F.col("conv") - F.col("conv") % every
    convs = stored(convs.select("conv", share.alias("h"), base.alias("base")))
    begin = own_turns.where((F.col("conv") % every == 0) & (F.col("pos") < heads))
    begin = begin.select(F.col("conv").alias("base"), "pos", "t1", "t2", "words")
    # At most ``every`` conversations share a base, and at most ``heads`` - 1 turns come from it.
    lent = stored(convs.join(begin, "base").where(F.col("pos") <= F.col("h")).select("conv", "pos", "t1", "t2", "words"))
    got = lent.groupBy("conv").agg(F.count("*").alias("got"))
    shift = stored(convs.join(got, "conv", "left").select("conv", "h", F.coalesce("got", F.lit(0)).alias("got")))
    rest = own_turns.join(shift, "conv").where(F.col("pos") > F.col("h"))
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "t1", "t2", "words")
    return lent.union(rest), convs.select("conv")


def running(turns: DataFrame) -> DataFrame:
    """(conv, d, d1, d2, p1, p2, words, upto): digests of each prefix and its parent, and the words up to its last turn.

    Windows hold 2^12 turns of a conversation at most; the sums of such blocks are carried on by windows over blocks.
    """
    salted = [F.xxhash64(F.lit(i), "pos", "t1", "t2").alias(f"g{i}") for i in (1, 2)]
    rows = turns.select("conv", "pos", *salted, "words", ((F.col("pos") - 1)).alias("b"))
    sums = {"s1": F.bit_xor("g1"), "s2": F.bit_xor("g2"), "s3": F.sum("words")}

    def window(level: int) -> Window:
        block = F.shiftright("b", BLOCK_BITS)
        return Window.partitionBy("conv", block).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)

    rows = stored(rows.select("*", *[f.over(window(0)).alias(c) for c, f in sums.items()]))
    carry, level = None, rows
    for _ in range(LEVELS - 1):
        long = level.where(F.col("b") >= 1 << BLOCK_BITS).select("conv").distinct()
        if long.isEmpty():
            break
        blocks = level.join(stored(long), "conv", "left_semi").groupBy("conv", F.shiftright("b", BLOCK_BITS).alias("b"))
        blocks = blocks.agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"), F.sum("words").alias("words"))
        blocks = stored(blocks)
        level = stored(blocks.select("*", *[f.over(window(1)).alias(c) for c, f in sums.items()]))
        carry = [*(carry or []), level]
    if carry:
        # From the coarsest blocks down: what stands before a block is what all earlier ones of its own block give.
        before = None
        for level in reversed(carry):
            level = _carried(level, before)
            before = stored(level.select("conv", (F.col("b") + 1).alias("block"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("s3").alias("c3")))
        rows = _carried(rows, before)
    parent = [F.col(f"s{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)]
    return rows.select("conv", F.col("pos").alias("d"), F.col("s1").alias("d1"), F.col("s2").alias("d2"), *parent, "words", F.col("s3").alias("upto"))


def _carried(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Running sums within blocks, with those of the blocks before."""
    if before is None:
        return rows
    out = rows.withColumn("block", F.shiftright("b", BLOCK_BITS)).join(before, ["conv", "block"], "left")
    return out.select(
        *[c for c in rows.columns if c not in ("s1", "s2", "s3")],
        *[F.col(s).bitwiseXOR(F.coalesce(c, F.lit(0))).alias(s) for s, c in (("s1", "c1"), ("s2", "c2"))],
        (F.col("s3") + F.coalesce("c3", F.lit(0))).alias("s3"),
    )


def counters_for(prefixes: int) -> int:
    """Counters in a row of the sketch: a power of two, at least twice the prefixes within the bounds."""
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, 2 * prefixes - 1).bit_length()))


def _places(digest: np.ndarray, row: int, counters: int) -> np.ndarray:
    mixed = (digest.astype(np.int64).view(np.uint64) ^ np.uint64(SPREAD[row] >> 3)) * np.uint64(SPREAD[row])
    return (mixed >> np.uint64(64 - counters.bit_length() + 1)).astype(np.int64)


def sketch(prefixes: DataFrame, counters: int) -> list[np.ndarray]:
    """Count-min rows over digests ``d1``, counters stopping at two, each row an array of bytes.

    Each task counts its rows, tasks send the parts of the table that they touched, two bits a counter and compressed,
    and the parts are added up by place. The finished table, 2^25 counters a row at most, comes to the driver.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((SKETCH_ROWS, counters), np.uint8)
        for pdf in batches:
            for row in range(SKETCH_ROWS):
                place, n = np.unique(_places(pdf["d1"].to_numpy(), row, counters), return_counts=True)
                table[row, place] = np.minimum(table[row, place] + n, 2)
        yield from _sent(table)

    def _sent(table: np.ndarray) -> Iterator[pd.DataFrame]:
        size = min(CHUNK, counters)
        for row in range(SKETCH_ROWS):
            for at in range(0, counters, size):
                part = table[row, at : at + size]
                if part.any():
                    yield pd.DataFrame({"row": [row], "at": [at], "part": [_packed(part)]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for row, at, data in zip(pdf["row"], pdf["at"], pdf["part"]):
                part = _unpacked(data)
                known = parts.get((row, at))
                parts[(row, at)] = part if known is None else np.minimum(known + part, 2)
        for (row, at), part in parts.items():
            yield pd.DataFrame({"row": [row], "at": [at], "part": [_packed(part)]})

    schema = "row int, at long, part binary"
    sent = prefixes.select("d1").mapInPandas(partial, schema)
    total = sent.repartition("row", "at").mapInPandas(added, schema)
    table = [np.zeros(counters, np.uint8) for _ in range(SKETCH_ROWS)]
    for row, at, data in total.toLocalIterator():
        part = _unpacked(data)
        table[row][at : at + len(part)] = part
    return table


def _packed(part: np.ndarray) -> bytes:
    """Two bits a counter."""
    bits = np.packbits(np.stack([part & 1, part >> 1], axis=-1).ravel())
    return zlib.compress(bits.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).reshape(-1, 2)
    return bits[:, 0] + 2 * bits[:, 1]


def screened(prefixes: DataFrame, table: list[np.ndarray]) -> DataFrame:
    """Rows with ``single``: whether the sketch proves that one conversation alone has the prefix."""
    counters = len(table[0])
    sent = prefixes.sparkSession.sparkContext.broadcast([_packed(row) for row in table])

    def single(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = [_unpacked(data) for data in sent.value]
        for digests in batches:
            least = rows[0][_places(digests.to_numpy(), 0, counters)]
            for i in range(1, SKETCH_ROWS):
                least = np.minimum(least, rows[i][_places(digests.to_numpy(), i, counters)])
            yield pd.Series(least == 1)

    return prefixes.withColumn("single", F.pandas_udf(single, "boolean")("d1"))


def ends_digest(ends: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of the ids ``conv`` of each node in ascending order, joined by commas: ``keys`` and ``ends``.

    The ids of one node may be any share of all. They are sorted over many tasks, which join stretches of them into
    texts; one task then hashes a node's texts in order, holding one at a time.
    """
    order = [*keys, "conv"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), IDS_AT_ONCE):
                for key, rows in pdf.iloc[at : at + IDS_AT_ONCE].groupby(keys, sort=False):
                    ids = rows["conv"].to_numpy()
                    yield pd.DataFrame([(*key, ids[0], ",".join(map(str, ids.tolist())))], columns=[*order, "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            done = []
            for *key, ids in pdf[[*keys, "ids"]].itertuples(index=False, name=None):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if done:
                yield pd.DataFrame(done, columns=[*keys, "ends"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*keys, "ends"])

    kinds = ", ".join(f"{k} long" for k in keys)
    texts = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    texts = stored(texts.mapInPandas(joined, f"{kinds}, conv long, ids string"))
    return texts.repartition(*keys).sortWithinPartitions(*order).mapInPandas(hashed, f"{kinds}, ends string")


def trie(turns: DataFrame, convs: DataFrame | None = None, counters: int | None = None) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv, pos from 1 without gaps, t1, t2, words).

    ``convs`` (conv) names all conversations, also those without turns; by default those of ``turns``. Returns
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` per node: a depth and a sequence of that many turns, the root at depth 0
    included. Without any conversation there is no node. (conv_id, depth) names a node; ``with_turns`` adds its last
    turn. Sketch width ``counters`` is a power of two; by default it follows the number of prefixes up to 2^25.
    """
    prefixes = stored(running(turns))
    convs = stored((turns.select("conv") if convs is None else convs).distinct())
    n = prefixes.count()
    marked = stored(screened(prefixes, sketch(prefixes, counters or counters_for(n))))
    last = marked.groupBy("conv").agg(
        F.max("d").alias("length"), F.max("upto").alias("total"), F.min(F.when(F.col("single"), F.col("d"))).alias("alone")
    )
    last = stored(convs.join(last, "conv", "left").select("conv", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("total", F.lit(0)).alias("total"), "alone"))
    rows = marked.drop("single").join(last.select("conv", "length", "alone"), "conv")
    rows = stored(rows)
    maybe = rows.where(F.col("alone").isNull() | (F.col("d") < F.col("alone")))
    tails = rows.where(F.col("d") >= F.col("alone"))
    heads = rows.where(F.col("d") == F.col("alone"))
    # Exact grouping of what may be shared; all members have the same parent and the same words.
    groups = stored(
        maybe.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
        )
    )
    above = [(F.col("d") - 1).alias("d"), F.col("p1").alias("d1"), F.col("p2").alias("d2")]
    below = groups.select(*above).union(heads.select(*above))
    children = stored(below.groupBy(*NODE).agg(F.count("*").alias("n_children")))
    nodes = groups.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes)
    # The depth from which on a conversation is the smallest member, and its words before that depth.
    members = stored(maybe.join(nodes.select(*NODE, "conv_id", "n_children"), NODE))
    before = F.struct("d", (F.col("upto") - F.col("words")).alias("before"))
    owned = members.where(F.col("conv") == F.col("conv_id")).select("conv", before.alias("from"))
    owned = owned.union(heads.select("conv", before.alias("from"))).groupBy("conv").agg(F.min("from").alias("from"))
    leaf = members.where("d = length and conv = conv_id and n_children = 0").select("conv").union(heads.select("conv"))
    leaf = leaf.distinct().withColumn("leaf", F.lit(1))
    known = last.join(owned, "conv", "left").join(leaf, "conv", "left").select(
        "conv", "length", F.coalesce("from.before", "total").alias("before"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    known = stored(known)
    told = members.select("conv", *NODE, (F.col("upto") - F.col("words")).alias("start")).join(known, "conv")
    sums = stored(
        told.groupBy(*NODE).agg(
            F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("before") - F.col("start"))).alias("saved_tokens")
        )
    )
    ends = stored(maybe.where("d = length").select(*NODE, "conv"))
    hashes = stored(ends_digest(ends, NODE))
    none = F.sha2(F.lit("").cast("binary"), 256)
    top = known.agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("leaves"), F.sum("before").alias("saved_tokens")
    ).first()
    # Parents of all nodes but tails after their first; the root's id is known.
    shared = nodes.join(sums, NODE).join(hashes, NODE, "left").select(
        "conv_id", "d", "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends")
    )
    only = [F.lit(v).cast("long").alias(c) for c, v in (("n_leaves", 1), ("saved_tokens", 0))]
    end = F.when(F.col("d") == F.col("length"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(none)
    single = [
        F.col("conv").alias("conv_id"), "d", "p1", "p2", F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("d") == F.col("length"), 0).otherwise(1).cast("long").alias("n_children"), *only, end.alias("ends"),
    ]
    rest = tails.where(F.col("d") > F.col("alone")).select(*single)
    asked = stored(shared.union(heads.select(*single)))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent"))
    placed = asked.where("d > 1").join(stored(parents), ["d", "p1", "p2"])
    root_id = F.lit(top["conv_id"]).cast("long")

    def told_by(parent: Column) -> list[Column]:
        return [
            F.col("conv_id").cast("long").alias("conv_id"), F.col("d").cast("long").alias("depth"), parent.cast("long").alias("parent_conv_id"),
            *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.col("ends").alias("ends_sha256"),
        ]

    out = asked.where("d = 1").select(*told_by(root_id)).union(placed.select(*told_by(F.col("parent"))))
    out = out.union(rest.select(*told_by(F.col("conv_id"))))
    empty = known.where("length = 0").select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "conv")
    if top["conv_id"] is None:
        return out
    fan = asked.where("d = 1").count()
    root = ends_digest(empty, NODE).agg(F.coalesce(F.min("ends"), none).alias("ends")).select(  # one row
        F.lit(top["conv_id"]).alias("conv_id"), F.lit(0).alias("d"), F.lit(top["n_convs"]).alias("n_convs"),
        F.lit(fan).alias("n_children"), F.lit(top["leaves"] if fan else 1).alias("n_leaves"),
        F.lit(top["saved_tokens"]).alias("saved_tokens"), "ends",
    )
    return out.union(root.select(*told_by(F.lit(None))))


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with the columns of the turn they end with: ``turns`` has ``conv``, ``pos`` and any others."""
    at = turns.withColumnRenamed("conv", "conv_id").withColumnRenamed("pos", "depth")
    return nodes.join(at, ["conv_id", "depth"], "left")
