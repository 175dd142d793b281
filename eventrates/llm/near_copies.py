"""Near copies by SimHash, found through deletion variants of fingerprint segments.

Fingerprints that differ in up to two of 64 bits agree, but for one bit at most, in one of two segments of 32 bits.
Each segment is indexed once per bit with that bit left open, equal keys are joined and the pairs verified. A key with
many fingerprints would give all pairs of them; its fingerprints are linked through their one-bit neighbours instead:
two fingerprints differ by up to two bits exactly if they share such a neighbour, and a neighbour has 65 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_below, carried, checkpointed, own, packed, stored, unpacked

SHINGLE_WORDS = 3
HASH_SEED = 42
# Keys with more fingerprints than this are linked through neighbours.
FEW = 16
# Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint_of(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the shingles of one text, as a signed number; 0 without words."""
    import numpy as np
    import xxhash

    # On bytes, lower() changes A-Z and split() cuts at \\x20 and \\x09-\\x0D alone.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: max(1, len(words) - words_each + 1)].tolist()
    ends = (ends[min(len(words), words_each) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = [digest(joined[s:e], HASH_SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    over_half = np.packbits(set_in * 2 > len(starts), bitorder="little")
    return int(over_half.view("<i8")[0])


def fingerprints(text: Column) -> Column:
    """SimHash of a text column as long; texts go to Python in Arrow batches, no other column does."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return of(text)


def hexadecimal(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _variants(prints: DataFrame) -> DataFrame:
    """(fingerprint, key): for both segments and each bit, the segment with that bit left open."""
    keys = F.expr(
        """concat(
            transform(sequence(0, 31), i ->
                shiftleft(i + 0L, 32) | (shiftrightunsigned(fingerprint, 32) & ~shiftleft(1L, i))),
            transform(sequence(0, 31), i ->
                shiftleft(i + 32L, 32) | ((fingerprint & 4294967295L) & ~shiftleft(1L, i))))"""
    )
    return prints.select("fingerprint", F.explode(keys).alias("key"))


def _through_neighbours(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within two bits of each other, from a group's least to the others."""
    near = F.expr("concat(array(fingerprint), transform(sequence(0, 63), i -> fingerprint ^ shiftleft(1L, i)))")
    spread = prints.select("fingerprint", F.explode(near).alias("neighbour"))
    # A group holds the neighbour itself and its 64 one-bit flips at most.
    groups = spread.groupBy("neighbour").agg(F.sort_array(F.collect_set("fingerprint")).alias("all"))
    rest = F.expr("slice(all, 2, size(all) - 1)")
    return groups.where(F.size("all") > 1).select(F.element_at("all", 1).alias("a"), F.explode(rest).alias("b"))


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a < b) between distinct fingerprints whose components are those of "differs in up to two bits"."""
    if bits != 2:
        raise ValueError("two segments with one open bit find differences of two bits")
    variants = _variants(prints)
    shared = checkpointed(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    few_keys = broadcast_below(shared.withColumnRenamed("key", "at"), shared.count(), 250_000)
    members = stored(variants.join(few_keys, F.col("key") == F.col("at")).select("key", "fingerprint", "n"))
    few = members.where(F.col("n") <= FEW)
    left = few.select("key", F.col("fingerprint").alias("a"))
    right = few.select("key", F.col("fingerprint").alias("b"))
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & verified).select("a", "b")
    crowded = members.where(F.col("n") > FEW).select("fingerprint").distinct()
    return pairs.union(_through_neighbours(crowded)).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over ``edges`` (a, b); roots and nodes without edges do not appear.

    Every turn links the larger neighbours of each node, then its smaller ones, to the least of all, until nothing
    changes. Turns start from a checkpoint; only two sums come to the driver.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
        larger = both.join(least, F.col("a") == F.col("at")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), "m")
        smaller = larger.join(least, F.col("a") == F.col("at")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(least.select(F.col("at").alias("a"), F.col("m").alias("b")).union(smaller).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with ``fingerprint`` (long), ``component_id`` and ``root``; ``keep`` names columns to carry.

    ``component_id`` is the smallest non-NULL key reachable (NULL if there is none); ``root`` is the least fingerprint
    reachable, which names the group whatever the keys are. Texts that are NULL or without words have fingerprint 0
    and are linked like any other; with fewer words than a shingle, the whole sequence is the one shingle. Repeated
    rows stay, each with its result. Input columns of the added names are replaced. Of an empty table nothing is left.
    """
    added = ["fingerprint", "component_id", "root"]
    names = carried(docs, added) if keep is None else [c for c in keep if c not in added]
    lean = docs.select(packed(docs, names).alias("row"), own(key).alias("id"), fingerprints(own(text)).alias("fingerprint"))
    lean = stored(lean)
    nodes = stored(lean.groupBy("fingerprint").agg(F.min("id").alias("smallest")))
    joined = roots(links(nodes.select("fingerprint")))
    linked = nodes.join(joined, F.col("fingerprint") == F.col("node"), "left")
    linked = linked.select("fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root"))
    # A group of many fingerprints is reduced by each task first.
    groups = linked.groupBy("root").agg(F.min("smallest").alias("component_id"))
    labels = linked.select("fingerprint", "root").join(groups, "root")
    out = lean.join(labels.withColumnRenamed("fingerprint", "of"), F.col("fingerprint") == F.col("of"))
    return out.select(*unpacked(names), "fingerprint", "component_id", "root")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``: that of the smallest key, NULL last."""
    marked = stored(
        docs.select(
            packed(docs, docs.columns).alias("row"),
            F.monotonically_increasing_id().alias("at"),
            own(key).alias("id"),
            fingerprints(own(text)).alias("fingerprint"),
        )
    )
    lean = marked.select("at", "id", "fingerprint")
    joined = roots(links(lean.select("fingerprint").distinct()))
    placed = lean.join(joined, F.col("fingerprint") == F.col("node"), "left")
    group = F.coalesce("root", "fingerprint").alias("group")
    first = placed.groupBy(group).agg(F.min(F.struct(F.col("id").isNull(), "id", "at")).alias("first"))
    kept = first.select(F.col("first.at").alias("kept"))
    return marked.join(kept, F.col("at") == F.col("kept"), "left_semi").select(*unpacked(docs.columns))
