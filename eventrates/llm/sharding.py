"""Sharding by a keyed permutation of global row numbers.

Rows get a global number in the order of their key. A Feistel network over the product of two ranges of about the
square root of the row count permutes the numbers; values at or beyond the row count walk on along their cycle. The
permuted number, taken modulo the shard count, is the shard, and its quotient the slot. Shard and slot of a row number
are thus computable, and so is the row number of a shard and slot; counts differ by one at most.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import carried, hashable, own, packed, stored, unpacked

ROUNDS = 8
SEED = 20240229
# Bits that monotonically_increasing_id leaves for the place within a partition.
PLACE_BITS = 33


def numbered(df: DataFrame, key: str, name: str = "row_number", nulls_last: bool = False) -> tuple[DataFrame, int]:
    """Add global row numbers from 0, in the order of ``key``, then of a hash of the row; also return the row count.

    The number depends on the rows alone, not on files or partitions. Rows equal in all columns are interchangeable
    and spread over partitions, so a key that holds a third of the rows is not one task's work. Columns that Spark
    cannot hash (maps) do not take part in the order. NULL keys come first, or last with ``nulls_last``. An empty
    table stays empty. Of two input columns named alike, ``name`` is replaced.
    """
    columns = carried(df, [name])
    spark = df.sparkSession
    keyed = df.select(
        packed(df, columns).alias("row"),
        own(key).alias("key"),
        F.xxhash64(*[own(c) for c in hashable(df.select(*[own(c) for c in columns]))]).alias("mark"),
        F.monotonically_increasing_id().alias("spread"),
    )
    order = [F.col("key").asc_nulls_last() if nulls_last else F.col("key").asc_nulls_first(), "mark", "spread"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        keyed.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .select("row", F.monotonically_increasing_id().alias("place"))
    )
    part = F.shiftright("place", PLACE_BITS)
    # One row per partition: as many as there are shuffle partitions.
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets, "part long, start long")
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    number = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return out.select(*unpacked(columns), number.alias(name)), total


def _ranges(rows: int) -> tuple[int, int]:
    """Two ranges whose product is at least ``rows`` and exceeds it by less than its root."""
    a = max(1, isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _pass(x: Column, rows: int, seed: int, back: bool) -> Column:
    """The Feistel network once, or its inverse."""
    a, b = _ranges(rows)
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    if rows > 1 << 50:
        raise ValueError("more than 2^50 rows")
    sign = -1 if back else 1

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.lit(sign) * F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.lit(sign) * F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), F.lit(b)), F.lit(b))
        even = i % 2 == 0
        return F.struct(
            F.when(even, left).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise(right).cast("long").alias("r"),
        )

    turns = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    return F.aggregate(turns, start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(number: Column, rows: int, seed: int = SEED, back: bool = False) -> Column:
    """The permutation of 0..rows-1 (with ``back`` its inverse) as a column expression.

    Values beyond the rows are fewer than the root of the rows. A walk meets each of them once at most, which bounds
    it on small tables; on large ones 40 steps outside have a probability far below 10^-80. A longer walk is an error.
    """
    a, b = _ranges(rows)
    steps = min(a * b - rows, 40) + 1

    def walk(v: Column, _: Column) -> Column:
        return F.when(v < rows, v).otherwise(_pass(v, rows, seed, back))

    first = _pass(number, rows, seed, back)
    if a * b == rows:
        return first
    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, walk)
    return F.when(last < rows, last).otherwise(F.raise_error(F.lit("the walk along a cycle did not end")))


def shard_of(number: Column, rows: int, shards: int, seed: int = SEED) -> Column:
    """Struct of shard (int) and slot (long) of a row number."""
    at = permuted(number, rows, seed)
    return F.transform(
        F.array(at),
        lambda p: F.struct(F.pmod(p, F.lit(shards)).cast("int").alias("shard"), F.floor(p / F.lit(shards)).alias("slot")),
    )[0]


def number_at(shard: Column, slot: Column, rows: int, shards: int, seed: int = SEED) -> Column:
    """The row number that stands at a shard and slot."""
    return permuted(slot * F.lit(shards) + shard, rows, seed, back=True)


def shard_rows(df: DataFrame, key: str, shards: int = 16, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``df`` with ``row_number``, ``shard`` and ``slot``.

    Slots run from 0 without gaps within a shard and shard sizes differ by one at most. NULL keys, NULL or empty or
    long texts and repeated rows are rows like any other; of equal rows each gets a place of its own. Input columns
    of the three names are replaced. An empty table gives an empty table.
    """
    columns = carried(df, ["row_number", "shard", "slot"])
    lean = df.select(*[own(c) for c in columns])
    rows, total = numbered(lean, key)
    place = shard_of(F.col("row_number"), max(total, 1), shards, seed)
    out = rows.select(packed(rows, columns).alias("row"), "row_number", place.alias("place"))
    return out.select(*unpacked(columns), "row_number", "place.shard", "place.slot")
