"""Training and held-out rows, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_below, checkpointed

SAMPLE_SEED = 11
HASH_RANGE = float(1 << 63)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; false for NULL."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(rows: DataFrame, group: str, most: int) -> DataFrame:
    """About ``most`` different rows of each group, or all where there are fewer, by a hash of all columns: reruns agree.

    Equal rows count once and come once, so copies neither widen nor narrow the sample. The fractions come from
    estimated numbers of different rows (5 % off), one row per group; no group is gathered.
    """
    mark = F.shiftrightunsigned(F.xxhash64(F.lit(SAMPLE_SEED), *[F.col(c) for c in rows.columns]), 1)
    counts = checkpointed(rows.groupBy(F.col(group).alias("of")).agg(F.approx_count_distinct(mark).alias("n")))
    counts = broadcast_below(counts, counts.count())
    joined = rows.join(counts, F.col(group).eqNullSafe(F.col("of")))
    return joined.where(mark / HASH_RANGE < most / F.col("n")).select(*rows.columns).distinct()
