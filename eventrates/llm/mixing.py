"""Mixing sources to target weights by nested hash thresholds.

Words are summed by source and hash bucket. A source's budget of further words ends in one bucket, whose rows alone are
summed again by the next bits of the hash, and so on down to a single hash. Rows below it are taken once more, rows
above are not; nothing is sorted. A larger budget only moves the threshold up, so smaller mixes are parts of larger
ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import numbered
from .storage import broadcast_below, carried, checkpointed, own, packed, stored, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = 7
HASH_BITS = 63
LEVEL_BITS = (12, 12, 12, 12, 15)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Target words per source from ``sizes`` (source, source_size), which has one row per source.

    Sources take the weights in turn, in code point order, NULL last, and share the sum of all sizes. A target stops at
    ``most`` times its source's size and the excess is shared again by weight. Each turn is one aggregate of the table
    of sources; two numbers come back. Without any words all targets are 0.
    """
    ranked, _ = numbered(sizes, "source", "rank", nulls_last=True)
    at = F.pmod("rank", F.lit(len(weights))).cast("int")
    weighed = checkpointed(
        ranked.select(
            "source",
            "source_size",
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1).alias("weight"),
            (F.col("source_size") * most).cast("double").alias("ceiling"),
        )
    )
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, before = 0.0, None
    while True:
        full = F.col("ceiling") <= level * F.col("weight")
        state = weighed.agg(
            F.coalesce(F.sum(F.when(full, F.col("ceiling"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if state[2] == before or not state[1]:
            break
        before, level = state[2], (total - state[0]) / state[1]
    target = F.least("ceiling", level * F.col("weight"))
    return checkpointed(weighed.select("source", "source_size", target.alias("target")))


def _thresholds(rows: DataFrame, targets: DataFrame, sources: int) -> DataFrame:
    """Per source: whole repeats of all rows, the boundary hash, and the words each row at that hash gives."""
    size = F.col("source_size")
    repeats = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = targets.select(
        "source",
        "source_size",
        "target",
        repeats.alias("repeats"),
        F.greatest(F.lit(0), F.floor(F.col("target") - repeats * size)).cast("long").alias("left"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("ties"),
    )
    left_bits = HASH_BITS
    for bits in LEVEL_BITS:
        known = F.shiftright("hash", left_bits)
        left_bits -= bits
        if left_bits + bits < HASH_BITS:  # from the second level on, the boundary bucket of each source alone
            now = broadcast_below(state.select(F.col("source").alias("of"), F.col("prefix").alias("at")), sources)
            rows = rows.join(now, F.col("source").eqNullSafe(F.col("of")) & (known == F.col("at")))
            rows = checkpointed(rows.select("source", "hash", "size"))
        buckets = rows.groupBy(
            F.col("source").alias("of"), F.shiftright("hash", left_bits).alias("bucket")
        ).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        # At most 2^bits rows per source.
        summed = buckets.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        summed = summed.join(
            broadcast_below(state, sources),
            F.col("source").eqNullSafe(F.col("of")) & (F.col("upto") > F.col("left")) & (F.col("before") <= F.col("left")),
        )
        state = checkpointed(
            summed.select(
                "source",
                "source_size",
                "target",
                "repeats",
                (F.col("left") - F.col("before")).alias("left"),
                F.col("bucket").alias("prefix"),
                F.col("n").alias("ties"),
            )
        )
    return state


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``repeats``, ``rest`` and ``taken``.

    ``repeats`` is how often the mix takes the whole row, ``rest`` how many further words it takes of the one row at
    which its source's budget ends (rows equal in key and text share it evenly), ``taken`` = repeats * size + rest.
    NULL text has size 0; NULL is a source of its own; NULL keys are hashed like others. A source without words has
    target 0. Rows without words are repeated like those around them, ``most`` times at most. Repeated rows share a hash and are taken alike. Input columns of the added names are replaced. The hash
    depends on seed, key and text only, so reruns agree. An empty table gives an empty table.
    """
    added = ["size", "source_size", "target", "repeats", "rest", "taken"]
    columns = carried(docs, added)
    measured = docs.select(
        packed(docs, columns).alias("row"),
        own(source).cast("string").alias("source"),
        word_count(own(text)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), own(key), own(text)), 1).alias("hash"),
    )
    slim = stored(measured.select("source", "hash", "size"))
    sizes = checkpointed(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sizes.count()
    targets = source_targets(sizes, weights, most)
    ends = _thresholds(slim, targets, sources)
    limits = targets.select(
        F.col("source").alias("of"), "source_size", "target"
    ).join(
        ends.select(F.col("source").alias("at"), "repeats", "left", F.col("prefix").alias("end"), "ties"),
        F.col("of").eqNullSafe(F.col("at")),
        "left",
    )
    limits = checkpointed(limits.select("of", "source_size", "target", "repeats", "left", "end", "ties"))
    joined = measured.join(broadcast_below(limits, sources), F.col("source").eqNullSafe(F.col("of")))
    size, repeats = F.col("size"), F.coalesce("repeats", F.lit(0))
    whole = repeats + F.when((F.col("hash") < F.col("end")) & (repeats < most), 1).otherwise(0)
    rest = F.when(F.col("hash") == F.col("end"), F.least(size, F.floor(F.col("left") / F.col("ties")))).otherwise(0)
    return joined.select(
        *unpacked(columns),
        size,
        "source_size",
        "target",
        whole.cast("int").alias("repeats"),
        rest.cast("long").alias("rest"),
        (whole * size + rest).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows of the mix: each row as often as it is taken, with all columns of ``docs``.

    The row at which a budget ends is taken once more if at least half of it fits, so texts stay whole.
    """
    read = docs.select(
        packed(docs, docs.columns).alias("document"),
        own(text).alias("text"),
        own(source).alias("source"),
        own(key).alias("doc_id"),
    )
    taken = mix(read, **options)
    once_more = (F.col("rest") > 0) & (F.col("rest") * 2 >= F.col("size"))
    copies = F.col("repeats") + F.when(once_more, 1).otherwise(0)
    repeated = taken.select("document", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("copy"))
    return repeated.select(*unpacked(docs.columns, "document"))
