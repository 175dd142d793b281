"""Frequency tables, shares, agreement, outcome rates and column summaries.

Counts are aggregated once; shares and totals are then taken from the counts, so no step regroups raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventrates.functions.columns import is_number, safe_ratio
from eventrates.session import levels_of, materialize


def group_total(df: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Add per-group totals to every row of an already aggregated table.

    An aggregate joined back on the keys: a hot group is combined map-side and never gathered in one task as a
    window would. Missing keys form a group of their own.
    """
    if not keys:
        return df.withColumns({name: df.agg(total).scalar() for name, total in totals.items()})
    renamed = {key: f"__{i}_{key}" for i, key in enumerate(keys)}
    sums = df.groupBy(*[F.col(key).alias(new) for key, new in renamed.items()]).agg(
        *[total.alias(name) for name, total in totals.items()]
    )
    match = [F.col(key).eqNullSafe(F.col(new)) for key, new in renamed.items()]
    return df.join(sums, match, "inner").drop(*renamed.values())


def group_count(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key combination, ordered by the keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).orderBy(*keys)


def frequency(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """One-way table of a column, sorted by level, missing left out."""
    return group_count(df.where(F.col(column).isNotNull()), [column], out)


def percent_of_total(df: DataFrame, column: str, out: str = "pct") -> DataFrame:
    """Percent of all rows by level; rows with a missing level count in the denominator only."""
    # The counts, one row per level, are stored so that levels and total come from one scan of the rows.
    counts = materialize(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    return (
        counts.withColumn(out, F.col("n") / counts.agg(F.sum("n")).scalar() * 100)
        .where(F.col(column).isNotNull())
        .orderBy(column)
    )


def crosstab_long(df: DataFrame, row: str, column: str, out: str = "n") -> DataFrame:
    """Two-way table in long form; pairs with a missing side are left out, empty cells are absent."""
    present = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return group_count(present, [row, column], out)


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence | None = None) -> DataFrame:
    """Two-way table in wide form, one column per level (named by the level), zero for empty cells."""
    counts = crosstab_long(df, row, column)
    if levels is None:
        counts = materialize(counts)
        levels = levels_of(counts, column)
    return counts.groupBy(row).pivot(column, list(levels)).agg(F.sum("n")).fillna(0, [str(v) for v in levels]).orderBy(row)


def add_position(df: DataFrame, order_by: Sequence[str | Column], out: str = "position") -> DataFrame:
    """One-based position of every row in a total order, without gathering the rows in one task.

    Rows are range-partitioned and sorted, then stored once so that partition borders stay put. Only the row count
    of each partition is then needed to turn the place within a partition into a place in the whole.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    place, part = "__place", "__part"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn(place, F.monotonically_increasing_id())).withColumn(
        part, F.shiftright(place, 33)
    )
    sizes = stored.groupBy(part).count()
    before = sizes.select(
        F.col(part).alias("__key"),
        (F.sum("count").over(W.orderBy(part)) - F.col("count")).alias("__before"),
    )
    return (
        stored.join(F.broadcast(before), F.col(part) == F.col("__key"))
        .withColumn(out, F.col("__before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1)
        .drop(place, part, "__key", "__before")
    )


def agreement(
    df: DataFrame,
    a: str,
    b: str,
    mode: str = "label",
    levels: tuple[Sequence[str], Sequence[str]] | None = None,
    out: str = "agreement",
) -> DataFrame:
    """Share of rows on which two columns agree, over all rows.

    ``label`` compares the values. ``positional`` compares the positions of the values in the sorted levels of each
    column, which is the diagonal of their two-way table; it departs from ``label`` when the level sets differ.
    """
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if mode == "label":
        same = F.col(a) == F.col(b)
    elif mode == "positional":
        if levels is None:
            counts = materialize(counts)
        paired = counts.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        for column, given, name in ((a, levels and levels[0], "__pa"), (b, levels and levels[1], "__pb")):
            if given is not None:
                place = F.array_position(F.array(*[F.lit(v) for v in given]), F.col(column))
                counts = counts.withColumn(name, F.when(place > 0, place))
                continue
            # Any number of levels: they are numbered where they are and joined back.
            numbered = add_position(paired.select(F.col(column).alias("__level")).distinct(), ["__level"], name)
            counts = counts.join(numbered, F.col(column) == F.col("__level"), "left").drop("__level")
        same = F.col("__pa") == F.col("__pb")
    else:
        raise ValueError(f"unknown agreement mode: {mode}")
    agreed = F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0))
    return counts.agg(safe_ratio(agreed, F.sum("n")).alias(out))


def outcome_rate(
    df: DataFrame,
    keys: Sequence[str],
    outcome: Column,
    trials: str = "trials",
    hits: str = "hits",
    rate: str = "rate",
) -> DataFrame:
    """Rows, rows with the outcome, and their ratio per group."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(trials), F.count_if(outcome).alias(hits))
        .withColumn(rate, F.col(hits) / F.col(trials))
        .orderBy(*keys)
    )


def melt(df: DataFrame, measures: Sequence[str], ids: Sequence[str] = (), name: str = "variable", value: str = "value"):
    """Wide to long; only the id columns given are carried, so the scan stays narrow.

    Written with ``inline``, whose exchanges can be reused when counts and totals are taken from the same long form.
    """
    parts = [
        F.named_struct(F.lit(name), F.lit(m), F.lit(value), F.col(m).cast("string")) for m in measures
    ]
    return df.select(*ids, F.inline(F.array(*parts)))


def share_table(df: DataFrame, group: str, measures: Sequence[str], count: str = "n", share: str = "freq") -> DataFrame:
    """Counts of (group, variable, value) and their percent within (group, variable)."""
    counts = melt(df, measures, [group]).groupBy(group, "variable", "value").agg(F.count(F.lit(1)).alias(count))
    return share_within(counts, [group, "variable"], count, share).orderBy(group, "variable", "value")


def share_within(counts: DataFrame, keys: Sequence[str], count: str = "n", share: str = "freq") -> DataFrame:
    """Percent of a count within its key group."""
    total = "__total"
    return (
        group_total(counts, keys, {total: F.sum(count)})
        .withColumn(share, F.col(count) / F.col(total) * 100)
        .drop(total)
    )


def fill_share(counts: DataFrame, bar: str | Sequence[str], count: str = "n", share: str = "share") -> DataFrame:
    """Height of each part of a bar scaled to 1; several columns may name a bar."""
    return share_within(counts, [bar] if isinstance(bar, str) else list(bar), count, share).withColumn(share, F.col(share) / 100)


def column_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each column as ``min_x, max_x``; NaN is ignored."""
    pairs = []
    for c in columns:
        value = F.when(is_number(c), F.col(c))
        pairs += [F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}")]
    return df.agg(*pairs)


def mean_ci(df: DataFrame, columns: Sequence[str], se_mode: str = "n", z: float = 1.96) -> DataFrame:
    """Mean, sample deviation and interval of each column, one row per measure, in one pass.

    ``se_mode="n"`` divides the deviation by the row count, ``"sqrt_n"`` by its square root. NaN is ignored.
    """
    if se_mode not in ("n", "sqrt_n"):
        raise ValueError(f"unknown se_mode: {se_mode}")
    stats = []
    for c in columns:
        value = F.when(is_number(c), F.col(c).cast("double"))
        stats.append(
            F.struct(
                F.lit(c).alias("measure"),
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("sd"),
            )
        )
    rows = df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))
    divisor = F.col("n") if se_mode == "n" else F.sqrt("n")
    half = F.lit(z) * safe_ratio("sd", divisor)
    return rows.withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half})
