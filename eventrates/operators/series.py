"""Monthly series: counts and shares, long form, stacked layout, label thinning, dated markers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventrates.functions.columns import month_key, safe_ratio
from eventrates.operators.counts import TOTAL, count_matrix
from eventrates.operators.describe import add_position

MONTH = "dateMonthYear"


def monthly_counts(
    df: DataFrame,
    day: str | Column,
    category: str,
    labels: Mapping[str, str],
    drop_months: Sequence[str] = (),
    prefix: str = "NStops",
    month: str = MONTH,
) -> DataFrame:
    """One row per month: a count per category and its percent of all rows of the month.

    ``labels`` maps the label in the column name to the category value. Dropped months are filtered after the
    aggregation, where they are known by key.
    """
    keyed = df.withColumn(month, month_key(day))
    wide = count_matrix(keyed, [month], category, labels, prefix=prefix)
    percents = {
        f"{prefix}{label}Pct": safe_ratio(f"{prefix}{label}", f"{prefix}{TOTAL}") * 100 for label in labels
    }
    wide = wide.withColumns(percents).drop(f"{prefix}{TOTAL}")
    if drop_months:
        wide = wide.where(~F.col(month).isin(list(drop_months)))
    return wide.orderBy(month)


def series_long(
    wide: DataFrame,
    labels: Mapping[str, str],
    prefix: str = "NStops",
    month: str = MONTH,
    category: str = "race",
) -> DataFrame:
    """Long form of the monthly table: counts and percents unfold together, each row carrying its category."""
    parts = [
        F.struct(
            F.lit(value).alias(category),
            F.col(f"{prefix}{label}").alias(prefix),
            F.col(f"{prefix}{label}Pct").alias(f"{prefix}Pct"),
        )
        for label, value in labels.items()
    ]
    return wide.select(month, F.inline(F.array(*parts)))


def stack_layout(
    long: DataFrame, bar: str = MONTH, part: str = "race", height: str = "NStops", descending: bool = True
) -> DataFrame:
    """Cumulative top and label midpoint of each part of a stacked bar.

    The window runs inside one bar, which holds one row per category.
    """
    order = F.col(part).desc() if descending else F.col(part)
    stacked = W.partitionBy(bar).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return long.withColumn("top", F.sum(height).over(stacked)).withColumn(
        "middle", F.col("top") - F.col(height) / 2
    )


def every_nth(
    df: DataFrame, value: str, nth: int, order_by: Sequence[str | Column], empty: bool = True, inverse: bool = False
) -> DataFrame:
    """Thin an ordered sequence of labels.

    By default the first of each ``nth`` labels is blanked; with ``empty=False`` its row is dropped. ``inverse``
    treats all but the first that way.
    """
    placed = add_position(df, order_by, "__position")
    first = (F.col("__position") - 1) % nth == 0
    hit = ~first if inverse else first
    thinned = placed.withColumn(value, F.when(hit, F.lit("")).otherwise(F.col(value))) if empty else placed.where(~hit)
    return thinned.drop("__position")


def mark_events(months: DataFrame, markers: DataFrame, month: str = MONTH, label: str = "label", day: str = "date"):
    """Attach the labels of dated events to their months, joined in date order; other months keep NULL.

    Markers are grouped by month first, so a month row is never repeated.
    """
    dated = F.array_sort(F.collect_list(F.struct(F.to_date(F.col(day)).alias("d"), F.col(label).alias("l"))))
    text = F.array_join(F.transform(dated, lambda m: m["l"]), "\n")
    by_month = markers.groupBy(month_key(day).alias(month)).agg(text.alias(label))
    return months.join(by_month, month, "left")


def days_since_first(df: DataFrame, day: str, out: str = "day") -> DataFrame:
    """Days between each row and the earliest day of the table (a scalar subquery, not a join)."""
    first = df.agg(F.min(F.to_date(F.col(day)))).scalar()
    return df.withColumn(out, F.datediff(F.to_date(F.col(day)), first))
