"""Class binning of rates and top-n selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrates.functions.columns import compose_title, is_number, rate_category


def class_of(column: str | Column, breaks: Sequence[float]) -> Column:
    """Zero-based class in ``[b0,b1), [b1,b2), ..., [bk-1,bk]``; missing outside, for NULL and for NaN."""
    value = F.col(column) if isinstance(column, str) else column
    last = len(breaks) - 2
    inside = None
    for i, (low, high) in enumerate(zip(breaks[:-1], breaks[1:])):
        below = value <= high if i == last else value < high
        hit = (value >= low) & below
        inside = F.when(hit, F.lit(i)) if inside is None else inside.when(hit, F.lit(i))
    return F.when(is_number(value), inside)


def class_label(column: str | Column, breaks: Sequence[float]) -> Column:
    """Legend text of a class index, such as ``5 to 10``."""
    index = F.col(column) if isinstance(column, str) else column
    texts = [f"{low:g} to {high:g}" for low, high in zip(breaks[:-1], breaks[1:])]
    return F.get(F.array(*[F.lit(t) for t in texts]), index)


def fixed_breaks(df: DataFrame, column: str, breaks: Sequence[float], out: str = "class") -> DataFrame:
    """Add the class of a column by fixed break points."""
    return df.withColumn(out, class_of(column, breaks))


def classified_long(
    df: DataFrame,
    breaks: Mapping[str, Sequence[float]],
    keys: Sequence[str] = ("YEAR", "NAME"),
    title: str = "%s rates across areas in %s",
) -> DataFrame:
    """One row per (measure, area, period) with rate, class, legend text and title: the table behind a map series."""
    parts = [
        F.struct(
            F.lit(measure).alias("measure"),
            F.col(measure).cast("double").alias("rate"),
            class_of(measure, cuts).alias("class"),
            class_label(class_of(measure, cuts), cuts).alias("legend"),
        )
        for measure, cuts in breaks.items()
    ]
    long = df.select(*keys, F.inline(F.array(*parts)))
    period = F.col(keys[0]).cast("string")
    return long.withColumn("title", compose_title(title, rate_category("measure"), period))


def top_n_ties(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows holding the ``n`` largest values, all ties of the smallest of them included; missing and NaN left out.

    The threshold comes from per-task top-n lists merged on a single small task; the rows are then filtered by it.
    """
    numbers = df.where(is_number(column))
    largest = numbers.select(column).orderBy(F.col(column).desc()).limit(n)
    return numbers.where(F.col(column) >= largest.agg(F.min(column)).scalar())
