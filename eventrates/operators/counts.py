"""Conditional count matrices per area and period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "Total"


def search_light_slices(
    person: str = "personSearch",
    vehicle: str = "vehicleSearch",
    before: str = "veilBeforeSunset",
    after: str = "veilAfterSunset",
    yes: str = "YES",
) -> dict[str, Column | None]:
    """The nine slices of an event table: all, by daylight, by search, and by search and daylight."""
    bs, as_ = F.col(before) == 1, F.col(after) == 1
    ps, vs = F.col(person) == yes, F.col(vehicle) == yes
    return {
        "": None,
        "BS": bs,
        "AS": as_,
        "PS": ps,
        "VS": vs,
        "PSBS": ps & bs,
        "VSBS": vs & bs,
        "PSAS": ps & as_,
        "VSAS": vs & as_,
    }


def count_matrix(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    labels: Mapping[str, str],
    slices: Mapping[str, Column | None] | None = None,
    prefix: str = "NStops",
    strict_na: bool = False,
) -> DataFrame:
    """One column ``{prefix}{label}{slice}`` per category label and slice, plus the ``Total`` of each slice.

    ``labels`` maps the label in the column name to the category value. Rows are first counted by key, category and
    the bit mask of the slices they belong to - one counter per row, combined map-side, so a hot area is spread over
    all tasks - and the matrix is then summed from those few counts.

    A row whose slice condition is missing is not counted; with ``strict_na`` it makes the cell missing, as a plain
    sum over a missing condition would.
    """
    slices = dict(slices) if slices is not None else {"": None}

    def bits(test) -> Column:
        mask = F.lit(0)
        for i, condition in enumerate(slices.values()):
            if condition is not None:
                mask = mask + F.when(test(condition), F.lit(1 << i)).otherwise(F.lit(0))
        return mask.cast("int")

    compact = [F.col(category).alias("__category"), bits(lambda c: c).alias("__in")]
    if strict_na:
        compact.append(bits(lambda c: c.isNull()).alias("__na"))
    counts = (
        df.select(*keys, *compact)
        .groupBy(*keys, *[f for f in ("__category", "__in", "__na") if f != "__na" or strict_na])
        .agg(F.count(F.lit(1)).alias("__n"))
    )

    # Conditions are built once and shared by the cells of a row or column of the matrix.
    always, never, n, zero = F.lit(True), F.lit(False), F.col("__n"), F.lit(0).cast("long")
    of_category = {label: F.col("__category") == value for label, value in labels.items()} | {TOTAL: always}
    no_category = F.col("__category").isNull()

    def bit(mask: str, position: int) -> Column:
        return F.col(mask).bitwiseAND(1 << position) != 0

    cells = []
    for position, (suffix, condition) in enumerate(slices.items()):
        in_slice = always if condition is None else bit("__in", position)
        unsure_slice = bit("__na", position) if strict_na and condition is not None else never
        for label, in_category in of_category.items():
            cell = F.sum(F.when(in_category & in_slice, n).otherwise(zero))
            if strict_na:
                unsure_category = never if label == TOTAL else no_category
                unsure = (unsure_slice & (in_category | unsure_category)) | (unsure_category & in_slice)
                cell = F.when(F.count_if(unsure) == 0, cell)
            cells.append(cell.alias(f"{prefix}{label}{suffix}"))
    return counts.groupBy(*keys).agg(*cells)


def category_sum_gap(matrix: DataFrame, keys: Sequence[str], labels: Sequence[str], prefix: str = "NStops"):
    """Rows where the labelled categories do not add up to the total, which shows label drift."""
    summed = sum((F.col(f"{prefix}{label}") for label in labels), F.lit(0))
    return (
        matrix.select(*keys, (F.col(f"{prefix}{TOTAL}") - summed).alias("uncounted"))
        .where(F.col("uncounted") != 0)
    )


def missing_in_periods(df: DataFrame, area: str, period: str, periods: Sequence) -> DataFrame:
    """Areas that occur in some listed period but not in all, with the periods in which they are absent."""
    expected = sorted(periods)
    seen = (
        df.where(F.col(period).isin(expected))
        .select(area, period)
        .distinct()
        .groupBy(area)
        .agg(*[F.max(F.col(period) == p).alias(f"__{i}") for i, p in enumerate(expected)])
    )
    absent = F.explode(
        F.filter(
            F.array(*[F.when(~F.coalesce(F.col(f"__{i}"), F.lit(False)), F.lit(p)) for i, p in enumerate(expected)]),
            lambda p: p.isNotNull(),
        )
    )
    return seen.select(area, absent.alias(period))


def in_every_period(df: DataFrame, area: str, period: str, periods: Sequence) -> DataFrame:
    """Keep the areas that occur in all listed periods."""
    absent = missing_in_periods(df, area, period, periods).select(area).distinct()
    return df.join(absent, area, "left_anti").select(*df.columns)
