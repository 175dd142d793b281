"""Demographic tables: variables to columns, derived totals and ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrates.functions.columns import safe_ratio

AREA_KEYS = ("YEAR", "GEOID", "NAME")


def name_variables(long: DataFrame, codes: Mapping[str, str], variable: str = "variable") -> DataFrame:
    """Keep the variables of a ``name -> source code`` dictionary and give them their names."""
    wanted = long.where(F.col(variable).isin(list(codes.values())))
    names = F.create_map(*[F.lit(x) for name, code in codes.items() for x in (code, name)])
    return wanted.withColumn(variable, names[F.col(variable)])


def pivot_variables(
    long: DataFrame,
    variables: Sequence[str],
    keys: Sequence[str] = AREA_KEYS,
    variable: str = "variable",
    measures: Mapping[str, str] = {"E": "estimate", "M": "moe"},
) -> DataFrame:
    """Long to wide: one column ``{variable}{suffix}`` per variable and measure.

    The variable list is given, so no extra job looks for it; cells are combined map-side by the aggregation.
    """
    suffixes = dict(measures)
    if len(suffixes) == 1:
        ((suffix, column),) = suffixes.items()
        wide = long.groupBy(*keys).pivot(variable, list(variables)).agg(F.first(column, ignorenulls=True))
        return wide.withColumnsRenamed({v: f"{v}{suffix}" for v in variables})
    aggregates = [F.first(c, ignorenulls=True).alias(s) for s, c in suffixes.items()]
    wide = long.groupBy(*keys).pivot(variable, list(variables)).agg(*aggregates)
    return wide.withColumnsRenamed({f"{v}_{s}": f"{v}{s}" for v in variables for s in suffixes})


def attach_areas(wide: DataFrame, areas: DataFrame, keys: Sequence[str] = ("GEOID",)) -> DataFrame:
    """Join the geometry of each area; only geometry columns are taken from the area table."""
    geometry = [c for c in ("rings", "minx", "miny", "maxx", "maxy") if c in areas.columns]
    return wide.join(areas.select(*keys, *geometry), list(keys), "inner")


def total_of(columns: Sequence[str | Column]) -> Column:
    """Sum of columns; missing if any part is missing."""
    return reduce(lambda a, b: a + b, [F.col(c) if isinstance(c, str) else c for c in columns])


def derive_totals(df: DataFrame, totals: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add sums of columns."""
    return df.withColumns({out: total_of(parts) for out, parts in totals.items()})


def derive_ratios(
    df: DataFrame, ratios: Mapping[str, tuple[Sequence[str], Sequence[str]]], mode: str = "null"
) -> DataFrame:
    """Add ``sum(numerator columns) / sum(denominator columns)`` for every entry."""
    return df.withColumns(
        {out: safe_ratio(total_of(num), total_of(den), mode) for out, (num, den) in ratios.items()}
    )
