"""Row exclusion and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrates.functions.columns import is_number, utc_date


def drop_first_column(df: DataFrame) -> DataFrame:
    """Drop the leading index column some exports carry."""
    return df.drop(df.columns[0])


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Drop columns whose name ends with ``suffix``, ignoring case."""
    return df.drop(*[c for c in df.columns if c.lower().endswith(suffix.lower())])


def select_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select columns in order; a repeated name is taken once."""
    return df.select(*dict.fromkeys(columns))


def keep_values(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Rows equal to every given value."""
    for column, value in conditions.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def exclude_values(df: DataFrame, exclusions: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose columns hold none of the listed values; a missing value is excluded as well."""
    for column, values in exclusions.items():
        df = df.where(~F.col(column).isin(list(values)))
    return df


def exclude_listed(df: DataFrame, key: str, listed: DataFrame | Sequence) -> DataFrame:
    """Rows whose key is not in a literal list (pushed to the scan) or not in a table (anti join)."""
    if isinstance(listed, DataFrame):
        return df.join(listed.select(key).distinct(), key, "left_anti").select(*df.columns)
    return df.where(~F.col(key).isin(sorted(set(listed))))


def at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows at or above a threshold; missing and NaN are dropped."""
    return df.where(is_number(column) & (F.col(column) >= threshold))


def exclude_years(df: DataFrame, timestamp: str | Column, years: Sequence[int]) -> DataFrame:
    """Rows outside the listed years."""
    value = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return df.where(~F.year(utc_date(value)).isin(list(years)))
