"""Population rates with own-category, per-capita and period-wide denominators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrates.functions.columns import is_number, safe_ratio
from eventrates.operators.clean import at_least
from eventrates.operators.describe import group_total
from eventrates.session import materialize


@dataclass(frozen=True)
class RateFamily:
    """Rates named ``{prefix}{label}{slice}Rate{suffix}``: counts over a population column.

    ``populations`` gives the population column of each label; ``period_wide`` divides by its sum over all areas of
    the period instead of the area's own value.
    """

    suffix: str
    populations: Mapping[str, str]
    slices: Sequence[str]
    period_wide: bool = False


def standard_rate_families(
    own: Mapping[str, str] = {"Black": "tot_black", "White": "tot_white"}, population: str = "tot_pop"
) -> list[RateFamily]:
    """The 33 rates: own-category (plain, by daylight, by search and daylight), per capita, and city-wide."""
    light = ("", "AS", "BS")
    searches = ("PS", "VS", "PSBS", "VSBS", "PSAS", "VSAS")
    return [
        RateFamily("PerStratum", own, light),
        RateFamily("PerCapita", {"Total": population, **dict.fromkeys(own, population)}, light),
        RateFamily("PerCapitaCity", own, light, period_wide=True),
        RateFamily("PerStratum", own, searches),
    ]


def join_counts(population: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of area populations and event counts; colliding non-key columns get suffixes ``.x`` and ``.y``."""
    shared = (set(population.columns) & set(counts.columns)) - set(keys)
    left = population.withColumnsRenamed({c: f"{c}.x" for c in shared})
    right = counts.withColumnsRenamed({c: f"{c}.y" for c in shared})
    return left.join(right, list(keys), "inner")


def add_rates(
    df: DataFrame,
    families: Sequence[RateFamily],
    period: str,
    mode: str = "null",
    scale: float = 100.0,
    prefix: str = "NStops",
) -> DataFrame:
    """Add every rate of the families, each ``count / population * scale``.

    Period-wide totals sum the areas present in ``df`` (those with events), missing and NaN left out. ``df``, one row
    per area and period, is stored first when there are such totals, so that the events behind it are counted once.
    """
    wide = sorted({c for f in families if f.period_wide for c in f.populations.values()})
    if wide:
        df = group_total(
            materialize(df), [period], {_period_total(c): F.sum(F.when(is_number(c), F.col(c).cast("double"))) for c in wide}
        )
    rates: dict[str, Column] = {}
    for family in families:
        for label, population in family.populations.items():
            for slice_ in family.slices:
                count = f"{prefix}{label}{slice_}"
                below = _period_total(population) if family.period_wide else population
                rates[f"{count}Rate{family.suffix}"] = safe_ratio(count, below, mode) * scale
    return df.withColumns(rates).drop(*[_period_total(c) for c in wide])


def _period_total(column: str) -> str:
    return f"__period_{column}"


def rate_columns(families: Sequence[RateFamily], prefix: str = "NStops") -> list[str]:
    """Names of the columns ``add_rates`` adds, in order."""
    return [
        f"{prefix}{label}{slice_}Rate{f.suffix}" for f in families for label in f.populations for slice_ in f.slices
    ]


def high_rate_areas(df: DataFrame, rate: str, threshold: float = 100.0, keys: Sequence[str] = ("NAME", "YEAR")):
    """Area-periods whose rate is a number at or above the threshold."""
    return at_least(df, rate, threshold).select(*keys)
