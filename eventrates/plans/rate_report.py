"""Description, ranking, natural breaks and class tables of area rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from eventrates.functions import fixed_values as fixed
from eventrates.operators.classify import classified_long, top_n_ties
from eventrates.operators.describe import mean_ci
from eventrates.operators.natural_breaks import natural_breaks
from eventrates.session import materialize
from eventrates.sources.writers import write_by_measure


def rate_report(
    rates: DataFrame,
    described: Sequence[str] = ("NStopsBlackPSRatePerStratum", "NStopsWhitePSRatePerStratum"),
    breaks: Mapping[str, Sequence[float]] = fixed.RATE_BREAKS,
    top: int = 10,
    classes: int = 5,
    se_mode: str = "n",
) -> dict[str, DataFrame]:
    """Means with intervals, top areas per described rate, natural breaks, and the class of every rate.

    The rates are stored once, because the break search reads them several times.
    """
    rates = materialize(rates.select("YEAR", "NAME", *dict.fromkeys([*described, *breaks])))
    tables = {
        "means": mean_ci(rates, list(described), se_mode),
        "natural_breaks": natural_breaks(rates, list(breaks), classes),
        "classes": classified_long(rates, breaks),
    }
    for rate in described:
        tables[f"top_{rate}"] = top_n_ties(rates.select("NAME", rate), rate, top)
    return tables


def save_class_tables(rates: DataFrame, path: str, breaks: Mapping[str, Sequence[float]] = fixed.RATE_BREAKS) -> None:
    """One output per measure and year."""
    write_by_measure(classified_long(rates, breaks), path)
