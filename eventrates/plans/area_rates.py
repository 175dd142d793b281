"""From events, demographics and polygons to per-area, per-period counts and rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrates.functions import fixed_values as fixed
from eventrates.operators.clean import drop_suffix, exclude_listed, exclude_values, select_once
from eventrates.operators.counts import count_matrix, in_every_period, search_light_slices
from eventrates.operators.demographics import attach_areas, derive_ratios, derive_totals
from eventrates.operators.rates import add_rates, high_rate_areas, join_counts, standard_rate_families
from eventrates.operators.spatial import points_in, polygons_touching
from eventrates.session import materialize
from eventrates.sources import writers


def derive_demographics(wide: DataFrame, mode: str = "null") -> DataFrame:
    """The 53 derived totals and ratios of a wide demographic table, margins of error dropped."""
    estimates = drop_suffix(wide, "M")
    totals = derive_totals(estimates, fixed.DERIVED_TOTALS).withColumn(
        "tot_other", F.col("tot_pop") - (F.col("tot_white") + F.col("tot_black"))
    )
    ratios = derive_ratios(totals, fixed.DERIVED_RATIOS, mode).withColumn(
        "pct_other", 1 - (F.col("pct_white") + F.col("pct_black"))
    )
    derived = [*fixed.DERIVED_TOTALS, "tot_other", *fixed.DERIVED_RATIOS, "pct_other"]
    return select_once(ratios, ["GEOID", "NAME", "YEAR", "pop_maleE", "pop_femaleE", *derived])


def areas_in_city(
    demographics: DataFrame, areas: DataFrame, boundary: DataFrame, outside: DataFrame | Sequence = fixed.OUTSIDE_AREAS
) -> DataFrame:
    """Area-periods with geometry that touch the boundary and are not on the deny list."""
    keys = [k for k in ("YEAR", "GEOID") if k in areas.columns]
    touching = polygons_touching(areas, boundary.select("rings"), keys)
    return attach_areas(demographics, exclude_listed(touching, "GEOID", outside), keys)


def area_counts(
    events: DataFrame,
    areas: DataFrame,
    boundary: DataFrame,
    labels: Mapping[str, str] = fixed.CATEGORY_LABELS,
    years: Sequence[int] = (),
) -> DataFrame:
    """Conditional counts per area and year of the events inside the boundary.

    Only the columns the counts need are carried through both spatial joins. Years are filtered on the ``year`` column,
    which prunes folders where the events are stored by year.
    """
    columns = ["year", "lon", "lat", "raceRecode", "veilBeforeSunset", "veilAfterSunset", "personSearch", "vehicleSearch"]
    kept = exclude_values(events, {"year": fixed.EXCLUDED_YEARS}).select(*columns)
    if years:
        kept = kept.where(F.col("year").isin(list(years)))
    inside = points_in(kept, boundary.select("rings"), "lon", "lat", how="semi").withColumnRenamed("year", "YEAR")
    placed = points_in(inside, areas.select("YEAR", "NAME", "rings"), "lon", "lat", keys=["YEAR"])
    return count_matrix(placed, ["YEAR", "NAME"], "raceRecode", labels, search_light_slices())


def area_rates(
    events: DataFrame,
    demographics: DataFrame,
    areas: DataFrame,
    boundary: DataFrame,
    years: Sequence[int],
    outside: DataFrame | Sequence = fixed.OUTSIDE_AREAS,
    labels: Mapping[str, str] = fixed.CATEGORY_LABELS,
    mode: str = "null",
    every_period: bool = False,
) -> DataFrame:
    """Demographics, counts and rates of every area and year, as one table keyed by ``YEAR``.

    ``every_period`` drops areas without events in some of the years. The areas, and the counts if they are to be
    reconciled, are stored once, since the spatial index and the reconciliation read them again.
    """
    city = materialize(areas_in_city(demographics.where(F.col("YEAR").isin(list(years))), areas, boundary, outside))
    counts = area_counts(events, city, boundary, labels, years)
    if every_period:
        counts = in_every_period(materialize(counts), "NAME", "YEAR", years)
    joined = join_counts(city, counts, ["YEAR", "NAME"])
    return add_rates(joined, standard_rate_families(), "YEAR", mode)


def save_area_rates(events: DataFrame, rates: DataFrame, folder: str, rate: str = "NStopsBlackRatePerStratum") -> None:
    """Write the event points, the rate table by year, and the list of very high area-years."""
    writers.write_snapshot(exclude_values(events, {"year": fixed.EXCLUDED_YEARS}), f"{folder}/points")
    writers.write_table(rates, f"{folder}/area_rates", ["YEAR"])
    writers.write_tsv(high_rate_areas(rates, rate), f"{folder}/very_high_areas")
