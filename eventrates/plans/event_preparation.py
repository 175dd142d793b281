"""From raw event rows to cleaned, classified events and their descriptive tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrates.functions import fixed_values as fixed
from eventrates.functions.columns import (
    any_flag,
    clock_window_flag,
    decimal_hour,
    fill_blank,
    parse_utc,
    recode,
    strip_text,
    utc_date,
)
from eventrates.operators.clean import exclude_values, keep_values
from eventrates.operators.daylight import add_sun_times, add_veil_flags
from eventrates.operators.describe import agreement, outcome_rate, percent_of_total, share_table


def clean_events(
    raw: DataFrame,
    excluded_problems: Sequence[str] = tuple(fixed.EXCLUDED_PROBLEMS),
    category_recode: Mapping[str, str] = fixed.CATEGORY_RECODE,
    day_mode: str = "utc",
    tz: str | None = None,
) -> DataFrame:
    """Cleaned events: rows without an area or with an excluded problem dropped, categories recoded, time parsed,
    search, daylight and clock-window flags added. Row-wise throughout: one scan, no shuffle.
    """
    kept = exclude_values(raw, {"neighborhood": [""], "problem": list(excluded_problems)})
    coded = kept.withColumns(
        {
            "preRaceRecode": fill_blank(recode("preRace", category_recode)),
            "raceRecode": fill_blank(recode("race", category_recode)),
            "responseDate": strip_text("responseDate", "+00"),
        }
    )
    timed = coded.withColumn("dateFull", parse_utc("responseDate")).withColumns(
        {
            "date": utc_date(F.col("dateFull")),
            "anySearch": any_flag(["personSearch", "vehicleSearch"]),
            "lon": F.col("long"),
        }
    )
    lit = add_veil_flags(add_sun_times(timed, "dateFull", "lat", "lon", day_mode, tz), "dateFull")
    return lit.drop("sunrise", "sunset", "dusk").withColumns(
        {
            "hm": decimal_hour("dateFull"),
            "interTwilight": clock_window_flag("dateFull", 17.0, 22.0),
            "year": F.year("date"),
        }
    )


def search_outcomes(raw: DataFrame, search: str = "vehicleSearch", category: str = "race", outcome: str = fixed.BOOKED):
    """Searches, arrests and arrest rate per category among searched events."""
    return outcome_rate(
        keep_values(raw, {search: "YES"}),
        [category],
        F.col("callDisposition") == outcome,
        "total_searches_race",
        "total_arrests_race",
        "arrest_search_rate_race",
    )


def category_agreement(events: DataFrame, mode: str = "label") -> DataFrame:
    """Agreement of the category before and at the event, among rows with a known category."""
    known = exclude_values(events, {"race": ["", "Unknown"], "preRace": ["Unknown"]})
    return agreement(known, "preRace", "race", mode)


def category_percent(events: DataFrame) -> DataFrame:
    """Percent of all events by recoded category."""
    return percent_of_total(events, "raceRecode")


def search_share_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Counts and shares of categories by person search and by vehicle search."""
    measures = ["preRaceRecode", "raceRecode", "problem", "gender"]
    return {search: share_table(events, search, measures) for search in ("personSearch", "vehicleSearch")}
