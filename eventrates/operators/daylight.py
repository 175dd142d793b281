"""Daylight classification of events from their instant and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrates.functions.columns import flag, utc_date, utc_instant
from eventrates.functions.sun import sun_times


def add_sun_times(
    df: DataFrame,
    timestamp: str,
    lat: str,
    lon: str,
    day_mode: str = "utc",
    tz: str | None = None,
    anchor_hour: float = 12.0,
) -> DataFrame:
    """Add ``sunrise``, ``sunset`` and ``dusk`` instants (UTC).

    ``day_mode="utc"`` looks the sun up for the UTC calendar day of the event, ``"local"`` for its calendar day in
    ``tz``. The two differ for evening events whose UTC day has already turned.
    """
    instant = F.col(timestamp)
    if day_mode == "local":
        if tz is None:
            raise ValueError("local days need a tz")
        instant = F.from_utc_timestamp(utc_instant(instant), tz)
    elif day_mode != "utc":
        raise ValueError(f"unknown day mode: {day_mode}")
    times = sun_times(
        utc_date(instant), F.col(lat).cast("double"), F.col(lon).cast("double"), anchor_hour
    )
    return df.withColumns(times._asdict())


def add_veil_flags(df: DataFrame, timestamp: str, before: str = "veilBeforeSunset", after: str = "veilAfterSunset"):
    """Add 1/0 flags from sun times: before = sunrise..sunset, after = from dusk on or up to sunrise.

    Between sunset and dusk both flags are 0.
    """
    instant = utc_instant(F.col(timestamp))
    return df.withColumns(
        {
            before: flag((instant >= F.col("sunrise")) & (instant <= F.col("sunset"))),
            after: flag((instant >= F.col("dusk")) | (instant <= F.col("sunrise"))),
        }
    )
