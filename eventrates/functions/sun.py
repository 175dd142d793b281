"""Sunrise, sunset and dusk as column arithmetic (the published low-precision solar position series).

All quantities are kept as days since J2000 (2000-01-01 12:00 UTC), where doubles still resolve microseconds.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the solar position series, in degrees unless noted.
J2000_UNIX_DAYS = 10957.5
TRANSIT_OFFSET_DAYS = 0.0009
MEAN_ANOMALY = (357.5291, 0.98560028)
EQUATION_OF_CENTER = (1.9148, 0.02, 0.0003)
PERIHELION = 102.9372
OBLIQUITY = 23.4397
TRANSIT_TERMS = (0.0053, -0.0069)
SUNRISE_ALTITUDE = -0.833
DUSK_ALTITUDE = -6.0


class SunTimes(NamedTuple):
    sunrise: Column
    sunset: Column
    dusk: Column


def _radians(degrees: float) -> Column:
    return F.lit(math.radians(degrees))


def sun_times(day: Column, lat: Column, lon: Column, anchor_hour: float = 12.0) -> SunTimes:
    """UTC instants for a calendar day and position; NULL where the sun does not reach the altitude that day."""
    west = -F.radians(lon)
    phi = F.radians(lat)
    days = F.unix_date(day) + F.lit(anchor_hour / 24.0 - J2000_UNIX_DAYS)
    cycle = F.floor(days - TRANSIT_OFFSET_DAYS - west / F.lit(2 * math.pi) + 0.5)
    mean_transit = F.lit(TRANSIT_OFFSET_DAYS) + west / F.lit(2 * math.pi) + cycle

    anomaly = _radians(MEAN_ANOMALY[0]) + _radians(MEAN_ANOMALY[1]) * mean_transit
    center = sum(
        (_radians(size) * F.sin(F.lit(float(k)) * anomaly) for k, size in enumerate(EQUATION_OF_CENTER, start=1)),
        F.lit(0.0),
    )
    longitude = anomaly + center + _radians(PERIHELION) + F.lit(math.pi)
    declination = F.asin(F.sin(_radians(OBLIQUITY)) * F.sin(longitude))
    wobble = F.lit(TRANSIT_TERMS[0]) * F.sin(anomaly) + F.lit(TRANSIT_TERMS[1]) * F.sin(F.lit(2.0) * longitude)
    noon = mean_transit + wobble

    def setting(altitude: float) -> Column:
        cosine = F.try_divide(
            F.sin(_radians(altitude)) - F.sin(phi) * F.sin(declination), F.cos(phi) * F.cos(declination)
        )
        hour_angle = F.when(F.abs(cosine) <= 1.0, F.acos(cosine))
        return F.lit(TRANSIT_OFFSET_DAYS) + (hour_angle + west) / F.lit(2 * math.pi) + cycle + wobble

    def instant(since_j2000: Column) -> Column:
        return F.timestamp_micros(F.floor((since_j2000 + J2000_UNIX_DAYS) * 86400e6 + 0.5))

    sunset = setting(SUNRISE_ALTITUDE)
    return SunTimes(instant(noon * 2.0 - sunset), instant(sunset), instant(setting(DUSK_ALTITUDE)))
