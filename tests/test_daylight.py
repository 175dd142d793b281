import datetime as dt

import pytest

from eventrates.operators.daylight import add_sun_times, add_veil_flags

PLACE = (44.98, -93.27)


def flags(spark, when, mode="utc"):
    df = spark.createDataFrame([(when, *PLACE)], "t timestamp, lat double, lon double")
    tz = "America/Chicago" if mode == "local" else None
    row = add_veil_flags(add_sun_times(df, "t", "lat", "lon", mode, tz), "t").first()
    return row["veilBeforeSunset"], row["veilAfterSunset"]


def near(got, want):
    return abs((got - want).total_seconds()) < 180


def test_known_instants(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 10, 31, 22, 0), *PLACE)], "t timestamp, lat double, lon double")
    row = add_sun_times(df, "t", "lat", "lon").first()
    assert near(row["sunrise"], dt.datetime(2016, 10, 31, 12, 52))
    assert near(row["sunset"], dt.datetime(2016, 10, 31, 23, 3))
    assert near(row["dusk"], dt.datetime(2016, 10, 31, 23, 34))


@pytest.mark.parametrize(
    "when, mode, want",
    [
        (dt.datetime(2018, 12, 21, 18, 0), "utc", (1, 0)),
        (dt.datetime(2016, 10, 31, 23, 15), "utc", (0, 0)),
        (dt.datetime(2018, 6, 21, 0, 30), "utc", (0, 1)),
        (dt.datetime(2018, 6, 21, 0, 30), "local", (1, 0)),
        (None, "utc", (None, None)),
    ],
)
def test_flags(spark, when, mode, want):
    assert flags(spark, when, mode) == want


def test_no_sunset_at_high_latitude(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 6, 21, 12, 0), 80.0, 20.0)], "t timestamp, lat double, lon double")
    row = add_veil_flags(add_sun_times(df, "t", "lat", "lon"), "t").first()
    assert row["sunset"] is None and row["veilBeforeSunset"] is None


def test_anchor_moves_the_day(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 10, 31, 22, 0), *PLACE)], "t timestamp, lat double, lon double")
    noon = add_sun_times(df, "t", "lat", "lon").first()["sunset"]
    midnight = add_sun_times(df, "t", "lat", "lon", anchor_hour=0.0).first()["sunset"]
    assert noon.date() - midnight.date() == dt.timedelta(days=1)


def test_bad_modes(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 6, 21), *PLACE)], "t timestamp, lat double, lon double")
    for mode in ("local", "other"):
        with pytest.raises(ValueError):
            add_sun_times(df, "t", "lat", "lon", mode)
