import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from eventrates.functions import columns as c


def one(spark, schema, rows, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_recode_and_fill(spark):
    chain = {"East African": "Black", "Latino": "Latinx", "Native American": "Indigenous"}
    rows = [("East African",), ("Latino",), ("Native American",), ("",), ("Asian",), (None,)]
    got = one(spark, "a string", rows, c.fill_blank(c.recode("a", chain)))
    assert [g[0] for g in got] == ["Black", "Latinx", "Indigenous", "Unknown", "Asian", None]


def test_parse_utc(spark):
    rows = [("2016/10/31 22:52:01+00",), ("2016-1-3 2:03:04",), ("not a date",), ("",), (None,), ("2016/10/31 22:52",)]
    got = [g[0] for g in one(spark, "a string", rows, c.parse_utc(c.strip_text("a", "+00")))]
    assert got == [dt.datetime(2016, 10, 31, 22, 52, 1), dt.datetime(2016, 1, 3, 2, 3, 4), None, None, None, None]


def test_any_flag_truth_table(spark):
    rows = [("YES", None), ("NO", None), ("NO", "NO"), (None, "YES"), ("", "NO")]
    got = one(spark, "a string, b string", rows, c.any_flag(["a", "b"]))
    assert [g[0] for g in got] == ["YES", None, "NO", "YES", "NO"]


def test_clock_window_edges(spark):
    rows = [(dt.datetime(2020, 1, 1, h, m, s),) for h, m, s in [(16, 59, 0), (17, 0, 0), (22, 0, 59), (22, 1, 0)]]
    assert [g[0] for g in one(spark, "t timestamp", rows, c.clock_window_flag("t"))] == [0, 1, 1, 0]
    assert one(spark, "t timestamp", [(None,)], c.clock_window_flag("t")) == [(None,)]
    chicago = one(spark, "t timestamp", [(dt.datetime(2020, 1, 1, 23, 30),)], c.clock_window_flag("t", tz="America/Chicago"))
    assert chicago == [(1,)]


@pytest.mark.parametrize("mode", ["null", "ieee"])
def test_zero_population(spark, mode):
    rows = [(3.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (1.0, 4.0), (None, 2.0), (2.0, None)]
    got = [g[0] for g in one(spark, "a double, b double", rows, c.safe_ratio("a", "b", mode))]
    assert got[3:] == [0.25, None, None]
    if mode == "null":
        assert got[:3] == [None, None, None]
    else:
        assert got[0] == math.inf and math.isnan(got[1]) and got[2] == -math.inf


def test_percent_label_is_half_even(spark):
    rows = [(2.25,), (2.35,), (12.0,), (100.0,), (0.0,), (None,)]
    got = [g[0] for g in one(spark, "a double", rows, c.percent_label("a"))]
    assert got == ["2.2%", "2.4%", "12%", "100%", "0%", None]


def test_cutoff_is_strict(spark):
    rows = [(dt.date(2020, 5, 25),), (dt.date(2020, 5, 26),), (None,)]
    assert [g[0] for g in one(spark, "d date", rows, c.after_date("d", "2020-05-25"))] == [False, True, None]


def test_levels_and_codes(spark):
    rows = [("NO",), ("YES",), ("",), (None,)]
    assert [g[0] for g in one(spark, "a string", rows, c.level_code("a", ["YES", "NO"]))] == [0, 1, None, None]
    assert [g[0] for g in one(spark, "a string", rows, c.with_levels("a", ["YES"]))] == [None, "YES", None, None]


def test_rate_names(spark):
    rows = [("NStopsBlackPSASRatePerStratum",), ("NStopsTotalRatePerCapita",), ("other",)]
    got = one(spark, "m string", rows, c.rate_category("m"), c.rate_slice("m"), c.compose_title("%s in %s", c.rate_category("m"), F.lit("2017")))
    assert got == [("Black", "PSAS", "Black in 2017"), ("Total", "", "Total in 2017"), ("", "", " in 2017")]


def test_logistic_extremes(spark):
    got = [g[0] for g in one(spark, "x double", [(0.0,), (800.0,), (-800.0,)], c.logistic("x"))]
    assert got == [0.5, 1.0, 0.0]


def test_clock_does_not_follow_the_session_zone(spark):
    texts = ["2018-06-21 00:30:00", "2018-03-11 02:30:00", "2018-11-04 01:15:00", "2018-11-04 06:15:00"]
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        df = spark.createDataFrame([(t,) for t in texts], "a string").withColumn("t", c.parse_utc("a"))
        got = df.select(
            F.unix_seconds("t"), c.decimal_hour("t"), c.utc_date(F.col("t")), F.unix_seconds(c.utc_instant(F.to_timestamp_ntz("a")))
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for text, (seconds, hour, day, again) in zip(texts, got):
        when = dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)
        assert seconds == again == when.timestamp()
        assert hour == when.hour + when.minute / 60 and day == when.date()


def test_clock_of_instants_and_readings_agrees(spark):
    texts = ["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "0001-01-01 00:00:00.000001", "2018-06-21 00:30:59.999999", "9999-12-31 23:59:00"]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select(
        F.to_timestamp_ntz("a").alias("r"), F.to_timestamp(F.concat("a", F.lit("Z"))).alias("t")
    )
    shown = [(c.utc_date(F.col(x)), c.utc_minutes(F.col(x)), F.unix_micros(c.utc_instant(F.col(x)))) for x in ("r", "t")]
    for text, row in zip(texts, df.select(*shown[0], *shown[1], F.unix_micros("t")).collect()):
        when = dt.datetime.fromisoformat(text)
        assert row[0] == row[3] == when.date() and row[1] == row[4] == when.hour * 60 + when.minute
        assert row[2] == row[5] == row[6]
