"""Describe, counts, rates, series, classes and demographics on small fixtures."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from eventrates.functions import fixed_values as fixed
from eventrates.operators import clean, counts, describe, rates, series
from eventrates.operators.classify import classified_long, fixed_breaks, top_n_ties
from eventrates.operators.demographics import attach_areas, pivot_variables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exclusions_and_columns(spark):
    df = spark.createDataFrame([(0, "", "x", 1), (1, "a", "T", 2), (2, "a", "x", 3), (3, None, "x", 4)], "i int, n string, p string, FooM int")
    kept = clean.exclude_values(df, {"n": [""], "p": ["T", "C"]})
    assert rows(kept) == [(2, "a", "x", 3)]
    assert clean.drop_first_column(df).columns == ["n", "p", "FooM"]
    assert clean.drop_suffix(df, "m").columns == ["i", "n", "p"]
    assert clean.select_once(df, ["p", "i", "p"]).columns == ["p", "i"]
    years = spark.createDataFrame([(dt.datetime(2016, 5, 1),), (dt.datetime(2017, 5, 1),)], "t timestamp")
    assert clean.exclude_years(years, "t", [2016, 2021]).count() == 1


def test_nan_is_neither_high_nor_top(spark):
    df = spark.createDataFrame([(math.nan,), (150.0,), (20.0,), (None,)], "r double")
    assert rows(clean.at_least(df, "r", 100)) == [(150.0,)]
    assert rows(top_n_ties(df, "r", 1)) == [(150.0,)]


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(5,), (4,), (4,), (3,)], "v int")
    assert sorted(rows(top_n_ties(df, "v", 2)), reverse=True) == [(5,), (4,), (4,)]
    assert top_n_ties(df, "v", 10).count() == 4


def test_break_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 5.0, 10.0, 10.1, -1.0, math.nan, None]], "v double")
    assert [r["class"] for r in fixed_breaks(df, "v", [0, 5, 10]).collect()] == [0, 1, 1, None, None, None, None]


def test_classified_long_names(spark):
    df = spark.createDataFrame([(2017, "A", 7.0, None)], "YEAR int, NAME string, NStopsBlackRatePerStratum double, NStopsWhitePSRatePerStratum double")
    breaks = {k: fixed.RATE_BREAKS[k] for k in df.columns[2:]}
    got = {r["measure"]: r for r in classified_long(df, breaks, title="%s stop rates in %s").collect()}
    assert got["NStopsBlackRatePerStratum"]["class"] == 1
    assert got["NStopsBlackRatePerStratum"]["legend"] == "5 to 10"
    assert got["NStopsWhitePSRatePerStratum"]["class"] is None
    assert got["NStopsWhitePSRatePerStratum"]["title"] == "White stop rates in 2017"


def test_agreement_modes(spark):
    df = spark.createDataFrame([("x", "y"), ("y", "z"), ("y", "y"), ("x", "z")], "a string, b string")
    assert describe.agreement(df, "a", "b").first()[0] == 0.25
    # Positions: x=1, y=2 against y=1, z=2; the pairs (x,y) and (y,z) lie on the diagonal.
    assert describe.agreement(df, "a", "b", "positional").first()[0] == 0.5
    with pytest.raises(ValueError):
        describe.agreement(df, "a", "b", "other")


def test_percent_of_total_counts_missing_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert rows(describe.percent_of_total(df, "k")) == [("a", 2, 50.0), ("b", 1, 25.0)]
    assert rows(describe.frequency(df, "k")) == [("a", 2), ("b", 1)]


def test_crosstab_has_zero_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "y")], "r string, c string")
    assert rows(describe.crosstab(df, "r", "c")) == [("a", 2, 0), ("b", 0, 1)]
    assert describe.crosstab(df, "r", "c", ["y"]).columns == ["r", "y"]


def test_shares_with_missing_keys(spark):
    df = spark.createDataFrame([("YES", "a"), ("YES", "b"), (None, "a"), (None, "a"), ("NO", None)], "s string, k string")
    got = {(r["s"], r["value"]): r["freq"] for r in describe.share_table(df, "s", ["k"]).collect()}
    assert got == {("YES", "a"): 50.0, ("YES", "b"): 50.0, (None, "a"): 100.0, ("NO", None): 100.0}


def test_mean_interval_modes(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,), (math.nan,), (None,)], "v double")
    sd = math.sqrt(7.0)
    by_n = describe.mean_ci(df, ["v"]).first()
    by_root = describe.mean_ci(df, ["v"], "sqrt_n").first()
    assert by_n["n"] == 3 and by_n["mean"] == pytest.approx(3.0)
    assert by_n["upper"] == pytest.approx(3 + 1.96 * sd / 3)
    assert by_root["upper"] == pytest.approx(3 + 1.96 * sd / math.sqrt(3))
    assert rows(describe.column_range(df, ["v"])) == [(1.0, 6.0)]


STOPS = "YEAR int, NAME string, raceRecode string, veilBeforeSunset int, veilAfterSunset int, personSearch string, vehicleSearch string"


def test_count_matrix_cells_and_order(spark):
    df = spark.createDataFrame(
        [
            (2017, "A", "Black", 1, 0, "YES", "NO"),
            (2017, "A", "White", 0, 1, "YES", "YES"),
            (2017, "A", "Black", None, None, "NO", "YES"),
            (2017, "A", None, 1, 0, "YES", "YES"),
        ],
        STOPS,
    )
    slices = counts.search_light_slices()
    wide = counts.count_matrix(df, ["YEAR", "NAME"], "raceRecode", fixed.CATEGORY_LABELS, slices)
    assert len(wide.columns) == 2 + 72
    assert wide.columns[2:10] == [f"NStops{x}" for x in [*fixed.CATEGORY_LABELS, "Total"]]
    row = wide.first()
    assert (row["NStopsBlack"], row["NStopsTotal"], row["NStopsBlackBS"], row["NStopsTotalBS"]) == (2, 4, 1, 2)
    assert (row["NStopsTotalPSBS"], row["NStopsWhiteVSAS"], row["NStopsAsian"]) == (2, 1, 0)
    strict = counts.count_matrix(df, ["YEAR", "NAME"], "raceRecode", fixed.CATEGORY_LABELS, slices, strict_na=True).first()
    assert (strict["NStopsTotal"], strict["NStopsBlack"], strict["NStopsTotalBS"]) == (4, None, None)
    assert strict["NStopsTotalVS"] == 3 and strict["NStopsTotalPSAS"] == 1
    assert rows(counts.category_sum_gap(wide, ["YEAR", "NAME"], list(fixed.CATEGORY_LABELS))) == [(2017, "A", 1)]


def people(spark, data):
    return spark.createDataFrame(data, "YEAR int, NAME string, tot_pop double, tot_black double, tot_white double")


def test_city_denominator_leaves_out_areas_without_events(spark):
    population = people(spark, [(2017, n, p, p, p) for n, p in (("A", 10.0), ("B", 30.0), ("C", 60.0))])
    stops = [(2017, n, "Black", 1, 0, "NO", "NO") for n in "AAB"]
    matrix = counts.count_matrix(spark.createDataFrame(stops, STOPS), ["YEAR", "NAME"], "raceRecode", fixed.CATEGORY_LABELS, counts.search_light_slices())
    out = rates.add_rates(rates.join_counts(population, matrix, ["YEAR", "NAME"]), rates.standard_rate_families(), "YEAR")
    names = rates.rate_columns(rates.standard_rate_families())
    assert len(names) == len(set(names)) == 33
    got = {r["NAME"]: r for r in out.collect()}
    assert set(got) == {"A", "B"}
    assert got["A"]["NStopsBlackRatePerCapitaCity"] == pytest.approx(2 / 40 * 100)
    assert got["A"]["NStopsBlackRatePerStratum"] == pytest.approx(20.0)
    assert rows(rates.high_rate_areas(out, "NStopsBlackRatePerStratum", 20.0)) == [("A", 2017)]


def test_zero_population_rates(spark):
    population = people(spark, [(2017, "A", 0.0, 0.0, math.nan)])
    matrix = spark.createDataFrame([(2017, "A", 3, 0)], "YEAR int, NAME string, NStopsBlack long, NStopsWhite long")
    family = [rates.RateFamily("PerStratum", {"Black": "tot_black"}, ["",]), rates.RateFamily("PerCapitaCity", {"White": "tot_white"}, [""], True)]
    joined = rates.join_counts(population, matrix, ["YEAR", "NAME"])
    nulls = rates.add_rates(joined, family, "YEAR").first()
    assert nulls["NStopsBlackRatePerStratum"] is None and nulls["NStopsWhiteRatePerCapitaCity"] is None
    ieee = rates.add_rates(joined, family, "YEAR", "ieee").first()
    assert ieee["NStopsBlackRatePerStratum"] == math.inf


def test_join_suffixes(spark):
    left = spark.createDataFrame([(2017, "A", 1)], "YEAR int, NAME string, g int")
    right = spark.createDataFrame([(2017, "A", 2), (2017, "B", 3)], "YEAR int, NAME string, g int")
    assert rates.join_counts(left, right, ["YEAR", "NAME"]).columns == ["YEAR", "NAME", "g.x", "g.y"]


def test_area_missing_in_a_period(spark):
    df = spark.createDataFrame([("A", 2017), ("A", 2018), ("C", 2017), ("C", 2017), ("D", 2020)], "NAME string, YEAR int")
    assert rows(counts.missing_in_periods(df, "NAME", "YEAR", [2017, 2018])) == [("C", 2018)]
    assert sorted(rows(counts.in_every_period(df, "NAME", "YEAR", [2017, 2018]))) == [("A", 2017), ("A", 2018), ("D", 2020)]


def days(spark):
    data = [(dt.date(2016, 10, 31), "Black"), (dt.date(2016, 11, 2), "Black"), (dt.date(2016, 11, 9), "White"), (dt.date(2016, 12, 1), "Latinx"), (dt.date(2016, 12, 5), "Black"), (dt.date(2016, 12, 6), "Black")]
    return spark.createDataFrame(data, "date date, raceRecode string")


def test_monthly_series(spark):
    wide = series.monthly_counts(days(spark), "date", "raceRecode", fixed.CATEGORY_LABELS, fixed.PARTIAL_MONTHS)
    got = {r["dateMonthYear"]: r for r in wide.collect()}
    assert list(got) == ["2016-11", "2016-12"] and "NStopsTotal" not in wide.columns
    assert got["2016-12"]["NStopsLatin"] == 1 and got["2016-11"]["NStopsBlackPct"] == 50.0
    long = series.series_long(wide, fixed.CATEGORY_LABELS)
    assert long.columns == ["dateMonthYear", "race", "NStops", "NStopsPct"] and long.count() == 14
    sums = long.groupBy("dateMonthYear").agg(F.round(F.sum("NStopsPct"), 9).alias("s")).collect()
    assert all(r["s"] == 100 for r in sums)
    stack = {(r["dateMonthYear"], r["race"]): (r["top"], r["middle"]) for r in series.stack_layout(long).collect()}
    assert stack[("2016-12", "Latinx")] == (1, 0.5) and stack[("2016-12", "Black")] == (3, 2.0)


@pytest.mark.parametrize(
    "empty, inverse, want",
    [
        (True, False, ["", "b", "", "d", ""]),
        (False, False, ["b", "d"]),
        (True, True, ["a", "", "c", "", "e"]),
        (False, True, ["a", "c", "e"]),
    ],
)
def test_every_nth(spark, empty, inverse, want):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("abcde")], "i int, x string").repartition(3)
    got = series.every_nth(df, "x", 2, ["i"], empty, inverse).orderBy("i").collect()
    assert [r["x"] for r in got] == want


def test_positions_are_dense_over_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"))
    got = series.add_position(df, ["v"]).where(F.col("position") != F.col("v") + 1)
    assert got.count() == 0


def test_marks_do_not_repeat_months(spark):
    months = spark.createDataFrame([("2020-03",), ("2020-04",)], "dateMonthYear string")
    marks = spark.createDataFrame([(dt.date(2020, 3, 13), "b"), (dt.date(2020, 3, 6), "a")], "date date, label string")
    assert rows(series.mark_events(months, marks).orderBy("dateMonthYear")) == [("2020-03", "a\nb"), ("2020-04", None)]


def test_days_since_first(spark):
    got = series.days_since_first(days(spark), "date").orderBy("date").collect()
    assert [r["day"] for r in got] == [0, 2, 9, 31, 35, 36]


def test_pivot_two_measures_and_geometry(spark):
    long = spark.createDataFrame(
        [(2017, "1", "A", "pop", 5.0, 1.0), (2017, "1", "A", "inc", 7.0, 2.0), (2017, "2", "B", "pop", 9.0, 3.0)],
        "YEAR int, GEOID string, NAME string, variable string, estimate double, moe double",
    )
    wide = pivot_variables(long, ["pop", "inc"])
    assert wide.columns[3:] == ["popE", "popM", "incE", "incM"]
    assert sorted(rows(wide)) == [(2017, "1", "A", 5.0, 1.0, 7.0, 2.0), (2017, "2", "B", 9.0, 3.0, None, None)]
    areas = spark.createDataFrame([("1", "other", [[(0.0, 0.0)]])], "GEOID string, NAME string, rings array<array<struct<x:double,y:double>>>")
    joined = attach_areas(wide, areas)
    assert joined.count() == 1 and "rings" in joined.columns and joined.columns.count("NAME") == 1


def test_fixed_value_sizes():
    assert len(fixed.VARIABLE_CODES) == 140
    assert len(set(fixed.VARIABLE_CODES.values())) == 140
    assert len(fixed.DERIVED_TOTALS) + len(fixed.DERIVED_RATIOS) + 2 == 53
    assert len(set(fixed.OUTSIDE_AREAS)) == 16 and len(fixed.RATE_BREAKS) == 19
