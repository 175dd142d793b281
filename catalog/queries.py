"""One query per operator, each over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.standins import (
    areas,
    boundary,
    demographics_long,
    nation_orders,
    nation_people,
    raw_events,
    table,
)
from eventrates.functions import columns as c
from eventrates.functions import fixed_values as fixed
from eventrates.operators import clean, counts, daylight, demographics, describe, rates, series, spatial
from eventrates.operators.classify import classified_long, fixed_breaks, top_n_ties
from eventrates.operators.demographics import derive_ratios, derive_totals, name_variables
from eventrates.operators.design import BinaryModel, design_matrix
from eventrates.operators.natural_breaks import natural_breaks
from eventrates.operators.regression import (
    cluster_correlation,
    coefficients,
    contrast_odds_ratios,
    covariances,
    fit_glm,
    odds_ratios,
    one_step_gee,
    period_pairs,
    predict,
)
from eventrates.plans import area_rates as area_plan
from eventrates.plans import event_preparation as prep
from eventrates.plans import search_models
from eventrates.session import shared_folder
from eventrates.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PRIORITIES = {
    "Urgent": "1-URGENT",
    "High": "2-HIGH",
    "Medium": "3-MEDIUM",
    "Unspec": "4-NOT SPECIFIED",
    "Low": "5-LOW",
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def local(df: DataFrame, *names: str) -> DataFrame:
    """Instants as UTC wall-clock timestamps without zone."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


# Cleaning and recoding


@query
def clean_events(spark, sf_dir):
    events = prep.clean_events(raw_events(spark, sf_dir))
    return rounded(
        local(events, "dateFull").select(
            "event_id", "neighborhood", "preRaceRecode", "raceRecode", "responseDate", "dateFull", "date", "anySearch",
            "lon", "veilBeforeSunset", "veilAfterSunset", "hm", "interTwilight", "year",
        )
    )


@query
def recode_fill(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    raw = events.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("note"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00")).alias("text"),
    )
    kept = clean.exclude_values(raw, {"kind": ["error"]})
    coded = kept.withColumns(
        {
            "kind": c.fill_blank(c.recode("kind", {"click": "tap", "view": "look"})),
            "note": c.fill_missing("note"),
            "at": c.parse_utc(c.strip_text("text", "+00")),
        }
    )
    return local(coded, "at").drop("text")


@query
def any_flag_clock_window(spark, sf_dir):
    events = raw_events(spark, sf_dir)
    timed = events.withColumn("at", c.parse_utc(c.strip_text("responseDate", "+00")))
    return timed.select(
        "event_id",
        c.any_flag(["personSearch", "vehicleSearch"]).alias("anySearch"),
        F.round(c.decimal_hour("at"), 6).alias("hm"),
        c.clock_window_flag("at").alias("utcWindow"),
        c.clock_window_flag("at", tz="America/Chicago").alias("localWindow"),
        c.month_key("at").alias("month"),
        c.level_code("personSearch", ["NO", "YES"]).alias("code"),
        c.with_levels("gender", ["Male", "Female"]).alias("gender"),
        c.after_date("at", "2018-05-25").alias("after"),
    )


@query
def exclude_listed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    listed = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("user_id"))
    by_table = clean.exclude_listed(events, "user_id", listed)
    by_list = clean.exclude_listed(by_table, "user_id", [3, 5, 8, 8, 13])
    wide = clean.keep_values(by_list, {"event_type": "click"})
    return clean.drop_suffix(clean.drop_first_column(wide), "S").select("user_id", "event_type", "value")


@query
def safe_ratios(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") % 3 - 1).alias("a"), (F.col("p_partkey") % 4 - 1).alias("b")
    )
    ieee = c.safe_ratio("a", "b", "ieee")
    return parts.select(
        "p_partkey",
        F.round(c.safe_ratio("a", "b"), 6).alias("nulls"),
        F.isnan(ieee).alias("is_nan"),
        (ieee == float("inf")).alias("is_inf"),
        (ieee == float("-inf")).alias("is_minus_inf"),
        c.percent_label(F.col("p_partkey") / 8.0).alias("label"),
    )


# Description


@query
def hit_rate(spark, sf_dir):
    lines = clean.keep_values(table(spark, sf_dir, "lineitem"), {"l_linestatus": "F"})
    return rounded(describe.outcome_rate(lines, ["l_returnflag"], F.col("l_discount") >= 0.05))


@query
def search_outcomes(spark, sf_dir):
    return rounded(prep.search_outcomes(raw_events(spark, sf_dir)))


@query
def frequency(spark, sf_dir):
    return describe.frequency(table(spark, sf_dir, "orders"), "o_orderstatus")


@query
def percent_of_total(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "status", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus"))
    )
    return rounded(describe.percent_of_total(orders, "status"))


@query
def crosstab(spark, sf_dir):
    return describe.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query
def crosstab_long(spark, sf_dir):
    return describe.crosstab_long(raw_events(spark, sf_dir), "problem", "reason")


def _known(spark, sf_dir):
    return clean.exclude_values(raw_events(spark, sf_dir), {"race": ["", "Unknown"], "preRace": ["Unknown", "Other"]})


@query
def agreement_label(spark, sf_dir):
    mixed = _known(spark, sf_dir).withColumn(
        "preRace", F.when(F.col("event_id") % 5 == 0, "Asian").otherwise(F.col("preRace"))
    )
    return rounded(describe.agreement(mixed, "preRace", "race"))


@query
def agreement_positional(spark, sf_dir):
    return rounded(describe.agreement(_known(spark, sf_dir), "preRace", "race", "positional"))


@query
def category_percent(spark, sf_dir):
    return rounded(prep.category_percent(prep.clean_events(raw_events(spark, sf_dir))))


@query
def melt_share(spark, sf_dir):
    return rounded(describe.share_table(raw_events(spark, sf_dir), "personSearch", ["race", "problem", "gender", "reason"]))


@query
def fill_share(spark, sf_dir):
    searched = clean.exclude_values(raw_events(spark, sf_dir), {"personSearch": [""]})
    long = describe.melt(searched, ["race", "problem", "gender", "reason"], ["personSearch"])
    bars = describe.group_count(long, ["personSearch", "variable", "value"])
    return rounded(describe.fill_share(bars, ["variable", "value"]))


@query
def column_range(spark, sf_dir):
    return describe.column_range(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount", "l_quantity"])


@query
def mean_ci(spark, sf_dir):
    return rounded(describe.mean_ci(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount", "l_tax"]))


@query
def mean_ci_sqrt_n(spark, sf_dir):
    return rounded(describe.mean_ci(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "sqrt_n"))


# Monthly series


def _monthly(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return series.monthly_counts(orders, "o_orderdate", "o_orderpriority", PRIORITIES, ["1995-01"])


@query
def monthly_counts(spark, sf_dir):
    return rounded(_monthly(spark, sf_dir))


@query
def monthly_long(spark, sf_dir):
    return rounded(series.series_long(_monthly(spark, sf_dir), PRIORITIES))


@query
def stack_layout(spark, sf_dir):
    long = series.series_long(_monthly(spark, sf_dir), PRIORITIES)
    return rounded(series.stack_layout(long).withColumn("label", c.percent_label("NStopsPct")).drop("NStopsPct"))


def _every_nth(empty: bool, inverse: bool) -> Query:
    def run(spark, sf_dir):
        months = _monthly(spark, sf_dir).select("dateMonthYear", F.col("dateMonthYear").alias("label"))
        return series.every_nth(months, "label", 3, ["dateMonthYear"], empty, inverse)

    return run


QUERIES["every_nth_blank_first"] = _every_nth(True, False)
QUERIES["every_nth_drop_first"] = _every_nth(False, False)
QUERIES["every_nth_blank_rest"] = _every_nth(True, True)
QUERIES["every_nth_keep_first"] = _every_nth(False, True)


@query
def add_position(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return series.add_position(orders, [F.col("o_totalprice").desc(), "o_orderkey"])


@query
def mark_events(spark, sf_dir):
    largest = top_n_ties(table(spark, sf_dir, "orders"), "o_totalprice", 40)
    markers = largest.select(
        F.to_date("o_orderdate").alias("date"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("label")
    )
    return series.mark_events(_monthly(spark, sf_dir).select("dateMonthYear"), markers)


@query
def days_since_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return series.days_since_first(orders, "o_orderdate").drop("o_orderdate")


# Demographics


def _quantities(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.year("l_shipdate").alias("YEAR"), F.col("l_suppkey").alias("GEOID"), F.col("l_returnflag").alias("variable"))
        .agg(F.sum("l_quantity").alias("estimate"), F.max("l_quantity").alias("moe"))
    )


FLAG_NAMES = {"added": "A", "none": "N", "returned": "R"}


@query
def pivot_variables(spark, sf_dir):
    return _wide_quantities(spark, sf_dir)


def _wide_quantities(spark, sf_dir):
    named = name_variables(_quantities(spark, sf_dir), FLAG_NAMES)
    return demographics.pivot_variables(named, list(FLAG_NAMES), ["YEAR", "GEOID"])


@query
def derive_ratios_totals(spark, sf_dir):
    wide = clean.drop_suffix(_wide_quantities(spark, sf_dir), "M")
    totals = derive_totals(wide, {"tot_all": ["addedE", "noneE", "returnedE"]})
    shares = {"pct_added": (["addedE"], ["tot_all"]), "pct_back": (["addedE", "returnedE"], ["tot_all"])}
    return rounded(derive_ratios(totals, shares))


@query
def demographic_ratios(spark, sf_dir):
    long = name_variables(demographics_long(spark, sf_dir), fixed.VARIABLE_CODES)
    return rounded(area_plan.derive_demographics(demographics.pivot_variables(long, list(fixed.VARIABLE_CODES))))


# Counts and rates

ORDER_LABELS = {"Black": "1-URGENT", "White": "5-LOW"}


def _stop_slices():
    return counts.search_light_slices(before="bs", after="as_")


def _lit_events(spark, sf_dir):
    """Events with morning and evening flags; both are missing for every 23rd event."""
    events = raw_events(spark, sf_dir).withColumn("at", c.parse_utc(c.strip_text("responseDate", "+00")))
    known = F.col("event_id") % 23 != 0
    return events.withColumns(
        {"bs": F.when(known, c.flag(F.hour("at") < 9)), "as_": F.when(known, c.flag(F.hour("at") >= 15))}
    )


@query
def count_matrix(spark, sf_dir):
    return counts.count_matrix(
        _lit_events(spark, sf_dir), ["neighborhood"], "race",
        {"Black": "Black", "White": "White", "Latin": "Latino", "NatAm": "Native American"}, _stop_slices(),
    )


@query
def count_matrix_strict(spark, sf_dir):
    return counts.count_matrix(
        _lit_events(spark, sf_dir), ["reason", "gender"], "race", {"Black": "Black"}, _stop_slices(), strict_na=True
    )


@query
def category_sum_gap(spark, sf_dir):
    labels = {"Black": "Black", "White": "White"}
    matrix = counts.count_matrix(raw_events(spark, sf_dir), ["problem"], "race", labels)
    return counts.category_sum_gap(matrix, ["problem"], list(labels))


def _order_rates(spark, sf_dir):
    """Rates per nation and year: dear orders stand for searches before sunset, cheap ones for those after."""
    orders = nation_orders(spark, sf_dir).withColumns(
        {
            "personSearch": F.when(F.col("price") > 300_000, "YES").otherwise("NO"),
            "vehicleSearch": F.when(F.col("price") < 200_000, "YES").otherwise("NO"),
            "bs": c.flag(F.col("price") > 250_000),
            "as_": c.flag(F.col("price") < 100_000),
        }
    )
    matrix = counts.count_matrix(orders, ["YEAR", "NAME"], "category", ORDER_LABELS, _stop_slices())
    joined = rates.join_counts(nation_people(spark, sf_dir), matrix, ["YEAR", "NAME"])
    return rates.add_rates(joined, rates.standard_rate_families(), "YEAR")


@query
def area_rates(spark, sf_dir):
    names = rates.rate_columns(rates.standard_rate_families())
    return rounded(_order_rates(spark, sf_dir).select("YEAR", "NAME", *names))


@query
def high_rate_areas(spark, sf_dir):
    return rates.high_rate_areas(_order_rates(spark, sf_dir), "NStopsBlackRatePerStratum", 150.0)


def _user_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"))


@query
def missing_in_periods(spark, sf_dir):
    return counts.missing_in_periods(_user_days(spark, sf_dir), "user_id", "day", list(range(1, 31)))


@query
def in_every_period(spark, sf_dir):
    halves = table(spark, sf_dir, "events").select(
        "user_id", F.floor((F.dayofmonth("ts") - 1) / 3).cast("int").alias("part"), "value"
    )
    return counts.in_every_period(halves, "user_id", "part", list(range(10))).select("user_id", "part", "value")


@query
def pooled_years(spark, sf_dir):
    rated = _order_rates(spark, sf_dir).select("YEAR", "NAME", "NStopsTotal")
    return reduce(lambda a, b: a.unionByName(b), [rated.where(F.col("YEAR") == y) for y in range(1995, 2002)])


# Classes and ranking


@query
def top_n_ties_customers(spark, sf_dir):
    return top_n_ties(table(spark, sf_dir, "customer"), "c_acctbal", 10).select("c_name", "c_acctbal")


@query
def top_n_ties_quantity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "score", F.when(F.col("l_quantity") == 50, float("nan")).otherwise(F.col("l_quantity"))
    )
    return top_n_ties(lines, "score", 10).select("l_orderkey", "l_linenumber", "l_partkey", "score")


@query
def fixed_breaks_parts(spark, sf_dir):
    return fixed_breaks(table(spark, sf_dir, "part"), "p_retailprice", [910, 920, 950, 990]).select(
        "p_partkey", "p_retailprice", "class"
    )


@query
def class_tables(spark, sf_dir):
    return rounded(classified_long(_order_rates(spark, sf_dir), fixed.RATE_BREAKS))


@query
def class_tables_own_scale(spark, sf_dir):
    return rounded(classified_long(_order_rates(spark, sf_dir), fixed.OWN_SCALE_BREAKS))


@query
def natural_breaks_price(spark, sf_dir):
    return natural_breaks(table(spark, sf_dir, "part"), ["p_retailprice"], 5)


@query
def natural_breaks_balance(spark, sf_dir):
    return natural_breaks(table(spark, sf_dir, "supplier"), ["s_acctbal"], 6)


@query
def natural_breaks_quantity(spark, sf_dir):
    return natural_breaks(table(spark, sf_dir, "lineitem"), ["l_quantity"], 5)


@query
def natural_breaks_lines(spark, sf_dir):
    return natural_breaks(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], {"l_extendedprice": 5, "l_quantity": 4})


# Daylight


def _timed(spark, sf_dir):
    events = raw_events(spark, sf_dir)
    return events.select("event_id", "lat", "long", c.parse_utc(c.strip_text("responseDate", "+00")).alias("at"))


def _second(name: str):
    return F.date_trunc("second", F.col(name) + F.expr("INTERVAL 0.5 SECOND")).alias(name)


@query
def sun_times(spark, sf_dir):
    lit = daylight.add_sun_times(_timed(spark, sf_dir), "at", "lat", "long")
    seconds = lit.select("event_id", *[_second(n) for n in ("sunrise", "sunset", "dusk")])
    return local(seconds, "sunrise", "sunset", "dusk")


@query
def sun_times_local(spark, sf_dir):
    lit = daylight.add_sun_times(_timed(spark, sf_dir), "at", "lat", "long", "local", "America/Chicago")
    seconds = lit.select("event_id", *[_second(n) for n in ("sunrise", "sunset", "dusk")])
    return local(seconds, "sunrise", "sunset", "dusk")


@query
def veil_flags(spark, sf_dir):
    lit = daylight.add_sun_times(_timed(spark, sf_dir), "at", "lat", "long")
    return daylight.add_veil_flags(lit, "at").select("event_id", "veilBeforeSunset", "veilAfterSunset")


@query
def veil_flags_local(spark, sf_dir):
    lit = daylight.add_sun_times(_timed(spark, sf_dir), "at", "lat", "long", "local", "America/Chicago")
    return daylight.add_veil_flags(lit, "at").select("event_id", "veilBeforeSunset", "veilAfterSunset")


# Spatial joins


def _points(spark, sf_dir):
    return raw_events(spark, sf_dir).select("event_id", "lat", "long", F.lit(2018).alias("YEAR"))


@query
def points_semi(spark, sf_dir):
    return spatial.points_in(_points(spark, sf_dir), boundary(spark, sf_dir), "long", "lat", "semi").select("event_id")


@query
def points_inner(spark, sf_dir):
    placed = spatial.points_in(_points(spark, sf_dir), areas(spark, sf_dir), "long", "lat", keys=["YEAR"])
    return placed.select("event_id", "YEAR", "GEOID", "NAME")


@query
def points_inner_shuffled(spark, sf_dir):
    placed = spatial.points_in(
        _points(spark, sf_dir), areas(spark, sf_dir), "long", "lat", keys=["YEAR"], cell=0.02, broadcast_limit=0
    )
    return placed.select("event_id", "YEAR", "GEOID", "NAME")


@query
def polygons_touching(spark, sf_dir):
    return spatial.polygons_touching(areas(spark, sf_dir), boundary(spark, sf_dir)).select("YEAR", "GEOID", "NAME")


@query
def gather_points(spark, sf_dir):
    placed = spatial.points_in(_points(spark, sf_dir), areas(spark, sf_dir), "long", "lat", keys=["YEAR"])
    return spatial.gather_points(placed, ["YEAR", "NAME"], "long", "lat").select("YEAR", "NAME", "points.x", "points.y", "n")


@query
def area_rate_pipeline(spark, sf_dir):
    events = prep.clean_events(raw_events(spark, sf_dir))
    long = name_variables(demographics_long(spark, sf_dir), fixed.VARIABLE_CODES)
    people = area_plan.derive_demographics(demographics.pivot_variables(long, list(fixed.VARIABLE_CODES)))
    outside = ["27053000007", "27053000012"]
    result = area_plan.area_rates(
        events, people, areas(spark, sf_dir), boundary(spark, sf_dir), [2017, 2018, 2019], outside
    )
    names = rates.rate_columns(rates.standard_rate_families())
    return rounded(result.select("YEAR", "GEOID", "NAME", "tot_pop", "NStopsTotal", "NStopsLatinVS", *names))


# Regression


def _trial(spark, sf_dir):
    """Events as binary trials: a large value is a success, users are clusters."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("cluster"),
        (F.col("value") >= 40).cast("int").alias("y"),
        F.col("event_type").alias("kind"),
        (F.to_date("ts") > F.lit("2024-01-12").cast("date")).alias("post"),
        (F.hour("ts") >= 12).alias("late"),
        (F.dayofmonth("ts") / 10.0).alias("day"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("k"),
        F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("ward"),
    )


KINDS = ["click", "error", "purchase", "signup", "view"]
SATURATED = BinaryModel("y", ["kind", "post"], {"kind": KINDS}, "post", ["kind"])
ADJUSTED = BinaryModel("y", ["kind", "ward", "day", "k", "post"], {"kind": KINDS, "ward": None}, "post", ["kind"])
TWO_TERMS = BinaryModel("y", ["late"])


@query
def design_columns(spark, sf_dir):
    spec = BinaryModel(
        "y", ["kind", "k", "post"], {"kind": KINDS}, "post", ["kind", "k"], category="kind", category_interactions=["k"]
    )
    wide = design_matrix(_trial(spark, sf_dir), spec, "cluster", keep=["event_id"])
    return wide.toDF("event_id", "cluster", "y", *[f"x{i}" for i in range(len(wide.columns) - 3)])


@query
def gee_rho(spark, sf_dir):
    return rounded(cluster_correlation(_trial(spark, sf_dir), SATURATED, "cluster"), 8)


@query
def glm_means(spark, sf_dir):
    trial = _trial(spark, sf_dir)
    terms, beta = fit_glm(trial, SATURATED, "cluster")
    return rounded(predict(trial, SATURATED, terms, beta).groupBy("kind", "post").agg(F.avg("mean").alias("mean")))


@query
def gee_two_terms(spark, sf_dir):
    fit = one_step_gee(_trial(spark, sf_dir), TWO_TERMS, "cluster")
    return rounded(coefficients(spark, fit), 8)


@query
def gee_fit(spark, sf_dir):
    return rounded(coefficients(spark, one_step_gee(_trial(spark, sf_dir), SATURATED, "cluster")))


@query
def gee_covariance(spark, sf_dir):
    return rounded(covariances(spark, one_step_gee(_trial(spark, sf_dir), SATURATED, "cluster")), 8)


@query
def gee_odds(spark, sf_dir):
    return rounded(odds_ratios(spark, one_step_gee(_trial(spark, sf_dir), SATURATED, "cluster")))


@query
def gee_post_odds(spark, sf_dir):
    fit = one_step_gee(_trial(spark, sf_dir), SATURATED, "cluster")
    return rounded(contrast_odds_ratios(spark, fit, period_pairs(fit, SATURATED, "kind")))


@query
def gee_adjusted(spark, sf_dir):
    return rounded(coefficients(spark, one_step_gee(_trial(spark, sf_dir), ADJUSTED, "cluster")))


@query
def gee_dependent(spark, sf_dir):
    """Terms that earlier ones make up have no estimate: a twin of the ward, and a sum of two numbers."""
    trial = _trial(spark, sf_dir).withColumn("twin", F.col("ward")).withColumn("both", F.col("k") * 2 - F.col("day"))
    spec = BinaryModel("y", ["kind", "ward", "twin", "day", "k", "both", "post"], {"kind": KINDS, "ward": None, "twin": None}, "post", ["kind"])
    return rounded(coefficients(spark, one_step_gee(trial, spec, "cluster")))


@query
def glm_separated(spark, sf_dir):
    """A cell without a success and one without a failure: means are those of the cells, whatever the estimates."""
    y = F.when(F.col("post") & (F.col("kind") == "error"), 0).when(~F.col("post") & (F.col("kind") == "view"), 1).otherwise(F.col("y"))
    trial = _trial(spark, sf_dir).withColumn("y", y)
    terms, beta = fit_glm(trial, SATURATED, "cluster")
    means = predict(trial, SATURATED, terms, beta).groupBy("kind", "post").agg(F.avg("mean").alias("mean"))
    return rounded(means, 5)


@query
def gee_battery(spark, sf_dir):
    """The four standard models from two sets of passes: both outcomes, plain and adjusted.

    One event in 29 has its outcomes turned round, as the made-up categories tell some outcomes without error.
    """
    events = prep.clean_events(raw_events(spark, sf_dir))
    for c in ("personSearch", "vehicleSearch"):
        other = F.when(F.col(c) == "YES", "NO").when(F.col(c) == "NO", "YES").otherwise(F.col(c))
        events = events.withColumn(c, F.when(F.col("event_id") % 29 == 3, other).otherwise(F.col(c)))
    results = search_models.search_battery(events, "2018-06-15")
    parts = [r.period_odds.withColumn("model", F.lit(name)) for name, r in results.items()]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), 4)


# Sources and sinks


def _scratch(spark: SparkSession) -> str:
    """A new folder under the shared folder of the session."""
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, sf_dir):
    path = _scratch(spark)
    events = raw_events(spark, sf_dir)
    writers.write_csv(events, path)
    return readers.read_csv(spark, path, events.columns, ["event_id", "lat", "long"])


@query
def tsv_round_trip(spark, sf_dir):
    path = _scratch(spark)
    high = rates.high_rate_areas(_order_rates(spark, sf_dir), "NStopsBlackRatePerStratum", 150.0)
    writers.write_tsv(high, path)
    schema = "NAME string, YEAR int"
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


@query
def year_layers_round_trip(spark, sf_dir):
    path = _scratch(spark)
    writers.write_table(_order_rates(spark, sf_dir).select("YEAR", "NAME", "NStopsTotal"), path)
    return readers.read_areas(spark, path).select("YEAR", "NAME", "NStopsTotal")


@query
def layer_replaced(spark, sf_dir):
    """Layers of three years, of which one is written again from other rows: the other two stay."""
    path = _scratch(spark)
    layers = _order_rates(spark, sf_dir).select("YEAR", "NAME", "NStopsTotal")
    writers.write_table(layers, path)
    writers.write_table(layers.where("YEAR = 1994").withColumn("NStopsTotal", F.col("NStopsTotal") + 1000), path)
    return readers.read_areas(spark, path).select("YEAR", "NAME", "NStopsTotal")


@query
def measure_outputs_round_trip(spark, sf_dir):
    path = _scratch(spark)
    writers.write_by_measure(classified_long(_order_rates(spark, sf_dir), fixed.RATE_BREAKS), path)
    return rounded(spark.read.parquet(path))


@query
def agreement_many_levels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    return rounded(describe.agreement(lines, "l_partkey", "l_orderkey", "positional"), 8)


@query
def demographics_round_trip(spark, sf_dir):
    path = _scratch(spark)
    writers.write_snapshot(demographics_long(spark, sf_dir), path)
    years = [2017, 2018, 2019]
    return readers.read_demographics(spark, path, fixed.VARIABLE_CODES, "2705300000", years)
