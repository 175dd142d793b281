"""The pipelines on the stand-in tables, and the shape of the physical plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import standins
from catalog.queries import QUERIES
from eventrates.functions import fixed_values as fixed
from eventrates.operators import series
from eventrates.operators.classify import top_n_ties
from eventrates.plans import event_preparation as prep
from eventrates.plans.area_rates import save_area_rates
from eventrates.plans.monthly_series import monthly_series
from eventrates.plans.rate_report import rate_report, save_class_tables
from eventrates.plans.search_models import fit_models, model_events, search_battery, search_model

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    return prep.clean_events(standins.raw_events(spark, SF)).persist()


def test_recode_leaves_no_old_label(spark, events):
    left = events.where(F.col("raceRecode").isin(["East African", "Latino", "Native American", ""]))
    assert left.count() == 0
    kept = standins.raw_events(spark, SF).where("neighborhood <> '' AND problem NOT IN ('Truancy (P)', 'Curfew Violations (P)')")
    assert events.count() == kept.count()
    assert events.where("raceRecode IS NULL OR veilBeforeSunset + veilAfterSunset > 1").count() == 0


def test_cleaning_does_not_shuffle(spark):
    text = plan(prep.clean_events(standins.raw_events(spark, SF)))
    assert "Exchange" not in text and "Python" not in text


def test_monthly_tables(spark, events):
    markers = events.agg(F.min("date").alias("date"), F.lit("x").alias("label"))
    tables = monthly_series(events, markers)
    wide = tables["wide"].collect()
    assert [r["dateMonthYear"] for r in wide] == sorted(r["dateMonthYear"] for r in wide)
    spread = tables["range"].first()
    assert all(0 <= v <= 100 for v in spread)
    assert tables["long"].count() == 7 * len(wide)
    assert tables["axis"].where("label = ''").count() == math.ceil(len(wide) / 2)
    assert tables["marked"].where("label = 'x'").count() == 1
    assert all(r["label"].endswith("%") for r in tables["stack"].collect())


def test_rates_report_and_outputs(spark, events, tmp_path):
    rates = QUERIES["area_rate_pipeline"](spark, SF).persist()
    report = rate_report(rates, top=5)
    assert report["means"].count() == 2
    assert report["classes"].count() == rates.count() * len(fixed.RATE_BREAKS)
    assert report["top_NStopsBlackPSRatePerStratum"].count() >= 5
    assert {r["measure"] for r in report["natural_breaks"].collect()} == set(fixed.RATE_BREAKS)
    save_class_tables(rates, str(tmp_path / "classes"))
    save_area_rates(events, rates, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "area_rates")).count() == rates.count()
    assert spark.read.parquet(str(tmp_path / "out" / "points")).where("year = 2021").count() == 0


def test_plain_and_adjusted_models(spark, events):
    table = model_events(events, "2018-06-15")
    assert {r[0] for r in table.select("personSearch").distinct().collect()} == {0, 1}
    models = {"plain": search_model("personSearch", False), "adjusted": search_model("personSearch", True)}
    with pytest.warns(UserWarning):
        # The stand-in texts are functions of one id, so the adjusted design has a level or direction too many.
        results = fit_models(table, models)
    assert len(results["plain"].fit.terms) + len(results["plain"].fit.aliased) == 14
    assert results["plain"].odds.count() == results["plain"].period_odds.count()
    assert np.isfinite(results["adjusted"].fit.beta).all()
    names = results["adjusted"].fit.terms
    assert names.index("veilAfterSunset") < names.index("lat") < names.index("long") < names.index("postPeriod")


def test_shares_and_agreement(events):
    tables = prep.search_share_tables(events)
    for search, table in tables.items():
        sums = table.groupBy(search, "variable").agg(F.round(F.sum("freq"), 6).alias("s")).collect()
        assert all(r["s"] == 100 for r in sums)
    assert prep.category_agreement(events).first()["agreement"] == 1.0


def test_scalar_totals_do_not_join(spark):
    orders = standins.table(spark, SF, "orders")
    for df in (series.days_since_first(orders, "o_orderdate"), top_n_ties(orders, "o_totalprice", 10)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text and "Subquery" in text


# Queries whose result is a plan over the tables, not over rows their own jobs brought back.
LAZY = [n for n in sorted(QUERIES) if not n.startswith(("gee", "glm", "natural")) and not n.endswith("round_trip")]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_join_anywhere(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_counts_prune_the_scan(spark):
    text = plan(QUERIES["monthly_counts"](spark, SF))
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in text
    text = plan(QUERIES["hit_rate"](spark, SF))
    assert "EqualTo(l_linestatus,F)" in text


def test_battery_names(spark):
    assert search_battery.__doc__ and search_model("vehicleSearch", True).outcome == "vehicleSearch"


def test_year_filter_prunes_stored_events(spark, events, tmp_path):
    from eventrates.plans.area_rates import area_counts
    from eventrates.sources.writers import write_table

    path = str(tmp_path / "events")
    write_table(events, path, ["year"])
    stored = spark.read.parquet(path)
    counts = area_counts(stored, standins.areas(spark, SF), standins.boundary(spark, SF), years=[2018])
    assert "PartitionFilters: [isnotnull(year" in plan(counts)
    direct = area_counts(events, standins.areas(spark, SF), standins.boundary(spark, SF), years=[2018])
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, direct.collect()))
