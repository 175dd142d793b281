import os

import pytest
from pyspark.sql import functions as F

from eventrates.functions import fixed_values as fixed
from eventrates.operators.classify import classified_long
from eventrates.sources import readers, writers


def test_blank_quoted_blank_and_na(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('k,a,n\n1,,\n2,NA,NA\n3,"",1.5\n4,"x, ""y""",abc\n5,NAN,7\n')
    got = [tuple(r) for r in readers.read_csv(spark, str(path), ["k", "a", "n"], ["n"]).orderBy("k").collect()]
    assert got == [("1", "", None), ("2", None, None), ("3", "", 1.5), ("4", 'x, "y"', None), ("5", "NAN", 7.0)]


def test_event_reader_drops_the_index(spark, tmp_path):
    path = tmp_path / "events.csv"
    header = ",".join(readers.RAW_EVENT_COLUMNS)
    path.write_text(f"{header}\n1,N1,P,Male,Black,,YES,NO,X,NA,2017/01/02 03:04:05+00,44.9,-93.2\n")
    row = readers.read_events_csv(spark, str(path)).first()
    assert "row" not in row and row["reason"] is None and row["preRace"] == "" and row["lat"] == 44.9


def test_csv_round_trip_keeps_three_kinds_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([("1", "", None), ("2", None, 2.5), ("3", "Unknown", 0.1), ("4", 'q"u,o\\te', -1.0)], "k string, a string, n double")
    writers.write_csv(df, str(tmp_path / "out"))
    back = readers.read_csv(spark, str(tmp_path / "out"), ["k", "a", "n"], ["n"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_layers_are_overwritten_and_split_by_year(spark, tmp_path):
    path = str(tmp_path / "layers")
    for _ in range(2):
        writers.write_table(spark.createDataFrame([(2017, "A"), (2018, "B")], "YEAR int, NAME string"), path)
    assert sorted(d for d in os.listdir(path) if d.startswith("YEAR")) == ["YEAR=2017", "YEAR=2018"]
    back = readers.read_areas(spark, path)
    assert back.count() == 2
    plan = back.where("YEAR = 2018")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YEAR" in plan


def test_one_layer_is_replaced_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "layers")
    writers.write_table(spark.createDataFrame([(y, "A") for y in (2017, 2018, 2019)], "YEAR int, NAME string"), path)
    writers.write_table(spark.createDataFrame([(2018, "B"), (2018, "C")], "YEAR int, NAME string"), path)
    back = sorted((r["YEAR"], r["NAME"]) for r in readers.read_areas(spark, path).collect())
    assert back == [(2017, "A"), (2018, "B"), (2018, "C"), (2019, "A")]


def test_rings_come_back(spark, tmp_path):
    path = str(tmp_path / "areas")
    rings = [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)], [(0.1, 0.1), (0.2, 0.1), (0.1, 0.2), (0.1, 0.1)]]
    df = spark.createDataFrame([(2017, "A", rings), (2018, "B", rings[:1])], "YEAR int, GEOID string, rings array<array<struct<x:double,y:double>>>")
    writers.write_table(df, path)
    back = readers.read_areas(spark, path).select(*df.columns)
    assert dict(back.dtypes)["rings"] == "array<array<struct<x:double,y:double>>>"
    assert sorted(back.collect()) == sorted(df.collect())


def test_one_output_per_measure_and_year(spark, tmp_path):
    path = str(tmp_path / "classes")
    df = spark.createDataFrame([(2017, "A", 1.0, 2.0), (2018, "A", 3.0, 4.0)], "YEAR int, NAME string, NStopsBlackRatePerStratum double, NStopsTotalRatePerCapita double")
    writers.write_by_measure(classified_long(df, {c: fixed.RATE_BREAKS[c] for c in df.columns[2:]}), path)
    found = {(m, y) for m in os.listdir(path) if "=" in m for y in os.listdir(f"{path}/{m}")}
    assert len(found) == 4 and ("measure=NStopsBlackRatePerStratum", "YEAR=2018") in found


def test_tsv_has_header_and_tabs(spark, tmp_path):
    writers.write_tsv(spark.createDataFrame([("A b", 2017)], "NAME string, YEAR int").coalesce(1), str(tmp_path / "t"))
    part = next(f for f in os.listdir(tmp_path / "t") if f.startswith("part"))
    assert (tmp_path / "t" / part).read_text() == "NAME\tYEAR\nA b\t2017\n"


def test_demographic_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "long")
    data = [(y, g, "n", code, 1.0, 0.5) for y in (2017, 2018) for g in ("27053000001", "27123000001") for code in ("B01003_001", "B02001_003", "ZZZ")]
    writers.write_snapshot(spark.createDataFrame(data, "YEAR int, GEOID string, NAME string, variable string, estimate double, moe double"), path)
    codes = {k: fixed.VARIABLE_CODES[k] for k in ("pop_tot", "race_blk")}
    wide = readers.read_demographics(spark, path, codes, "27053", [2018])
    assert [tuple(r) for r in wide.collect()] == [(2018, "27053000001", "n", 1.0, 0.5, 1.0, 0.5)]
    pushed = wide._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(GEOID,27053)" in pushed and "In(variabl" in pushed


@pytest.mark.parametrize("missing", ["", "none"])
def test_other_missing_words(spark, tmp_path, missing):
    path = tmp_path / "m.csv"
    path.write_text("a\nnone\nNA\n")
    got = [r["a"] for r in readers.read_csv(spark, str(path), ["a"], missing=missing or "NA").collect()]
    assert got == ([None, "NA"] if missing else ["none", None])


def test_unmatched_header_count_is_refused(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("a,b\n1,2\n")
    got = readers.read_csv(spark, str(path), ["x", "y"]).select(F.col("y")).first()
    assert got["y"] == "2"
    for columns in (["x"], ["x", "y", "z"]):
        with pytest.raises(ValueError, match="2 columns"):
            readers.read_csv(spark, str(path), columns)
