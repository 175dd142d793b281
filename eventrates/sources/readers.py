"""Readers with declared columns; no schema inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventrates.operators.demographics import name_variables, pivot_variables

RAW_EVENT_COLUMNS = (
    "row", "neighborhood", "problem", "gender", "race", "preRace", "personSearch", "vehicleSearch",
    "callDisposition", "reason", "responseDate", "lat", "long",
)
NUMERIC_EVENT_COLUMNS = ("lat", "long")

RING_TYPE = "array<array<struct<x:double,y:double>>>"


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    numeric: Sequence[str] = (),
    missing: str = "NA",
    multi_line: bool = False,
) -> DataFrame:
    """Headered CSV whose columns, in file order, are all read as text and then typed.

    Text: a blank field is the empty string and ``NA`` is missing. Numbers: anything unparsable is missing. Header
    names are ignored in favour of ``columns``; a header with another number of columns is refused. ``multi_line`` allows line breaks in
    quoted text, at the price that a file can no longer be split over tasks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    plain = {"header": True, "multiLine": multi_line, "escape": '"'}
    # Without a schema only the head of a file is read.
    header = spark.read.options(**plain).csv(path).columns
    if len(header) != len(columns):
        raise ValueError(f"{path} has {len(header)} columns, expected {len(columns)}: {header}")
    raw = spark.read.schema(schema).options(**plain, enforceSchema=True).csv(path)
    typed = {}
    for c in columns:
        value = F.col(c)
        if c in numeric:
            typed[c] = value.try_cast("double")
        else:
            typed[c] = F.when(value.isNull(), F.lit("")).when(value != missing, value)
    return raw.select(*[typed[c].alias(c) for c in columns])


def read_events_csv(spark: SparkSession, path: str, columns: Sequence[str] = RAW_EVENT_COLUMNS) -> DataFrame:
    """Raw event export with its leading index column dropped."""
    return read_csv(spark, path, columns, NUMERIC_EVENT_COLUMNS).drop(columns[0])


def read_demographics(
    spark: SparkSession, path: str, codes: dict[str, str], area_prefix: str | None = None, years: Sequence[int] = ()
) -> DataFrame:
    """Wide demographic table from long Parquet ``(YEAR, GEOID, NAME, variable, estimate, moe)``.

    ``area_prefix`` restricts to a state or county by the leading digits of ``GEOID``; it, the years and the
    variable list are all pushed to the scan.
    """
    long = spark.read.parquet(path)
    if area_prefix:
        long = long.where(F.col("GEOID").startswith(area_prefix))
    if years:
        long = long.where(F.col("YEAR").isin(list(years)))
    return pivot_variables(name_variables(long, codes), list(codes))


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Polygon table: any attributes, ``rings`` and, if stored, a bounding box."""
    return spark.read.parquet(path)
