"""Writers. All overwrite what they write; none collects rows, so each output is a folder of part files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Headered CSV. Missing is written as ``NA`` and the empty string as ``""``, as ``read_csv`` expects."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "NA").option(
        "emptyValue", '""'
    ).option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Headered tab-separated text."""
    write_csv(df, path, sep="\t")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("YEAR",)) -> None:
    """Parquet, one folder per partition value (period). Only the periods that ``df`` has are replaced; others stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Plain Parquet copy of a table."""
    df.write.mode("overwrite").parquet(path)


def write_by_measure(long: DataFrame, path: str, measure: str = "measure", period: str = "YEAR") -> None:
    """One folder per (measure, period) of a long table.

    The rebalance hint gathers small slices into few files and lets the adaptive plan split a large one. Only the
    slices that ``long`` has are replaced.
    """
    writer = long.hint("rebalance", measure, period).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(measure, period).parquet(path)
