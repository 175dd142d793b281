"""Shared storage of intermediate tables and column bookkeeping of the pipeline operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventrates.session import materialize, shared_folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint a slim table in the shared folder."""
    return materialize(df)


def own(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, added: list[str]) -> list[str]:
    """Input columns that an operator hands on: those it adds replace input columns of the same name."""
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def packed(df: DataFrame, columns: list[str]) -> Column:
    """The named columns as one struct, so that an operator's own names cannot clash with them."""
    return F.struct(*[own(c) for c in columns]) if columns else F.struct(F.lit(None).alias("none"))


def unpacked(columns: list[str], struct: str = "row") -> list[Column]:
    """The columns that ``packed`` put together."""
    return [F.col(struct).getField(c).alias(c) for c in columns]


def hashable(df: DataFrame) -> list[str]:
    """Columns that Spark can hash: all but those that hold maps or variants."""

    def fits(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return fits(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(fits(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType, T.NullType))

    return [f.name for f in df.schema.fields if fits(f.dataType)]


def broadcast_below(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Hint a broadcast of a table of short rows when its counted ``rows`` are at most ``limit``."""
    return F.broadcast(df) if rows <= limit else df
