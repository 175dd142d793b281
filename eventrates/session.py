"""Session settings and the two helpers every iterative or size-dependent operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only when its measured size is below this.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024


# Settings the library expects. Generated methods above 8000 bytes of bytecode are never compiled by the JVM and then
# run many times slower, so such stages are left to the per-operator code, which is split into small methods.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the expected settings on a running session; all of them can be changed at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "eventrates", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the expected settings. Master, memory and shuffle settings come from spark-submit or ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="eventrates-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, so later passes neither recompute it nor depend on lost executors.

    The rows are written to the session's shared folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark
    removes the files once no table refers to them.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: computed once, read by column, safe from lost
    executors, and with a short plan. The files stay until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(
    df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_LIMIT_BYTES
) -> tuple[DataFrame, bool]:
    """Hint a broadcast when the summed ``row_bytes`` is proven to be at most ``limit``.

    Returns the (possibly hinted) DataFrame and whether the hint was given, so that the caller can salt otherwise.
    """
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.coalesce(F.sum(size.cast("double")), F.lit(0.0))).first()[0]
    if total <= limit:
        return F.broadcast(df), True
    return df, False


def levels_of_each(df: DataFrame, columns: list[str], max_levels: int | None = None) -> dict[str, list]:
    """Sorted distinct non-missing values of category columns, from one pass over the data.

    For results that have a column or a term per level, whose size the driver holds anyway. A caller that wants to be
    warned of a key column taken by mistake states ``max_levels``.
    """
    found: dict[str, list] = {c: [] for c in columns}

    def slots(own: str) -> list[Column]:
        """The column's value in its own slot and NULL in the others, so that every slot keeps its type."""
        named = []
        for i, c in enumerate(columns):
            named += [F.lit(f"v{i}"), F.col(c) if c == own else F.lit(None).cast(df.schema[c].dataType)]
        return named

    long = df.select(F.inline(F.array(*[F.named_struct(*slots(c)) for c in columns])))
    filled = F.greatest(*[F.col(f"v{i}").isNotNull() for i in range(len(columns))], F.lit(False))
    rows = long.where(filled).distinct()
    if max_levels is not None:
        rows = rows.limit(max_levels * len(columns) + 1)
    rows = rows.collect()
    for row in rows:
        for i, c in enumerate(columns):
            if row[i] is not None:
                found[c].append(row[i])
    for c, values in found.items():
        if max_levels is not None and (len(values) > max_levels or len(rows) > max_levels * len(columns)):
            raise ValueError(f"{c} may have more than {max_levels} distinct values; pass its levels explicitly")
    return {c: sorted(values) for c, values in found.items()}


def levels_of(df: DataFrame, column: str, max_levels: int | None = None) -> list:
    """Sorted distinct non-missing values of one category column."""
    return levels_of_each(df, [column], max_levels)[column]
