"""Monthly category series with the tables behind the stacked and line charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from eventrates.functions import fixed_values as fixed
from eventrates.functions.columns import percent_label
from eventrates.operators.describe import column_range
from eventrates.operators.series import MONTH, every_nth, mark_events, monthly_counts, series_long, stack_layout


def monthly_series(
    events: DataFrame,
    markers: DataFrame | None = None,
    day: str = "date",
    category: str = "raceRecode",
    labels: Mapping[str, str] = fixed.CATEGORY_LABELS,
    drop_months: Sequence[str] = tuple(fixed.PARTIAL_MONTHS),
) -> dict[str, DataFrame]:
    """``wide`` and ``long`` monthly tables, ``range`` of the percents, ``stack`` layout with labels, thinned
    ``axis`` labels and, given markers, the ``marked`` months."""
    wide = monthly_counts(events, day, category, labels, drop_months)
    long = series_long(wide, labels)
    axis = wide.select(MONTH, wide[MONTH].alias("label"))
    tables = {
        "wide": wide,
        "long": long,
        "range": column_range(wide, [f"NStops{label}Pct" for label in labels]),
        "stack": stack_layout(long).withColumn("label", percent_label("NStopsPct")),
        "axis": every_nth(axis, "label", 2, [MONTH]),
    }
    if markers is not None:
        tables["marked"] = mark_events(wide.select(MONTH), markers)
    return tables
