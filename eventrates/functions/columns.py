"""Scalar column expressions for cleaning, recoding, clock time, ratios and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95% normal quantile.
Z_95 = 1.959963984540054

DAY_MICROS, MINUTE_MICROS = 86_400_000_000, 60_000_000

# Accepted layouts of a date-time text.
TIMESTAMP_LAYOUTS = ("yyyy/M/d H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_number(column: Column | str) -> Column:
    """True when the value is neither missing nor NaN.

    Spark sorts NaN above every number and lets it pass ``>=``; operators that filter, rank or bin use this guard.
    """
    value = _col(column)
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def is_finite(column: Column | str) -> Column:
    """True when the value is a number other than NaN and the infinities."""
    return F.coalesce(F.abs(_col(column).cast("double")) < F.lit(float("inf")), F.lit(False))


def safe_ratio(numerator: Column | str, denominator: Column | str, mode: str = "null") -> Column:
    """``numerator / denominator`` without the division error of ANSI mode.

    ``null`` gives NULL on a zero denominator; ``ieee`` gives Inf, -Inf or NaN as floating-point division does.
    """
    num, den = _col(numerator).cast("double"), _col(denominator).cast("double")
    quotient = F.try_divide(num, den)
    if mode == "null":
        return quotient
    if mode != "ieee":
        raise ValueError(f"unknown ratio mode: {mode}")
    on_zero = (
        F.when((num == 0) | F.isnan(num), F.lit(float("nan")))
        .when(num > 0, F.lit(float("inf")))
        .when(num < 0, F.lit(float("-inf")))
    )
    return F.when(den == 0, on_zero).otherwise(quotient)


def recode(column: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace the listed values and keep all others, missing included."""
    value = _col(column)
    chain = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), mapping.items(), F)
    return chain.otherwise(value) if mapping else value


def fill_blank(column: Column | str, filler: str = "Unknown") -> Column:
    """Replace the empty string; missing stays missing."""
    value = _col(column)
    return F.when(value == "", F.lit(filler)).otherwise(value)


def fill_missing(column: Column | str, filler: str = "Unknown") -> Column:
    """Replace missing; the empty string stays."""
    return F.coalesce(_col(column), F.lit(filler))


def strip_text(column: Column | str, literal: str) -> Column:
    """Remove every occurrence of a literal text, such as an offset suffix."""
    return F.replace(_col(column), F.lit(literal), F.lit(""))


def parse_utc(column: Column | str, layouts: Sequence[str] = TIMESTAMP_LAYOUTS) -> Column:
    """Parse a date-time text written in UTC; unparsable text gives NULL and keeps its row.

    The result is the instant, whatever zone the session works in.
    """
    value = F.concat(_col(column), F.lit(" +00"))
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f"{layout} X")) for layout in layouts])


def _whole(value: Column, unit: int) -> Column:
    """How many whole units a count of microseconds holds, rounded down; exact, as only multiples are divided."""
    return (value - F.pmod(value, F.lit(unit))) / F.lit(unit)


def utc_date(value: Column) -> Column:
    """The UTC calendar day of an instant; that of readings without a zone and of dates as they are."""
    day = F.date_from_unix_date(_whole(F.unix_micros(value.cast("timestamp")), DAY_MICROS).cast("int"))
    return F.when(F.typeof(value) == "timestamp", day).otherwise(value.cast("timestamp_ntz").cast("date"))


def utc_minutes(value: Column) -> Column:
    """Whole minutes of the UTC clock since midnight, for an instant or a reading without a zone."""
    in_day = F.pmod(F.unix_micros(value.cast("timestamp")), F.lit(DAY_MICROS))
    reading = value.cast("timestamp_ntz")
    return F.when(F.typeof(value) == "timestamp", _whole(in_day, MINUTE_MICROS).cast("int")).otherwise(
        F.hour(reading) * 60 + F.minute(reading)
    )


def utc_instant(value: Column) -> Column:
    """The instant of a UTC clock reading without a zone; instants are taken as they are."""
    reading = value.cast("timestamp_ntz")
    micros = (
        F.unix_date(reading.cast("date")).cast("long") * DAY_MICROS
        + (F.hour(reading) * 60 + F.minute(reading)).cast("long") * MINUTE_MICROS
        + (F.date_part(F.lit("second"), reading) * 1_000_000).cast("long")
    )
    return F.when(F.typeof(value) == "timestamp", value.cast("timestamp")).otherwise(F.timestamp_micros(micros))


def flag(condition: Column) -> Column:
    """1 or 0 by condition, missing where the condition is missing."""
    return condition.cast("int")


def any_flag(columns: Sequence[Column | str], yes: str = "YES", no: str = "NO") -> Column:
    """``yes`` if any column equals ``yes``, by three-valued OR."""
    hit = reduce(lambda a, b: a | b, [_col(c) == yes for c in columns])
    return F.when(hit, F.lit(yes)).when(~hit, F.lit(no))


def decimal_hour(timestamp: Column | str) -> Column:
    """Hour plus minutes of the UTC clock as a fraction; seconds are ignored."""
    minutes = utc_minutes(_col(timestamp))
    minute = F.pmod(minutes, F.lit(60))
    return (minutes - minute) / F.lit(60) + minute / F.lit(60.0)


def clock_window_flag(
    timestamp: Column | str, start: float = 17.0, end: float = 22.0, tz: str | None = None
) -> Column:
    """1 when the decimal hour lies in ``[start, end]``, by the UTC clock or the clock of ``tz``."""
    value = _col(timestamp)
    if tz is not None:
        value = F.from_utc_timestamp(value, tz)
    return flag(decimal_hour(value).between(start, end))


def month_key(day: Column | str) -> Column:
    """``yyyy-MM`` text, which sorts by time."""
    return F.date_format(_col(day), "yyyy-MM")


def after_date(day: Column | str, cutoff: date | str) -> Column:
    """True strictly after the cutoff date."""
    return F.to_date(_col(day)) > F.lit(str(cutoff)).cast("date")


def with_levels(column: Column | str, levels: Sequence[str]) -> Column:
    """Keep listed categories; any other value becomes missing."""
    value = _col(column)
    return F.when(value.isin(list(levels)), value)


def level_code(column: Column | str, levels: Sequence[str]) -> Column:
    """Zero-based position among the alphabetically sorted levels; missing for an unlisted value."""
    position = F.array_position(F.array(*[F.lit(v) for v in sorted(levels)]), _col(column))
    return F.when(position > 0, (position - 1).cast("int"))


def logistic(eta: Column | str) -> Column:
    """Inverse logit, stable for large positive and negative arguments."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(eta)))


def percent_label(column: Column | str, digits: int = 1) -> Column:
    """Half-even rounded percent text, such as ``12.5%``; whole numbers carry no decimals."""
    value = F.bround(_col(column).cast("double"), digits)
    text = F.format_string(f"%.{digits}f", value)
    return F.when(value.isNotNull(), F.concat(F.regexp_replace(text, r"\.?0+$", "") if digits else text, F.lit("%")))


# The parts a rate column name is made of.
RATE_NAME = r"^NStops(Total|Asian|Black|Latin|NatAm|Other|Unkwn|White)(PSBS|PSAS|VSBS|VSAS|PS|VS|BS|AS)?Rate(Per.+)$"


def rate_category(measure: Column | str) -> Column:
    """Category label held in a rate column name; empty when the name does not follow the pattern."""
    return F.regexp_extract(_col(measure), RATE_NAME, 1)


def rate_slice(measure: Column | str) -> Column:
    """Slice suffix held in a rate column name; empty for the unsliced rate."""
    return F.regexp_extract(_col(measure), RATE_NAME, 2)


def compose_title(template: str, *columns: Column | str) -> Column:
    """Text from a printf template, for titles made of a measure and a period."""
    return F.format_string(template, *[_col(c) for c in columns])
