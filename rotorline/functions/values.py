"""Lenient parsing and defaulting of message values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The leading number of a text, as a lenient number parser accepts it.
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

UNKNOWN_STATUS = "Unknown"


def truthy_text(text: Column, value: Column) -> Column:
    """The text of a JSON value (variant); NULL where it is missing, null, empty, false or the number zero.

    Few texts look like zero or false, and only for those the value itself is looked at.
    """
    looks_false = text.isNotNull() & (text.startswith("0") | text.startswith("-0") | (text == "false"))
    is_true = (F.schema_of_variant(value) == "STRING") | (text != "false") & (F.try_variant_get(value, "$", "double") != 0)
    # As branches, not as `or`: Spark takes what both sides of an `or` share with others out of it and runs it always.
    filled = F.nullif(text, F.lit(""))
    return F.when(~looks_false, filled).when(is_true, filled)


def or_default(text: Column, default) -> Column:
    """The text, or the default where it is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def normalise_status(status: Column) -> Column:
    return F.lower(or_default(status, "unknown"))


def lenient_number(text: Column) -> Column:
    """Leading number of a text ('12.5abc' is 12.5); NULL where there is none."""
    return F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("double")


def finite_or_null(value: Column) -> Column:
    """A double; NaN and infinities, which are not measurements, become NULL."""
    return F.when(F.abs(value) < float("inf"), value)


def epoch_to_ts(seconds: Column) -> Column:
    """Epoch seconds to a timestamp cut to milliseconds; 0 and unreadable are NULL."""
    millis = (F.nullif(seconds.try_cast("double"), F.lit(0.0)) * 1000).try_cast("bigint")
    return F.timestamp_millis(millis)


EVENT_DATE = "event_date"


def in_period(columns: Sequence[str], low: Column | None = None, before: Column | None = None,
              until: Column | None = None) -> Column:
    """`low` <= event time, < `before`, <= `until`; where given.

    A table that is stored by date is tested on its date as well, so that only the folders of
    the period are read.
    """
    ts, day = F.col("event_ts"), F.col(EVENT_DATE)
    by_date = EVENT_DATE in columns
    tests = [F.lit(True)]
    if low is not None:
        tests += [ts >= low] + [day >= low.cast("date")] * by_date
    if before is not None:
        tests += [ts < before] + [day <= before.cast("date")] * by_date
    if until is not None:
        tests += [ts <= until] + [day <= until.cast("date")] * by_date
    return reduce(lambda a, b: a & b, tests)


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def average(value: Column, rows: Column) -> Column:
    """Sum of doubles divided by `rows`, in full double precision; NULL where there are no rows."""
    return F.try_divide(F.sum(value), rows)


def round_half_up(value: Column, digits: int) -> Column:
    """Rounded for display; the operators themselves return unrounded doubles."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale
