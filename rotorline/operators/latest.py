"""Newest or first row per key.

`max_by` / `min_by` aggregate on the map side first, so that a key holding a third of all
rows sends one row per task through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = {"event": ("event_ts", "reading_id"), "arrival": ("arrival_seq",)}


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(fn(row, F.struct(*order)).alias("_row")).select("_row.*")


def newest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def latest_reading(readings: DataFrame, order: str = "event") -> DataFrame:
    """Last reading per motor, by event time (ties by reading id) or by arrival."""
    return newest_per(readings, ["motor_id"], ORDERS[order])
