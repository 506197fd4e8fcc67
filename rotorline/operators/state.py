"""Current state of every registered motor: building it, updating it, and its liveness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import epoch_millis
from ..schemas import STATE_VALUES
from .latest import latest_reading
from .ordering import SPAN, in_order

THRESHOLD_MS = 10_000  # fixed value: a motor counts as connected for this long

# What a message says about its motor.
_FIVE = ("temperature", "vibration", "status", "confidence", "event_ts")

# The state of a motor that has not reported yet.
INITIAL = {"temperature": None, "vibration": None, "status": "Disconnected", "confidence": 0.0}


def initial_state(motors: DataFrame, ts_type: str = "timestamp") -> DataFrame:
    return motors.select(
        "*",
        F.lit(INITIAL["temperature"]).cast("double").alias("temperature"),
        F.lit(INITIAL["vibration"]).cast("double").alias("vibration"),
        F.lit(INITIAL["status"]).alias("status"),
        F.lit(INITIAL["confidence"]).alias("confidence"),
        F.lit(None).cast(ts_type).alias("last_updated"),
    )


def apply_messages(state: DataFrame, readings: DataFrame) -> DataFrame:
    """State after all messages: the last to arrive wins, other motors stay as they are.

    Readings shrink to one row per motor before they meet the state.
    """
    slim = readings.select("motor_id", "arrival_seq", *_FIVE)
    last = latest_reading(slim, "arrival").select(
        F.col("motor_id"),
        F.struct(
            "temperature", "vibration", "status", "confidence", F.col("event_ts").alias("last_updated")
        ).alias("_new"),
    )
    joined = state.join(last, "motor_id", "left")
    matched = F.col("_new").isNotNull()
    return joined.select(
        *[F.when(matched, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in STATE_VALUES else F.col(c)
          for c in state.columns]
    )


def motor_state(motors: DataFrame, readings: DataFrame) -> DataFrame:
    """State of all registered motors from the registry and the readings so far."""
    ts_type = readings.schema["event_ts"].dataType.simpleString()
    return apply_messages(initial_state(motors, ts_type), readings)


def changed_only(readings: DataFrame, span: int = SPAN) -> DataFrame:
    """Readings that differ in any of the five values from the one delivered before."""
    now = F.struct(*_FIVE)

    def previous(rows: DataFrame, window_keys: list[str]) -> DataFrame:
        return rows.withColumn("_prev", F.lag(now).over(Window.partitionBy(*window_keys).orderBy("arrival_seq")))

    out = in_order(readings, ["motor_id"], "arrival_seq", 1, previous, span)
    return out.where(~now.eqNullSafe(F.col("_prev"))).select(*readings.columns)


def remove_motors(state: DataFrame, buffer: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and buffer without the given motors; the log is kept."""
    gone = ids.select("motor_id")
    return state.join(gone, "motor_id", "left_anti"), buffer.join(gone, "motor_id", "left_anti")


def _is_fresh(ts: Column, as_of: Column, threshold_ms: int) -> Column:
    return F.coalesce(epoch_millis(as_of) - epoch_millis(ts) < threshold_ms, F.lit(False))


def connection_status(state: DataFrame, as_of: Column, threshold_ms: int = THRESHOLD_MS,
                      ts: str = "last_updated") -> DataFrame:
    """Adds `connection`; Unknown counts as disconnected, a time in the future as connected."""
    off = F.coalesce(F.col("status").isin("Disconnected", "Unknown"), F.lit(False))
    alive = ~off & _is_fresh(F.col(ts), as_of, threshold_ms)
    return state.withColumn("connection", F.when(alive, "Connected").otherwise("Disconnected"))


def fleet_connected(state: DataFrame, as_of: Column, threshold_ms: int = THRESHOLD_MS,
                    by: Sequence[str] = ()) -> DataFrame:
    """'Connected' if there are motors and all are live; here Unknown does not count against."""
    live = F.coalesce(F.col("status") != "Disconnected", F.lit(True)) & _is_fresh(
        F.col("last_updated"), as_of, threshold_ms
    )
    return state.groupBy(*by).agg(
        F.when(F.coalesce(F.bool_and(live), F.lit(False)), "Connected")
        .otherwise("Mixed/Disconnected")
        .alias("connection")
    )


def display_last_updated(state: DataFrame) -> DataFrame:
    """Adds the last update, else the time of installation, else 'N/A', as text."""
    shown = F.coalesce(F.col("last_updated"), F.col("installed_at"))
    return state.withColumn(
        "display_last_updated", F.coalesce(F.date_format(shown, "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))
    )


def prediction_view(state: DataFrame, newest: DataFrame) -> DataFrame:
    """Each motor with its live value where it has reported, else its stored one.

    `newest` has the last delivered reading of each motor, which is the last point of its live
    buffer, so the buffer itself is not needed.
    """
    last = newest.select("motor_id", F.struct("event_ts", "temperature", "vibration").alias("_last"))
    joined = state.join(last, "motor_id", "left")

    def live_or(stored: str, live: str) -> Column:
        return F.when(F.col("_last").isNotNull(), F.col("_last")[live]).otherwise(F.col(stored))

    keys = [c for c in ("company_id",) if c in state.columns]
    return joined.select(
        *keys, "motor_id", "motor_name", "confidence", "status",
        live_or("temperature", "temperature").alias("temperature"),
        live_or("vibration", "vibration").alias("vibration"),
        live_or("last_updated", "event_ts").alias("last_checked"),
    )
