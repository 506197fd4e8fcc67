"""The live buffer of each motor and the chart series built from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import SPAN, in_order

POINTS = 60  # fixed value: length of the live buffer
BUCKETS = 64

_POINT = ("arrival_seq", "event_ts", "temperature", "vibration")


def last_points(readings: DataFrame, n: int = POINTS) -> DataFrame:
    """The last n delivered readings of each motor, one row each.

    The row-number filter becomes a group limit before the shuffle: a busy motor sends at
    most n rows per task. It sends them to one of `BUCKETS` groups first, so that no task gets
    n rows from every other.
    """
    newest_first = F.col("arrival_seq").desc()
    bucket = F.pmod(F.xxhash64("arrival_seq"), F.lit(BUCKETS))

    def limited(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(newest_first))
        return rows.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")

    rows = readings.select("motor_id", *_POINT).withColumn("_bucket", bucket)
    return limited(limited(rows, "motor_id", "_bucket"), "motor_id").drop("_bucket")


def live_buffer(readings: DataFrame, n: int = POINTS) -> DataFrame:
    """(motor_id, points): at most n points in arrival order, oldest first.

    Points stay structs, so a NULL measurement keeps its place.
    """
    return (
        last_points(readings, n)
        .groupBy("motor_id")
        .agg(F.sort_array(F.collect_list(F.struct(*_POINT))).alias("points"))
    )


def buffer_rows(buffer: DataFrame) -> DataFrame:
    """The buffer as rows, slot 0 the oldest point."""
    return buffer.select("motor_id", F.posexplode("points").alias("slot", "p")).select(
        "motor_id", "slot", "p.event_ts", "p.temperature", "p.vibration"
    )


def buffer_last(buffer: DataFrame) -> DataFrame:
    """Last point of each motor; NULLs for an empty buffer."""
    last = F.try_element_at(F.col("points"), F.lit(-1))
    return buffer.select("motor_id", last.event_ts.alias("event_ts"), last.temperature.alias("temperature"),
                         last.vibration.alias("vibration"))


def rolling_points(readings: DataFrame, n: int = POINTS, span: int = SPAN) -> DataFrame:
    """What the buffer showed after every message: size, average, minimum and maximum.

    Aggregates instead of arrays, which would repeat every reading n times. The rows of a motor are
    cut into blocks of n. A frame of n rows is the end of one block and the beginning of the next, so
    running aggregates forward and backward in the blocks, each one step a row, are combined two by
    two. Nothing is subtracted: no value depends on what stood before the frame.
    """
    slim = readings.select("motor_id", "arrival_seq", "temperature", "vibration")

    def stats(rows: DataFrame, keys: list[str]) -> DataFrame:
        in_order = Window.partitionBy(*keys).orderBy("arrival_seq")
        place = F.row_number().over(in_order) - 1
        placed = rows.withColumn("_place", place).withColumn("_block", F.col("_place") - F.col("_place") % n)
        block = Window.partitionBy(*keys, "_block")
        to_end = block.orderBy(F.col("arrival_seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
        from_start = block.orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
        # The frame's first row, n - 1 rows back, if that lies in the block before.
        first = Window.partitionBy(*keys).orderBy("_block", "arrival_seq")
        backward = placed.withColumn("_end", _running(to_end))
        forward = backward.select(
            *rows.columns, "_place", _running(from_start).alias("_start"),
            F.when(F.col("_place") % n != n - 1, F.lag("_end", n - 1).over(first)).alias("_end"),
        )
        return forward.select(
            *rows.columns, F.least(F.col("_place") + 1, F.lit(n)).cast("bigint").alias("n_points"),
            *[c for name in _MEASURED for c in _combined(name)],
        )

    return in_order(slim, ["motor_id"], "arrival_seq", n - 1, stats, span).drop(*_MEASURED)


_MEASURED = ("temperature", "vibration")
_RUNNING = (("sum", F.sum), ("count", F.count), ("min", F.min), ("max", F.max))


def _running(frame) -> Column:
    """Sum, count, minimum and maximum of each measurement over a growing frame."""
    return F.struct(*[fn(name).over(frame).alias(f"{s}_{name}") for name in _MEASURED for s, fn in _RUNNING])


def _combined(name: str) -> list[Column]:
    """Average, minimum and maximum over two parts of a frame, of which the earlier may be missing."""
    def both(s: str) -> tuple[Column, Column]:
        return F.col(f"_end.{s}_{name}"), F.col(f"_start.{s}_{name}")

    def added(s: str) -> Column:
        end, start = both(s)
        return F.coalesce(end + start, end, start)

    return [
        F.try_divide(added("sum"), added("count")).alias(f"avg_{name}"),
        F.least(*both("min")).alias(f"min_{name}"),
        F.greatest(*both("max")).alias(f"max_{name}"),
    ]


def effectively_disconnected(status: Column, temperature: Column, vibration: Column) -> Column:
    """Nothing to show: marked Disconnected, or a measurement is missing."""
    return (F.coalesce(status, F.lit("")) == "Disconnected") | temperature.isNull() | vibration.isNull()


def live_card(state: DataFrame) -> DataFrame:
    """Values on the live card: 0 while effectively disconnected."""
    gone = effectively_disconnected(F.col("status"), F.col("temperature"), F.col("vibration"))
    return state.withColumn("disconnected", gone).withColumns(
        {
            "shown_temperature": F.when(gone, 0.0).otherwise(F.col("temperature")),
            "shown_vibration": F.when(gone, 0.0).otherwise(F.col("vibration")),
        }
    )


def padded_series(buffer: DataFrame, state: DataFrame, n: int = POINTS) -> DataFrame:
    """Exactly n chart points per row of state, padded on the left; zeros while disconnected."""
    joined = state.join(buffer.select("motor_id", "points"), "motor_id", "left")
    gone = effectively_disconnected(F.col("status"), F.col("temperature"), F.col("vibration"))
    points = F.coalesce(F.col("points"), F.array())
    shown = F.slice(points, F.greatest(F.lit(1), F.size(points) - (n - 1)), n)
    lacking = F.greatest(F.lit(0), n - F.size(points))

    def padded(fill: Column, value: Callable[[Column], Column]) -> Column:
        # Each point is turned into its value once: the padding asks for the number of points alone.
        return F.concat(F.array_repeat(fill, lacking), F.transform(shown, value))

    def values(name: str) -> Column:
        zero = F.lit(0.0)
        measured = padded(zero, lambda p: p.getField(name))
        return F.when(gone, F.array_repeat(zero, n)).otherwise(measured).alias(f"{name}_series")

    labels = padded(F.lit(""), lambda p: F.date_format(p.event_ts, "HH:mm:ss"))
    return joined.select(*state.columns, labels.alias("labels"), values("temperature"), values("vibration"))
