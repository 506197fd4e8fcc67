"""Fleet summaries: status counts, averages and the daily trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import average, in_period, normalise_status

COUNTED = ("healthy", "warning", "fault")


def _status_is(name: str) -> Column:
    return normalise_status(F.col("status")) == name


def overview_summary(state: DataFrame, by: Sequence[str] = (), null_policy: str = "zero") -> DataFrame:
    """Motor count, counts per status and averages; an empty fleet averages 0.

    `null_policy="zero"` lets a motor without a measurement count as 0, `"skip"` leaves it out.
    """
    motors = F.count(F.lit(1))

    def mean(name: str) -> Column:
        value = F.col(name)
        if null_policy == "zero":
            value = F.coalesce(value, F.lit(0.0))
        rows = motors if null_policy == "zero" else F.count(value)
        return F.coalesce(average(value, rows), F.lit(0.0)).alias(f"avg_{name}")

    return state.groupBy(*by).agg(
        motors.alias("total_motors"),
        *[F.count_if(_status_is(s)).alias(s) for s in COUNTED],
        mean("temperature"),
        mean("vibration"),
    )


def status_distribution(state: DataFrame) -> DataFrame:
    """(status, n, share) of the three counted statuses, zero where there are none.

    One pass of conditional counts, turned into rows afterwards; no join to fill the zeros.
    """
    counts = state.agg(*[F.count_if(_status_is(s)).alias(s) for s in COUNTED])
    total = sum((F.col(s) for s in COUNTED[1:]), F.col(COUNTED[0]))
    rows = F.array(*[F.struct(F.lit(s.capitalize()).alias("status"), F.col(s).alias("n")) for s in COUNTED])
    share = F.coalesce(F.try_divide(F.col("r.n").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return counts.select(total.alias("total"), F.explode(rows).alias("r")).select(
        "r.status", "r.n", share.alias("share")
    )


def prediction_status_counts(state: DataFrame) -> DataFrame:
    """Five buckets; whatever is none of the named four counts as unknown."""
    named = (*COUNTED, "disconnected")
    other = ~normalise_status(F.col("status")).isin(*named)
    return state.agg(
        *[F.count_if(_status_is(s)).alias(s) for s in named], F.count_if(other).alias("unknown")
    )


def daily_trend(readings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Average temperature and vibration of each of the last `days` days; empty days stay."""
    last = as_of.cast("date")
    calendar = readings.sparkSession.range(days).select(
        F.date_sub(last, F.col("id").cast("int")).alias("day")
    )
    from_midnight = F.date_sub(last, days - 1).cast("timestamp_ntz")
    before = F.date_add(last, 1).cast("timestamp_ntz")
    daily = (
        readings.where(in_period(readings.columns, from_midnight, before))
        .groupBy(F.to_date("event_ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            average(F.col("temperature"), F.count("temperature")).alias("avg_temperature"),
            average(F.col("vibration"), F.count("vibration")).alias("avg_vibration"),
        )
    )
    return calendar.join(daily, "day", "left").select(
        "day", F.date_format("day", "E").alias("label"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "avg_temperature", "avg_vibration",
    )
