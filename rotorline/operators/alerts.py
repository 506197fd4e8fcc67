"""Risk scores, alerts, per-company settings, calibration, units and retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import units
from ..functions.values import in_period, normalise_status

VIBRATION_CUT = 0.04  # fixed value: vibration above this is a high risk

# Settings of a company that has set none.
DEFAULTS = {
    "temp_threshold": 30.0, "vib_threshold": 5.0, "calibration": 0.0, "retention_months": 30,
    "temp_unit": units.CELSIUS, "vib_unit": units.METRES_PER_S2,
}
CALIBRATION_RANGE = (-100.0, 100.0)
RETENTION_RANGE = (1, 120)

# Display class of a status as written; any other status has none.
STATUS_CLASSES = {
    "NORMAL": "normal", "WARNING": "warning", "FAULT": "fault", "DISCONNECTED": "disconnected",
    "Healthy": "normal", "Warning": "warning", "Fault": "fault", "Unknown": "disconnected",
}


def risk(vibration: Column, cut: float = VIBRATION_CUT) -> Column:
    return F.when(vibration > cut, "High").otherwise("Low")


def risk_level(readings: DataFrame, cut: float = VIBRATION_CUT) -> DataFrame:
    return readings.withColumn("risk_level", risk(F.col("vibration"), cut))


PandasModel = Callable[[pd.Series, pd.Series], pd.Series]


def score(
    readings: DataFrame, model: Callable[[Column, Column], Column] | PandasModel | None = None,
    result: str = "risk_level", result_type: T.DataType | None = None,
) -> DataFrame:
    """Adds the result of a model of (temperature, vibration).

    Without a model this is the risk level. A model of columns stays inside generated code; a
    model of pandas series is marked by `result_type` and runs over Arrow batches.
    """
    temperature, vibration = F.col("temperature"), F.col("vibration")
    if model is None:
        return readings.withColumn(result, risk(vibration))
    if result_type is None:
        return readings.withColumn(result, model(temperature, vibration))

    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for temps, vibs in parts:
            yield model(temps, vibs)

    batches.__annotations__ = {
        "parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]
    }
    return readings.withColumn(result, F.pandas_udf(batches, result_type)(temperature, vibration))


def alert_feed(readings: DataFrame) -> DataFrame:
    """Readings that call for an alert: faults and warnings, in any case."""
    return readings.where(normalise_status(F.col("status")).isin("fault", "warning"))


def status_class(df: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for kv in STATUS_CLASSES.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), F.coalesce("status", F.lit("")))
    return df.withColumn("status_class", F.coalesce(known, F.lit("")))


def with_settings(readings: DataFrame, motors: DataFrame, settings: DataFrame) -> DataFrame:
    """Readings with the company and settings of each owner; without an owner, the defaults.

    Two joins, one after the other, since Spark knows the sizes of the registry and of the
    settings, and not what their join would have: each is broadcast while it is small.
    """
    owners = motors.select("motor_id", "company_id").distinct()
    joined = readings.join(owners, "motor_id", "left").join(settings, "company_id", "left")
    return joined.select(
        *readings.columns, "company_id",
        *[F.coalesce(F.col(name), F.lit(value)).alias(name) for name, value in DEFAULTS.items()],
    )


def threshold_alerts(readings: DataFrame, motors: DataFrame, settings: DataFrame) -> DataFrame:
    """Readings above a limit of their company, with which limit (strictly above)."""
    hot = F.coalesce(F.col("temperature") > F.col("temp_threshold"), F.lit(False))
    shaking = F.coalesce(F.col("vibration") > F.col("vib_threshold"), F.lit(False))
    return (
        with_settings(readings, motors, settings)
        .where(hot | shaking)
        .select("company_id", *readings.columns, hot.alias("over_temperature"), shaking.alias("over_vibration"))
    )


def convert_units(with_prefs: DataFrame) -> DataFrame:
    """Measurements in the units their company prefers (see `with_settings`)."""
    return with_prefs.withColumns(
        {
            "temperature": units.temperature_in(F.col("temperature"), F.col("temp_unit")),
            "vibration": units.vibration_in(F.col("vibration"), F.col("vib_unit")),
        }
    )


def calibrate(with_prefs: DataFrame, col: str = "temperature") -> DataFrame:
    """The company's calibration, held to its range, added to a measurement."""
    low, high = CALIBRATION_RANGE
    offset = F.least(F.greatest(F.col("calibration"), F.lit(low)), F.lit(high))
    return with_prefs.withColumn(col, F.col(col) + offset)


def retention_filter(df: DataFrame, as_of: Column, months: int | Column = DEFAULTS["retention_months"]) -> DataFrame:
    """Rows of the last N months. A constant N and a literal `as_of` reach the file scan.

    A constant outside the range is an error, a column is held to it.
    """
    low, high = RETENTION_RANGE
    if isinstance(months, int):
        if not low <= months <= high:
            raise ValueError(f"months must lie in {low}..{high}")
        months = F.lit(months)
    else:
        months = F.least(F.greatest(months, F.lit(low)), F.lit(high))
    oldest = as_of - F.make_ym_interval(F.lit(0), months.cast("int"))
    return df.where(in_period(df.columns, oldest))
