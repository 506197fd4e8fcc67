"""Unit conversions for display preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit codes and the standard gravity.
CELSIUS, FAHRENHEIT = "C", "F"
G, METRES_PER_S2 = "g", "ms2"
STANDARD_GRAVITY = 9.80665


def temperature_in(celsius: Column, unit: Column) -> Column:
    return F.when(unit == FAHRENHEIT, celsius * 9.0 / 5.0 + 32.0).otherwise(celsius)


def vibration_in(g: Column, unit: Column) -> Column:
    return F.when(unit == METRES_PER_S2, g * STANDARD_GRAVITY).otherwise(g)
