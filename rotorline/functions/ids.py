"""Motor ids and message topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic layout and id layout of the message bus and the registry.
TOPIC_PATTERN = r"^motors/([^/]+)/data$"
ID_PREFIX = "MOTOR-"
TRAILING_DIGITS = r"(\d+)$"


def topic_of(motor_id: Column) -> Column:
    return F.concat(F.lit("motors/"), motor_id, F.lit("/data"))


def motor_of(topic: Column) -> Column:
    """Motor id of a topic; NULL for a topic of another layout."""
    return F.nullif(F.regexp_extract(topic, TOPIC_PATTERN, 1), F.lit(""))


def id_number(motor_id: Column) -> Column:
    """Number at the end of an id, 0 where there is none."""
    return F.coalesce(F.regexp_extract(motor_id, TRAILING_DIGITS, 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def format_id(number: Column) -> Column:
    """'MOTOR-' and at least three digits; longer numbers, which `lpad` would cut, stay whole."""
    text = number.cast("string")
    return F.concat(F.lit(ID_PREFIX), F.when(number < 1000, F.lpad(text, 3, "0")).otherwise(text))
