"""Raw bus messages to readings.

Every function is row-wise, so each works on a batch and on a stream and adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids
from ..functions.values import (
    UNKNOWN_STATUS, epoch_to_ts, finite_or_null, lenient_number, truthy_text,
)

# JSON as the bus defines it: no single quotes, no bare NaN.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _seal(payload: Column) -> Column:
    """What no payload can foresee of itself."""
    return F.xxhash64(payload).cast("string")


def _may_end_early(payload: Column) -> Column:
    """Whether a text could close an array around it, which none without a bracket can."""
    return payload.contains("]")


def _decoded(payload: Column) -> Column:
    """The payload in a JSON array; one that may end it early with a sealed message after it.

    Anything after the payload's object makes another array or none, and so shows.
    """
    sealed = F.concat(F.lit(',{"timestamp":"'), _seal(payload), F.lit('"}]'))
    end = F.when(_may_end_early(payload), sealed).otherwise(F.lit("]"))
    return F.from_json(F.concat(F.lit("["), payload, end), schemas.T.ArrayType(schemas.MESSAGE), _STRICT)


def _is_one_object(messages: Column, payload: Column) -> Column:
    last = F.get(messages, F.lit(1)).timestamp
    alone = F.when(_may_end_early(payload), (F.size(messages) == 2) & (last == _seal(payload)))
    return F.coalesce(alone.otherwise(F.size(messages) == 1) & F.get(messages, F.lit(0)).isNotNull(), F.lit(False))


def is_message(payload: Column) -> Column:
    """Whether a payload is one JSON object and nothing else."""
    return _is_one_object(_decoded(payload), payload)


def _is_other_json(payload: Column) -> Column:
    """Whether a payload is one JSON value that is neither an object nor null."""
    sealed = F.concat(F.lit("["), payload, F.lit(',"'), _seal(payload), F.lit('"]'))
    values = F.from_json(sealed, schemas.T.ArrayType(schemas.T.VariantType()), _STRICT)
    whole = (F.size(values) == 2) & (F.try_variant_get(F.get(values, F.lit(1)), "$", "string") == _seal(payload))
    first = F.get(values, F.lit(0))
    no_object = ~F.ltrim(payload).startswith("{") & (F.trim(payload) != "")
    return F.coalesce(no_object & whole & first.isNotNull() & ~F.is_variant_null(first), F.lit(False))


# What a decoded message holds: whether it is one JSON object and nothing else, and its values.
_MESSAGE = "_message"


def with_messages(raw: DataFrame) -> DataFrame:
    """Adds what the payloads say, in whose place the payloads of whole messages go.

    `parse_telemetry` and `malformed_telemetry` take messages with or without it; where both are
    called on kept messages, no payload is decoded twice.
    """
    # A one-element explode is a barrier: a filter on what it makes would otherwise move below the
    # projection and decode every message a second time.
    decoded = raw.withColumn("ms", F.explode(F.array(_decoded(F.col("payload")))))
    m = F.get("ms", 0)
    typed = F.from_json("payload", "motor_id variant, status variant", _STRICT)
    message = F.struct(
        _is_one_object(F.col("ms"), F.col("payload")).alias("whole"),
        truthy_text(m.motor_id, typed.motor_id).alias("motor_id"),
        m.timestamp.try_cast("double").alias("seconds"),
        lenient_number(m.temperature).alias("temperature"),
        lenient_number(m.vibration).alias("vibration"),
        F.coalesce(truthy_text(m.status, typed.status), F.lit(UNKNOWN_STATUS)).alias("status"),
        m.confidence.try_cast("double").alias("confidence"),
    )
    return decoded.select(*raw.columns, F.explode(F.array(message)).alias(_MESSAGE)).withColumn(
        "payload", F.when(~F.col(f"{_MESSAGE}.whole"), F.col("payload")))


def parse_telemetry(raw: DataFrame) -> DataFrame:
    """Messages as readings; malformed messages and those without a motor id are dropped.

    Unreadable numbers become NULL, a missing status 'Unknown', a missing confidence 0 and a
    missing time the arrival time. An id or status that is the number 0 or false counts as missing.
    """
    known = raw if _MESSAGE in raw.columns else with_messages(raw)
    named = known.where(f"{_MESSAGE}.whole and {_MESSAGE}.motor_id is not null")
    return named.select("arrival_seq", "arrival_ts", f"{_MESSAGE}.*").select(
        F.col("arrival_seq").alias("reading_id"),
        "motor_id",
        F.coalesce(epoch_to_ts(F.col("seconds")), F.col("arrival_ts").cast("timestamp")).alias("event_ts"),
        "arrival_seq",
        finite_or_null(F.col("temperature")).alias("temperature"),
        finite_or_null(F.col("vibration")).alias("vibration"),
        "status",
        F.coalesce(finite_or_null(F.col("confidence")), F.lit(0.0)).alias("confidence"),
    )


def malformed_telemetry(raw: DataFrame) -> DataFrame:
    """Messages that are not valid JSON, whole, for the quarantine table.

    JSON that is no object (a number, say) names no motor and is dropped without being kept here.
    """
    whole = F.col(f"{_MESSAGE}.whole") if _MESSAGE in raw.columns else is_message(F.col("payload"))
    return raw.where(~whole & ~_is_other_json(F.col("payload"))).drop(_MESSAGE)


def with_topic_motor(raw: DataFrame) -> DataFrame:
    """Adds the motor id that the topic names (NULL for a foreign topic)."""
    return raw.withColumn("topic_motor_id", ids.motor_of(F.col("topic")))


def subscribed(raw: DataFrame, motors: DataFrame) -> DataFrame:
    """Only messages on topics of registered motors. Works stream against table."""
    wanted = motors.select(ids.topic_of(F.col("motor_id")).alias("topic"))
    return raw.join(wanted, "topic", "left_semi")


def subscription_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Topics to give up and topics to take on, as (topic, action).

    One aggregation over both sets instead of two anti joins: partial aggregation shrinks
    repeated topics before the only shuffle.
    """
    both = current.select("topic", F.lit(1).alias("have"), F.lit(0).alias("want")).unionByName(
        wanted.select("topic", F.lit(0).alias("have"), F.lit(1).alias("want"))
    )
    return (
        both.groupBy("topic")
        .agg(F.max("have").alias("have"), F.max("want").alias("want"))
        .where(F.col("have") != F.col("want"))
        .select("topic", F.when(F.col("have") == 1, "unsubscribe").otherwise("subscribe").alias("action"))
    )
