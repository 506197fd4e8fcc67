"""Explicit schemas of the tables. Nothing is ever inferred."""

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


_S, _D, _L, _I, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()

USERS = _fields(("id", _S), ("name", _S), ("email", _S), ("created_at", _TS))

MOTORS = _fields(
    ("motor_id", _S), ("company_id", _S), ("motor_name", _S), ("location", _S),
    ("installed_at", _TS), ("reg_seq", _L),
)

TELEMETRY = _fields(("topic", _S), ("payload", _S), ("arrival_seq", _L), ("arrival_ts", _TS))

# Every field is read as text, so that one odd value cannot void its message.
MESSAGE = _fields(
    ("motor_id", _S), ("temperature", _S), ("vibration", _S), ("timestamp", _S),
    ("status", _S), ("confidence", _S),
)

READINGS = _fields(
    ("reading_id", _L), ("motor_id", _S), ("event_ts", _TS), ("arrival_seq", _L),
    ("temperature", _D), ("vibration", _D), ("status", _S), ("confidence", _D),
)

SENSOR_AXES = (
    "acceleration_x", "acceleration_y", "acceleration_z", "gyro_x", "gyro_y", "gyro_z",
    "amplitude", "angular_velocity", "temperature",
)
SENSOR_DATA = _fields(("id", _L), ("motor_id", _S), *[(a, _D) for a in SENSOR_AXES], ("event_ts", _TS))

STATE_VALUES = ("temperature", "vibration", "status", "confidence", "last_updated")
MOTOR_STATE = T.StructType(
    MOTORS.fields
    + _fields(("temperature", _D), ("vibration", _D), ("status", _S), ("confidence", _D), ("last_updated", _TS)).fields
)

# One saved motor as JSON. Numbers are typed here on purpose: text in their place reads as NULL.
SAVED_MOTOR = _fields(
    ("id", _S), ("companyId", _S), ("name", _S), ("location", _S), ("installedAt", _S), ("regSeq", _L),
    ("temperature", _D), ("vibration", _D), ("status", _S), ("confidence", _D), ("lastUpdated", _S),
)

HISTORY_LOG = _fields(
    ("log_id", _S), ("motor_id", _S), ("event_ts", _TS), ("motor", _S), ("status", _S),
    ("confidence", _D), ("temperature", _D), ("vibration", _D), ("arrival_seq", _L),
)

SETTINGS = _fields(
    ("company_id", _S), ("temp_threshold", _D), ("vib_threshold", _D), ("calibration", _D),
    ("retention_months", _I), ("temp_unit", _S), ("vib_unit", _S),
)
