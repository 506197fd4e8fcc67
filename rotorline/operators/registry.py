"""Registry upkeep: registering, validating, numbering and removing users and motors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import format_id, id_number
from .latest import first_per


def insert_if_absent(new: DataFrame, base: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of `new` that may be added to `base`: unseen keys, the first row of each.

    The anti join runs after the batch is down to one row per key.
    """
    return first_per(new, keys, order).join(base.select(*keys), list(keys), "left_anti").select(*new.columns)


def union_append(base: DataFrame, rows: DataFrame) -> DataFrame:
    return base.unionByName(rows, allowMissingColumns=True)


def register_users(new: DataFrame, users: DataFrame, order: Sequence[str] = ("created_at",)) -> DataFrame:
    return insert_if_absent(new, users, ["id"], order)


def register_motors(new: DataFrame, motors: DataFrame) -> DataFrame:
    """Valid new motors whose id the company does not have yet, in their inserted form."""
    return insert_if_absent(validate_motors(new), motors, ["company_id", "motor_id"], ["reg_seq"])


_FORM = ("motor_id", "motor_name", "location", "company_id")


def validate_motors(df: DataFrame) -> DataFrame:
    """Rows of the motor form with every field filled in; the typed ones are trimmed."""
    trimmed = df.withColumns({c: F.trim(c) for c in _FORM[:3]})
    filled = [F.nullif(F.col(c), F.lit("")).isNotNull() for c in _FORM]
    return trimmed.where(reduce(lambda a, b: a & b, filled))


def _missing(cols: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))


def validate_required(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rows with all required values, and the others with what they lack."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    rejected = df.where(~complete).withColumn("missing", F.concat_ws(",", _missing(cols)))
    return df.where(complete), rejected


def orphan_readings(readings: DataFrame, motors: DataFrame) -> DataFrame:
    return readings.join(motors.select("motor_id"), "motor_id", "left_anti").select(*readings.columns)


def orphan_motors(motors: DataFrame, users: DataFrame) -> DataFrame:
    return motors.join(
        users.select(F.col("id").alias("company_id")), "company_id", "left_anti"
    ).select(*motors.columns)


def gate_writes(rows: DataFrame, motors: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that may be written: all required values present and the motor registered."""
    valid, _ = validate_required(rows, required)
    return valid.join(motors.select("motor_id"), "motor_id", "left_semi").select(*rows.columns)


def uniqueness_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; as in SQL, a key with a NULL in it never clashes."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def next_motor_id(motors: DataFrame, by: Sequence[str] = ("company_id",)) -> DataFrame:
    """Suggested id per company: one above the largest number at the end of an id."""
    top = F.coalesce(F.max(id_number(F.col("motor_id"))), F.lit(0).cast("bigint"))
    return motors.groupBy(*by).agg(format_id(top + 1).alias("next_motor_id"))


def motor_exists(df: DataFrame, wanted: DataFrame, key: str = "motor_id") -> DataFrame:
    """Each wanted id with whether `df` has it; `df` is reduced to its distinct ids first."""
    seen = df.select(F.col(key)).distinct().withColumn("_seen", F.lit(True))
    return wanted.select(key).distinct().join(seen, key, "left").select(
        key, F.coalesce("_seen", F.lit(False)).alias("found")
    )


def cascade_delete(
    users: DataFrame, motors: DataFrame, readings: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, motors and readings that remain once the given users are removed.

    A reading goes only if no other company still has its motor.
    """
    gone = ids.select("id")
    owner = gone.withColumnRenamed("id", "company_id")
    kept_motors = motors.join(owner, "company_id", "left_anti").select(*motors.columns)
    lost_ids = (
        motors.join(owner, "company_id", "left_semi")
        .select("motor_id")
        .distinct()
        .join(kept_motors.select("motor_id"), "motor_id", "left_anti")
    )
    return (
        users.join(gone, "id", "left_anti").select(*users.columns),
        kept_motors,
        readings.join(lost_ids, "motor_id", "left_anti").select(*readings.columns),
    )
