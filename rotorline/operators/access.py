"""Who may see what, and the way from a user to motors to readings.

Joins of readings with the registry carry no broadcast hint, because the registry grows with
the fleet: Spark broadcasts it while its size is below the limit and otherwise shuffles, and
adaptive execution splits the partition of a busy motor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_spans


def rls_users(users: DataFrame, uid: str) -> DataFrame:
    return users.where(F.col("id") == uid)


def rls_motors(motors: DataFrame, uid: str) -> DataFrame:
    return motors.where(F.col("company_id") == uid)


def rls_sensor_data(rows: DataFrame, motors: DataFrame, uid: str) -> DataFrame:
    """Rows of the caller's motors, each once."""
    own = rls_motors(motors, uid).select("motor_id")
    return rows.join(own, "motor_id", "left_semi").select(*rows.columns)


def rls_fanout(rows: DataFrame, motors: DataFrame) -> DataFrame:
    """The same rule for all companies at once: one row per company that may see it."""
    owners = motors.select("motor_id", "company_id").distinct()
    return rows.join(owners, "motor_id").select("company_id", *rows.columns)


def _with_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join whose right side may be skewed.

    Adaptive execution cannot split the right side of an outer join, so this is an inner join,
    of which it splits either side, and the left rows without a partner.
    """
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    return left.join(right, key).unionByName(unmatched, allowMissingColumns=True)


def fleet_rollup(users: DataFrame, motors: DataFrame, readings: DataFrame) -> DataFrame:
    """Every user with every motor and a summary of its readings (zero for none).

    Readings are aggregated per motor before the joins.
    """
    per_motor = readings.groupBy("motor_id").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.min("event_ts").alias("first_event_ts"),
        F.max("event_ts").alias("last_event_ts"),
    )
    owned = motors.select(F.col("company_id").alias("id"), "motor_id", "motor_name")
    return (
        _with_all(users.select("id", "name"), owned, "id")
        .join(per_motor, "motor_id", "left")
        .select(
            F.col("id").alias("user_id"), "name", "motor_id", "motor_name",
            F.coalesce("n_readings", F.lit(0).cast("bigint")).alias("n_readings"),
            "first_event_ts", "last_event_ts",
        )
    )


def fleet_tree(users: DataFrame, motors: DataFrame, readings: DataFrame, part_rows: int = 1_000, parts: int = 16) -> DataFrame:
    """Users with their motors and the readings of these, nested, in documents of bounded size.

    user_id, name, document, motors: an array of (motor_id, motor_name, part, readings), and readings
    an array of (reading_id, event_ts, temperature, vibration) in order. The readings of a motor are
    cut, in order of reading_id, into parts of `part_rows`; a motor without readings has an empty
    part 0. A user's parts are dealt to documents of about `parts`; a user without motors has an empty
    document 0. So a busy motor lies in many parts, a large company in many documents, and no array
    holds either whole. `reading_id` is unique in a motor.
    """
    rows = readings.select("motor_id", "reading_id", "event_ts", "temperature", "vibration")
    in_span = Window.partitionBy("motor_id", "_span").orderBy("reading_id")
    numbered = with_spans(rows, ["motor_id"], "reading_id").withColumn(
        "part", F.floor((F.row_number().over(in_span) - 1) / part_rows))
    cut = numbered.groupBy("motor_id", "_span", "part").agg(
        F.sort_array(F.collect_list(F.struct("reading_id", "event_ts", "temperature", "vibration"))).alias("readings"))
    # Parts are few: numbered through the spans of a motor, then joined and dealt.
    through = Window.partitionBy("motor_id").orderBy("_span", "part")
    cut = cut.select("motor_id", (F.row_number().over(through) - 1).alias("part"), "readings")
    owned = motors.select(F.col("company_id").alias("user_id"), "motor_id", "motor_name")
    reported = _with_all(owned, cut, "motor_id").withColumn("part", F.coalesce("part", F.lit(0)))
    documents = reported.groupBy("user_id").agg(F.ceil(F.count("*") / parts).alias("documents"))
    dealt = reported.join(documents, "user_id").withColumn("document", F.pmod(F.xxhash64("motor_id", "part"), F.col("documents")))
    nested = dealt.groupBy("user_id", "document").agg(F.sort_array(F.collect_list(F.struct(
        "motor_id", "motor_name", "part", F.coalesce("readings", F.array().cast(cut.schema["readings"].dataType)).alias("readings")))).alias("motors"))
    whole = _with_all(users.select(F.col("id").alias("user_id"), "name"), nested, "user_id")
    return whole.select("user_id", "name", F.coalesce("document", F.lit(0)).alias("document"),
                        F.coalesce("motors", F.array().cast(nested.schema["motors"].dataType)).alias("motors"))


def fleet_navigation(users: DataFrame, motors: DataFrame, readings: DataFrame) -> DataFrame:
    """Every (user, motor, reading), keeping users without motors and motors without readings."""
    by_owner = motors.select(F.col("company_id").alias("user_id"), "motor_id")
    owned = _with_all(users.select(F.col("id").alias("user_id")), by_owner, "user_id")
    reported = _with_all(owned, readings.select("motor_id", "reading_id"), "motor_id")
    return reported.select("user_id", "motor_id", "reading_id")
