"""The fleet's tables derived from the given parquet tables, whole.

Companies come from `supplier`, motors from `customer`, readings and messages from `events`;
every one of them grows with the scale factor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import format_id, topic_of

MOTORS_PER_COMPANY = 14

# The given tables, declared so that no job runs to infer them.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def motor_key(number: str) -> Column:
    return format_id(F.col(number) + 1)


def company_key(number: Column) -> Column:
    return F.concat(F.lit("company_"), number.cast("string"))


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _div(number: str, by: int) -> Column:
    return F.floor(F.col(number) / by)


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        company_key(F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("owner"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
        _ntz("2023-01-01 00:00:00").alias("created_at"),
    )


def signups(spark: SparkSession, d: str) -> DataFrame:
    """Registrations to come: repeated, partly known ids and emails used more than once."""
    return table(spark, d, "customer").select(
        company_key(_div("c_custkey", 10)).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(
            F.lit("owner"), _div("c_custkey", 10).cast("string"), F.lit("."), F.lower("c_mktsegment"),
            F.lit("@example.com"),
        ).alias("email"),
        (_ntz("2024-01-01 00:00:00") + F.expr("make_dt_interval(0, 0, 0, 1) * c_custkey")).alias("created_at"),
    )


def _motor_rows(customers: DataFrame, company: Column, name: Column, seq: Column) -> DataFrame:
    return customers.select(
        motor_key("c_custkey").alias("motor_id"),
        company_key(company).alias("company_id"),
        name.alias("motor_name"),
        F.col("c_mktsegment").alias("location"),
        F.when(F.col("c_custkey") % 7 != 0, _ntz("2023-06-01 08:00:00")).alias("installed_at"),
        seq.alias("reg_seq"),
    )


def new_motors(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's motor as a filled-in form, registered already or not."""
    name = F.when(F.col("c_custkey") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_name")))
    return _motor_rows(table(spark, d, "customer"), _div("c_custkey", MOTORS_PER_COMPANY), name, F.col("c_custkey"))


def motors(spark: SparkSession, d: str) -> DataFrame:
    """The registry: motors of accounts in credit, and those in machinery registered twice."""
    customers = table(spark, d, "customer")
    own = _div("c_custkey", MOTORS_PER_COMPANY)
    first = _motor_rows(customers.where("c_acctbal >= 0"), own, F.col("c_name"), F.col("c_custkey") * 2)
    shared = customers.where((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") != own))
    second = _motor_rows(
        shared, F.col("c_nationkey"), F.concat(F.lit("Shared "), F.col("c_name")), F.col("c_custkey") * 2 + 1
    )
    return first.unionByName(second)


def departed_users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_acctbal < 1000").select(company_key(F.col("s_suppkey")).alias("id"))


def retired_motors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal >= 8000").select(motor_key("c_custkey").alias("motor_id"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


STATUS_OF = {"view": "Healthy", "click": "healthy", "purchase": "Warning", "error": "Fault"}


def readings_of(rows: DataFrame) -> DataFrame:
    """Readings from events; row-wise, so it serves a stream as well."""
    status = reduce(
        lambda c, kv: c.when(F.col("event_type") == kv[0], kv[1]), list(STATUS_OF.items())[1:],
        F.when(F.col("event_type") == "view", STATUS_OF["view"]),
    ).otherwise("Unknown")
    k = F.col("k").cast("double")
    return rows.withColumn("k", _k()).select(
        F.col("event_id").alias("reading_id"),
        motor_key("user_id").alias("motor_id"),
        F.col("ts").alias("event_ts"),
        (F.col("event_id") + F.when(F.col("event_id") % 10 == 0, 2500).otherwise(0)).alias("arrival_seq"),
        F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("temperature"),
        (k / 1000).alias("vibration"),
        status.alias("status"),
        F.when(F.col("event_type") == "signup", 0.0).otherwise(k).alias("confidence"),
    )


def readings(spark: SparkSession, d: str) -> DataFrame:
    return readings_of(events(spark, d))


def deliveries_of(rows: DataFrame) -> DataFrame:
    """Readings as delivered: strong faults come a second time, later."""
    base = readings_of(rows).withColumn("arrival_seq", F.col("arrival_seq") * 2)
    again = (F.col("status") == "Fault") & (F.col("vibration") > 0.08)
    copies = F.when(again, F.array(F.lit(0), F.lit(7001))).otherwise(F.array(F.lit(0)))
    return (
        base.withColumn("_late", F.explode(copies))
        .withColumn("arrival_seq", F.col("arrival_seq") + F.col("_late"))
        .drop("_late")
    )


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    return deliveries_of(events(spark, d))


def repeats(spark: SparkSession, d: str) -> DataFrame:
    """Readings each delivered twice in a row, the second time with a new sequence number."""
    return readings(spark, d).withColumn("arrival_seq", F.explode(F.array(
        F.col("arrival_seq") * 2, F.col("arrival_seq") * 2 + 1
    )))


def telemetry_of(rows: DataFrame) -> DataFrame:
    """Raw messages: malformed, without id, with id 0, odd numbers, no time, missing, empty or false status."""
    eid = F.col("event_id")
    k = F.col("k").cast("string")
    temperature = F.when(eid % 71 == 0, "n/a").otherwise(F.col("value").cast("decimal(10,2)").cast("string"))
    suffix = F.when(eid % 83 == 0, "abc").otherwise("")
    seconds = F.when(eid % 79 == 0, "0").otherwise(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    status = (
        F.when(F.col("event_type") == "signup", "")
        .when(F.col("event_type") == "view", ',"status":""')
        .when(eid % 13 == 0, ',"status":false')
        .otherwise(F.concat(F.lit(',"status":"Fault","confidence":'), k))
    )
    message = F.concat(
        F.lit('{"motor_id":"'), motor_key("user_id"), F.lit('","temperature":"'), temperature, suffix,
        F.lit('","vibration":0.0'), F.lpad(k, 2, "0"), F.lit(',"timestamp":'), seconds, status, F.lit("}"),
    )
    return rows.withColumn("k", _k()).select(
        eid.alias("arrival_seq"),
        topic_of(motor_key("user_id")).alias("topic"),
        F.when(eid % 97 == 0, "{bad").when(eid % 89 == 0, '{"temperature":20.5}')
        .when(eid % 101 == 0, '{"motor_id":0,"temperature":20.5}').when(eid % 103 == 0, F.concat(message, F.lit("] junk")))
        .otherwise(message).alias("payload"),
        F.col("ts").alias("arrival_ts"),
    )


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    return telemetry_of(events(spark, d))


# Column, factor, modulus, shift and divisor of each axis.
AXES = (
    ("acceleration_x", 7, 400, 200, 100), ("acceleration_y", 11, 400, 200, 100),
    ("acceleration_z", 13, 400, 200, 100), ("gyro_x", 17, 400, 200, 100), ("gyro_y", 19, 400, 200, 100),
    ("gyro_z", 23, 400, 200, 100), ("amplitude", 29, 1000, 0, 100), ("angular_velocity", 31, 3000, 0, 10),
)


def sensor_data(spark: SparkSession, d: str) -> DataFrame:
    eid = F.col("event_id")
    axes = {
        name: (eid * factor % modulus - shift).cast("double") / divisor
        for name, factor, modulus, shift, divisor in AXES
    }
    axes["angular_velocity"] = F.when(eid % 40 != 0, axes["angular_velocity"])
    return events(spark, d).select(
        eid.alias("id"), motor_key("user_id").alias("motor_id"),
        *[c.alias(name) for name, c in axes.items()],
        F.col("value").alias("temperature"), F.col("ts").alias("event_ts"),
    )


def settings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        company_key(F.col("s_suppkey")).alias("company_id"),
        (n + 30).cast("double").alias("temp_threshold"),
        (n.cast("double") / 250).alias("vib_threshold"),
        (n % 5 - 2).cast("double").alias("calibration"),
        (n % 3 + 1).alias("retention_months"),
        F.when(n % 2 == 0, "C").otherwise("F").alias("temp_unit"),
        F.when(n % 2 == 0, "g").otherwise("ms2").alias("vib_unit"),
    )


def saved_motors(spark: SparkSession, d: str) -> DataFrame:
    """Saved JSON of every motor: numbers, text in their place, missing and odd values."""
    key = F.col("c_custkey")
    number = F.col("c_acctbal").cast("decimal(10,2)").cast("string")
    temperature = (
        F.when(key % 3 == 0, number).when(key % 3 == 1, F.concat(F.lit('"'), number, F.lit('"'))).otherwise("null")
    )
    confidence = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(',"confidence":'), (key % 100).cast("string")))
    updated = F.when(key % 5 == 0, "null").when(key % 5 == 1, '""').otherwise('"2024-01-30T10:20:30.500Z"')
    company = F.concat(F.lit(',"companyId":"'), company_key(_div("c_custkey", MOTORS_PER_COMPANY)), F.lit('"'))
    installed = F.when(key % 6 == 0, "").otherwise(',"installedAt":"2023-06-01T08:00:00.000Z"')
    registered = F.when(key % 8 == 0, ',"regSeq":"none"').otherwise(F.concat(F.lit(',"regSeq":'), (key * 2).cast("string")))
    return table(spark, d, "customer").select(
        F.concat(
            F.lit('{"id":"'), motor_key("c_custkey"), F.lit('","name":"'), F.col("c_name"),
            F.lit('","location":"'), F.col("c_mktsegment"), F.lit('","temperature":'), temperature,
            F.lit(',"vibration":0.0'), F.lpad((key % 100).cast("string"), 2, "0"),
            company, installed, registered, F.lit(',"status":"Healthy"'), confidence, F.lit(',"lastUpdated":'), updated, F.lit("}"),
        ).alias("value")
    )


TREE_NODE = T.StructType([
    T.StructField("motorId", T.StringType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Keyed subtrees with two records each, one per event."""
    eid = F.col("event_id").cast("string")
    number = F.col("value").cast("decimal(10,2)").cast("string")

    def node(key: str, ts: Column) -> Column:
        return F.concat(
            F.lit(f'"{key}'), eid, F.lit('":{"motorId":"'), motor_key("user_id"), F.lit('","temperature":'),
            number, F.lit(',"timestamp":'), ts.cast("string"), F.lit("}"),
        )

    return events(spark, d).select(
        F.concat(F.lit("{"), node("a", F.col("event_id") * 2), F.lit(","), node("b", F.col("event_id") * 2 + 1),
                 F.lit("}")).alias("value")
    )
