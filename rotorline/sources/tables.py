"""Table scans, projections between shapes, saved state, appends and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.values import EVENT_DATE, finite_or_null
from . import folders


def scan(table: DataFrame, cols: Sequence[str] | None = None, eq: Mapping[str, object] | None = None) -> DataFrame:
    """Chosen columns of the rows that equal every given value; both reach the file scan."""
    out = table
    for name, value in (eq or {}).items():
        out = out.where(F.col(name) == F.lit(value))
    return out.select(*cols) if cols else out


def canonical(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep and rename the mapped columns only ({old: new})."""
    return df.select([F.col(old).alias(new) for old, new in mapping.items()])


def _snake(name: str) -> str:
    return "".join("_" + ch.lower() if ch.isupper() else ch for ch in name)


def record_sensor_data(df: DataFrame, recorded_at: Column | None = None) -> DataFrame:
    """Wide camel-case sensor records as `sensor_data` rows, stamped with the time of writing."""
    renamed = df.withColumnsRenamed({c: _snake(c) for c in df.columns})
    return renamed.withColumn("event_ts", F.current_timestamp() if recorded_at is None else recorded_at)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_by_date(rows: DataFrame, path: str) -> None:
    """Append readings, sensor data or log rows under a folder per date.

    Rows are rebalanced by date, so that a date gets files of a good size instead of one from
    every task, and a very full date is split; sorting by motor lets readers of one motor skip.
    """
    dated = rows.withColumn(EVENT_DATE, F.to_date("event_ts")).hint("rebalance", EVENT_DATE)
    append(dated.sortWithinPartitions(EVENT_DATE, "motor_id"), path, [EVENT_DATE])


def newest_event(spark: SparkSession, path: str) -> Column:
    """The newest event time of a table that is stored by date, as a literal; NULL for an empty one.

    The names of the folders tell the last date, and rows of that folder alone are read. As a literal
    it prunes the dates of whatever is compared with it.
    """
    key = f"{EVENT_DATE}="
    dates = [n for n in folders.names(spark, path) if n.startswith(key) and n[len(key):len(key) + 1].isdigit()]
    for name in sorted(dates, reverse=True):  # the first, unless its rows were deleted
        rows = spark.read.schema("event_ts timestamp_ntz").parquet(f"{path}/{name}")
        newest = rows.agg(F.max("event_ts")).first()[0]
        if newest is not None:
            return F.lit(newest).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _from_iso(text: Column) -> Column:
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def to_saved(state: DataFrame) -> DataFrame:
    """State rows as JSON text, one motor of one company to a line, times in ISO form."""
    record = F.struct(
        F.col("motor_id").alias("id"), F.col("company_id").alias("companyId"), F.col("motor_name").alias("name"), "location",
        _iso(F.col("installed_at")).alias("installedAt"), F.col("reg_seq").alias("regSeq"), "temperature", "vibration",
        "status", "confidence", _iso(F.col("last_updated")).alias("lastUpdated"),
    )
    return state.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


VERSION = "version"


def save_state(state: DataFrame, path: str) -> int:
    """Write the state as a new version beside the older ones; a failed write leaves those readable.

    Of the older versions the newest complete one stays.
    """
    spark = state.sparkSession
    before = folders.complete(spark, path, VERSION)
    number = before[-1] + 1 if before else 0
    to_saved(state).write.mode("overwrite").text(f"{path}/{VERSION}={number}")
    for old in before[:-1]:
        folders.delete(spark, f"{path}/{VERSION}={old}")
    return number


def restore_state(saved: DataFrame) -> DataFrame:
    """Saved JSON lines back as state; a value of the wrong type reads as NULL (confidence as 0)."""
    s = F.from_json(F.col("value"), schemas.SAVED_MOTOR, {"allowNonNumericNumbers": "false"})
    return saved.select(s.alias("s")).select(
        F.col("s.id").alias("motor_id"),
        F.col("s.companyId").alias("company_id"),
        F.col("s.name").alias("motor_name"),
        F.col("s.location").alias("location"),
        _from_iso(F.col("s.installedAt")).alias("installed_at"),
        F.col("s.regSeq").alias("reg_seq"),
        finite_or_null(F.col("s.temperature")).alias("temperature"),
        finite_or_null(F.col("s.vibration")).alias("vibration"),
        F.col("s.status").alias("status"),
        F.coalesce(finite_or_null(F.col("s.confidence")), F.lit(0.0)).alias("confidence"),
        _from_iso(F.col("s.lastUpdated")).alias("last_updated"),
    )


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    versions = folders.complete(spark, path, VERSION)
    if not versions:
        raise FileNotFoundError(f"no saved state in {path}")
    return restore_state(spark.read.text(f"{path}/{VERSION}={versions[-1]}"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns, which CSV cannot hold, are written as JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(flat).write.mode("overwrite").option("header", True).csv(path)


def explode_tree(tree: DataFrame, value_schema: T.StructType) -> DataFrame:
    """Keyed JSON subtrees (column `value`) as rows, the key becoming `id`."""
    entries = F.from_json(F.col("value"), T.MapType(T.StringType(), value_schema))
    return tree.select(F.explode(entries).alias("id", "node")).select("id", "node.*")


def single(df: DataFrame, required: bool = True) -> DataFrame:
    """The only row of a result: an error for more than one and, if required, for none."""
    packed = df.limit(2).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*df.columns)).alias("r"))
    if required:
        fail, keep = F.col("n") != 1, F.lit(True)
    else:
        fail, keep = F.col("n") > 1, F.col("n") > 0
    checked = F.when(fail, F.raise_error(F.lit("expected a single row"))).otherwise(F.col("r"))
    return packed.where(keep).select(checked.alias("r")).select("r.*")


def maybe_single(df: DataFrame) -> DataFrame:
    return single(df, required=False)
