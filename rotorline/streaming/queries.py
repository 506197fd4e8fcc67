"""The streaming queries.

All take a stream, a target folder and a checkpoint folder and return the started query.
Rows that are only appended go through the file sink, which is exactly-once by its own log, or
into a log of batches (`log.py`); tables that change go through `MergedTable`. Batches may be replayed.

Where a query needs the registry, `motors` may be a function that reads it: it is called for every
batch, so that a motor registered or removed meanwhile counts. A DataFrame stays as it was read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.values import EVENT_DATE
from ..operators.alerts import risk_level
from ..operators.history import append_history
from ..operators.latest import newest_per
from ..operators.series import POINTS, last_points, live_buffer
from ..operators.state import THRESHOLD_MS, apply_messages, changed_only, initial_state
from ..sources.telemetry import malformed_telemetry, parse_telemetry, subscribed, with_messages
from .log import append_batch, read_log
from .merged import MergedTable, read_batches

AVAILABLE_NOW = {"availableNow": True}

BatchFn = Callable[[DataFrame, int], None]
Table = DataFrame | Callable[[], DataFrame]


def _now(table: Table) -> DataFrame:
    return table() if callable(table) else table


def _kept(fn: BatchFn) -> BatchFn:
    """Keep a batch that is used several times; what an executor loses is computed again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            fn(batch, batch_id)
        finally:
            batch.unpersist()

    return run


def _spread(batch: DataFrame) -> DataFrame:
    """The batch in at least as many partitions as there are cores: a few files or offsets would keep a few of them busy."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch if batch.rdd.getNumPartitions() >= cores else batch.repartition(cores)


def on_batch(stream: DataFrame, fn: BatchFn, checkpoint: str, trigger: dict | None = None,
             mode: str = "append") -> StreamingQuery:
    """Call `fn(batch, batch_id)` on every micro-batch; after a failure a batch may come again."""
    return (
        stream.writeStream.foreachBatch(fn)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def _append(stream: DataFrame, target: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start(target)
    )


# --- appended tables ---------------------------------------------------------------------

def _write_log(log: DataFrame, path: str, batch_id: int) -> None:
    """Log rows of a batch under a folder per event date, so that readers of a period skip the rest."""
    append_batch(log.withColumn(EVENT_DATE, F.to_date("event_ts")), path, batch_id, EVENT_DATE)


def stream_history(readings: DataFrame, motors: Table, target: str, checkpoint: str,
                   trigger: dict | None = None) -> StreamingQuery:
    """The history log; read it with `history_log`."""
    return on_batch(readings, lambda batch, i: _write_log(append_history(batch, _now(motors)), target, i), checkpoint, trigger)


def history_log(spark: SparkSession, target: str, schema: T.StructType, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """The rows of the log, with the date by which its folders are pruned.

    Of a period (both days included, a row without a time in none) only the folders of its days are listed.
    """
    def wanted(day: str) -> bool:
        return day[:4].isdigit() and (since is None or day >= since.isoformat()) and (until is None or day <= until.isoformat())

    period = wanted if since is not None or until is not None else None
    return read_log(spark, target, schema, T.StructField(EVENT_DATE, T.DateType()), period).drop("batch_id")


def stream_risk(readings: DataFrame, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return _append(risk_level(readings), target, checkpoint, trigger)


# What a day's averages are made of.
_SUMS = "day date, n long, n_temperature long, sum_temperature double, n_vibration long, sum_vibration double"


def _added(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(*[F.sum(c).alias(c) for c in df.columns if c != "day"])


def _trend_table(spark: SparkSession, path: str, **options) -> MergedTable:
    return MergedTable(path, T.StructType.fromDDL(_SUMS), _added, keys=("day",), order="n", **options)


def stream_daily_trend(readings: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Counts and sums of each day, late readings included; read the averages with `daily_averages`."""
    table = _trend_table(readings.sparkSession, target, **options)

    def store(batch: DataFrame, batch_id: int) -> None:
        daily = batch.groupBy(F.to_date("event_ts").alias("day")).agg(
            F.count(F.lit(1)).alias("n"),
            *[f(name).alias(f"{label}_{name}") for name in ("temperature", "vibration")
              for label, f in (("n", F.count), ("sum", F.sum))])
        table.store(daily, batch_id)

    return on_batch(readings, store, checkpoint, trigger)


def daily_averages(spark: SparkSession, target: str) -> DataFrame:
    """Every day with readings so far, the current one too."""
    return _trend_table(spark, target).read(spark).select(
        "day", "n", *[F.try_divide(f"sum_{c}", f"n_{c}").alias(f"avg_{c}") for c in ("temperature", "vibration")])


# --- state of each motor -----------------------------------------------------------------

def _by_arrival(df: DataFrame) -> DataFrame:
    return newest_per(df, ["motor_id"], ["arrival_seq"])


def state_table(path: str, schema: T.StructType, **options) -> MergedTable:
    return MergedTable(path, schema, _by_arrival, **options)


def _registered(rows: DataFrame, motors: DataFrame) -> DataFrame:
    return rows.join(motors.select("motor_id"), "motor_id", "left_semi")


def stream_latest_state(readings: DataFrame, motors: Table, target: str, checkpoint: str,
                        trigger: dict | None = None, **options) -> StreamingQuery:
    """Last delivered reading of every registered motor; read it with `latest_state` or `fleet_state`."""
    table = state_table(target, readings.schema, **options)

    def store(batch: DataFrame, batch_id: int) -> None:
        table.store(_registered(_by_arrival(batch), _now(motors)), batch_id)

    return on_batch(readings, store, checkpoint, trigger)


def latest_state(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return state_table(target, schema).read(spark)


def fleet_state(spark: SparkSession, target: str, schema: T.StructType, motors: DataFrame) -> DataFrame:
    """State of all motors registered now: of those that never reported, the initial one."""
    ts_type = schema["event_ts"].dataType.simpleString()
    return apply_messages(initial_state(motors, ts_type), latest_state(spark, target, schema))


def remove_from_state(target: str, gone: DataFrame, schema: T.StructType) -> None:
    """Drop motors (motor_id, arrival_seq) from a stored state: what they sent up to that message."""
    state_table(target, schema).remove(gone)


def _points_table(path: str, schema: T.StructType, n: int, **options) -> MergedTable:
    point = T.StructType([schema[c] for c in ("motor_id", "arrival_seq", "event_ts", "temperature", "vibration")])
    return MergedTable(path, point, lambda df: last_points(df, n), **options)


def stream_live_buffer(readings: DataFrame, target: str, checkpoint: str, n: int = POINTS,
                       trigger: dict | None = None, **options) -> StreamingQuery:
    """The last n points of every motor; read them with `buffered`."""
    return on_batch(readings, _points_table(target, readings.schema, n, **options).put, checkpoint, trigger)


def buffered(spark: SparkSession, target: str, schema: T.StructType, n: int = POINTS) -> DataFrame:
    return live_buffer(_points_table(target, schema, n).read(spark), n)


def remove_from_buffer(target: str, gone: DataFrame, schema: T.StructType, n: int = POINTS) -> None:
    """Drop motors (motor_id, arrival_seq) from a stored buffer; the log is kept."""
    _points_table(target, schema, n).remove(gone)


def stream_changed_only(readings: DataFrame, target: str, checkpoint: str,
                        trigger: dict | None = None, **options) -> StreamingQuery:
    """Readings that change the state of their motor, in `target`/changes.

    The last reading before the batch leads each motor's rows, so that the first one of the
    batch has something to be compared with. A reading delivered before that one, which comes
    late in a replayed or reordered topic, no longer changes the state and is left out.
    """
    table = state_table(f"{target}/state", readings.schema, **options)

    def store(batch: DataFrame, batch_id: int) -> None:
        reporting = batch.select("motor_id").distinct()
        seeds = table.read(batch.sparkSession, before=batch_id, only=reporting)
        known = seeds.select("motor_id", F.col("arrival_seq").alias("_known"))
        later = batch.join(known, "motor_id", "left").where("_known is null or arrival_seq > _known").select(*batch.columns)
        both = later.withColumn("_seed", F.lit(False)).unionByName(seeds.withColumn("_seed", F.lit(True)))
        fresh = changed_only(both).where(~F.col("_seed")).drop("_seed")
        append_batch(fresh, f"{target}/changes", batch_id)
        table.put(batch, batch_id)

    return on_batch(readings, _kept(store), checkpoint, trigger)


def changes(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return read_batches(spark, f"{target}/changes", schema)


def stream_ingest(raw: DataFrame, motors: Table, target: str, checkpoint: str, n: int = POINTS,
                  trigger: dict | None = None, **options) -> StreamingQuery:
    """Raw messages of registered topics to state, buffer, history and quarantine in one pass.

    Each result has its own folder of `target`; read them with `latest_state`, `buffered`,
    `history_log` and `batches`.
    """
    schema = parse_telemetry(raw).schema
    state = state_table(f"{target}/state", schema, **options)
    buffer = _points_table(f"{target}/buffer", schema, n, **options)

    def store(batch: DataFrame, batch_id: int) -> None:
        registry = _now(motors)
        delivered = with_messages(subscribed(_spread(batch), registry)).persist()
        readings = parse_telemetry(delivered)
        try:
            state.store(_registered(_by_arrival(readings), registry), batch_id)
            buffer.put(readings, batch_id)
            _write_log(append_history(readings, registry), f"{target}/history", batch_id)
            append_batch(malformed_telemetry(delivered), f"{target}/quarantine", batch_id)
        finally:
            delivered.unpersist()

    return on_batch(raw, store, checkpoint, trigger)


def batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that batches have written to a folder."""
    return read_batches(spark, path, schema).drop("batch_id")


def stream_motor_changes(motors: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("company_id", "motor_id"),
                         order: str = "arrival_seq", trigger: dict | None = None, **options) -> StreamingQuery:
    """Registry rows whose content differs from the one stored before, in `target`/changes.

    A row that is older than the stored one of its key is no change.
    """
    values = [c for c in motors.columns if c not in (*keys, order)]

    def newest(df: DataFrame) -> DataFrame:
        return newest_per(df, list(keys), [order])

    table = MergedTable(f"{target}/state", motors.schema, newest, keys=keys, order=order, **options)

    def store(batch: DataFrame, batch_id: int) -> None:
        before = table.read(batch.sparkSession, before=batch_id, only=batch.select(*keys).distinct())
        old = before.select(*keys, F.struct(*values).alias("_old"), F.col(order).alias("_order"))
        joined = newest(batch).join(old, list(keys), "left")
        later = F.col("_order").isNull() | (F.col(order) > F.col("_order"))
        changed = joined.where(later & ~F.struct(*values).eqNullSafe(F.col("_old"))).select(*motors.columns)
        append_batch(changed, f"{target}/changes", batch_id)
        table.put(batch, batch_id)

    return on_batch(motors, _kept(store), checkpoint, trigger)


def subscribe_readings(readings: DataFrame, motor: str, fn: BatchFn, target: str, checkpoint: str,
                       trigger: dict | None = None, **options) -> StreamingQuery:
    """Call `fn` on each change with all readings of one motor so far, newest first.

    They are kept in `target`; a batch without a reading of the motor calls nothing.
    """
    table = MergedTable(target, readings.schema, lambda df: df, **options)

    def store(batch: DataFrame, batch_id: int) -> None:
        table.store(batch, batch_id)
        if not batch.isEmpty():
            so_far = table.read(batch.sparkSession, before=batch_id + 1)
            fn(so_far.orderBy(F.col("event_ts").desc(), F.col("reading_id").desc()), batch_id)

    return on_batch(readings.where(F.col("motor_id") == motor), _kept(store), checkpoint, trigger)


# --- liveness ----------------------------------------------------------------------------

CONNECTION = "motor_id string, connection string, last_ms long"


def _newest_per_block(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per motor of each Arrow block, so that a busy motor sends few rows on."""
    for block in blocks:
        yield block.loc[block.groupby("motor_id")["arrival_seq"].idxmax()]


def _track(threshold_ms: int, forget_ms: int | None):
    """State of a motor: its last message by arrival, when it was sent, and the last verdict.

    A disconnected motor keeps its state, for `forget_ms` if that is given, so that an older message
    which comes later does not connect it again.
    """

    def track(key: tuple, blocks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def out(connection: str, last_ms: int) -> pd.DataFrame:
            return pd.DataFrame({"motor_id": [key[0]], "connection": [connection], "last_ms": [last_ms]})

        seq, last_ms, off, was = state.get if state.exists else (-1, 0, False, None)
        if state.hasTimedOut and was == "Disconnected":
            state.remove()
            return
        if not state.hasTimedOut:
            for block in blocks:
                row = block.loc[block["arrival_seq"].idxmax()]
                if row["arrival_seq"] > seq:
                    seq, last_ms, off = int(row["arrival_seq"]), int(row["ms"]), bool(row["off"])
        left = threshold_ms - (state.getCurrentProcessingTimeMs() - last_ms)
        now = "Disconnected" if off or left <= 0 else "Connected"
        state.update((seq, last_ms, off, now))
        if now == "Connected" or forget_ms is not None:
            state.setTimeoutDuration(left if now == "Connected" else forget_ms)
        if now != was:
            yield out(now, last_ms)

    return track


def stream_connection_timeout(readings: DataFrame, target: str, checkpoint: str, threshold_ms: int = THRESHOLD_MS,
                              trigger: dict | None = None, forget_ms: int | None = None) -> StreamingQuery:
    """Liveness changes: a motor turns Disconnected `threshold_ms` after its last message.

    The change comes from a timer, without a further message. Only changes are written; read them
    with `batches`. The state of a motor is a few numbers, kept for good: an older message connects
    nobody, however late it comes. `forget_ms` lets go of motors that were disconnected for so long.
    """
    slim = readings.select(
        "motor_id", "arrival_seq", F.unix_millis(F.col("event_ts").cast("timestamp")).alias("ms"),
        F.col("status").isin("Disconnected", "Unknown").alias("off"),
    )
    tracked = (
        slim.mapInPandas(_newest_per_block, slim.schema)
        .groupBy("motor_id")
        .applyInPandasWithState(
            _track(threshold_ms, forget_ms), CONNECTION, "seq long, last_ms long, off boolean, verdict string", "update",
            GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
    store = lambda batch, batch_id: append_batch(batch, target, batch_id)
    return on_batch(tracked, store, checkpoint, trigger or {"processingTime": "1 second"}, mode="update")
