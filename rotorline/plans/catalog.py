"""Every registered query: a callable of (spark, folder of the given tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, values
from ..operators import access, alerts, history, latest, overview, registry, series, state
from ..schemas import SENSOR_AXES
from ..session import shared_dir, tune
from ..sources import tables, telemetry, trees, versioned
from ..streaming import queries as streams
from ..streaming.sources import landing
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

COMPANY = "company_1"
MOTOR = "MOTOR-002"
LIVE_MS = 6 * 60 * 60 * 1000
NOT_READ = ["reg_seq", "installed_at"]


def query(name: str):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        return fn

    return register


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _state(s: SparkSession, d: str) -> DataFrame:
    return state.motor_state(fx.motors(s, d), fx.deliveries(s, d))


def _log(s: SparkSession, d: str) -> DataFrame:
    return history.append_history(fx.deliveries(s, d), fx.motors(s, d))


def _buffer(s: SparkSession, d: str) -> DataFrame:
    return series.live_buffer(fx.deliveries(s, d))


# Averages of doubles depend in their last digits on the order of the rows. The operators return
# them as they are; the queries cut them to steps of 10^-6, so that results can be compared. The
# shift keeps averages that are short decimals, as many are, away from the edges of the steps.
AVERAGE_SCALE, AVERAGE_SHIFT = 1e6, 0.4871


def _comparable(df: DataFrame) -> DataFrame:
    """The frame with its averages cut to steps."""
    def cut(name: str) -> Column:
        return F.floor(F.col(name) * AVERAGE_SCALE + AVERAGE_SHIFT) / AVERAGE_SCALE

    return df.withColumns({c: cut(c) for c in df.columns if c.startswith("avg_")})


def _now(s: SparkSession, d: str) -> Column:
    """The newest event time, as a subquery inside the plan."""
    return fx.events(s, d).agg(F.max("ts")).scalar()


def _scratch(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _dated(df: DataFrame) -> T.StructType:
    """The schema of the frame stored by date."""
    return T.StructType([*df.schema.fields, T.StructField("event_date", T.DateType())])


# --- scans, sources, sinks -----------------------------------------------------------------

@query("parse_telemetry")
def _(s, d):
    return _ntz(telemetry.parse_telemetry(fx.telemetry(s, d)), "event_ts")


@query("malformed_telemetry")
def _(s, d):
    return telemetry.malformed_telemetry(fx.telemetry(s, d)).select("arrival_seq", "topic", "payload")


@query("topic_route")
def _(s, d):
    routed = telemetry.with_topic_motor(fx.telemetry(s, d))
    back = ids.topic_of(F.col("topic_motor_id"))
    return routed.select("arrival_seq", "topic_motor_id", back.alias("topic"))


@query("subscribed_stream")
def _(s, d):
    return telemetry.subscribed(fx.telemetry(s, d), fx.motors(s, d)).select("arrival_seq", "topic", "payload")


@query("subscription_diff")
def _(s, d):
    wanted = fx.motors(s, d).select(ids.topic_of(F.col("motor_id")).alias("topic"))
    return telemetry.subscription_diff(fx.telemetry(s, d), wanted)


@query("scan_motors")
def _(s, d):
    cols = ["motor_id", "company_id", "location", "motor_name", "installed_at"]
    return tables.scan(fx.motors(s, d), cols, {"company_id": COMPANY})


@query("scan_all_columns")
def _(s, d):
    return tables.scan(fx.sensor_data(s, d), eq={"motor_id": MOTOR})


@query("filter_eq")
def _(s, d):
    return tables.scan(fx.motors(s, d), ["motor_id"], {"company_id": COMPANY, "location": "MACHINERY"})


@query("explode_tree")
def _(s, d):
    return tables.explode_tree(fx.tree(s, d), fx.TREE_NODE)


@query("explode_tree_files")
def _(s, d):
    path = _scratch(s, "trees")
    fx.tree(s, d).write.text(path)
    return tables.explode_tree(trees.read_trees(s, path), fx.TREE_NODE)


@query("restore_state")
def _(s, d):
    return _ntz(tables.restore_state(fx.saved_motors(s, d)), "last_updated", "installed_at")


@query("save_state")
def _(s, d):
    path = _scratch(s, "state")
    tables.save_state(_state(s, d), path)
    return _ntz(tables.load_state(s, path), "last_updated", "installed_at")


@query("append_history")
def _(s, d):
    return _log(s, d)


@query("append_by_date")
def _(s, d):
    path = _scratch(s, "log")
    log = _log(s, d)
    tables.append_by_date(log, path)
    return s.read.schema(log.schema).parquet(path).groupBy("motor").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_ts").alias("last_event_ts")
    )


@query("record_sensor_data")
def _(s, d):
    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(part.capitalize() for part in rest)

    sensor = fx.sensor_data(s, d).drop("event_ts")
    record = sensor.withColumnsRenamed({c: camel(c) for c in sensor.columns})
    return tables.record_sensor_data(record, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("register_motors")
def _(s, d):
    return registry.register_motors(fx.new_motors(s, d), fx.motors(s, d))


@query("register_motors_committed")
def _(s, d):
    """Two writers with the same forms, of whom the second commits while the first is at work."""
    path, new, motors = _scratch(s, "registry"), fx.new_motors(s, d), fx.motors(s, d)
    base = versioned.add(s, path, motors.schema, lambda none: motors)

    def second(rows: DataFrame) -> DataFrame:
        return registry.register_motors(new, rows)

    def first(rows: DataFrame) -> DataFrame:
        versioned.add(s, path, motors.schema, second)
        return registry.register_motors(new, rows)

    versioned.add(s, path, motors.schema, first)
    return versioned.read(s, path, motors.schema).exceptAll(versioned.read(s, path, motors.schema, base))


@query("register_users")
def _(s, d):
    return registry.register_users(fx.signups(s, d), fx.users(s, d))


@query("export_csv")
def _(s, d):
    path = _scratch(s, "csv")
    out = fx.readings(s, d).select("reading_id", "motor_id", "temperature", "vibration", "status")
    tables.export_csv(out, path)
    return s.read.option("header", True).schema(out.schema).csv(path)


# --- projections, filters, predicates --------------------------------------------------------

@query("project_rename")
def _(s, d):
    return tables.canonical(
        fx.motors(s, d), {"motor_id": "id", "motor_name": "name", "location": "location", "company_id": "companyId"}
    )


@query("display_last_updated")
def _(s, d):
    shown = state.display_last_updated(_state(s, d))
    return shown.select("company_id", "motor_id", "display_last_updated")


@query("history_filter")
def _(s, d):
    return history.history_filter(
        _log(s, d), fx.motors(s, d), start="2024-01-05", end="2024-01-20", status="Healthy"
    )


@query("history_filter_end_of_day")
def _(s, d):
    return history.history_filter(
        _log(s, d), fx.motors(s, d), start="2024-01-05", end="2024-01-20", end_of_day=True
    )


@query("history_filter_motor")
def _(s, d):
    return history.history_filter(_log(s, d), fx.motors(s, d), motor="Customer#000000001")


@query("risk_level")
def _(s, d):
    return alerts.risk_level(fx.readings(s, d)).select("reading_id", "temperature", "vibration", "risk_level")


@query("effectively_disconnected")
def _(s, d):
    gone = series.effectively_disconnected(F.col("status"), F.col("temperature"), F.col("vibration"))
    return _state(s, d).select("company_id", "motor_id", gone.alias("disconnected"))


@query("live_card")
def _(s, d):
    return series.live_card(_state(s, d)).select(
        "company_id", "motor_id", "disconnected", "shown_temperature", "shown_vibration"
    )


REQUIRED = ("motor_id", *SENSOR_AXES, "event_ts")


@query("validate_required")
def _(s, d):
    return registry.validate_required(fx.sensor_data(s, d), REQUIRED)[0]


@query("validate_required_rejected")
def _(s, d):
    return registry.validate_required(fx.sensor_data(s, d), REQUIRED)[1].select("id", "motor_id", "missing")


@query("validate_motor_form")
def _(s, d):
    return registry.validate_motors(fx.new_motors(s, d)).drop(*NOT_READ)


@query("connection_status")
def _(s, d):
    out = state.connection_status(_state(s, d), _now(s, d), LIVE_MS)
    return out.select("company_id", "motor_id", "connection")


@query("status_class")
def _(s, d):
    return alerts.status_class(_state(s, d)).select("company_id", "motor_id", "status", "status_class")


@query("threshold_alerts")
def _(s, d):
    out = alerts.threshold_alerts(fx.readings(s, d), fx.motors(s, d), fx.settings(s, d))
    return out.select("company_id", "reading_id", "motor_id", "temperature", "vibration", "over_temperature",
                      "over_vibration")


@query("alert_feed")
def _(s, d):
    return alerts.alert_feed(fx.readings(s, d))


@query("retention_filter")
def _(s, d):
    as_of = F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")
    return alerts.retention_filter(fx.readings(s, d), as_of, 1)


@query("retention_filter_by_company")
def _(s, d):
    with_prefs = alerts.with_settings(fx.readings(s, d), fx.motors(s, d), fx.settings(s, d))
    as_of = F.lit("2024-03-15 00:00:00").cast("timestamp_ntz")
    return alerts.retention_filter(with_prefs, as_of, F.col("retention_months")).select(
        "company_id", "reading_id", "motor_id", "event_ts", "retention_months"
    )


# --- joins -----------------------------------------------------------------------------------

@query("rls_users")
def _(s, d):
    return access.rls_users(fx.users(s, d), COMPANY)


@query("rls_motors")
def _(s, d):
    return access.rls_motors(fx.motors(s, d), COMPANY)


@query("rls_sensor_data")
def _(s, d):
    return access.rls_sensor_data(fx.sensor_data(s, d), fx.motors(s, d), COMPANY)


@query("rls_fanout")
def _(s, d):
    return access.rls_fanout(fx.readings(s, d), fx.motors(s, d))


@query("motor_name_lookup")
def _(s, d):
    return history.motor_name_lookup(fx.readings(s, d), fx.motors(s, d)).select("reading_id", "motor_id", "motor")


@query("history_known_motors")
def _(s, d):
    return history.known_motors(_log(s, d), fx.motors(s, d)).select("log_id", "motor")


@query("insert_if_absent")
def _(s, d):
    twice = F.explode(F.array(F.col("reg_seq") + 1_000_000_000, F.col("reg_seq")))
    new = fx.new_motors(s, d).withColumn("reg_seq", twice)
    return registry.insert_if_absent(new, fx.motors(s, d), ["motor_id"], ["reg_seq"])


@query("orphan_readings")
def _(s, d):
    return registry.orphan_readings(fx.readings(s, d), fx.motors(s, d))


@query("orphan_motors")
def _(s, d):
    return registry.orphan_motors(fx.motors(s, d), fx.users(s, d))


@query("gate_writes")
def _(s, d):
    return registry.gate_writes(fx.sensor_data(s, d), fx.motors(s, d), REQUIRED)


@query("fleet_rollup")
def _(s, d):
    return access.fleet_rollup(fx.users(s, d), fx.motors(s, d), fx.readings(s, d))


@query("fleet_tree")
def _(s, d):
    """The documents, told row by row: where each reading lies."""
    tree = access.fleet_tree(fx.users(s, d), fx.motors(s, d), fx.readings(s, d), part_rows=16, parts=4)
    motors = tree.select("user_id", "name", F.explode_outer("motors").alias("m")).select("user_id", "name", "m.*")
    return motors.select("user_id", "name", "motor_id", "motor_name", "part", F.posexplode_outer("readings").alias("slot", "r")).select(
        "user_id", "name", "motor_id", "motor_name", "part", "slot", "r.*")


@query("fleet_navigation")
def _(s, d):
    return access.fleet_navigation(fx.users(s, d), fx.motors(s, d), fx.readings(s, d))


def _cascade(s, d):
    return registry.cascade_delete(fx.users(s, d), fx.motors(s, d), fx.readings(s, d), fx.departed_users(s, d))


@query("cascade_delete_users")
def _(s, d):
    return _cascade(s, d)[0]


@query("cascade_delete_motors")
def _(s, d):
    return _cascade(s, d)[1]


@query("cascade_delete")
def _(s, d):
    return _cascade(s, d)[2]


@query("remove_motor")
def _(s, d):
    left, _ = state.remove_motors(_state(s, d), _buffer(s, d), fx.retired_motors(s, d))
    return left.drop(*NOT_READ)


@query("remove_motor_buffer")
def _(s, d):
    _, left = state.remove_motors(_state(s, d), _buffer(s, d), fx.retired_motors(s, d))
    return series.buffer_rows(left)


@query("prediction_view")
def _(s, d):
    newest = latest.latest_reading(fx.deliveries(s, d), "arrival")
    current = state.apply_messages(state.initial_state(fx.motors(s, d), "timestamp_ntz"), newest)
    return state.prediction_view(current, newest)


@query("apply_message")
def _(s, d):
    return _state(s, d)


# --- aggregations ----------------------------------------------------------------------------

@query("overview_summary")
def _(s, d):
    return _comparable(overview.overview_summary(_state(s, d)))


@query("overview_by_company")
def _(s, d):
    return _comparable(overview.overview_summary(_state(s, d), by=["company_id"]))


@query("overview_skip_nulls")
def _(s, d):
    return _comparable(overview.overview_summary(_state(s, d), by=["company_id"], null_policy="skip"))


@query("status_distribution")
def _(s, d):
    return overview.status_distribution(_state(s, d))


@query("prediction_status_counts")
def _(s, d):
    return overview.prediction_status_counts(_state(s, d))


@query("history_summary")
def _(s, d):
    return history.history_summary(
        history.history_filter(_log(s, d), fx.motors(s, d), start="2024-01-05", end="2024-01-20")
    )


@query("history_page_count")
def _(s, d):
    return history.page_count(history.known_motors(_log(s, d), fx.motors(s, d)))


@query("next_motor_id")
def _(s, d):
    return registry.next_motor_id(fx.motors(s, d))


@query("fleet_connected")
def _(s, d):
    return state.fleet_connected(_state(s, d), _now(s, d), LIVE_MS)


@query("fleet_connected_by_company")
def _(s, d):
    return state.fleet_connected(_state(s, d), _now(s, d), LIVE_MS, by=["company_id"])


@query("motor_exists")
def _(s, d):
    return registry.motor_exists(fx.motors(s, d), fx.readings(s, d))


@query("uniqueness_violations")
def _(s, d):
    return registry.uniqueness_violations(fx.signups(s, d), ["email"])


@query("uniqueness_violations_motors")
def _(s, d):
    return registry.uniqueness_violations(fx.motors(s, d), ["motor_id"])


@query("daily_trend")
def _(s, d):
    return _comparable(overview.daily_trend(fx.readings(s, d), _now(s, d)))


# --- windows and series ------------------------------------------------------------------------

@query("daily_trend_dated")
def _(s, d):
    path, readings = _scratch(s, "readings"), fx.readings(s, d)
    tables.append_by_date(readings, path)
    stored = s.read.schema(_dated(readings)).parquet(path)
    return _comparable(overview.daily_trend(stored, tables.newest_event(s, path)))


@query("latest_reading")
def _(s, d):
    return latest.latest_reading(fx.readings(s, d))


@query("latest_by_arrival")
def _(s, d):
    return latest.latest_reading(fx.deliveries(s, d), "arrival")


@query("live_buffer")
def _(s, d):
    return series.buffer_rows(_buffer(s, d))


@query("rolling_points")
def _(s, d):
    return _comparable(series.rolling_points(fx.deliveries(s, d)))


@query("padded_series")
def _(s, d):
    charts = series.padded_series(_buffer(s, d), _state(s, d))
    zipped = F.arrays_zip("labels", "temperature_series", "vibration_series")
    return charts.select("company_id", "motor_id", F.posexplode(zipped).alias("slot", "p")).select(
        "company_id", "motor_id", "slot", F.col("p.labels").alias("label"),
        F.col("p.temperature_series").alias("temperature"), F.col("p.vibration_series").alias("vibration"),
    )


@query("buffer_last")
def _(s, d):
    return series.buffer_last(_buffer(s, d))


@query("changed_only")
def _(s, d):
    return state.changed_only(fx.repeats(s, d))


# --- sort, limit, page -------------------------------------------------------------------------

@query("history_sort")
def _(s, d):
    return history.history_sort(history.known_motors(_log(s, d), fx.motors(s, d)), "confidence", desc=False)


@query("history_page")
def _(s, d):
    return history.history_page(history.known_motors(_log(s, d), fx.motors(s, d)), 3)


@query("history_page_deep")
def _(s, d):
    return history.history_page_deep(_log(s, d), 150)


@query("history_page_deep_dated")
def _(s, d):
    path, log = _scratch(s, "log"), _log(s, d)
    tables.append_by_date(log, path)
    return history.history_page_deep(s.read.schema(_dated(log)).parquet(path), 150).drop("event_date")


@query("history_page_after")
def _(s, d):
    log = history.known_motors(_log(s, d), fx.motors(s, d))
    return history.history_page_after(log, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), F.lit(0))


@query("history_last_page")
def _(s, d):
    return history.history_last_page(_log(s, d), key="motor")


@query("history_pages")
def _(s, d):
    return history.history_pages(_log(s, d), key="status", desc=True).select("log_id", "status", "page", "slot")


@query("readings_desc")
def _(s, d):
    return history.readings_desc(fx.sensor_data(s, d), MOTOR)


@query("single_row")
def _(s, d):
    return tables.single(history.readings_desc(fx.sensor_data(s, d), MOTOR).limit(1))


# --- sets --------------------------------------------------------------------------------------

@query("filter_options")
def _(s, d):
    return history.filter_options(fx.motors(s, d))


@query("union_append")
def _(s, d):
    added = registry.register_users(fx.signups(s, d), fx.users(s, d))
    return registry.union_append(fx.users(s, d), added)


# --- scalar functions over all readings -----------------------------------------------------------

@query("normalise_status")
def _(s, d):
    return fx.readings(s, d).select("reading_id", values.normalise_status(F.col("status")).alias("status"))


@query("lenient_number")
def _(s, d):
    text = F.when(telemetry.is_message(F.col("payload")), F.get_json_object("payload", "$.temperature"))
    return fx.telemetry(s, d).select("arrival_seq", values.lenient_number(text).alias("number"))


@query("epoch_to_ts")
def _(s, d):
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("string")
    return _ntz(fx.events(s, d).select("event_id", values.epoch_to_ts(seconds).alias("ts_millis")), "ts_millis")


@query("round_half_up")
def _(s, d):
    return fx.readings(s, d).select(
        "reading_id", values.round_half_up(F.col("temperature"), 1).alias("temperature"),
        values.round_half_up(F.col("vibration"), 2).alias("vibration"),
    )


@query("convert_units")
def _(s, d):
    prefs = alerts.with_settings(fx.readings(s, d), fx.motors(s, d), fx.settings(s, d))
    return alerts.convert_units(prefs).select("company_id", "reading_id", "temperature", "vibration", "temp_unit",
                                              "vib_unit")


@query("calibrate")
def _(s, d):
    prefs = alerts.with_settings(fx.readings(s, d), fx.motors(s, d), fx.settings(s, d))
    return alerts.calibrate(prefs).select("company_id", "reading_id", "temperature")


# --- scoring -------------------------------------------------------------------------------------

@query("score")
def _(s, d):
    return alerts.score(fx.readings(s, d)).select("reading_id", "risk_level")


@query("score_columns")
def _(s, d):
    def heat(temperature: Column, vibration: Column) -> Column:
        return F.coalesce(temperature, F.lit(0.0)) * vibration

    return alerts.score(fx.readings(s, d), heat, "heat").select("reading_id", "heat")


@query("score_pandas")
def _(s, d):
    def model(temperature: pd.Series, vibration: pd.Series) -> pd.Series:
        return (temperature.fillna(0.0) * vibration).where(vibration > alerts.VIBRATION_CUT, 0.0)

    scored = alerts.score(fx.readings(s, d), model, "heat", T.DoubleType())
    return scored.select("reading_id", "heat")


# --- streams: all given rows, as a stream of several batches to its end -----------------------------

PIECES = 4


def _pieces(rows: DataFrame, key: str) -> list[DataFrame]:
    """All rows in pieces by ranges of a whole number, in order."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    edges = [low + (high + 1 - low) * i // PIECES for i in range(PIECES + 1)] if low is not None else [0, 0]
    return [rows.where((F.col(key) >= a) & (F.col(key) < b)) for a, b in zip(edges, edges[1:])]


def _landed(s: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A given table, landed piece after piece in a folder, as a stream of about a batch per piece."""
    path = _scratch(s, "landing")
    for piece in _pieces(fx.table(s, d, name), key):
        piece.write.mode("append").parquet(path)
    files = len(s.read.schema(fx.TABLES[name]).parquet(path).inputFiles())
    return landing(s, path, fx.TABLES[name], files_per_batch=max(1, files // PIECES))


def _events_stream(s: SparkSession, d: str) -> DataFrame:
    return _landed(s, d, "events", "event_id")


def _registry(s: SparkSession, d: str) -> Callable[[], DataFrame]:
    """The registry, read anew for every batch."""
    return lambda: fx.motors(s, d)


def _finish(started) -> None:
    started.awaitTermination()


@query("stream_latest_state")
def _(s, d):
    path = _scratch(s, "latest")
    stream = fx.deliveries_of(_events_stream(s, d))
    _finish(streams.stream_latest_state(stream, _registry(s, d), path, f"{path}-cp"))
    return streams.latest_state(s, path, stream.schema)


@query("stream_fleet_state")
def _(s, d):
    path = _scratch(s, "fleet")
    stream = fx.deliveries_of(_events_stream(s, d))
    _finish(streams.stream_latest_state(stream, _registry(s, d), path, f"{path}-cp", snapshot_every=2))
    return streams.fleet_state(s, path, stream.schema, fx.motors(s, d))


def _ingested(s: SparkSession, d: str) -> tuple[str, T.StructType]:
    path = _scratch(s, "ingest")
    raw = fx.telemetry_of(_events_stream(s, d))
    _finish(streams.stream_ingest(raw, _registry(s, d), path, f"{path}-cp"))
    return path, telemetry.parse_telemetry(raw).schema


@query("stream_ingest")
def _(s, d):
    path, schema = _ingested(s, d)
    return _ntz(streams.latest_state(s, f"{path}/state", schema), "event_ts")


@query("stream_ingest_buffer")
def _(s, d):
    path, schema = _ingested(s, d)
    return _ntz(series.buffer_rows(streams.buffered(s, f"{path}/buffer", schema)), "event_ts")


@query("stream_ingest_history")
def _(s, d):
    path, schema = _ingested(s, d)
    log = history.append_history(s.createDataFrame([], schema), fx.motors(s, d)).schema
    return _ntz(streams.history_log(s, f"{path}/history", log), "event_ts").drop("event_date")


@query("stream_ingest_quarantine")
def _(s, d):
    path, _ = _ingested(s, d)
    return streams.batches(s, f"{path}/quarantine", fx.telemetry(s, d).schema).select("arrival_seq", "topic", "payload")


@query("stream_live_buffer")
def _(s, d):
    path = _scratch(s, "buffer")
    stream = fx.deliveries_of(_events_stream(s, d))
    _finish(streams.stream_live_buffer(stream, path, f"{path}-cp"))
    return series.buffer_rows(streams.buffered(s, path, stream.schema))


@query("stream_history")
def _(s, d):
    path = _scratch(s, "history")
    stream = fx.deliveries_of(_events_stream(s, d))
    _finish(streams.stream_history(stream, _registry(s, d), path, f"{path}-cp"))
    return streams.history_log(s, path, _log(s, d).schema).drop("event_date")


@query("stream_changed_only")
def _(s, d):
    path = _scratch(s, "changed")
    # By delivery, since a change is one against what was delivered before.
    ordered = fx.deliveries(s, d)
    # A run for each piece that lands, so that a batch has all files of a piece and none of the next.
    for piece in _pieces(ordered, "arrival_seq"):
        piece.write.mode("append").parquet(f"{path}-landing")
        stream = landing(s, f"{path}-landing", ordered.schema)
        _finish(streams.stream_changed_only(stream, path, f"{path}-cp"))
    return streams.changes(s, path, ordered.schema).drop("batch_id")


@query("stream_connection_timeout")
def _(s, d):
    path = _scratch(s, "liveness")
    readings = fx.deliveries(s, d)
    # A query with timers never runs out of batches, so it is started once for each piece that lands.
    for piece in _pieces(readings, "arrival_seq"):
        piece.write.mode("append").parquet(f"{path}-landing")
        stream = landing(s, f"{path}-landing", readings.schema)
        _finish(streams.stream_connection_timeout(stream, path, f"{path}-cp", trigger={"once": True}))
    return streams.batches(s, path, T.StructType.fromDDL(streams.CONNECTION)).select("motor_id", "connection")


@query("stream_motor_changes")
def _(s, d):
    path = _scratch(s, "registry")
    stream = _landed(s, d, "customer", "c_custkey").select(
        fx.motor_key("c_custkey").alias("motor_id"),
        fx.company_key(F.col("c_nationkey")).alias("company_id"),
        F.col("c_name").alias("motor_name"), F.col("c_mktsegment").alias("location"),
        F.col("c_custkey").alias("arrival_seq"),
    )
    _finish(streams.stream_motor_changes(stream, path, f"{path}-cp"))
    return streams.changes(s, path, stream.schema).drop("batch_id")


@query("stream_risk")
def _(s, d):
    path = _scratch(s, "risk")
    _finish(streams.stream_risk(fx.readings_of(_events_stream(s, d)), path, f"{path}-cp"))
    return s.read.parquet(path).select("reading_id", "temperature", "vibration", "risk_level")


@query("stream_daily_trend")
def _(s, d):
    path = _scratch(s, "trend")
    _finish(streams.stream_daily_trend(fx.readings_of(_events_stream(s, d)), path, f"{path}-cp"))
    return _comparable(streams.daily_averages(s, path))


@query("stream_callback")
def _(s, d):
    path = _scratch(s, "callback")
    stream = fx.readings_of(_events_stream(s, d))
    calls: list[int] = []

    def keep(so_far: DataFrame, batch_id: int) -> None:
        calls.append(batch_id)
        so_far.write.parquet(f"{path}-calls/batch_id={batch_id}")

    _finish(streams.subscribe_readings(stream, MOTOR, keep, path, f"{path}-cp"))
    return s.read.schema(stream.schema).parquet(f"{path}-calls/batch_id={calls[-1]}")
