"""Streams against their batch operators: several batches, restarts and replays."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from check import compare, open_tables
from conftest import READING, rows
from rotorline.operators import alerts, history, latest, series, state
from rotorline.plans import fixtures as fx
from rotorline.plans.catalog import QUERIES as CATALOG
from rotorline.sources import folders, telemetry
from rotorline.streaming import merged, queries, sources

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    """Readings in four landing files, in the order of arrival."""
    base = tmp_path_factory.mktemp("landing")
    frame = fx.deliveries(spark, SF_DIR).orderBy("arrival_seq").cache()
    cut = [r[0] for r in frame.select(F.ntile(4).over(__import__("pyspark").sql.Window.orderBy("arrival_seq")).alias("q"),
                                      "arrival_seq").groupBy("q").agg(F.max("arrival_seq")).orderBy("q").select("max(arrival_seq)").collect()]

    def land(part):
        low = cut[part - 1] if part else -1
        piece = frame.where((F.col("arrival_seq") > low) & (F.col("arrival_seq") <= cut[part]))
        piece.coalesce(1).write.mode("append").parquet(str(base / "in"))
        time.sleep(0.01)

    return frame, str(base / "in"), land


@pytest.fixture(scope="module")
def landed(delivered):
    frame, path, land = delivered
    for part in range(4):
        land(part)
    return frame, path


def stream(spark, frame, path):
    return sources.landing(spark, path, frame.schema, files_per_batch=1)


def finish(query):
    query.awaitTermination()
    return len(query.recentProgress)


@pytest.fixture
def motors(spark):
    return fx.motors(spark, SF_DIR)


def test_latest_state_over_batches_and_restart(spark, landed, motors, folder):
    frame, path = landed
    for _ in range(2):  # the second run finds nothing new
        finish(queries.stream_latest_state(stream(spark, frame, path), motors, folder("t"), folder("cp"), snapshot_every=2))
    want = latest.latest_reading(frame, "arrival").join(motors, "motor_id", "left_semi")
    assert rows(queries.latest_state(spark, folder("t"), frame.schema), *want.columns) == rows(want)
    assert folders.complete(spark, folder("t/full"), "batch_id") == [1, 3]
    assert folders.complete(spark, folder("t/delta"), "batch_id") == [2, 3]  # what came before snapshot 1 is gone


def test_ingest_feeds_every_table(spark, motors, folder):
    raw = fx.telemetry(spark, SF_DIR)
    for low in range(0, 1000, 250):
        raw.where(F.col("arrival_seq").between(low, low + 249)).coalesce(1).write.mode("append").parquet(folder("in"))
        time.sleep(0.01)
    feed = sources.landing(spark, folder("in"), raw.schema, files_per_batch=1)
    for _ in range(2):
        finish(queries.stream_ingest(feed, motors, folder("t"), folder("cp"), snapshot_every=3))
    delivered = telemetry.subscribed(raw, motors)
    readings = telemetry.parse_telemetry(delivered)
    state_now = queries.latest_state(spark, folder("t/state"), readings.schema)
    assert rows(state_now) == rows(latest.latest_reading(readings, "arrival"))
    points = queries.buffered(spark, folder("t/buffer"), readings.schema)
    assert rows(series.buffer_rows(points)) == rows(series.buffer_rows(series.live_buffer(readings)))
    log = history.append_history(readings, motors)
    assert rows(queries.history_log(spark, folder("t/history"), log.schema).drop("event_date")) == rows(log)
    bad = telemetry.malformed_telemetry(delivered)
    assert rows(queries.batches(spark, folder("t/quarantine"), bad.schema)) == rows(bad) != []


def test_a_batch_of_few_files_keeps_all_cores_busy(spark, motors, folder, monkeypatch):
    """Messages are decoded once, in a task per core at least, and no batch stays in memory."""
    raw = fx.telemetry(spark, SF_DIR)
    raw.coalesce(1).write.parquet(folder("in"))
    kept, parse = [], queries.parse_telemetry

    def parsed(delivered):
        if not delivered.isStreaming:
            kept.append((delivered.rdd.getNumPartitions(), delivered.is_cached))
        return parse(delivered)

    decoded, decode = [], telemetry._decoded
    monkeypatch.setattr(telemetry, "_decoded", lambda payload: decoded.append(payload) or decode(payload))
    monkeypatch.setattr(queries, "parse_telemetry", parsed)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    finish(queries.stream_ingest(sources.landing(spark, folder("in"), raw.schema), motors, folder("t"), folder("cp")))
    assert kept == [(spark.sparkContext.defaultParallelism, True)]
    assert len(decoded) == 2  # for the schema, and for the batch
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_live_buffer_over_batches(spark, landed, folder):
    frame, path = landed
    finish(queries.stream_live_buffer(stream(spark, frame, path), folder("t"), folder("cp"), snapshot_every=3))
    got = series.buffer_rows(queries.buffered(spark, folder("t"), frame.schema))
    assert rows(got) == rows(series.buffer_rows(series.live_buffer(frame)))


def test_history_has_no_duplicates_after_restart(spark, landed, motors, folder):
    frame, path = landed
    for _ in range(2):
        finish(queries.stream_history(stream(spark, frame, path), motors, folder("t"), folder("cp")))
    want = history.append_history(frame, motors)
    got = queries.history_log(spark, folder("t"), want.schema)
    assert rows(got, *want.columns) == rows(want)
    day = got.where(F.col("event_date") == F.lit("2024-01-05"))
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()


def test_changed_only_over_batches(spark, make, folder):
    parts = [
        [("a", 1, 1, 1.0), ("b", 1, 2, 1.0)],
        [("a", 1, 3, 1.0), ("b", 1, 4, 2.0), ("b", 1, 5, 2.0)],
        [("b", 1, 6, 2.0), ("c", 1, 7, 1.0), ("a", 1, 8, 3.0)],
    ]
    whole = make.readings(*[r for p in parts for r in p])
    for p in parts:
        make.readings(*p).coalesce(1).write.mode("append").parquet(folder("in"))
        time.sleep(0.01)
    finish(queries.stream_changed_only(stream(spark, whole, folder("in")), folder("t"), folder("cp")))
    got = queries.changes(spark, folder("t"), whole.schema)
    assert rows(got, "arrival_seq") == rows(state.changed_only(whole), "arrival_seq") == [(1,), (2,), (4,), (7,), (8,)]


def test_replayed_batch_changes_nothing(spark, make, folder):
    table = queries.state_table(folder("t"), make.readings(("a", 1, 1)).schema)
    table.put(make.readings(("a", 1, 1, 1.0)), 0)
    for _ in range(2):
        table.put(make.readings(("a", 1, 2, 2.0), ("b", 1, 3, 3.0)), 1)
    assert rows(table.read(spark), "motor_id", "temperature") == [("a", 2.0), ("b", 3.0)]
    assert rows(table.read(spark, before=1), "motor_id", "temperature") == [("a", 1.0)]
    assert merged.read_batches(spark, folder("nothing"), make.readings(("a", 1, 1)).schema).count() == 0


def test_motor_changes(spark, make, folder):
    schema = "motor_id string, company_id string, motor_name string, arrival_seq long"
    for batch in ([("a", "c", "x", 1), ("b", "c", "x", 2)], [("a", "c", "x", 3), ("b", "c", "y", 4), ("b", "c", None, 5)]):
        make.of(schema, *batch).coalesce(1).write.mode("append").parquet(folder("in"))
        time.sleep(0.01)
    feed = sources.landing(spark, folder("in"), make.of(schema).schema, files_per_batch=1)
    finish(queries.stream_motor_changes(feed, folder("t"), folder("cp")))
    got = queries.changes(spark, folder("t"), feed.schema)
    assert rows(got, "batch_id", "motor_id", "motor_name") == [(0, "a", "x"), (0, "b", "x"), (1, "b", None)]


def test_risk_and_callbacks(spark, landed, folder):
    frame, path = landed
    finish(queries.stream_risk(stream(spark, frame, path), folder("t"), folder("cp")))
    want = alerts.risk_level(frame)
    assert rows(spark.read.parquet(folder("t")), *want.columns) == rows(want)
    calls = []
    finish(queries.subscribe_readings(stream(spark, frame, path), "MOTOR-003", lambda df, i: calls.append(
        [r.event_ts for r in df.collect()]), folder("kept"), folder("cp2"), snapshot_every=3))
    mine = frame.where("motor_id = 'MOTOR-003'")
    assert len(calls) == 4 and all(c == sorted(c, reverse=True) for c in calls)
    assert [len(c) for c in calls] == sorted(len(c) for c in calls) and len(calls[-1]) == mine.count()
    calls.clear()
    finish(queries.subscribe_readings(stream(spark, frame, path), "no such motor", lambda df, i: calls.append(i),
                                      folder("kept2"), folder("cp3")))
    assert calls == []


def test_daily_trend_has_every_day_and_late_readings(spark, make, folder):
    day = 86400
    parts = [[("a", 5, 1, 10.0), ("a", day + 5, 2, 20.0)], [("a", 9, 3, 30.0), ("a", 4 * day, 4, 1.0)],
             [("a", 7 * day, 5, 1.0), ("a", 10, 6, 50.0), ("a", 11, 7, None)]]
    for p in parts:
        make.readings(*p).coalesce(1).write.mode("append").parquet(folder("in"))
        time.sleep(0.01)
    feed = sources.landing(spark, folder("in"), make.readings(("a", 1, 1)).schema, files_per_batch=1)
    for _ in range(2):
        finish(queries.stream_daily_trend(feed, folder("t"), folder("cp"), snapshot_every=2))
    got = queries.daily_averages(spark, folder("t"))
    assert rows(got, "day", "n", "avg_temperature") == [
        (dt.date(2024, 1, 1), 4, 30.0), (dt.date(2024, 1, 2), 1, 20.0), (dt.date(2024, 1, 5), 1, 1.0), (dt.date(2024, 1, 8), 1, 1.0)]


def land(frame, path):
    frame.coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.01)


def test_a_table_streams_as_file_and_as_folder(spark, folder):
    events = spark.read.schema(fx.TABLES["events"]).parquet(f"{SF_DIR}/events.parquet")
    events.repartition(3).write.parquet(folder("events.parquet"))
    got = []
    for i, path in enumerate((f"{SF_DIR}/events.parquet", folder("events.parquet"))):
        feed = fx.readings_of(sources.landing(spark, path, fx.TABLES["events"]))
        finish(queries.stream_risk(feed, folder(f"t{i}"), folder(f"cp{i}")))
        got.append(rows(spark.read.parquet(folder(f"t{i}"))))
    assert got[0] == got[1] and len(got[0]) == 1000
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.landing(spark, folder("nothing"), fx.TABLES["events"])
    events.limit(0).write.parquet(folder("none"))
    for part in (tmp for tmp in __import__("pathlib").Path(folder("none")).glob("part-*")):
        part.unlink()
    with pytest.raises(FileNotFoundError):
        sources.landing(spark, folder("none"), fx.TABLES["events"])


@pytest.fixture(scope="module")
def as_folders(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    for table in ("events", "customer", "supplier"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").repartition(3).write.parquet(f"{base}/{table}.parquet")
    return base


@pytest.mark.parametrize("name", [n for n in CATALOG if n.startswith("stream_")])
def test_registered_streams_take_tables_as_folders(spark, as_folders, name):
    """Every stream key gives the rows of its SQL for tables of many files, as `test_catalog` has it for one."""
    _, n, problem = compare(spark, open_tables(SF_DIR), name, as_folders)
    assert problem is None and n


def test_a_motor_registered_or_removed_meanwhile_counts(spark, make, folder):
    """The registry is read for every batch; removal takes state and buffer, later messages count again."""
    schema = make.readings(("a", 1, 1)).schema
    registry = [make.motors(("a", "c"))]
    for p in ([("a", 1, 1, 1.0), ("b", 1, 2, 1.0)], [("a", 2, 3, 2.0), ("b", 2, 4, 2.0)]):
        land(make.readings(*p), folder("in"))
        for what, target in ((queries.stream_latest_state, "s"), (queries.stream_history, "h")):
            finish(what(stream(spark, make.readings(("a", 1, 1)), folder("in")), lambda: registry[-1], folder(target), folder(f"{target}-cp")))
        finish(queries.stream_live_buffer(stream(spark, make.readings(("a", 1, 1)), folder("in")), folder("b"), folder("b-cp")))
        registry.append(make.motors(("a", "c"), ("b", "c", "Bee"), ("idle", "c")))
    state_rows = lambda: rows(queries.latest_state(spark, folder("s"), schema), "motor_id", "arrival_seq")
    assert state_rows() == [("a", 3), ("b", 4)]
    log = queries.history_log(spark, folder("h"), history.append_history(make.readings(("a", 1, 1)), registry[0]).schema)
    assert rows(log, "motor", "arrival_seq") == [("Bee", 4), ("b", 2), ("name a", 1), ("name a", 3)]
    fleet = queries.fleet_state(spark, folder("s"), schema, registry[-1])
    assert rows(fleet, "motor_id", "temperature", "status") == [("a", 2.0, "Healthy"), ("b", 2.0, "Healthy"), ("idle", None, "Disconnected")]
    gone = make.of("motor_id string, arrival_seq long", ("a", 3))
    queries.remove_from_state(folder("s"), gone, schema)
    queries.remove_from_buffer(folder("b"), gone, schema)
    assert state_rows() == [("b", 4)]
    assert rows(queries.buffered(spark, folder("b"), schema), "motor_id") == [("b",)]
    land(make.readings(("a", 9, 5, 5.0)), folder("in"))
    finish(queries.stream_latest_state(stream(spark, make.readings(("a", 1, 1)), folder("in")), lambda: registry[-1], folder("s"), folder("s-cp")))
    assert state_rows() == [("a", 5), ("b", 4)]


def test_folders_of_a_merged_table_stay_few(spark, make, folder):
    table = queries.state_table(folder("t"), make.readings(("a", 1, 1)).schema, snapshot_every=4)
    for i in range(20):
        table.put(make.readings((f"m{i % 6}", i, i, float(i))), i)
        if i in (7, 15):
            table.put(make.readings((f"m{i % 6}", i, i, float(i))), i)  # the batch of a snapshot comes again
    assert len(folders.complete(spark, folder("t/delta"), "batch_id")) <= 8
    assert len(folders.complete(spark, folder("t/full"), "batch_id")) == 2
    assert rows(table.read(spark), "motor_id", "arrival_seq") == [("m0", 18), ("m1", 19), ("m2", 14), ("m3", 15), ("m4", 16), ("m5", 17)]


def test_late_registry_rows_and_readings_are_no_changes(spark, make, folder):
    schema = "motor_id string, company_id string, motor_name string, arrival_seq long"
    for batch in ([("a", "c", "new", 5)], [("a", "c", "old", 3)], [("a", "c", "newer", 6)]):
        land(make.of(schema, *batch), folder("in"))
    finish(queries.stream_motor_changes(sources.landing(spark, folder("in"), make.of(schema).schema, files_per_batch=1), folder("t"), folder("cp")))
    assert rows(queries.changes(spark, folder("t"), make.of(schema).schema), "batch_id", "motor_name") == [(0, "new"), (2, "newer")]
    whole = make.readings(("a", 1, 1))
    for batch in ([("a", 1, 5, 1.0)], [("a", 1, 3, 2.0), ("a", 1, 6, 1.0)], [("a", 1, 7, 2.0)]):
        land(make.readings(*batch), folder("in2"))
    finish(queries.stream_changed_only(stream(spark, whole, folder("in2")), folder("t2"), folder("cp2")))
    assert rows(queries.changes(spark, folder("t2"), whole.schema), "arrival_seq") == [(5,), (7,)]


def test_liveness_keeps_order_and_tells_changes_only(spark, make, folder):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    batches = [[("a", 10, "Disconnected"), ("b", 1, "Healthy")], [("a", 9, "Healthy"), ("b", 2, "Healthy")], [("a", 11, "Healthy"), ("b", 3, "Unknown")]]
    seen = []
    for i, batch in enumerate(batches):
        land(make.of(READING, *[(n, m, now, seq, 1.0, 0.1, status, 1.0) for n, (m, seq, status) in enumerate(batch)]), folder("in"))
        feed = sources.landing(spark, folder("in"), make.of(READING).schema)
        finish(queries.stream_connection_timeout(feed, folder("t"), folder("cp"), threshold_ms=3_600_000, trigger={"once": True}))
        seen = rows(merged.read_batches(spark, folder("t"), make.of(queries.CONNECTION).schema), "motor_id", "batch_id", "connection")
    assert [(m, c) for m, _, c in seen] == [("a", "Disconnected"), ("a", "Connected"), ("b", "Connected"), ("b", "Disconnected")]


def test_redelivered_readings_can_be_dropped(spark, make, folder):
    for p in ([("a", 5, 1), ("a", 5, 2)], [("a", 5, 3), ("a", 6, 4)]):
        make.readings(*p).coalesce(1).write.mode("append").parquet(folder("in"))
        time.sleep(0.01)
    feed = sources.landing(spark, folder("in"), make.readings(("a", 1, 1)).schema, files_per_batch=1)
    once = sources.drop_redelivered(feed, "1 hour")
    finish(queries.stream_risk(once, folder("t"), folder("cp")))
    assert spark.read.parquet(folder("t")).count() == 2


def test_connection_times_out_without_a_message(spark, make, folder):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows_ = [(0, "live", now, 1, 1.0, 0.1, "Healthy", 1.0), (1, "old", now - dt.timedelta(hours=1), 2, 1.0, 0.1, "Healthy", 1.0),
             (2, "off", now, 3, 1.0, 0.1, "Disconnected", 1.0)]
    make.of(READING, *rows_).coalesce(1).write.parquet(folder("in"))
    feed = sources.landing(spark, folder("in"), make.of(READING, *rows_).schema)
    query = queries.stream_connection_timeout(feed, folder("t"), folder("cp"), threshold_ms=12_000,
                                              trigger={"processingTime": "500 milliseconds"})
    try:
        deadline, seen = time.time() + 60, []
        while time.time() < deadline and ("live", "Disconnected") not in seen:
            time.sleep(0.5)
            read = merged.read_batches(spark, folder("t"), make.of(queries.CONNECTION).schema)
            seen = [(r.motor_id, r.connection) for r in read.orderBy("batch_id").collect()]
    finally:
        query.stop()
    assert [c for m, c in seen if m == "live"] == ["Connected", "Disconnected"]
    assert sorted(x for x in seen if x[0] != "live") == [("off", "Disconnected"), ("old", "Disconnected")]
