"""The log of batches: every row once, few folders, only the wanted dates."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorline.sources import folders
from rotorline.streaming import log, queries

from tests.conftest import T0

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("day_text", T.StringType())])
DAY = T.StructField("day", T.DateType())


def put(spark, path, batch, n=2, every=10):
    rows = spark.range(n * batch, n * batch + n, 1, 1).selectExpr("id", "'x' AS day_text", f"date_add(DATE'2024-01-01', {batch // 40}) AS day")
    log.append_batch(rows, path, batch, "day", every)


def test_two_hundred_batches_leave_few_folders_and_every_row_once(spark, folder):
    path = folder("t")
    held = None
    for batch in range(200):
        put(spark, path, batch)
        if batch % 37 == 36:
            ids = sorted(r.id for r in log.read_log(spark, path, SCHEMA, DAY).select("id").collect())
            assert ids == list(range(2 * batch + 2))
        if batch == 120:
            held = log.read_log(spark, path, SCHEMA, DAY)  # planned before the next compaction
        if batch == 135:
            assert held.count() == held.select("id").distinct().count() == 242
    assert len(folders.complete(spark, path, "batch_id")) <= 21
    assert len(folders.names(spark, f"{path}/segments")) <= 22
    assert len(folders.complete(spark, f"{path}/manifest", "version")) <= 2
    levels = {s.level for s in log.manifest(spark, path).segments}
    assert levels == {2}  # of a hundred batches each
    got = log.read_log(spark, path, SCHEMA, DAY)
    assert {r.batch_id: r["count"] for r in got.groupBy("batch_id").count().collect()} == dict.fromkeys(range(200), 2)
    wanted = log.read_log(spark, path, SCHEMA, DAY, lambda day: day == "2024-01-02")
    assert wanted.count() == 80 and {f.split("day=")[1][:10] for f in wanted.inputFiles()} == {"2024-01-02"}
    assert wanted.select("batch_id").distinct().count() == 40


def test_replays_and_leftovers(spark, folder):
    path = folder("t")
    for batch in (0, 1, 1, 2, 0):
        put(spark, path, batch, every=3)
    files = set(log.read_log(spark, path, SCHEMA, DAY).inputFiles())
    put(spark, path, 2, every=3)  # a replay leaves what is complete
    assert set(log.read_log(spark, path, SCHEMA, DAY).inputFiles()) == files
    put(spark, path, 3, every=3)
    spark.range(5).withColumn("day_text", F.lit("half")).withColumn("day", F.lit(None).cast("date")).write.parquet(f"{path}/batch_id=4")
    folders.delete(spark, f"{path}/batch_id=4/_SUCCESS")  # as a failed job leaves it
    assert log.read_log(spark, path, SCHEMA, DAY).count() == 8
    put(spark, path, 4, every=3)
    assert sorted(r.id for r in log.read_log(spark, path, SCHEMA, DAY).collect()) == list(range(10))
    assert log.read_log(spark, folder("none"), SCHEMA, DAY).count() == 0


def test_empty_batches_and_rows_without_a_date(spark, folder):
    path = folder("t")
    for batch in range(6):
        rows = spark.range(batch % 2).selectExpr("id", "'x' AS day_text", "CAST(NULL AS DATE) AS day")
        log.append_batch(rows, path, batch, "day", 3)
    got = log.read_log(spark, path, SCHEMA, DAY)
    assert [(r.batch_id, r.day) for r in got.orderBy("batch_id").collect()] == [(1, None), (3, None), (5, None)]
    assert log.read_log(spark, path, SCHEMA, DAY, lambda day: day[:4].isdigit()).count() == 0


def test_history_of_a_period(spark, make, folder):
    def readings(batch):
        return make.readings(*[("a", 86_400 * d + batch, 10 * batch + d) for d in range(3)])

    motors = make.motors(("a", "c"))
    for batch in range(4):
        queries._write_log(queries.append_history(readings(batch), motors), folder("t"), batch)
    schema = queries.append_history(readings(0), motors).schema
    day = (T0 + dt.timedelta(days=1)).date()
    got = queries.history_log(spark, folder("t"), schema, since=day, until=day)
    assert got.count() == 4 and all(f"event_date={day}" in f for f in got.inputFiles())
    assert queries.history_log(spark, folder("t"), schema, until=day).count() == 8
    assert queries.history_log(spark, folder("t"), schema).count() == 12


class Clock:
    """What a motor's state is to the tracker, with a clock that is set."""

    def __init__(self):
        self.now, self.get, self.exists, self.hasTimedOut, self.timeout = 0, None, False, False, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists, self.timeout = value, True, None

    def setTimeoutDuration(self, ms):
        self.timeout = ms

    def remove(self):
        self.get, self.exists = None, False


def test_an_older_message_connects_nobody_however_late():
    track, state, hour = queries._track(10_000, None), Clock(), 3_600_000
    state.now = 100 * hour

    def message(seq, ms):
        state.hasTimedOut = False
        return [r for f in track(("m",), iter([pd.DataFrame({"arrival_seq": [seq], "ms": [ms], "off": [False]})]), state) for r in f.connection]

    assert message(7, state.now) == ["Connected"] and state.timeout == 10_000
    state.now += 10_000
    state.hasTimedOut = True
    assert [r for f in track(("m",), iter([]), state) for r in f.connection] == ["Disconnected"]
    assert state.timeout is None
    state.now += 25 * hour
    assert message(6, state.now) == [] and message(7, state.now) == []  # older ones, stamped as if new
    assert message(8, state.now) == ["Connected"]
