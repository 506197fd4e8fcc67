"""Physical plans: what is pushed down, limited before the shuffle, and split when skewed."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rotorline.operators import access, alerts, history, latest, ordering, registry, series, state
from rotorline.plans import fixtures as fx
from rotorline.plans.catalog import QUERIES
from rotorline.sources import tables

SF_DIR = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_filters_and_columns_reach_the_scan(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    text = plan(tables.scan(events, ["event_id"], {"event_type": "view"}))
    assert "EqualTo(event_type,view)" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_buffer_is_limited_before_the_shuffle(spark):
    text = plan(series.live_buffer(fx.readings(spark, SF_DIR)))
    # Once per motor and bucket, then per motor.
    assert len(re.findall(r"WindowGroupLimit .* 60, Final", text)) == 2
    assert len(re.findall(r"WindowGroupLimit .* 60, Partial", text)) == 2
    assert text.count("Exchange hashpartitioning") == 2


def test_settings_reach_readings_without_a_shuffle_of_them(spark):
    text = plan(QUERIES["threshold_alerts"](spark, SF_DIR))
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") == 2


def test_prediction_view_reads_no_buffer(spark):
    text = plan(QUERIES["prediction_view"](spark, SF_DIR))
    assert "Window" not in text


def test_latest_is_reduced_before_the_shuffle(spark):
    text = plan(latest.latest_reading(fx.readings(spark, SF_DIR)))
    assert "partial_max_by" in text and text.count("Exchange hashpartitioning") == 1 and "Window" not in text


def test_page_is_a_top_k(spark):
    log = history.append_history(fx.readings(spark, SF_DIR), fx.motors(spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan(history.history_page(log, 2))


def test_membership_is_a_semi_join(spark):
    text = plan(access.rls_sensor_data(fx.sensor_data(spark, SF_DIR), fx.motors(spark, SF_DIR), "company_1"))
    assert "LeftSemi" in text


def test_message_is_decoded_once(spark):
    df = QUERIES["parse_telemetry"](spark, SF_DIR)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    # Once whole; once more only inside the branch for values that look like zero or false.
    assert text.count("from_json(ArrayType(") == 1
    assert text.count("from_json(StructField(motor_id,VariantType") == text.count("from_json(") - 1


def test_no_query_multiplies_or_broadcasts_blindly(spark):
    for name, query in QUERIES.items():
        if name.startswith("stream_") or name in ("save_state", "append_by_date", "export_csv"):
            continue
        text = plan(query(spark, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


@pytest.mark.parametrize("build", [series.rolling_points, state.changed_only])
def test_uncut_motors_are_read_and_shuffled_once(spark, build):
    text = plan(build(fx.readings(spark, SF_DIR)))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange hashpartitioning") == 1
    assert "Union" not in text and "Join" not in text


def test_rolling_frames_are_running_aggregates(spark):
    text = plan(series.rolling_points(fx.readings(spark, SF_DIR)))
    windows = re.findall(r"(sum|count|min|max|avg)\([a-z]+#\d+\) windowspecdefinition\([^()]*specifiedwindowframe\(RowFrame, ([^,]*),", text)
    assert windows and {low for _, low in windows} == {"unboundedpreceding$()"}


def test_chart_points_are_turned_once(spark):
    text = QUERIES["padded_series"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("transform(") == 3


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Readings, in several files, of which one motor holds a third."""
    share, path = 3, str(tmp_path_factory.mktemp("hot") / "readings")
    key = F.when(F.col("reading_id") % share == 0, F.lit("MOTOR-001")).otherwise(F.col("motor_id"))
    many = (
        fx.readings(spark, SF_DIR)
        .withColumn("motor_id", key)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(19))))
        .withColumn("arrival_seq", F.col("arrival_seq") * 20 + F.col("_i"))
        .drop("_i")
    )
    many.repartition(8).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def shuffled_joins(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name,build", [
    ("fanout", lambda r, m, u: access.rls_fanout(r, m)),
    ("log", lambda r, m, u: history.append_history(r, m)),
    ("orphans", lambda r, m, u: registry.orphan_readings(r, m)),
    ("navigation", lambda r, m, u: access.fleet_navigation(u, m, r)),
    ("gate", lambda r, m, u: registry.gate_writes(r, m, ["motor_id"])),
    ("settings", lambda r, m, u: alerts.with_settings(r, m, u.select(
        F.col("id").alias("company_id"), *[F.lit(v).alias(k) for k, v in alerts.DEFAULTS.items()]))),
    ("names", lambda r, m, u: history.known_motors(
        r.withColumn("motor", F.col("motor_id")), m.withColumn("motor_name", F.col("motor_id")))),
])
def test_busy_motor_is_split_in_joins(spark, hot, shuffled_joins, name, build):
    out = build(hot, fx.motors(spark, SF_DIR), fx.users(spark, SF_DIR))
    assert "skew=true" in final_plan(out)


def test_busy_motor_is_cut_into_chunks(hot):
    data = hot.select("motor_id", "arrival_seq", "temperature", "vibration", "status", "confidence", "event_ts")
    whole = rows(series.rolling_points(data), "motor_id", "arrival_seq", "n_points", "max_temperature")
    cut = rows(series.rolling_points(data, span=5000), "motor_id", "arrival_seq", "n_points", "max_temperature")
    assert whole == cut
    assert state.changed_only(data, 5000).count() == state.changed_only(data).count()
    spans = ordering.with_spans(data, ["motor_id"], "arrival_seq", 5000).groupBy("motor_id", "_span").count()
    assert spans.agg(F.max("count")).first()[0] <= 10_000
    assert spans.where("motor_id = 'MOTOR-001'").count() > 10
