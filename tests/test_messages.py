"""Parsing of messages and values."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from rotorline.functions import ids, units, values
from rotorline.sources import tables, telemetry
from rotorline.streaming.sources import from_kafka

RAW = "topic string, payload string, arrival_seq long, arrival_ts timestamp_ntz"


def one(spark, expr, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,number", [
    ("12.5abc", 12.5), (" 12.5", 12.5), ("-3", -3.0), (".5", 0.5), ("5.", 5.0), ("1e3x", 1000.0), ("1e", 1.0),
    ("abc", None), ("", None), (None, None), ("NaN", None), ("+7", 7.0), ("true", None), ("--1", None),
])
def test_lenient_number(spark, text, number):
    assert one(spark, values.lenient_number, text) == number


def test_decoded_messages_give_what_raw_ones_give(spark):
    odd = [None, "", "null", "7", "[]", "{}", "{bad", '{"motor_id":"a"}', '{"motor_id":"a"}] junk', '{"motor_id":0}', '{"motor_id":"0"}',
           '{"motor_id":"a]","temperature":"1x","timestamp":"5"}', '{"motor_id":false,"status":"x"}', '{"motor_id":"a"},{"motor_id":"b"}']
    raw = spark.createDataFrame([("t", p, i, at(i)) for i, p in enumerate([*odd, *odd])], RAW)
    known = telemetry.with_messages(raw)
    for read in (telemetry.parse_telemetry, telemetry.malformed_telemetry):
        assert read(known).schema == read(raw).schema
        assert rows(read(known)) == rows(read(raw)) != []


@pytest.mark.parametrize("text,expected", [(None, "unknown"), ("", "unknown"), ("HEALTHY", "healthy"), ("x", "x")])
def test_normalise_status(spark, text, expected):
    assert one(spark, values.normalise_status, text) == expected


def test_epoch_is_cut_to_millis(spark):
    assert one(spark, lambda c: values.epoch_to_ts(c).cast("timestamp_ntz"), "1.0019") == dt.datetime(1970, 1, 1, 0, 0, 1, 1000)
    assert one(spark, values.epoch_to_ts, "0") is None
    assert one(spark, values.epoch_to_ts, "1e300") is None
    assert one(spark, values.epoch_to_ts, "soon") is None


@pytest.mark.parametrize("number,text", [(1, "MOTOR-001"), (99, "MOTOR-099"), (1000, "MOTOR-1000"), (15000, "MOTOR-15000")])
def test_ids_are_padded_never_cut(spark, number, text):
    assert one(spark, ids.format_id, number, "long") == text


@pytest.mark.parametrize("text,number", [("MOTOR-007", 7), ("pump", 0), ("A12", 12), ("9" * 30, 0), ("12b", 0)])
def test_id_number(spark, text, number):
    assert one(spark, ids.id_number, text) == number


@pytest.mark.parametrize("topic,motor", [("motors/a/data", "a"), ("motors//data", None), ("motors/a/b/data", None), ("x", None)])
def test_motor_of_topic(spark, topic, motor):
    assert one(spark, ids.motor_of, topic) == motor


def test_units(spark):
    df = spark.createDataFrame([(100.0, "F"), (100.0, "C")], "x double, u string")
    assert [r[0] for r in df.select(units.temperature_in(F.col("x"), F.col("u"))).collect()] == [212.0, 100.0]
    df = spark.createDataFrame([(2.0, "ms2"), (2.0, "g")], "x double, u string")
    assert [r[0] for r in df.select(units.vibration_in(F.col("x"), F.col("u"))).collect()] == [2 * 9.80665, 2.0]


def parsed(make, *payloads):
    raw = make.of(RAW, *[("motors/a/data", p, i, at(i)) for i, p in enumerate(payloads)])
    return telemetry.parse_telemetry(raw).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


def test_parse_defaults(make):
    got = parsed(
        make,
        '{"motor_id":"a","temperature":"20.5abc","vibration":0.04,"timestamp":1704067260,"status":"Fault","confidence":7}',
        '{"motor_id":"a","temperature":"n/a","vibration":null,"timestamp":0,"status":"","confidence":"many"}',
        '{"motor_id":"a"}',
        '{"motor_id":""}', '{"temperature":1}', "{bad", None,
    )
    assert rows(got, "reading_id", "event_ts", "temperature", "vibration", "status", "confidence") == [
        (0, dt.datetime(2024, 1, 1, 0, 1), 20.5, 0.04, "Fault", 7.0),
        (1, at(1), None, None, "Unknown", 0.0),
        (2, at(2), None, None, "Unknown", 0.0),
    ]


def test_odd_values_do_not_void_a_message(make):
    got = parsed(make, '{"motor_id":"a","temperature":{"x":1},"vibration":true,"confidence":[1],"timestamp":"later"}')
    assert rows(got, "temperature", "vibration", "confidence", "event_ts") == [(None, None, 0.0, at(0))]


@pytest.mark.parametrize("value", ["0", "-0.0", "0e5", "false", "null", '""'])
def test_falsy_values_are_missing(make, value):
    assert rows(parsed(make, '{"motor_id":%s}' % value)) == []
    assert rows(parsed(make, '{"motor_id":"a","status":%s}' % value), "status") == [("Unknown",)]


@pytest.mark.parametrize("value,text", [("7", "7"), ("true", "true"), ('"0"', "0"), ('"false"', "false"), ("12.5", "12.5")])
def test_other_values_are_text(make, value, text):
    assert rows(parsed(make, '{"motor_id":%s,"status":%s}' % (value, value)), "motor_id", "status") == [(text, text)]


def test_infinite_numbers_are_not_measurements(make):
    assert rows(parsed(make, '{"motor_id":"a","temperature":"1e999"}'), "temperature") == [(None,)]


def test_quarantine_takes_exactly_the_malformed(make):
    raw = make.of(RAW, *[("t", p, i, at(i)) for i, p in enumerate(["{bad", '{"motor_id":"a"}', "{}", "not json", None])])
    assert [r.arrival_seq for r in telemetry.malformed_telemetry(raw).orderBy("arrival_seq").collect()] == [0, 3, 4]


@pytest.mark.parametrize("payload", [
    '{"motor_id":"a"} x', '{"motor_id":"a"}] junk', '{"motor_id":"a"},{"motor_id":"b"}] junk', '{"motor_id":"a"}{"motor_id":"b"}', '{"motor_id":"a"},{"motor_id":"b"}', "{'motor_id':'a'}",
    '5 junk', '"t"] x', '{"motor_id":"a","temperature":NaN}', '{"motor_id":"a",}', "", "  ", "null",
])
def test_json_is_read_strictly(make, payload):
    raw = make.of(RAW, ("t", payload, 1, at(1)))
    assert telemetry.parse_telemetry(raw).count() == 0
    assert telemetry.malformed_telemetry(raw).count() == 1

def test_only_one_whole_object_is_a_message(spark):
    """Every beginning of a message, with everything that could close it or follow it, as a strict reader takes it."""
    def one_object(text):
        try:
            return isinstance(json.loads(text), dict)
        except ValueError:
            return False

    whole = ['{"motor_id":"a]","temperature":1}', '{"motor_id":"a","x":[1,{"y":"]"}],"status":""}', '{"motor_id":"a"}']
    after = ["", "]", "}", '"}', '"}]', "]]", ",", ",{}", '],[{"motor_id":"b"}', '] {"motor_id":"b"}', " ", "[", "null", '"']
    texts = sorted({m[:n] + end for m in whole for n in range(len(m) + 1) for end in after})
    made = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = {r.payload for r in made.where(telemetry.is_message(F.col("payload"))).collect()}
    assert got == {t for t in texts if one_object(t)}


@pytest.mark.parametrize("payload", ["5", '"t"', "true", '[{"motor_id":"a"}]'])
def test_json_without_a_motor_is_dropped_silently(make, payload):
    raw = make.of(RAW, ("t", payload, 1, at(1)))
    assert telemetry.parse_telemetry(raw).count() == 0
    assert telemetry.malformed_telemetry(raw).count() == 0


def test_last_of_repeated_keys_counts(make):
    assert rows(parsed(make, '{"motor_id":"a","motor_id":"b"}'), "motor_id") == [("b",)]


def test_subscription_diff(make):
    have = make.of("topic string", ("a",), ("b",), ("b",))
    want = make.of("topic string", ("b",), ("c",), ("c",))
    assert rows(telemetry.subscription_diff(have, want)) == [("a", "unsubscribe"), ("c", "subscribe")]


def test_kafka_records(make):
    records = make.of("key binary, value binary, offset long, timestamp timestamp", (b"motors/a/data", b"{}", 5, at(0)))
    assert rows(from_kafka(records), "topic", "payload", "arrival_seq") == [("motors/a/data", "{}", 5)]


def test_saved_state_guards_types(spark):
    lines = [
        '{"id":"a","temperature":"30","vibration":0.5,"confidence":"x","lastUpdated":"2024-01-01T00:00:00.250Z","status":"Fault"}',
        '{"id":"b","temperature":30,"vibration":null,"confidence":4,"lastUpdated":""}',
        '{"id":"c","temperature":"NaN","lastUpdated":"never"}',
    ]
    got = tables.restore_state(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = got.withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))
    assert rows(got, "motor_id", "temperature", "vibration", "confidence", "last_updated") == [
        ("a", None, 0.5, 0.0, dt.datetime(2024, 1, 1, 0, 0, 0, 250000)), ("b", 30.0, None, 4.0, None),
        ("c", None, None, 0.0, None),
    ]


def test_single(make):
    two, none = make.of("x long", (1,), (2,)), make.of("x long", (1,)).where("x > 1")
    assert rows(tables.single(two.where("x = 1"))) == [(1,)]
    assert rows(tables.maybe_single(none)) == []
    for df, fn in ((two, tables.single), (none, tables.single), (two, tables.maybe_single)):
        with pytest.raises(Exception, match="single row"):
            fn(df).collect()


def test_csv_export(spark, make, folder):
    df = make.of("a string, b array<int>, c double", ("x,y", [1, 2], 0.5), (None, None, None))
    tables.export_csv(df, folder("csv"))
    back = spark.read.option("header", True).csv(folder("csv"))
    assert rows(back) == [("x,y", "[1,2]", "0.5"), (None, None, None)]


def test_average_is_that_of_the_doubles(make):
    def avg(*xs):
        return make.of("x double", *[(x,) for x in xs]).agg(values.average(F.col("x"), F.count("x"))).first()[0]

    assert avg(0.1, 0.2, 0.3) == pytest.approx(0.2, rel=1e-15)
    assert avg() is None
    assert avg(1e30, 1e30) == 1e30
    assert avg(3e-9, 1e-9, 2e-9) == pytest.approx(2e-9, rel=1e-15)
    assert math.isinf(avg(float("inf"), 1.0))


STATE = ("motor_id string, company_id string, motor_name string, location string, installed_at timestamp, reg_seq long, "
         "temperature double, vibration double, status string, confidence double, last_updated timestamp")


def test_saved_state_comes_back_whole_and_keeps_a_readable_version(spark, make, folder):
    """A motor of two companies, an older version beside the new one, and a write that failed."""
    state = make.of(
        STATE, ("a", "c1", "n", "hall", at(1), 5, 1.5, None, "Healthy", 0.0, at(2)),
        ("a", "c2", "n2", None, None, None, 2.5, 0.1, "Fault", 9.0, None), ("b", None, None, None, None, 7, None, None, None, 0.0, None))
    with pytest.raises(FileNotFoundError):
        tables.load_state(spark, folder("s"))
    assert tables.save_state(state.limit(1), folder("s")) == 0
    assert tables.save_state(state, folder("s")) == 1
    assert rows(tables.load_state(spark, folder("s")), *state.columns) == rows(state)
    broken = state.withColumn("status", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        tables.save_state(broken, folder("s"))
    assert rows(tables.load_state(spark, folder("s")), *state.columns) == rows(state)
    for _ in range(3):
        tables.save_state(state, folder("s"))
    assert len(tables.folders.complete(spark, folder("s"), tables.VERSION)) == 2
