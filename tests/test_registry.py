"""Registering, validating, access and removal."""

from pyspark.sql import functions as F

from conftest import MOTOR, rows
from rotorline.operators import access, alerts, registry

USER = "id string, name string, email string, created_at timestamp_ntz"


def test_next_id_counts_trailing_digits_per_company(make):
    motors = make.motors(("MOTOR-999", "a"), ("pump", "a"), ("A12", "b"), ("MOTOR-1000", "c"), ("pump", "d"))
    assert rows(registry.next_motor_id(motors)) == [
        ("a", "MOTOR-1000"), ("b", "MOTOR-013"), ("c", "MOTOR-1001"), ("d", "MOTOR-001")]
    assert rows(registry.next_motor_id(motors.where("false"), by=[])) == [("MOTOR-001",)]


def test_insert_if_absent_takes_the_first_of_a_batch_and_is_idempotent(make):
    base = make.motors(("m1", "a"))
    new = make.motors(("m1", "a", "dup"), ("m1", "b", "first"), ("m1", "b", "second"), ("m2", "a"))
    added = registry.insert_if_absent(new, base, ["company_id", "motor_id"], ["reg_seq"])
    assert rows(added, "company_id", "motor_id", "motor_name") == [("a", "m2", "name m2"), ("b", "m1", "first")]
    after = registry.union_append(base, added)
    assert registry.insert_if_absent(new, after, ["company_id", "motor_id"], ["reg_seq"]).count() == 0


def test_motor_form(make):
    new = make.of(MOTOR, (" m1 ", "a", " n ", "x", None, 1), ("  ", "a", "n", "x", None, 2), ("m", "a", "n", None, None, 3),
                  ("m", "", "n", "x", None, 4))
    assert rows(registry.validate_motors(new), "motor_id", "motor_name") == [("m1", "n")]


def test_required_values_and_gate(make):
    data = make.of("motor_id string, x double, y double", ("a", 1.0, 2.0), ("a", None, None), (None, 1.0, 2.0), ("z", 1.0, 1.0))
    valid, rejected = registry.validate_required(data, ["motor_id", "x", "y"])
    assert valid.count() == 2
    assert rows(rejected, "missing") == [("motor_id",), ("x,y",)]
    assert rows(registry.gate_writes(data, make.motors(("a", "c")), ["motor_id", "x", "y"])) == [("a", 1.0, 2.0)]


def test_orphans(make):
    motors = make.motors(("a", "c1"), ("b", "c2"))
    users = make.of(USER, ("c1", "n", "e", None))
    assert rows(registry.orphan_motors(motors, users), "motor_id") == [("b",)]
    r = make.readings(("a", 1, 1), ("x", 1, 2), (None, 1, 3))
    assert rows(registry.orphan_readings(r, motors), "arrival_seq") == [(2,), (3,)]


def test_uniqueness_ignores_nulls(make):
    users = make.of(USER, ("1", "n", "e", None), ("2", "n", "e", None), ("3", "n", None, None), ("4", "n", None, None))
    assert rows(registry.uniqueness_violations(users, ["email"])) == [("e", 2)]


def test_cascade_keeps_readings_of_shared_motors(make):
    users = make.of(USER, ("c1", "n", "e", None), ("c2", "n", "f", None))
    motors = make.motors(("a", "c1"), ("b", "c1"), ("b", "c2"))
    r = make.readings(("a", 1, 1), ("b", 1, 2), ("x", 1, 3))
    u, m, kept = registry.cascade_delete(users, motors, r, make.of("id string", ("c1",)))
    assert rows(u, "id") == [("c2",)]
    assert rows(m, "company_id", "motor_id") == [("c2", "b")]
    assert rows(kept, "motor_id") == [("b",), ("x",)]


def test_shared_motor_is_seen_by_every_owner_once(make):
    motors = make.motors(("m", "c1"), ("m", "c2"), ("m", "c2", "again"))
    r = make.readings(("m", 1, 1), ("x", 1, 2))
    assert rows(access.rls_fanout(r, motors), "company_id", "reading_id") == [("c1", 0), ("c2", 0)]
    assert access.rls_sensor_data(r, motors, "c2").count() == 1
    assert access.rls_sensor_data(r, motors, "c3").count() == 0


def test_navigation_keeps_users_and_motors_without_readings(make):
    users = make.of(USER, ("c1", "n", "e", None), ("c2", "n", "f", None))
    motors = make.motors(("a", "c1"), ("b", "c1"))
    r = make.readings(("a", 1, 1), ("a", 2, 2), ("x", 1, 3))
    assert rows(access.fleet_navigation(users, motors, r)) == sorted(
        [("c1", "a", 0), ("c1", "a", 1), ("c1", "b", None), ("c2", None, None)], key=repr)
    assert rows(access.fleet_rollup(users, motors, r), "user_id", "motor_id", "n_readings") == sorted(
        [("c1", "a", 2), ("c1", "b", 0), ("c2", None, 0)], key=repr)


SETTING = ("company_id string, temp_threshold double, vib_threshold double, calibration double, retention_months int, "
           "temp_unit string, vib_unit string")


def test_settings_apply_per_owner_with_defaults(make):
    motors = make.motors(("m", "c1"), ("m", "c2"), ("n", "c3"))
    settings = make.of(SETTING, ("c1", 50.0, 0.5, 500.0, 1, "F", "g"), ("c2", 10.0, 0.5, -1.0, 1, "C", "ms2"))
    r = make.readings(("m", 1, 1, 20.0, 0.5), ("n", 1, 2, 30.0, 5.0), ("x", 1, 3, 31.0, None))
    prefs = alerts.with_settings(r, motors, settings)
    assert rows(alerts.threshold_alerts(r, motors, settings), "company_id", "reading_id", "over_temperature") == sorted(
        [("c2", 0, True), (None, 2, True)], key=repr)
    assert rows(alerts.convert_units(prefs).where("motor_id = 'm'"), "company_id", "temperature", "vibration") == [
        ("c1", 68.0, 0.5), ("c2", 20.0, 0.5 * 9.80665)]
    assert rows(alerts.calibrate(prefs).where("motor_id = 'm'"), "company_id", "temperature") == [("c1", 120.0), ("c2", 19.0)]


def test_retention_counts_months(make):
    r = make.readings(("a", -86400, 1), ("a", 0, 2), ("a", 86400, 3))
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    assert rows(alerts.retention_filter(r, as_of, 1), "arrival_seq") == [(2,), (3,)]
