import datetime as dt

import pytest

from rotorline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


READING = ("reading_id long, motor_id string, event_ts timestamp_ntz, arrival_seq long, temperature double, "
           "vibration double, status string, confidence double")
MOTOR = ("motor_id string, company_id string, motor_name string, location string, installed_at timestamp_ntz, "
         "reg_seq long")
STATE = MOTOR + ", temperature double, vibration double, status string, confidence double, last_updated timestamp_ntz"

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def make(spark):
    """Small frames: make.readings(...), make.motors(...), make.state(...)."""

    class Make:
        def readings(self, *rows):
            """Rows of (motor, seconds, arrival) and optionally temperature, vibration, status, confidence."""
            out = []
            for i, row in enumerate(rows):
                motor, sec, seq, *rest = row
                temp, vib, status, conf = (list(rest) + [20.0, 0.01, "Healthy", 90.0][len(rest):])[:4]
                out.append((i, motor, at(sec), seq, temp, vib, status, conf))
            return spark.createDataFrame(out, READING)

        def motors(self, *rows):
            """Rows of (motor, company) and optionally a name."""
            return spark.createDataFrame(
                [(r[0], r[1], r[2] if len(r) > 2 else f"name {r[0]}", "hall", None, i) for i, r in enumerate(rows)],
                MOTOR,
            )

        def state(self, *rows):
            """Rows of (motor, temperature, vibration, status, last_updated)."""
            return spark.createDataFrame(
                [(m, "c", m, "hall", None, i, t, v, s, 0.0, ts) for i, (m, t, v, s, ts) in enumerate(rows)], STATE
            )

        def of(self, schema, *rows):
            return spark.createDataFrame(list(rows), schema)

    return Make()


def rows(df, *cols):
    """Sorted tuples of a frame."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
