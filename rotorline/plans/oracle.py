"""DuckDB SQL for the registered queries, over the same parquet tables.

Each statement is self-contained: the tables it names are put in front of it as CTEs.
"""

from __future__ import annotations

import re

from . import fixtures as fx
from .catalog import AVERAGE_SCALE, AVERAGE_SHIFT, COMPANY, LIVE_MS, MOTOR


def _motor(number: str) -> str:
    text = f"CAST({number} + 1 AS VARCHAR)"
    return f"('MOTOR-' || CASE WHEN length({text}) < 3 THEN lpad({text}, 3, '0') ELSE {text} END)"


def _avg(value: str, rows: str, over: str = "") -> str:
    """An average, cut to steps as the queries cut it."""
    mean = f"sum(CAST({value} AS DOUBLE)){over} / {rows}"
    return f"floor({mean} * {AVERAGE_SCALE}::DOUBLE + {AVERAGE_SHIFT}::DOUBLE) / {AVERAGE_SCALE}::DOUBLE"


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
OWN = f"c_custkey // {fx.MOTORS_PER_COMPANY}"
INSTALLED = "CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2023-06-01 08:00:00' END AS installed_at"

_AXES = ", ".join(
    f"CASE WHEN event_id % 40 <> 0 THEN CAST(event_id * {f} % {m} - {s} AS DOUBLE) / {v} END AS {n}"
    if n == "angular_velocity"
    else f"CAST(event_id * {f} % {m} - {s} AS DOUBLE) / {v} AS {n}"
    for n, f, m, s, v in fx.AXES
)

CTES: dict[str, str] = {
    "f_users": """
        SELECT 'company_' || s_suppkey AS id, s_name AS name, 'owner' || s_suppkey || '@example.com' AS email,
               TIMESTAMP '2023-01-01 00:00:00' AS created_at
        FROM supplier""",
    "f_signups": """
        SELECT 'company_' || (c_custkey // 10) AS id, c_name AS name,
               'owner' || (c_custkey // 10) || '.' || lower(c_mktsegment) || '@example.com' AS email,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey) AS created_at
        FROM customer""",
    "f_new_motors": f"""
        SELECT {_motor('c_custkey')} AS motor_id, 'company_' || ({OWN}) AS company_id,
               CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE ' ' || c_name END AS motor_name,
               c_mktsegment AS location, {INSTALLED}, c_custkey AS reg_seq
        FROM customer""",
    "f_motors": f"""
        SELECT {_motor('c_custkey')} AS motor_id, 'company_' || ({OWN}) AS company_id, c_name AS motor_name,
               c_mktsegment AS location, {INSTALLED}, c_custkey * 2 AS reg_seq
        FROM customer WHERE c_acctbal >= 0
        UNION ALL
        SELECT {_motor('c_custkey')}, 'company_' || c_nationkey, 'Shared ' || c_name, c_mktsegment, {INSTALLED},
               c_custkey * 2 + 1
        FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey <> {OWN}""",
    "f_departed": "SELECT 'company_' || s_suppkey AS id FROM supplier WHERE s_acctbal < 1000",
    "f_retired": f"SELECT {_motor('c_custkey')} AS motor_id FROM customer WHERE c_acctbal >= 8000",
    "f_readings": f"""
        SELECT event_id AS reading_id, {_motor('user_id')} AS motor_id, ts AS event_ts,
               event_id + CASE WHEN event_id % 10 = 0 THEN 2500 ELSE 0 END AS arrival_seq,
               CASE WHEN event_id % 50 <> 0 THEN value END AS temperature,
               CAST({K} AS DOUBLE) / 1000 AS vibration,
               CASE event_type WHEN 'view' THEN 'Healthy' WHEN 'click' THEN 'healthy'
                    WHEN 'purchase' THEN 'Warning' WHEN 'error' THEN 'Fault' ELSE 'Unknown' END AS status,
               CASE WHEN event_type = 'signup' THEN 0.0::DOUBLE ELSE CAST({K} AS DOUBLE) END AS confidence
        FROM events""",
    "f_deliveries": """
        SELECT * REPLACE (arrival_seq * 2 AS arrival_seq) FROM f_readings
        UNION ALL
        SELECT * REPLACE (arrival_seq * 2 + 7001 AS arrival_seq) FROM f_readings
        WHERE status = 'Fault' AND vibration > 0.08""",
    "f_telemetry": f"""
        SELECT event_id AS arrival_seq, 'motors/' || {_motor('user_id')} || '/data' AS topic,
               CASE WHEN event_id % 97 = 0 THEN '{{bad'
                    WHEN event_id % 89 = 0 THEN '{{"temperature":20.5}}'
                    WHEN event_id % 101 = 0 THEN '{{"motor_id":0,"temperature":20.5}}'
                    ELSE '{{"motor_id":"' || {_motor('user_id')} || '","temperature":"'
                      || CASE WHEN event_id % 71 = 0 THEN 'n/a' ELSE CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) END
                      || CASE WHEN event_id % 83 = 0 THEN 'abc' ELSE '' END
                      || '","vibration":0.0' || lpad(CAST({K} AS VARCHAR), 2, '0')
                      || ',"timestamp":' || CASE WHEN event_id % 79 = 0 THEN '0'
                                                 ELSE CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) END
                      || CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'view' THEN ',"status":""'
                              WHEN event_id % 13 = 0 THEN ',"status":false'
                              ELSE ',"status":"Fault","confidence":' || CAST({K} AS VARCHAR) END
                      || '}}' || CASE WHEN event_id % 103 = 0 THEN '] junk' ELSE '' END END AS payload,
               ts AS arrival_ts
        FROM events""",
    "f_sensor_data": f"""
        SELECT event_id AS id, {_motor('user_id')} AS motor_id, {_AXES}, value AS temperature, ts AS event_ts
        FROM events""",
    "f_settings": """
        SELECT 'company_' || s_suppkey AS company_id, CAST(s_nationkey + 30 AS DOUBLE) AS temp_threshold,
               CAST(s_nationkey AS DOUBLE) / 250 AS vib_threshold, CAST(s_nationkey % 5 - 2 AS DOUBLE) AS calibration,
               s_nationkey % 3 + 1 AS retention_months,
               CASE WHEN s_nationkey % 2 = 0 THEN 'C' ELSE 'F' END AS temp_unit,
               CASE WHEN s_nationkey % 2 = 0 THEN 'g' ELSE 'ms2' END AS vib_unit
        FROM supplier""",
    "f_saved": f"""
        SELECT c_custkey, {_motor('c_custkey')} AS motor_id, c_name, c_mktsegment,
               CAST(c_acctbal AS DECIMAL(10,2)) AS number
        FROM customer""",
    # Results that several checks build on.
    "arrived": """
        SELECT * FROM f_deliveries QUALIFY row_number() OVER (PARTITION BY motor_id ORDER BY arrival_seq DESC) = 1""",
    "state": """
        SELECT m.*, a.temperature, a.vibration,
               CASE WHEN a.motor_id IS NULL THEN 'Disconnected' ELSE a.status END AS status,
               CASE WHEN a.motor_id IS NULL THEN 0.0::DOUBLE ELSE a.confidence END AS confidence,
               a.event_ts AS last_updated
        FROM f_motors m LEFT JOIN arrived a USING (motor_id)""",
    "names": """
        SELECT motor_id, motor_name FROM f_motors
        QUALIFY row_number() OVER (PARTITION BY motor_id ORDER BY reg_seq) = 1""",
    "log": """
        SELECT 'log-' || arrival_seq || '-' || motor_id AS log_id, motor_id, event_ts,
               coalesce(motor_name, motor_id) AS motor, status, confidence, temperature, vibration, arrival_seq
        FROM f_deliveries LEFT JOIN names USING (motor_id)""",
    "known": "SELECT * FROM log WHERE motor IN (SELECT motor_name FROM f_motors)",
    "buffer": """
        SELECT motor_id, CAST(row_number() OVER (PARTITION BY motor_id ORDER BY arrival_seq) - 1 AS INTEGER) AS slot,
               event_ts, temperature, vibration
        FROM (SELECT * FROM f_deliveries
              QUALIFY row_number() OVER (PARTITION BY motor_id ORDER BY arrival_seq DESC) <= 60)""",
    "prefs": """
        SELECT r.*, m.company_id, coalesce(temp_threshold, 30.0) AS temp_threshold,
               coalesce(vib_threshold, 5.0) AS vib_threshold, coalesce(calibration, 0.0) AS calibration,
               coalesce(retention_months, 30) AS retention_months, coalesce(temp_unit, 'C') AS temp_unit,
               coalesce(vib_unit, 'ms2') AS vib_unit
        FROM f_readings r LEFT JOIN (SELECT DISTINCT motor_id, company_id FROM f_motors) m USING (motor_id)
             LEFT JOIN f_settings s ON s.company_id = m.company_id""",
    "gone_motors": """
        SELECT motor_id FROM f_motors GROUP BY motor_id
        HAVING bool_and(company_id IN (SELECT id FROM f_departed))""",
    "valid_forms": """
        SELECT trim(motor_id) AS motor_id, company_id, trim(motor_name) AS motor_name, trim(location) AS location,
               installed_at, reg_seq
        FROM f_new_motors
        WHERE trim(motor_id) <> '' AND trim(motor_name) <> '' AND trim(location) <> '' AND company_id <> ''""",
    "new_users": """
        SELECT * FROM f_signups WHERE id NOT IN (SELECT id FROM f_users)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1""",
}

_STATE_COLS = "motor_id, company_id, motor_name, location"
_OFF = "(coalesce(status, '') = 'Disconnected' OR temperature IS NULL OR vibration IS NULL)"
_LOWER = "lower(coalesce(nullif(status, ''), 'unknown'))"
# Times are cut, not rounded, to milliseconds.
_AGE = "epoch_us((SELECT max(ts) FROM events)) // 1000 - epoch_us(last_updated) // 1000"
_BY_ARRIVAL = "PARTITION BY motor_id ORDER BY arrival_seq"
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ("motor_id", *[a[0] for a in fx.AXES], "temperature", "event_ts"))


def _count(name: str) -> str:
    return f"count(*) FILTER (WHERE {_LOWER} = '{name}') AS {name}"


def _summary(by: str = "", skip: bool = False) -> str:
    def avg(name: str) -> str:
        if skip:
            return f"coalesce({_avg(name, f'nullif(count({name}), 0)')}, 0) AS avg_{name}"
        return f"coalesce({_avg(f'coalesce({name}, 0)', 'nullif(count(*), 0)')}, 0) AS avg_{name}"

    group = f"GROUP BY {by}" if by else ""
    return (
        f"SELECT {by + ',' if by else ''} count(*) AS total_motors, {_count('healthy')}, {_count('warning')}, "
        f"{_count('fault')}, {avg('temperature')}, {avg('vibration')} FROM state {group}"
    )


def _fleet(source: str, limit: int, by: str = "") -> str:
    live = f"coalesce(status <> 'Disconnected', true) AND coalesce({_AGE} < {limit}, false)"
    group = f"GROUP BY {by}" if by else ""
    return (
        f"SELECT {by + ',' if by else ''} CASE WHEN coalesce(bool_and({live}), false) THEN 'Connected' "
        f"ELSE 'Mixed/Disconnected' END AS connection FROM {source} {group}"
    )


def _trend(value: str) -> str:
    return f"{_avg(value, f'nullif(count({value}), 0)')} AS avg_{value}"


_ROLL = "OVER (PARTITION BY motor_id ORDER BY arrival_seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


def _rolled(name: str) -> str:
    mean = _avg(name, f"nullif(count({name}) {_ROLL}, 0)", f" {_ROLL}")
    return f"{mean} AS avg_{name}, min({name}) {_ROLL} AS min_{name}, max({name}) {_ROLL} AS max_{name}"


_DECODED = """
    SELECT arrival_seq, CASE WHEN json_type(j, '$.motor_id') = 'VARCHAR' THEN json_extract_string(j, '$.motor_id') END AS motor_id,
           json_extract_string(j, '$.temperature') AS t, json_extract_string(j, '$.vibration') AS v,
           json_extract_string(j, '$.timestamp') AS s,
           CASE WHEN json_type(j, '$.status') = 'VARCHAR' THEN json_extract_string(j, '$.status') END AS st,
           json_extract_string(j, '$.confidence') AS c, arrival_ts
    FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS j FROM f_telemetry)"""


def _leading(text: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1), '') AS DOUBLE)"


_PARSED = f"""
        SELECT arrival_seq AS reading_id, motor_id,
               coalesce(make_timestamp(nullif(CAST(trunc(CAST(s AS DOUBLE) * 1000) AS BIGINT), 0) * 1000), arrival_ts) AS event_ts,
               arrival_seq, {_leading('t')} AS temperature, {_leading('v')} AS vibration,
               coalesce(nullif(st, ''), 'Unknown') AS status, coalesce(TRY_CAST(c AS DOUBLE), 0) AS confidence
        FROM ({_DECODED}) WHERE motor_id <> ''"""

_SUBSCRIBED = f"SELECT * FROM ({_PARSED}) WHERE motor_id IN (SELECT motor_id FROM f_motors)"

SQL: dict[str, str] = {
    "parse_telemetry": _PARSED,
    "malformed_telemetry": "SELECT arrival_seq, topic, payload FROM f_telemetry WHERE NOT json_valid(payload)",
    "topic_route": """
        SELECT arrival_seq, split_part(topic, '/', 2) AS topic_motor_id, topic FROM f_telemetry""",
    "subscribed_stream": """
        SELECT arrival_seq, topic, payload FROM f_telemetry
        WHERE split_part(topic, '/', 2) IN (SELECT motor_id FROM f_motors)""",
    "subscription_diff": """
        (SELECT topic, 'unsubscribe' AS action FROM
           (SELECT topic FROM f_telemetry EXCEPT SELECT 'motors/' || motor_id || '/data' FROM f_motors))
        UNION ALL
        (SELECT topic, 'subscribe' FROM
           (SELECT 'motors/' || motor_id || '/data' AS topic FROM f_motors EXCEPT SELECT topic FROM f_telemetry))""",
    "scan_motors": f"""
        SELECT motor_id, company_id, location, motor_name, installed_at FROM f_motors WHERE company_id = '{COMPANY}'""",
    "scan_all_columns": f"SELECT * FROM f_sensor_data WHERE motor_id = '{MOTOR}'",
    "filter_eq": f"SELECT motor_id FROM f_motors WHERE company_id = '{COMPANY}' AND location = 'MACHINERY'",
    "explode_tree": f"""
        SELECT p || event_id AS id, {_motor('user_id')} AS "motorId",
               CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) AS temperature, event_id * 2 + o AS timestamp
        FROM events, (VALUES ('a', 0), ('b', 1)) AS n(p, o)""",
    "restore_state": """
        SELECT motor_id, 'company_' || (c_custkey // 14) AS company_id, c_name AS motor_name, c_mktsegment AS location,
               CASE WHEN c_custkey % 6 <> 0 THEN TIMESTAMP '2023-06-01 08:00:00' END AS installed_at,
               CASE WHEN c_custkey % 8 <> 0 THEN c_custkey * 2 END AS reg_seq,
               CASE WHEN c_custkey % 3 = 0 THEN CAST(number AS DOUBLE) END AS temperature,
               CAST('0.0' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS vibration,
               'Healthy' AS status,
               CASE WHEN c_custkey % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(c_custkey % 100 AS DOUBLE) END AS confidence,
               CASE WHEN c_custkey % 5 NOT IN (0, 1) THEN TIMESTAMP '2024-01-30 10:20:30.5' END AS last_updated
        FROM f_saved""",
    "save_state": """
        SELECT motor_id, company_id, motor_name, location, installed_at, reg_seq, temperature, vibration, status, confidence,
               date_trunc('millisecond', last_updated) AS last_updated FROM state""",
    "append_history": "SELECT * FROM log",
    "append_by_date": "SELECT motor, count(*) AS n, max(event_ts) AS last_event_ts FROM log GROUP BY motor",
    "record_sensor_data": """
        SELECT * REPLACE (TIMESTAMP '2024-02-01 00:00:00' AS event_ts) FROM f_sensor_data""",
    "register_motors": """
        SELECT * FROM valid_forms v
        WHERE NOT EXISTS (SELECT 1 FROM f_motors m WHERE m.company_id = v.company_id AND m.motor_id = v.motor_id)""",
    "register_users": "SELECT * FROM new_users",
    "export_csv": "SELECT reading_id, motor_id, temperature, vibration, status FROM f_readings",
    "project_rename": """
        SELECT motor_id AS id, motor_name AS name, location, company_id AS "companyId" FROM f_motors""",
    "display_last_updated": """
        SELECT company_id, motor_id,
               coalesce(strftime(coalesce(last_updated, installed_at), '%Y-%m-%d %H:%M:%S'), 'N/A') AS display_last_updated
        FROM state""",
    "history_filter": """
        SELECT * FROM known WHERE event_ts >= TIMESTAMP '2024-01-05' AND event_ts <= TIMESTAMP '2024-01-20'
          AND status = 'Healthy'""",
    "history_filter_end_of_day": """
        SELECT * FROM known WHERE event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-21'""",
    "history_filter_motor": "SELECT * FROM known WHERE motor = 'Customer#000000001'",
    "risk_level": """
        SELECT reading_id, temperature, vibration, CASE WHEN vibration > 0.04 THEN 'High' ELSE 'Low' END AS risk_level
        FROM f_readings""",
    "effectively_disconnected": f"SELECT company_id, motor_id, {_OFF} AS disconnected FROM state",
    "live_card": f"""
        SELECT company_id, motor_id, {_OFF} AS disconnected,
               CASE WHEN {_OFF} THEN 0.0::DOUBLE ELSE temperature END AS shown_temperature,
               CASE WHEN {_OFF} THEN 0.0::DOUBLE ELSE vibration END AS shown_vibration FROM state""",
    "validate_required": f"SELECT * FROM f_sensor_data WHERE {_COMPLETE}",
    "validate_required_rejected": f"""
        SELECT id, motor_id, 'angular_velocity' AS missing FROM f_sensor_data WHERE NOT ({_COMPLETE})""",
    "validate_motor_form": "SELECT motor_id, company_id, motor_name, location FROM valid_forms",
    "connection_status": f"""
        SELECT company_id, motor_id, CASE WHEN coalesce(status, '') NOT IN ('Disconnected', 'Unknown')
               AND coalesce({_AGE} < {LIVE_MS}, false) THEN 'Connected' ELSE 'Disconnected' END AS connection
        FROM state""",
    "status_class": """
        SELECT company_id, motor_id, status,
               CASE status WHEN 'NORMAL' THEN 'normal' WHEN 'WARNING' THEN 'warning' WHEN 'FAULT' THEN 'fault'
                    WHEN 'DISCONNECTED' THEN 'disconnected' WHEN 'Healthy' THEN 'normal' WHEN 'Warning' THEN 'warning'
                    WHEN 'Fault' THEN 'fault' WHEN 'Unknown' THEN 'disconnected' ELSE '' END AS status_class
        FROM state""",
    "threshold_alerts": """
        SELECT company_id, reading_id, motor_id, temperature, vibration,
               coalesce(temperature > temp_threshold, false) AS over_temperature,
               coalesce(vibration > vib_threshold, false) AS over_vibration
        FROM prefs WHERE coalesce(temperature > temp_threshold, false) OR coalesce(vibration > vib_threshold, false)""",
    "alert_feed": "SELECT * FROM f_readings WHERE lower(status) IN ('fault', 'warning')",
    "retention_filter": """
        SELECT * FROM f_readings WHERE event_ts >= TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 1 MONTH""",
    "retention_filter_by_company": """
        SELECT company_id, reading_id, motor_id, event_ts, retention_months FROM prefs
        WHERE event_ts >= TIMESTAMP '2024-03-15 00:00:00' - to_months(retention_months)""",
    "rls_users": f"SELECT * FROM f_users WHERE id = '{COMPANY}'",
    "rls_motors": f"SELECT * FROM f_motors WHERE company_id = '{COMPANY}'",
    "rls_sensor_data": f"""
        SELECT * FROM f_sensor_data s
        WHERE EXISTS (SELECT 1 FROM f_motors m WHERE m.motor_id = s.motor_id AND m.company_id = '{COMPANY}')""",
    "rls_fanout": """
        SELECT m.company_id, r.* FROM f_readings r
        JOIN (SELECT DISTINCT motor_id, company_id FROM f_motors) m ON m.motor_id = r.motor_id""",
    "motor_name_lookup": """
        SELECT reading_id, motor_id, coalesce(motor_name, motor_id) AS motor
        FROM f_readings LEFT JOIN names USING (motor_id)""",
    "history_known_motors": "SELECT log_id, motor FROM known",
    "insert_if_absent": """
        SELECT * FROM f_new_motors n WHERE NOT EXISTS (SELECT 1 FROM f_motors m WHERE m.motor_id = n.motor_id)""",
    "orphan_readings": "SELECT * FROM f_readings WHERE motor_id NOT IN (SELECT motor_id FROM f_motors)",
    "orphan_motors": "SELECT * FROM f_motors WHERE company_id NOT IN (SELECT id FROM f_users)",
    "gate_writes": f"""
        SELECT * FROM f_sensor_data WHERE {_COMPLETE} AND motor_id IN (SELECT motor_id FROM f_motors)""",
    "fleet_rollup": """
        SELECT u.id AS user_id, u.name, m.motor_id, m.motor_name, count(r.reading_id) AS n_readings,
               min(r.event_ts) AS first_event_ts, max(r.event_ts) AS last_event_ts
        FROM f_users u LEFT JOIN f_motors m ON m.company_id = u.id LEFT JOIN f_readings r ON r.motor_id = m.motor_id
        GROUP BY u.id, u.name, m.motor_id, m.motor_name""",
    "fleet_tree": """
        SELECT u.id AS user_id, u.name, m.motor_id, m.motor_name,
               CASE WHEN m.motor_id IS NOT NULL THEN coalesce(r.n // 16, 0) END::BIGINT AS part, (r.n % 16)::INTEGER AS slot,
               r.reading_id, r.event_ts, r.temperature, r.vibration
        FROM f_users u LEFT JOIN f_motors m ON m.company_id = u.id LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY motor_id ORDER BY reading_id) - 1 AS n FROM f_readings) r ON r.motor_id = m.motor_id""",
    "fleet_navigation": """
        SELECT u.id AS user_id, m.motor_id, r.reading_id
        FROM f_users u LEFT JOIN f_motors m ON m.company_id = u.id LEFT JOIN f_readings r ON r.motor_id = m.motor_id""",
    "cascade_delete_users": "SELECT * FROM f_users WHERE id NOT IN (SELECT id FROM f_departed)",
    "cascade_delete_motors": "SELECT * FROM f_motors WHERE company_id NOT IN (SELECT id FROM f_departed)",
    "cascade_delete": "SELECT * FROM f_readings WHERE motor_id NOT IN (SELECT motor_id FROM gone_motors)",
    "remove_motor": f"""
        SELECT {_STATE_COLS}, temperature, vibration, status, confidence, last_updated FROM state
        WHERE motor_id NOT IN (SELECT motor_id FROM f_retired)""",
    "remove_motor_buffer": "SELECT * FROM buffer WHERE motor_id NOT IN (SELECT motor_id FROM f_retired)",
    "prediction_view": """
        SELECT s.company_id, s.motor_id, s.motor_name, s.confidence, s.status,
               CASE WHEN b.motor_id IS NULL THEN s.temperature ELSE b.temperature END AS temperature,
               CASE WHEN b.motor_id IS NULL THEN s.vibration ELSE b.vibration END AS vibration,
               coalesce(b.event_ts, s.last_updated) AS last_checked
        FROM state s LEFT JOIN (SELECT * FROM buffer
             QUALIFY row_number() OVER (PARTITION BY motor_id ORDER BY slot DESC) = 1) b ON b.motor_id = s.motor_id""",
    "apply_message": "SELECT * FROM state",
    "overview_summary": _summary(),
    "overview_by_company": _summary("company_id"),
    "overview_skip_nulls": _summary("company_id", skip=True),
    "status_distribution": f"""
        WITH n AS (SELECT {_count('healthy')}, {_count('warning')}, {_count('fault')} FROM state)
        SELECT s.status, s.n, coalesce(s.n::DOUBLE / nullif(healthy + warning + fault, 0), 0) AS share
        FROM n, LATERAL (VALUES ('Healthy', healthy), ('Warning', warning), ('Fault', fault)) AS s(status, n)""",
    "prediction_status_counts": f"""
        SELECT {_count('healthy')}, {_count('warning')}, {_count('fault')}, {_count('disconnected')},
               count(*) FILTER (WHERE {_LOWER} NOT IN ('healthy', 'warning', 'fault', 'disconnected')) AS unknown
        FROM state""",
    "history_summary": """
        SELECT count(*) FILTER (WHERE status = 'Healthy') AS healthy, count(*) FILTER (WHERE status = 'Warning') AS warning,
               count(*) FILTER (WHERE status = 'Fault') AS fault
        FROM known WHERE event_ts >= TIMESTAMP '2024-01-05' AND event_ts <= TIMESTAMP '2024-01-20'""",
    "history_page_count": "SELECT CAST(ceil(count(*) / 5) AS BIGINT) AS pages FROM known",
    "next_motor_id": """
        SELECT company_id, 'MOTOR-' || CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END AS next_motor_id
        FROM (SELECT company_id, CAST(max(CAST(regexp_extract(motor_id, '(\\d+)$', 1) AS BIGINT)) + 1 AS VARCHAR) AS n
              FROM f_motors GROUP BY company_id)""",
    "fleet_connected": _fleet("state", LIVE_MS),
    "fleet_connected_by_company": _fleet("state", LIVE_MS, "company_id"),
    "motor_exists": """
        SELECT DISTINCT motor_id, motor_id IN (SELECT motor_id FROM f_motors) AS found FROM f_readings""",
    "uniqueness_violations": "SELECT email, count(*) AS n FROM f_signups GROUP BY email HAVING count(*) > 1",
    "uniqueness_violations_motors": "SELECT motor_id, count(*) AS n FROM f_motors GROUP BY motor_id HAVING count(*) > 1",
    "daily_trend": f"""
        WITH days AS (SELECT CAST((SELECT max(ts) FROM events) AS DATE) - CAST(i AS INTEGER) AS day FROM range(7) AS r(i)),
             daily AS (SELECT CAST(event_ts AS DATE) AS day, count(*) AS n, {_trend('temperature')}, {_trend('vibration')}
                       FROM f_readings GROUP BY 1)
        SELECT day, strftime(day, '%a') AS label, coalesce(n, 0) AS n, avg_temperature, avg_vibration
        FROM days LEFT JOIN daily USING (day)""",
    "latest_reading": """
        SELECT * FROM f_readings
        QUALIFY row_number() OVER (PARTITION BY motor_id ORDER BY event_ts DESC, reading_id DESC) = 1""",
    "latest_by_arrival": "SELECT * FROM arrived",
    "live_buffer": "SELECT * FROM buffer",
    "rolling_points": f"""
        SELECT motor_id, arrival_seq, count(*) {_ROLL} AS n_points, {_rolled('temperature')}, {_rolled('vibration')}
        FROM f_deliveries""",
    "padded_series": f"""
        WITH sized AS (SELECT motor_id, count(*) AS size FROM buffer GROUP BY motor_id)
        SELECT s.company_id, s.motor_id, CAST(g.slot AS INTEGER) AS slot, coalesce(strftime(b.event_ts, '%H:%M:%S'), '') AS label,
               CASE WHEN {_OFF.replace('temperature', 's.temperature').replace('vibration', 's.vibration')}
                         OR b.motor_id IS NULL THEN 0.0::DOUBLE ELSE b.temperature END AS temperature,
               CASE WHEN {_OFF.replace('temperature', 's.temperature').replace('vibration', 's.vibration')}
                         OR b.motor_id IS NULL THEN 0.0::DOUBLE ELSE b.vibration END AS vibration
        FROM state s CROSS JOIN range(60) AS g(slot) LEFT JOIN sized z ON z.motor_id = s.motor_id
             LEFT JOIN buffer b ON b.motor_id = s.motor_id AND b.slot = g.slot - (60 - z.size)""",
    "buffer_last": """
        SELECT motor_id, event_ts, temperature, vibration FROM buffer
        QUALIFY row_number() OVER (PARTITION BY motor_id ORDER BY slot DESC) = 1""",
    "changed_only": f"""
        WITH r AS (SELECT * REPLACE (arrival_seq * 2 + o AS arrival_seq) FROM f_readings, (VALUES (0), (1)) AS n(o))
        SELECT * EXCLUDE (o) FROM r
        QUALIFY row_number() OVER ({_BY_ARRIVAL}) = 1
             OR temperature IS DISTINCT FROM lag(temperature) OVER ({_BY_ARRIVAL})
             OR vibration IS DISTINCT FROM lag(vibration) OVER ({_BY_ARRIVAL})
             OR status IS DISTINCT FROM lag(status) OVER ({_BY_ARRIVAL})
             OR confidence IS DISTINCT FROM lag(confidence) OVER ({_BY_ARRIVAL})
             OR event_ts IS DISTINCT FROM lag(event_ts) OVER ({_BY_ARRIVAL})""",
    "history_sort": "SELECT * FROM known ORDER BY confidence, arrival_seq",
    "history_page": "SELECT * FROM known ORDER BY event_ts DESC, arrival_seq LIMIT 5 OFFSET 10",
    "history_page_deep": "SELECT * FROM log ORDER BY event_ts DESC, arrival_seq LIMIT 5 OFFSET 745",
    "history_page_after": """
        SELECT * FROM known WHERE event_ts <= TIMESTAMP '2024-01-15 12:00:00' ORDER BY event_ts DESC, arrival_seq LIMIT 5""",
    "history_last_page": """
        SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (ORDER BY motor DESC, arrival_seq) AS place FROM log)
        WHERE (place - 1) // 5 = ((SELECT count(*) FROM log) - 1) // 5""",
    "history_pages": """
        SELECT log_id, status, (row_number() OVER w - 1) // 5 + 1 AS page, (row_number() OVER w - 1) % 5 AS slot
        FROM log WINDOW w AS (ORDER BY status DESC, arrival_seq)""",
    "readings_desc": f"SELECT * FROM f_sensor_data WHERE motor_id = '{MOTOR}' ORDER BY event_ts DESC, id DESC",
    "single_row": f"SELECT * FROM f_sensor_data WHERE motor_id = '{MOTOR}' ORDER BY event_ts DESC, id DESC LIMIT 1",
    "filter_options": """
        SELECT DISTINCT company_id, CAST(0 AS BIGINT) AS ord, 'All' AS option FROM f_motors
        UNION ALL SELECT company_id, reg_seq + 1, motor_name FROM f_motors""",
    "union_append": "SELECT * FROM f_users UNION ALL SELECT * FROM new_users",
    "normalise_status": f"SELECT reading_id, {_LOWER} AS status FROM f_readings",
    "lenient_number": f"SELECT arrival_seq, {_leading('t')} AS number FROM ({_DECODED})",
    "epoch_to_ts": "SELECT event_id, date_trunc('millisecond', ts) AS ts_millis FROM events",
    "round_half_up": """
        SELECT reading_id, floor(temperature * 10 + 0.5) / 10 AS temperature,
               floor(vibration * 100 + 0.5) / 100 AS vibration FROM f_readings""",
    "convert_units": """
        SELECT company_id, reading_id,
               CASE WHEN temp_unit = 'F' THEN temperature * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE ELSE temperature END AS temperature,
               CASE WHEN vib_unit = 'ms2' THEN vibration * 9.80665::DOUBLE ELSE vibration END AS vibration,
               temp_unit, vib_unit
        FROM prefs""",
    "calibrate": "SELECT company_id, reading_id, temperature + calibration AS temperature FROM prefs",
    "score": "SELECT reading_id, CASE WHEN vibration > 0.04 THEN 'High' ELSE 'Low' END AS risk_level FROM f_readings",
    "score_columns": "SELECT reading_id, coalesce(temperature, 0) * vibration AS heat FROM f_readings",
    "score_pandas": """
        SELECT reading_id, CASE WHEN vibration > 0.04 THEN coalesce(temperature, 0) * vibration ELSE 0.0::DOUBLE END AS heat
        FROM f_readings""",
    "stream_latest_state": "SELECT * FROM arrived WHERE motor_id IN (SELECT motor_id FROM f_motors)",
    "stream_ingest": f"""
        SELECT * FROM ({_PARSED}) WHERE motor_id IN (SELECT motor_id FROM f_motors)
        QUALIFY row_number() OVER (PARTITION BY motor_id ORDER BY arrival_seq DESC) = 1""",
    "stream_fleet_state": "SELECT * FROM state",
    "stream_ingest_buffer": f"""
        SELECT motor_id, CAST(row_number() OVER (PARTITION BY motor_id ORDER BY arrival_seq) - 1 AS INTEGER) AS slot,
               event_ts, temperature, vibration
        FROM (SELECT * FROM ({_SUBSCRIBED}) QUALIFY row_number() OVER (PARTITION BY motor_id ORDER BY arrival_seq DESC) <= 60)""",
    "stream_ingest_history": f"""
        SELECT 'log-' || arrival_seq || '-' || motor_id AS log_id, motor_id, event_ts,
               coalesce(motor_name, motor_id) AS motor, status, confidence, temperature, vibration, arrival_seq
        FROM ({_SUBSCRIBED}) LEFT JOIN names USING (motor_id)""",
    "stream_ingest_quarantine": """
        SELECT arrival_seq, topic, payload FROM f_telemetry
        WHERE NOT json_valid(payload) AND split_part(topic, '/', 2) IN (SELECT motor_id FROM f_motors)""",
    "stream_live_buffer": "SELECT * FROM buffer",
    "stream_history": "SELECT * FROM log",
    "stream_changed_only": f"""
        SELECT * FROM f_deliveries
        QUALIFY row_number() OVER ({_BY_ARRIVAL}) = 1
             OR (temperature, vibration, status, confidence, event_ts) IS DISTINCT FROM
                (lag(temperature) OVER ({_BY_ARRIVAL}), lag(vibration) OVER ({_BY_ARRIVAL}), lag(status) OVER ({_BY_ARRIVAL}),
                 lag(confidence) OVER ({_BY_ARRIVAL}), lag(event_ts) OVER ({_BY_ARRIVAL}))""",
    "stream_connection_timeout": """
        SELECT motor_id, 'Disconnected' AS connection FROM arrived""",
    "stream_motor_changes": f"""
        SELECT {_motor('c_custkey')} AS motor_id, 'company_' || c_nationkey AS company_id, c_name AS motor_name,
               c_mktsegment AS location, c_custkey AS arrival_seq FROM customer""",
    "stream_risk": """
        SELECT reading_id, temperature, vibration, CASE WHEN vibration > 0.04 THEN 'High' ELSE 'Low' END AS risk_level
        FROM f_readings""",
    "stream_daily_trend": f"""
        SELECT CAST(event_ts AS DATE) AS day, count(*) AS n, {_trend('temperature')}, {_trend('vibration')}
        FROM f_readings GROUP BY 1""",
    "stream_callback": f"SELECT * FROM f_readings WHERE motor_id = '{MOTOR}'",
}


# Other ways to the same rows.
SQL |= {
    "register_motors_committed": SQL["register_motors"],
    "daily_trend_dated": SQL["daily_trend"],
    "history_page_deep_dated": SQL["history_page_deep"],
    "explode_tree_files": SQL["explode_tree"],
}


def _needed(text: str, itself: str = "") -> list[str]:
    """Names of the CTEs a text uses, each after those it uses itself."""
    out: list[str] = []
    for name in CTES:
        if name != itself and re.search(rf"\b{name}\b", text):
            out += [n for n in [*_needed(CTES[name], name), name] if n not in out]
    return out


def _statement(body: str) -> str:
    body = body.strip()
    names = _needed(body)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"


def statements() -> dict[str, str]:
    return {name: _statement(body) for name, body in SQL.items()}
