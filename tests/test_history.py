"""The history log: names, filters, order and pages."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import at, rows
from rotorline.operators import history, overview
from rotorline.sources import tables

DAY = 86400


@pytest.fixture
def log(make):
    rnd = random.Random(1)
    motors = make.motors(*[(f"m{i}", "c", f"name {i}") for i in range(4)])
    r = make.readings(*[
        (f"m{rnd.randrange(5)}", rnd.randrange(6), i, rnd.choice([None, 1.0, 2.0]), 0.1,
         rnd.choice(["Healthy", "healthy", "Fault", "Warning"]), float(rnd.randrange(3)))
        for i in range(60)
    ])
    return history.append_history(r, motors).cache(), motors


def test_log_names_and_membership(make):
    motors = make.motors(("a", "c1", "first"), ("a", "c2", "second"), ("b", "c1", "x"))
    log = history.append_history(make.readings(("a", 1, 1), ("x", 1, 2), ("zz", 1, 3)), motors)
    assert rows(log, "log_id", "motor") == [("log-1-a", "first"), ("log-2-x", "x"), ("log-3-zz", "zz")]
    # Membership goes by name: motor id 'x' passes, because a motor of another id has that name.
    assert rows(history.known_motors(log, motors), "motor") == [("first",), ("x",)]


def test_end_date_is_its_midnight_inclusive(make):
    motors = make.motors(("a", "c", "a"))
    log = history.append_history(make.readings(("a", DAY, 1), ("a", DAY + 0.001, 2), ("a", 2 * DAY, 3), ("a", -1, 4)), motors)
    pick = lambda **kw: [r[0] for r in rows(history.history_filter(log, motors, **kw), "arrival_seq")]
    assert pick(start="2024-01-01", end="2024-01-02") == [1]
    assert pick(end="2024-01-02", end_of_day=True) == [1, 2, 4]
    assert pick() == [1, 2, 3, 4]


def test_filters_and_summary_mind_case(log):
    rows_, motors = log
    got = history.history_filter(rows_, motors, motor="name 1", status="Healthy")
    assert {(r.motor, r.status) for r in got.collect()} == {("name 1", "Healthy")}
    total = history.history_summary(rows_).first()
    assert total.healthy == rows_.where("status = 'Healthy'").count()
    assert sum(total) == rows_.where("status != 'healthy'").count()


@pytest.mark.parametrize("key", history.SORT_KEYS)
@pytest.mark.parametrize("desc", [True, False])
def test_pages_add_up_to_the_sorted_log(log, key, desc):
    frame, _ = log
    whole = [tuple(r) for r in history.history_sort(frame, key, desc).collect()]
    paged = history.history_pages(frame, 7, key, desc).orderBy("page", "slot").drop("page", "slot").collect()
    assert [tuple(r) for r in paged] == whole
    for page in (history.history_page, history.history_page_deep):
        assert [tuple(r) for r in page(frame, 3, 7, key, desc).collect()] == whole[14:21]
    for size in (7, 60, 100):
        last = history.history_last_page(frame, size, key, desc).collect()
        assert [tuple(r) for r in last] == whole[(len(whole) - 1) // size * size:]


def test_ties_keep_append_order_both_ways(make):
    motors = make.motors(("a", "c", "a"))
    log = history.append_history(make.readings(("a", 1, 5), ("a", 1, 2), ("a", 2, 9)), motors)
    assert [r.arrival_seq for r in history.history_sort(log, desc=True).collect()] == [9, 2, 5]
    assert [r.arrival_seq for r in history.history_sort(log, desc=False).collect()] == [2, 5, 9]


def test_unknown_sort_key(log):
    with pytest.raises(ValueError):
        history.history_sort(log[0], "password")


def test_pages_follow_one_another_by_key(log):
    frame, _ = log
    whole = [r.log_id for r in history.history_sort(frame).collect()]
    seen, page = [], history.history_page(frame, 1, 9).collect()
    while page:
        seen += [r.log_id for r in page]
        page = history.history_page_after(frame, F.lit(page[-1].event_ts), F.lit(page[-1].arrival_seq), 9).collect()
    assert seen == whole


@pytest.mark.parametrize("count,pages", [(0, 0), (1, 1), (5, 1), (6, 2)])
def test_page_count(make, count, pages):
    frame = make.readings(*[("a", i, i) for i in range(count)]) if count else make.readings(("a", 1, 1)).where("false")
    assert history.page_count(frame).first().pages == pages


def test_filter_options(make):
    got = history.filter_options(make.motors(("a", "c", "z"), ("b", "c", "a"), ("d", "e", "q"))).orderBy("company_id", "ord")
    assert [(r.company_id, r.option) for r in got.collect()] == [("c", "All"), ("c", "z"), ("c", "a"), ("e", "All"), ("e", "q")]


def test_log_table_is_pruned_by_date(spark, log, folder):
    tables.append_by_date(log[0], folder("log"))
    read = spark.read.parquet(folder("log")).where(F.col("event_date") == "2024-01-01")
    assert "PartitionFilters: [isnotnull(event_date" in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == log[0].count()
    stored = spark.read.parquet(folder("log"))
    for period in ({"start": "2024-01-01", "end": "2024-01-02"}, {"end": "2024-01-01", "end_of_day": True}):
        filtered = history.history_filter(stored, log[1], **period)
        assert "PartitionFilters: [isnotnull(event_date" in filtered._jdf.queryExecution().executedPlan().toString()
        assert rows(filtered.drop("event_date")) == rows(history.history_filter(log[0], log[1], **period))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["Healthy", "Fault"])), min_size=1, max_size=30), st.integers(1, 8))
def test_paging_any_log(make, entries, size):
    frame = make.readings(*[("a", t, i, 1.0, 0.1, s) for i, (t, s) in enumerate(entries)])
    log = history.append_history(frame, make.motors(("a", "c")))
    pages = history.history_pages(log, size, "status").collect()
    assert max(r.page for r in pages) == -(-len(entries) // size) == history.page_count(log, size).first().pages
    assert at(entries[0][0]) in {r.event_ts for r in pages}


@pytest.mark.parametrize("desc", [True, False])
def test_deep_page_reads_the_dates_it_lies_in(spark, make, folder, monkeypatch, desc):
    readings = make.readings(*[("a", (i * 7 % 9) * DAY + i % 2, i) for i in range(40)]).withColumn(
        "event_ts", F.expr("if(arrival_seq % 10 = 3, null, event_ts)"))
    log = history.append_history(readings, make.motors(("a", "c")))
    tables.append_by_date(log, folder("log"))
    stored = spark.read.parquet(folder("log"))
    whole = [r.log_id for r in history.history_sort(log, desc=desc).collect()]
    sorted_parts, numbered = [], history.numbered
    monkeypatch.setattr(history, "numbered", lambda part, *how: sorted_parts.append(part) or numbered(part, *how))
    for page in (1, 3, 6, 7):
        got = history.history_page_deep(stored, page, 7, desc=desc).collect()
        assert [r.log_id for r in got] == whole[(page - 1) * 7:page * 7]
    read = [{r.event_date for r in part.select("event_date").distinct().collect()} for part in sorted_parts]
    assert all(len(dates) <= 4 for dates in read[:3]) and read[3] == set()
    text = sorted_parts[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text


def test_trend_of_a_dated_table_reads_its_dates(spark, make, folder):
    readings = make.readings(*[("a", i * DAY, i) for i in range(30)])
    tables.append_by_date(readings, folder("readings"))
    stored = spark.read.parquet(folder("readings"))
    as_of = tables.newest_event(spark, folder("readings"))
    assert spark.range(1).select(as_of).first()[0] == at(29 * DAY)
    trend = overview.daily_trend(stored, as_of)
    assert rows(trend) == rows(overview.daily_trend(readings, F.lit(at(29 * DAY)).cast("timestamp_ntz")))
    text = trend._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in text.split("PartitionFilters: [")[1].split("]")[0] and "Subquery" not in text
    assert spark.range(1).select(tables.newest_event(spark, folder("none"))).first()[0] is None
