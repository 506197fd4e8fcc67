"""The history log: writing, filtering, sorting, paging and summarising it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions.values import EVENT_DATE, in_period
from .latest import first_per

PAGE_SIZE = 5  # fixed value
ALL = "All"
DEFAULT_SORT = "event_ts"
SORT_KEYS = ("event_ts", "motor", "status", "confidence", "temperature", "vibration")


def first_names(motors: DataFrame) -> DataFrame:
    """First registered name of every motor id."""
    return first_per(motors.select("motor_id", "motor_name", "reg_seq"), ["motor_id"], ["reg_seq"]).select(
        "motor_id", "motor_name"
    )


def motor_name_lookup(readings: DataFrame, motors: DataFrame) -> DataFrame:
    """Adds `motor`: the registered name, else the id."""
    named = readings.join(first_names(motors), "motor_id", "left")
    return named.withColumn("motor", F.coalesce("motor_name", "motor_id")).drop("motor_name")


def append_history(readings: DataFrame, motors: DataFrame) -> DataFrame:
    """One log row for each delivered message, redelivered ones included."""
    log_id = F.concat(F.lit("log-"), F.col("arrival_seq").cast("string"), F.lit("-"), F.col("motor_id"))
    return motor_name_lookup(readings, motors).select(
        log_id.alias("log_id"), "motor_id", "event_ts", "motor", "status", "confidence", "temperature",
        "vibration", "arrival_seq",
    )


def known_motors(log: DataFrame, motors: DataFrame) -> DataFrame:
    """Log rows whose motor name is registered."""
    names = motors.select(F.col("motor_name").alias("motor"))
    return log.join(names, "motor", "left_semi").select(*log.columns)


def _midnight(day: str) -> Column:
    return F.lit(day).cast("date").cast("timestamp_ntz")


def history_filter(
    log: DataFrame, motors: DataFrame, start: str | None = None, end: str | None = None,
    motor: str = ALL, status: str = ALL, end_of_day: bool = False,
) -> DataFrame:
    """Rows of registered motor names that meet every filter given.

    The end date stands for its midnight, inclusive; `end_of_day` takes in the whole day.
    """
    low = _midnight(start) if start else None
    last = _midnight(end) if end else None
    if end_of_day and end:
        period = in_period(log.columns, low, before=last + F.expr("INTERVAL 1 DAY"))
    else:
        period = in_period(log.columns, low, until=last)
    tests = [period]
    if motor != ALL:
        tests.append(F.col("motor") == motor)
    if status != ALL:
        tests.append(F.col("status") == status)
    return known_motors(log.where(reduce(lambda a, b: a & b, tests)), motors)


def _order(key: str, desc: bool) -> list[Column]:
    if key not in SORT_KEYS:
        raise ValueError(f"cannot sort by {key!r}")
    return [F.col(key).desc() if desc else F.col(key).asc(), F.col("arrival_seq").asc()]


def history_sort(log: DataFrame, key: str = DEFAULT_SORT, desc: bool = True) -> DataFrame:
    """Sorted by one column; ties keep the order in which they were appended."""
    return log.orderBy(*_order(key, desc))


def numbered(log: DataFrame, key: str = DEFAULT_SORT, desc: bool = True) -> DataFrame:
    """Adds `position`, the 0-based place of each row in the sorted log.

    The sorted log is checkpointed once, which fixes partitions and the order inside them. Row
    counts of the partitions, one row each, then turn places in a partition into places in the
    whole; no task ever sees more than its own partition. The counts are safe to broadcast:
    there are as many as partitions.
    """
    session.ready_checkpoints(log.sparkSession)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = (
        history_sort(log, key, desc)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_in_part", inside)
        .checkpoint()
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    return placed.join(F.broadcast(starts), "_part").select(
        *log.columns, (F.col("_start") + F.col("_in_part")).alias("position")
    )


def history_page(log: DataFrame, page: int, size: int = PAGE_SIZE, key: str = DEFAULT_SORT, desc: bool = True) -> DataFrame:
    """Page k, counted from 1, as a top-k sort; every task keeps the rows up to it.

    For pages far from the start `history_page_deep` numbers the sorted log instead, and
    `history_page_after` starts from the row before.
    """
    return history_sort(log, key, desc).offset((page - 1) * size).limit(size)


def _dates_of(log: DataFrame, first: int, last: int, desc: bool) -> tuple[list, int]:
    """The dates that hold the places `first` to `last` of the log, and the place at which they begin.

    A count per date reads no column, only what the files say of their row counts. There is one row
    for a date, and at most one date for a row of the page.
    """
    order = F.col(EVENT_DATE).desc() if desc else F.col(EVENT_DATE).asc()
    so_far = F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counts = log.groupBy(EVENT_DATE).agg(F.count(F.lit(1)).alias("_n")).withColumn("_end", so_far)
    found = counts.where((F.col("_end") > first) & (F.col("_end") - F.col("_n") <= last)).collect()
    return [r[EVENT_DATE] for r in found], min((r["_end"] - r["_n"] for r in found), default=0)


def history_page_deep(log: DataFrame, page: int, size: int = PAGE_SIZE, key: str = DEFAULT_SORT, desc: bool = True) -> DataFrame:
    """Page k, counted from 1, out of the numbered log: sorts and checkpoints the log when called.

    Of a log that is stored by date, sorted by time, only the dates that the page lies in: the row
    counts of the dates, newest or oldest first, tell which.
    """
    first, last = (page - 1) * size, page * size - 1
    start = 0
    if key == DEFAULT_SORT and EVENT_DATE in log.columns:
        dates, start = _dates_of(log, first, last, desc)
        known = F.col(EVENT_DATE).isin([d for d in dates if d is not None])
        log = log.where(known | F.col(EVENT_DATE).isNull() if None in dates else known)
    here = (F.col("position") + start).between(first, last)
    return numbered(log, key, desc).where(here).orderBy("position").drop("position")


def history_page_after(log: DataFrame, last_ts: Column, last_seq: Column, size: int = PAGE_SIZE) -> DataFrame:
    """The page after a given row in default order, at the same cost however deep it lies."""
    ts, seq = F.col("event_ts"), F.col("arrival_seq")
    return history_sort(log.where((ts < last_ts) | ((ts == last_ts) & (seq > last_seq)))).limit(size)


def history_last_page(log: DataFrame, size: int = PAGE_SIZE, key: str = DEFAULT_SORT, desc: bool = True) -> DataFrame:
    """The last page, as a top-k sort from the other end."""
    rows_on_it = log.agg(F.pmod(F.count(F.lit(1)) - 1, F.lit(size)) + 1).scalar()
    from_end = [F.col(key).asc() if desc else F.col(key).desc(), F.col("arrival_seq").desc()]
    tail = log.orderBy(*from_end).limit(size)
    place = F.row_number().over(Window.orderBy(*from_end))  # over at most `size` rows
    kept = tail.withColumn("_place", place).where(F.col("_place") <= rows_on_it).drop("_place")
    return history_sort(kept, key, desc)


def history_pages(log: DataFrame, size: int = PAGE_SIZE, key: str = DEFAULT_SORT, desc: bool = True) -> DataFrame:
    """The whole log with its `page` and `slot` on the page."""
    pos = F.col("position")
    return numbered(log, key, desc).withColumns(
        {"page": F.floor(pos / size) + 1, "slot": pos % size}
    ).drop("position")


def page_count(log: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return log.agg(F.ceil(F.count(F.lit(1)) / size).alias("pages"))


def history_summary(filtered: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the three statuses, exactly as written (case matters here)."""
    return filtered.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Healthy", "Warning", "Fault")]
    )


def filter_options(motors: DataFrame) -> DataFrame:
    """Choices of the motor filter of each company: 'All', then its motors in registry order.

    `ord` carries the order, so that no company has to be sorted in one task.
    """
    everything = motors.select("company_id").distinct().select(
        "company_id", F.lit(0).cast("bigint").alias("ord"), F.lit(ALL).alias("option")
    )
    return everything.unionByName(
        motors.select("company_id", (F.col("reg_seq") + 1).alias("ord"), F.col("motor_name").alias("option"))
    )


def readings_desc(rows: DataFrame, motor: str, tie: str = "id") -> DataFrame:
    """All rows of one motor, newest first."""
    return rows.where(F.col("motor_id") == motor).orderBy(F.col("event_ts").desc(), F.col(tie).desc())
