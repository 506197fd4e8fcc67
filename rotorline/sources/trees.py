"""Files of large keyed JSON trees, read by many tasks.

One tree may be one file without a line end, far larger than a task. Spark's text reader splits a file at
any separator, so the separator here is the closing brace. Where a split begins, in a string or not and how
deep, follows from what lies before it: every split is first summed up for both cases, and the sums, one row
per split, are added up along each file. Then each task knows its place and cuts the text into entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..operators.ordering import MOST_LISTED

_SPLIT = ("file", "block")
_CLOSINGS = "array<struct<depth: int, n: bigint>>"
_SUMMARY = ("file string, block bigint, file_size bigint, size bigint, odd_quotes boolean, "
            f"deeper array<int>, closings array<{_CLOSINGS}>")
_RECORD = "file string, block bigint, entry bigint, value string, whole boolean, closed boolean"

# The same two for Arrow; workers have no session to read the texts above.
_CLOSINGS_ARROW = pa.list_(pa.struct({"depth": pa.int32(), "n": pa.int64()}))
_SUMMARY_ARROW = pa.schema({
    "file": pa.string(), "block": pa.int64(), "file_size": pa.int64(), "size": pa.int64(), "odd_quotes": pa.bool_(),
    "deeper": pa.list_(pa.int32()), "closings": pa.list_(_CLOSINGS_ARROW),
})
_RECORD_ARROW = pa.schema({
    "file": pa.string(), "block": pa.int64(), "entry": pa.int64(), "value": pa.string(), "whole": pa.bool_(), "closed": pa.bool_(),
})

_BATCH = 1000

_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between closing braces, in the order of the file within each split."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(
        "value", meta.file_path.alias("file"), meta.file_block_start.alias("block"), meta.file_size.alias("file_size"),
        (F.octet_length("value") + 1).alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool, pa.RecordBatch]]:
    """Pieces in a row that are of one split: the first, whether the split begins with it, and all of them."""
    last = None
    for batch in batches:
        codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in _SPLIT]
        borders = np.flatnonzero(reduce(np.logical_or, [np.diff(c) != 0 for c in codes])) + 1
        for low, high in zip([0, *borders], [*borders, batch.num_rows]):
            if low == high:
                continue
            run = batch.slice(low, high - low)
            row = run.slice(0, 1).to_pylist()[0]
            split = tuple(row[c] for c in _SPLIT)
            yield row, split != last, run
            last = split


def _between_quotes(piece: str) -> list[str]:
    return (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')


def _deeper(outside: str) -> int:
    return outside.count("{") + outside.count("[") - outside.count("]")


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: for a start outside (0) and inside (1) of a string, how deep each closing brace leads."""

    def summary() -> pa.RecordBatch:
        listed = [[{"depth": d, "n": n} for d, n in c.items()] for c in closings]
        row = {k: first[k] for k in ("file", "block", "file_size")}
        return pa.RecordBatch.from_pylist(
            [row | {"size": total, "odd_quotes": bool(odd), "deeper": depth, "closings": listed}], _SUMMARY_ARROW)

    first = None
    for row, begins, run in _runs(batches):
        if begins:
            if first:
                yield summary()
            first, total, odd, depth, closings = row, 0, 0, [0, 0], [Counter(), Counter()]
        total += pc.sum(run.column("size")).as_py()
        for piece in run.column("value").to_pylist():
            parts = _between_quotes(piece)
            depth[0] += _deeper("".join(parts[odd::2]))
            depth[1] += _deeper("".join(parts[odd ^ 1::2]))
            odd ^= (len(parts) - 1) & 1
            depth[odd] -= 1
            closings[odd][depth[odd]] += 1
    if first:
        yield summary()


def _starts(pieces: DataFrame) -> DataFrame:
    """Where each split begins: in a string or not, how deep, after how many entries."""
    along = Window.partitionBy("file").orderBy("block")
    before, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")

    def so_far(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    odd = F.col("odd_quotes").cast("int")
    placed = pieces.mapInArrow(_sum_up, _SUMMARY).withColumn("in_string", so_far(odd) % 2)
    placed = placed.withColumns({c: F.col(c)[F.col("in_string").cast("int")] for c in ("deeper", "closings")})
    placed = placed.withColumn("depth", so_far(F.col("deeper")))
    ends = F.filter("closings", lambda c: (c.depth + F.col("depth")).isin(0, 1))
    placed = placed.withColumn("entry", so_far(F.aggregate(ends, F.lit(0).cast("bigint"), lambda a, c: a + c.n)))
    # A brace too many is counted where a file ends with something else than a brace.
    added = (F.sum("size").over(whole) > F.col("file_size")).cast("int")
    balanced = (F.sum("deeper").over(whole) == -added) & (F.sum(odd).over(whole) % 2 == 0)
    problem = F.raise_error(F.concat(F.lit("cut off, unbalanced or compressed JSON tree: "), F.col("file")))
    depth = F.when(balanced, F.col("depth")).otherwise(problem).cast("int")
    return placed.select(*_SPLIT, F.col("in_string").cast("int").alias("in_string"), depth.alias("depth"), "entry")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the root, in runs that end with an object; what crosses a border of splits comes in parts."""

    def record(end: str | None) -> dict:
        return {"file": first["file"], "block": first["block"], "entry": entry, "value": "".join(held) + (end or ""),
                "whole": end is not None and not at_head, "closed": end is not None}

    first, held, found = None, [], []
    for row, begins, run in _runs(batches):
        if begins:
            if held:
                found.append(record(None))
            first, in_string, depth, entry = row, row["in_string"], row["depth"], row["entry"]
            held, at_head = [], row["block"] > 0
        for piece in run.column("value").to_pylist():
            parts = _between_quotes(piece)
            depth += _deeper("".join(parts[in_string::2]))
            in_string ^= (len(parts) - 1) & 1
            held.append(piece + "}")
            if not in_string:
                depth -= 1
                if depth in (0, 1):
                    found.append(record("}" * depth))  # the root's own brace, where it does not follow here
                    entry, held, at_head = entry + 1, [], False
            if len(found) >= _BATCH:
                yield pa.RecordBatch.from_pylist(found, _RECORD_ARROW)
                found = []
    if held:
        found.append(record(None))
    if found:
        yield pa.RecordBatch.from_pylist(found, _RECORD_ARROW)


def read_trees(spark: SparkSession, path: str, most_listed: int = MOST_LISTED) -> DataFrame:
    """The trees of JSON files as many small trees (column `value`), for `explode_tree`.

    A file holds one object, or several one after the other; their values should be objects, others go with
    the next object. An entry must fit into a task, a file need not. An empty file, `null` and `{}` give
    nothing; the entries of repeated keys all stay. A file that ends early or is unbalanced is an error;
    compressed files cannot be split and count as such. Files are read three times, and only entries that
    cross a border of splits are shuffled.
    """
    session.ready_checkpoints(spark)
    pieces = _pieces(spark, path)
    starts = _starts(pieces).checkpoint()
    slim = pieces.select("value", *_SPLIT)
    if starts.count() <= most_listed:
        placed = slim.join(F.broadcast(starts), list(_SPLIT))
    else:
        numbered = slim.withColumn("_n", F.monotonically_increasing_id())
        placed = numbered.join(starts, list(_SPLIT)).repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "_n").drop("_n")
    records = placed.mapInArrow(_cut, _RECORD)
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = records.where(~F.col("whole")).groupBy("file", "entry").agg(
        F.array_join(F.transform(parts, lambda p: p.value), "").alias("value"), F.bool_or("closed").alias("closed"))
    entries = records.where("whole").select("value").unionByName(joined.where("closed").select("value"))
    more_than_root_end = ~F.col("value").rlike(r"^\s*\}$")
    return entries.where(more_than_root_end).select(F.regexp_replace("value", r"^\s*[{,]", "{").alias("value"))
