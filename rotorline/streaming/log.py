"""A table that micro-batches append to, of a bounded number of folders.

A batch is a folder of its own. Every `compact_every` batches the ones before are put together as a
segment, whose rows lie by date; as many segments are put together as one of the next level, so a
row is written once a level and the folders in force grow with the logarithm of the batches.

Which segments are in force, and from which batch on folders are read as they are, says the newest
complete manifest. A reader who has read it sees every row once, whatever is written meanwhile: what a
manifest replaces is deleted only when the one after it is there. A batch whose folder is complete is
not written again, so a replay never takes away what a reader is reading. Folders are named by the
numbers of one checkpoint; another checkpoint needs another path.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources import folders

BATCH, SEGMENT, VERSION = "batch_id", "segment", "version"
COMPACT_EVERY = 50


class Segment(NamedTuple):
    """Batches put together: the first and last of them, and how often."""

    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}-{self.level}"


class Manifest(NamedTuple):
    version: int
    segments: list[Segment]

    @property
    def last(self) -> int:
        """The last batch that a segment has."""
        return max((s.last for s in self.segments), default=-1)


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest one."""
    versions = folders.complete(spark, f"{path}/manifest", VERSION)
    return _manifest(spark, path, versions[-1]) if versions else Manifest(-1, [])


def _manifest(spark: SparkSession, path: str, version: int) -> Manifest:
    rows = spark.read.schema("first long, last long, level int").parquet(f"{path}/manifest/{VERSION}={version}").collect()
    return Manifest(version, sorted(Segment(*r) for r in rows))


def _publish(spark: SparkSession, path: str, segments: list[Segment], version: int) -> None:
    rows = spark.createDataFrame([tuple(s) for s in segments], "first long, last long, level int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{VERSION}={version}")


def _chosen(spark: SparkSession, folder: str, by: str | None, wanted: Callable[[str], bool] | None) -> list[str]:
    """The folder, or its folders of wanted dates."""
    if by is None or wanted is None:
        return [folder]
    return [f"{folder}/{name}" for name in folders.names(spark, folder) if name.startswith(f"{by}=") and wanted(name[len(by) + 1:])]


def _read(spark: SparkSession, base: str, paths: list[str], schema: T.StructType) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*paths)


def read_log(spark: SparkSession, path: str, schema: T.StructType, by: T.StructField | None = None,
             wanted: Callable[[str], bool] | None = None, batches: list[int] | None = None, segments: list[Segment] | None = None) -> DataFrame:
    """The rows with their `batch_id` and, if they lie by date, that column; only folders of wanted dates are listed.

    Everything unless `batches` and `segments` tell what to read.
    """
    if batches is None or segments is None:
        now = manifest(spark, path)
        segments = now.segments
        batches = [b for b in folders.complete(spark, path, BATCH) if b > now.last]
    dates = [by] if by is not None else []
    name = by.name if by is not None else None
    number = T.StructField(BATCH, T.LongType())
    fresh = _read(
        spark, path, [p for b in batches for p in _chosen(spark, f"{path}/{BATCH}={b}", name, wanted)],
        T.StructType([*schema.fields, number, *dates]))
    settled = _read(
        spark, f"{path}/segments", [p for s in segments for p in _chosen(spark, f"{path}/segments/{SEGMENT}={s.name}", name, wanted)],
        T.StructType([*schema.fields, number, T.StructField(SEGMENT, T.StringType()), *dates]))
    return fresh.unionByName(settled.drop(SEGMENT))


def append_batch(df: DataFrame, path: str, batch_id: int, by: str | None = None, compact_every: int = COMPACT_EVERY) -> None:
    """Store a batch, unless it is, and now and then put the earlier ones together."""
    spark = df.sparkSession
    if batch_id <= manifest(spark, path).last or folders.exists(spark, f"{path}/{BATCH}={batch_id}/_SUCCESS"):
        return
    df.write.mode("overwrite").partitionBy(*([by] if by else [])).parquet(f"{path}/{BATCH}={batch_id}")
    if batch_id % compact_every == compact_every - 1:
        plain = T.StructType([f for f in df.schema.fields if f.name != by])
        compact(spark, path, plain, df.schema[by] if by else None, batch_id, compact_every)


def compact(spark: SparkSession, path: str, schema: T.StructType, by: T.StructField | None, before: int, fan: int) -> None:
    """Put the batches before one together, and as many segments of a level as `fan` as one of the next."""
    old = manifest(spark, path)
    batches = [b for b in folders.complete(spark, path, BATCH) if old.last < b < before]
    if not batches:
        return

    def together(batches: list[int], segments: list[Segment], made: Segment) -> Segment:
        rows = read_log(spark, path, schema, by, batches=batches, segments=segments)
        dates = [by.name] if by is not None else []
        rows.hint("rebalance", *dates).write.mode("overwrite").partitionBy(*dates).parquet(f"{path}/segments/{SEGMENT}={made.name}")
        return made

    segments = [*old.segments, together(batches, [], Segment(batches[0], batches[-1], 1))]
    while len(same := [s for s in segments if s.level == segments[-1].level]) >= fan:
        segments = [s for s in segments if s not in same]
        segments.append(together([], same, Segment(same[0].first, same[-1].last, same[0].level + 1)))
    _publish(spark, path, segments, old.version + 1)
    _clean(spark, path, old, segments)


def _clean(spark: SparkSession, path: str, old: Manifest, segments: list[Segment]) -> None:
    """Delete what neither the newest manifest nor the one before needs."""
    for batch in folders.complete(spark, path, BATCH):
        if batch <= old.last:
            folders.delete(spark, f"{path}/{BATCH}={batch}")
    needed = {f"{SEGMENT}={s.name}" for s in [*old.segments, *segments]}
    for name in folders.names(spark, f"{path}/segments"):
        if name.startswith(f"{SEGMENT}=") and name not in needed:
            folders.delete(spark, f"{path}/segments/{name}")
    for version in folders.complete(spark, f"{path}/manifest", VERSION):
        if version < old.version:
            folders.delete(spark, f"{path}/manifest/{VERSION}={version}")
