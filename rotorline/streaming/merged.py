"""A keyed table fed by micro-batches.

Each batch adds one small folder with its already reduced rows, so the cost of a batch does
not grow with the table. A replayed batch overwrites its own folder and changes nothing.
Readers merge the folders; every so often a batch also writes the merged table, readers then
start from the newest one, and what lies before the one but newest is deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import folders
from .log import BATCH, read_log


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All complete batches of a log with their `batch_id`; empty if there are none."""
    return read_log(spark, path, schema)


def _of_batches(spark: SparkSession, path: str, schema: T.StructType, batches: list[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{BATCH}={b}" for b in batches])


@dataclass(frozen=True)
class MergedTable:
    """`merge` reduces rows to the table's content and may be applied again and again.

    `keys` and `order` say which rows `remove` takes away.
    """

    path: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]
    snapshot_every: int = 100
    keys: tuple[str, ...] = ("motor_id",)
    order: str = "arrival_seq"

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """Reduce a batch and store it."""
        self.store(self.merge(batch.select(*self.schema.names)), batch_id)

    def store(self, reduced: DataFrame, batch_id: int) -> None:
        """Store a batch that `merge` has already reduced."""
        write_batch(reduced.select(*self.schema.names), f"{self.path}/delta", batch_id)
        if batch_id % self.snapshot_every == self.snapshot_every - 1:
            spark = reduced.sparkSession
            write_batch(self._content(spark, batch_id + 1, batch_id), f"{self.path}/full", batch_id)
            self._prune(spark)

    def _prune(self, spark: SparkSession) -> None:
        """Delete all that readers who start from the last snapshot but one, or later, do not need."""
        snapshots = folders.complete(spark, f"{self.path}/full", BATCH)
        for old in snapshots[:-2]:
            folders.delete(spark, f"{self.path}/full/{BATCH}={old}")
        if len(snapshots) > 1:
            for old in folders.complete(spark, f"{self.path}/delta", BATCH):
                if old <= snapshots[-2]:
                    folders.delete(spark, f"{self.path}/delta/{BATCH}={old}")

    def remove(self, gone: DataFrame) -> None:
        """Take away the rows of the given keys up to a place in their order (columns: keys and order).

        May be called beside the stream that feeds the table. Later rows of a key count again.
        """
        gone.select(*self.keys, self.order).write.mode("append").parquet(f"{self.path}/removed")

    def _without_removed(self, rows: DataFrame) -> DataFrame:
        spark, path = rows.sparkSession, f"{self.path}/removed"
        if not folders.exists(spark, path):
            return rows
        schema = T.StructType([self.schema[c] for c in (*self.keys, self.order)])
        gone = spark.read.schema(schema).parquet(path).groupBy(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).agg(
            F.max(self.order).alias("_until"))
        match = rows[self.order] <= gone["_until"]
        for key in self.keys:
            match = match & rows[key].eqNullSafe(gone[f"_k_{key}"])
        return rows.join(gone, match, "left_anti")

    def _content(self, spark: SparkSession, before: int | None, base_before: int | None, only: DataFrame | None = None) -> DataFrame:
        snapshots = [b for b in folders.complete(spark, f"{self.path}/full", BATCH) if base_before is None or b < base_before]
        base = snapshots[-1] if snapshots else -1
        later = [b for b in folders.complete(spark, f"{self.path}/delta", BATCH) if b > base and (before is None or b < before)]
        rows = _of_batches(spark, f"{self.path}/full", self.schema, snapshots[-1:]).unionByName(
            _of_batches(spark, f"{self.path}/delta", self.schema, later))
        if only is not None:
            rows = rows.join(only, only.columns, "left_semi")
        return self.merge(self._without_removed(rows).select(*self.schema.names))

    def read(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The merged content.

        `before` leaves out that batch and all later ones, `only` all rows but those whose keys
        (the columns of `only`) it lists, before anything is merged.
        """
        return self._content(spark, before, before, only)
