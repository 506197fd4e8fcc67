"""What several operators share: columns by name, checkpoints, Arrow texts, dropping decided rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.session import ready_checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def settled(df: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder and cut from its lineage."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint()


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of a shuffle of so many rows, about `each` in one, and no fewer than the session sets."""
    return max(width(spark), -(-rows // each))


BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """`df.mapInArrow(function, schema)` over batches of a few megabytes, however long the texts are.

    The bound holds for the session from then on.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every text of an Arrow column; null gives empty bytes."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def fixed_binary(values: np.ndarray) -> pa.Array:
    """An Arrow binary column of a numpy array of fixed-width byte strings."""
    size = values.dtype.itemsize
    fixed = pa.Array.from_buffers(pa.binary(size), len(values), [None, pa.py_buffer(values.tobytes())])
    return fixed.cast(pa.binary())


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of the frame has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes up to which a table may be sent to every task.
MOST_BROADCAST = 16 << 20
DECISION_BYTES = 64


def sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A settled frame, marked to be broadcast if its rows, of so many bytes, are few; else joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= MOST_BROADCAST else df


def keep_decided(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of `docs` that `decisions` (doc_id, text_digest, kept, copies) keeps, columns unchanged.

    A row is known by its id, null included, and the digest of its text. Rows that agree in both
    are one document given `copies` times; one of them stays. Only ids and digests of dropped rows
    travel besides the documents, and while they are few the documents stay where they are.
    """
    doc, digest = free_names(docs, "doc_id_", "text_digest_")
    keyed = docs.withColumns({doc: named(id_col), digest: text_digest(named(text_col))})
    lost = sent_if_small(decisions.filter(~F.col("kept")).select("doc_id", "text_digest").distinct(), DECISION_BYTES)
    same = keyed[digest] == lost["text_digest"]
    left = keyed.join(lost, same & keyed[doc].eqNullSafe(lost["doc_id"]), "left_anti")
    again = decisions.filter("kept and copies > 1").select("doc_id", "text_digest").distinct()
    if not again.isEmpty():
        match = (F.col(digest) == again["text_digest"]) & F.col(doc).eqNullSafe(again["doc_id"])
        once = left.join(again, match, "left_semi").dropDuplicates([doc, digest])
        left = left.join(again, match, "left_anti").unionByName(once)
    return left.drop(doc, digest)
