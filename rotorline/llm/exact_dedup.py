"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition sorts the digests of its texts into a run and merges equal ones. Then the
partitions exchange runs in binomial rounds: the nodes form a hypercube, and in a round the nodes
that differ in a few bits of their number trade the parts of their runs that belong to each other.
A node merges what it gets, several sorted runs at a time, and keeps for each digest the identifier
that stays, the rows, and how often that identifier came. After the last round node n holds all
digests that start with the bits of n. Copies shrink to one entry before every exchange, so a text
that a third of all rows share costs one entry per node.

Equal means equal SHA-256, equal MD5 and equal length; the three travel with every entry and are
compared at every level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import fixed_binary, in_arrow, keep_decided, named, settled, tasks, text_digest

ENTRY = np.dtype([("digest", "S32"), ("check", "S24"), ("known", "u1"), ("id", "<i8"), ("rows", "<i8"), ("same", "<i8")])
RUN_SCHEMA = "node int, head binary, run binary"
MERGED_SCHEMA = "digest binary, check binary, keep_id long, rows long, same long"
LEAF_ENTRIES = 50_000
CHUNK_ENTRIES = 2_048
FAN_BITS = 3
#: Rows whose digests one node is there for.
NODE_ROWS = 2_000_000


def combined(entries: np.ndarray, largest: bool) -> np.ndarray:
    """Entries in digest order, one per text: the id that stays, its rows, and the rows with that id.

    A null id stays only where no copy has one.
    """
    if not len(entries):
        return entries
    rank = entries["id"] if largest else ~entries["id"]
    entries = entries[np.lexsort((rank, entries["known"], entries["check"], entries["digest"]))]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["digest"][1:] != entries["digest"][:-1]) | (entries["check"][1:] != entries["check"][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(entries)) - 1
    out = entries[last]
    of = np.cumsum(new) - 1
    winner = (entries["id"] == out["id"][of]) & (entries["known"] == out["known"][of])
    out["rows"] = np.add.reduceat(entries["rows"], first)
    out["same"] = np.add.reduceat(np.where(winner, entries["same"], 0), first)
    return out


def merged(runs: Iterable[np.ndarray], largest: bool) -> Iterator[np.ndarray]:
    """One sorted run of many, given their pieces by first digest.

    What sorts before the next piece's first digest is final, so only the pieces that overlap are
    held: one of each run.
    """
    held = np.empty(0, ENTRY)
    for piece in runs:
        cut = np.searchsorted(held["digest"], piece["digest"][0], "left")
        if cut:
            yield held[:cut]
        held = combined(np.concatenate([held[cut:], piece]), largest)
    if len(held):
        yield held


def _prefix(digests: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of each digest: the node where it ends."""
    head = np.frombuffer(digests.tobytes(), ">u4").reshape(len(digests), 8)[:, 0].astype(np.int64)
    return head >> (32 - bits) if bits else np.zeros(len(digests), np.int64)


def _sent(run: Iterable[np.ndarray], node: int, digit: tuple[int, int], bits: int) -> Iterator[pa.RecordBatch]:
    """A sorted run as pieces, each addressed to the node that differs in this round's digit."""
    shift, size = digit
    mask = ((1 << size) - 1) << shift
    waiting: dict[int, list[np.ndarray]] = {}

    def batch(to: int) -> pa.RecordBatch:
        entries = np.concatenate(waiting.pop(to))
        return pa.RecordBatch.from_arrays(
            [pa.array([to], pa.int32()), fixed_binary(entries["digest"][:1]), pa.array([entries.tobytes()], pa.binary())],
            ["node", "head", "run"],
        )

    for entries in run:
        targets = (node & ~mask) | (_prefix(entries["digest"], bits) & mask)
        for to in np.unique(targets).tolist():
            part = entries[targets == to]
            for at in range(0, len(part), CHUNK_ENTRIES):
                waiting.setdefault(to, []).append(part[at:at + CHUNK_ENTRIES])
                if sum(map(len, waiting[to])) >= CHUNK_ENTRIES:
                    yield batch(to)
    for to in list(waiting):
        yield batch(to)


def _fixed(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.to_pylist(), f"S{size}")


def _leaf(nodes: int, digit: tuple[int, int], bits: int, largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() % nodes
        held: list[np.ndarray] = []

        def flush():
            yield from _sent([combined(np.concatenate(held), largest)], node, digit, bits)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            entries = np.ones(batch.num_rows, ENTRY)
            ids = batch.column("doc_id")
            entries["digest"], entries["check"] = _fixed(batch.column("digest"), 32), _fixed(batch.column("check"), 24)
            entries["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
            entries["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            held.append(combined(entries, largest))
            if sum(map(len, held)) >= LEAF_ENTRIES:
                yield from flush()
        if held:
            yield from flush()

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for value in batch.column("run"):
            yield np.frombuffer(value.as_py(), ENTRY)


def _round(digit: tuple[int, int], bits: int, largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        yield from _sent(merged(_pieces(batches), largest), node, digit, bits)

    return run


def _root(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in merged(_pieces(batches), largest):
            ids = pa.array(np.ascontiguousarray(entries["id"]), mask=entries["known"] == 0)
            yield pa.RecordBatch.from_arrays(
                [fixed_binary(entries["digest"]), fixed_binary(entries["check"]), ids,
                 pa.array(np.ascontiguousarray(entries["rows"])), pa.array(np.ascontiguousarray(entries["same"]))],
                ["digest", "check", "keep_id", "rows", "same"],
            )

    return run


def merge_digests(digests: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per distinct text of `digests` (doc_id long, digest, check): see the module.

    Rows out: digest, check, keep_id (the largest or smallest id; null if no copy has one), rows
    (copies), same (copies that carry keep_id).
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    largest = keep == "largest"
    bits = (tasks(digests.sparkSession, digests.count(), NODE_ROWS) - 1).bit_length()
    digits = [(at, min(FAN_BITS, bits - at)) for at in range(0, bits, FAN_BITS)] or [(0, 0)]
    nodes = 1 << bits

    def exchanged(runs: DataFrame) -> DataFrame:
        return runs.repartitionById(nodes, F.col("node")).sortWithinPartitions("head")

    runs = exchanged(digests.transform(in_arrow, _leaf(nodes, digits[0], bits, largest), RUN_SCHEMA))
    for digit in digits[1:]:
        runs = exchanged(runs.transform(in_arrow, _round(digit, bits, largest), RUN_SCHEMA))
    return runs.transform(in_arrow, _root(largest), MERGED_SCHEMA)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_digest, copies.

    Texts are equal when their bytes are; null counts as the empty text. Of equal texts the row
    with the largest (or smallest) id stays; a null id stays only where all ids of the group are
    null. Rows that agree in id and text are the same document and share one decision; `copies`
    counts them on the kept ones. Extra columns are ignored, an empty table gives an empty result.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    length = F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0"))
    digests = settled(docs.select(
        named(id_col).cast("long").alias("doc_id"), text_digest(text).alias("digest"),
        F.concat(F.unhex(F.md5(text)), length).alias("check"),
    ))
    shared = merge_digests(digests, keep).filter("rows > 1").select(
        F.col("digest").alias("digest_"), F.col("check").alias("check_"), "keep_id", "rows", "same")
    joined = digests.join(
        shared, (F.col("digest") == F.col("digest_")) & (F.col("check") == F.col("check_")), "left")
    grouped = F.col("rows").isNotNull()
    return joined.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("digest").alias("text_digest"),
        F.coalesce("same", F.lit(1)).cast("long").alias("copies"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """`docs` without exact copies, columns unchanged; see `duplicate_groups`."""
    decisions = settled(
        duplicate_groups(docs, id_col, text_col, keep).filter("group_size > 1")
        .select("doc_id", "text_digest", "kept", "copies"))
    return keep_decided(docs, decisions, id_col, text_col)
