"""Token ids of documents in files of compressed planes.

A store is a folder of Parquet files whose rows are chunks. A chunk holds whole documents, in
ascending doc_id order, and their ids in blocks of `BLOCK` ids. A block is transposed: into four
byte planes (the first bytes of all ids, then the second, ...) or 32 bit planes, each compressed
with zstandard. The chunk index is in the same rows: where each plane ends, the documents with their
lengths, and where the chunk starts in its shard. Planes of high bits are nearly constant and cost
next to nothing; reading the index alone touches no plane.

Shards are ranges of doc_id, one per partition. Spark's committers write the files, so a lost
executor leaves no half-written shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotorline.llm.common import in_arrow, named, tasks
from rotorline.llm.tokens import BYTE_BPE, encoder

BLOCK = 1 << 16
CHUNK_IDS = 1 << 18
SHARD_DOCS = 200_000
PLANES = {"byte": 4, "bit": 32}
CHUNK_SCHEMA = (
    "shard int, chunk int, first_id long, n_ids long, block int, layout string, doc_ids array<long>, "
    "doc_lengths array<long>, plane_ends array<long>, planes binary")


def to_planes(ids: np.ndarray, layout: str) -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids; a last block is filled up with zeros to 8 ids."""
    ids = np.concatenate([ids, np.zeros(-len(ids) % 8, "<u4")]).astype("<u4", copy=False)
    octets = ids.view(np.uint8).reshape(-1, 4)
    if layout == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    """The ids of one block of `n`."""
    if layout == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8)) for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)[:n]


def _packed(ids: np.ndarray, layout: str, block: int, level: int) -> tuple[list[int], bytes]:
    squeeze = zstandard.ZstdCompressor(level=level).compress
    planes = [squeeze(p) for at in range(0, len(ids), block) for p in to_planes(ids[at:at + block], layout)]
    return np.cumsum([len(p) for p in planes], dtype=np.int64).tolist(), b"".join(planes)


def _unpacked(row: dict) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    ends, data, per = row["plane_ends"], row["planes"], PLANES[row["layout"]]
    starts = [0, *ends]
    out = []
    for k, at in enumerate(range(0, row["n_ids"], row["block"])):
        planes = [expand(data[starts[i]:ends[i]]) for i in range(k * per, (k + 1) * per)]
        out.append(from_planes(planes, min(row["block"], row["n_ids"] - at), row["layout"]))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def _chunks(tokenizer: str, end_id: int, layout: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, parts, lengths = [], [], []

        def batch() -> pa.RecordBatch:
            nonlocal number, first
            ids = np.frombuffer(b"".join(parts), "<u4")
            ends, planes = _packed(ids, layout, BLOCK, level)
            row = {"shard": shard, "chunk": number, "first_id": first, "n_ids": len(ids), "block": BLOCK, "layout": layout,
                   "doc_ids": doc_ids, "doc_lengths": lengths, "plane_ends": ends, "planes": planes}
            schema = pa.schema([
                ("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                ("block", pa.int32()), ("layout", pa.string()), ("doc_ids", pa.list_(pa.int64())),
                ("doc_lengths", pa.list_(pa.int64())), ("plane_ends", pa.list_(pa.int64())), ("planes", pa.binary())])
            out = pa.RecordBatch.from_pylist([row], schema)
            number, first = number + 1, first + len(ids)
            doc_ids.clear(), parts.clear(), lengths.clear()
            return out

        held = 0
        for got in batches:
            encode = encoder(tokenizer).encode
            for doc, text in zip(got.column("doc_id").to_pylist(), got.column("text")):
                ids = encode(text.as_py()) + end
                doc_ids.append(doc), parts.append(ids), lengths.append(len(ids) // 4)
                held += len(ids) // 4
                if held >= CHUNK_IDS:
                    yield batch()
                    held = 0
        if doc_ids:
            yield batch()

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE,
                 end_id: int = 2, layout: str = "byte", level: int = 3, shards: int | None = None) -> None:
    """Write the ids of every whole text, `end_id` after each, in ascending id order.

    Null text is empty: its ids are the end id alone. Rows without an id come first; rows of one id
    are ordered by their text, and a common id may fill several shards. Extra columns are ignored.
    An empty table gives a store without chunks. Without `shards`, one holds about `SHARD_DOCS` documents.
    """
    if layout not in PLANES:
        raise ValueError(f"layout is one of {sorted(PLANES)}, not {layout!r}")
    text = F.coalesce(named(text_col), F.lit(""))
    order = ["doc_id", F.xxhash64("text")]
    (docs.select(named(id_col).cast("long").alias("doc_id"), text.alias("text"))
     .repartitionByRange(shards or tasks(docs.sparkSession, docs.count(), SHARD_DOCS), *order)
     .sortWithinPartitions(*order, "text")
     .transform(in_arrow, _chunks(tokenizer, end_id, layout, level), CHUNK_SCHEMA)
     .write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path))


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _unpacked(row)
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                parts = [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                columns = [
                    pa.array([row["shard"]] * len(lengths), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first_id"] + ends - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of a store, decoded from its planes.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, with `with_ids`, ids. Where a shard starts comes
    from the index: one row per shard.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_offset"))
    ids = ", ids array<int>" if with_ids else ""
    docs = chunks.transform(
        in_arrow,
        _documents(with_ids), "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long" + ids)
    placed = docs.join(F.broadcast(offsets), "shard")
    return placed.select(
        "doc_id", (F.col("shard_offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))
