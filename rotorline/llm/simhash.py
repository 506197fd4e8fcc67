"""Near duplicates by SimHash fingerprints and BK-trees.

A BK-tree keys the children of a node by their integer Hamming distance to it, so a search within a
radius follows only the edges whose key lies within the radius of the distance to the node.

One tree over all fingerprints would fit no task, so fingerprints are dealt to shards. Cut into
`radius + 2` blocks of bits, two fingerprints within the radius agree in at least two blocks; a shard
holds those that agree in one pair of blocks, so a pair within the radius meets in some shard and
hardly anything else does. A crowded shard is dealt once more: the bits that its fingerprints need not
share are cut into blocks too, and again two of them agree. A shard above `SHARD` fingerprints is cut
into parts, and the tree of each part is sent to every part of the shard. That is this operator's broadcast: all trees together grow
with the corpus, so they go to the tasks that ask them and not to all. A task holds two parts at most.

Inside a task the hits are joined up at once, so that a part gives a link per member and not all
pairs; `components` puts the links of all shards together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import byte_texts, in_arrow, keep_decided, named, settled, tasks, text_digest
from rotorline.llm.components import components

SEED = 42
SHARD = 2_048
#: Parts of a shard from which it is dealt once more, and rows of a task of shards.
MOST_PARTS, CELL_ROWS = 4, 1_000_000
BLOCK_SHINGLES = 65_536


def simhash(text: bytes, shingle: int) -> int:
    """The 64-bit fingerprint of a UTF-8 text: majority of the bits of the XXH64 of its word shingles.

    Words are what white space (ASCII) parts, A-Z in lower case; shingles count as often as they
    occur. A text of fewer words is one shingle, a text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK_SHINGLES):
        stop = min(n, at + BLOCK_SHINGLES)
        spans = zip(starts[at:stop].tolist(), ends[at:stop].tolist())
        hashes = np.array([of(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


class BKTree:
    """Distinct integers, each the child of its parent by their Hamming distance."""

    def __init__(self, values=()):
        self.root: tuple | None = None
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while distance := (node[0] ^ value).bit_count():
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The values at most `radius` from `value`."""
        waiting = [self.root] if self.root else []
        while waiting:
            own, children = waiting.pop()
            distance = (own ^ value).bit_count()
            if distance <= radius:
                yield own
            if len(children) <= 2 * radius:
                waiting.extend(c for edge, c in children.items() if abs(edge - distance) <= radius)
            else:
                for edge in range(max(1, distance - radius), distance + radius + 1):
                    if child := children.get(edge):
                        waiting.append(child)


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(text, shingle) for text in byte_texts(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_digest"), pa.array(prints.view(np.int64))],
                ["doc_id", "text_digest", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_digest, print) per document; `print` is the fingerprint as a signed long."""
    text = F.coalesce(named(text_col), F.lit(""))
    return docs.select(
        named(id_col).cast("long").alias("doc_id"), text_digest(text).alias("text_digest"), text.alias("text"),
    ).transform(in_arrow, _prints(shingle), "doc_id long, text_digest binary, print long")


def _pairs(places: list[int], radius: int) -> list[tuple[int, list[int]]]:
    """Bits cut into blocks: per pair of blocks the mask of its bits, as a signed long, and the other bits."""
    edges = [len(places) * i // (radius + 2) for i in range(radius + 3)]
    blocks = [places[a:b] for a, b in zip(edges, edges[1:])]
    out = []
    for pair in combinations(range(len(blocks)), 2):
        mask = sum(1 << bit for i in pair for bit in blocks[i])
        out.append((mask - (1 << 64) if mask >> 63 else mask, [bit for i, block in enumerate(blocks) if i not in pair for bit in block]))
    return out


def _keys(pairs: list[tuple[int, list[int]]], first: int, shared: int = 0) -> Column:
    """Of each fingerprint its bits in every pair of blocks, and in `shared`, with the number of the pair."""
    return F.array(*[
        F.struct(F.lit(first + i).alias("table"), F.col("print").bitwiseAND(F.lit(mask | shared).cast("long")).alias("bits"))
        for i, (mask, _) in enumerate(pairs)])


def _cells(prints: DataFrame, radius: int) -> DataFrame:
    """(print, table, bits, n): the shards with several fingerprints, n of them, that two within the radius meet in."""
    pairs = _pairs(list(range(64)), radius)

    def shared(keyed: DataFrame) -> DataFrame:
        of = keyed.groupBy("table", "bits").agg(F.count("*").alias("n")).filter("n > 1")
        return keyed.join(of, ["table", "bits"])

    dealt = shared(prints.select("print", F.explode(_keys(pairs, 0)).alias("key")).select("print", "key.*"))
    crowded = F.col("n") > MOST_PARTS * SHARD
    again = F.when(F.lit(False), F.lit(None))
    for i, (mask, rest) in enumerate(pairs):
        again = again.when(F.col("table") == i, _keys(_pairs(rest, radius), (i + 1) * len(pairs), mask))
    finer = shared(dealt.filter(crowded).select("print", F.explode(again).alias("key")).select("print", "key.*"))
    return dealt.filter(~crowded).select("print", "table", "bits", "n").unionByName(finer.select("print", "table", "bits", "n"))


def _joined(tree: BKTree, members: list[int], asked: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join up what lies within the radius: every member with the smallest it reaches."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            parent[v] = parent.get(up, up)
            v = parent[v]
        return v

    for value in asked:
        for hit in tree.within(value, radius):
            if hit != value and (a := root(value)) != (b := root(hit)):
                parent[max(a, b)] = min(a, b)
    for value in {*members, *asked}:
        if (top := root(value)) != value:
            yield value, top


def _cell_links(radius: int):
    """Over rows (table, bits, a, b, part, print) sorted by cell: the links of each cell (table, bits, a, b).

    The fingerprints of part `a` make the tree and those of part `b` ask it.
    """

    def close(cell, rows) -> Iterator[tuple[int, int]]:
        a, b = cell[2], cell[3]
        tree_of = [v for part, v in rows if part == a]
        asked = tree_of if a == b else [v for part, v in rows if part == b]
        if len(rows) > 1 and tree_of and asked:
            yield from _joined(BKTree(tree_of), tree_of, asked, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, links = None, [], []

        def batch() -> pa.RecordBatch:
            hi, lo = (pa.array([link[i] - (1 << 64) if link[i] >> 63 else link[i] for link in links], pa.int64()) for i in (0, 1))
            links.clear()
            return pa.RecordBatch.from_arrays([hi, lo], ["x", "y"])

        for got in batches:
            columns = [got.column(c).to_pylist() for c in ("table", "bits", "a", "b", "part", "print")]
            for *at, part, value in zip(*columns):
                if at != cell:
                    if cell is not None:
                        links.extend(close(cell, rows))
                    cell, rows = at, []
                rows.append((part, value & 0xFFFFFFFFFFFFFFFF))
                if len(links) >= 50_000:
                    yield batch()
        if cell is not None:
            links.extend(close(cell, rows))
        if links:
            yield batch()

    return run


def print_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (hi, lo) that join up all distinct values of `prints` (print) within the radius."""
    if not 0 <= radius <= 16:
        raise ValueError("radius is 0 to 16 bits")
    parts = F.ceil(F.col("n") / SHARD).cast("int")
    own = F.pmod(F.xxhash64("print"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = (
        _cells(prints, radius).withColumn("parts", parts).withColumn("part", own)
        .withColumn("other", other)
        .select("table", "bits", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "print")
    )
    cell = ["table", "bits", "a", "b"]
    links = (
        cells.repartition(tasks(prints.sparkSession, prints.count(), CELL_ROWS), *cell).sortWithinPartitions(*cell)
        .transform(in_arrow, _cell_links(radius), "x long, y long")
    )
    return links.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept, text_digest.

    Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the
    smallest doc_id reachable over links. Null and empty texts have fingerprint zero and are linked
    like any other. A null id is never a component_id, unless a component has no other. The row of
    the smallest id stays, of equal ids the one with the smallest text digest; rows that agree in id
    and text share one decision. Extra columns are ignored.
    """
    prints = settled(fingerprints(docs, id_col, text_col, shingle))
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_digest")
    values = settled(prints.groupBy("print").agg(F.min(least).alias("least")))
    roots = components(print_links(values, radius))
    placed = values.join(roots, values["print"] == roots["vertex"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("first"))
    groups = placed.select("print", "root").join(firsts, "root").select(F.col("print").alias("print_"), "first")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_digest") == F.col("first.text_digest"))
    return prints.join(groups, F.col("print") == F.col("print_"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        same.alias("kept"), "text_digest",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """`docs` with one document of each group of near duplicates, columns unchanged; see `near_groups`."""
    groups = near_groups(docs, id_col, text_col, shingle, radius)
    decisions = settled(
        groups.groupBy("doc_id", "text_digest").agg(F.first("kept").alias("kept"), F.count("*").alias("copies"))
        .filter("not kept or copies > 1"))
    return keep_decided(docs, decisions, id_col, text_col)
