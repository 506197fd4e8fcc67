"""The prefix trie of conversations, from adaptive radix trees over turn ids.

A turn is an id of fixed width: 16 bytes of the digest of its role and text and the code points of the
text as a big-endian number. A conversation is the byte string of its ids, so a prefix of turns is a
prefix of bytes. Spark orders conversations by these keys and cuts them into ranges; copies shrink to
their ids on the way, and text never travels. Every task inserts its range into an adaptive radix tree
(nodes that grow from 4 to 16, 48 and 256 children, compressed paths) and walks it: only byte depths
at the end of a turn are nodes of the trie.

As ranges are cut anywhere, a node can lie in several of them, but only if it is on the path of the
first or the last key of a range. Those open nodes, two paths a task, are merged by Spark: sums over
the tasks, less what neighbours counted twice. All others are final where they are found.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.llm.common import in_arrow, named, sent_if_small, settled, width

DIGEST, LENGTH = 16, 4
WIDTH = DIGEST + LENGTH
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Ids in one row of a sequence's members, turns of a task at most (of many conversations) and at least (while there are few).
IDS, TURNS, FEW_TURNS = 8_192, 250_000, 5_000
MEMBERS = "key binary, first long, n long, ids string"
CLOSED, FIRST, LAST = 0, 1, 2
FOUND = ("task int, side int, depth long, digest binary, parent_digest binary, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved long, length long, ends_sha256 string")
ROW_BYTES = 64


class Node:
    """A node of the tree: the bytes that lead to it from its parent, and its children by their first byte.

    Up to 4 and up to 16 children are a sorted list of bytes; up to 48 are found by an index of 256 places; above,
    there is a place for every byte.
    """

    __slots__ = ("prefix", "value", "layout", "index", "children")

    def __init__(self, prefix: bytes, value: int | None = None):
        self.prefix, self.value = prefix, value
        self.layout, self.index, self.children = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = bisect_left(self.index, byte)
            return self.children[at] if at < len(self.index) and self.index[at] == byte else None
        if self.layout == 48:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, node: Node) -> None:
        """Add a child, or put it in the place of the one with the same first byte."""
        byte = node.prefix[0]
        if self.layout <= 16:
            at = bisect_left(self.index, byte)
            if at < len(self.index) and self.index[at] == byte:
                self.children[at] = node
                return
            if len(self.index) < self.layout:
                self.index.insert(at, byte)
                self.children.insert(at, node)
                return
            self._grow()
            self.put(node)
        elif self.layout == 48:
            if at := self.index[byte]:
                self.children[at - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.index[byte] = len(self.children)
            else:
                self._grow()
                self.put(node)
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.index):
                index[byte] = at + 1
            self.layout, self.index = 48, index
        else:
            self.layout, self.children, self.index = 256, [self.children[at - 1] if at else None for at in self.index], bytearray()

    def in_order(self) -> list[Node]:
        """The children by their first byte."""
        if self.layout <= 16:
            return self.children
        if self.layout == 48:
            return [self.children[at - 1] for at in self.index if at]
        return [node for node in self.children if node is not None]


def _common(prefix: bytes, key: bytes, at: int) -> int:
    """How many bytes of `prefix` the key has from `at` on."""
    low, high = 0, min(len(prefix), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(prefix[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    """Byte strings with a number each."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: int) -> None:
        node, above, at = self.root, None, 0
        while True:
            if not key.startswith(node.prefix, at):
                same = _common(node.prefix, key, at)
                fork = Node(node.prefix[:same])
                node.prefix = node.prefix[same:]
                fork.put(node)
                above.put(fork)
                node = fork
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(Node(key[at:], value))
                return
            node, above = below, node


class Trie(NamedTuple):
    """Nodes of turns, parents before children: the parent of each, its depth, the code points of its last text; the node of each value."""

    parents: list[int]
    depths: list[int]
    lengths: list[int]
    ends: dict[int, int]


def trie_of(tree: RadixTree) -> Trie:
    """The nodes at the depths of the tree where a turn ends."""
    trie = Trie([-1], [0], [0], {})
    path = bytearray()
    waiting = [(tree.root, 0, 0)]
    while waiting:
        node, start, above = waiting.pop()
        path[start:] = node.prefix
        for depth in range((start // WIDTH + 1) * WIDTH, len(path) + 1, WIDTH):
            trie.parents.append(above)
            trie.depths.append(depth // WIDTH)
            trie.lengths.append(int.from_bytes(path[depth - LENGTH:depth], "big"))
            above = len(trie.parents) - 1
        if node.value is not None:
            trie.ends[node.value] = above
        end = len(path)
        waiting += [(below, end, above) for below in reversed(node.in_order())]
    return trie


class Ending(NamedTuple):
    """The conversations of one whole sequence of turns."""

    key: bytes
    n: int
    least: int
    ids_sha256: str


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[Ending]:
    """One per key of rows (key, first, n, ids) in order of key and first: their ids pass through a hash, none is held."""
    key, n, least, digest = None, 0, 0, None
    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in ("key", "first", "n", "ids"))):
            if row[0] != key:
                if key is not None:
                    yield Ending(key, n, least, digest.hexdigest())
                key, n, least, digest = row[0], 0, row[1], hashlib.sha256()
            digest.update((("," if n else "") + row[3]).encode())
            n += row[2]
    if key is not None:
        yield Ending(key, n, least, digest.hexdigest())


def _chain(key: bytes, node: int, trie: Trie) -> Iterator[tuple[int, bytes]]:
    """(node, digest of its turns) from the root to a node whose turns are the key's."""
    up = [node]
    while (node := trie.parents[node]) >= 0:
        up.append(node)
    digest = hashlib.sha256()
    for depth, node in enumerate(reversed(up)):
        digest.update(key[(depth - 1) * WIDTH:depth * WIDTH] if depth else b"")
        yield node, digest.digest()


def nodes_of(endings: list[Ending], task: int) -> Iterator[tuple]:
    """Rows of `FOUND` of the trie of one range, its endings in order of their keys.

    Of open nodes, `n_children`, `n_leaves` and `saved` are what the closed ones below them bring, and
    `saved` all conversations times the text of open ones: none is taken off yet for the first.
    """
    tree = RadixTree()
    for i, ending in enumerate(endings):
        tree.insert(ending.key, i)
    trie = trie_of(tree)
    size = len(trie.parents)
    n, least, sha = [0] * size, [None] * size, [NO_ENDS] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for i, ending in enumerate(endings):
        at = trie.ends[i]
        n[at], least[at], sha[at] = ending.n, ending.least, ending.ids_sha256
    firsts = dict(_chain(endings[0].key, trie.ends[0], trie))
    lasts = dict(_chain(endings[-1].key, trie.ends[len(endings) - 1], trie))
    digests = firsts | lasts
    for at in range(size - 1, -1, -1):
        if at in digests:
            saved[at] += n[at] * trie.lengths[at]
        else:
            saved[at] += (n[at] - 1) * trie.lengths[at]
            leaves[at] += not children[at]
        above = trie.parents[at]
        if above >= 0:
            n[above] += n[at]
            least[above] = least[at] if least[above] is None else min(least[above], least[at])
            children[above] += at not in digests
            leaves[above] += leaves[at]
            saved[above] += saved[at]
    for at in range(size):
        above = trie.parents[at]
        side = CLOSED if at not in digests else FIRST if at in firsts else LAST
        yield (task, side, trie.depths[at], digests.get(at), digests.get(above), least[at],
               None if above < 0 or above in digests else least[above], n[at], children[at], leaves[at], saved[at], trie.lengths[at],
               sha[at] if side == CLOSED or sha[at] != NO_ENDS else None)
    if len(lasts.keys() - firsts.keys()):
        for at in lasts.keys() & firsts.keys():  # the path of the last key is whole too; these have told what they bring
            yield (task, LAST, trie.depths[at], digests[at], digests.get(trie.parents[at]), None, None, 0, 0, 0, 0, trie.lengths[at], None)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    endings = list(_endings(batches))
    if not endings:
        return
    schema = pa.schema([
        ("task", pa.int32()), ("side", pa.int32()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent_digest", pa.binary()),
        *((name, pa.int64()) for name in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "length")),
        ("ends_sha256", pa.string())])
    rows = []
    for row in nodes_of(endings, TaskContext.get().partitionId()):
        rows.append(row)
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order as rows of at most `IDS` ids of one key."""
    rows, key, ids = [], None, []

    def batch() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows)] or [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            ["key", "first", "n", "ids"])

    def end() -> None:
        if ids:
            rows.append((key, ids[0], len(ids), ",".join(map(str, ids))))
            ids.clear()

    for got in batches:
        for next_key, conv in zip(got.column("key").to_pylist(), got.column("conv_id").to_pylist()):
            if next_key != key or len(ids) == IDS:
                end()
                key = next_key
            ids.append(conv)
        yield batch()
    end()
    yield batch()


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn as hexadecimal digits."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 2 * DIGEST), F.lpad(F.hex(F.length(text)), 2 * LENGTH, "0"))


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, ids) of every conversation: the ids of its turns in order."""
    turns = conversations.select(
        named(conv_col).cast("long").alias("conv_id"), named(turn_col).alias("turn"), turn_id(named(role_col), named(text_col)).alias("id")
    ).filter("conv_id IS NOT NULL")
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id"))).alias("turns"))
    return ordered.select("conv_id", F.col("turns.id").alias("ids"))


def rebuilt(seqs: DataFrame, block: int, most_shared: int) -> DataFrame:
    """(conv_id, ids) with the first h turns replaced by those of the conversation that starts its block of ids.

    h is the CRC-32 of the decimal id modulo `most_shared` + 1.
    """
    heads = seqs.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most_shared).alias("head"))
    own = seqs.select(
        "conv_id", "ids", (F.col("conv_id") - F.col("conv_id") % block).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % (most_shared + 1)).cast("int").alias("h"))
    return own.join(heads, "base", "left").selectExpr(
        "conv_id", "concat(if(head IS NULL, slice(ids, 1, 0), slice(head, 1, h)), slice(ids, h + 1, greatest(size(ids) - h, 0))) AS ids")


def _tasks(spark: SparkSession, turns: int) -> int:
    return max(-(-turns // TURNS), min(width(spark), -(-turns // FEW_TURNS)), 1)


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_chars, ends_sha256: the trie of `seqs` (conv_id, ids).

    A row per distinct sequence of the first turns of a conversation, the empty one too. Its members
    are the conversations that start with it; conv_id is the smallest. parent_conv_id is that of the
    sequence without its last turn (root: null), n_convs counts the members, n_children the sequences
    that are longer by a turn, n_leaves those in its subtree (itself included) that no other extends.
    saved_chars sums over the subtree the members but one times the code points of the last text.
    ends_sha256 is the SHA-256 of the ids of the members that end there, ascending, joined by commas.

    Ids must be unique. Without conversations there is no row, not even the root. A task holds the
    trie of a range of sequences, about `TURNS` turns of it, and at least one sequence whole, as ids
    of 20 bytes a turn; ids of copies stream through it.
    """
    spark = seqs.sparkSession
    keyed = settled(seqs.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key")))
    tasks = _tasks(spark, int(keyed.agg(F.sum(F.octet_length("key") / WIDTH + 1)).first()[0] or 0))
    members = settled(keyed.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id").transform(in_arrow, _members, MEMBERS))
    found = settled(members.repartitionByRange(tasks, "key").sortWithinPartitions("key", "first").transform(in_arrow, _found, FOUND))

    parts = found.filter(F.col("side") != CLOSED)
    same = parts.groupBy("digest", "parent_digest", "depth", "length").agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.min("conv_id").alias("conv_id"),
        F.max("ends_sha256").alias("ends_sha256"), F.min(F.struct("task", "side")).alias("owner"))
    extended = same.groupBy(F.col("parent_digest").alias("above")).agg(F.count("*").alias("open_children"))
    nodes = settled(
        same.join(extended, same["digest"] == extended["above"], "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0))).drop("above", "open_children"))
    # Each open node is counted on one path alone, and from there for all that lie above it.
    own = F.col("owner") == F.struct("task", "side")
    counted = parts.select("task", "side", "digest").join(nodes.select("digest", "depth", "length", "n_children", "owner"), "digest").select(
        "task", "side", "digest", "depth", F.when(own, F.col("length")).otherwise(0).alias("length"),
        F.when(own & (F.col("n_children") == 0), 1).otherwise(0).alias("leaf"))
    below = "OVER (PARTITION BY task, side ORDER BY depth DESC ROWS UNBOUNDED PRECEDING)"
    sums = counted.selectExpr("digest", f"sum(length) {below} AS open_length", f"sum(leaf) {below} AS open_leaves").groupBy("digest").agg(
        F.sum("open_length").alias("open_length"), F.sum("open_leaves").alias("open_leaves"))
    parents = sent_if_small(nodes.select(F.col("digest").alias("above"), F.col("conv_id").alias("above_conv_id")), ROW_BYTES)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    opened = nodes.join(sums, "digest").join(parents, F.col("parent_digest") == F.col("above"), "left").select(
        "conv_id", "depth", F.col("above_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("open_leaves")).alias("n_leaves"), (F.col("saved") - F.col("open_length")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    closed = found.filter(F.col("side") == CLOSED)
    inner = closed.filter("parent_digest IS NULL").select(*columns)
    outer = closed.filter("parent_digest IS NOT NULL").join(parents, F.col("parent_digest") == F.col("above")).withColumn(
        "parent_conv_id", F.col("above_conv_id")).select(*columns)
    return inner.unionByName(outer).unionByName(opened).withColumnRenamed("saved", "saved_chars")


def conversation_nodes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text", block: int | None = 100, most_shared: int = 5) -> DataFrame:
    """The prefix trie of conversations, see `prefix_trie`; with `block`, of the rebuilt ones, see `rebuilt`.

    Turns are in order of `turn_col`, null first; turns of one number in order of their ids, so the
    order of rows does not matter, and repeated rows are repeated turns. Null role or text is empty,
    rows without a conversation id belong to none. Extra columns are ignored.
    """
    seqs = sequences(conversations, conv_col, turn_col, role_col, text_col)
    return prefix_trie(seqs if block is None else rebuilt(seqs, block, most_shared))


def trie_sql(block: int = 100, most_shared: int = 5) -> str:
    """The same over the table `conversations`, with every prefix as a list of turns."""
    return f"""
        WITH t AS (SELECT conv_id, turn, struct_pack(role := coalesce(role, ''), "text" := coalesce("text", '')) AS t,
                          left(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce("text", '')), 32) AS id
                   FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv_id),
        h AS (SELECT conv_id, turns, conv_id - conv_id % {block} AS base, xor(list_reduce(
                  list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                           lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
                  4294967295::BIGINT) % {most_shared + 1} AS h FROM s),
        r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h], h.turns[h + 1:]) AS turns FROM h LEFT JOIN s b ON b.conv_id = h.base),
        n AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(turns)) AS ends
              FROM (SELECT conv_id, turns, d, turns[1:d] AS prefix FROM r, unnest(range(0, len(turns) + 1)) AS u(d)) GROUP BY ALL),
        c AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(prefix[d]['text']) END AS own
              FROM n LEFT JOIN c USING (prefix)),
        b AS (SELECT prefix[1:a] AS prefix, sum(own) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
              FROM w, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
        SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, b.n_leaves,
               b.saved::BIGINT AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
        FROM w JOIN b USING (prefix) LEFT JOIN n p ON w.d > 0 AND p.prefix = w.prefix[1:w.d - 1]
    """
