"""Benchmark passages in documents: a broadcast hash set of the benchmark's word windows.

The benchmark's windows (10 consecutive words; a shorter item is one window) are hashed into a set
that every task gets. A task looks its documents' words up in the benchmark's vocabulary, hashes
every window whose words are all known, asks the set, and compares the words of what it finds with
the benchmark's before it counts.

The set is broadcast in blocks of at most `BLOCK_BYTES` of benchmark text. A benchmark that fits one
block is scanned in one pass without a shuffle; a larger one takes a pass over the documents per
block, and the hits of the passes, which are few, are put together by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import DECISION_BYTES, byte_texts, free_names, in_arrow, named, sent_if_small, settled, text_digest

WINDOW = 10
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 10_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
# Bytes of words in lower case, all others as blanks.
NORMAL = bytes(b if b in WORD_BYTES else 0x20 for b in range(256)).lower()
WORD = re.compile(b"[0-9A-Za-z\x80-\xff]+")
HIT_SCHEMA = "doc_id long, text_digest binary, n_words long, starts array<long>, ends array<long>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters, in lower case, digits and all beyond ASCII."""
    return text.translate(NORMAL).split()


class Windows:
    """The windows of benchmark pieces (item, words), ready to be asked."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in pieces]
        number = self.vocabulary
        split = [[number.setdefault(w, len(number) + 1) for w in words.split()] for _, words in pieces]
        self.words = np.array([w for words in split for w in words], np.int64)
        at, by_length = 0, {}
        for i, words in enumerate(split):
            if words:
                size = min(window, len(words))
                starts, owners = by_length.setdefault(size, ([], []))
                starts.extend(range(at, at + len(words) - size + 1))
                owners.extend(repeat(i, len(words) - size + 1))
                at += len(words)
        self.tables = []
        for size, (starts, owners) in sorted(by_length.items()):
            starts, owners = np.array(starts), np.array(owners)
            hashes = self._hashed(self.words, starts, size)
            order = np.argsort(hashes, kind="stable")
            hashes, starts, owners = hashes[order], starts[order], owners[order]
            # A window that many items share is kept once, with the list of its owners.
            new = np.ones(len(starts), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            for j in range(size):
                new[1:] |= self.words[starts[1:] + j] != self.words[starts[:-1] + j]
            first = np.flatnonzero(new)
            self.tables.append((size, hashes[first], starts[first], np.append(first, len(starts)), owners))

    @staticmethod
    def _hashed(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for j in range(size):
            out = out * FACTOR + words[starts + j].astype(np.uint64)
            out ^= out >> np.uint64(29)
        return out

    def hits(self, text: list[bytes]) -> tuple[list[int], list[int], list[str]]:
        """Word ranges [start, end) inside occurrences of windows, merged, and the items they are from."""
        words = np.fromiter(map(self.vocabulary.get, text, repeat(0)), np.int64, len(text))
        known = np.concatenate([[0], np.cumsum(words > 0)])
        edges = np.zeros(len(words) + 1, np.int64)
        items = set()
        for size, hashes, starts, owned, owners in self.tables:
            if len(words) < size:
                continue
            asked = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(asked):
                continue
            own = self._hashed(words, asked, size)
            first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            found = set()
            for i in np.flatnonzero(first < last).tolist():
                at = int(asked[i])
                for k in range(first[i], last[i]):
                    if np.array_equal(self.words[starts[k]:starts[k] + size], words[at:at + size]):
                        found.add(k)
                        edges[at] += 1
                        edges[at + size] -= 1
            for k in found:
                items.update(map(self.items.__getitem__, set(owners[owned[k]:owned[k + 1]].tolist())))
        if not items:
            return [], [], []
        inside = np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8)])
        step = np.diff(inside)
        return np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), sorted(items)


def _pieces(window: int):
    """Items as pieces of bounded length; neighbours share window - 1 words, so no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, pieces = [], []
            for item, text in zip(batch.column("item").to_pylist(), byte_texts(batch.column("text"))):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    items.append(item)
                    pieces.append(b" ".join(words[at:at + PIECE_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], ["item", "words"])

    return run


def _scan(windows, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            n_words, found = [], []
            for text in byte_texts(batch.column("text")):
                words = words_of(text)
                n_words.append(len(words))
                found.append(known.hits(words))
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_digest"), pa.array(n_words, pa.int64()),
                 *(pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))],
                ["doc_id", "text_digest", "n_words", "starts", "ends", "items"])
            yield out if all_rows else out.filter(pa.array([bool(f[2]) for f in found], pa.bool_()))

    return run


def _union(spans) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the hits of several passes (all_starts, all_ends, all_items) as rows with their union."""
    for batch in batches:
        rows = batch.to_pylist()
        spans = [_union((a, b) for s, e in zip(r["all_starts"], r["all_ends"]) for a, b in zip(s, e)) for r in rows]
        items = [sorted({i for part in r["all_items"] for i in part}) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_digest"), batch.column("n_words"),
             pa.array([s[0] for s in spans], pa.list_(pa.int64())), pa.array([s[1] for s in spans], pa.list_(pa.int64())),
             pa.array(items, pa.list_(pa.string()))],
            ["doc_id", "text_digest", "n_words", "starts", "ends", "items"])



def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> tuple[int, Iterator[Windows]]:
    """How many blocks of the benchmark's windows there are, and the blocks, made one at a time."""
    item = F.coalesce(named(item_col).cast("string"), F.lit(""))
    pieces = settled(
        benchmark.select(item.alias("item"), F.coalesce(named(text_col), F.lit("")).alias("text"))
        .transform(in_arrow, _pieces(window), "item string, words binary").filter(F.octet_length("words") > 0).distinct())
    total = pieces.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def made() -> Iterator[Windows]:
        for k in range(n):
            part = pieces if n == 1 else pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k)
            yield Windows([(r.item, bytes(r.words)) for r in part.collect()], window)

    return n, made()


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, text_digest, n_words, hit word ranges (starts, ends), items.

    Null texts and items have no words; an item without words hits nothing; items without an id go
    by the empty string; items that share an id are one. An empty benchmark leaves all clean. Rows
    of one id and text have the same hits. Extra columns are ignored.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_digest(text).alias("text_digest"), text.alias("text"))
    context = docs.sparkSession.sparkContext
    n, blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    passes = []
    for k, windows in enumerate(blocks):
        sent = context.broadcast(windows)
        scanned = rows.transform(in_arrow, _scan(sent, k == 0), HIT_SCHEMA)
        if n == 1:
            return scanned
        passes.append(settled(scanned))
        sent.destroy()  # no task holds more than one block
    more = reduce(DataFrame.union, passes[1:]).groupBy(F.col("doc_id").alias("id_"), F.col("text_digest").alias("digest_")).agg(
        *(F.collect_set(c).alias(f"more_{c}") for c in ("items",)),
        F.collect_set(F.struct("starts", "ends")).alias("more_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_digest") == F.col("digest_"))
    both = passes[0].join(more, same, "left").select(
        "doc_id", "text_digest", "n_words",
        F.concat(F.array("starts"), F.coalesce(F.col("more_spans.starts"), F.array())).alias("all_starts"),
        F.concat(F.array("ends"), F.coalesce(F.col("more_spans.ends"), F.array())).alias("all_ends"),
        F.concat(F.array("items"), F.coalesce("more_items", F.array())).alias("all_items"))
    return both.transform(in_arrow, _together, HIT_SCHEMA)


def hit_report(hits: DataFrame) -> DataFrame:
    """Counts of `find_hits` rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _without_hits(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, starts, ends in zip(batch.column(text_at), batch.column(batch.num_columns - 2).to_pylist(),
                                          batch.column(batch.num_columns - 1).to_pylist()):
                text = text.as_py()
                if starts:
                    data = text.encode()
                    spans = [m.span() for m in WORD.finditer(data)]
                    kept, at = [], 0
                    for a, b in zip(starts, ends):
                        kept.append(data[at:spans[a][0]])
                        at = spans[b][0] if b < len(spans) else len(data)
                    text = b"".join([*kept, data[at:]]).decode()
                texts.append(text)
            columns = list(batch.columns[:-2])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """`docs` without the documents that hold benchmark windows, or without the passages alone.

    With remove="spans" the words of every hit range go, and what stands between them and up to the
    next word. Columns unchanged. Rows are known by id, null included, and digest of the text. Other
    options are those of `find_hits`.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    hits = settled(find_hits(docs, benchmark, id_col, text_col, **options).filter(F.size("items") > 0).dropDuplicates(["doc_id", "text_digest"]))
    doc, digest, starts, ends = free_names(docs, "doc_id_", "text_digest_", "starts_", "ends_")
    keyed = docs.withColumns({doc: named(id_col), digest: text_digest(named(text_col))})
    found = hits.select(
        F.col("doc_id").alias("found_id"), F.col("text_digest").alias("found_digest"), F.col("starts").alias(starts), F.col("ends").alias(ends))
    same = (keyed[digest] == found["found_digest"]) & keyed[doc].eqNullSafe(found["found_id"])
    own = [keyed[f"`{c}`"] for c in docs.columns]
    if remove == "documents":
        return keyed.join(sent_if_small(found.drop(starts, ends), DECISION_BYTES), same, "left_anti").select(*own)
    joined = keyed.join(found, same, "left").select(*own, starts, ends)
    return joined.transform(in_arrow, _without_hits(docs.columns.index(text_col)), docs.schema)
