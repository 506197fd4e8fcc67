"""Packing examples into sequences under several limits at once.

A sequence has room for so many tokens, so many segments and so many loss-bearing tokens; an example
takes some of each. That is vector bin packing, and the rule is the dot product: of the examples that
fit an open sequence, the one whose demands point most in the direction of the room left is placed,
both as shares of the limits. So a long example goes first where tokens are plenty, short ones where
few segments would waste them, and prompts without loss where the loss is used up. Where none fits
whole, one is cut to fill the rest, and its remainder waits on. A sequence that reaches its limit of
segments or loss before it is full ends at a power of two, which needs no padding.

Every partition packs what it reads and holds `POOL` waiting examples, or as many as a sequence may
take. What is left at its end goes to sequences of 2, 4, 8, ... tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rotorline.llm.common import in_arrow, named
from rotorline.llm.tokens import BYTE_BPE, encoder

POOL = 256
IDS_OF_PARTITION = 33


class Limits(NamedTuple):
    """What a sequence may hold."""

    tokens: int = 1024
    segments: int = 1024
    loss: int = 1024


class Piece(NamedTuple):
    """A run of one example's ids, waiting or placed."""

    doc: object
    start: int
    ids: bytes
    doc_tokens: int
    bears_loss: bool

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return (self._replace(ids=self.ids[:4 * length]),
                self._replace(start=self.start + length, ids=self.ids[4 * length:]))


class Packer:
    """Places pieces into sequences; `add` and `finish` yield each sequence as a list of pieces.

    Sequences are made while `pool` pieces or more wait that fill one: with short pieces, `pool` is
    exceeded, up to the limit of tokens.
    """

    def __init__(self, limits: Limits, pool: int = POOL):
        if min(limits) < 1:
            raise ValueError("every limit is 1 or more")
        self.limits, self.pool = limits, pool
        self.pieces: list[Piece | None] = [None] * pool
        self.free = list(range(pool))
        # what the piece of each place takes of tokens and of loss; 0 tokens: the place is free
        self.tokens, self.loss = np.zeros(pool), np.zeros(pool)
        self.waiting = self.waiting_tokens = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        most = min(self.limits.tokens, self.limits.loss) if piece.bears_loss else self.limits.tokens
        while piece.length > most:
            whole, piece = piece.cut(most)
            yield from self._wait(whole)
        if piece.length:
            yield from self._wait(piece)

    def _wait(self, piece: Piece) -> Iterator[list[Piece]]:
        if piece.length == self.limits.tokens:
            yield [piece]
            return
        self._put(piece)
        if self.waiting < self.pool or self.waiting_tokens < self.limits.tokens:
            return
        while self.waiting > self.pool // 2 and self.waiting_tokens >= self.limits.tokens:
            yield self._sequence(self.limits.tokens)

    def _put(self, piece: Piece) -> None:
        if not self.free:
            size = len(self.pieces)
            self.free = list(range(size, 2 * size))
            self.pieces += [None] * size
            self.tokens, self.loss = np.concatenate([self.tokens, np.zeros(size)]), np.concatenate([self.loss, np.zeros(size)])
        at = self.free.pop()
        self.waiting, self.waiting_tokens = self.waiting + 1, self.waiting_tokens + piece.length
        self.pieces[at] = piece
        self.tokens[at], self.loss[at] = piece.length, piece.length * piece.bears_loss

    def _take(self, at: int) -> Piece:
        piece = self.pieces[at]
        self.pieces[at], self.tokens[at], self.loss[at] = None, 0, 0
        self.free.append(at)
        self.waiting, self.waiting_tokens = self.waiting - 1, self.waiting_tokens - piece.length
        return piece

    def finish(self) -> Iterator[list[Piece]]:
        while left := self.waiting_tokens:
            size = self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1)
            yield self._sequence(size)

    def _sequence(self, size: int) -> list[Piece]:
        """One sequence of at most `size` tokens, of waiting pieces."""
        tokens, segments, loss = size, self.limits.segments, self.limits.loss
        out: list[Piece] = []

        def best(allowed: np.ndarray) -> int | None:
            # Demands times room, both as shares of the limits. Every piece is one segment, so that
            # term of the product is the same for all.
            product = self.tokens * (tokens / size**2) + self.loss * (loss / self.limits.loss**2)
            product[~allowed] = -1.0
            at = int(product.argmax())
            return at if product[at] >= 0 else None

        while tokens and segments:
            at = best((self.tokens > 0) & (self.tokens <= tokens) & (self.loss <= loss))
            if at is None:
                break
            out.append(self._take(at))
            tokens -= out[-1].length
            segments -= 1
            loss -= out[-1].length * out[-1].bears_loss
        if tokens and segments:
            at = best((self.tokens > 0) & ((self.loss == 0) | (loss > 0)))
            if at is not None:
                piece = self._take(at)
                part, rest = piece.cut(min(tokens, loss) if piece.bears_loss else tokens)
                out.append(part)
                self._put(rest)
                tokens -= part.length
        if tokens:
            self._shorten(out, size - tokens)
        return out

    def _shorten(self, pieces: list[Piece], length: int) -> None:
        """Let the last pieces of a sequence wait on, as far as its length is above a power of two."""
        over = length - (1 << (length.bit_length() - 1))
        while over:
            piece = pieces.pop()
            if piece.length > over:
                kept, piece = piece.cut(piece.length - over)
                pieces.append(kept)
            over -= piece.length
            self._put(piece)


def _packed(tokenizer: str, end_id: int, limits: Limits, id_type: pa.DataType):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << IDS_OF_PARTITION
        packer, rows = Packer(limits), []
        end = np.array([end_id], "<u4").tobytes()

        def place(sequences) -> None:
            nonlocal number
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    rows.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, number, offset))
                    offset += p.length
                number += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for got in batches:
            encode = encoder(tokenizer).encode
            for doc, text, loss in zip(got.column("doc_id").to_pylist(), got.column("text"), got.column("loss").to_pylist()):
                ids = encode(text.as_py()) + end
                place(packer.add(Piece(doc, 0, ids, len(ids) // 4, loss)))
                if len(rows) >= 10_000:
                    yield batch()
        place(packer.finish())
        if rows:
            yield batch()

    return run


def pack(examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
         tokenizer: str = BYTE_BPE, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Pack the ids of every whole text, `end_id` after each, into sequences within `limits`.

    One row per piece: doc_id, start (the example's ids before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), doc_tokens (of the whole example), sequence_id, offset
    (where the piece starts in its sequence). Each id lies in exactly one piece. `loss_col` (boolean,
    null is false) says whose tokens bear loss, all without it. Null text is empty: its only id is
    the end id. Ids may be null or repeat; each row is an example of its own. Extra columns are
    ignored. No shuffle: a partition packs its own rows, and sequence_id starts with its number.
    """
    loss = F.coalesce(named(loss_col), F.lit(False)) if loss_col else F.lit(True)
    chosen = examples.select(
        named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"), loss.alias("loss"))
    kind = chosen.schema["doc_id"].dataType
    schema = (f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")
    return chosen.transform(in_arrow, _packed(tokenizer, end_id, limits, to_arrow_type(kind)), schema)
