"""Token ids of texts by a public tokenizer, with what was encoded before remembered per worker."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

BYTE_BPE = "byte_bpe_50k.json"
REMEMBERED = 250_000
LONG = 64

# Byte-level tokenizers split a text before they merge: runs of letters, of digits and of the rest,
# each with one space before it, and white space. No such part goes on after a letter that is
# followed by something else, or from a visible character to white space, and where one ends says
# nothing about the next. So a text may be cut there and its pieces encoded alone. The pattern
# cuts after whole runs of common Latin letters before ASCII, and else before white space.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"
PIECES = re.compile(rf"\s?{LETTERS}++(?=[\x00-\x7f]|\Z)|\s*\S+|\s+")
# A piece that is one such part, and so needs no splitting.
WORD = re.compile(rf"\x20?{LETTERS}+\Z")
# Characters that Python takes for white space and tokenizers do not.
ODD_SPACE = re.compile(r"[\x1c-\x1f]")


def tokenizer_file(name: str) -> str:
    """The file of a public tokenizer, or `name` itself if it is a path."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Pieces(dict):
    """Ids of pieces as bytes. Two generations: when the young one is full it becomes the old one."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(piece) > LONG:
                return ids
        self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts, those of the library's `encode` with `add_special_tokens=False`.

    So a marker of the tokenizer's file that stands in a text, such as its end-of-text token, is one id.
    """

    def __init__(self, name: str):
        path = tokenizer_file(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        split = parts.get("pre_tokenizer") or {}
        self.cuttable = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding"))
        added = {token["content"]: token for token in parts.get("added_tokens") or ()}
        self.cuttable &= not any(token["lstrip"] or token["rstrip"] or token["single_word"] for token in added.values())
        # Markers are cut out before all else, the longest where several start.
        self.markers = {content: _as_bytes([token["id"]]) for content, token in added.items()}
        self.marker = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pieces = _Pieces(self._encode_piece)
        self.model = self.tokenizer.model
        split = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.symbols = {code: split(chr(code))[0][0] for code in range(0x20, 0x100)}

    def _encode(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _encode_piece(self, piece: str) -> bytes:
        """A piece of a text that may be cut; a single word goes to the merges at once."""
        if WORD.match(piece):
            return _as_bytes([token.id for token in self.model.tokenize(piece.translate(self.symbols))])
        return self._encode(piece)

    def _encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        if not self.cuttable or ODD_SPACE.search(text):
            return self._encode(text)
        out, at = [], 0
        for m in self.marker.finditer(text) if self.marker else ():
            out += [self._encode_pieces(text[at:m.start()]), self.markers[m[0]]]
            at = m.end()
        out.append(self._encode_pieces(text[at:]))
        self.pieces.age()
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(name)
