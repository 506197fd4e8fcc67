"""Secrets in documents, also below layers of encoding.

Every document is a worklist of layers. The first is its text; each layer is scanned, and what can be
unwrapped in it (percent escapes, form encoding, string and character escapes, base64 runs, compressed
data) makes further layers, until none is new. A layer that came before with the same place is not
entered again, so data that unpack to themselves end. Spans are told in the document: a layer knows what
was replaced in the one it was made of, and asks that one for its places. Bytes that are decoded stand for
a character each, as all that is looked for is ASCII.

Every layer is cut where nothing that is looked for can go on, and only pieces in which something is
wrapped make further layers, one piece at a time.
Escapes of escapes are unwrapped `LEVELS` times layer by layer; what is still wrapped then goes to its
end in one pass, as each escape that is completed is resolved at once, so a long chain takes linear time.

Only compressed data grow when unwrapped, and all they unpack to has one place. So they are streams: a
block at a time is read, found in, and let go. A run without a place to cut it is read in windows that
overlap by `OVERLAP` characters, more than any secret needs to be seen; base64 in it is a stream too, at
four alignments, and may hold compressed data of any length.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import byte_texts, in_arrow, named

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_BYTES = bytes(0x78 if b in b"0123456789abcdef" else 0x20 for b in range(256))
BASE64_BYTES = bytes(
    0x78 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_" else 0x20 for b in range(256))

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
FORM = re.compile(r"(?:(?<!\+)\+++)?+(?:(?:%[0-9A-Fa-f]{2})++\+*+)++")
FORM_SEEN = re.compile(r"\+%[0-9A-Fa-f]{2}|%[0-9A-Fa-f]{2}\+")
FORM_BYTE = re.compile(r"\+|%..")
UNICODE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
    r"|\\([nrt\"'/\\])")
#: The escapes that a character may end, for one after the other.
ENDED = re.compile(
    r"(?:%([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
    r"|\\([nrt\"'/\\]))\Z")
LONGEST_ESCAPE = 11
ENDS = frozenset("0123456789abcdefABCDEF};nrt\"'/\\")
SIMPLE = {"n": "\n", "r": "\r", "t": "\t"}
ESCAPE_BYTES = re.compile(rb"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]")
ANY_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]|\\[nrt\"'/\\]")
#: Where text of either order of UTF-16 is seen: every second byte is NUL.
WIDE = {"utf-16-le": re.compile(rb"(?:[^\0]\0){4}"), "utf-16-be": re.compile(rb"(?:\0[^\0]){4}")}
LEAST_BASE64 = 16
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[A-Za-z0-9+/_-]++)+={0,2}")
NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/_\r\n-]+")
PLAIN = str.maketrans("-_", "+/")
MAGIC = (b"\x1f\x8b", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00")
COMPRESSED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0")
#: Bytes that tell a magic, and from its start on those of which one must have been escaped.
MAGIC_BYTES, NEAR = 10, 32
FILLED = re.compile(rb"\0*")
LINE_END = re.compile(rb"[\r\n]")
BLANKS = re.compile(" {257,}")
#: Bytes that the compressed data of one document may unpack to; None for no limit.
MOST_UNPACKED = None
#: Compressed bytes read at a time, characters of a block of unpacked text, and of a piece of a layer, if there is a place to cut it.
FEED, BLOCK, PIECE = 4 << 10, 1 << 20, 1 << 10
#: Characters of unpacked text without a cut that are still one block, and how far windows of longer ones overlap.
LONG_RUN, OVERLAP = 1 << 21, 4 << 10
#: Compressed bytes after which a stream that turns out broken is not tried again from its second byte.
REWIND = 1 << 16
#: Layers inside one another that are entered at once; compressed data further down wait until these are done.
DEEP = 60
#: Passes of unescaping that are layers of their own, however long the layer is.
LEVELS = 4
#: Characters that no pattern has: nothing that is looked for, in a text or a layer of it, goes on over one.
CUT_BYTES = bytes(0x20 if chr(b) in "+/_.=%\\&#;{}:\"' \r\n-" or chr(b).isascii() and chr(b).isalnum() else 0x78 for b in range(256))
#: Nor over a blank after a letter that ends no escape and before a letter.
LETTERS, ENDLESS = (frozenset(b"".join(bytes(range(ord(a), ord(z) + 1)) for a, z in pairs)) for pairs in (("AZ", "az"), ("GZ", "gz")))


def plain_bytes(text: str) -> bytes:
    """A byte for each character, the same for ASCII and those of a byte; others are question marks, which nothing has either."""
    return text.encode("latin-1", "replace")


def next_cut(data: bytes, marks: bytes, at: int) -> int:
    """Where the first place ends, from `at` on, that nothing goes on over; -1 if there is none. `marks` are the data by `CUT_BYTES`."""
    mark = marks.find(b"x", at)
    blank = data.find(b" ", at + 1, mark if mark >= 0 else len(data))
    while blank >= 0:
        if data[blank - 1] in ENDLESS and blank + 1 < len(data) and data[blank + 1] in LETTERS:
            return blank + 1
        blank = data.find(b" ", blank + 1, mark if mark >= 0 else len(data))
    return mark + 1 if mark >= 0 else -1


class Document:
    """Places of the document itself."""

    def starts(self, at: np.ndarray) -> np.ndarray:
        return at

    def ends(self, at: np.ndarray) -> np.ndarray:
        return at + 1


class Part:
    """Places of a part of a layer."""

    def __init__(self, above, offset: int):
        self.above, self.offset = above, offset

    def starts(self, at: np.ndarray) -> np.ndarray:
        return self.above.starts(at + self.offset)

    def ends(self, at: np.ndarray) -> np.ndarray:
        return self.above.ends(at + self.offset)


class OnePlace:
    """One range of the document for all characters."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end

    def starts(self, at: np.ndarray) -> np.ndarray:
        return np.full(len(at), self.start)

    def ends(self, at: np.ndarray) -> np.ndarray:
        return np.full(len(at), self.end)


class Replaced:
    """Places of a layer some of whose characters stand for ranges of the layer it was made of, the others for themselves."""

    def __init__(self, above, at, first, last):
        self.above = above
        self.at, self.first, self.last = (np.asarray(a, np.int64) for a in (at, first, last))

    def _own(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The replaced characters at or before the given ones, -1 for none, and the places that unreplaced ones had."""
        of = np.searchsorted(self.at, at, "right") - 1
        shift = np.where(of < 0, 0, self.last[of] - self.at[of] - 1) if len(self.at) else np.zeros(len(at), np.int64)
        return of, at + shift

    def starts(self, at: np.ndarray) -> np.ndarray:
        of, own = self._own(at)
        if len(self.at):
            own = np.where((of >= 0) & (self.at[of] == at), self.first[of], own)
        return self.above.starts(own)

    def ends(self, at: np.ndarray) -> np.ndarray:
        of, own = self._own(at)
        if len(self.at):
            own = np.where((of >= 0) & (self.at[of] == at), self.last[of] - 1, own)
        return self.above.ends(own)


class Unbased:
    """Places of bytes read from base64: the lines of its run in the layer above, and the characters of the run before it.

    Of text in UTF-16, `first` bytes are before it and `sizes` are those of its characters.
    """

    def __init__(self, above, lines: list[tuple[int, int]], skipped: int, first: int = 0, sizes: np.ndarray | None = None):
        self.above, self.skipped, self.first = above, skipped, first
        self.line_starts = np.array([a for a, _ in lines], np.int64)
        self.before = np.concatenate([[0], np.cumsum([b - a for a, b in lines])])
        self.last = None if sizes is None else np.cumsum(sizes)

    def _bytes(self, at: np.ndarray, end: bool) -> np.ndarray:
        """Where the characters start, or end, in the decoded bytes."""
        if self.last is None:
            return at + end
        return self.first + (self.last[at] if end else np.where(at > 0, self.last[at - 1], 0))

    def _above(self, of_run: np.ndarray) -> np.ndarray:
        line = np.searchsorted(self.before, of_run, "right") - 1
        return self.line_starts[line] + of_run - self.before[line]

    def starts(self, at: np.ndarray) -> np.ndarray:
        return self.above.starts(self._above(self.skipped + self._bytes(at, False) * 4 // 3))

    def ends(self, at: np.ndarray) -> np.ndarray:
        return self.above.ends(self._above(self.skipped - (-self._bytes(at, True) * 4 // 3) - 1))


class Layer(NamedTuple):
    """A text and the places of its characters in the document."""

    text: str
    places: Part | OnePlace | Replaced | Unbased | Document

    def range(self, a: int, b: int) -> tuple[int, int]:
        """The range of the document that characters stand for."""
        return int(self.places.starts(np.array([a]))[0]), int(self.places.ends(np.array([b - 1]))[0])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets in a text as it stands, in order."""
    lower, out = text.lower(), []
    if any(word.decode() in lower for word in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def may_hold_secret(data: bytes) -> bool:
    """False only if the text of these UTF-8 bytes has no base span."""
    if b"AKIA" in data or b"x" * LEAST["hex"] in data.translate(HEX_BYTES):
        return True
    lower = data.lower()
    return any(word in lower for word in KEYWORDS)


def _may_hold_any(data: bytes) -> bool:
    """False only if the text of these bytes has no base span and nothing to unwrap; sharper than the other two for what is no text."""
    return may_hold_secret(data) or ESCAPE_BYTES.search(data) is not None or b"x" * LEAST_BASE64 in data.translate(BASE64_BYTES, b"\r\n")


def may_hold_layer(data: bytes) -> bool:
    """False only if nothing in the text of these UTF-8 bytes can be unwrapped."""
    return b"%" in data or b"\\" in data or b"&#" in data or b"x" * LEAST_BASE64 in data.translate(BASE64_BYTES, b"\r\n")


def _reader(data: bytes, at: int):
    """A decompressor for what starts there, None if nothing known does."""
    if data.startswith(MAGIC[0], at):
        return zlib.decompressobj(31)
    if data.startswith(MAGIC[1:5], at):
        return zlib.decompressobj()
    if data.startswith(MAGIC[5], at):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data.startswith(MAGIC[6], at) else None


def may_hold_compressed(data: bytes) -> bool:
    return any(magic in data for magic in MAGIC)


class Unpacker:
    """Finds compressed data in a stream of bytes and reads each as a `Content`, which `opened` makes of where it starts.

    Streams that follow one another, also after NULs that fill up, are one content.
    """

    def __init__(self, scan: Scan, opened: Callable[[int], Content]):
        self.scan, self.opened = scan, opened
        self.data, self.at, self.base = b"", 0, 0  # bytes at hand, the next of them, and the number of those before them
        self.reader, self.content = None, None
        self.read: bytes | None = b""  # of the stream in hand, None if too many

    def feed(self, data: bytes) -> None:
        self.base += self.at
        self.data, self.at = self.data[self.at:] + data, 0
        while self._step(False):
            pass

    def close(self) -> None:
        while self._step(True):
            pass
        self._end()

    def _end(self) -> None:
        if self.content is not None:
            self.content.close()
        self.reader = self.content = None

    def _begin(self) -> bool:
        """Start reading the next stream, if enough bytes are there to see one."""
        self.reader, self.read = _reader(self.data, self.at), b""
        return self.reader is not None

    def _step(self, last: bool) -> bool:
        """Read on; false if that needs more bytes."""
        if self.scan.stopped:
            self._end()
            self.at = len(self.data)
            return False
        if self.reader is None and self.content is not None:  # after a stream: another one, or the end
            at = FILLED.match(self.data, self.at).end()
            if len(self.data) - at < MAGIC_BYTES and not last:
                return False
            self.at, after = at, self.at
            if not self._begin():
                self._end()
                self.at = after
        if self.reader is None:
            m = COMPRESSED.search(self.data, self.at) if may_hold_compressed(self.data) else None
            if m is None:
                self.at = max(self.at, len(self.data) - MAGIC_BYTES)
                return False
            self.at = m.start()
            self._begin()
            self.content = self.opened(self.base + self.at)
        feed = self.data[self.at:self.at + FEED]
        if not feed:
            return False
        self.at += len(feed)
        self.read = self.read + feed if self.read is not None and len(self.read) < REWIND else None
        try:
            self._unpack(feed)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            if self.read is not None:
                back = self.at - len(self.read) + 1
                if back < 0:  # what came before the bytes at hand
                    self.data, self.base = self.read[1:1 - back] + self.data, self.base + back
                self.at = max(back, 0)
            self._end()
            return True
        if self.reader.eof:
            self.at -= len(self.reader.unused_data)
            self.reader = None
        return True

    def _unpack(self, feed: bytes) -> None:
        if not hasattr(self.reader, "needs_input"):
            self.content.feed(self.reader.decompress(feed))
            return
        self.content.feed(self.reader.decompress(feed, BLOCK))
        while not self.reader.eof and not self.reader.needs_input and not self.scan.stopped:
            self.content.feed(self.reader.decompress(b"", BLOCK))


class Base64Stream:
    """Compressed data in base64 that comes in windows. Only runs over the end of a window are followed; others are found in it."""

    def __init__(self, scan: Scan, place: OnePlace):
        self.scan, self.place = scan, place
        self.unpackers: list[Unpacker] = []
        self.rests, self.size = [""] * 4, 0

    def feed(self, text: str) -> None:
        pieces = [p.replace("\r", "").replace("\n", "").translate(PLAIN) for p in NOT_BASE64.split(text)] if text else [""]
        self._take(pieces[0])
        if len(pieces) > 1:
            self.close()
            self._take(pieces[-1])

    def _take(self, coded: str) -> None:
        if not coded:
            return
        if not self.unpackers:
            self.unpackers = [Unpacker(self.scan, lambda _: Content(self.scan, self.place)) for _ in range(4)]
        for skipped, unpacker in enumerate(self.unpackers):
            more = self.rests[skipped] + coded[max(0, skipped - self.size):]
            whole = len(more) // 4 * 4
            self.rests[skipped] = more[whole:]
            unpacker.feed(binascii.a2b_base64(more[:whole]))
        self.size += len(coded)

    def close(self) -> None:
        for skipped, unpacker in enumerate(self.unpackers):
            rest = self.rests[skipped]
            if len(rest) > 1:
                unpacker.feed(binascii.a2b_base64(rest + "=" * (-len(rest) % 4)))
            unpacker.close()
        self.unpackers, self.rests, self.size = [], [""] * 4, 0


class Content:
    """What compressed data unpack to, read as text and found in a block at a time; all of it has one place."""

    def __init__(self, scan: Scan, place: OnePlace):
        self.scan, self.place = scan, place
        self.parts, self.size, self.due = [], 0, BLOCK
        self.looked, self.fed = 0, 0  # characters that no cut follows, and that the stream of base64 has had
        self.run: Base64Stream | None = None

    def feed(self, data: bytes) -> None:
        if self.scan.stopped or self.scan.all_found(self.place):
            return
        text = self.scan.take(data).decode("latin-1")
        if self.parts and text.startswith(" "):
            blank = len(self.parts[-1]) - len(self.parts[-1].rstrip(" "))
            text = self.parts[-1][len(self.parts[-1]) - blank:] + text
            self.parts[-1] = self.parts[-1][:len(self.parts[-1]) - blank]
            self.size -= blank
        if "  " in text:
            text = BLANKS.sub(" " * 256, text)
        if text:
            self.parts.append(text)
            self.size += len(text)
        if self.size > self.due:
            self._cut()

    def _cut(self) -> None:
        text = "".join(self.parts)
        data = plain_bytes(text)
        marks, at = data.translate(CUT_BYTES), 0
        while len(text) - at > BLOCK and (end := next_cut(data, marks, at + max(BLOCK, self.looked) - 2)) >= 0:
            self._block(text[at:end])
            at = end
        text = text[at:]
        self.looked = len(text)
        if len(text) > max(LONG_RUN, 2 * BLOCK):
            if self.run is None:
                self.run = Base64Stream(self.scan, self.place)
            self.run.feed(text[self.fed:])
            self.scan.walk(Layer(text, self.place))
            text = text[-OVERLAP:]
            self.looked = self.fed = len(text)
        self.parts, self.size, self.due = [text], len(text), max(BLOCK, len(text) + BLOCK // 2)

    def _block(self, text: str) -> None:
        """Find in text that ends where nothing goes on."""
        if self.run is not None:
            self.run.feed(text[self.fed:])
            self.run.close()
        self.run, self.looked, self.fed = None, 0, 0
        if text:
            self.scan.walk(Layer(text, self.place))

    def close(self) -> None:
        if not self.scan.all_found(self.place):
            self._block("".join(self.parts))


def _wide(data: bytes) -> tuple[int, str] | None:
    """Where UTF-16 starts in bytes, and its text; None if there is none."""
    if b"\0" not in data:
        return None
    found = [(m.start(), coding) for coding, pattern in WIDE.items() if (m := pattern.search(data))]
    if not found:
        return None
    first, coding = min(found, key=lambda f: (f[0] % 2, f[0]))  # text mostly starts with the bytes
    at = first % 2
    return at, data[at:len(data) - (len(data) - at) % 2].decode(coding, "replace")


def _wide_sizes(text: str) -> np.ndarray:
    return 2 + 2 * (np.frombuffer(text.encode("utf-32-le"), "<u4") >= 0x10000).astype(np.int64)


class _Rewritten:
    """A layer in the making: what is copied, and what is put in the place of ranges."""

    def __init__(self, layer: Layer):
        self.layer, self.parts, self.size, self.copied = layer, [], 0, 0
        self.at, self.first, self.last = array("q"), array("q"), array("q")

    def copy(self, to: int) -> None:
        if to == self.copied:
            return
        part = self.layer.text[self.copied:to]
        self.parts.append(part)
        self.size += len(part)
        self.copied = to

    def put(self, text: str, first, last, to: int) -> None:
        """Characters for ranges that start and end as told; the layer goes on at `to`."""
        self.at.extend(range(self.size, self.size + len(text)))
        self.first.extend(first)
        self.last.extend(last)
        self.parts.append(text)
        self.size += len(text)
        self.copied = to

    def done(self) -> Layer:
        self.copy(len(self.layer.text))
        return Layer("".join(self.parts), Replaced(self.layer.places, self.at, self.first, self.last))


def _percent(layer: Layer, form: bool = False) -> _Rewritten | None:
    """Percent escapes decoded; with `form`, each + that touches them is a blank."""
    out = None
    for m in (FORM if form else PERCENT).finditer(layer.text):
        out = out or _Rewritten(layer)
        out.copy(m.start())
        if form and "+" in m[0]:
            units = FORM_BYTE.findall(m[0])
            text = "".join(" " if u == "+" else chr(int(u[1:], 16)) for u in units)
            ends = (m.start() + np.cumsum([len(u) for u in units])).tolist()
            out.put(text, [m.start(), *ends[:-1]], ends, m.end())
        else:
            text = bytes.fromhex(m[0].replace("%", "")).decode("latin-1")
            out.put(text, range(m.start(), m.end(), 3), range(m.start() + 3, m.end() + 3, 3), m.end())
    return out


def _escapes(layer: Layer) -> _Rewritten | None:
    """Character and string escapes decoded."""
    out, high = None, None
    for m in UNICODE.finditer(layer.text):
        out = out or _Rewritten(layer)
        a, b = m.span()
        out.copy(a)
        if m.lastindex == 7:
            out.put(SIMPLE.get(m[7], m[7]), (a,), (b,), b)
            continue
        code = int(m[m.lastindex], 10 if m.lastindex == 6 else 16)
        if high and high[1] == a and 0xDC00 <= code < 0xE000:
            out.parts[-1] = chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00)
            out.last[-1] = out.copied = b
            high = None
            continue
        high = (code, b) if 0xD800 <= code < 0xDC00 else None
        out.put(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", (a,), (b,), b)
    return out


def _resolved(layer: Layer) -> _Rewritten | None:
    """Percent and other escapes decoded to their end: one that a decoded character completes is decoded at once."""
    out, chars, first, last = _Rewritten(layer), [], array("q"), array("q")
    for i, char in enumerate(layer.text):
        chars.append(char)
        first.append(i)
        last.append(i + 1)
        while chars[-1] in ENDS and (e := ENDED.search("".join(chars[-LONGEST_ESCAPE:]))):
            size = len(e[0])
            del chars[-size + 1:], first[-size + 1:], last[-size:]
            last.append(i + 1)
            if e.lastindex == 8:
                chars[-1] = SIMPLE.get(e[8], e[8])
                continue
            code = int(e[e.lastindex], 10 if e.lastindex == 7 else 16)
            chars[-1] = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    out.put("".join(chars), first, last, len(layer.text))
    return out if len(chars) < len(layer.text) else None


def _runs(text: str) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """The lines of base64 runs, and where each run ends with its padding.

    Lines of one width and a shorter one after them are one run too, with what may be the end of another
    line before them. A line is left out alone where the run of all decodes every line as it is.
    """
    joined = set()
    for m in BASE64_LINES.finditer(text):
        lines = [line.span() for line in BASE64_LINE.finditer(text, m.start(), m.end())]
        widths = [b - a for a, b in lines]
        first = 0
        while first < len(lines) - 1:
            last = first + (first == 0)
            width = widths[last]
            while last + 1 < len(lines) and widths[last + 1] == width:
                last += 1
            if last + 1 < len(lines) and widths[last + 1] < width:
                last += 1
            if last == first:
                first += 1
                continue
            if sum(widths[first:last + 1]) >= LEAST_BASE64:
                yield lines[first:last + 1], m.end() if last == len(lines) - 1 else lines[last][1]
                if all(w % 4 == 0 for w in widths[first:last]):
                    joined.update(a for a, _ in lines[first:last + 1])
            first = last
    for m in BASE64.finditer(text):
        if m.start() not in joined:
            yield [(m.start(), m.start() + len(m[0].rstrip("=")))], m.end()


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """A text cut where nothing that is looked for goes on, about every `PIECE` characters, where something may be unwrapped."""
    data = plain_bytes(text)
    marks, at = data.translate(CUT_BYTES), 0
    while at < len(text):
        end = next_cut(data, marks, at + PIECE) if at + PIECE < len(text) else -1
        end = end if end >= 0 else len(text)
        if may_hold_layer(data[at:end]):
            yield at, end
        at = end


class Scan:
    """What is found in one document, and what was unwrapped of it."""

    def __init__(self, most: int | None):
        self.spans: set[tuple[int, int, int]] = set()
        self.seen: set[bytes] = set()
        self.left, self.complete, self.stopped = most, True, False
        self.depth, self.later = 0, []

    def take(self, data: bytes) -> bytes:
        """As much of unpacked data as may still be read; if that is not all, no more compressed data are."""
        if self.left is None:
            return data
        taken = data[:self.left]
        self.left -= len(taken)
        if len(taken) < len(data):
            self.complete, self.stopped = False, True
        return taken

    def all_found(self, place: OnePlace) -> bool:
        return all((place.start, kind, place.end) in self.spans for kind in range(len(KINDS)))

    def _new(self, layer: Layer) -> bool:
        mark = hashlib.blake2b(layer.text.encode("utf-8", "replace"), digest_size=16)
        if isinstance(layer.places, OnePlace):
            mark.update(b"%d:%d" % (layer.places.start, layer.places.end))
        else:
            for at in range(0, len(layer.text), BLOCK):
                of = np.arange(at, min(at + BLOCK, len(layer.text)))
                mark.update(layer.places.starts(of).tobytes())
                mark.update(layer.places.ends(of).tobytes())
        new = mark.digest() not in self.seen
        self.seen.add(mark.digest())
        return new

    def walk(self, layer: Layer, level: int = 0, found: bool = False) -> None:
        """Find in a layer (unless that was done) and in all that can be unwrapped in it."""
        data = plain_bytes(layer.text)
        if not found and may_hold_secret(data):
            told = base_spans(layer.text)
            if told:
                starts = layer.places.starts(np.array([a for a, _, _ in told]))
                ends = layer.places.ends(np.array([b - 1 for _, _, b in told]))
                self.spans.update((int(a), kind, int(b)) for a, (_, kind, _), b in zip(starts, told, ends))
        if not may_hold_layer(data):
            return
        del data
        self.depth += 1
        for a, b in pieces(layer.text):
            piece = Layer(layer.text[a:b], layer.places if isinstance(layer.places, OnePlace) else Part(layer.places, a))
            if self._new(piece):
                self._unwrap(piece, level)
        self.depth -= 1

    def _unwrap(self, piece: Layer, level: int) -> None:
        self._base64(piece)
        if not ANY_ESCAPE.search(piece.text):
            return
        if level >= LEVELS:
            ways = [(_resolved, LEVELS)]
        else:
            ways = [(_percent, level + 1), (_escapes, level + 1)]
            if FORM_SEEN.search(piece.text):
                ways.append((lambda layer: _percent(layer, form=True), level + 1))
        for way, next_level in ways:
            rewritten = way(piece)
            if rewritten is not None:
                made = rewritten.done()
                self._unpack_among(made)
                self.walk(made, next_level)

    def _unpack(self, data: bytes, opened: Callable[[int], Content]) -> None:
        """Read the compressed data in bytes, now or later."""
        if self.depth >= DEEP:
            self.later.append((data, opened))
            return
        unpacker = Unpacker(self, opened)
        unpacker.feed(data)
        unpacker.close()

    def finish(self) -> None:
        """Read what was too deep to be read at once."""
        while self.later:
            self._unpack(*self.later.pop())

    def _unpack_among(self, layer: Layer) -> None:
        """Unpack what starts with a replaced character, or just before one, up to the end of a line that stands for itself."""
        data = plain_bytes(layer.text)
        if not may_hold_compressed(data):
            return
        replaced, at = layer.places.at, 0
        while m := COMPRESSED.search(data, at):
            at = m.start()
            near = np.searchsorted(replaced, (at, at + NEAR))
            if near[0] == near[1]:
                at += 1
                continue
            end = len(data)
            for line in LINE_END.finditer(data, at):
                of = np.searchsorted(replaced, line.start())
                if of == len(replaced) or replaced[of] != line.start():
                    end = line.start()
                    break
            last = int(replaced[np.searchsorted(replaced, end) - 1])
            _, stop = layer.range(last, last + 1)

            def opened(offset: int, at=at, stop=stop) -> Content:
                start, _ = layer.range(at + offset, at + offset + 1)
                return Content(self, OnePlace(min(start, stop), stop))

            self._unpack(data[at:end], opened)
            at = end

    def _base64(self, layer: Layer) -> None:
        """Unpack and enter what base64 runs hold, read from each of the first four characters, so that what is before a blob does not hide it."""
        for lines, end in _runs(layer.text):
            coded = "".join(layer.text[a:b] for a, b in lines).translate(PLAIN)
            for skipped in range(4):
                size = len(coded) - skipped - ((len(coded) - skipped) % 4 == 1)
                data = binascii.a2b_base64(coded[skipped:skipped + size] + "=" * (-size % 4))
                if may_hold_compressed(data) and COMPRESSED.search(data):
                    _, stop = layer.range(end - 1, end)

                    def opened(at: int, whole=Unbased(layer.places, lines, skipped), stop=stop) -> Content:
                        return Content(self, OnePlace(int(whole.starts(np.array([at]))[0]), stop))

                    self._unpack(data, opened)
                if _may_hold_any(data):
                    self.walk(Layer(data.decode("latin-1"), Unbased(layer.places, lines, skipped)))
                if wide := _wide(data):
                    at, text = wide
                    self.walk(Layer(text, Unbased(layer.places, lines, skipped, at, _wide_sizes(text))))


def scan(text: str, most: int | None = MOST_UNPACKED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """(base spans, all spans, whether every layer was unwrapped); a span is (start, kind number, end)."""
    base = base_spans(text)
    found = Scan(most)
    found.spans.update(base)
    found.walk(Layer(text, Document()), found=True)
    found.finish()
    return base, sorted(found.spans), found.complete


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _scanned(most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in byte_texts(batch.column("text")):
                if may_hold_layer(data):
                    base, spans, complete = scan(data.decode(), most)
                elif may_hold_secret(data):
                    base, complete = base_spans(data.decode()), True
                    spans = base
                else:
                    base, spans, complete = [], [], True
                told = _told(base)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((*counts, hashlib.sha256(told.encode()).hexdigest(), _told(spans), complete))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "complete"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_unpacked: int | None = MOST_UNPACKED) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, complete.

    The counts and the digest tell the secrets of the text as it stands, `spans` those of all its
    layers too, as kind:start:end in code points of the document, end exclusive, comma-joined in
    order of start, kind and end. A secret found in unpacked data spans all the data; one in base64,
    the characters that encode it. `complete` is false where a document's compressed data would
    unpack to more than `most_unpacked` bytes; without that limit it is true.

    Null text is empty. Every row is scanned, repeated ones too, and ids may be null. An empty table
    gives no rows. Extra columns are ignored. A task holds a document, the layers of a piece of it,
    and a few megabytes of unpacked data for each level of compression.
    """
    chosen = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.transform(
        in_arrow,
        _scanned(most_unpacked),
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, complete boolean")
