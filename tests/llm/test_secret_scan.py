import base64
import binascii
import bz2
import gzip
import hashlib
import json
import lzma
import random
import re
import time
import tracemalloc
import zlib
from urllib.parse import quote, quote_plus

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rotorline.llm import secret_scan as ss

BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
}
KEY = "AKIA" + "Q7" * 8
HEX = "0a1b2c3d" * 4


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def spans(text):
    return ss.scan(text)[1]


PARTS = ["password", "API_KEY", "apikey", "token", "ſecret", "Kelvin", "=", ": ", "'", '"', "abc", "abcdef", KEY, "AKIA", HEX, "0af", " ", "\n", "é", "%41", "\\u0041"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_base_spans_equal_the_patterns(text):
    base, found, complete = ss.scan(text)
    assert base == brute(text) and set(base) <= set(found) and complete
    assert ss.may_hold_secret(text.encode()) or not base
    if not ss.may_hold_layer(text.encode()):
        assert base == found


def test_layers_map_to_the_document():
    inner = f'token = "{"s3cretvalue"}"'
    head = "é before "
    for wrap in (lambda s: quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
                 lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: base64.b64encode(s.encode()).decode()):
        coded = wrap(inner)
        (a, kind, b), = [s for s in spans(f"{head}{coded} after") if s[1] == 0]
        assert kind == 0 and a == len(head) and len(head) + len(coded) - 8 <= b <= len(head) + len(coded)


def test_secret_inside_decoded_text_is_placed_exactly():
    text = "x " + base64.b64encode(b"abc" * 4 + KEY.encode() + b" zz").decode()
    assert spans(text) == [(2 + 16, 1, 2 + 16 - (-20 * 4 // 3))]
    assert spans("a %41KIA" + KEY[4:] + " b") == [(2, 1, 2 + 22)]


def test_nested_and_compressed():
    secret = f"password: {HEX}"
    for squeeze in (gzip.compress, zlib.compress, bz2.compress):
        blob = base64.b64encode(squeeze(secret.encode())).decode()
        for text in (blob, quote(blob, safe=""), base64.b64encode(blob.encode()).decode(),
                     base64.urlsafe_b64encode(quote(blob, safe="").encode()).decode()):
            found = spans(f"see {text}")
            assert {kind for _, kind, _ in found} == {0, 2}, text
            assert all(a >= 4 and b <= 4 + len(text) for a, _, b in found)


def test_escaped_compressed_bytes():
    text = "".join(f"%{b:02x}" for b in gzip.compress(HEX.encode()))
    assert (0, 2, len(text)) in spans(text)


def test_wrapped_base64():
    lines = base64.encodebytes((f"some words first, then {KEY} " * 8).encode()).decode()
    assert sum(kind == 1 for _, kind, _ in spans(lines)) == 8


def test_self_feeding_layers_end():
    deep = "token=abcdefg"
    for _ in range(12):
        deep = quote(deep, safe="").replace("%", "%25") if len(deep) < 20_000 else deep
    assert ss.scan(deep)[2]
    assert ss.scan("%25" * 5_000 + "41")[2]


def test_bombs_are_told():
    bomb = base64.b64encode(gzip.compress(bytes(b"a b " * 100_000))).decode()
    assert ss.scan(bomb)[2]
    assert not ss.scan(bomb, most=1_000)[2]


def test_query_equals_scan(docs):
    rng = random.Random(12)
    pairs = [(i, "".join(rng.choices(PARTS + ["long words go here "], k=30))) for i in range(60)]
    pairs += [(100, None), (101, ""), (None, KEY), (102, HEX), (102, HEX), (103, "é" * 200_000 + KEY), (104, base64.b64encode(KEY.encode() * 3).decode())]
    want = []
    for i, t in pairs:
        base = brute(t or "")
        told = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(told.encode()).hexdigest()))
    got = ss.find_secrets(docs(*pairs))
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=key) == sorted(want, key=key)
    assert got.limit(0).count() == 0 and ss.find_secrets(docs((1, "a")).limit(0)).count() == 0


def test_large_content_hides_nothing():
    filler = b"some words, " * 400_000
    big = base64.b64encode(gzip.compress(filler * 15 + f" {KEY} ".encode() + filler)).decode()
    text = f"{big} {quote(f'password={HEX}', safe='')}"
    _, found, complete = ss.scan(text)
    assert complete and (0, 1, len(big)) in found
    assert {kind for a, kind, _ in found if a > len(big)} == {0, 2}


def test_limit_ends_only_what_exceeds_it():
    bomb = base64.b64encode(gzip.compress(b"a b " * 100_000)).decode()
    for text in (f"{bomb} token%3Dabcdefgh", f"token%3Dabcdefgh {bomb}"):
        _, found, complete = ss.scan(text, most=1_000)
        assert not complete and [kind for _, kind, _ in found] == [0]


def test_blocks_are_cut_where_nothing_goes_on(monkeypatch):
    rng = random.Random(3)
    for n in range(40):
        pieces = rng.choices(PARTS + ["%3a", "%20", "password ", "long words, go here ", base64.b64encode(KEY.encode() * 2).decode()], k=200)
        content = "".join(pieces)
        blob = base64.b64encode(gzip.compress(content.encode())).decode()
        monkeypatch.setattr(ss, "BLOCK", 1 << 20)
        whole = ss.scan(blob)
        monkeypatch.setattr(ss, "BLOCK", 64)
        assert ss.scan(blob) == whole and whole[2]


def test_base64_of_any_bytes_is_entered():
    secret = f"token: abcdefgh {KEY}"
    for odd in ("\xa0", "﻿", "​", "　", "\xad", "\x0c", "\0", "�"):
        for content in (f"un mot{odd}: {secret}", f"{secret} {odd} after", quote(secret, safe="") + odd):
            blob = base64.b64encode(content.encode()).decode()
            assert [kind for _, kind, _ in spans(f"see {blob}")] == [0, 1], repr(content)
    blob = base64.b64encode(b"\xff\xfe\x80 " + secret.encode() + b"\xc3").decode()
    assert [kind for _, kind, _ in spans(blob)] == [0, 1]
    assert {kind for _, kind, _ in spans("%ef%bf%bd%ff%41KIA" + KEY[4:])} == {1}


def test_base64_of_utf16_is_entered():
    for coding in ("utf-16-le", "utf-16-be", "utf-16"):
        for head in ("", "é ", "漢字 ", "😀 "):
            content = f"{head}$token = 'abcdefgh'; {KEY}"
            blob = base64.b64encode(content.encode(coding)).decode()
            found = spans(f"powershell -enc {blob}")
            assert [kind for _, kind, _ in found] == [0, 1], (coding, head)
            (a, _, b), = [s for s in found if s[1] == 1]
            assert 16 <= a and len(blob) + 16 - 4 <= b <= len(blob) + 16 and b - a in range(53, 56)


def test_base64_after_something_else():
    secret = f"password={HEX} {KEY}"
    blob = base64.b64encode(secret.encode()).decode().rstrip("=")
    for squeezed in (blob, *(base64.b64encode(squeeze(secret.encode())).decode() for squeeze in (gzip.compress, zlib.compress, bz2.compress))):
        for head in ("", "a", "id", "id-", "https://host/cb/", "x/y_", "path/to/it/"):
            found = spans(f"see {head}{squeezed} after")
            assert {kind for _, kind, _ in found} == {0, 1, 2}, (head, squeezed)
            assert all(a >= 4 + len(head) - (head != "") for a, _, _ in found)


def test_base64_lines_of_any_width():
    rng = random.Random(5)
    text = "".join(rng.choices("some words ", k=200)) + KEY + " " + "".join(rng.choices("other words ", k=300)) + f"token={HEX}"
    packed = gzip.compress(rng.randbytes(400).hex("-", 1).encode() + text.encode())
    for width in (4, 10, 57, 60, 61, 64, 70, 72, 76, 100):
        for line in ("\n", "\r\n"):
            for head in ("", "key: ", "key=id/", "-----BEGIN X-----\n"):
                for content in (text.encode(), packed):
                    coded = base64.b64encode(content).decode()
                    wrapped = line.join(coded[i:i + width] for i in range(0, len(coded), width))
                    document = head.replace("\n", line) + wrapped + f"{line}-----END X-----"
                    assert {kind for _, kind, _ in spans(document)} == {0, 1, 2}, (width, line, head)


def test_lines_of_words_are_no_burden():
    assert ss.scan("a" * 300_000 + "\n" + "word\n" * 50_000)[2]


def test_all_streams_of_compressed_data_are_read():
    pad = b"nothing to see, " * 50
    for squeeze in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        for fill in (b"", b"\0" * 8):
            # the key lies over the end of a stream
            members = [squeeze(pad), squeeze(pad + KEY[:9].encode()), squeeze(KEY[9:].encode() + b" "), squeeze(b""), squeeze(f"token={HEX} ".encode())]
            data = fill.join(members)
            coded = base64.b64encode(data).decode()
            want = {(0, k, len(coded)) for k in range(3)}
            assert set(spans(coded)) == want, squeeze
            assert {kind for _, kind, _ in spans("".join(f"%{b:02x}" for b in data))} == {0, 1, 2}


def test_many_small_streams():
    data = gzip.compress(b"words ") * 20_000 + gzip.compress(KEY.encode())
    assert {kind for _, kind, _ in spans(base64.b64encode(data).decode())} == {1}


def naive(text):
    """All spans by unwrapping whole layers, every character with its own range, until none is new."""
    spans, seen, waiting = set(), set(), [tuple((c, i, i + 1) for i, c in enumerate(text))]

    def replaced(layer, pattern, decode):
        flat, out, at = "".join(c for c, _, _ in layer), [], 0
        for m in re.finditer(pattern, flat):
            out += layer[at:m.start()]
            out += [(c, layer[m.start() + a][1], layer[m.start() + b - 1][2]) for c, a, b in decode(m[0])]
            at = m.end()
        return tuple(out) + layer[at:] if at else None

    def percent(run):
        out, at = [], 0
        while at < len(run):
            size = 1 if run[at] == "+" else 3
            out.append((" " if size == 1 else chr(int(run[at + 1:at + 3], 16)), at, at + size))
            at += size
        return out

    def escape(run):
        simple = {"n": "\n", "r": "\r", "t": "\t"}
        if m := re.fullmatch(r"&#(x?)([0-9A-Fa-f]+);", run, re.IGNORECASE):
            code = int(m[2], 16 if m[1] else 10)
        elif m := re.fullmatch(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?", run):
            code = int(m[1], 16)
        else:
            return [(simple.get(run[1], run[1]), 0, 2)]
        return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", 0, len(run))]

    escapes = r"""\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|\\[nrt"'/\\]"""
    while waiting:
        layer = waiting.pop()
        if layer in seen:
            continue
        seen.add(layer)
        flat = "".join(c for c, _, _ in layer)
        spans |= {(min(r[1] for r in layer[a:b]), k, max(r[2] for r in layer[a:b])) for a, k, b in brute(flat)}
        made = [replaced(layer, r"(?:%[0-9A-Fa-f]{2})+", percent), replaced(layer, r"\+*(?:(?:%[0-9A-Fa-f]{2})+\+*)+", percent), replaced(layer, escapes, escape)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", flat):
            for skipped in range(4):
                run = layer[m.start() + skipped:m.end()]
                run = run[:len(run) - (len(run) % 4 == 1)]
                coded = "".join(c for c, _, _ in run).replace("-", "+").replace("_", "/")
                data = binascii.a2b_base64(coded + "=" * (-len(coded) % 4))
                made.append(tuple((chr(b), run[i * 4 // 3][1], run[-(-(i + 1) * 4 // 3) - 1][2]) for i, b in enumerate(data)))
        waiting += [new for new in made if new]
    return sorted(spans)


WRAPS = [
    lambda s: quote(s, safe=""), quote_plus, lambda s: "".join(f"%{b:02X}" for b in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: base64.b64encode(s.encode()).decode(), lambda s: json.dumps(s), lambda s: f"id-{s}, "]
INNER = ["password", "token", "=", " = ", ": ", "'", "abcdef", "a b", KEY, HEX, "0a", "é", "+", "%", "\\", ";", "x y"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(INNER), min_size=1, max_size=4).map("".join), st.lists(st.sampled_from(WRAPS), max_size=3)), min_size=1, max_size=3))
def test_spans_equal_those_of_a_naive_unwrapper(parts):
    text = ""
    for inner, wraps in parts:
        for wrap in wraps:
            inner = wrap(inner) if len(inner) < 300 else inner
        text += inner + " "
    assert spans(text) == naive(text)


def test_layers_that_look_otherwise():
    """Form encoding, lines ended by escapes, compressed bytes anywhere in escapes, as a program would print them."""
    assert spans("password+%3D+hunter2222") == [(0, 0, 23)]
    coded = base64.b64encode(f"some words and more of them, then {KEY} and others".encode()).decode()
    for end in ("\\n", "\\r\\n"):
        assert {kind for _, kind, _ in spans('{"k": "' + end.join(coded[i:i + 20] for i in range(0, len(coded), 20)) + '"}')} == {1}
    for squeeze in (gzip.compress, bz2.compress, zlib.compress):
        data = squeeze(f"x password={HEX} {KEY}".encode())
        hexed = "".join(f"\\x{b:02x}" for b in data)
        for wrapped in ("%41%42" + "".join(f"%{b:02x}" for b in data), hexed, "\\x41\\x42" + hexed, repr(data), quote(data), f"a%20{quote(data)}"):
            found = spans(f"see {wrapped}\nafter")
            assert {kind for _, kind, _ in found} == {0, 1, 2}, (squeeze, wrapped)
            assert all(4 <= a and b <= 4 + len(wrapped) for a, _, b in found)
    assert spans('\\"password\\": \\"hunter22\\"')[0][1] == 0


@pytest.mark.parametrize("text, kinds", [
    ("%" + "25" * 32_000 + "41", {2}), ("%5cu0025" + "5cu0025" * 9_000 + "41", set()), ("&#x25;" + "25" * 32_000 + "41", {2}),
    ("+" * 64_000 + "%41", set()), ("\\" * 64_000 + "n", set()), ("%" + "25" * 32_000 + "41KIA" + KEY[4:], {1, 2}), ("%41" * 21_000, set())])
def test_chains_of_escapes_take_linear_time(text, kinds):
    started = time.process_time()
    assert {kind for _, kind, _ in spans(text)} >= kinds
    assert time.process_time() - started < 3
    tracemalloc.start()
    spans(text[:8_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_layers_in_between_are_found_whatever_the_length():
    """Runs of 24 hex digits and more that each pass shortens, the last one below that."""
    wrapped = "%25252561" + HEX[:22]
    told = [(1, 2, 31), (3, 2, 31), (5, 2, 31), (7, 2, 31)]
    for before in (0, 1 << 10, 1 << 19, 1 << 20):
        assert spans("." * before + wrapped) == [(before + a, kind, before + b) for a, kind, b in told], before


def test_long_runs_of_unpacked_data_are_windows():
    """A letter 24 million times is not held; what lies over the end of a window is found."""
    pad = b"a" * 12_000_000
    blob = base64.b64encode(gzip.compress(pad + KEY.encode() + pad)).decode()
    tracemalloc.start()
    found = spans(blob)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 1, len(blob)), (0, 2, len(blob))] and peak < 100 << 20
    for at in range(ss.LONG_RUN - 30, ss.LONG_RUN + 4, 3):
        content = b"z" * at + KEY.encode() + b"z" * 100
        assert {kind for _, kind, _ in spans(base64.b64encode(gzip.compress(content)).decode())} == {1}
    blanks = base64.b64encode(gzip.compress(b"password" + b" " * 3_000_000 + b"= abcdef1")).decode()
    assert spans(blanks) == [(0, 0, len(blanks))]


def test_compressed_data_go_on_through_windows_of_base64():
    noise = random.Random(1).randbytes(3_000_000)
    inner = gzip.compress(noise + f" {KEY} ".encode())
    for coded in (base64.b64encode(inner), base64.encodebytes(inner), b"id/" + base64.urlsafe_b64encode(inner)):
        blob = base64.b64encode(gzip.compress(coded)).decode()
        assert (0, 1, len(blob)) in spans(blob)


def test_any_depth():
    deep = f"{KEY} "
    for _ in range(150):
        deep = base64.b64encode(gzip.compress(deep.encode())).decode()
    assert spans(f"see {deep}") == [(4, 1, 4 + len(deep))]
