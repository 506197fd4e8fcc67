import hashlib
import random
import re
import time

import numpy as np
import pytest

from rotorline.llm import decontaminate as dc
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    """(n_words, hit word indexes, items) of one document."""
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j:j + n] == w[i:i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(doc), hit, found


def report(pairs, items):
    out = []
    for i, t in pairs:
        n, hit, found = brute(t, items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, n, len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    vocabulary = ["a", "b", "Été", "ÉTÉ", "x9"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n)) + rng.choice([".", "!", " -- "])
    items = [(i, text(rng.choice([3, 7, 10, 14]))) for i in range(12)] + [(12, None), (13, " . "), (3, text(11)), (100, "unique9 short")]
    pairs = [(i, text(rng.randrange(60))) for i in range(80)]
    pairs += [(200, items[0][1].upper()), (201, "unique9,SHORT"), (202, None), (203, ""), (None, items[2][1]), (5, pairs[5][1]), (204, "zz " * 30_000)]
    return pairs, items


@pytest.fixture
def benchmark(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 60])
def test_hits_equal_brute_force(docs, benchmark, block):
    pairs, items = corpus()
    got = dc.hit_report(dc.find_hits(docs(*pairs), benchmark(items), block_bytes=block))
    assert rows(got) == report(pairs, items)


def test_long_items_are_cut_without_loss(docs, benchmark, monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", 4)
    rng = random.Random(9)
    item = " ".join(rng.choices("abcdefgh", k=60))
    pairs = [(i, "q " + " ".join(item.split()[i:i + 11]) + " q") for i in range(50)]
    got = dc.hit_report(dc.find_hits(docs(*pairs), benchmark([(1, item)])))
    assert rows(got) == report(pairs, [(1, item)])


def test_owners_of_a_shared_window_are_walked_once():
    passage = " ".join(f"w{i}" for i in range(10)).encode()
    windows = dc.Windows([(str(i), passage) for i in range(20_000)] + [("own", passage + b" w0")], 10)
    assert [len(starts) for _, _, starts, _, _ in windows.tables] == [2]
    started = time.process_time()
    starts, ends, items = windows.hits(passage.split() * 2_000)
    assert time.process_time() - started < 5
    assert (starts, ends) == ([0], [20_000]) and len(items) == 20_001


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc.Windows, "_hashed", staticmethod(lambda words, starts, size: np.zeros(len(starts), np.uint64)))
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=12)) for _ in range(6)]
    items = [(i, texts[i % 5]) for i in range(15)]
    windows = dc.Windows([(str(i), t.encode()) for i, t in items], 10)
    for text in [*texts, texts[0] + " " + texts[3]]:
        starts, ends, found = windows.hits(text.encode().split())
        n, hit, owners = brute(text, items)
        assert {w for a, b in zip(starts, ends) for w in range(a, b)} == hit and set(found) == set(map(str, owners))


def test_remove_documents(docs, benchmark):
    pairs, items = corpus()
    df = docs(*pairs)
    out = dc.decontaminate(df, benchmark(items))
    assert out.columns == df.columns
    assert rows(out, "doc_id", "text") == sorted(((i, t) for i, t in pairs if not brute(t, items)[1]), key=repr)


def test_remove_spans(docs, benchmark):
    df = docs((1, "Keep, this! one two THREE four; and that."), (2, "one two three four"), (3, "clean"), (4, None))
    out = dc.decontaminate(df, benchmark([(1, "one two three four")]), remove="spans")
    assert rows(out, "doc_id", "text") == [(1, "Keep, this! and that."), (2, ""), (3, "clean"), (4, None)]
    with pytest.raises(ValueError):
        dc.decontaminate(df, df, remove="words")


def test_empty_tables(docs, benchmark):
    df = docs((1, "a b"))
    none = benchmark([(1, "a")]).limit(0)
    assert rows(dc.hit_report(dc.find_hits(df, none)), "doc_id", "n_hit", "contaminated") == [(1, 0, False)]
    assert dc.hit_report(dc.find_hits(df.limit(0), none)).count() == 0
    assert dc.decontaminate(df, none).count() == 1
