import math
import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from rotorline.llm import token_counts as tc
from tests.llm.test_tokens import ALPHABET

COUNTER = tc.Counter()


@pytest.fixture(scope="module")
def logs():
    return tc.unigram()


def brute(word, logs):
    """Best (score, tokens) of a word without a trie."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[start][0] + logs[word[start:end]], -start, best[start][1] + 1) for start in range(end) if word[start:end] in logs]
        score, _, tokens = max(options)
        best.append((score, tokens))
    return best[-1]


def test_probabilities_sum_to_one(logs):
    assert math.isclose(sum(map(math.exp, logs.values())), 1.0)
    assert all(bytes([b]) in logs for b in range(256))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("theioné 12", min_size=1, max_size=14), min_size=1, max_size=20))
def test_trie_equals_plain_programming(logs, words):
    trie = tc.Trie(logs)
    for word in (w.encode() for w in words):
        assert trie.insert(word) == trie.alone(word) == brute(word, logs)


def test_prefixes_are_shared(logs):
    trie = tc.Trie(logs)
    trie.insert(b" international")
    before = len(trie.scores)
    trie.insert(b" internationally")
    assert len(trie.scores) == before + 2
    trie.insert(b" inter")
    assert len(trie.scores) == before + 2


def expected(text, logs):
    words = regex.findall(public_tokenizers.PATTERN, text or "")
    found = [brute(w.encode(), logs) for w in words]
    return len(words), sum(n for _, n in found), sum(s for s, _ in found)


def test_documents(docs, logs):
    rng = random.Random(3)
    pairs = [(i, " ".join(rng.choices(["the", "nation's", "été", "x1", "\n\n", "--", "漢"], k=rng.randrange(80)))) for i in range(50)]
    pairs += [(90, None), (91, ""), (None, "no id"), (92, "same"), (92, "same"), (93, "z" * 3_000), (94, "many words " * 30_000)]
    got = sorted(map(tuple, tc.count_tokens(docs(*pairs)).collect()), key=repr)
    want = sorted(((i, *expected(t, logs)) for i, t in pairs), key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)
    assert tc.count_tokens(docs((1, "a")).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=40))
def test_cut_texts_count_as_whole_ones(logs, text):
    got, want = COUNTER.count(text), expected(text, logs)
    assert got[:2] == want[:2] and got[2] == pytest.approx(want[2], rel=1e-12)


def test_emptying_changes_nothing(logs, monkeypatch):
    texts = [f"word{i} words{i % 7} and more" for i in range(60)]
    want = [tc.Counter().count(t) for t in texts[:3]] + []
    monkeypatch.setattr(tc, "MOST_NODES", 5)
    monkeypatch.setattr(tc, "MOST_CHARS", 30)
    small = tc.Counter()
    assert [small.count(t) for t in texts][:3] == want
    assert len(small.trie.scores) < 60 and len(small.counts) + len(small.old[0]) < 30
