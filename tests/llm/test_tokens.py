import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rotorline.llm import tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.BYTE_BPE)


@pytest.fixture(scope="module")
def fresh():
    """The library's own tokenizer, as the file makes it."""
    return Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))


ALPHABET = "aZé'’sdt0½ \n\t\r\x0b\x1c\x1f\x85\xa0 ​　.,-_#łŁжﬀªº漢😀é<|endoftext|>"


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=30) | st.text(max_size=30) | st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "b.", "\n", "<|", "'s", "é"])).map("".join))
@example("it's  we'll\n\n  x ''s don't  ")
@example("<|endoftext|> a <|endoftext|>")
@example("wordł worldé.next́ a b")
@example(" a b")
@example("a b ")
@example("a b  c \n d")
def test_pieces_give_the_ids_of_the_whole(enc, fresh, text):
    want = fresh.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want


def test_markers_are_ids(enc, fresh):
    text = "x <|endoftext|> y<|endoftext|><|endoftext|>"
    ids = np.frombuffer(enc.encode(text), "<u4").tolist()
    assert ids.count(50256) == 3 and ids == fresh.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded(enc, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    for i in range(200):
        enc.encode(f"some{i} words{i}")
    assert len(enc.pieces) + len(enc.pieces.old) < 40


def test_other_tokenizers_are_not_cut():
    other = tokens.Encoder("word_bpe_49k.json")
    assert not other.cuttable
    text = "Hello  wide world"
    assert np.frombuffer(other.encode(text), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
