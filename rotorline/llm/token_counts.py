"""Token counts of documents under a unigram model, by dynamic programming shared in a trie.

The distinct pre-tokens of a task's documents are put into a trie of bytes. A node holds the best
score of the prefix it stands for, over all ways to cut it into tokens of the vocabulary, and how
many tokens that takes; both follow from the nodes above it. So a prefix is computed once, whatever
number of pre-tokens share it, and a pre-token adds only its own last bytes. The counts at the ends
of pre-tokens are kept, and a document adds them up.

The vocabulary and the way to split pre-tokens are those of a public byte-level tokenizer. Nothing is
trained: a token's probability is Zipf's, by its rank in the vocabulary.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import in_arrow, named
from rotorline.llm.tokens import ODD_SPACE, PIECES, WORD, tokenizer_file

RANKS = "byte_bpe_50k.tiktoken"
OFFSET = 2.7
MOST_NODES = 400_000
MOST_CHARS = 2_500_000
LONG = 256


def unigram(name: str = RANKS) -> dict[bytes, float]:
    """Log probability of every token: 1 / (rank + 2.7), normalised (the law of Zipf and Mandelbrot)."""
    with open(tokenizer_file(name), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    weights = 1.0 / (np.array(list(ranks.values()), float) + OFFSET)
    return dict(zip(ranks, np.log(weights / weights.sum()).tolist()))


def by_suffix(logs: dict[bytes, float]) -> dict[bytes, float | None]:
    """Log probabilities of tokens, and None for what is only the end of a token."""
    out: dict[bytes, float | None] = {}
    for token in logs:
        for start in range(1, len(token)):
            out.setdefault(token[start:], None)
    out.update(logs)
    return out


class Trie:
    """Best scores and token counts of prefixes."""

    def __init__(self, logs: dict[bytes, float]):
        self.suffixes = by_suffix(logs)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.scores, self.counts = array("d", [0.0]), array("l", [0])

    def _best(self, word: bytes, end: int, scores, counts) -> tuple[float, int]:
        """The best (score, tokens) of word[:end] given those of its prefixes; of equal scores the longer last token.

        The last token grows to the left until no token ends so.
        """
        suffixes, best, tokens = self.suffixes, float("-inf"), 0
        for start in range(end - 1, -1, -1):
            log = suffixes.get(word[start:end], 1.0)
            if log is None:
                continue
            if log > 0:
                break
            score = scores[start] + log
            if score >= best:
                best, tokens = score, counts[start] + 1
        return best, tokens

    def insert(self, word: bytes) -> tuple[float, int]:
        """(score, tokens) of a pre-token, computing what its prefixes in the trie lack."""
        children, scores, counts, node = self.children, self.scores, self.counts, 0
        path_scores, path_counts = [0.0], [0]
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = children.get(key)
            if node is None:
                score, tokens = self._best(word, end, path_scores, path_counts)
                node = children[key] = len(scores)
                scores.append(score)
                counts.append(tokens)
                path_scores.append(score)
                path_counts.append(tokens)
            else:
                path_scores.append(scores[node])
                path_counts.append(counts[node])
        return path_scores[-1], path_counts[-1]

    def alone(self, word: bytes) -> tuple[float, int]:
        """The same for a pre-token too long to share much, without nodes."""
        scores, counts = array("d", [0.0]), array("l", [0])
        for end in range(1, len(word) + 1):
            score, tokens = self._best(word, end, scores, counts)
            scores.append(score)
            counts.append(tokens)
        return scores[-1], counts[-1]


class _Ends(dict):
    """What is kept of pieces of text; asks `learn` for a new one."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> int:
        return self.learn(piece)


class Counter:
    """Counts of whole texts. What is kept of pre-tokens is bounded; forgetting changes no count.

    Texts are cut first where every pre-token ends (see `tokens`), and most pieces are one pre-token.
    """

    def __init__(self, name: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        self.trie = Trie(unigram(name))
        self.split = regex.compile(pattern).findall
        self.counts = _Ends(self._learn)  # pre-tokens << 32 | tokens
        self.scores: dict[str, float] = {}
        self.old: tuple[dict, dict] = ({}, {})
        self.chars = 0

    def _learn(self, piece: str) -> int:
        counts = self.old[0].get(piece)
        if counts is not None:
            score = self.old[1][piece]
        else:
            counts, score = 0, 0.0
            for word in [piece] if WORD.match(piece) else self.split(piece):
                data = word.encode()
                best, tokens = self.trie.insert(data) if len(data) <= LONG else self.trie.alone(data)
                counts += 1 << 32 | tokens
                score += best
        self.counts[piece], self.scores[piece] = counts, score
        self.chars += len(piece)
        return counts

    def count(self, text: str) -> tuple[int, int, float]:
        """(pre-tokens, tokens, log probability) of a text."""
        if len(self.trie.scores) > MOST_NODES:
            self.trie.clear()
        if self.chars > MOST_CHARS:
            self.old, self.scores, self.chars = (dict(self.counts), self.scores), {}, 0
            self.counts.clear()
        pieces = self.split(text) if ODD_SPACE.search(text) else PIECES.findall(text)
        counts = sum(map(self.counts.__getitem__, pieces))
        return counts >> 32, counts & 0xFFFFFFFF, sum(map(self.scores.__getitem__, pieces))


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    """One counter per worker process."""
    return Counter(name)


def _counted(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name).count
        for batch in batches:
            found = [count(text.as_py()) for text in batch.column("text")]
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64())))],
                ["doc_id", "n_pretokens", "n_tokens", "log_probability"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = RANKS) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, log_probability of the best tokens of its whole text.

    Null and empty texts have none, with log probability 0. Rows may repeat, ids may be null. Extra
    columns are ignored, an empty table gives no rows. No shuffle: a task counts the documents it reads.
    """
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.transform(in_arrow, _counted(vocabulary), f"doc_id {kind}, n_pretokens long, n_tokens long, log_probability double")
