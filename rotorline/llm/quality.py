"""Quality of documents by a factorisation machine.

A document is a sparse vector: its words, hashed to `BUCKETS` places and weighted by the log of their
count; statistics of its structure; and numbers that come with it (metadata), each as a standard score
and as the one of `BINS` ranges it falls in. A weight for every place and, for every pair of places, the
product of two vectors of rank `RANK` make the score. The sum over all pairs takes linear time, as half of
the square of the sum less the sum of the squares, rank by rank.

The machine is fitted on the driver by gradient descent on the log loss, on a sample of labelled rows
drawn by a hash of their id; the features of the sample are made in tasks, and every document is scored in
tasks, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import byte_texts, in_arrow, named, sent_if_small
from rotorline.llm.language import held_out

BUCKETS, BINS, RANK = 1 << 14, 8, 8
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.1, 1e-5
CLIP = 4.0
#: Bytes of a text that are read at a time, and words whose place a worker remembers.
SLICE, REMEMBERED = 1 << 20, 200_000
DRAWS = 1 << 31
ID_BYTES = 64

_CLASS = bytes(
    ord("U") if chr(b).isupper() else ord("l") if chr(b).islower() else ord("d") if chr(b).isdigit() else ord("s") if chr(b).isspace()
    else ord("p") if b < 0x80 else ord("w") for b in range(0x80)) + b"w" * 0x80
STATISTICS = (
    "words", "word_length", "upper", "digits", "signs", "distinct", "foremost", "same_as_last", "repeated_pairs", "lines",
    "repeated_lines", "words_a_line", "closed_lines", "signs_alone", "beyond_ascii")


class Features(NamedTuple):
    """Places of words and their weights, and the statistics."""

    places: np.ndarray
    weights: np.ndarray
    statistics: np.ndarray


_PLACES: dict[bytes, int] = {}


def _place(word: bytes) -> int:
    at = _PLACES.get(word)
    if at is None:
        if len(_PLACES) >= REMEMBERED:
            _PLACES.clear()
        at = _PLACES[word] = zlib.crc32(word) % BUCKETS
    return at


def _slices(data: bytes) -> Iterator[bytes]:
    """A text in parts of `SLICE` bytes and what remains of the last word."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            blanks = [b for b in (data.find(b" ", end), data.find(b"\n", end)) if b >= 0]
            end = min(blanks, default=len(data))
        yield data[at:end]
        at = end


def features(data: bytes) -> Features:
    """Of a whole text in UTF-8. What is repeated is told within parts of a megabyte."""
    size = n_words = distinct = same = pairs = repeated = lines = lines_again = closed = alone = foremost = 0
    classes = Counter()
    counts: dict[int, int] = {}
    for part in _slices(data):
        kinds = part.translate(_CLASS)
        for kind in b"Uldpw":
            classes[kind] += kinds.count(kind)
        words = part.lower().split()
        found = Counter(words)
        places = map(_place, found)
        for at, n in zip(places, found.values()):
            counts[at] = counts.get(at, 0) + n
        size += len(part)
        n_words += len(words)
        distinct += len(found)
        foremost += max(found.values(), default=0)
        same += sum(map(eq, words, words[1:]))
        pairs += max(0, len(words) - 1)
        repeated += max(0, len(words) - 1) - len(set(zip(words, words[1:])))
        rows = [row for row in part.split(b"\n") if row.strip()]
        lines += len(rows)
        lines_again += len(rows) - len(set(rows))
        closed += sum(row.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for row in rows)
        alone += sum(1 for kind in kinds.split(b"s") if kind and not kind.strip(b"p"))
    letters = classes[ord("U")] + classes[ord("l")]

    def share(part: float, whole: float) -> float:
        return part / whole if whole else 0.0

    statistics = np.array([
        np.log1p(n_words), share(size, n_words), share(classes[ord("U")], letters), share(classes[ord("d")], size), share(classes[ord("p")], size),
        share(distinct, n_words), share(foremost, n_words), share(same, n_words), share(repeated, pairs), np.log1p(lines),
        share(lines_again, lines), np.log1p(share(n_words, lines)), share(closed, lines), share(alone, n_words), share(classes[ord("w")], size)])
    weights = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    norm = np.sqrt((weights**2).sum())
    return Features(np.fromiter(counts, np.int32, len(counts)), weights / norm if norm else weights, statistics)


class Machine(NamedTuple):
    """A fitted factorisation machine, and how numbers become places: mean and deviation of each, and the ends of its ranges."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    ends: np.ndarray

    def numbers(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of statistics and metadata. A missing number (NaN) has none."""
        known = np.flatnonzero(~np.isnan(values))
        scores = np.clip((values[known] - self.means[known]) / self.deviations[known], -CLIP, CLIP)
        ranges = (values[known, None] > self.ends[known]).sum(axis=1)
        ranged = BUCKETS + len(values) + known * BINS + ranges
        return np.concatenate([BUCKETS + known, ranged]), np.concatenate([scores / CLIP, np.ones(len(known))])

    def score(self, places: np.ndarray, weights: np.ndarray) -> float:
        """Probability of label 1 of a vector, in time linear in its places."""
        terms = weights[:, None] * self.factors[places]
        total = self.bias + weights @ self.weights[places] + 0.5 * ((terms.sum(axis=0)**2).sum() - (terms**2).sum())
        return float(_probability(np.array([total]))[0])


def _probability(totals: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(totals, -30, 30)))


def _vector(machine: Machine, found: Features, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places, weights = machine.numbers(np.concatenate([found.statistics, metadata]))
    return np.concatenate([found.places, places]), np.concatenate([found.weights, weights])


def train(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, machine: Machine) -> Machine:
    """The machine after gradient descent, steps scaled by the gradients so far, over the vectors in seeded random order."""
    rng = np.random.default_rng(7)
    size = len(machine.weights)
    weights, factors = machine.weights.copy(), rng.normal(0, 0.05, (size, RANK))
    bias, bias_seen = float(machine.bias), 1e-8
    weights_seen, factors_seen = np.full(size, 1e-8), np.full((size, RANK), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(vectors))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            sizes = np.array([len(vectors[i][0]) for i in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of = np.repeat(np.arange(len(rows)), sizes)
            places, x = np.concatenate([vectors[i][0] for i in rows]), np.concatenate([vectors[i][1] for i in rows])
            terms = x[:, None] * factors[places]
            sums = np.add.reduceat(terms, starts)
            totals = bias + np.add.reduceat(x * weights[places], starts) + 0.5 * (
                (sums**2).sum(axis=1) - np.add.reduceat((terms**2).sum(axis=1), starts))
            errors = (_probability(totals) - labels[rows]) / len(rows)
            used, at_used = np.unique(places, return_inverse=True)
            step = errors[of] * x
            pull = np.bincount(at_used, step, len(used)) + DECAY * weights[used]
            pulls = step[:, None] * (sums[of] - terms)
            pulls = np.stack([np.bincount(at_used, pulls[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * factors[used]
            bias_seen += errors.sum()**2
            weights_seen[used] += pull**2
            factors_seen[used] += pulls**2
            bias -= RATE * errors.sum() / np.sqrt(bias_seen)
            weights[used] -= RATE * pull / np.sqrt(weights_seen[used])
            factors[used] -= RATE * pulls / np.sqrt(factors_seen[used])
    return machine._replace(bias=bias, weights=weights, factors=factors)


def _untrained(values: np.ndarray, share: float) -> Machine:
    """A machine that gives every document the share of label 1, knowing the spread of the sample's numbers."""
    n = values.shape[1]
    size = BUCKETS + n * (1 + BINS)
    means, deviations, ends = np.zeros(n), np.ones(n), np.zeros((n, BINS - 1))
    for i, column in enumerate(values.T):
        known = column[~np.isnan(column)]
        if len(known):
            means[i], deviations[i] = known.mean(), known.std() or 1.0
            ends[i] = np.quantile(known, np.linspace(0, 1, BINS + 1)[1:-1])
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, RANK)), means, deviations, ends)


def _metadata(columns: tuple[str, ...]):
    """The numbers that come with a document, as logs of one more than their size, with their sign."""
    numbers = [named(c).cast("double") for c in columns]
    return F.array(*(F.signum(x) * F.log1p(F.abs(x)) for x in numbers)).cast("array<double>")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(data) for data in byte_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("draw"), batch.column("label"), pa.array([f.places for f in found], pa.list_(pa.int32())),
             pa.array([f.weights for f in found], pa.list_(pa.float64())), pa.array([f.statistics for f in found], pa.list_(pa.float64())),
             batch.column("metadata")],
            ["draw", "label", "places", "weights", "statistics", "metadata"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        label_id_col: str = "doc_id", metadata: tuple[str, ...] = (), sample: int = 6_000) -> Machine:
    """The machine of `docs` whose id `labels` marks 0 or 1.

    Labels without an id or a mark teach nothing, an id with several has the one that more than half
    of them tell (0 if neither). About `sample` ids are drawn by a hash, all where there are fewer;
    of documents with one id the least text teaches. Without labelled documents every score is 0.5,
    with labels of one kind the score is theirs.
    """
    told = labels.filter(named(label_id_col).isNotNull() & named(label_col).isNotNull()).groupBy(
        named(label_id_col).alias("label_id")).agg((F.avg(named(label_col).cast("double")) > 0.5).cast("int").alias("label"))
    draw = F.pmod(F.xxhash64("label_id"), F.lit(DRAWS))
    rate = min(1.0, sample / max(told.count(), 1))
    drawn = told.withColumn("draw", draw).filter(F.col("draw") < int(rate * DRAWS))
    texts = docs.select(named(id_col).alias("doc_id_"), F.coalesce(named(text_col), F.lit("")).alias("text"), _metadata(metadata).alias("metadata"))
    rows = texts.join(sent_if_small(drawn, ID_BYTES), F.col("doc_id_") == F.col("label_id")).groupBy("label_id", "draw", "label").agg(
        F.min(F.struct("text", "metadata")).alias("least")).select("draw", "label", "least.text", "least.metadata")
    found = rows.transform(
        in_arrow, _sampled,
        "draw long, label int, places array<int>, weights array<double>, statistics array<double>, metadata array<double>").toArrow()
    found = found.sort_by("draw")
    if not found.num_rows:
        return _untrained(np.zeros((0, len(STATISTICS) + len(metadata))), 0.5)
    known = [np.array([x if x is not None else np.nan for x in row], float) for row in found.column("metadata").to_pylist()]
    values = np.concatenate([np.array(found.column("statistics").to_pylist(), float), np.array(known).reshape(len(known), -1)], axis=1)
    labels_of = found.column("label").to_numpy().astype(float)
    machine = _untrained(values, labels_of.mean())
    if labels_of.min() == labels_of.max():
        return machine
    vectors = [
        _vector(machine, Features(np.array(p.values, dtype=np.int64), p_weights.values.to_numpy(), v[:len(STATISTICS)]), v[len(STATISTICS):])
        for p, p_weights, v in zip(found.column("places"), found.column("weights"), values)]
    return train(vectors, labels_of, machine)


def _scored(sent, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            scores = []
            for data, numbers in zip(byte_texts(batch.column("text")), batch.column("metadata").to_pylist()):
                metadata = np.array([x if x is not None else np.nan for x in numbers], float)
                scores.append(machine.score(*_vector(machine, features(data), metadata)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= least) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
                  metadata: tuple[str, ...] = (), least_score: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from `least_score` on).

    Only the text and the `metadata` columns, the same as in `fit`, decide. Null text is empty; an empty
    text is scored by its statistics; a missing number says nothing. Repeated rows get equal scores,
    an empty table gives no rows. Extra columns are ignored.
    """
    rows = docs.select(
        named(id_col).alias("doc_id"), held_out(named(id_col)).alias("held_out"),
        F.coalesce(named(text_col), F.lit("")).alias("text"), _metadata(metadata).alias("metadata"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return rows.transform(in_arrow, _scored(sent, least_score), f"doc_id {kind}, held_out boolean, score double, predicted int")
