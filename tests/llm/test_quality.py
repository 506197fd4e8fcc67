import random

import numpy as np
import pytest

from rotorline.llm import quality
from tests.llm.conftest import rows

WORDS = "the of and to in is that it for was on are as with his they at be this from have or by".split()


def good(rng):
    return "\n".join(" ".join(rng.choices(WORDS, k=12)) + "." for _ in range(4))


def bad(rng):
    return f"{rng.choice(WORDS).upper()}!! " * 40


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    marks = [int(rng.random() < 0.7) for _ in range(300)]
    docs = spark.createDataFrame(
        [(i, good(rng) if m else bad(rng), "en", "s", None if i % 7 == 0 else i, 0, "x") for i, m in enumerate(marks)],
        "doc_id long, text string, lang string, source string, n_chars long, label int, draw string")
    return docs, spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, quality int"), marks


def test_linear_time_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    size = quality.BUCKETS
    machine = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)) / 4, *[np.zeros(0)] * 3)
    places, x = rng.choice(size, 30, replace=False), rng.normal(size=30) / 3
    total = machine.bias + x @ machine.weights[places]
    for i in range(30):
        for j in range(i + 1, 30):
            total += machine.factors[places[i]] @ machine.factors[places[j]] * x[i] * x[j]
    assert machine.score(places, x) == pytest.approx(1 / (1 + np.exp(-total)))


def test_gradients():
    """The step of the training goes down the log loss, as differences of the loss tell."""
    rng = np.random.default_rng(1)
    vectors = [(rng.choice(40, 6, replace=False), rng.normal(size=6)) for _ in range(50)]
    labels = np.array([float(x[0] * x[1] > 0) for _, x in vectors])
    start = quality.Machine(0.0, np.zeros(40), np.zeros((40, quality.RANK)), *[np.zeros(0)] * 3)

    def loss(machine):
        p = np.clip([machine.score(*v) for v in vectors], 1e-9, 1 - 1e-9)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    assert loss(quality.train(vectors, labels, start)) < 0.6 * loss(start)


def test_held_out_accuracy(corpus):
    docs, labels, marks = corpus
    kept = docs.filter(~quality.held_out(docs["doc_id"]))
    machine = quality.fit(kept, labels, metadata=("n_chars",))
    out = quality.score_quality(docs, machine, metadata=("n_chars",)).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 300 and 30 < len(held) < 90
    assert all(r.predicted == marks[r.doc_id] and r.predicted == int(r.score >= 0.3) for r in out)
    again = quality.score_quality(docs.repartition(7), quality.fit(kept.repartition(5), labels, metadata=("n_chars",)), metadata=("n_chars",)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in out}


def test_only_the_text_and_its_numbers_decide(corpus, spark):
    docs, labels, _ = corpus
    machine = quality.fit(docs, labels)
    rng = random.Random(9)
    text = good(rng)
    odd = spark.createDataFrame(
        [(1, text, "en"), (None, text, None), (1, text, "xx"), (4, None, "en"), (5, "", "en"), (6, "1", "en"), (7, "x " * 400_000, "en")],
        "doc_id long, text string, lang string")
    out = quality.score_quality(odd, machine).collect()
    assert out[0].score == out[1].score == out[2].score and out[3].score == out[4].score
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 7 and not out[1].held_out
    assert quality.score_quality(odd.limit(0), machine).collect() == []


def test_labels_missing_or_of_one_kind(corpus, spark):
    docs, labels, _ = corpus
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    ones = quality.fit(docs, labels.filter("quality = 1").unionByName(spark.createDataFrame([(None, 0), (3, None)], labels.schema)))
    assert all(r.predicted == 1 for r in quality.score_quality(docs, ones).collect())
    assert {r.score for r in quality.score_quality(docs, quality.fit(docs.limit(0), labels)).collect()} == {0.5}


def test_repeated_ids_and_labels(corpus, spark):
    docs, labels, _ = corpus
    machine, again = quality.fit(docs, labels), quality.fit(docs.union(docs), labels.union(labels))
    assert rows(quality.score_quality(docs, machine)) == rows(quality.score_quality(docs, again))


def test_statistics_by_hand():
    found = dict(zip(quality.STATISTICS, quality.features("Aa aa b1!\n\n-- aa aa.\n-- aa aa.".encode()).statistics))
    assert found["words"] == pytest.approx(np.log(10)) and found["lines"] == pytest.approx(np.log(4))
    assert found["upper"] == pytest.approx(1 / 13) and found["same_as_last"] == pytest.approx(1 / 9)
    assert found["repeated_pairs"] == pytest.approx(2 / 8) and found["repeated_lines"] == pytest.approx(1 / 3)
    assert found["closed_lines"] == 1 and found["signs_alone"] == pytest.approx(2 / 9)


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(4)
    data = good(rng).encode() * 20
    whole = quality.features(data)
    monkeypatch.setattr(quality, "SLICE", 100)
    parts = quality.features(data)
    assert dict(zip(whole.places, whole.weights)) == pytest.approx(dict(zip(parts.places, parts.weights)))
    assert parts.statistics[0] == whole.statistics[0]
