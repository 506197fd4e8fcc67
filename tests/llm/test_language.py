import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rotorline.llm import language as la
from rotorline.llm.common import table
from tests.llm.conftest import rows

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, DATA, "documents")
    return la.fit(docs.filter(~la.held_out(docs["doc_id"])))


def test_held_out_fold(spark, docs):
    df = docs(*[(i, "x") for i in range(40)], (None, "x"))
    got = rows(df.select("doc_id", la.held_out(df["doc_id"])))
    assert got == sorted([(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in range(40)] + [(None, False)], key=repr)


def test_held_out_accuracy(spark, model):
    docs = table(spark, DATA, "documents")
    found = la.identify(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 150 and right / len(found) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_prediction_ignores_labels(spark, model):
    docs = table(spark, DATA, "documents").limit(50)
    plain = rows(la.identify(docs, model), "doc_id", "lang_pred", "score")
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'?' as source", "1 as lang_pred", "2 as score")
    assert rows(la.identify(other, model), "doc_id", "lang_pred", "score") == plain


def test_odd_texts(docs, model):
    pairs = [(1, None), (2, ""), (3, "12 ½ ² --- \n_"), (4, "the and of this " * 50_000), (5, "漢字"), (5, "漢字"), (None, "der die und nicht"), (6, "é" * 5_000)]
    df = docs(*pairs)
    got = {(r.doc_id, r.lang_pred) for r in la.identify(df, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de")} <= got
    assert all(lang in {*model.languages, "und"} for _, lang in got)
    kept = la.keep_identified(df, model)
    assert kept.columns == df.columns and rows(kept, "doc_id") == sorted([(4,), (5,), (5,), (6,), (None,)], key=repr)
    assert la.identify(df.limit(0), model).count() == 0


def test_nothing_labelled(spark, docs):
    df = docs((1, "word")).selectExpr("doc_id", "text", "cast(null as string) as lang")
    model = la.fit(df)
    assert rows(la.identify(df, model), "lang_pred", "score") == [("und", 0.0)]


def test_unseen_words_back_off_to_shorter_grams():
    logs = np.array([[-9.0, -9.0], [-3.0, -1.0], [0.0, -1.0], [0.0, -5.0], [-5.0, 0.0], [-1.0, -1.0]])
    model = la.Model(["x", "y"], {"known": 1}, {"abc": 2, "bc": 3, "cd": 4, "a": 5}, logs)
    scorer = la.Scorer(model)
    assert scorer.word("known").tolist() == [-3.0, -1.0]
    assert scorer._gram("abc").tolist() == [0.0, -1.0]
    assert scorer._gram("bcd").tolist() == [-5.0, -5.0]  # "bc" and "cd"
    assert scorer._gram("ab").tolist() == [-10.0, -10.0]  # "a" and an unseen "b"


def test_sample_is_bounded_and_whole_below_the_bound(spark):
    docs = table(spark, DATA, "documents")
    few = la.fit(docs, sample=5, most_words=50, most_grams=60)
    assert len(few.words) <= 50 * len(few.languages)
    assert len(few.grams) <= 60 * la.LONGEST * len(few.languages)


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(la, "REMEMBERED", 20)
    scorer, fresh = la.Scorer(model), la.Scorer(model)
    for i in range(200):
        text = f"wort{chr(97 + i % 26) * 3} the der {'xyz' * (i % 7)}{chr(97 + i % 23)}"
        assert scorer.predict(text) == la.Scorer(model).predict(text)
    assert len(scorer.places) < 30 and fresh.places == {}


def naive(training, texts):
    """{text: {language: log likelihood}} of a model counted and applied word by word."""
    languages = sorted({lang for lang, _ in training})
    words = {lang: Counter(w for of, t in training if of == lang for w in la.WORD.findall(t.lower())) for lang in languages}
    grams = {size: {lang: Counter() for lang in languages} for size in range(1, 5)}
    for lang in languages:
        for w, n in words[lang].items():
            for size in grams:
                for i in range(len(w) + 3 - size):
                    if (g := f" {w} "[i:i + size]) != " ":
                        grams[size][lang][g] += n

    def log(table, entry, lang):
        known = set().union(*table.values())
        return math.log((table[lang][entry] + 1) / (table[lang].total() + len(known) + 1)) if entry in known else None

    least = min(log(grams[size], g, lang) for size in grams for g in set().union(*grams[size].values()) for lang in languages)

    def gram(g, lang):
        found = log(grams[len(g)], g, lang)
        return found if found is not None else least if len(g) == 1 else gram(g[:-1], lang) + gram(g[1:], lang)

    def word(w, lang):
        found = log(words, w, lang)
        return found if found is not None else sum(gram(f" {w} "[i:i + min(4, len(w) + 2)], lang) for i in range(len(w) + 2 - min(4, len(w) + 2) + 1))

    return {t: {lang: sum(word(w, lang) for w in la.WORD.findall(t.lower())) for lang in languages} for t in texts}


def test_equals_a_naive_scorer(spark):
    training = [("en", "The cat and the hat, a cat of no hat."), ("en", "and then " + "longword" * 20), ("de", "Die Katze und der Hut, die Katze."), ("de", "ohne Hut"),
                ("fr", "Le chat et le chapeau é"), ("fr", "un chat" + "x" * 130)]
    texts = ["the cat", "Katzen und Hüte", "chapeaux élevés", "q", "zzz the", "longword" * 30, "x" * 500 + " und", "hat hut"]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(training)] + [(99, "nobody", None)], "doc_id long, text string, lang string")
    model = la.fit(docs)
    want = naive(training, texts)
    assert model.languages == ["de", "en", "fr"] and len(model.words) == len({w for _, t in training for w in re.findall("[a-zäöüé]+", t.lower())})
    got = {r.text: r for r in la.identify(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string"), model).selectExpr("doc_id AS text", "lang_pred", "score").collect()}
    for text, logs in want.items():
        best = max(logs.values())
        assert logs[got[text].lang_pred] == pytest.approx(best)
        assert got[text].score == pytest.approx(1 / sum(math.exp(x - best) for x in logs.values()))


def test_words_longer_than_any_bound(spark, model):
    """N-grams of a long word are those of the whole word, each once, and such words are not remembered."""
    long = "".join(chr(97 + i * 7 % 26) for i in range(1_000))
    counted = la._grams_of(spark.createDataFrame([("en", long, 2), ("en", "ab", 1)], "lang string, entry string, n long")).collect()
    want = Counter()
    for size in range(1, 5):
        for w, n in ((long, 2), ("ab", 1)):
            for i in range(len(w) + 3 - size):
                want[size, f" {w} "[i:i + size]] += n
    del want[1, " "]
    assert {(r["size"], r.entry): r.n for r in counted} == want
    scorer = la.Scorer(model)
    scorer.predict(f"the {long} of {long}")
    assert set(scorer.places) == {"the", "of"}
