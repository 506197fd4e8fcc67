import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from check import rows_of
from rotorline.llm import divergence
from tests.llm.conftest import rows


@pytest.fixture(scope="module")
def corpus(spark):
    def make(*found):
        """Rows of (lang, source, text), with columns whose names clash with results."""
        return spark.createDataFrame(
            [(i, *r, "x", "y", 1, "z") for i, r in enumerate(found)],
            "doc_id long, lang string, source string, text string, term string, part string, bucket int, item string")

    return make


def by_sql(found, least_docs, top):
    documents = pd.DataFrame(found, columns=["lang", "source", "text"])  # noqa: F841, read by the SQL
    con = duckdb.connect()
    con.register("documents", documents)
    cur = con.execute(divergence.divergence_sql(least_docs, top))
    names = [c[0] for c in cur.description]
    return rows_of(names, cur.fetchall())


def test_against_sql(corpus):
    rng = random.Random(3)
    words = ["a", "B", "ab", "Ünï", "É", "tie", "tied", "z9z", "don't", "日本"]
    found = [
        (rng.choice(["en", "fr", None]), rng.choice(["s", "t", "u", None]), " ".join(rng.choices(words, k=rng.randrange(12))))
        for _ in range(150)]
    found += [("en", "s", "a a a b")] * 80 + [("de", "empty", None), ("de", "other", ""), ("xx", "one", "a b c"), ("en", "quiet", "12 !?")]
    for least, top in ((1, 3), (4, 2), (500, 10)):
        got = divergence.source_divergence(corpus(*found), least_docs=least, top=top)
        assert rows_of(got.columns, got.collect()) == by_sql(found, least, top)


def test_by_hand(corpus):
    found = rows(divergence.source_divergence(corpus(("en", "s", "cat cat dog"), ("en", "t", "dog")), least_docs=1, top=1))
    # V = 2; s: cat (2 + 2) / 7, dog 3 / 7; t: cat 2 / 5, dog 3 / 5; all: cat 4 / 8, dog 4 / 8
    s, t = {"cat": 571428572, "dog": 428571429}, {"cat": 400000001, "dog": 600000001}
    sum_ = sum((s[w] - t[w])**2 // (s[w] + t[w]) for w in s)
    assert found == [
        ("en", "s", "pair", "t", sum_, 1), ("en", "s", "term", "cat", (s["cat"] - 500000001)**2 // (s["cat"] + 500000001), 1),
        ("en", "t", "pair", "s", sum_, 1), ("en", "t", "term", "dog", (t["dog"] - 500000001)**2 // (t["dog"] + 500000001), 1)]


def test_empty_table_and_texts(corpus, spark):
    assert rows(divergence.source_divergence(corpus().limit(0))) == []
    assert rows(divergence.source_divergence(corpus((None, None, None), (None, "t", "")))) == [
        ("", "", "pair", "t", 0, 1), ("", "t", "pair", "", 0, 1)]


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    rng = random.Random(5)
    data = "".join(rng.choice(["word ", "é", "日本語", "X", "1", "\n", "longer"]) for _ in range(5_000)).encode()
    whole = Counter(data.translate(divergence.TERM_BYTES).split())
    for size in (1, 7, 300, 1 << 20):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert divergence.term_counts(data) == whole


def test_folds_spill_and_merge_to_the_same_stripes():
    rng = random.Random(7)
    docs = [(rng.choice("ab"), rng.choice("xyz"), Counter(rng.choices([b"p", b"q", b"r", "ß".encode()], k=rng.randrange(5)))) for _ in range(60)]

    def stripes(every):
        fold, out = divergence.Fold(), []
        for i, doc in enumerate(docs):
            fold.add(*doc)
            if i % every == 0:
                out += fold.spilled()
                assert not fold.entries
        out += fold.spilled()
        parts = sorted((r["lang"], r["term"], i, j) for i, batch in enumerate(out) for j, r in enumerate(batch.to_pylist()))
        ordered = [out[i].slice(j, 1) for _, _, i, j in parts]
        found = [r for batch in divergence.merged(iter(ordered), 2) for r in batch.to_pylist()]
        return sorted((r["lang"], r["term"], r["docs"], sorted(zip(r["sources"], r["counts"]))) for r in found)

    assert stripes(1) == stripes(7) == stripes(1000)
    assert all(n >= 2 for _, _, n, _ in stripes(1))


def test_shares_of_large_counts_are_exact():
    np = divergence.np
    counts, size = np.array([0, 10**15, 3 * 10**15]), np.array([4 * 10**15 + 7] * 3)
    assert divergence.shares(counts, size).tolist() == [1 + 10**9 * (c + 2) // (4 * 10**15 + 7) for c in counts.tolist()]


def test_blocks_of_sources(corpus, monkeypatch):
    found = [("en", f"s{i % 7}", f"w{i % 3} w{i % 5}") for i in range(70)]
    whole = rows(divergence.source_divergence(corpus(*found), least_docs=2, top=3))
    monkeypatch.setattr(divergence, "BUCKET_ENTRIES", 4)
    assert rows(divergence.source_divergence(corpus(*found), least_docs=2, top=3)) == whole
    pa = divergence.pa
    stripes = pa.table({"term": ["a", "b"], "sources": [["s0", "s2"], ["s1"]], "counts": [[3, 1], [2]]})
    totals = pa.table({"lang": ["en"] * 3, "source": ["s0", "s1", "s2"], "n": [3, 2, 1], "n_lang": [6] * 3, "terms": [2] * 3})
    at_once = divergence._divergences(2)(stripes, totals)
    monkeypatch.setattr(divergence, "CELLS", 3)
    assert divergence._divergences(2)(stripes, totals).equals(at_once)
