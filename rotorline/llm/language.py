"""Language of documents: known words first, character n-grams for the rest.

A word of the model scores its log frequency in each language. An unseen word is read as character
n-grams, longest first: a known n-gram scores its log frequency, an unknown one falls back to the
two shorter ones in it, down to single characters, and a character never seen scores the same in all
languages. The language with the highest sum over the words is the prediction.

The model is fitted on labelled rows drawn by a hash of their id, `sample` rows of each language on
average at most, and knows every word and n-gram of them: so the bounded sample bounds it, and it is
sent to every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.llm.common import in_arrow, named, sent_if_small

UNDECIDED = "und"
WORD = re.compile(r"[^\W\d_]+")
LETTERS = "\\p{L}+"
LONGEST = 4
REMEMBERED = 100_000
#: Letters of a word that are read for n-grams at a time; longer words are not remembered.
LONG_WORD = 64
DRAWS = 1 << 31


class Model(NamedTuple):
    """The languages, the rows of `logs` that words and n-grams have there, and log frequencies per language.

    Row 0 is that of a character never seen.
    """

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray


def _logs(found: pa.Table, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The entries of rows (lang, entry, n), and their log frequency per language, one added to every count."""
    coded = found.column("entry").combine_chunks().dictionary_encode()
    entries = coded.dictionary.to_pylist()
    counts = np.zeros((len(entries), len(languages)))
    langs = pc.index_in(found.column("lang"), pa.array(languages, pa.string())).to_numpy()
    np.add.at(counts, (coded.indices.to_numpy(), langs), found.column("n").to_numpy())
    return entries, np.log((counts + 1) / (counts.sum(axis=0) + len(entries) + 1))


def _grams_of(words: DataFrame) -> DataFrame:
    """(lang, size, entry, n) of the n-grams of `words` (lang, entry, n), a blank at either end; long words are read in parts."""
    part = F.explode(F.expr(f"sequence(0, length(word) - size, {LONG_WORD})")).alias("at")
    return (
        words.select("lang", F.concat(F.lit(" "), "entry", F.lit(" ")).alias("word"), "n")
        .select("lang", "word", "n", F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size")).filter("length(word) >= size")
        .select("lang", "word", "n", "size", part).selectExpr("lang", "n", "size", f"substring(word, at + 1, {LONG_WORD} + size - 1) AS word")
        .select("lang", "n", "size", F.explode(F.expr("transform(sequence(1, length(word) - size + 1), i -> substring(word, i, size))")).alias("entry"))
        .filter("entry <> ' '").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n")))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 4_000,
        most_words: int | None = None, most_grams: int | None = None) -> Model:
    """The model of rows with a language; rows without one or without a word teach nothing.

    About `sample` rows of each language are drawn by a hash of the id (of the text where there is
    none), all where there are fewer. With `most_words` or `most_grams`, only so many of the most
    frequent of a language (and size) are kept. Nothing labelled gives a model without languages,
    which predicts `und`. The model has a number for each of its entries and languages.
    """
    rows = labelled.filter(named(lang_col).isNotNull()).select(
        named(lang_col).cast("string").alias("lang"), named(text_col).alias("text"),
        F.pmod(F.when(named(id_col).isNull(), F.xxhash64(named(text_col))).otherwise(F.xxhash64(named(id_col))), F.lit(DRAWS)).alias("draw"))
    counted = rows.groupBy("lang").count()
    languages = sorted(r.lang for r in counted.select("lang").collect())
    if not languages:
        return Model([], {}, {}, np.zeros((1, 0)))
    rates = counted.select(F.col("lang").alias("of"), F.floor(F.least(F.lit(1.0), sample / F.col("count")) * DRAWS).alias("bound"))
    drawn = rows.join(sent_if_small(rates, 64), (F.col("lang") == F.col("of")) & (F.col("draw") < F.col("bound")))
    words = (
        drawn.select("lang", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(LETTERS), F.lit(0))).alias("entry"))
        .groupBy("lang", "entry").agg(F.count("*").alias("n")))

    def frequent(counts: DataFrame, most: int | None, *by: str) -> pa.Table:
        if most is not None:
            ranked = Window.partitionBy(*by).orderBy(F.desc("n"), "entry")
            counts = counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most).drop("rank")
        return counts.toArrow()

    known = frequent(words, most_words, "lang")
    grams = frequent(_grams_of(words), most_grams, "lang", "size")
    tables: list[np.ndarray] = []

    def rows_of(found: pa.Table) -> dict[str, int]:
        """The rows that entries get in the next of the tables."""
        first = 1 + sum(map(len, tables))
        entries, logs = _logs(found, languages)
        tables.append(logs)
        return {entry: first + i for i, entry in enumerate(entries)}

    gram_rows: dict[str, int] = {}
    for size in range(1, LONGEST + 1):
        gram_rows |= rows_of(grams.filter(pc.equal(grams.column("size"), size)))
    least = min((float(t.min()) for t in tables if len(t)), default=0.0)
    word_rows = rows_of(known)
    return Model(languages, word_rows, gram_rows, np.concatenate([np.full((1, len(languages)), least), *tables]))


class Scorer:
    """Predicts texts by a model. Scores of words are remembered until there are `REMEMBERED`."""

    def __init__(self, model: Model):
        self.model = model
        self.places: dict[str, int] = {}
        self.scores = np.empty((1024, len(model.languages)))

    def _gram(self, gram: str) -> np.ndarray:
        known = self.model.grams.get(gram)
        if known is not None:
            return self.model.logs[known]
        if len(gram) == 1:
            return self.model.logs[0]
        return self._gram(gram[:-1]) + self._gram(gram[1:])

    def word(self, word: str) -> np.ndarray:
        """Log score of one word per language; a run without letters (of signs like ½) scores nothing."""
        known = self.model.words.get(word)
        if known is not None:
            return self.model.logs[known]
        total = np.zeros(len(self.model.languages))
        if any(map(str.isalpha, word)):
            padded = f" {word} "
            size = min(LONGEST, len(padded))
            for i in range(len(padded) - size + 1):
                total += self._gram(padded[i:i + size])
        return total

    def _place(self, word: str) -> int:
        at = self.places.get(word)
        if at is None:
            at = self.places[word] = len(self.places)
            if at == len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[at] = self.word(word)
        return at

    def predict(self, text: str) -> tuple[str, float]:
        """(language, its share of the likelihood), or (und, 0) without letters or without languages."""
        words = WORD.findall(text.lower())
        if not words or not self.model.languages:
            return UNDECIDED, 0.0
        if len(self.places) > REMEMBERED:
            self.places.clear()
        places, total = list(map(self.places.get, words)), np.zeros(len(self.model.languages))
        if None in places:
            places = [self._place(word) for word in words if len(word) <= LONG_WORD]
            for word in words if len(places) < len(words) else ():
                if len(word) > LONG_WORD:
                    total += self.word(word)
        total += self.scores[places].sum(axis=0)
        if not total.any():
            return UNDECIDED, 0.0
        best = int(np.argmax(total))
        return self.model.languages[best], 1.0 / float(np.exp(total - total[best]).sum())


_LAST: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    """The scorer of a model, the same one for all tasks of a worker process."""
    if not _LAST or _LAST[0].model is not model:
        _LAST[:] = [Scorer(model)]
    return _LAST[0]


def _predicted(model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.value)
        for batch in batches:
            found = [scorer.predict(text.as_py() or "") for text in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != text_at),
                 pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*(n for i, n in enumerate(batch.schema.names) if i != text_at), "lang_pred", "score"])

    return run


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether a row is of the fold that teaches nothing: crc32 of the id as text, 0 modulo the folds."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    `und` with score 0 where the text is null or has no letter. Of languages with equal scores the
    first in order is told. Only the text decides, so repeated rows get equal results; ids may be
    null. An empty table gives no rows. Extra columns are ignored.
    """
    rows = docs.select(named(id_col).alias("doc_id"), held_out(named(id_col)).alias("held_out"), named(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.transform(in_arrow, _predicted(sent, 2), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _accepted(model, text_at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.value)
        for batch in batches:
            found = [scorer.predict(text.as_py() or "") for text in batch.column(text_at)]
            yield batch.filter(pa.array([lang != UNDECIDED and score >= least for lang, score in found], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """`docs` without rows of undecided language or a score under `least_score`; columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.transform(in_arrow, _accepted(sent, docs.columns.index(text_col), least_score), docs.schema)
