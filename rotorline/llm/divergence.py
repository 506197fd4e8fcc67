"""How the sources of a language differ in their words, from in-mapper stripes.

Every partition folds its whole documents into hash stripes: a term of a language has the number of
documents it is in and its occurrences by source. When a fold holds `ENTRIES` counts it is spilled, and
the stripes of all folds meet by (language, term), where Spark sorts them and a stream merges them with
one stripe open. Terms of too few documents end there. The merged stripes, in buckets of bounded size,
meet the totals of their language's sources and directly emit the divergences: sums per pair of sources
and the foremost terms of every source.

All arithmetic is on integers. A term's share of a group is p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)),
and two shares differ by floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import byte_texts, in_arrow, named, settled

SCALE = 1_000_000_000
#: Counts that a fold holds before it is spilled, and counts of a bucket of merged stripes.
ENTRIES, BUCKET_ENTRIES = 400_000, 400_000
#: Bytes of a text that are split into terms at a time, and shares that are compared at a time.
SLICE, CELLS = 1 << 20, 1 << 20
#: Every byte of a term as it counts, A-Z in lower case; all others are blank. Beyond ASCII all characters are of terms.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
STRIPES = "lang string, term string, docs long, sources array<string>, counts array<long>"
PARTS = "lang string, source string, part string, item string, value long"


def term_counts(data: bytes) -> Counter:
    """Occurrences of the terms of a text in UTF-8, split a slice at a time."""
    out: Counter = Counter()
    at = 0
    while at < len(data):
        end = at + SLICE
        text = data[at:end].translate(TERM_BYTES)
        while end < len(data) and not text.endswith(b" "):  # on to the end of the term that the slice would cut
            more = data[end:end + 256].translate(TERM_BYTES)
            cut = more.find(b" ") + 1 or len(more)
            text += more[:cut]
            end += cut
        out.update(text.split())
        at = end
    return out


class Fold:
    """Stripes in memory: documents per term of a language, and occurrences per term of a source."""

    def __init__(self):
        self.docs: dict[str, dict[bytes, int]] = {}
        self.counts: dict[str, dict[str, dict[bytes, int]]] = {}
        self.entries = 0

    def add(self, lang: str, source: str, found: Counter) -> None:
        docs = self.docs.setdefault(lang, {})
        counts = self.counts.setdefault(lang, {}).setdefault(source, {})
        before = len(counts)
        for term, n in found.items():
            docs[term] = docs.get(term, 0) + 1
            counts[term] = counts.get(term, 0) + n
        self.entries += len(counts) - before

    def spilled(self) -> Iterator[pa.RecordBatch]:
        """The stripes, a batch per language; the fold is empty afterwards."""
        for lang, docs in self.docs.items():
            if not docs:
                continue
            places = {term: i for i, term in enumerate(docs)}
            rows, sources, counts = [], [], []
            for source, of in self.counts[lang].items():
                rows.append(np.fromiter(map(places.__getitem__, of), np.int64, len(of)))
                counts.append(np.fromiter(of.values(), np.int64, len(of)))
                sources.append(source)
            codes = np.repeat(np.arange(len(sources)), [len(r) for r in rows])
            yield _stripes(
                pa.array([lang] * len(docs), pa.string()), pa.array(list(docs), pa.binary()).cast(pa.string()),
                np.fromiter(docs.values(), np.int64, len(docs)), np.concatenate(rows), codes, np.concatenate(counts), sources)
        self.__init__()


def _stripes(langs, terms, docs: np.ndarray, rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, sources: list[str]) -> pa.RecordBatch:
    """A batch of stripes, given the row, source and count of every entry; entries of one row and source are summed."""
    order = np.lexsort((codes, rows))
    rows, codes, counts = rows[order], codes[order], counts[order]
    if len(rows):
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])))
        rows, codes, counts = rows[first], codes[first], np.add.reduceat(counts, first)
    starts = pa.array(np.searchsorted(rows, np.arange(len(docs) + 1)).astype(np.int32))
    names = pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), pa.array(sources, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [langs, terms, pa.array(docs), pa.ListArray.from_arrays(starts, names), pa.ListArray.from_arrays(starts, pa.array(counts))],
        ["lang", "term", "docs", "sources", "counts"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = Fold()
    for batch in batches:
        for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), byte_texts(batch.column("text"))):
            fold.add(lang, source, term_counts(data))
            if fold.entries >= ENTRIES:
                yield from fold.spilled()
    yield from fold.spilled()


def _entries(stripes: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, source and count of every entry of a batch of stripes."""
    lists = stripes.column("sources")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten(), stripes.column("counts").flatten().to_numpy(zero_copy_only=False)


def merged(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """One stripe per (language, term) of stripes that come in that order, of terms in at least so many documents."""
    held: pa.RecordBatch | None = None

    def kept(stripes: pa.RecordBatch) -> pa.RecordBatch:
        return stripes.filter(pc.greater_equal(stripes.column("docs"), least_docs))

    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        langs, terms = batch.column("lang"), batch.column("term")
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.or_(pc.not_equal(terms[1:], terms[:-1]), pc.not_equal(langs[1:], langs[:-1])).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        rows, names, counts = _entries(batch)
        coded = names.dictionary_encode()
        out = _stripes(
            langs.take(pa.array(first)), terms.take(pa.array(first)), np.add.reduceat(batch.column("docs").to_numpy(), first),
            (np.cumsum(new) - 1)[rows], coded.indices.to_numpy(zero_copy_only=False), counts, coded.dictionary.to_pylist())
        held = out.slice(out.num_rows - 1)
        yield kept(out.slice(0, out.num_rows - 1))
    if held is not None:
        yield kept(held)


def term_stripes(docs: DataFrame, lang_col: str, source_col: str, text_col: str, least_docs: int) -> DataFrame:
    """(lang, term, docs, sources, counts) of the terms in at least `least_docs` documents of their language."""
    chosen = docs.select(*(
        F.coalesce(named(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    spilled = chosen.transform(in_arrow, _folded, STRIPES)
    ordered = spilled.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.transform(in_arrow, lambda batches: merged(batches, least_docs), STRIPES)


def shares(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / size), in steps of a thousand so that no product leaves 64 bits."""
    left, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        part, left = np.divmod(left * 1000, size)
        out = out * 1000 + part
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _divergences(top: int):
    """Of one bucket of a language's stripes and the totals of its sources: sums per pair, the bucket's `top` terms per source."""

    def run(stripes: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("source")
        sources, lang = totals.column("source").to_pylist(), totals.column("lang")[0].as_py()
        terms_kept = totals.column("terms")[0].as_py()
        sizes = totals.column("n").to_numpy() + 2 * terms_kept
        whole_size = np.int64(totals.column("n_lang")[0].as_py() + 2 * terms_kept)
        width = len(sources)
        batch = stripes.combine_chunks().to_batches()
        best: dict[int, list[tuple[int, str]]] = {}
        found_rows, names, found_counts = _entries(batch[0]) if batch else (np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64))
        codes = pc.index_in(names, pa.array(sources, pa.string())).to_numpy(zero_copy_only=False)
        terms = batch[0].column("term") if batch else []
        step = max(1, CELLS // width)
        out: list[tuple[str, str, str, int]] = []
        for low in range(0, width, step):  # a block of sources against all, so that the sums of all pairs are never held
            high = min(low + step, width)
            sums = np.zeros((high - low, width), np.int64)
            for at in range(0, len(terms), step):
                a, b = np.searchsorted(found_rows, (at, at + step))
                counts = np.zeros((min(step, len(terms) - at), width), np.int64)
                counts[found_rows[a:b] - at, codes[a:b]] = found_counts[a:b]
                p = shares(counts, sizes)
                for i in range(low, high):
                    sums[i - low] += difference(p[:, i:i + 1], p).sum(axis=0)
                if not low:
                    q = shares(counts.sum(axis=1), whole_size)
                    for i in range(width):
                        _keep_best(best.setdefault(i, []), counts[:, i], p[:, i], q, at, terms, top)
            for i in range(low, high):
                out += [(sources[i], "pair", sources[j], int(sums[i - low, j])) for j in range(width) if j != i]
        out += [(sources[i], "term", term, value) for i, of in best.items() for value, term in of]
        columns = list(zip(*out)) or [()] * 4
        return pa.table({
            "lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(columns[0], pa.string()),
            "part": pa.array(columns[1], pa.string()), "item": pa.array(columns[2], pa.string()), "value": pa.array(columns[3], pa.int64())})

    return run


def _keep_best(best: list[tuple[int, str]], counts, p, q, at: int, terms, top: int) -> None:
    """Add a block's terms that stand out in a source to its foremost ones: the largest values, equal ones by term."""
    places = np.flatnonzero((counts > 0) & (p > q))
    values = difference(p[places], q[places])
    if len(values) > top:
        enough = values >= np.partition(values, -top)[-top]
        places, values = places[enough], values[enough]
    best += [(int(v), terms[int(at + i)].as_py()) for i, v in zip(places, values)]
    best.sort(key=lambda found: (-found[0], found[1]))
    del best[top:]


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group that occurs.

    Part `pair` has a row for each other source of the language: the divergence of the two, summed over
    all kept terms (0 where there are none). Part `term` has the `top` terms that the group uses and uses
    more than its language, by their divergence from it. A term is a run of letters A-Z and a-z (in lower
    case) and characters beyond ASCII; kept are those in at least `least_docs` rows of their language.
    Rank is by value, largest first, equal ones by item.

    Null lang, source or text counts as empty. Each row is a document of its own, copies too. An empty
    table gives no rows, empty texts give their group without terms. Extra columns are ignored. The rows
    of part `pair` grow with the square of the sources of a language, as they are asked for; tasks hold
    a bucket of stripes, the totals of a language's sources and a block of sums.
    """
    kept = settled(term_stripes(docs, lang_col, source_col, text_col, least_docs))
    entries = kept.agg(F.sum(F.size("sources"))).first()[0] or 0
    buckets = -(-entries // BUCKET_ENTRIES) or 1
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy(
        "lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    groups = docs.select(*(
        F.coalesce(named(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()
    totals = (
        groups.join(counted, ["lang", "source"], "left")
        .join(counted.groupBy("lang").agg(F.sum("n").alias("n_lang")), "lang", "left")
        .join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
        .na.fill(0, ["n", "n_lang", "terms"])
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))))
    bucketed = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "sources", "counts")
    parts = bucketed.groupBy("lang", "bucket").cogroup(totals.groupBy("lang", "bucket")).applyInArrow(_divergences(top), PARTS)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = "PARTITION BY lang, source, part ORDER BY value DESC, item"
    return summed.selectExpr("*", f"row_number() OVER ({order}) AS rank").filter((F.col("part") == "pair") | (F.col("rank") <= top))


def divergence_sql(least_docs: int = 10, top: int = 10) -> str:
    """The same over the table `documents`, with every share written out."""
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {least_docs}),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c,
                     1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (coalesce(n, 0) + 2 * v) AS p
              FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 2) // (n + 2 * v) AS q
              FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) USING (lang) JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
        WHERE part = 'pair' OR rank <= {top}
    """
