from collections import defaultdict

import pytest

import corpus_pipeline as cp
from rotorline.llm import language
from tests.llm.conftest import rows
from tests.llm.test_decontaminate import brute as hits_of
from tests.llm.test_simhash import brute_groups, brute_print

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage over the given documents, some spoilt, and what comes out."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame(
        [(9_000, None, None, None, None), (9_001, "12 345", "en", "s", 6), (None, docs.first().text, "en", "s", 3)], docs.schema)
    docs = docs.union(odd).union(docs.limit(3)).selectExpr("*", "1 as kept", "'x' as text_digest", "doc_id as doc_id_")
    out = []
    for name, stage in cp.STAGES:
        result = stage(spark, docs, DATA).checkpoint()
        out.append((name, docs, result))
        docs = result
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_pass(stages):
    for _, before, after in stages[:-1]:
        assert after.schema == before.schema


def test_language(stages):
    _, before, after = stages[0]
    want = [(i, t) for i, t in texts(before) if t and any(map(str.isalpha, t))]
    assert sorted(texts(after), key=repr) == sorted(want, key=repr)


def test_exact(stages):
    _, before, after = stages[1]
    best = {}
    for i, t in texts(before):
        best[t] = i if best.get(t) is None else max(best[t], i if i is not None else best[t])
    assert sorted(texts(after), key=repr) == sorted(((i, t) for t, i in best.items()), key=repr)


def test_near(stages):
    _, before, after = stages[2]
    prints = {i: brute_print(t) for i, t in texts(before)}
    assert sorted(i for i, _ in texts(after)) == sorted(set(brute_groups(prints).values()))


def test_decontamination(spark, stages):
    _, before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    known = {w for _, t in items for w in (t or "").split()}
    want = [(i, t) for i, t in texts(before) if known.intersection(t.split()) and not hits_of(t, items)[1] or not known.intersection(t.split())]
    assert sorted(texts(after), key=repr) == sorted(want, key=repr)


def test_packing(stages):
    _, before, after = stages[4]
    per = defaultdict(list)
    for r in after.collect():
        per[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(per) == {i for i, _ in texts(before)}
    for pieces in per.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total


def test_empty_table_passes_every_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        result = stage(spark, docs, DATA)
        assert result.count() == 0
        docs = docs if result.columns[-1] == "offset" else result


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA).checkpoint()
    total = lambda df: rows(df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}))
    assert total(cp.run(spark, DATA)) == total(docs) != []


def test_stages_are_named():
    assert [name for name, _ in cp.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    assert cp.ORACLE_SQL is None and language.UNDECIDED == "und"
