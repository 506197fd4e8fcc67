import random
import zlib

import numpy as np
import pytest

from rotorline.llm import token_store as ts
from rotorline.llm.tokens import BYTE_BPE, encoder


def ids_of(text, end=2):
    return [*encoder(BYTE_BPE).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("layout", ts.PLANES)
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(layout, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    planes = ts.to_planes(ids, layout)
    assert len(planes) == ts.PLANES[layout]
    assert ts.from_planes(planes, n, layout).tolist() == ids.tolist()


@pytest.mark.parametrize("layout", ts.PLANES)
def test_store_round_trip(spark, docs, folder, monkeypatch, layout):
    rng = random.Random(2)
    pairs = [(i, " ".join(rng.choices(["alpha", "été", "x", "\n", "12"], k=rng.randrange(60)))) for i in rng.sample(range(500), 120)]
    pairs += [(600, None), (601, ""), (602, "long " * 90_000), (None, "no id"), (7_000, "twice"), (7_000, "twice"), (7_000, "again")]
    path = folder("store")
    ts.write_tokens(docs(*pairs).repartition(5), path, layout=layout, shards=4)
    got = ts.read_tokens(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted((i or -1, tuple(ids_of(t))) for i, t in pairs)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens


def test_chunks_hold_whole_documents_and_blocks(spark, docs, folder):
    path = folder("store")
    ts.write_tokens(docs(*[(i, "many words " * 3_000) for i in range(60)]), path, shards=1)
    chunks = spark.read.parquet(path).orderBy("chunk").collect()
    assert len(chunks) > 1
    for c in chunks:
        assert sum(c.doc_lengths) == c.n_ids
        assert len(c.plane_ends) == 4 * -(-c.n_ids // c.block)


def test_empty(spark, docs, folder):
    path = folder("store")
    ts.write_tokens(docs((1, "a")).limit(0), path)
    assert ts.read_tokens(spark, path).count() == 0


def test_layout_is_checked(docs, folder):
    with pytest.raises(ValueError):
        ts.write_tokens(docs((1, "a")), folder("store"), layout="nibble")
