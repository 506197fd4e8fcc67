import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from rotorline.llm import exact_dedup as ed
from tests.llm.conftest import rows


def brute(pairs, largest=True):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for i, t in pairs:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


CASES = {
    "copies, nulls and ties": [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (7, "c"), (8, "é" * 40_000)],
    "null ids alone": [(None, "z"), (None, "z")],
    "one row": [(9, "only")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups(docs, name, keep):
    got = ed.duplicate_groups(docs(*CASES[name]), keep=keep)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute(CASES[name], keep == "largest")


def test_many_rounds(spark, docs):
    rng = random.Random(5)
    pairs = [(i, "hot" if rng.random() < 0.4 else str(rng.randrange(400))) for i in range(3_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "67")  # 128 nodes, three rounds
    try:
        got = ed.duplicate_groups(docs(*pairs).repartition(9))
        assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute(pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty(docs):
    assert ed.duplicate_groups(docs((1, "a")).limit(0)).count() == 0
    assert ed.drop_duplicates(docs((1, "a")).limit(0)).count() == 0


def test_drop_keeps_columns_and_one_of_each(docs):
    df = docs((1, "a"), (2, "a"), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (6, None), (7, ""))
    out = ed.drop_duplicates(df)
    assert out.columns == df.columns
    assert rows(out, "doc_id", "text") == sorted([(2, "a"), (5, "b"), (None, "c"), (7, "")], key=repr)


def test_merge_is_streaming_and_whole():
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(8):
        e = np.ones(500, ed.ENTRY)
        e["digest"] = np.array([hashlib.sha256(bytes([x % 251, x // 251])).digest() for x in rng.integers(0, 900, 500)], "S32")
        e["check"], e["id"] = b"c" * 24, rng.integers(0, 10_000, 500)
        runs.append(ed.combined(e, True))
    pieces = sorted((r[i:i + 64] for r in runs for i in range(0, len(r), 64)), key=lambda p: bytes(p["digest"][0]))
    whole = ed.combined(np.concatenate(runs), True)
    assert np.concatenate(list(ed.merged(pieces, True))).tobytes() == whole.tobytes()


def test_check_separates_equal_digests():
    e = np.ones(2, ed.ENTRY)
    e["digest"], e["check"] = b"d" * 32, [b"1" * 24, b"2" * 24]
    assert len(ed.combined(e, True)) == 2


def test_keep_is_checked(docs):
    with pytest.raises(ValueError):
        ed.duplicate_groups(docs((1, "a")), keep="first")
