import random
import re

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from rotorline.llm import simhash as sh
from rotorline.llm.components import components
from tests.llm.conftest import rows


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=2):
    """{doc: smallest id reachable} of {doc: fingerprint}."""
    out, left = {}, set(prints)
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            near = {d for d in left if (prints[d] ^ prints[todo[-1]]).bit_count() <= radius}
            todo.pop()
            left -= near
            group |= near
            todo.extend(near)
        out |= dict.fromkeys(group, min(group))
    return out


@given(st.text("aBé \t\n\x0b\x1c İ", max_size=40))
def test_print_is_the_plain_one(text):
    assert sh.simhash(text.encode(), 3) == brute_print(text)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 2**64 - 1), st.integers(0, 30))
def test_tree_finds_all_within(values, asked, radius):
    values |= {asked ^ 1, asked ^ 6}
    assert set(sh.BKTree(values).within(asked, radius)) == {v for v in values if (v ^ asked).bit_count() <= radius}


def noisy(rng, value, flips):
    for b in rng.sample(range(64), flips):
        value ^= 1 << b
    return value


def test_links_join_what_is_near(spark, monkeypatch):
    rng = random.Random(3)
    for shard in (2_048, 7):
        monkeypatch.setattr(sh, "SHARD", shard)
        centres = [rng.getrandbits(64) for _ in range(15)] + [0, 2**64 - 1]
        values = {noisy(rng, rng.choice(centres), rng.randrange(5)) for _ in range(250)}
        frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long")
        roots = dict((r[0] % 2**64, r[1] % 2**64) for r in components(sh.print_links(frame)).collect())
        want = brute_groups({v: v for v in values})
        groups, wanted = {}, {}
        for v in values:
            groups.setdefault(roots.get(v, v), set()).add(v)
            wanted.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_path_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(i, 100) for i in range(101, 160)]
    got = dict(components(spark.createDataFrame(links, "hi long, lo long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    out = [None, "", " \n", "one", "One", "two words", "the same " * 20_000]
    for text in base:
        out += [text, text, text.upper()] + [re.sub(r"w5\b", "w6", text), text + " tail"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_groups_equal_brute_force(docs):
    pairs = corpus()
    want = brute_groups({i: brute_print(t) for i, t in pairs})
    got = sh.near_groups(docs(*pairs))
    assert rows(got, "doc_id", "fingerprint", "component_id", "kept") == sorted(
        ((i, f"{brute_print(t):016x}", want[i], i == want[i]) for i, t in pairs), key=repr)


def test_drop_keeps_one_of_each_group(docs):
    pairs = corpus()
    df = docs(*pairs, (0, dict(pairs)[0]), (None, "one"), (None, "quite other words"))
    out = sh.drop_near_duplicates(df)
    assert out.columns == df.columns
    want = set(brute_groups({i: brute_print(t) for i, t in pairs}).values())
    assert rows(out, "doc_id") == sorted([(i,) for i in want] + [(None,)], key=repr)


def test_empty(docs):
    assert sh.near_groups(docs((1, "a")).limit(0)).count() == 0
    assert sh.drop_near_duplicates(docs((1, "a")).limit(0)).count() == 0


def test_crowded_blocks_are_dealt_once_more(spark):
    """Ten thousand fingerprints that agree in two blocks of bits: few rows for each, and no link lost."""
    rng = np.random.default_rng(5)
    high = rng.choice(1 << 32, 10_000, replace=False).astype(np.uint64)
    values = set((high << np.uint64(32) | np.uint64(0x1234ABCD)).tolist())
    planted = {}
    for value in list(values)[:300]:
        near = value ^ (1 << int(rng.integers(32, 64))) ^ (1 << int(rng.integers(32, 64)))
        if near != value and near not in values:
            planted[near] = value
    values |= planted.keys()
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long")
    assert sh._cells(frame, 2).selectExpr("sum(ceil(n / 2048)) AS rows").first().rows < 20 * len(values)
    roots = {r.vertex % 2**64: r.root % 2**64 for r in components(sh.print_links(frame)).collect()}
    assert len(planted) > 250
    for near, value in planted.items():
        assert roots.get(near, near) == roots.get(value, value)


def test_crowded_cells_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sh, "SHARD", 3)
    monkeypatch.setattr(sh, "MOST_PARTS", 2)
    rng = random.Random(8)
    for radius in (1, 2, 3):
        base = [rng.getrandbits(64) for _ in range(4)]
        values = {b ^ (rng.getrandbits(10) << rng.choice([0, 27, 50])) for b in base for _ in range(40)}
        frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long")
        roots = {r.vertex % 2**64: r.root % 2**64 for r in components(sh.print_links(frame, radius)).collect()}
        groups = {v: {v} for v in values}
        for v in values:
            for w in values:
                if (v ^ w).bit_count() <= radius and groups[v] is not groups[w]:
                    groups[v] |= groups[w]
                    for x in groups[w]:
                        groups[x] = groups[v]
        tops = {}
        for v in values:
            tops.setdefault(roots.get(v, v), set()).add(v)
        assert sorted(map(sorted, tops.values())) == sorted(map(list, {tuple(sorted(g)) for g in groups.values()}))
