import random

import duckdb
import pytest

from rotorline.llm import licenses as li
from tests.llm.conftest import rows


def corpus():
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choices(["under", "the", "terms", "of", "license", "software", "and", "x", "distributed"], k=n))
    pairs = []
    for i in range(150):
        name, text = rng.choice(li.TEMPLATES)
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = rng.choice(["foo", "the", ""])
        joined = rng.choice([" ", "\n * ", "  "]).join(words)
        pairs.append((i, f"{fill(rng.randrange(90))} {rng.choice([joined, joined.upper()])} {fill(rng.randrange(90))}"))
    both = " ".join(t for _, t in li.TEMPLATES)
    return [*pairs, (200, None), (201, ""), (202, "license"), (None, li.TEMPLATES[0][1]), (203, both), (203, both), (204, fill(20_000) + both)]


def brute(pairs):
    """Every run of twice a template's shingles against it, wherever it starts, by sets."""
    best = {}
    for i, text in pairs:
        words = li.words_of(text or "")
        grams = [" ".join(words[p:p + 5]) for p in range(len(words) - 4)]
        for name, template in li.TEMPLATES:
            own = set(li.shingles_of(template))
            room = 2 * (len(li.words_of(template)) - 4)
            for at in (p for p, gram in enumerate(grams) if gram in own):
                found = len(own.intersection(grams[at:at + room]))
                if found >= 0.8 * len(own) - 1e-9:
                    best[i, name] = max(best.get((i, name), (0,)), (found, len(own)))
    return sorted(((*k, *v) for k, v in best.items()), key=repr)


def test_equals_brute_force_and_sql(docs):
    pairs = corpus()
    got = rows(li.find_licenses(docs(*pairs)))
    assert got == brute(pairs)
    assert len(got) > 60
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", pairs)
    assert sorted(con.execute(li.windows_sql()).fetchall(), key=repr) == got


def test_plan_is_native(docs):
    plan = li.find_licenses(docs((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bands_guarantee_the_collision():
    for c in li.classes(li.TEMPLATES):
        for _, text in c.templates:
            needed, own = li.needed_of(text), len(li.shingles_of(text))
            similar = needed / (c.size + own - needed)
            assert (1 - similar) ** c.bands <= li.MISSED * 1.001 or similar == 1
            assert li.room_of(text) + c.step - 1 <= c.size  # a run lies whole in a window
            assert c.needed <= needed


def test_anchors_are_in_every_match():
    words = li.anchors(li.TEMPLATES)
    for _, text in li.TEMPLATES:
        without = [s for s in li.shingles_of(text) if not any(w in s for w in words)]
        assert len(without) < li.needed_of(text)


def test_empty_and_short(docs):
    assert li.find_licenses(docs((1, "a")).limit(0)).count() == 0
    assert li.find_licenses(docs((1, "license"), (2, None))).count() == 0
    with pytest.raises(ValueError):
        li.classes([("x", "too short")])


@pytest.mark.parametrize("name, inserted", [("mit-grant", 20), ("mit-body", 60), ("bsd-grant", 9), ("mit", 1)])
def test_inserted_words_are_found_wherever_the_notice_stands(docs, name, inserted):
    words = dict(li.TEMPLATES)[name].split()
    middle = len(words) // 2
    notice = " ".join(words[:middle] + ["zz"] * inserted + words[middle:])
    pairs = [(i, "before " * i + notice + " after" * 50) for i in range(40)]
    got = {r.doc_id: r.shingles_found for r in li.find_licenses(docs(*pairs)).filter(f"license = '{name}'").collect()}
    of = len(li.shingles_of(dict(li.TEMPLATES)[name]))
    if of - 4 >= li.needed_of(dict(li.TEMPLATES)[name]):
        assert got == {i: of - 4 for i in range(40)}
    else:
        assert not got


def test_the_best_run_counts_and_no_more(docs):
    """Parts of a notice that are too far from each other are no match together."""
    words = dict(li.TEMPLATES)["mit-grant"].split()
    far = " ".join(words[:30]) + " zz" * 200 + " " + " ".join(words[30:])
    twice = f"{' '.join(words[:-9])} {'zz ' * 300} {' '.join(words)} {'zz ' * 300} {' '.join(words[9:])}"
    got = rows(li.find_licenses(docs((1, far), (2, twice))), "doc_id", "license", "shingles_found")
    assert got == [(2, "mit-grant", len(li.shingles_of(dict(li.TEMPLATES)["mit-grant"])))]


def test_one_word_over_and_over(docs):
    """A very long document of a template's words takes no more than its windows."""
    got = rows(li.find_licenses(docs((1, "of this software and associated documentation " * 3_000 + " ".join(dict(li.TEMPLATES)["isc-body"].split())))), "license")
    assert ("isc-body",) in got
