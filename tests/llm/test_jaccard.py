import random

import numpy as np
import pytest

from orrery.llm import jaccard
from tests.llm.common import ODD, docs, edited, prose, shingles


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def families(seed):
    rng = random.Random(seed)
    texts = list(ODD)
    passage = prose(rng, 60)
    for n in (5, 6, 9, 14, 30, 60, 120, 300, 800):
        base = prose(rng, n)
        texts += [base, base.upper(), edited(rng, base, 0.02), edited(rng, base, 0.03), edited(rng, base, 0.05)]
        texts.append(" ".join(base.split(" ")[: max(5, int(n * 0.85))]))
        texts.append(base + " " + prose(rng, max(1, n // 5)))
        texts += [passage + " " + prose(rng, n), prose(rng, n) + " " + passage]
    chain = prose(rng, 200)
    for _ in range(25):  # neighbours are linked, the ends are not
        chain = edited(rng, chain, 0.012)
        texts.append(chain)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("limits", [{}, {"LEAF": 3000, "SHARE": 2000}, {"LEAF": 700, "SHARE": 900, "BLOCK": 1500, "LEVELS": 2}, {"FEW": 2}, {"FEW": 2, "LEAF": 1500, "GAIN": 9.0, "BLOCK": 3000}, {"FEW": 1, "HELD": 300, "LEAF": 1000}])
def test_components_match_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    texts = families(len(str(limits)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == brute(texts)


def test_empty_table_and_null_ids(spark):
    assert jaccard.jaccard_components(docs(spark, ["a"]).where("false")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, None), (None, None)], "doc_id long, text string")
    got = sorted(jaccard.jaccard_components(df).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 0, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "3")]


def test_rows_without_ids_are_joined_too(spark):
    rng = random.Random(4)
    base = prose(rng, 60)
    rows = [(None, base), (None, base), (7, base + " extra"), (None, base + " more words"), (9, prose(rng, 60)), (9, base + " again"), (None, prose(rng, 50)), (None, "a b")] + [(None, "one two three four five six")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_rows(df).select("doc_id", "component_id", "first", "n").collect()
    assert len(got) == len(rows) and sum(r.first for r in got) == 5
    assert sorted(str(r.component_id) for r in got) == sorted(["7"] * 5 + ["9"] + ["None"] * 5)
    assert {r.doc_id for r in got if r.first} == {7, 9, None}


def test_texts_with_equal_polynomials_are_not_linked(spark):
    texts = []
    for n in (1024, 2048):
        one = "".join("ab"[k.bit_count() & 1] for k in range(n))
        two = one.translate({97: "b", 98: "a"})
        texts += [f"{one} x y z w", f"{two} x y z w", f"{one} x y z w", f"{two} x y z W v"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("leaf", [800, 40_000])
def test_tight_groups_beside_strangers(spark, monkeypatch, leaf):
    """Many near copies of one text, some of which only a chain connects, with FEW exceeded everywhere."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "BLOCK", 5 * leaf)
    rng = random.Random(leaf)
    base = prose(rng, 90)
    texts = [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03])) for _ in range(150)]
    far = base
    for _ in range(40):
        far = edited(rng, far, 0.02)
        texts.append(far)
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == brute(texts)


def test_registered_query_splits_regions_by_pivots(spark, monkeypatch):
    from orrery.llm.queries import op6_jaccard_components

    seen = []
    monkeypatch.setattr(jaccard, "split_regions", lambda members, level, f=jaccard.split_regions: seen.append(level) or f(members, level))
    assert op6_jaccard_components(spark, "/root/testdata/check_s").count() > 50_000
    assert seen


def test_linked_sets_always_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.integers(1, 400)) if rng.random() < 0.5 else int(rng.integers(1, 30))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 64, int(rng.integers(0, n // 8 + 2)), dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 80 * (len(a) + len(b) - inter):
            (s, ca), (t, cb) = jaccard.signatures(a), jaccard.signatures(b)
            common = set(s.tolist()) & set(t.tolist())
            assert common
            # the count that the filter relies on, in the slot of the smaller set
            parity = jaccard.slot_of(min(len(a), len(b))) & 1
            assert sum(x & 3 == parity for x in common) >= max(ca[parity], cb[parity]) - (len(a) + len(b)) // 9


def test_join_region_covers_without_losing_strangers():
    rng = random.Random(3)
    for _ in range(20):
        base, sets = list(range(60)), []
        for _ in range(30):
            if rng.random() < 0.2:
                base = [x if rng.random() > 0.1 else rng.randrange(10**6) for x in base]
            sets.append(np.unique(np.array([x if rng.random() > 0.06 else rng.randrange(10**6) for x in base], np.uint64)))
        links = jaccard.join_region(sets, list(range(len(sets))))
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        for i in range(len(sets)):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                    assert find(i) == find(j)
