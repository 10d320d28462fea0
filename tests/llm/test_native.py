"""Mixing, line chunks and decontamination against plain Python, and that no Python runs in their plans."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from orrery.llm import decontamination, line_dedup, mixing
from tests.llm.common import ODD, docs, edited, prose, shingles, words


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
    return df


def mix_input(seed=1):
    rng = random.Random(seed)
    texts = [*ODD, *(prose(rng, rng.randint(1, 200)) for _ in range(300))]
    names = [None, "b", "a", "B", "é"]
    return texts, [names[min(4, int(rng.expovariate(1)))] for _ in texts]


@pytest.mark.parametrize("per_range", [7, 10_000])
def test_mix(spark, per_range):
    texts, source = mix_input()
    rows = no_python(mixing.mix(docs(spark, texts, source=source), rows_per_range=per_range)).collect()
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    of = defaultdict(int)
    for i, s in enumerate(source):
        of[s] += size[i]
    order = sorted((s for s in of if s is not None), key=str.encode) + [None] * (None in of)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(of.values()), set(order)
    while open_:  # share, stop at the limit, share again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * of[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * of[s] for s in full}
        left -= sum(2 * of[s] for s in full)
        open_ -= full
    taken = defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == of[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in of)
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs(spark, texts, source=source).repartition(5), rows_per_range=per_range).collect()))


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, ["a"]).where("false")).collect() == []
    none = mixing.mix(docs(spark, [None, "", " "])).collect()
    assert [(r.size, r.taken, r.position) for r in none] == [(0, 0, None)] * 3
    one = mixing.mixed_documents(docs(spark, ["a b", "c d e", None]))
    assert one.columns == docs(spark, ["a"]).columns and {r.doc_id for r in one.collect()} == {0, 1}


def test_positions_invert_the_schedule(spark):
    for knots in mixing.SCHEDULES:
        df = spark.range(1001).selectExpr("id / 1000 as u")
        for r in df.select("u", mixing.inverse(knots, df["u"]).alias("t")).collect():
            used = 0.0
            for (t, w), (u, v) in zip(knots, knots[1:], strict=False):
                if r.t > t:
                    end = min(r.t, u)
                    used += (end - t) * (w + (w + (v - w) * (end - t) / (u - t))) / 2
            assert used == pytest.approx(r.u * mixing.integral(knots), abs=1e-9)


def signed(x):
    return x - (x >> 63 << 64)


def lines_brute(texts):
    def roll(mask, *parts):
        seed = xxhash.xxh64_intdigest(mask.to_bytes(4, "little"), seed=42)
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed=seed)
        return signed(seed)

    chunks, first, out = [], {}, {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42).to_bytes(8, "little") for x in lines]
        mine = set()
        for k in range(line_dedup.CHUNKINGS):
            for a in range(len(lines) - 1):
                if roll(2 * k, *h[a : a + 2]) % 3 < 2:
                    b = next((b for b in range(a, min(len(lines) - 1, a + 7)) if roll(2 * k + 1, *h[b : b + 2]) % 3 < 2), None)
                    mine.add((a, min(a + 8, len(lines)) if b is None else b + 2))
        chunks.append(sorted(mine))
        for a, b in chunks[-1]:
            if "".join(lines[a:b]).strip(" \t\n\x0b\f\r"):
                first.setdefault(tuple(lines[a:b]), (i, a))
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = [(a, b) for a, b in chunks[i] if first.get(tuple(lines[a:b]), (i, a)) != (i, a)]
        away = {k for a, b in gone for k in range(a, b)}
        text = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in away)
        out[i] = (0 if t is None else len(lines), len(away), len(gone), text)
    return out


def test_repeated_passages_go_and_every_line_stays_once(spark):
    rng = random.Random(12)
    share = {}
    for size in (2, 3, 4, 6, 8, 12):
        passages = ["\n".join(prose(rng, 8) for _ in range(size)) for _ in range(40)]
        texts = ["\n".join([prose(rng, 8), p, prose(rng, 8)]) for p in passages for _ in range(2)]
        got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
        assert {x for r in got.values() for x in r.text.split("\n")} == {x for t in texts for x in t.split("\n")}
        assert all(got[k].text == texts[k] for k in range(0, 80, 2))
        share[size] = sum(got[k].removed_lines for k in range(1, 80, 2)) / (40 * size)
    assert share[2] > 0.5 and share[3] > 0.75 and share[6] > 0.85 and share[12] > 0.9, share


def test_lines_of_rows_without_ids(spark):
    rng = random.Random(3)
    text = "\n".join(prose(rng, 5) for _ in range(12))
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.removed_lines, r.text) for r in line_dedup.dedup_lines(df).collect()]
    assert sum(t == text for _, _, t in got) == 1 and (None, 0, text) in got and (3, 0, None) in got
    again = line_dedup.dedup_lines(docs(spark, ["the same line\n" * 50])).first()
    assert again.text.split("\n").count("the same line") in (1, 2, 3)


def test_chunks_that_share_a_hash_are_compared(spark, monkeypatch):
    """With chunk hashes that are all alike, equal bytes alone decide."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c, f=F.xxhash64: F.lit(7).cast("long") if len(c) == 1 and "slice" in str(c[0]) else f(*c))
    rng = random.Random(6)
    passage = "\n".join(prose(rng, 6) for _ in range(12))
    texts = [prose(rng, 3) + "\n" + passage, "\n".join(prose(rng, 4) for _ in range(8)), passage, None, ""]
    got = {r.doc_id: (r.n_lines, r.removed_lines, r.removed_chunks, r.text) for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == lines_brute(texts)


def test_line_chunks(spark):
    rng = random.Random(6)
    passage = "\n".join(prose(rng, 6) for _ in range(30))
    texts = [*ODD, "\n\n\n\n", "a\nb\n"]
    for _ in range(20):
        own = "\n".join(prose(rng, rng.randint(0, 6)) for _ in range(rng.randint(1, 20)))
        texts += [own, own + "\n" + passage, passage + "\n" + own]
    texts += [texts[-1], passage + "\n" + passage]
    got = {r.doc_id: (r.n_lines, r.removed_lines, r.removed_chunks, r.text) for r in no_python(line_dedup.dedup_lines(docs(spark, texts))).collect()}
    want = lines_brute(texts)
    assert got == want and sum(v[2] for v in want.values()) > 100
    assert line_dedup.dedup_lines(docs(spark, ["a"]).where("false")).collect() == []


def test_contained_items(spark):
    rng = random.Random(8)
    items = [*(prose(rng, n) for n in (5, 6, 9, 20, 40, 80)), None, "", "a b c", "a b c d e"]
    texts = list(ODD)
    for t in items[:6]:
        w = t.split(" ")
        texts += [prose(rng, 3000) + " " + t.upper() + "\n" + prose(rng, 50), t, " ".join(w[: int(len(w) * 0.9)]) + " " + prose(rng, 40), " ".join(w[: int(len(w) * 0.7)]), prose(rng, 100)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for i, q in enumerate(items):
            mine, all_ = shingles(q), shingles(t)
            if len(words(q)) >= 5 and 10 * len(mine & all_) >= 8 * len(mine):
                want.add((d, i, len(mine), len(mine & all_)))
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in no_python(decontamination.contained_items(docs(spark, texts), bench)).collect()}
    assert got == want and len(want) > 15
    kept = decontamination.clean_documents(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {x[0] for x in want} and kept.columns == docs(spark, texts).columns
    assert decontamination.contained_items(docs(spark, texts), bench.where("false")).collect() == []
    assert decontamination.contained_items(docs(spark, texts).where("false"), bench).collect() == []


def test_mixed_rows_are_as_many_as_their_uses(spark):
    rows = [(7, "a b c d", "s", 1)] * 5 + [(None, "x y z", "s", 1)] * 40 + [(8, "q w e", "t", 2)] * 2 + [(None, "x y z", None, 1), (None, None, None, None), (9, "", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(3)
    for options in ({}, {"rows_per_range": 4}, {"rows_per_range": 1}):
        plan = mixing.plan_mix(df, **options)
        uses = plan.select("doc_id", F.explode(F.filter("passes", lambda p: p["words"] * 2 >= F.col("size")))).groupBy("doc_id").count()
        got = no_python(mixing.mixed_documents(df, **options)).collect()
        assert {r.doc_id: r["count"] for r in uses.collect()} == dict(Counter(r.doc_id for r in got))
        assert set(map(tuple, got)) <= set(rows)
        assert plan.count() == len(rows)
        for source, part in (("s", 5 * 4 + 40 * 3), ("t", 6), (None, 3)):
            some = [r for r in plan.where(F.col("source_size") == part).collect()]
            assert abs(sum(r.taken for r in some) - some[0].target) < 1


def test_rows_are_cleaned_by_their_texts(spark):
    item = "one two three four five six seven eight"
    items = spark.createDataFrame([(1, item), (1, None), (None, item), (2, "short item")], "item_id long, text string")
    texts = [f"x {item.upper()} y", "clean text of more than five words here", None, "", f"{item} " * 3, "short item is not found in here"]
    rows = [(i if k else None, t, k) for k in range(2) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = no_python(decontamination.clean_documents(df, items))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if r[1] not in (texts[0], texts[4]))
    assert got.columns == df.columns


def test_partitions_lose_nothing(spark):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (5, 6, 8, 9, 12, 13, 19, 20, 21, 40, 60, 61, 200)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(k, f"{prose(rng, rng.randint(0, 300))} {edited(rng, rng.choice(texts), rng.choice([0, 0.02, 0.05, 0.1]))} {prose(rng, 30)}") for k in range(150)]
    rows += [(1000 + k, " ".join(t.split(" ")[: rng.randint(4, 300)])) for k, t in enumerate(texts)]
    want = {}
    for d, t in rows:
        mine = shingles(t) if len(words(t)) >= 5 else set()
        for i, x in enumerate(texts):
            n = len(mine & shingles(x))
            if 10 * n >= 8 * len(shingles(x)):
                want[d, i] = (len(shingles(x)), n)
    got = decontamination.contained_items(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in got} == want and len(want) > 60
