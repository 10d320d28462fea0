import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from orrery.llm import tokens
from orrery.llm.queries import SQL
from tests.llm.common import docs, prose, shingles

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 !! 34", "en", "src0", 8)], docs.schema)
    columns, at = docs.columns, docs.union(junk)
    seen = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, SF)
        assert at.columns == columns
        at = spark.createDataFrame(at.collect(), docs.schema)
        seen.append(at)
    ids = [sorted(r.doc_id for r in x.select("doc_id").collect()) for x in seen]
    every = {r.doc_id: r.text for r in docs.collect()}
    assert ids[0] == sorted(every)  # the junk goes, every document in a language stays
    kept = {i: shingles(every[i]) for i in ids[1]}
    for i in set(ids[0]) - set(ids[1]):
        a = shingles(every[i])
        assert any(10 * len(a & b) >= 6 * len(a | b) for b in kept.values())
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i in ids[1] if not any(10 * len(q & kept[i]) >= 8 * len(q) for q in items)]
    assert ids[2] == clean
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) > len(set(ids[3]))
    got = corpus_pipeline.STAGES[4][1](spark, seen[3], SF).collect()
    assert sorted(r.doc_id for r in got) == ids[3]


def test_run_is_the_stages_in_turn(spark):
    a = corpus_pipeline.run(spark, SF)
    b = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 100




def test_stages_take_empty_tables_and_other_columns(spark):
    empty = docs(spark, ["a"]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
    rng = random.Random(0)
    some = docs(spark, [prose(rng, 50) for _ in range(6)] + [None, ""])
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, some, SF)
        assert out.columns == some.columns
        assert {r["size"] for r in out.collect()} == {"x"}


def test_repeated_rows_leave_one(spark):
    rows = [(5, "some words that are here twice over", "en", "s", 1)] * 2 + [(5, "other words of the same doc_id in full", "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.STAGES[1][1](spark, df, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "None"]


def test_rows_without_doc_id_are_searched(spark):
    rng = random.Random(2)
    base = prose(rng, 60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, base, "en", "s", 1), (3, base + " x", "en", "s", 1), (None, base + " y", "en", "s", 1), (None, f"{prose(rng, 9)} {item} {prose(rng, 9)}", "en", "s", 1)] + [(None, "one two three four five six", "en", "s", 1)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.STAGES[1][1](spark, df, SF)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4]]))
    clean = corpus_pipeline.STAGES[2][1](spark, got, SF)
    assert sorted(map(str, map(tuple, clean.collect()))) == sorted(map(str, [rows[1], rows[4]]))
    assert corpus_pipeline.STAGES[3][1](spark, df, SF).where("text like 'one two%'").count() <= 8


def test_rows_of_the_whole_run_against_plain_programs(spark):
    """Every stage but the trained model again by other means: sets of words, SQL, the tokenizer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {r.doc_id: r for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    sets = {i: shingles(r.text) for i, r in at.items()}
    root = {i: i for i in at}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for x in by.values() for a in x for b in x if a < b}
    changed = True
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [at[i] for i in sorted(at) if root[i] == i and not any(10 * len(q & sets[i]) >= 8 * len(q) for q in items)]
    con = duckdb.connect()
    table = pa.Table.from_pylist([r.asDict() for r in kept])
    con.register("documents", table)
    taken = {d: (size, n) for d, size, n in con.sql(f"SELECT doc_id, size, taken FROM ({SQL['op4_mix_curriculum']})").fetchall()}
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    want, start = [], 0
    for r in kept:
        size, n = taken[r.doc_id]
        for words_taken in (min(size, n), n - min(size, n)):
            if words_taken and 2 * words_taken >= size:
                ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
                want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 100
