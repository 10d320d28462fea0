"""Token files, archives and exact dedup against plain Python."""

import hashlib
import random
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import exact_dedup, tokens, warc
from orrery.llm.text import text_blocks
from tests.llm.common import ODD, docs, edited, prose


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.tokenizer_path())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎ ​ 　'slltvre.,;!aA1é٣½日<|endoftext|>", max_size=30), max_size=4))
def test_encoder_agrees_with_the_tokenizer(plain, encoder, texts):
    check(plain, encoder, texts)


def check(plain, encoder, texts):
    for i, j, raw, offs in text_blocks(pa.array(texts, pa.string())):
        for t, got in zip(texts[i:j], encoder(raw, offs), strict=True):
            assert got.tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_encoder_forgets_and_learns_anew(plain):
    own, rng = tokens.Encoder(tokens.tokenizer_path(), 200), random.Random(5)
    for _ in range(20):
        check(plain, own, [prose(rng, 30), "the same words", None, "", prose(rng, 50), "x. y, z.\n"])
        assert len(own.new) <= 200 and len(own.old) <= 200
    # a text with few new pieces, then one with more than the table holds, and the other way round
    for numbers in (range(150), range(1000), range(100), range(90, 300), range(2000), range(150)):
        check(plain, own, [" ".join(map(str, numbers)), "the same words"])


def test_only_the_batch_of_a_special_string_is_encoded_alone(plain, monkeypatch):
    own, alone = tokens.Encoder(tokens.tokenizer_path()), []
    monkeypatch.setattr(own, "_plain", lambda raw, f=own._plain: alone.append(raw) or f(raw))
    pieces = [f" word{k}".encode() for k in range(3 * tokens.LEARN)]
    pieces[5] = b" a" + own.special[0] + b"b"
    assert [np.frombuffer(x, own.type).tolist() for x in own.learned(pieces)] == [plain.encode(p.decode(), add_special_tokens=False).ids for p in pieces]
    assert len(alone) == tokens.LEARN


def thue_morse(n, a="a", b="b"):
    """Words whose polynomial hashes modulo 2**64 agree under every odd base, from 1024 characters on."""
    w = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return w.translate({97: a, 98: b}), w.translate({97: b, 98: a})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_with_equal_polynomials_keep_their_own_ids(plain, encoder, n):
    one, two = thue_morse(n)
    check(plain, encoder, [f"{one} x {two}", two, one, f"{two} {one}"])
    check(plain, encoder, [f"z {two} {two}"])


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    own, rng = tokens.Encoder(path), random.Random(6)
    plain = Tokenizer.from_file(path)
    assert not own.by_pieces and tokens.Encoder(tokens.tokenizer_path()).by_pieces
    check(plain, own, [prose(rng, 40), "Some words, with a stop.  And 123 \n\n more", None, "", *(t for t in ODD if t)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_rank_codes_round_trip(ranks):
    a = np.array(ranks, "<u4")
    assert tokens.unpack_ranks(*tokens.pack_ranks(a), len(a)).tolist() == ranks


def test_token_files(spark, plain, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    monkeypatch.setattr(tokens, "ROLL", 400)
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randint(1, 80)) for _ in range(60)), "ends <|endoftext|> here"]
    files = tokens.write_tokens(docs(spark, texts))
    got = {r.doc_id: r for r in tokens.read_tokens(files, ids=True).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        r = got.pop(i)
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got
    assert tokens.read_tokens(tokens.write_tokens(docs(spark, ["a"]).where("false"))).collect() == []


def test_a_worker_gives_freed_memory_back_after_each_block(tmp_path, monkeypatch, plain, encoder):
    rng, seen = random.Random(0), []
    texts = [prose(rng, 30) for _ in range(20)]
    monkeypatch.setattr(tokens, "TEXTS", 400)
    monkeypatch.setattr(tokens, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(tokens, "release", lambda: seen.append("release"))

    def encode(raw, offsets):
        seen.append("encode")
        return encoder(raw, offsets)

    encode.type = encoder.type
    monkeypatch.setattr(tokens, "encoder", lambda path: encode)
    batches = iter([pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": texts})])
    (made,) = tokens._writer(f"file://{tmp_path}", "", 2)(batches)
    n = seen.count("encode")
    assert n > 5 and seen[: 2 * n] == ["encode", "release"] * n
    got = [(d, x.tolist()) for ids, parts in tokens.read_file(made.to_pydict()["path"][0]) for d, x in zip(ids, parts, strict=True)]
    assert got == [(d, [*plain.encode(t, add_special_tokens=False).ids, 2]) for d, t in enumerate(texts)]


def test_repeated_and_null_doc_ids_have_an_order(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (2, "a"), (2, "b"), (1, None)], "doc_id long, text string")
    got = sorted(tokens.read_tokens(tokens.write_tokens(df)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 2] and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert got == sorted(tokens.read_tokens(tokens.write_tokens(df.repartition(4))).collect(), key=lambda r: r.start)


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_archive_round_trip(spark, split):
    rng = random.Random(2)
    long = prose(rng, 20_000)
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50, "é" * 50, long, long, "WARC/1.1\r\n\r\n" + long, *(prose(rng, 50) for _ in range(30))]
    rows = [(i, None if i == 3 else f"http://h/{i} \n", h, "x") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    files = warc.write_warc(pages)
    got = {r.page_id: r for r in warc.read_warc(files, split=split).collect()}
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        lead = first.setdefault(raw, i)
        again = len(raw) >= 100 and lead != i
        r = got.pop(i)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", lead) if again else ("response", None))
        assert r.payload == (None if again else raw)
    assert not got
    assert warc.read_warc(warc.write_warc(pages.where("false"))).collect() == []


def test_archive_listing_and_null_ids(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, "z" * 200), (7, "u", "z" * 200), (7, "u", "z" * 200)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w").count()
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_warc(warc.archive(spark, f"file://{tmp_path}/w")).collect())
    assert got == [("7", "response", None), ("7", "response", None), ("None", "revisit", 7)]


def test_exact_groups(spark):
    rng = random.Random(4)
    long = prose(rng, 30_000)
    texts = [*ODD, long, long, long[:-1], edited(rng, long, 0.001), "x" * 300_000, "x" * 300_000]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for run in (exact_dedup.exact_groups, exact_dedup._by_bytes):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in run(docs(spark, texts)).collect()}
        assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    twice = docs(spark, ["a", "b"]).union(docs(spark, ["a", "c"]))
    assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(twice).collect()) == [(0, 2, False), (0, 2, True), (1, 1, True), (1, 1, True)]
    assert exact_dedup.exact_groups(twice.where("false")).collect() == []


def test_a_shared_digest_is_found_by_its_bytes(spark, monkeypatch):
    class Weak:
        def __init__(self, part, digest_size):
            self.part = part

        def digest(self):
            return b"same for all"

    monkeypatch.setattr(exact_dedup.hashlib, "blake2b", Weak)
    # tasks run in another process: run one here
    out = [r for b in exact_dedup._recipes(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a", "b"]})])) for r in b.to_pylist()]
    assert [r["bytes"] for r in out if r["is_chunk"]] == [b"a", b"b"]


def test_cuts_follow_the_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, 200_000).astype(np.uint8)
    b = np.concatenate([rng.integers(0, 256, 777).astype(np.uint8), a])
    ends_a, ends_b = exact_dedup.cuts(a), exact_dedup.cuts(b)
    assert ends_a[-1] == len(a) and len(set(ends_a) & {e - 777 for e in ends_b}) > 0.8 * len(ends_a)


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_damage_in_an_archive_is_an_error(spark, tmp_path, split):
    rng = random.Random(4)
    files = warc.write_warc(spark.createDataFrame([(i, None, prose(rng, 60)) for i in range(5)], "page_id long, url string, html string").coalesce(1)).collect()
    path, size = files[0].path, files[0].bytes
    sound = open(path.removeprefix("file://"), "rb").read()
    assert len(sound) == size

    def read(raw, size=None):
        (tmp_path / "a.warc.gz").write_bytes(raw)
        table = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", size or len(raw))], "path string, bytes long")
        return warc.read_warc(table, split=split).count()

    assert read(sound) == 5
    second = sound.index(warc.MAGIC, 1)
    for at in (0, 2, 12, 40, second - 5, second, second + 11, second + 60, size - 3):
        with pytest.raises(Exception, match="DamagedArchive"):
            read(sound[:at] + bytes([sound[at] ^ 0x41]) + sound[at + 1 :])
    for raw in (sound[:-1], sound[:-300], sound[: second + 5], sound + b"x", sound[5:], sound[:second] + b"\0" + sound[second:]):
        with pytest.raises(Exception, match="DamagedArchive"):
            read(raw)
    with pytest.raises(Exception, match="DamagedArchive"):
        read(sound[:second], size)


def test_exact_groups_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (2, "a b"), (2, "a b"), (None, None), (None, ""), (5, "c"), (None, "d" * 5000), (None, "d" * 5000)], "doc_id long, text string").repartition(3)
    got = exact_dedup.exact_groups(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert len(got) == 9 and sorted(len(x) for x in by.values()) == [1, 2, 2, 4]
    for x in by.values():
        assert sum(r.kept for r in x) == 1 and {r.group_size for r in x} == {len(x)}
        assert {r.keep_id for r in x} == {max((r.doc_id for r in x if r.doc_id is not None), default=None)}


def test_passed_over_record_types_and_foreign_ids(tmp_path, spark):
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    page = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    raw = b""
    for x in (info, page, info):
        pack = zlib.compressobj(5, zlib.DEFLATED, 31)
        raw += pack.compress(x) + pack.flush()
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (r,) = warc.read_warc(warc.archive(spark, f"file://{tmp_path}")).collect()
    assert (r.page_id, r.payload_bytes, bytes(r.payload), r.record_type) == (None, 2, b"hi", "response")
