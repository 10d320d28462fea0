"""Token ids as files of frequency-ranked, byte-aligned variable-length codes (operator 5).

Every text is encoded whole with a public byte-level tokenizer, and an end id is appended.  Documents are
range-partitioned by doc_id, and each task writes its range as files of some ``ROLL`` ids.  A file ranks its ids
by how often they occur in it, so the commonest take one byte.  A rank is stored in one to four
little-endian bytes; its length less one stands in two bits of a separate control byte
for four ranks.  The reader expands control bytes by a table of 256 rows of four lengths.

File format, little-endian: ``ORTK``, u32 version, u32 number of ids V, V u32 ids by rank; then blocks:
u32 documents, u64 ids, u64 data bytes; i64 doc_id each; u8 1 if doc_id is null each; u32 ids of each;
control bytes (ids / 4, rounded up); data bytes.  Files are in ascending doc_id order, and so are blocks.

The tokenizer splits at pre-token borders and encodes each pre-token by itself.  White space other than
a leading blank never shares a pre-token with anything else, so a text is cut into such pieces, and each
distinct piece is encoded by the tokenizer once, for as long as a worker remembers it.  Texts with
white space beyond ASCII, or with the string of a special token, are encoded whole instead, and so are
all texts if the tokenizer splits by other rules.

Defined results: null text is empty and has the end id only; repeated doc_ids stand next to each other
in the order of a hash of their texts; null doc_ids come first; an empty table writes no files and
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.text import SPACE, distinct, release, text_blocks
from orrery.plans.scratch import new_dir, written

END = 2
BLOCK_IDS = 1 << 18
ROLL = 1 << 23
#: Pieces in each of the two tables of a worker, those sent to the tokenizer at once, and bytes of texts encoded together.
CACHE, LEARN, TEXTS = 250_000, 400, 2 << 20
MAGIC = b"ORTK"
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def piece_starts(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts, none of which has white space beyond ASCII.

    ``first``: where the (non-empty) texts begin.  Pieces cover all bytes.  A word takes the blank before it;
    of several white-space characters before a word the last stands apart; at the end of a text they stay together.
    """
    blank = SPACE[raw]
    head = np.zeros(len(raw) + 1, bool)
    head[first] = True
    head[-1] = True
    after = np.ones(len(raw), bool)  # the byte before is white space, or there is none in the text
    after[1:] = blank[:-1]
    after[first] = True
    start = head[:-1].copy()
    start |= blank & ~after
    word = np.flatnonzero(~blank & after & ~head[:-1])
    start[word - 1] = True  # the last of the white space before a word
    start[word[raw[word - 1] != 0x20]] = True
    # a comma or full stop after a letter, at the end of a word, is a pre-token of its own
    tail = ((raw == 0x2C) | (raw == 0x2E)) & ~head[:-1]
    tail[1:] &= (raw[:-1] >= 97) & (raw[:-1] <= 122)
    tail[:-1] &= blank[1:] | head[1:-1]
    return np.flatnonzero(start | tail)


def cut_alike(own) -> bool:
    """Whether a tokenizer splits texts by the rules that ``piece_starts`` follows."""
    if own.pre_tokenizer is None or own.normalizer is not None or own.truncation is not None or own.padding is not None:
        return False
    split, model = json.loads(own.pre_tokenizer.__getstate__()), own.model
    bpe = type(model).__name__ == "BPE" and not any((model.dropout, model.unk_token, model.continuing_subword_prefix, model.end_of_word_suffix))
    return bpe and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


class Encoder:
    """Ids of whole texts, by pieces that are remembered with their ids.

    Pieces are told apart by their bytes.  There are two tables of up to ``CACHE`` pieces each; when the
    newer is full it takes the place of the older, so pieces in use stay.  What a block needs is held by
    the block itself, so that forgetting never changes a result.  A tokenizer that splits by other
    rules (see ``cut_alike``) gets whole texts.
    """

    def __init__(self, path: str, cache: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.by_pieces = cut_alike(self.own)
        added = self.own.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        sound = [(t.content.encode(), k) for k, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.between = min(sound, default=None)
        self.type = np.dtype("<u2" if max(self.own.get_vocab(True).values(), default=0) < 1 << 16 else "<u4")
        self.cache = CACHE if cache is None else cache
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        release()  # what reading the vocabulary took

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, as bytes."""
        out, old = list(map(self.new.get, pieces)), self.old.get
        away = [k for k, x in enumerate(out) if x is None]
        asked = [pieces[k] for k in away]
        found = list(map(old, asked))
        at = [k for k, x in enumerate(found) if x is None]
        if at:
            for k, x in zip(at, self.learned([asked[k] for k in at]), strict=True):
                found[k] = x
        for k, x in zip(away, found, strict=True):
            out[k] = x
        if len(self.new) + len(asked) > self.cache:
            self.old, self.new, asked, found = self.new, {}, pieces, out
        if len(asked) <= self.cache:
            self.new.update(zip(asked, found, strict=True))
        return out

    def learned(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces from the tokenizer, ``LEARN`` at once.

        The tokenizer splits texts at its special tokens before all else, so pieces joined by one keep their ids, and
        the special token's id tells them apart.
        """
        if self.between is None:
            return [self._plain(p).tobytes() for p in pieces]
        out, width = [], self.type.itemsize
        for low in range(0, len(pieces), LEARN):
            some = pieces[low : low + LEARN]
            joined = self.between[0].join(some)
            # searched once joined, as searching each piece takes long
            if any(joined.count(x) > (len(some) - 1) * (x in self.between[0]) for x in self.special):
                out += [self._plain(p).tobytes() for p in some]
                continue
            (found,) = self.own.encode_batch_fast([joined.decode()], add_special_tokens=False)
            ids = np.array(found.ids, self.type)
            raw, ends = ids.tobytes(), [*(np.flatnonzero(ids == self.between[1]) * width).tolist(), len(ids) * width]
            out += [raw[a:b] for a, b in zip([0, *(x + width for x in ends[:-1])], ends, strict=True)]
        return out

    def _plain(self, raw: bytes) -> np.ndarray:
        return np.array(self.own.encode(raw.decode(), add_special_tokens=False).ids, self.type)

    def odd(self, raw: np.ndarray, offsets: np.ndarray) -> set[int]:
        """Texts with other white space, or with the string of a special token."""
        lead = np.flatnonzero((raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3)).astype(np.int32)
        a, b, c = (raw.take(lead + k, mode="clip") for k in (0, 1, 2))
        wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        wide |= (a == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        at, whole = lead[wide].tolist(), raw.tobytes()
        for x in self.special:
            k = whole.find(x)
            while k >= 0:
                at.append(k)
                k = whole.find(x, k + 1)
        return set((np.searchsorted(offsets, at, side="right") - 1).tolist())

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a block (see ``text_blocks``), in ``type``."""
        n = len(offsets) - 1
        if not len(raw):
            return [np.zeros(0, self.type)] * n
        ends = offsets.tolist()
        if not self.by_pieces:
            return [self._plain(raw[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
        odd = self.odd(raw, offsets)
        start = piece_starts(raw, offsets[:-1][np.diff(offsets) > 0])
        which, pieces = distinct(raw, np.append(start, len(raw)))
        coded = self.ids_of(pieces)
        pool = np.frombuffer(b"".join(coded), self.type)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // self.type.itemsize
        del pieces, coded
        count, place = size[which], (np.cumsum(size) - size)[which]
        stop = np.cumsum(count)
        place -= stop - count
        at = np.repeat(place, count)
        at += np.arange(stop[-1])
        ids = pool[at]
        cut = np.append(0, stop)[np.searchsorted(start, offsets)]
        del which, count, place, at
        return [self._plain(raw[ends[d] : ends[d + 1]].tobytes()) if d in odd else ids[cut[d] : cut[d + 1]] for d in range(n)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that what it remembers serves all tasks that the worker runs."""
    return Encoder(path)


def pack_ranks(rank: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    size = np.ones(len(rank) + -len(rank) % 4, np.uint8)
    for k in (8, 16, 24):
        size[: len(rank)] += rank >= 1 << k
    codes = (size - 1).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = int(size.max(initial=1))
    raw = rank.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide]
    return control.tobytes(), raw[np.arange(wide, dtype=np.uint8) < size[: len(rank), None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks from control and data bytes, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    wide = int(size.max(initial=1))
    wide = 4 if wide == 3 else wide
    out = np.zeros((n, wide), np.uint8)
    out[np.arange(wide, dtype=np.uint8) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{wide}").ravel()


def _write_file(folder: str, docs: list[tuple[int | None, np.ndarray]]) -> str:
    """Write one file; its path."""
    count = np.zeros(1, np.int64)
    for at in range(0, len(docs), 4096):
        n = np.bincount(np.concatenate([x for _, x in docs[at : at + 4096]]), minlength=len(count))
        n[: len(count)] += count
        count = n
    used = np.flatnonzero(count)
    ranked = used[np.argsort(-count[used], kind="stable")].astype("<u4")
    rank = np.zeros(len(count), "<u4")
    rank[ranked] = np.arange(len(ranked))
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.ortk"
    with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
        sink.write(MAGIC + struct.pack("<II", 1, len(ranked)) + ranked.tobytes())
        at = 0
        while at < len(docs):
            to, many = at, 0
            while to < len(docs) and many < BLOCK_IDS:
                many += len(docs[to][1])
                to += 1
            part, at = docs[at:to], to
            control, data = pack_ranks(rank[np.concatenate([x for _, x in part])])
            sink.write(struct.pack("<IQQ", len(part), many, len(data)))
            sink.write(np.array([d or 0 for d, _ in part], "<i8").tobytes() + bytes(d is None for d, _ in part))
            sink.write(np.array([len(x) for _, x in part], "<u4").tobytes() + control + data)
    return f"{folder}/{name}"


FILES = "file long, path string, first_doc long, docs long, ids long"


def _writer(folder: str, path: str, end: int):
    """Texts in doc_id order to files; a row for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        last, docs, many, made = np.array([end], encode.type), [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, many, made
            row = {"file": [TaskContext.get().partitionId() << 24 | made], "path": [_write_file(folder, docs)], "first_doc": [docs[0][0]], "docs": [len(docs)], "ids": [many]}
            docs, many, made = [], 0, made + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([(x, pa.string() if x == "path" else pa.int64()) for x in row]))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, raw, offs in text_blocks(batch.column(1), TEXTS):
                for d, found in zip(ids[i:j], encode(raw, offs), strict=True):
                    docs.append((d, np.concatenate([found, last])))
                    many += len(docs[-1][1])
                    if many >= ROLL:
                        yield close()
                release()  # freed memory that stays with the worker counts beside all that the executor holds
        if docs:
            yield close()
        release()

    return write


def write_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None, end: int = END) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files; one row for each: file (its place), path, first_doc, docs, ids, start."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    laid = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = written(laid.mapInArrow(_writer(folder, path, end), FILES), "token-files")
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_file(path: str) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Blocks of one file: doc_ids and the ids of each."""
    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(base, compression=None) as f:
        if f.read(4) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        _, n = struct.unpack("<II", f.read(8))
        ranked = np.frombuffer(f.read(4 * n), "<u4")
        while head := f.read(20):
            docs, ids, size = struct.unpack("<IQQ", head)
            doc, none = np.frombuffer(f.read(8 * docs), "<i8").tolist(), f.read(docs)
            ends = np.cumsum(np.frombuffer(f.read(4 * docs), "<u4").astype(np.int64))
            control = f.read(-(-ids // 4))
            a = ranked[unpack_ranks(control, f.read(size), ids)]
            yield [None if z else d for d, z in zip(doc, none, strict=True)], np.split(a, ends[:-1])


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, parts in read_file(path):
                    size = np.array([len(x) for x in parts], np.int64)
                    begin = start + np.cumsum(size) - size
                    start += int(size.sum())
                    columns = [pa.array(docs, pa.int64()), pa.array(begin), pa.array(size), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return read


def read_tokens(files: DataFrame, ids: bool = False) -> DataFrame:
    """One row for each document of the files (path, start): doc_id, start, n_tokens, ids_crc32 (and ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    # a task for each file, however few bytes the list itself has
    return files.select("path", "start").repartition(max(1, files.count()), "path").mapInArrow(_reader(ids), schema)
