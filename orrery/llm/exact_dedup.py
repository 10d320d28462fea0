"""Exact dedup by content-defined chunk recipes (operator 10).

A text's bytes are cut where a rolling hash of the last 48 bytes meets a mask, so equal stretches are
cut alike wherever they stand.  Each chunk gets a 128-bit digest; the chunk store keeps each
distinct (digest, bytes) once, pre-aggregated in the map task, and so proves by bytes that a digest
stands for one content.  A text's recipe is its ordered list of chunk identifiers.  From there on only
recipes travel: long texts are neither moved nor compared again.  Should two chunks ever share a
digest, texts are grouped by their bytes instead.

Defined results: null text equals the empty text; of rows with equal text and equal doc_id one stays;
a null doc_id is the smallest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import powers, text_blocks
from orrery.plans.scratch import written

WINDOW, LEAST, MOST, MASK_BITS = 48, 1024, 65536, 12
REMEMBER = 4096

SCHEMA = "is_chunk boolean, doc_id long, row long, text_sha256 string, recipe binary, digest binary, bytes binary"


def cuts(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, by content; the last is the text's length."""
    n = len(raw)
    if n <= LEAST:
        return [n]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(raw * up[:n], out=total[1:])
    rolled = (total[WINDOW:] - total[:-WINDOW]) * down[: n + 1 - WINDOW]
    found = np.flatnonzero((rolled * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - MASK_BITS) == 0) + WINDOW
    ends, last = [], 0
    for at in found.tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST and at < n:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, bytes] = {}
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    schema = pa.schema([("is_chunk", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary()), ("digest", pa.binary()), ("bytes", pa.binary())])
    for batch in batches:
        ids = batch.column(0).cast(pa.int64()).to_pylist()
        for i, j, raw, offs in text_blocks(batch.column(1), 4 << 20):
            out = []
            for d in range(j - i):
                one = raw[offs[d] : offs[d + 1]]
                whole, recipe, at = one.tobytes(), [], 0
                for end in cuts(one):
                    part = whole[at:end]
                    at = end
                    digest = hashlib.blake2b(part, digest_size=16).digest()
                    recipe.append(digest)
                    if seen.get(digest) != part:
                        if len(seen) >= REMEMBER:
                            seen.clear()
                        seen[digest] = part
                        out.append((True, None, None, None, None, digest, part))
                out.append((False, ids[i + d], row, hashlib.sha256(whole).hexdigest(), b"".join(recipe), None, None))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    both = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_recipes, SCHEMA)
    both = written(both, "recipes")
    rows = both.where(~F.col("is_chunk")).select("doc_id", "row", "text_sha256", "recipe")
    store = both.where("is_chunk").groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    shared = store.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    if shared.take(1):
        return _by_bytes(docs)
    group = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(group, "recipe").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")


def _by_bytes(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), text.alias("text"), F.sha2(text, 256).alias("text_sha256")), "rows")
    group = rows.groupBy("text").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(group, "text").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")
