"""Byte strings in chunks of a page, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk (a fixed value of the page layout).
CHUNK = 8172


def split(blobs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, payload) to (id, seq, chunk); an empty or null payload has no chunk."""
    n = F.ceil(F.octet_length("payload") / size).cast("int")
    seq = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    rows = blobs.select("id", F.col("payload").cast("binary").alias("payload"), F.explode(seq).alias("seq"))
    return rows.select("id", "seq", F.substring("payload", F.col("seq") * size + 1, F.lit(size)).alias("chunk"))


def join(chunks: DataFrame) -> DataFrame:
    """(id, payload) from chunks in any order; a missing chunk gives null."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    packed = chunks.groupBy("id").agg(parts.alias("parts"))
    whole = F.element_at("parts", -1)["seq"] == F.size("parts") - 1
    # joined as one string of hex digits: a fold would copy the blob once for each chunk
    data = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["chunk"])), ""))
    return packed.select("id", F.when(whole, data).alias("payload"))


def prefix(chunks: DataFrame, length: int, size: int = CHUNK) -> DataFrame:
    """(id, payload): the first ``length`` bytes of each blob (all, if it has fewer); chunks beyond them are not read."""
    some = join(chunks.where(F.col("seq") * size < length))
    return some.select("id", F.substring("payload", 1, length).alias("payload"))
