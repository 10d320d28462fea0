"""Line dedup by content-defined line chunks (operator 7, native).

A text's lines are hashed, and a rolling hash goes over each line's hash and the next one's.  Where it meets a
mask a chunk begins with the first of the two; at the first place from there on where it meets another mask the chunk ends
with the second.  Both borders thus come from lines inside the chunk, and a passage has the same chunks wherever it stands.
A chunk has two lines at least and ``MOST`` at most; the text's end is a border too.  There are ``CHUNKINGS`` pairs of
masks, each met by ``MET`` in ``OF`` places, and chunks may overlap: so even passages of two or three lines
mostly have a chunk of their own.

Chunks that occur more than once in the corpus are compared by their bytes; of equal ones the first (by doc_id, then
row and place) stays, and the lines of the others are removed.  Every line that goes equals a line before it that stands
at the same place of an equal chunk, so some copy of it stays.

Only DataFrame functions are used.  The hashes alone are counted first.  The texts of chunks with a repeated hash are
grouped where they are before they move, so a chunk that every document has moves once for each task, and occurrences meet
the first one by hash, without their texts.

Defined results: null text stays null, with 0 lines; the empty text is one empty line; a text whose
lines all go is empty; chunks of white space alone stay; blank lines count as lines; of repeated rows
the first stays whole; null doc_ids come first; a line that follows itself many times may be left once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.scratch import passing, small, written

CHUNKINGS, MET, OF, MOST = 2, 2, 3, 8
SMALL = 1_000_000


def _chunks(chunking: int) -> tuple[Column, Column]:
    """array<struct<start, lines, hash>> of ``h``, the hashes of a text's lines, by one pair of masks; and ``ends``, where the second is met."""
    pairs = F.sequence(F.lit(1), F.size("h") - 1)

    def met(mask: int, i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(mask), F.get("h", i - 1), F.get("h", i)), F.lit(OF)) < MET

    found = F.filter(pairs, lambda i: met(2 * chunking, i))
    # the place of the first end among the next pairs; 0 where there is none
    end = lambda i: F.array_position(F.slice("ends", i, F.lit(MOST - 1)), True)
    size = lambda i: F.when(end(i) > 0, end(i) + 1).otherwise(F.least(F.lit(MOST), F.size("h") - i + 1)).cast("int")
    sized = F.transform(found, lambda i: F.struct(i.alias("start"), size(i).alias("lines")))
    chunks = F.transform(sized, lambda c: F.struct(c["start"].alias("start"), c["lines"].alias("lines"), F.xxhash64(F.slice("h", c["start"], c["lines"])).alias("hash")))
    return chunks, F.transform(pairs, lambda i: met(2 * chunking + 1, i))


def chunked(docs: DataFrame) -> DataFrame:
    """(row, doc_id, is_null, lines array<string>, chunks array<struct<start, lines, hash>>), a row for each of ``docs``."""
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").isNull().alias("is_null"), F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("lines"))
    # explode() of one element keeps an array a column that is computed once
    at = lines.select("*", F.explode(F.array(F.transform("lines", lambda x: F.xxhash64(x)))).alias("h"))
    every = []
    for k in range(CHUNKINGS):
        chunks, ends = _chunks(k)
        at = at.select("*", F.explode(F.array(F.when(F.size("h") > 1, ends).otherwise(F.array().cast("array<boolean>")))).alias("ends"))
        at = at.select("*", F.explode(F.array(F.when(F.size("h") > 1, chunks).otherwise(F.array().cast("array<struct<start:int,lines:int,hash:bigint>>")))).alias(f"chunks{k}")).drop("ends")
        every.append(f"chunks{k}")
    return at.select("row", "doc_id", "is_null", "lines", F.array_distinct(F.concat(*every)).alias("chunks"))


def _first(texts: DataFrame) -> DataFrame:
    """(hash, chunk, first, n) of texts (hash, chunk, doc_id, row, start)."""
    return texts.groupBy("hash", "chunk").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed_lines, removed_chunks, text) for each row of ``docs`` (doc_id, text)."""
    rows = written(chunked(docs), "chunks")
    keep: list[DataFrame] = []
    with passing(keep):
        flat = rows.select("row", "doc_id", F.explode("chunks").alias("c")).select("row", "doc_id", "c.start", "c.lines", "c.hash")
        repeated = written(flat.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
        some = written(flat.join(small(repeated, SMALL), "hash", "left_semi"), "repeated-chunks")
        wanted = written(some.groupBy("row").agg(F.collect_list(F.struct("start", "lines", "hash")).alias("wanted")), "wanted")
        texts = rows.select("row", "doc_id", F.col("lines").alias("every")).join(small(wanted, SMALL, F.size("wanted")), "row")
        texts = texts.select("row", "doc_id", "every", F.explode("wanted").alias("c"))
        texts = texts.select("row", "doc_id", "c.start", "c.lines", "c.hash", F.array_join(F.slice("every", F.col("c.start"), F.col("c.lines")), "\n").alias("chunk")).where(F.col("chunk").rlike("\\S"))
        first = written(_first(texts), "firsts")
        several = written(first.groupBy("hash").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("hash"), "several")
        one = first.where("n > 1").select("hash", "first")
        gone = None
        if several.take(1):  # chunks that share a hash are told apart by their bytes
            one = one.join(several, "hash", "left_anti")
            gone = texts.join(several, "hash", "left_semi").join(first.where("n > 1").select("hash", "chunk", "first"), ["hash", "chunk"]).select("row", "start", "lines", "first")
        found = some.join(small(one, SMALL), "hash").select("row", "start", "lines", "first")
        gone = (found if gone is None else found.union(gone)).where("row != first.row or start != first.start")
        places = F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("lines") - 1))))
        keep.append(written(gone.groupBy("row").agg(places.alias("gone"), F.count(F.lit(1)).alias("removed_chunks")), "gone"))
    gone = keep[0]
    out = rows.drop("chunks").join(small(gone, SMALL, F.size("gone") + 1), "row", "left")
    stays = F.transform(F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone"), lambda k: F.element_at("lines", k))
    text = F.when(~F.col("is_null"), F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stays), "\n"))
    lines = F.when(F.col("is_null"), F.lit(0)).otherwise(F.size("lines"))
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return out.select("doc_id", lines.cast("long").alias("n_lines"), removed.cast("long").alias("removed_lines"), F.coalesce("removed_chunks", F.lit(0)).cast("long").alias("removed_chunks"), text.alias("text"))
