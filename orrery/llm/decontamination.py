"""Benchmark decontamination by size-partitioned MinHash containment search (operator 8, native).

Items are short and documents may be long, so resemblance says nothing; what counts is containment, the
share of an item's word shingles that a document has.  Items are partitioned by size, a power of two to the
next.  A partition's largest size n gives the sketch size s = n - ceil(t n) + 1, its smallest size
the least number of shingles a document needs, and the largest hash of its sketches a limit.  An item's sketch is
its s smallest shingle hashes (all, if it has no more).  A document that has a share t of an item's shingles lacks at most
s - 1 of them, so it holds one of the sketch: the search loses nothing.  Documents probe the partitions whose
least size they have; of their shingles only those below the limit of one of these go on to the join.

Pairs found are verified on the words themselves: the item's distinct shingles that the document has are
counted as strings, not as hashes.

Only DataFrame functions are used.  The sketches are broadcast only if a count shows them below
``SMALL`` rows; else the join is left to Spark.  The partitions are at most one for each power of two.

Words are lowered as Unicode has it.

Defined results: null text has no shingle; an item of fewer than ``k`` words has none and is never found, as so
short a run proves nothing; repeated item ids or doc_ids count as one item or document with all their shingles; rows with null
doc_id or item_id are left out of ``contained_items``, while ``clean_documents`` decides each row by its own text, whatever its
doc_id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans.scratch import small, written

K = 5
SHARE = 0.8
SMALL = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def word_rows(df: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, w): the words of each text that has ``k`` of them."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    # explode() of one element keeps the words a column that is computed once
    return df.where(F.col(key).isNotNull()).select(key, F.explode(F.array(words)).alias("w")).where(F.size("w") >= k)


def runs(f, k: int) -> Column:
    """``f`` of the words of each run, in order."""
    return F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: f(*(F.get("w", i + j) for j in range(k))))


def shingle_text(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def item_shingles(items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, run, shingle, n): the distinct shingles of each item, with their hashes and number."""
    each = word_rows(items, "item_id", k).select("item_id", F.explode(runs(lambda *w: F.struct(shingle_text(*w).alias("run"), F.xxhash64(*w).alias("shingle")), k)).alias("s"))
    n = F.count(F.lit(1)).over(W.partitionBy("item_id"))
    return each.select("item_id", "s.run", "s.shingle").distinct().withColumn("n", n.cast("int"))


def needed(n: Column, share: float) -> Column:
    """How many of ``n`` shingles are a share of ``share``."""
    return F.ceil(F.round(F.lit(share) * n, 6)).cast("int")


def item_sketches(shingles: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, partition, least, shingle): the sketch of each item, by the size of its partition."""
    partition = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")
    most = (F.pow(F.lit(2.0), F.col("partition") + 1) - 1).cast("int")
    least = needed(F.pow(F.lit(2.0), F.col("partition")).cast("int"), share)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("shingle", "run"))
    sized = shingles.withColumn("partition", partition).withColumn("rank", rank)
    return sized.where(F.col("rank") <= most - needed(most, share) + 1).select("item_id", "partition", least.alias("least"), "shingle").distinct()


def candidates(docs: DataFrame, key: str, sketch: DataFrame, k: int = K) -> DataFrame:
    """(key, item_id): documents that hold a shingle of an item's sketch and have the size for its partition."""
    limits = sketch.groupBy("partition").agg(F.first("least").alias("least"), F.max("shingle").alias("limit")).collect()
    words, runs_of = word_rows(docs, key, k), F.size("w") - (k - 1)
    # the largest limit of the partitions that a document of this size probes
    limit = F.greatest(*(F.when(runs_of >= r["least"], F.lit(r["limit"])) for r in limits), F.lit(None).cast("long")) if limits else F.lit(None).cast("long")
    sized = words.select(key, "w", runs_of.alias("size"), limit.alias("limit")).where("limit is not null")
    each = sized.select(key, "size", "limit", F.explode(runs(F.xxhash64, k)).alias("shingle")).where("shingle <= limit")
    hits = each.join(small(sketch, SMALL), "shingle").where("size >= least")
    return hits.select(key, "item_id").distinct()


def contained(docs: DataFrame, key: str, items: DataFrame, share: float = SHARE, k: int = K) -> DataFrame:
    """(key, item_id, n, n_found) of each pair with containment of ``share`` or more."""
    known = written(item_shingles(items, k), "items")
    pairs = written(candidates(docs, key, written(item_sketches(known, share), "sketches"), k), "candidates")
    found = docs.join(small(pairs.select(key).distinct(), SMALL), key, "left_semi")
    # an item's shingles at its candidates, and those that the document has
    parts = word_rows(found, key, k).select(key, F.explode(runs(shingle_text, k)).alias("run")).join(small(known.select("run").distinct(), SMALL), "run", "left_semi").distinct()
    common = pairs.join(small(known.select("item_id", "run", "n"), SMALL), "item_id").join(parts, [key, "run"], "left_semi")
    return common.groupBy(key, "item_id", "n").agg(F.count(F.lit(1)).alias("n_found")).where(F.col("n_found") >= needed(F.col("n"), share))


def contained_items(docs: DataFrame, items: DataFrame, share: float = SHARE, k: int = K) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of each pair with containment of ``share`` or more."""
    counted = contained(docs.select("doc_id", "text"), "doc_id", items, share, k)
    return counted.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_found", F.round(F.col("n_found") / F.col("n"), 6).alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, share: float = SHARE, k: int = K) -> DataFrame:
    """The rows of ``docs`` whose texts hold no item; columns as they are."""
    mark = F.md5("text")
    bad = contained(docs.select(mark.alias("mark"), "text"), "mark", items, share, k).select("mark").distinct()
    bad = small(written(bad, "contaminated"), SMALL)
    packed = docs.select(F.struct(*docs.columns).alias("document"), mark.alias("mark"))
    return packed.join(bad, "mark", "left_anti").select("document.*")
