"""A corpus from raw documents to token files, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.

Rows: a document that a stage keeps goes on as it is.  Language ID rejects documents in which it finds no
language (null, no letter) or is unsure (score below ``SURE``).  Of each component of the Jaccard
join one row stays, the one with the smallest doc_id (rows without one come after all others, and of rows that share a doc_id the
first read stays); documents without words are alone in theirs.  A row whose text holds a benchmark item goes, with or without a doc_id.
The mix takes a document not at all, once or twice, whole, and orders documents by training position; the token files are in doc_id order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontamination, jaccard, langid, mixing, tokens
from orrery.plans.scratch import small, written
from orrery.plans.ship import shipped

SURE = 0.35
SMALL = 1_000_000


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the classifier knows."""
    model = langid.train(docs, held_out=None)
    told = langid.identify(docs, model, F.struct(*docs.columns).alias("document"))
    return told.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= SURE)).select("document.*")


@shipped
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    rows = jaccard.jaccard_rows(docs)
    keys = rows.groupBy("doc_id", "mark").agg(F.sum(F.col("first").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n"))
    keys = written(keys.where("kept < n").select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "kept"), "not-first")

    def joined(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return left.join(small(keys, SMALL), left["doc_id"].eqNullSafe(keys["id"]) & (left["mark"] == keys["of"]), how)

    packed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.struct(*docs.columns).alias("document"))
    out = joined(packed, keys.where("kept = 0"), "left_anti")
    # rows that share doc_id and text, of which one is first
    repeated = keys.where("kept > 0")
    if not repeated.take(1):
        return out.select("document.*")
    told = joined(out, repeated, "left")
    one = told.where("kept > 0").groupBy("doc_id", "mark").agg(F.min_by("document", F.xxhash64(F.col("document").cast("string"))).alias("document"))
    return told.where("kept is null").select("document").union(one.select("document")).select("document.*")


@shipped
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shipped
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


@shipped
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and read each document's entry back from them."""
    return tokens.read_tokens(tokens.write_tokens(docs))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontaminate), ("mixing to target weights", mix), ("token files", token_files)]

#: Language ID is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
