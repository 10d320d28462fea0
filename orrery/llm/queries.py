"""The queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontamination, exact_dedup, html, jaccard, langid, line_dedup, mixing, passages, tokens, warc
from orrery.llm import pipeline as stages


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return langid.identify(docs, langid.train(docs), "doc_id", held_out)


def op2_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontamination.contained_items(docs, items)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_shared_passages, op3_html_text, op4_mix_curriculum, op5_token_files, op6_jaccard_components, op7_line_chunks, op8_decontaminate, op9_warc_round_trip, op10_exact_dedup, pipeline)}

SQL = {
    "op6_jaccard_components": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i : i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
  UNION ALL SELECT doc_id, w FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(s) AS n FROM (SELECT doc_id FROM documents) LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, root FROM r JOIN links ON r.doc_id = links.a)
SELECT doc_id, n AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op8_decontaminate": """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, w[i : i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
its AS (SELECT DISTINCT item_id, w[i : i + 4] AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, n_found, round(n_found / n, 6) AS containment FROM c JOIN n USING (item_id) WHERE n_found >= ceil(round(0.8::DOUBLE * n, 6))""",
    "op9_warc_round_trip": """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_mix_curriculum": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    coalesce((abs(doc_id % 2147483647) * 1103515245 + 12345) % 2147483648, 0) AS k FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER w AS place, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST), b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rest AS (SELECT min_by(level, place) AS level FROM levels WHERE cap / weight > level),
goals AS (
  SELECT source, source_size, kind, CASE WHEN r.level IS NULL OR cap <= r.level * weight THEN cap ELSE r.level * weight END AS target FROM levels LEFT JOIN rest r ON TRUE),
placed AS (
  SELECT d.*, g.source_size, g.kind, g.target, floor(g.target)::BIGINT AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
used AS (SELECT *, greatest(0, least(size, goal - off)) + greatest(0, least(size, goal - off - source_size)) AS taken, off / target AS u FROM placed)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN round(CASE kind
    WHEN 0 THEN CASE WHEN u * 5 < 2.75 THEN least(0.5, 2 * (u * 5) / (6 + sqrt(36 - 4 * (u * 5)))) ELSE least(1, 0.5 + 2 * (u * 5 - 2.75) / (5 + sqrt(25 - 4 * (u * 5 - 2.75)))) END
    WHEN 1 THEN least(1, 2 * (u * 2) / (1 + sqrt(1 + 4 * (u * 2))))
    ELSE CASE WHEN u < 0.375 THEN least(0.5, 2 * u / (0.5 + sqrt(0.25 + 2 * u))) ELSE least(1, 0.5 + 2 * (u - 0.375) / (1 + sqrt(1 + 2 * (u - 0.375)))) END END, 9) END AS position
FROM used""",
}
