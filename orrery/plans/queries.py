"""Registered queries over the shared tables, one for each operator, and the same in SQL.

Vectors are ``embedding * (1 + label)`` in double: the raw ones have unit length, so that all metrics would
rank them alike.  ``deleted`` are the vec_ids divisible by 7.  Batch searches ask for every vec_id divisible by
20, against all rows.  Centroids, where a query does not train them, are the first ``NLIST`` vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import distance as D
from orrery.operators import evaluate, flat, ivf, metadata, records, topk
from orrery.plans.scratch import new_dir, written
from orrery.sources import blobs, changelog
from orrery.streaming import ingest

DIM, K, NLIST, NPROBE = 64, 10, 16, 14
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _emb(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label")))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", scaled.alias("embedding"))


def _query(spark: SparkSession, d: str) -> list[float]:
    return _emb(spark, d).where("vec_id = 0").first().embedding


def _asked(emb: DataFrame) -> DataFrame:
    return emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _gone(emb: DataFrame) -> DataFrame:
    return emb.where("vec_id % 7 = 0").select("vec_id")


def _meta(emb: DataFrame) -> DataFrame:
    text = F.concat(F.lit('{"category": "c'), F.col("label").cast("string"), F.lit('"}'))
    return emb.select("vec_id", text.alias("metadata"))


def _r(c: str = "distance") -> F.Column:
    return F.round(c, 6).alias(c)


# SQL pieces ---------------------------------------------------------------------------------------------

E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * (1 + label)) AS v FROM embeddings)"
Q = "q AS (SELECT v AS u FROM e WHERE vec_id = 0)"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, {DIM} + 1), lambda i: {a}[i] * {b}[i]))"


def _dist(name: str, a: str, b: str) -> str:
    if name == "l2":
        return f"list_sum(list_transform(range(1, {DIM} + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
    if name == "inner_product":
        return f"(0 - {_dot(a, b)})"
    both = f"(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"
    return f"(CASE WHEN {both} < 1e-12 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_dot(a, b)} / {both})) END)"


def _nearest_sql(name: str, rows: str = "e", k: int = K) -> str:
    return f"SELECT row_number() OVER (ORDER BY distance, vec_id)::INT AS rank, vec_id, round(distance, 6) AS distance FROM (SELECT vec_id, {_dist(name, 'v', 'u')} AS distance FROM {rows}, q ORDER BY distance, vec_id LIMIT {k})"


def _ranked_sql(pairs: str, k: int = K) -> str:
    return f"SELECT query_id, rank::INT AS rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM ({pairs})) WHERE rank <= {k}"


ASKED = "a AS (SELECT vec_id AS query_id, v AS u FROM e WHERE vec_id % 20 = 0)"
CENTROIDS = f"c AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cid, v AS m FROM (SELECT * FROM e ORDER BY vec_id LIMIT {NLIST}))"


def _assign_sql(name: str = "l2", cells: str = "c", rows: str = "e") -> str:
    return f"SELECT vec_id, label, v, arg_min(cid, (d, cid)) AS cid FROM (SELECT vec_id, label, v, cid, {_dist(name, 'v', 'm')} AS d FROM {rows}, {cells}) GROUP BY vec_id, label, v"


def _probe_sql(name: str, nprobe: int) -> str:
    return f"SELECT query_id, u, cid, rank, d FROM (SELECT query_id, u, cid, d, row_number() OVER (PARTITION BY query_id ORDER BY d, cid) AS rank FROM (SELECT query_id, u, cid, {_dist(name, 'u', 'm')} AS d FROM a, c)) WHERE rank <= {nprobe}"


def _ivf_sql(name: str, nprobe: int = NPROBE, where: str = "TRUE", k: int = K) -> str:
    pairs = f"SELECT query_id, vec_id, {_dist(name, 'v', 'u')} AS distance FROM cells JOIN probed USING (cid) WHERE {where}"
    return f"WITH {E}, {ASKED}, {CENTROIDS}, cells AS ({_assign_sql(name)}), probed AS ({_probe_sql(name, nprobe)}) {_ranked_sql(pairs, k)}"


# distances ----------------------------------------------------------------------------------------------


def _distance_query(name: str, sql_name: str, f, sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _emb(spark, d).select("vec_id", F.round(f(F.col("embedding"), D.vector(_query(spark, d))), 6).alias("distance"))

    QUERIES[name] = query
    SQL[name] = f"WITH {E}, {Q} SELECT vec_id, round({sql}, 6) AS distance FROM e, q"


_distance_query("dist_l2_sq", "l2", D.l2_sq, _dist("l2", "v", "u"))
_distance_query("dist_l2", "l2", D.l2, f"sqrt({_dist('l2', 'v', 'u')})")
_distance_query("dist_cosine", "cosine", D.cosine, _dist("cosine", "v", "u"))
_distance_query("dist_inner_product", "inner_product", D.inner_product, _dist("inner_product", "v", "u"))


@_registered(f"WITH {E} SELECT vec_id, round(sqrt({_dot('v', 'v')}), 6) AS norm FROM e")
def vec_norm(spark, d):
    return _emb(spark, d).select("vec_id", F.round(D.norm(F.col("embedding")), 6).alias("norm"))


@_registered(f"WITH {E} SELECT vec_id, (i - 1)::INT AS pos, round(v[i] / n, 6) AS x FROM (SELECT vec_id, v, sqrt({_dot('v', 'v')}) AS n, unnest(range(1, {DIM} + 1)) AS i FROM e)")
def vec_normalize(spark, d):
    rows = _emb(spark, d).select("vec_id", F.posexplode(D.normalize(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x", 6).alias("x"))


ZERO = f"list_transform(range({DIM}), lambda i: 0.0::DOUBLE)"


@_registered(f"WITH {E}, z AS (SELECT vec_id, CASE WHEN label < 5 THEN {ZERO} ELSE v END AS v FROM e), q AS (SELECT v AS u FROM e WHERE vec_id = 0) SELECT vec_id, round({_dist('cosine', 'v', 'u')}, 6) AS distance, {_dist('cosine', 'v', ZERO)} AS to_zero FROM z, q")
def cosine_zero_vector(spark, d):
    some = F.when(F.col("label") < 5, D.vector([0.0] * DIM)).otherwise(F.col("embedding"))
    rows = _emb(spark, d).select("vec_id", some.alias("v"))
    return rows.select("vec_id", F.round(D.cosine(F.col("v"), D.vector(_query(spark, d))), 6).alias("distance"), D.cosine(F.col("v"), D.vector([0.0] * DIM)).alias("to_zero"))


# exact search -------------------------------------------------------------------------------------------


def _flat(spark: SparkSession, d: str, name: str = "l2") -> flat.FlatIndex:
    return flat.FlatIndex.create(_emb(spark, d), DIM, name)


def _flat_query(name: str, metric: str) -> None:
    QUERIES[name] = lambda spark, d: _flat(spark, d, metric).search(_query(spark, d), K).select("rank", "vec_id", _r())
    SQL[name] = f"WITH {E}, {Q} {_nearest_sql(metric)}"


_flat_query("flat_knn_l2", "l2")
_flat_query("flat_knn_cosine", "cosine")
_flat_query("flat_knn_ip", "inner_product")


def _batch_query(name: str, metric: str, search) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        emb = _emb(spark, d)
        return search(emb, _asked(emb), K, metric).select("query_id", "rank", "vec_id", _r())

    QUERIES[name] = query
    SQL[name] = f"WITH {E}, {ASKED} " + _ranked_sql(f"SELECT query_id, vec_id, {_dist(metric, 'v', 'u')} AS distance FROM e, a")


_batch_query("flat_knn_batch", "l2", topk.nearest_batch)
_batch_query("flat_knn_batch_cosine", "cosine", topk.nearest_batch)
_batch_query("flat_knn_batch_ip", "inner_product", topk.nearest_batch)
_batch_query("flat_knn_batch_expressions", "l2", topk.nearest_pairs)


@_registered(f"WITH {E}, {Q} {_nearest_sql('l2', k=1_000_000)}")
def flat_knn_k_exceeds(spark, d):
    return _flat(spark, d).search(_query(spark, d), 1_000_000).select("rank", "vec_id", _r())


@_registered(f"WITH {E}, {Q} SELECT 0::INT AS rank, 0::BIGINT AS vec_id, 0.0::DOUBLE AS distance FROM e WHERE FALSE")
def flat_knn_k_zero(spark, d):
    return _flat(spark, d).search(_query(spark, d), 0).select("rank", "vec_id", _r())


@_registered(f"WITH {E}, {Q} SELECT round(max(distance), 6) AS threshold FROM (SELECT {_dist('l2', 'v', 'u')} AS distance FROM e, q ORDER BY distance LIMIT {K})")
def flat_topk_threshold(spark, d):
    return topk.threshold(_flat(spark, d).search(_query(spark, d), K)).select(_r("threshold"))


@_registered(f"WITH {E}, {Q} " + _nearest_sql("l2"))
def flat_insert(spark, d):
    """Inserted one vector, many and none, after a third of all."""
    emb = _emb(spark, d)
    index = flat.FlatIndex.create(emb.where("vec_id % 3 = 0"), DIM).insert(emb.where("vec_id = 1"))
    index = index.insert(emb.where("vec_id % 3 <> 0 and vec_id <> 1")).insert(emb.where("false"))
    return index.search(_query(spark, d), K).select("rank", "vec_id", _r())


@_registered("SELECT count(*) AS live, count(*) + (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 2 <> 0) AS stored FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 2 = 0")
def flat_insert_counts(spark, d):
    index = _flat(spark, d)
    gone = _gone(index.vectors)
    back = index.vectors.join(gone.where("vec_id % 2 = 0"), "vec_id")
    index = index.delete(gone)[0].insert(back.select(*index.vectors.columns))
    live, stored = index.live().agg(F.count(F.lit(1)).alias("live")), index.vectors.agg(F.count(F.lit(1)).alias("stored"))
    return live.join(F.broadcast(stored))


@_registered(f"WITH {E}, {Q}, r AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN list_transform(v, lambda x: x * 3) ELSE v END AS v FROM e) " + _nearest_sql("l2", "r"))
def flat_insert_after_delete(spark, d):
    """Deleted ids come back with other vectors, which alone are found."""
    index = _flat(spark, d)
    gone = _gone(index.vectors)
    new = index.vectors.join(gone, "vec_id").withColumn("embedding", F.transform("embedding", lambda x: x * 3)).select(*index.vectors.columns)
    return index.delete(gone)[0].insert(new).search(_query(spark, d), K).select("rank", "vec_id", _r())


@_registered(f"WITH {E}, {ASKED} " + _ranked_sql(f"SELECT query_id, vec_id, {_dist('l2', 'v', 'u')} AS distance FROM e, a WHERE vec_id % 7 <> 0"))
def flat_prepared(spark, d):
    """Several searches of one kept index; released when their results are written."""
    index = _flat(spark, d)
    kept = index.delete(_gone(index.vectors))[0].prepared()
    found = written(kept.search_batch(_asked(_emb(spark, d)), K), "found")
    kept.release()
    return found.select("query_id", "rank", "vec_id", _r())


# filters and metadata -----------------------------------------------------------------------------------


@_registered(f"WITH {E}, {Q} " + _nearest_sql("l2", "(SELECT * FROM e WHERE label = 3)"))
def flat_knn_filter_label(spark, d):
    return _flat(spark, d).search(_query(spark, d), K, F.col("label") == 3).select("rank", "vec_id", _r())


@_registered(f"WITH {E}, {Q} " + _nearest_sql("l2", "(SELECT * FROM e WHERE label = 5 AND vec_id % 2 = 0)"))
def flat_knn_filter_metadata(spark, d):
    emb = _emb(spark, d)
    rows = metadata.with_metadata(emb, _meta(emb.where("vec_id % 2 = 0")))
    index = flat.FlatIndex.create(rows, DIM)
    return index.search(_query(spark, d), K, metadata.contains('"c5"') & metadata.field_is("$.category", "c5")).select("rank", "vec_id", _r())


M = """m AS (SELECT vec_id, '{"category": "c' || label || '"}' AS metadata FROM embeddings)"""


@_registered(f"WITH {M} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'second ' || vec_id ELSE metadata END AS metadata FROM m WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def meta_upsert(spark, d):
    emb = _emb(spark, d)
    ids = emb.where("vec_id % 3 = 0").select("vec_id")
    text = lambda word: F.concat(F.lit(word), F.col("vec_id").cast("string")).alias("metadata")
    changes = ids.select("vec_id", text("first "), F.lit(1).alias("version")).union(ids.select("vec_id", text("second "), F.lit(2)))
    return metadata.upsert(_meta(emb.where("vec_id % 2 = 0")), changes)


@_registered(f"WITH {M} SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN metadata END AS metadata FROM m WHERE vec_id % 5 = 0")
def meta_get(spark, d):
    emb = _emb(spark, d)
    return metadata.lookup(emb.where("vec_id % 5 = 0"), _meta(emb.where("vec_id % 2 = 0")))


@_registered(f"WITH {M} SELECT vec_id, metadata FROM m WHERE vec_id % 7 <> 0")
def meta_delete(spark, d):
    emb = _emb(spark, d)
    return metadata.remove(_meta(emb), _gone(emb))


@_registered("SELECT vec_id, vec_id % 7 <> 0 AS removed FROM embeddings")
def meta_delete_status(spark, d):
    emb = _emb(spark, d)
    return metadata.remove_status(metadata.remove(_meta(emb), _gone(emb)), emb)


@_registered("SELECT 0::BIGINT AS vec_id, '' AS metadata FROM embeddings WHERE FALSE")
def meta_load_absent(spark, d):
    return metadata.load(spark, new_dir(spark, "absent"))


@_registered(f"WITH {M} SELECT vec_id, metadata FROM m WHERE vec_id % 7 = 0")
def meta_orphans(spark, d):
    emb = _emb(spark, d)
    index, _ = flat.FlatIndex.create(emb, DIM).delete(_gone(emb))
    return metadata.orphans(_meta(emb), index.live())


@_registered(f"WITH {M} SELECT vec_id, metadata FROM m")
def meta_save_load(spark, d):
    path = new_dir(spark, "metadata")
    metadata.save(_meta(_emb(spark, d)), path)
    return metadata.load(spark, path)


# deletes and compaction ---------------------------------------------------------------------------------


@_registered(f"WITH {E}, {Q} " + _nearest_sql("l2", "(SELECT * FROM e WHERE vec_id % 7 <> 0)"))
def flat_knn_after_delete(spark, d):
    index = _flat(spark, d)
    index, _ = index.delete(_gone(index.vectors))
    return index.search(_query(spark, d), K).select("rank", "vec_id", _r())


@_registered("SELECT vec_id, vec_id % 7 <> 0 AS deleted FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id + 1000000000, FALSE FROM embeddings WHERE vec_id % 2 = 0")
def delete_status(spark, d):
    index = _flat(spark, d)
    index, _ = index.delete(_gone(index.vectors))
    even = index.vectors.where("vec_id % 2 = 0").select("vec_id")
    return index.delete(even.union(even.select(F.col("vec_id") + 1_000_000_000)))[1]


@_registered(f"WITH {E} SELECT vec_id, round({_dot('v', 'v')}, 6) AS square FROM e WHERE vec_id % 3 = 0")
def vector_get(spark, d):
    index = _flat(spark, d)
    index, _ = index.delete(_gone(index.vectors))
    found = index.get(index.vectors.where("vec_id % 3 = 0"))
    return found.select("vec_id", F.round(D.dot(F.col("embedding"), F.col("embedding")), 6).alias("square"))


@_registered("SELECT vec_id, vec_id % 7 = 0 AS is_deleted FROM embeddings UNION ALL SELECT vec_id + 1000000000, TRUE FROM embeddings")
def is_deleted(spark, d):
    index = _flat(spark, d)
    index, _ = index.delete(_gone(index.vectors))
    every = index.vectors.select("vec_id")
    return index.is_deleted(every.union(every.select(F.col("vec_id") + 1_000_000_000)))


@_registered("SELECT count(*) AS n FROM embeddings WHERE vec_id % 7 <> 0")
def live_count(spark, d):
    index = _flat(spark, d)
    return index.delete(_gone(index.vectors))[0].live().agg(F.count(F.lit(1)).alias("n"))


@_registered("SELECT count(*) FILTER (vec_id % 7 = 0) AS reclaimed, count(*) FILTER (vec_id % 7 <> 0) AS live FROM embeddings")
def compact_reclaimed(spark, d):
    index = _flat(spark, d)
    index, reclaimed = index.delete(_gone(index.vectors))[0].compact()
    return index.vectors.agg(F.lit(reclaimed).cast("long").alias("reclaimed"), F.count(F.lit(1)).alias("live"))


P = f"p AS (SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 31)::BIGINT AS page, ((row_number() OVER (ORDER BY vec_id) - 1) % 31)::BIGINT AS slot FROM embeddings)"


@_registered(f"WITH {P} SELECT page, vec_id, (row_number() OVER (PARTITION BY page ORDER BY slot) - 1)::BIGINT AS slot FROM p WHERE vec_id % 7 <> 0")
def compact_addresses(spark, d):
    emb = _emb(spark, d)
    return records.compacted_slots(records.page_addresses(emb, DIM, 200), _gone(emb))


@_registered(f"WITH {P} SELECT vec_id, page, slot FROM p")
def page_address(spark, d):
    return records.page_addresses(_emb(spark, d), DIM, 200)


@_registered("SELECT DISTINCT p_size::INT AS dim, least(1024, 8044 // (4 * p_size))::BIGINT AS capacity FROM part WHERE p_size > 0")
def page_capacity(spark, d):
    sizes = spark.read.parquet(f"{d}/part.parquet").where("p_size > 0").select(F.col("p_size").cast("int").alias("dim")).distinct()
    return sizes.select("dim", records.page_capacity(F.col("dim")).alias("capacity"))


# cells --------------------------------------------------------------------------------------------------


def _ivf(spark: SparkSession, d: str, name: str = "l2", rounds: int = 0) -> ivf.IvfIndex:
    emb = _emb(spark, d)
    index = ivf.IvfIndex.create(spark, DIM, name, NLIST, NPROBE)
    return index.train(emb, ivf.first_vectors(emb, NLIST), rounds=rounds).insert(emb)


@_registered(f"WITH {E}, {CENTROIDS}, cells AS ({_assign_sql()}) SELECT vec_id, cid FROM cells")
def ivf_assign(spark, d):
    return _ivf(spark, d).vectors.select("vec_id", "cid")


@_registered(f"WITH {E}, {CENTROIDS}, cells AS ({_assign_sql()}) SELECT cid, count(*) AS n FROM cells GROUP BY cid")
def ivf_cell_sizes(spark, d):
    return _ivf(spark, d).vectors.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


@_registered(f"WITH {E}, {ASKED}, {CENTROIDS}, probed AS ({_probe_sql('l2', NPROBE)}) SELECT query_id, rank::INT AS rank, cid, round(d, 6) AS distance FROM probed")
def ivf_probe_cells(spark, d):
    return ivf.probes(_asked(_emb(spark, d)), _ivf(spark, d).centroid_table(), NPROBE).select("query_id", "rank", "cid", _r())


def _ivf_query(name: str, metric: str, nprobe: int = NPROBE) -> None:
    QUERIES[name] = lambda spark, d: _ivf(spark, d, metric).search_batch(_asked(_emb(spark, d)), K, nprobe=nprobe).select("query_id", "rank", "vec_id", _r())
    SQL[name] = _ivf_sql(metric, nprobe)


_ivf_query("ivf_knn_l2", "l2")
_ivf_query("ivf_knn_cosine", "cosine")
_ivf_query("ivf_knn_ip", "inner_product")
_ivf_query("ivf_full_probe", "l2", NLIST)


@_registered(_ivf_sql("l2", where="label < 4"))
def ivf_knn_filtered(spark, d):
    return _ivf(spark, d).search_batch(_asked(_emb(spark, d)), K, F.col("label") < 4).select("query_id", "rank", "vec_id", _r())


@_registered(_ivf_sql("l2", where="vec_id % 7 <> 0"))
def ivf_knn_after_delete(spark, d):
    index = _ivf(spark, d)
    index, _ = index.delete(_gone(index.vectors))
    return index.search_batch(_asked(_emb(spark, d)), K).select("query_id", "rank", "vec_id", _r())


@_registered(f"WITH {E}, {Q}, {ASKED}, {CENTROIDS}, cells AS ({_assign_sql()}), probed AS ({_probe_sql('l2', NPROBE)}) " + _nearest_sql("l2", "(SELECT * FROM cells WHERE cid IN (SELECT cid FROM probed WHERE query_id = 0))"))
def ivf_knn_single(spark, d):
    return _ivf(spark, d).search(_query(spark, d), K).select("rank", "vec_id", _r())


@_registered(f"WITH {E}, {CENTROIDS}, cells AS ({_assign_sql()}) SELECT cid, count(*) AS n, min(vec_id) AS least, max(vec_id) AS most FROM cells GROUP BY cid")
def ivf_insert_batch(spark, d):
    emb = _emb(spark, d)
    index = ivf.IvfIndex.create(spark, DIM, "l2", NLIST, NPROBE).train(emb, ivf.first_vectors(emb, NLIST), rounds=0)
    index = index.insert(emb.where("vec_id % 2 = 0")).insert(emb.where("vec_id % 2 <> 0")).insert(emb.where("false"))
    return index.vectors.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.max("vec_id").alias("most"))


@_registered(f"WITH {E}, {CENTROIDS}, cells AS ({_assign_sql()}) SELECT cid, count(*) AS live, (SELECT count(*) FROM e WHERE vec_id % 7 = 0) AS reclaimed FROM cells WHERE vec_id % 7 <> 0 GROUP BY cid")
def ivf_compact(spark, d):
    index = _ivf(spark, d)
    index, reclaimed = index.delete(_gone(index.vectors))[0].compact()
    return index.vectors.groupBy("cid").agg(F.count(F.lit(1)).alias("live"), F.lit(reclaimed).cast("long").alias("reclaimed"))


def _trained_query(name: str, metric: str) -> None:
    """Search over cells of two rounds of training, kept packed."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        emb = _emb(spark, d)
        kept = _ivf(spark, d, metric, rounds=2).prepared()
        found = written(kept.search_batch(_asked(emb), K, nprobe=TRAINED_NPROBE), "found")
        kept.release()
        return found.select("query_id", "rank", "vec_id", _r())

    QUERIES[name] = query
    pairs = f"SELECT query_id, vec_id, {_dist(metric, 'v', 'u')} AS distance FROM cells3 JOIN probed USING (cid)"
    probed = f"probed AS (SELECT query_id, u, cid FROM (SELECT query_id, u, cid, row_number() OVER (PARTITION BY query_id ORDER BY d, cid) AS rank FROM (SELECT query_id, u, cid, {_dist(metric, 'u', 'm')} AS d FROM a, c3)) WHERE rank <= {TRAINED_NPROBE})"
    SQL[name] = f"WITH {_round2(metric)}, {ASKED}, {probed} {_ranked_sql(pairs)}"


def _recall_query(name: str, metric: str) -> None:
    """Recall of that search against the exact one."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        emb = _emb(spark, d)
        found = QUERIES[f"ivf_trained_{metric}"](spark, d)
        row = evaluate.recall(found, topk.nearest_batch(emb, _asked(emb), K, metric))
        return row.select("*", (F.col("recall") >= 0.9).alias("enough"))

    QUERIES[name] = query
    exact = f"exact AS (SELECT query_id, vec_id FROM ({_ranked_sql(f'SELECT query_id, vec_id, {_dist(metric, chr(118), chr(117))} AS distance FROM e, a')}))"
    body = SQL[f"ivf_trained_{metric}"].replace("WITH ", "", 1)
    SQL[name] = f"WITH found AS (WITH {body}), {E}, {ASKED}, {exact}, hit AS (SELECT count(*) AS hits FROM found JOIN exact USING (query_id, vec_id)), n AS (SELECT count(*) AS expected FROM exact) SELECT hits, expected, round(hits / expected, 6) AS recall, hits / expected >= 0.9 AS enough FROM hit, n"


# training -----------------------------------------------------------------------------------------------

STEP = f"(SELECT cid, list(x ORDER BY i) AS m FROM (SELECT cid, i, avg(v[i]) AS x FROM (SELECT cid, v, unnest(range(1, {DIM} + 1)) AS i FROM {{cells}}) GROUP BY cid, i) GROUP BY cid)"
ROUND1 = f"{E}, {CENTROIDS}, cells AS ({_assign_sql()}), s1 AS {STEP.format(cells='cells')}"
#: An empty cell keeps its centroid.
NEXT = ", c2 AS (SELECT c.cid, coalesce(s1.m, c.m) AS m FROM c LEFT JOIN s1 USING (cid))"


def _round2(metric: str) -> str:
    one = f"{E}, {CENTROIDS}, cells AS ({_assign_sql(metric)}), s1 AS {STEP.format(cells='cells')}{NEXT}"
    two = f"cells2 AS ({_assign_sql(metric, 'c2')}), s2 AS {STEP.format(cells='cells2')}, c3 AS (SELECT c2.cid, coalesce(s2.m, c2.m) AS m FROM c2 LEFT JOIN s2 USING (cid))"
    return f"{one}, {two}, cells3 AS ({_assign_sql(metric, 'c3')})"


ROUND2 = f"{ROUND1}{NEXT}, cells2 AS ({_assign_sql(cells='c2')}), s2 AS {STEP.format(cells='cells2')}, c3 AS (SELECT c2.cid, coalesce(s2.m, c2.m) AS m FROM c2 LEFT JOIN s2 USING (cid)), cells3 AS ({_assign_sql(cells='c3')})"


@_registered(f"WITH {ROUND1} SELECT cid, (i - 1)::INT AS pos, round(m[i], 6) AS x FROM (SELECT cid, m, unnest(range(1, {DIM} + 1)) AS i FROM s1)")
def kmeans_step(spark, d):
    emb = _emb(spark, d)
    step = ivf.lloyd_step(emb, ivf.first_vectors(emb, NLIST))
    return step.select("cid", F.posexplode("centroid").alias("pos", "x")).select("cid", "pos", F.round("x", 6).alias("x"))


@_registered(f"WITH {ROUND1}{NEXT} SELECT cid, round({_dist('l2', 'c.m', 'c2.m')}, 6) AS shift FROM c JOIN c2 USING (cid)")
def kmeans_shift(spark, d):
    emb = _emb(spark, d)
    old = ivf.first_vectors(emb, NLIST)
    start = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(old)], "cid int, old array<double>")
    new = start.join(ivf.lloyd_step(emb, old), "cid", "left")
    return new.select("cid", F.round(D.l2_sq(F.col("old"), F.coalesce("centroid", "old")), 6).alias("shift"))


@_registered(f"WITH {ROUND2} SELECT cid, count(*) AS n FROM cells3 GROUP BY cid")
def kmeans_trained_sizes(spark, d):
    return _ivf(spark, d, rounds=2).vectors.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


@_registered()
def kmeans_converged(spark, d):
    emb = _emb(spark, d).persist()
    centroids, shifts = ivf.train(emb, ivf.chosen_vectors(emb, NLIST))
    emb.unpersist()
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(shifts)], "round int, shift double")


#: Cells of 16 to look into for a recall of 0.9 at least in every metric.
TRAINED_NPROBE = 14

for _metric in ("l2", "cosine", "inner_product"):
    _trained_query(f"ivf_trained_{_metric}", _metric)
    _recall_query(f"ivf_recall_{_metric}", _metric)


# evaluation ---------------------------------------------------------------------------------------------

EXACT = "exact AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT query_id, vec_id, " + _dist("l2", "v", "u") + f" AS distance FROM e, a)) WHERE rank <= {K})"


def _found_sql(n: int) -> str:
    pairs = f"SELECT query_id, vec_id, {_dist('l2', 'v', 'u')} AS distance FROM cells JOIN ranks USING (cid) WHERE cell_rank <= {n}"
    return f"SELECT {n}::INT AS nprobe, query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM ({pairs})) WHERE rank <= {K}"


def _curve_sql(nprobes) -> str:
    found = " UNION ALL ".join(map(_found_sql, nprobes))
    ranks = f"ranks AS (SELECT query_id, u, cid, row_number() OVER (PARTITION BY query_id ORDER BY d, cid) AS cell_rank FROM (SELECT query_id, u, cid, {_dist('l2', 'u', 'm')} AS d FROM a, c))"
    return f"WITH {E}, {ASKED}, {CENTROIDS}, cells AS ({_assign_sql()}), {ranks}, {EXACT}, found AS ({found}), hit AS (SELECT nprobe, count(*) AS hits FROM found JOIN exact USING (query_id, vec_id) GROUP BY nprobe), n AS (SELECT count(*) AS expected FROM exact)"


@_registered(_curve_sql([NPROBE]) + " SELECT hits, expected, round(hits / expected, 6) AS recall FROM hit, n")
def recall_at_k(spark, d):
    emb = _emb(spark, d)
    found = _ivf(spark, d).search_batch(_asked(emb), K)
    return evaluate.recall(found, topk.nearest_batch(emb, _asked(emb), K))


@_registered(f"WITH {E}, {ASKED}, x AS ({_ranked_sql('SELECT query_id, vec_id, ' + _dist('l2', 'v', 'u') + ' AS distance FROM e, a')}) SELECT count(*) FILTER (vec_id % 3 <> 0) AS hits, count(*) AS expected, round(count(*) FILTER (vec_id % 3 <> 0) / count(*), 6) AS recall FROM x")
def recall_by_distance(spark, d):
    """Other ids at distances within the tolerance count, those a little beyond it do not."""
    emb = _emb(spark, d)
    exact = topk.nearest_batch(emb, _asked(emb), K)
    # apart by 0.001 and more for each place, so that no other distance is near by chance
    exact = exact.withColumn("distance", F.col("rank") + F.round("distance", 0) * 100)
    off = F.when(F.col("vec_id") % 3 == 0, 2e-5).when(F.col("vec_id") % 3 == 1, 5e-6).otherwise(0.0)
    found = exact.withColumn("distance", F.col("distance") + off).withColumn("vec_id", -F.col("vec_id") - 1)
    return evaluate.recall_by_distance(found, exact)


@_registered(_curve_sql([1, 2, 4, 8, 16]) + f" SELECT nprobe, hits, expected, round(hits / expected, 6) AS recall, round(nprobe / {NLIST}, 6) AS cells_share FROM hit, n")
def nprobe_curve(spark, d):
    emb = _emb(spark, d)
    return evaluate.curve(_ivf(spark, d).vectors, _asked(emb), ivf.first_vectors(emb, NLIST), [1, 2, 4, 8, 16], K)


@_registered(f"WITH {E}, {ASKED}, {CENTROIDS}, cells AS ({_assign_sql()}), probed AS ({_probe_sql('l2', NPROBE)}), s AS (SELECT cid, count(*) AS n FROM cells GROUP BY cid) SELECT query_id, sum(n)::BIGINT AS scanned, round(sum(n) / (SELECT count(*) FROM e), 6) AS share FROM probed JOIN s USING (cid) GROUP BY query_id")
def scanned_fraction(spark, d):
    index = _ivf(spark, d)
    sizes = index.vectors.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    total = index.count()
    cells = ivf.probes(_asked(_emb(spark, d)), index.centroid_table(), NPROBE)
    return cells.join(sizes, "cid").groupBy("query_id").agg(F.sum("n").alias("scanned"), F.round(F.sum("n") / total, 6).alias("share"))


@_registered("WITH t AS (SELECT list(o_totalprice ORDER BY o_totalprice) AS v FROM orders) SELECT share::DOUBLE AS share, v[least(len(v), floor(len(v) * share::DOUBLE)::BIGINT + 1)] AS value FROM t, (SELECT unnest([0.5, 0.95, 0.99]) AS share)")
def latency_percentiles(spark, d):
    return evaluate.percentiles(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", [0.5, 0.95, 0.99])


@_registered("SELECT vec_id, 32::INT AS dim, vec_id < 1000 AS inside, (SELECT count(*) FROM embeddings) AS n, TRUE AS mean_half FROM embeddings")
def random_vectors(spark, d):
    """As many vectors as the table has, on its ids, which run from 0; all elements in [0, 1), with mean 1/2."""
    n = _emb(spark, d).count()
    rows = evaluate.random_vectors(spark, n, 32)
    mean = rows.select(F.explode("embedding").alias("x")).agg((F.abs(F.avg("x") - 0.5) < 0.02).alias("mean_half"))
    good = F.forall("embedding", lambda x: (x >= 0) & (x < 1))
    return rows.select("vec_id", F.size("embedding").alias("dim"), ((F.col("vec_id") < 1000) & good).alias("inside"), F.lit(n).cast("long").alias("n")).join(F.broadcast(mean))


@_registered("SELECT (i % 10)::BIGINT AS cluster, count(*) AS n, TRUE AS tight FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS i) GROUP BY i % 10")
def clustered_vectors(spark, d):
    """As many vectors as the table has, in ten clusters of spread 0.1."""
    rows = evaluate.clustered_vectors(spark, _emb(spark, d).count(), 32, 10)
    each = rows.select((F.col("vec_id") % 10).alias("cluster"), F.posexplode("embedding")).groupBy("cluster", "pos").agg(F.stddev("col").alias("s"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("cluster").agg(F.max("n").alias("n"), (F.abs(F.avg("s") - 0.1) < 0.02).alias("tight"))


# storage ------------------------------------------------------------------------------------------------


@_registered(f"WITH {E}, {Q} " + _nearest_sql("cosine", "(SELECT * FROM e WHERE vec_id % 7 <> 0)"))
def flat_save_load(spark, d):
    path = new_dir(spark, "flat")
    index = _flat(spark, d, "cosine")
    index, _ = index.delete(_gone(index.vectors))
    index.save(path)
    return flat.FlatIndex.load(spark, path).search(_query(spark, d), K).select("rank", "vec_id", _r())


@_registered(_ivf_sql("l2"))
def ivf_save_load(spark, d):
    path = new_dir(spark, "ivf")
    _ivf(spark, d).save(path)
    return ivf.IvfIndex.load(spark, path).search_batch(_asked(_emb(spark, d)), K).select("query_id", "rank", "vec_id", _r())


@_registered(f"WITH {E}, {CENTROIDS}, cells AS ({_assign_sql()}) SELECT cid, count(*) AS n FROM cells GROUP BY cid")
def ivf_stream_ingest(spark, d):
    path, emb = new_dir(spark, "stream"), _emb(spark, d)
    centroids = ivf.first_vectors(emb, NLIST)
    emb.select("vec_id", "embedding").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(emb.select("vec_id", "embedding").schema).parquet(f"{path}/in")
    ingest.ingest(stream, centroids, DIM, f"{path}/out", f"{path}/check").awaitTermination()
    return ingest.ingested(spark, f"{path}/out").groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Changes of users' last event: every fifth lsn deletes, every eleventh has a wrong checksum."""
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_id") % 5 == 0, F.lit("delete")).otherwise(F.lit("put"))
    payload = F.when(F.col("event_id") % 5 != 0, F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    log = changelog.entries(e.select(F.col("event_id").alias("lsn"), op.alias("op"), F.col("user_id").alias("vec_id"), payload.alias("payload")))
    return log.withColumn("crc", F.when(F.col("lsn") % 11 == 0, F.col("crc") + 1).otherwise(F.col("crc")))


def _base(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("vec_id")).distinct()
    more = users.union(users.select(F.col("vec_id") + 1_000_000))
    return more.select("vec_id", F.lit("base").cast("binary").alias("payload"))


def _replay_sql(good: str) -> str:
    base = "b AS (SELECT DISTINCT user_id AS vec_id FROM events UNION ALL SELECT DISTINCT user_id + 1000000 FROM events)"
    last = f"l AS (SELECT user_id AS vec_id, max(event_id) AS lsn, arg_max(event_type, event_id) AS t FROM events WHERE {good} GROUP BY user_id)"
    return f"WITH {base}, {last} SELECT vec_id, CASE WHEN l.lsn IS NULL THEN 'base' ELSE t || ':' || lsn END AS payload FROM b LEFT JOIN l USING (vec_id) WHERE l.lsn IS NULL OR l.lsn % 5 <> 0"


@_registered(_replay_sql("event_id % 11 <> 0"))
def log_replay(spark, d):
    return changelog.replay(_base(spark, d), _log(spark, d)).select("vec_id", F.col("payload").cast("string").alias("payload"))


@_registered(_replay_sql("TRUE"))
def log_checkpoint(spark, d):
    sound = _log(spark, d).withColumn("crc", changelog.checksum())
    return changelog.checkpoint(_base(spark, d), sound).select("vec_id", F.col("payload").cast("string").alias("payload"))


@_registered(_replay_sql("TRUE"))
def log_reopen(spark, d):
    path = new_dir(spark, "log")
    log = _log(spark, d).drop("crc")
    changelog.append(log.where("lsn % 2 = 0"), f"{path}/log")
    changelog.checkpoint_to(_base(spark, d), f"{path}/log", f"{path}/base")
    changelog.append(log, f"{path}/log")
    return changelog.opened(spark, f"{path}/log", f"{path}/base").select("vec_id", F.col("payload").cast("string").alias("payload"))


@_registered("SELECT event_id AS lsn, user_id AS vec_id FROM events WHERE event_id % 11 = 0")
def log_corrupt_skip(spark, d):
    return changelog.corrupt(_log(spark, d)).select("lsn", "vec_id")


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("payload"))


@_registered("SELECT id, seq::INT AS seq, least(8172, n - 8172 * seq)::BIGINT AS bytes FROM (SELECT doc_id AS id, octet_length(encode(text)) AS n, unnest(range(0, ceil(octet_length(encode(text)) / 8172)::BIGINT)) AS seq FROM documents)")
def stream_chunks(spark, d):
    return blobs.split(_blobs(spark, d)).select("id", "seq", F.octet_length("chunk").cast("long").alias("bytes"))


@_registered("SELECT doc_id AS id, md5(text) AS digest FROM documents WHERE octet_length(encode(text)) > 0")
def stream_round_trip(spark, d):
    return blobs.join(blobs.split(_blobs(spark, d))).select("id", F.md5("payload").alias("digest"))


@_registered("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderpriority END AS payload FROM orders WHERE o_orderkey % 4 <> 0")
def record_store_ops(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").cast("binary").alias("payload"))
    store = records.insert(rows.where("id % 2 = 0"), rows.where("id % 2 <> 0"))
    store = records.update(store, rows.where("id % 3 = 0").select("id", F.lit("changed").cast("binary").alias("payload")))
    store = records.delete(store, rows.where("id % 4 = 0"))
    return store.select("id", F.col("payload").cast("string").alias("payload"))


@_registered("SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS found, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderpriority END AS payload FROM orders UNION ALL SELECT -o_orderkey, FALSE, NULL FROM orders")
def record_get(spark, d):
    """Every id of a store with updates and deletes, and as many that it never had."""
    every = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    store = record_store_ops(spark, d).select("id", F.col("payload").cast("binary").alias("payload"))
    return records.get(store, every.union(every.select(-F.col("id")))).select("id", "found", F.col("payload").cast("string").alias("payload"))


@_registered("SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS deleted FROM orders")
def record_delete_status(spark, d):
    every = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return records.delete_status(record_store_ops(spark, d), every)


@_registered("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderpriority END AS payload, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0) AS reclaimed FROM orders WHERE o_orderkey % 4 <> 0")
def record_compact(spark, d):
    path, orders = new_dir(spark, "records"), spark.read.parquet(f"{d}/orders.parquet")
    records.save(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").cast("binary").alias("payload")), path)
    store = record_store_ops(spark, d).select("id", F.col("payload").cast("binary").alias("payload"))
    now, reclaimed = records.compact(store, path)
    return now.select("id", F.col("payload").cast("string").alias("payload"), F.lit(reclaimed).cast("long").alias("reclaimed"))


@_registered("SELECT doc_id AS id, md5(left(text, 100)) AS digest FROM documents WHERE octet_length(encode(text)) = length(text) AND length(text) > 0")
def stream_prefix(spark, d):
    """The first hundred bytes of the ASCII texts."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("octet_length(text) = char_length(text)")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("payload"))
    return blobs.prefix(blobs.split(rows), 100).select("id", F.md5("payload").alias("digest"))
