"""Distances, exact and approximate search, deletes, metadata, storage: small cases with known answers."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import distance as D
from orrery.operators import evaluate, flat, ivf, metadata, records, topk
from orrery.sources import blobs, changelog, store
from orrery.streaming import ingest


def vectors(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")


def ids(df):
    return [r.vec_id for r in df.orderBy("rank").collect()]


def value(spark, f, a, b):
    return spark.range(1).select(f(D.vector(a), D.vector(b)).alias("x")).first().x


# distances


def test_known_distances(spark):
    a, b = [1, 0, 0], [0, 1, 0]
    assert value(spark, D.l2_sq, a, b) == 2 and value(spark, D.l2, a, b) == pytest.approx(math.sqrt(2))
    assert value(spark, D.cosine, a, b) == 1 and value(spark, D.cosine, a, a) == 0
    assert value(spark, D.inner_product, a, b) == 0 and value(spark, D.inner_product, a, a) == -1
    assert value(spark, D.cosine, a, [0, 0, 0]) == 1.0
    assert spark.range(1).select(D.normalize(D.vector([3, 4, 0])).alias("x")).first().x == pytest.approx([0.6, 0.8, 0])
    assert spark.range(1).select(D.normalize(D.vector([0, 0])).alias("x")).first().x == [0, 0]
    with pytest.raises(ValueError):
        D.metric("hamming")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000))
def test_kernel_agrees_with_the_definition(dim, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(4, dim)), rng.normal(size=(3, dim))
    b[0] = a[0] + 1e-7
    a[1] = 0
    for i in range(4):
        for j in range(3):
            x, y = a[i], b[j]
            n = np.linalg.norm(x) * np.linalg.norm(y)
            for name, want in (("l2", ((x - y) ** 2).sum()), ("inner_product", -(x @ y)), ("cosine", 1.0 if n < 1e-12 else 1 - np.clip(x @ y / n, -1, 1))):
                assert D.chosen(name, a, b, np.array([i]), np.array([j]))[0] == pytest.approx(want, rel=1e-9, abs=1e-15)
                assert abs(D.pairwise(name, a, b)[i, j] - want) <= D.slack(name, a, b)[i]


@pytest.mark.parametrize("name", ["l2", "cosine", "inner_product"])
def test_equal_vectors_have_equal_distances(name):
    rng = np.random.default_rng(3)
    one = rng.normal(size=64)
    vectors, queries = np.tile(one, (2051, 1)), rng.normal(size=(50, 64))
    best = topk.Best(queries, 5, name)
    for at in range(0, 2051, 700):
        best.add(np.arange(2051)[::-1][at : at + 700], vectors[at : at + 700])
    assert (best.i == np.arange(5)).all() and (best.d == best.d[:, :1]).all()
    assert (D.nearest_row(name, queries, vectors) == 0).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["l2", "cosine", "inner_product"]))
def test_best_against_sorting(seed, name):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-2, 3, (60, 3)).astype(float), rng.integers(-2, 3, (7, 3)).astype(float)
    ids, k = rng.permutation(60), int(rng.integers(1, 70))
    best = topk.Best(q, k, name)
    for part in np.array_split(np.arange(60), 4):
        best.add(ids[part], x[part])
    for r in range(7):
        d = D.chosen(name, q, x, np.full(60, r), np.arange(60))
        order = np.lexsort((ids, d))[:k]
        assert best.i[r][: len(order)].tolist() == ids[order].tolist() and best.d[r][: len(order)].tolist() == d[order].tolist()


def most_mb(run):
    """MB that are held at most while ``run`` runs."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def vector_batch(x, *more):
    """vec_id, embedding and more columns as they come to a kernel."""
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), flat, *more], names=["vec_id", "embedding", "cid"][: 2 + len(more)])


@pytest.mark.parametrize("name", ["cosine", "inner_product", "l2"])
def test_memory_of_exact_search_does_not_grow_with_the_queries(name):
    rng = np.random.default_rng(4)
    batch, q = vector_batch(rng.normal(size=(2048, 64))), rng.normal(size=(topk.QUERY_BLOCK, 64))
    few, many = (most_mb(lambda n=n: list(topk._kernel(list(range(n)), q[:n], 10, name)(iter([batch])))) for n in (400, len(q)))
    assert many < 40 and many < 1.6 * few


def test_memory_of_probed_search_does_not_grow_with_the_queries():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(2048, 64)), rng.normal(size=(topk.QUERY_BLOCK, 64))
    # a cell has fewer vectors than k, so that all its pairs are candidates
    cid = np.arange(2048) % 256
    cells, batch = np.tile(np.arange(256), (len(q), 1))[:, :14], vector_batch(x, pa.array(cid.astype(np.int32)))
    few, many = (most_mb(lambda n=n: list(ivf._probed(np.arange(n), q[:n], cells[:n], 10, "l2", False)(iter([batch])))) for n in (1024, len(q)))
    assert many < 30 and many < 3 * few


def test_memory_of_assigning_does_not_grow_with_the_cells():
    rng = np.random.default_rng(7)
    batch, centroids = vector_batch(rng.normal(size=(2048, 64))), rng.normal(size=(2048, 64))
    few, many = (most_mb(lambda n=n: list(ivf._cells(centroids[:n], "l2")(iter([batch])))) for n in (128, 2048))
    assert many < 20 and many < 2 * few


def test_memory_of_many_equal_vectors_is_bounded():
    one = np.random.default_rng(5).normal(size=64)
    best = topk.Best(np.tile(one, (1024, 1)), 10, "l2")
    assert most_mb(lambda: best.add(np.arange(2048)[::-1], np.tile(one, (2048, 1)))) < 50
    assert (best.i == np.arange(10)).all()


# exact search


def test_flat_five(spark):
    index = flat.FlatIndex.create(vectors(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (10, 10, 10), (0.1, 0.1, 0)]), 3)
    got = index.search([0, 0, 0], 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 4, 1] and got[0].distance == 0 and got[1].distance == pytest.approx(0.02)
    assert index.search([0, 0, 0], 0).count() == 0 and index.search([0, 0, 0], 99).count() == 5
    assert topk.threshold(index.search([0, 0, 0], 0)).first().threshold == math.inf
    with pytest.raises(ValueError):
        index.search([0, 0], 1)


def test_metrics_rank_differently(spark):
    rows = vectors(spark, [(1, 0, 0), (5, 0, 0), (0.1, 0, 0)])
    ip = flat.FlatIndex.create(rows, 3, "inner_product").search([1, 0, 0], 3).orderBy("rank").collect()
    assert [r.vec_id for r in ip] == [1, 0, 2] and [r.distance for r in ip] == pytest.approx([-5, -1, -0.1])
    cos = flat.FlatIndex.create(vectors(spark, [(1, 0, 0), (0, 1, 0), (0.9, 0.1, 0)]), 3, "cosine")
    assert ids(cos.search([1, 0, 0], 2)) == [0, 2]


def test_ties_go_to_the_smaller_id(spark):
    rows = vectors(spark, [(1, 1)] * 6).repartition(4)
    assert ids(flat.FlatIndex.create(rows, 2).search([0, 0], 3)) == [0, 1, 2]
    q = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, embedding array<double>")
    for search in (topk.nearest_batch, topk.nearest_pairs):
        assert [r.vec_id for r in search(rows, q, 3).orderBy("rank").collect()] == [0, 1, 2]


@pytest.mark.parametrize("row", [(1, None), (None, [1.0, 2.0]), (1, [1.0]), (1, [1.0, float("nan")]), (1, [1.0, None])])
def test_malformed_vectors(spark, row):
    df = spark.createDataFrame([row, (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="malformed"):
        flat.FlatIndex.create(df, 2).vectors.collect()
    assert [r.vec_id for r in flat.FlatIndex.create(df, 2, strict=False).vectors.collect()] == [2]


@pytest.mark.parametrize("dim", [0, 2001])
def test_dimensions_have_limits(spark, dim):
    with pytest.raises(ValueError):
        flat.FlatIndex.create(vectors(spark, [(1,)]), dim)
    with pytest.raises(ValueError):
        ivf.IvfIndex.create(spark, dim)


def test_delete_and_compact(spark):
    index = flat.FlatIndex.create(vectors(spark, [[k] * 4 for k in range(10)]), 4)
    gone = spark.createDataFrame([(k,) for k in (0, 2, 4, 6, 8, 77)], "vec_id long")
    index, status = index.delete(gone)
    assert {r.vec_id: r.deleted for r in status.collect()} == {0: True, 2: True, 4: True, 6: True, 8: True, 77: False}
    assert not any(r.deleted for r in index.delete(gone)[1].collect())
    assert index.count() == 5 and ids(index.search([1, 0, 0, 0], 1)) == [1]
    small, reclaimed = index.compact()
    assert reclaimed == 5 and small.count() == 5 and small.tombstones is None and ids(small.search([9] * 4, 2)) == [9, 7]
    assert small.compact()[1] == 0


def test_inserts(spark):
    index = flat.FlatIndex.create(vectors(spark, [[k, 0] for k in range(50)]), 2)
    index = index.insert(vectors(spark, [[k, 0] for k in range(50, 100)], 50)).insert(vectors(spark, [[1, 1]]).where("false"))
    assert index.count() == 100 and ids(index.search([99, 0], 1)) == [99]


def test_batch_in_blocks_agrees_with_single_queries(spark):
    rng = np.random.default_rng(3)
    rows = vectors(spark, rng.normal(size=(300, 8)).tolist()).repartition(5)
    q = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(7, 8)))], "query_id long, embedding array<double>")
    for name in D.METRICS:
        got = topk.nearest_batch(rows, q, 5, name, block=3).collect()
        same = topk.nearest_pairs(rows, q, 5, name).collect()
        assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(r.query_id, r["rank"], r.vec_id) for r in same} and len(got) == 35
    assert topk.nearest_batch(rows, q, 0).count() == 0 and topk.nearest_batch(rows, q.where("false"), 5).count() == 0


# cells


def cluster_rows(spark, clusters, per, dim, spread, seed=1):
    rng = np.random.default_rng(seed)
    return vectors(spark, [(c * spread + rng.uniform(-0.25, 0.25, dim)).tolist() for c in range(clusters) for _ in range(per)])


def test_training_finds_clusters(spark):
    rows = cluster_rows(spark, 4, 50, 4, 100)
    start = ivf.first_vectors(rows.where("vec_id % 50 = 7"), 4)
    index = ivf.IvfIndex.create(spark, 4, nlist=4, nprobe=1).train(rows, start)
    assert sorted(np.round(index.centroids.mean(1)).tolist()) == [0, 100, 200, 300]
    index = index.insert(rows)
    assert index.count() == 200 and index.search([200] * 4, 10).count() == 10
    assert {r.vec_id // 50 for r in index.search([200] * 4, 10).collect()} == {2}
    with pytest.raises(RuntimeError):
        index.train(rows)


def test_untrained_and_bad_arguments(spark):
    index = ivf.IvfIndex.create(spark, 4, nlist=10, nprobe=99)
    assert index.nprobe == 10 and not index.is_trained and ivf.IvfIndex.create(spark, 4).nlist == 128
    rows = vectors(spark, [[0] * 4] * 5)
    for act in (lambda: index.insert(rows), lambda: index.search([0] * 4, 1), lambda: index.compact(), lambda: index.save("x")):
        with pytest.raises(RuntimeError):
            act()
    with pytest.raises(ValueError):
        index.train(rows)
    done = ivf.IvfIndex.create(spark, 4, nlist=2, nprobe=1).train(rows)
    with pytest.raises(ValueError):
        done.search([0] * 4, 1, nprobe=0)


def test_empty_cells_keep_their_centroid(spark):
    rows = vectors(spark, [[0.0], [1.0], [2.0]])
    centroids, shifts = ivf.train(rows, np.array([[1.0], [500.0]]))
    assert centroids.tolist() == [[1.0], [500.0]] and shifts == [0.0]


@pytest.mark.parametrize("name", list(D.METRICS))
def test_full_probe_equals_exact(spark, name):
    rng = np.random.default_rng(5)
    rows = vectors(spark, rng.uniform(0, 100, (120, 6)).tolist()).withColumn("label", F.col("vec_id") % 3)
    index = ivf.IvfIndex.create(spark, 6, name, 6, 2).train(rows, rounds=4).insert(rows)
    exact = flat.FlatIndex.create(rows, 6, name)
    gone = rows.where("vec_id % 5 = 0")
    index, exact = index.delete(gone)[0], exact.delete(gone)[0]
    q = rows.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    for where in (None, "label = 1"):
        a = index.search_batch(q, 7, where, nprobe=6).collect()
        b = exact.search_batch(q, 7, where).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in a) == sorted((r.query_id, r["rank"], r.vec_id) for r in b)
        one = rows.where("vec_id = 8").first().embedding
        assert ids(index.search(one, 7, where, nprobe=6)) == ids(exact.search(one, 7, where))


def test_recall_does_not_fall_with_more_cells(spark):
    rows = cluster_rows(spark, 8, 30, 4, 1.0, 9)
    q = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centroids = ivf.chosen_vectors(rows, 8)
    curve = evaluate.curve(ivf.assign(rows, centroids), q, centroids, [1, 2, 4, 8], 10).orderBy("nprobe").collect()
    assert [r.recall for r in curve] == sorted(r.recall for r in curve) and curve[-1].recall == 1.0


def test_fewer_than_k(spark):
    rows = vectors(spark, [(1, 1, 1), (2, 2, 2), (3, 3, 3)])
    index = ivf.IvfIndex.create(spark, 3, nlist=2, nprobe=2).train(rows).insert(rows)
    assert index.search([1, 1, 1], 10).count() == 3
    index, status = index.delete(rows.where("vec_id = 1"))
    assert status.first().deleted and index.count() == 2 and index.compact()[1] == 1


# metadata


def test_metadata(spark):
    kv = lambda rows: spark.createDataFrame(rows, "vec_id long, metadata string")
    base = kv([(1, "a"), (2, "b"), (3, "c")])
    change = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (9, "new", 1)], "vec_id long, metadata string, version int")
    up = metadata.upsert(base, change)
    assert dict(up.collect()) == {1: "a", 2: "y", 3: "c", 9: "new"}
    assert dict(metadata.lookup(kv([(1, ""), (5, "")]), up).collect()) == {1: "a", 5: None}
    assert dict(metadata.remove(up, kv([(1, ""), (77, "")])).collect()) == {2: "y", 3: "c", 9: "new"}
    with pytest.raises(Exception, match="metadata is null"):
        metadata.upsert(base, spark.createDataFrame([(2, None, 1)], change.schema)).collect()


def test_filtered_search(spark):
    rows = vectors(spark, [[1.0] * 4, [1.1] * 4, [1.2] * 4, [1.0] * 4])
    meta = spark.createDataFrame([(0, '{"type": "image"}'), (1, '{"type": "document"}'), (2, '{"type": "document"}')], "vec_id long, metadata string")
    index = flat.FlatIndex.create(metadata.with_metadata(rows, meta), 4)
    got = index.search([1.05] * 4, 3, metadata.contains("document")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2] and got[0].distance == pytest.approx(0.01, abs=1e-5)
    assert ids(index.search([1.05] * 4, 3, metadata.field_is("$.type", "image"))) == [0]
    small, _ = index.delete(rows.where("vec_id = 0"))[0].compact()
    assert ids(small.search([1.05] * 4, 3, metadata.contains("document"))) == [1, 2]


# storage


@pytest.mark.parametrize("kind", ["flat", "ivf"])
def test_save_and_load(spark, tmp_path, kind):
    rows = vectors(spark, [[float(k % 7), float(k), 1.0, 0.0] for k in range(60)])
    made = flat.FlatIndex.create(rows, 4, "cosine") if kind == "flat" else ivf.IvfIndex.create(spark, 4, "cosine", 4, 2).train(rows).insert(rows)
    made, _ = made.delete(rows.where("vec_id < 5"))
    path = f"file://{tmp_path}/index"
    assert made.save(path) == 1
    again = flat.FlatIndex.load(spark, path) if kind == "flat" else ivf.IvfIndex.load(spark, path)
    assert again.count() == 55 and ids(again.search([3, 4, 1, 0], 5)) == ids(made.search([3, 4, 1, 0], 5))
    assert again.compact()[0].save(path) == 2 and store.versions(spark, path) == [1, 2]
    (tmp_path / "index" / "v3").mkdir()  # an interrupted save
    (tmp_path / "index" / "v3.draft").write_text("{")
    other = type(again).load(spark, path)
    assert other.tombstones is None and other.count() == 55 and type(again).load(spark, path, 1).tombstones is not None
    assert again.save(path) == 4
    with pytest.raises(ValueError):
        (ivf.IvfIndex if kind == "flat" else flat.FlatIndex).load(spark, path)
    with pytest.raises(FileNotFoundError):
        type(again).load(spark, f"file://{tmp_path}/none")


def test_single_search_reads_only_its_cells(spark, tmp_path):
    rows = cluster_rows(spark, 4, 20, 4, 100)
    path = f"file://{tmp_path}/i"
    ivf.IvfIndex.create(spark, 4, nlist=4, nprobe=1).train(rows, ivf.first_vectors(rows.where("vec_id % 20 = 3"), 4)).insert(rows).save(path)
    plan = ivf.IvfIndex.load(spark, path).search([100.0] * 4, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cid" in plan or "PartitionFilters: [cid" in plan


def log(spark, rows):
    return changelog.entries(spark.createDataFrame(rows, "lsn long, op string, vec_id long, payload binary"))


def test_log_replay_and_corruption(spark, tmp_path):
    base = spark.createDataFrame([(1, b"old"), (2, b"two"), (3, b"three")], "vec_id long, payload binary")
    entries = log(spark, [(1, "put", 1, b"a"), (3, "put", 1, b"c"), (2, "put", 1, b"b"), (4, "delete", 2, None), (5, "put", 9, b"n")])
    read = lambda df: {r.vec_id: bytes(r.payload) for r in df.collect()}
    assert read(changelog.replay(base, entries)) == {1: b"c", 3: b"three", 9: b"n"}
    assert read(changelog.checkpoint(base, entries)) == {1: b"c", 3: b"three", 9: b"n"}
    bad = entries.withColumn("crc", F.when(F.col("lsn") == 3, F.col("crc") + 1).otherwise(F.col("crc")))
    assert read(changelog.replay(base, bad)) == {1: b"b", 3: b"three", 9: b"n"}
    with pytest.raises(Exception, match="corrupt"):
        changelog.checkpoint(base, bad).collect()
    row = spark.range(1).select(changelog.checksum(F.lit(3), F.lit("put"), F.lit(12), F.lit(b"123456789")).alias("c"))
    assert row.first().c == zlib.crc32(b"3\0put\x0012\x00123456789")
    for change in ({"op": F.lit("other")}, {"vec_id": F.col("vec_id") + 1}, {"lsn": F.col("lsn") + 1}, {"payload": F.lit(b"q")}):
        assert changelog.intact(entries.withColumns(change)).count() == 0
    path = f"file://{tmp_path}/log"
    changelog.append(spark.createDataFrame([(1, "put", 1, b"a")], "lsn long, op string, vec_id long, payload binary"), path)
    changelog.append(spark.createDataFrame([(2, "put", 1, b"z")], "lsn long, op string, vec_id long, payload binary"), path)
    assert read(changelog.replay(base, spark.read.parquet(path)))[1] == b"z"
    assert read(changelog.replay(base, entries.where("false"))) == {1: b"old", 2: b"two", 3: b"three"}


def test_log_on_disk(spark, tmp_path):
    schema = "lsn long, op string, vec_id long, payload binary"
    path, table = f"file://{tmp_path}/log", f"file://{tmp_path}/base"
    read = lambda: {r.vec_id: bytes(r.payload) for r in changelog.opened(spark, path, table).collect()}
    assert read() == {}
    changelog.append(spark.createDataFrame([(1, "put", 1, b"a"), (2, "put", 2, b"b")], schema), path)
    assert read() == {1: b"a", 2: b"b"}
    assert changelog.checkpoint_to(changelog.opened(spark, path, table), path, table) == 1
    assert not list((tmp_path / "log").glob("*.parquet")) and read() == {1: b"a", 2: b"b"}
    changelog.append(spark.createDataFrame([(3, "delete", 1, None)], schema), path)
    assert read() == {2: b"b"}
    bad = changelog.entries(spark.createDataFrame([(4, "put", 2, b"x")], schema)).withColumn("crc", F.lit(7).cast("long"))
    bad.write.mode("append").parquet(path)
    with pytest.raises(Exception, match="corrupt"):
        changelog.checkpoint_to(changelog.opened(spark, path, table), path, table)
    assert (tmp_path / "log").exists() and read() == {2: b"b"} and store.versions(spark, table) == [1]


def test_get_and_is_deleted(spark):
    index = flat.FlatIndex.create(vectors(spark, [[0.0], [1.0], [2.0]]), 1)
    index, _ = index.delete(vectors(spark, [[1.0]], 1))
    asked = spark.createDataFrame([(0,), (1,), (9,)], "vec_id long")
    assert {r.vec_id for r in index.get(asked).collect()} == {0, 1}
    assert {r.vec_id: r.is_deleted for r in index.is_deleted(asked).collect()} == {0: False, 1: True, 9: True}


def test_blobs(spark):
    rng = random.Random(0)
    data = {1: b"", 2: b"x", 3: rng.randbytes(8172), 4: rng.randbytes(8173), 5: rng.randbytes(100_000)}
    df = spark.createDataFrame(list(data.items()), "id long, payload binary")
    chunks = blobs.split(df)
    assert {r.id: r["count"] for r in chunks.groupBy("id").count().collect()} == {2: 1, 3: 1, 4: 2, 5: 13}
    got = {r.id: r.payload for r in blobs.join(chunks.repartition(7)).collect()}
    assert {k: bytes(v) for k, v in got.items()} == {k: v for k, v in data.items() if v}
    assert blobs.join(chunks.where("id = 5 and seq <> 12 and seq <> 3")).first().payload is None


def test_records_and_pages(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, payload binary")
    rows = records.insert(df([(1, b"one")]), df([(2, b"two"), (3, b"three")]))
    rows = records.delete(records.update(rows, df([(1, b"a longer record"), (8, b"?")])), df([(2, b"")]))
    assert {r.id: bytes(r.payload) for r in rows.collect()} == {1: b"a longer record", 3: b"three"}
    with pytest.raises(Exception, match="empty record"):
        records.insert(rows, df([(4, b"")])).collect()
    dims = spark.createDataFrame([(0,), (1,), (4,), (64,), (128,), (384,), (768,), (1024,), (2000,), (3000,)], "d int")
    assert [r.c for r in dims.select(records.page_capacity(F.col("d")).alias("c")).collect()] == [0, 1024, 502, 31, 15, 5, 2, 1, 1, 0]
    places = records.page_addresses(spark.range(100).select((F.col("id") * 3).alias("vec_id")), 64, 40)
    assert {r.vec_id: (r.page, r.slot) for r in places.collect()} == {3 * k: (k // 31, k % 31) for k in range(100)}
    moved = records.compacted_slots(places.where("page = 0"), spark.createDataFrame([(3,), (9,)], "vec_id long"))
    assert [r.vec_id for r in moved.orderBy("slot").collect()][:3] == [0, 6, 12]


def test_percentiles_and_recall(spark):
    times = spark.createDataFrame([(float(x),) for x in range(100)], "t double")
    assert {r.share: r.value for r in evaluate.percentiles(times, "t", [0.5, 0.95, 0.99, 1.0]).collect()} == {0.5: 50, 0.95: 95, 0.99: 99, 1.0: 99}
    pairs = lambda rows: spark.createDataFrame(rows, "query_id long, vec_id long, distance double")
    exact, found = pairs([(1, 1, 0.0), (1, 2, 1.0), (2, 3, 0.0), (2, 4, 2.0)]), pairs([(1, 1, 0.0), (1, 9, 1.0), (2, 3, 0.0)])
    assert evaluate.recall(found, exact).first().recall == 0.5
    assert evaluate.recall_by_distance(found, exact).first().recall == 0.75


def test_synthetic_vectors_repeat(spark):
    a = evaluate.clustered_vectors(spark, 50, 8, 5).collect()
    assert a == evaluate.clustered_vectors(spark, 50, 8, 5).collect() and a != evaluate.clustered_vectors(spark, 50, 8, 5, seed=1).collect()


def test_stream_ingest(spark, tmp_path):
    rows = cluster_rows(spark, 3, 20, 4, 100)
    centroids = ivf.first_vectors(rows.where("vec_id % 20 = 0"), 3)
    path = f"file://{tmp_path}"
    rows.where("vec_id < 30").write.parquet(f"{path}/in")
    for part in (rows.where("vec_id >= 30").union(spark.createDataFrame([(99, [1.0])], rows.schema)), None):
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        ingest.ingest(stream, centroids, 4, f"{path}/out", f"{path}/check").awaitTermination()
        if part is not None:
            part.write.mode("append").parquet(f"{path}/in")
    got = ingest.ingested(spark, f"{path}/out")
    assert {r.vec_id: r.cid for r in got.collect()} == {k: k // 20 for k in range(60)}


def test_a_deleted_id_may_come_back(spark):
    index = flat.FlatIndex.create(vectors(spark, [[1, 1], [2, 2], [3, 3]]), 2)
    index, _ = index.delete(vectors(spark, [[0, 0]], 1))
    assert index.count() == 2 and index.count(deleted=True) == 3
    index = index.insert(vectors(spark, [[9, 9]], 1))
    assert [(r.vec_id, r.distance) for r in index.search([9, 9], 1).collect()] == [(1, 0.0)]
    assert [r.vec_id for r in index.search([2, 2], 3).collect()] == [0, 2, 1] and index.count() == 3
    cells = ivf.IvfIndex.create(spark, 2, nlist=2, nprobe=2).train(vectors(spark, [[0, 0], [9, 9]])).insert(vectors(spark, [[1, 1], [2, 2], [8, 8]]))
    cells, _ = cells.delete(vectors(spark, [[0, 0]], 1))
    cells = cells.insert(vectors(spark, [[7, 7]], 1))
    assert [r.vec_id for r in cells.search([2, 2], 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("name", ["l2", "cosine", "inner_product"])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_prepared_cells_give_the_same(spark, name, kind):
    rng = np.random.default_rng(2)
    rows = vectors(spark, rng.normal(size=(500, 8))).select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).repartition(3)
    asked = vectors(spark, rng.normal(size=(20, 8))).withColumnRenamed("vec_id", "query_id")
    index = ivf.IvfIndex.create(spark, 8, name, nlist=9, nprobe=3).train(rows).insert(rows)
    kept = index.prepared()
    for n in (1, 3, 9):
        assert kept.search_batch(asked, 5, nprobe=n).collect() == index.search_batch(asked, 5, nprobe=n).collect()
    assert kept.search_batch(asked, 5, F.col("vec_id") % 2 == 0).count() == 100
    kept.release()
    exact = flat.FlatIndex.create(rows, 8, name).prepared()
    assert exact.search_batch(asked, 5).collect() == index.search_batch(asked, 5, nprobe=9).collect()
    exact.release()


def test_infinite_elements_are_refused(spark):
    for bad in (math.inf, -math.inf, math.nan):
        rows = vectors(spark, [[1, 2], [bad, 0]])
        assert flat.FlatIndex.create(rows, 2, strict=False).count() == 1
        with pytest.raises(Exception, match="malformed"):
            flat.FlatIndex.create(rows, 2).count()


def test_records_statuses_and_compaction(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"c")], "id long, payload binary")
    path = f"file://{tmp_path}/records"
    records.save(rows, path)
    some = spark.createDataFrame([(2,), (9,)], "id long")
    assert {(r.id, r.deleted) for r in records.delete_status(rows, some).collect()} == {(2, True), (9, False)}
    kept = records.delete(rows, some)
    assert {(r.id, r.deleted) for r in records.delete_status(kept, some).collect()} == {(2, False), (9, False)}
    now, gone = records.compact(kept, path)
    assert gone == 1 and now.count() == 2 and records.load(spark, path).count() == 2
    assert {(r.id, r.found, r.payload) for r in records.get(now, spark.createDataFrame([(1,), (2,)], "id long")).collect()} == {(1, True, b"a"), (2, False, None)}
    with pytest.raises(Exception, match="empty record"):
        records.update(rows, spark.createDataFrame([(1, b"")], rows.schema)).collect()


def test_metadata_of_an_absent_store_and_statuses(spark, tmp_path):
    assert metadata.load(spark, f"file://{tmp_path}/none").collect() == []
    store_ = spark.createDataFrame([(1, "a")], "vec_id long, metadata string")
    asked = spark.createDataFrame([(1,), (2,)], "vec_id long")
    assert {(r.vec_id, r.removed) for r in metadata.remove_status(store_, asked).collect()} == {(1, True), (2, False)}


def test_rows_appended_during_a_checkpoint_stay(spark, tmp_path, monkeypatch):
    path, table = f"file://{tmp_path}/log", f"file://{tmp_path}/base"
    base = spark.createDataFrame([], "vec_id long, payload binary")
    put = lambda lsn: changelog.append(spark.createDataFrame([(lsn, "put", lsn, b"x")], "lsn long, op string, vec_id long, payload binary"), path)
    put(1)
    monkeypatch.setattr(changelog, "save_version", lambda *a, f=changelog.save_version: (put(2), f(*a))[1])
    changelog.checkpoint_to(base, path, table)
    assert sorted(r.vec_id for r in changelog.opened(spark, path, table).collect()) == [1, 2]
    changelog.checkpoint_to(changelog.opened(spark, path, table), path, table)
    assert sorted(r.vec_id for r in changelog.opened(spark, path, table).collect()) == [1, 2]


def test_prefix_of_a_blob(spark):
    whole = bytes(range(256)) * 100
    chunks = blobs.split(spark.createDataFrame([(1, whole), (2, b"abc")], "id long, payload binary"))
    for n in (1, 3, 8172, 8173, 20_000, 10**6):
        assert {r.id: bytes(r.payload) for r in blobs.prefix(chunks, n).collect()} == {1: whole[:n], 2: b"abc"[:n]}
