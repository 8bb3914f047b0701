"""Golden values and invariants of the vector engine."""

import math
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import benchmark
from nearfield.functions import metrics
from nearfield.functions.distances import METRICS, metric
from nearfield.functions.vectors import from_arrays, norms, split_by_position, to_arrays
from nearfield.index import create_index, load_index
from nearfield.operators import graph, kmeans, knn, lsh
from nearfield.plans import measure
from nearfield.sources import files, sinks
from nearfield.sources import vectors as src
from nearfield.streaming.search import search_stream

LONG = "vec_id long, idx int, val double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, k, float(x)) for i, v in enumerate(vectors) for k, x in v.items()], LONG)


def brute(base, q, name):
    dot = sum(q[k] * base[k] for k in q.keys() & base.keys())
    a, b = (sum(x * x for x in v.values()) for v in (q, base))
    cos = dot / math.sqrt(a * b) if a and b else 0.0
    both, union = len(q.keys() & base.keys()), len(q.keys() | base.keys())
    return {
        "dot": dot, "inner_product": -dot, "euclidean": math.sqrt(max(0.0, a + b - 2 * dot)), "cosine": 1 - cos,
        "jaccard": 1 - (both / union if union else 1), "angular": math.acos(max(-1, min(1, cos))) / math.pi,
    }[name]


SIMPLE = [{0: 1, 2: 2}, {1: 3, 3: 4}, {0: 5, 2: 6}, {1: 7, 3: 8}, {0: 9, 2: 10}]


def test_distance_goldens(spark):
    v = frame(spark, [{0: 1, 2: 2, 3: 3}, {0: 4, 1: 5, 2: 6}])
    q = knn.as_queries(v, "vec_id = 0")
    get = lambda name: {r.vec_id: r.distance for r in knn.knn(v, q, 2, name).collect()}
    assert get("euclidean")[1] == pytest.approx(7.6811457, abs=1e-5)
    assert 1 - get("cosine")[1] == pytest.approx(0.4873159, abs=1e-5)
    assert get("angular")[0] == pytest.approx(0, abs=2e-4)


@pytest.mark.parametrize("name", METRICS)
def test_knn_equals_brute_force(spark, name):
    rng = random.Random(5)
    data = [{k: rng.choice([-2, -1, 0, 1, 2, 3]) for k in rng.sample(range(12), rng.randint(1, 4))} for _ in range(30)]
    v = frame(spark, data)
    ids = spark.range(32).select(F.col("id").alias("vec_id"))  # two vectors without entries
    q = knn.as_queries(v, "vec_id < 6")
    qids = spark.createDataFrame([(i,) for i in [*range(6), 99]], "query_id long")
    got = {(r.query_id, r.rnk): (r.vec_id, r.distance) for r in knn.knn(v, q, 8, name, ids, qids).collect()}
    for query, entries in [*enumerate(data[:6]), (99, {})]:
        want = sorted((round(brute(b, entries, name), 9), i) for i, b in enumerate([*data, {}, {}]))[:8]
        for r, (d, i) in enumerate(want, 1):
            assert got[query, r][0] == i and got[query, r][1] == pytest.approx(d, abs=1e-9)


def test_arrays_round_trip_and_duplicates(spark):
    a = spark.createDataFrame([(0, [3, 1], [1.0, 0.0]), (1, [2, 2], [1.0, 2.0])], "vec_id long, indices array<int>, `values` array<float>")
    assert from_arrays(a.filter("vec_id = 0")).count() == 2  # a stored zero is an entry
    assert {r.vec_id: r.indices for r in to_arrays(from_arrays(a, merge=True)).collect()} == {0: [1, 3], 1: [2]}
    with pytest.raises(Exception, match="duplicate index"):
        from_arrays(a).collect()


def test_split_is_balanced(spark):
    v = frame(spark, [{k: 1 for k in range(7)}, {0: 1}])
    got = {(r.vec_id, r.idx): r.m for r in split_by_position(v, 3).collect()}
    assert [got[0, k] for k in range(7)] == [0, 0, 0, 1, 1, 2, 2] and got[1, 0] == 0


def test_kmeans_converges(spark):
    v = frame(spark, [{0: 1, 1: 2}, {0: 1.5, 1: 1.8}, {0: 5, 1: 8}, {0: 8, 1: 8}]).withColumn("g", F.lit(0))
    centers = kmeans.lloyd(v, 2, 100, 0.001).groupBy("cid").agg(F.sort_array(F.collect_list("val"))).collect()
    found = sorted(tuple(r[1]) for r in centers)
    assert found == [pytest.approx((1.25, 1.9), abs=0.1), pytest.approx((6.5, 8.0), abs=0.1)]


@pytest.mark.parametrize("kind", ["linscan", "lsh-minhash", "lsh-simhash", "annoy", "pq", "ivfpq", "nsw", "hnsw"])
def test_every_index_finds_a_vector_itself(spark, kind):
    rng = random.Random(42)
    v = frame(spark, [{k: rng.random() + 0.1 for k in rng.sample(range(40), 10)} for _ in range(80)])
    params = {"pq": {"clusters": 80, "iterations": 1}, "ivfpq": {"clusters": 40, "coarse": 4, "iterations": 1}, "annoy": {"trees": 2, "max_points": 30}, "nsw": {"m": 8}, "hnsw": {"m": 8, "max_layers": 1}}.get(kind, {})
    got = create_index(kind, "cosine", **params).fit(v).search(knn.as_queries(v, "vec_id = 50"), 5).orderBy("rnk").collect()
    assert got[0].vec_id == 50 and len({r.vec_id for r in got}) == len(got)


def test_add_remove_save_load(spark, tmp_path):
    v = frame(spark, SIMPLE)
    q = knn.as_queries(v, "vec_id = 4")
    index = create_index("linscan", "euclidean").fit(v)
    gone = spark.createDataFrame([(2,), (77,)], "vec_id long")
    assert [r.vec_id for r in index.remove(gone).search(q, 3).orderBy("rnk").collect()] == [4, 0, 1]
    index.add(spark.createDataFrame([(9, 0, 9.0), (9, 2, 10.0)], LONG))
    assert [r.vec_id for r in index.search(q, 2).orderBy("rnk").collect()] == [4, 9]
    index.save(f"file://{tmp_path}/i")
    assert sorted(map(tuple, load_index(spark, f"file://{tmp_path}/i").search(q, 3).collect())) == sorted(map(tuple, index.search(q, 3).collect()))


def test_identical_points_end_the_forest(spark):
    v = frame(spark, [{0: 1.0}] * 30)
    assert create_index("annoy", "euclidean", trees=1, max_points=5).fit(v).search(knn.as_queries(v, "vec_id = 3"), 2).count() == 2


def test_graph_removal(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    assert [tuple(r) for r in graph.remove(links, spark.createDataFrame([(2,)], "vec_id long")).collect()] == [(0, 1)]


def test_beam_goes_on_while_it_improves(spark):
    v = frame(spark, [{0: float(i)} for i in range(8)])
    links = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long")
    entry = spark.createDataFrame([(7, 0)], "query_id long, vec_id long")
    got = graph.beam(v, knn.as_queries(v, "vec_id = 7"), links, entry, 2, name="euclidean").orderBy("rnk").collect()
    assert [(r.vec_id, r.distance) for r in got] == [(7, 0.0), (6, 1.0)]


def test_results_do_not_depend_on_partitions(spark):
    v = frame(spark, SIMPLE)
    one, many = (sorted(map(tuple, lsh.minhash(v.repartition(n), 3).collect())) for n in (1, 7))
    assert one == many


def test_metrics(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "query_id long, vec_id long")
    results = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 9)], "query_id long, rnk int, vec_id long")
    r = metrics.quality(results, truth, 3).first()
    assert (r.hits, r.recall, r.precision, r.f1) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert metrics.queries_per_second(100, 0.5) == 200 and metrics.queries_per_second(1, 0) == math.inf
    runs = spark.createDataFrame([(1000, 10, 100.0), (2000, 10, 210.0)], "dataset_size int, dims int, qps double")
    assert metrics.scalability(runs).orderBy("dataset_size").collect()[1].scalability_factor == pytest.approx(4.2)
    assert metrics.mean_median(spark.createDataFrame([(4,), (1,), (3,), (2,)], "x int"), "x").first().median == 2.5
    assert metrics.mean_median(spark.createDataFrame([], "x int"), "x").first().mean is None


def test_generator(spark):
    v = src.generate(spark, 100, 50, sparsity=0.8)
    assert abs(1 - v.count() / 5000 - 0.8) < 0.05 and v.filter("val < 0 or val >= 1").isEmpty()
    assert sorted(map(tuple, v.collect())) == sorted(map(tuple, src.generate(spark, 100, 50, sparsity=0.8).collect()))


def test_binary_files(spark, tmp_path):
    ptr, idx, val = [0, 2, 2, 3], [1, 3, 0], [0.5, 1.5, 2.5]
    (tmp_path / "x.csr").write_bytes(struct.pack("<3q", 3, 4, 3) + np.array(ptr, "<i8").tobytes() + np.array(idx, "<i4").tobytes() + np.array(val, "<f4").tobytes())
    assert sorted(tuple(r)[1:] for r in src.read_csr(spark, str(tmp_path / "x.csr")).collect()) == [(0, 1, 0.5), (0, 3, 1.5), (2, 0, 2.5)]
    (tmp_path / "x.gt").write_bytes(struct.pack("<2I", 1, 2) + np.array([7, 3], "<i4").tobytes() + np.array([0.1, 0.2], "<f4").tobytes())
    assert [r.vec_id for r in src.read_truth(spark, str(tmp_path / "x.gt")).orderBy("rnk").collect()] == [7, 3]


@pytest.mark.parametrize("encode,read", [(sinks.msgpack_vectors, files.read_msgpack), (sinks.csr, src.read_csr)])
def test_written_files_are_read_back(spark, tmp_path, encode, read):
    v = frame(spark, [{k: k / 2 for k in range(i % 4 + 1)} for i in range(23)]).repartition(3)
    folder = f"file://{tmp_path}/out"
    written = sinks.write_vectors(v, folder, encode, 5)
    assert written.select("file").distinct().count() > 4
    assert sorted(map(tuple, sinks.named(read(spark, folder), written, "vec_id").select("vec_id", "idx", "val").collect())) == sorted(map(tuple, v.select("vec_id", "idx", "val").collect()))


def test_saved_index_must_be_known(spark, tmp_path):
    from nearfield.plans import store

    store.save({"vectors": frame(spark, SIMPLE)}, {"kind": "btree", "tag": 9, "metric": "cosine", "params": {}}, f"file://{tmp_path}/i")
    with pytest.raises(ValueError, match="no known index"):
        load_index(spark, f"file://{tmp_path}/i")
    with pytest.raises(ValueError):
        create_index("pq", preset="tiny")
    assert create_index("nsw", preset="real", ef=7).params == {"m": 32, "ef": 7}


def test_encoder_must_give_terms(spark):
    docs = spark.createDataFrame([(1, "a a b")], "doc_id long, text string")
    assert {r.term: round(r.w, 6) for r in src.encode(docs, src.saturated).collect()} == {"a": round(math.log(3), 6), "b": round(math.log(2), 6)}
    with pytest.raises(ValueError):
        src.encode(docs, lambda d: d)


def test_empty_clusters_are_set_anew(spark):
    v = frame(spark, [{0: 1}, {0: 2}, {0: 3}, {1: 9}]).withColumn("g", F.lit(0))
    centers = kmeans.initial(v, 3)
    assigned = kmeans.assign(v, centers).withColumn("cid", F.lit(1))
    new = {r.cid: (r.idx, r.val) for r in kmeans.update(v, assigned, centers, turn=4).collect()}
    points = {(r.idx, r.val) for r in v.collect()}
    assert set(new) == {0, 1, 2} and new[0] in points and new[2] in points and new[0] != new[2]
    one = v.filter("vec_id = 0")
    few = {r.cid for r in kmeans.update(one, kmeans.assign(one, centers).withColumn("cid", F.lit(1)), centers).collect()}
    assert few == {0, 1, 2}


@pytest.mark.parametrize("kind", ["lsh-minhash", "annoy", "pq", "ivfpq", "nsw", "hnsw"])
def test_add_and_remove_change_what_was_built(spark, kind):
    v = src.generate(spark, 40, 60, sparsity=0.7)
    params = {"lsh-minhash": {}, "pq": {"clusters": 8, "iterations": 1, "rerank": 60}, "ivfpq": {"clusters": 4, "coarse": 3, "iterations": 1, "nprobe": 3, "rerank": 60}, "annoy": {"trees": 4, "max_points": 40}, "nsw": {"m": 8}, "hnsw": {"m": 8, "max_layers": 2}}[kind]
    index = create_index(kind, "cosine", **params).fit(v.filter("vec_id < 40")).add(v.filter("vec_id >= 40"))
    q = knn.as_queries(v, "vec_id in (3, 55)")
    found = index.search(q, 3).filter("rnk = 1").collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(3, 3), (55, 55)}
    index.remove(spark.createDataFrame([(55,), (3,), (99,)], "vec_id long"))
    left = index.search(q, 40).collect()
    assert left and not {r.vec_id for r in left} & {3, 55}


def test_positions_do_not_depend_on_partitions(spark):
    from nearfield.functions.vectors import ranked

    df = spark.createDataFrame([(i * 37 % 101, i % 5) for i in range(101)], "x long, y int").repartition(7)
    got = {r.x: r.position for r in ranked(df, "y", "x").collect()}
    assert got == {r.x: i for i, r in enumerate(df.orderBy("y", "x").collect())}


def test_command_line(spark, tmp_path, capsys):
    benchmark.main(["-i", "lsh-minhash", "-d", "60", "-f", "40", "-m", "jaccard", "--out", f"file://{tmp_path}"])
    assert "recall: " in capsys.readouterr().out
    (csv,) = (tmp_path / "lsh-minhash.csv").glob("part-*.csv")
    head, row = csv.read_text().split()
    assert head.startswith("execution_time,dataset_size,dataset_dimensionality,recall,precision,f1_score,scalability_factor,queries_per_second") and row.split(",")[2] == "60"


def test_names_are_checked(spark):
    assert metric("Cosine") == "cosine"
    with pytest.raises(ValueError):
        metric("hamming")
    with pytest.raises(ValueError):
        create_index("btree")
    with pytest.raises(ValueError):
        knn.knn(frame(spark, SIMPLE), knn.as_queries(frame(spark, SIMPLE), "vec_id = 0"), 0)
    assert norms(frame(spark, SIMPLE), spark.range(7).select(F.col("id").alias("vec_id"))).count() == 7


def pack(x) -> bytes:
    """MessagePack of lists, dicts, short strings, integers and floats."""
    if isinstance(x, list):
        return struct.pack(">BH", 0xDC, len(x)) + b"".join(map(pack, x))
    if isinstance(x, dict):
        return bytes([0x80 | len(x)]) + b"".join(pack(k) + pack(v) for k, v in x.items())
    if isinstance(x, str):
        return bytes([0xA0 | len(x)]) + x.encode()
    return struct.pack(">Bd", 0xCB, x) if isinstance(x, float) else bytes([x]) if x < 128 else struct.pack(">BI", 0xCE, x)


def test_msgpack_files(spark, tmp_path):
    (tmp_path / "data.msgpack").write_bytes(pack([{"indices": [3, 70000], "values": [0.5, 2.0]}, {"indices": [], "values": []}, {"indices": [1], "values": [1.5]}]))
    (tmp_path / "truth.msgpack").write_bytes(pack([[7, 300], [2]]))
    assert sorted(tuple(r)[1:] for r in files.read_msgpack(spark, str(tmp_path / "data.msgpack")).collect()) == [(0, 3, 0.5), (0, 70000, 2.0), (2, 1, 1.5)]
    assert sorted(tuple(r)[1:] for r in files.read_msgpack_truth(spark, str(tmp_path / "truth.msgpack")).collect()) == [(0, 1, 7), (0, 2, 300), (1, 1, 2)]
    kinds = b"\x97\xc0\xc3\xff\xd1\xff\x00\xca\x3f\x80\x00\x00\xc4\x01x\xd9\x01y"
    assert files.MessagePack(memoryview(kinds)).value() == [None, True, -1, -256, 1.0, b"x", "y"]
    with pytest.raises(ValueError):
        files.MessagePack(memoryview(b"\xd4\x01\x00")).value()


def test_bincode_files_and_data_sets(spark, tmp_path):
    vector = lambda i, v: struct.pack(f"<Q{len(i)}QQ{len(v)}f", len(i), *i, len(v), *v)
    data = struct.pack("<Q", 2) + vector([1, 5], [0.5, 1.5]) + vector([], []) + struct.pack("<Q", 1) + vector([5], [2.0]) + struct.pack("<QQ2Q", 1, 2, 0, 1)
    (tmp_path / "x.bin").write_bytes(data)
    got = files.read_bincode(spark, str(tmp_path / "x.bin"))
    want = [[(0, 1, 0.5), (0, 5, 1.5)], [(0, 5, 2.0)], [(0, 1, 0), (0, 2, 1)]]
    assert [sorted(tuple(r)[1:] for r in df.collect()) for df in got] == want
    files.save_dataset(*got, f"file://{tmp_path}/set")
    assert [sorted(tuple(r)[1:] for r in df.collect()) for df in files.load_dataset(spark, f"file://{tmp_path}/set")] == want


@pytest.mark.parametrize("kind", ["lsh-simhash", "annoy", "pq", "ivfpq", "nsw", "hnsw"])
def test_saved_indexes_answer_alike(spark, tmp_path, kind):
    v = src.generate(spark, 40, 60, sparsity=0.7)
    params = {"pq": {"clusters": 8, "iterations": 1}, "ivfpq": {"clusters": 4, "coarse": 3, "iterations": 1}, "annoy": {"trees": 2, "max_points": 20}, "nsw": {"m": 4}, "hnsw": {"m": 4, "max_layers": 1}}.get(kind, {})
    index, q = create_index(kind, "cosine", **params).fit(v), knn.as_queries(v, "vec_id < 3")
    index.save(f"file://{tmp_path}/i")
    assert sorted(map(tuple, load_index(spark, f"file://{tmp_path}/i").search(q, 3).collect())) == sorted(map(tuple, index.search(q, 3).collect()))


def test_benchmark_and_csv(spark, tmp_path):
    sweep = benchmark.Sweep(sparsity=0.8)
    assert list(sweep.configurations())[:2] == [(10_000, 1_000), (20_000, 2_000)] and len(list(sweep.configurations())) == 5
    vectors, queries, truth = benchmark.synthetic(spark, 50, 40, sweep)
    build, run = benchmark.measure(spark, create_index("linscan", "cosine"), vectors, queries, truth, 50, f"file://{tmp_path}/index")
    assert (run.recall, run.precision, run.f1_score) == (1, 1, 1) and run.index_disk_space > 0 and build.consumed_memory > 0
    benchmark.write_csv(spark, [benchmark.Build(10.0, 1000, 128, 1.0, 1.0)], benchmark.Build, f"file://{tmp_path}/b.csv")
    (csv,) = (tmp_path / "b.csv").glob("part-*.csv")
    assert csv.read_text().split() == ["execution_time,dataset_size,dataset_dimensionality,consumed_memory,consumed_cpu", "10.0,1000,128,1.0,1.0"]
    assert benchmark.scalability_factor(210.0, 2000, 10, benchmark.Run(*[0.0] * 1, 1000, 10, *[0.0] * 3, None, 100.0, *[0.0] * 7)) == pytest.approx(4.2)


def test_deadline(spark):
    slow = lambda: spark.range(8).select(F.expr("java_method('java.lang.Thread', 'sleep', 20000L)")).collect()
    began = time.perf_counter()
    assert measure.with_timeout(spark, slow, 1) is None and time.perf_counter() - began < 15
    assert measure.with_timeout(spark, lambda: spark.range(5).count(), 60) == 5
    with pytest.raises(ZeroDivisionError):
        measure.with_timeout(spark, lambda: 1 / 0, 60)


def test_stream_of_queries(spark, tmp_path):
    v = frame(spark, SIMPLE)
    index = create_index("linscan", "euclidean").fit(v)
    spark.createDataFrame([(0, [0, 2], [9.0, 10.0]), (1, [0, 2], [5.0, 6.0])], "query_id long, indices array<int>, `values` array<float>").write.parquet(f"file://{tmp_path}/in")
    asked = spark.readStream.schema("query_id long, indices array<int>, `values` array<float>").parquet(f"file://{tmp_path}/in")
    search_stream(index, asked, 1, f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.query_id, r.vec_id) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(0, 4), (1, 2)]


@pytest.mark.parametrize("kind,params", [("lsh-minhash", {"hashes": 10}), ("lsh-simhash", {"hashes": 10}), ("annoy", {"trees": 12, "max_points": 100}), ("nsw", {"m": 16}), ("hnsw", {"m": 16, "max_layers": 3}), ("pq", {"clusters": 16, "iterations": 2, "rerank": 300}), ("ivfpq", {"clusters": 16, "coarse": 4, "nprobe": 4, "iterations": 2, "rerank": 300})])
def test_recall_against_exact_search(spark, kind, params):
    v = src.generate(spark, 60, 400, sparsity=0.8)
    q = knn.as_queries(v, "vec_id % 40 = 0")
    got = create_index(kind, "cosine", **params).fit(v).search(q, 10)
    recall = metrics.quality(got, knn.knn(v, q, 10, "cosine"), 10).agg(F.avg("recall")).first()[0]
    print(kind, recall)
    assert recall >= 0.9
