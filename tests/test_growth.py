"""Steps that must not grow faster than their input: each gives what the plain way gives."""

import random

import numpy as np
import pytest

from nearfield import catalogue
from nearfield.functions.distances import METRICS
from nearfield.operators import blocks, graph, knn, lsh, pq, trees

LONG = "vec_id long, idx int, val double"


def vectors(spark, n=40, dims=30, most=4, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, k, float(rng.choice([-1, 1, 2, 3]))) for i in range(n) for k in rng.sample(range(dims), rng.randint(1, most))], LONG)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", ["jaccard", "cosine", "euclidean", "dot"])
def test_search_of_buckets_makes_no_row_for_every_candidate(spark, monkeypatch, name):
    v = vectors(spark)
    q, how = knn.as_queries(v, "vec_id < 8"), {"n_buckets": 7, "hashes": 2}
    plain = lsh.candidates(lsh.signed(v, **how), lsh.signed(q, key="query_id", **how))
    want = rows(knn.rerank(plain, v, q, 9, name), "query_id", "rnk", "vec_id", "distance")
    monkeypatch.delattr(lsh, "candidates")
    assert rows(lsh.lsh_knn(v, q, 9, name, **how), "query_id", "rnk", "vec_id", "distance") == want


def test_a_pair_that_shares_several_buckets_is_made_once(spark):
    v = vectors(spark)
    base, asked = (lsh.signed(x, n_buckets=5, hashes=6, key=key) for x, key in ((v, "vec_id"), (knn.as_queries(v, "vec_id < 9"), "query_id")))
    once = lsh.candidates(base, asked, 5)
    assert rows(once, "query_id", "vec_id") == rows(lsh.candidates(base, asked), "query_id", "vec_id")
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # above the join


def test_purchases_are_joined_once(spark):
    plan = catalogue.purchases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_codes_are_compared_once_whatever_the_number_of_their_vectors(spark, monkeypatch):
    """Sums of every vector, ties by id, and queries without distances in a list."""
    monkeypatch.setattr(pq, "SCAN_CODES", 5)
    rng = random.Random(4)
    codes = [(i, i % 2 * 3 + g, rng.randrange(2)) for i in range(60) for g in range(1 + i % 3)]
    table = [(q, g, c, round(rng.random(), 1)) for q in range(5) for g in range(6) if q % 3 != 2 or g < 3 for c in range(2)]
    found = pq.scan(spark.createDataFrame(codes, "vec_id long, g int, cid int"), spark.createDataFrame(table, "query_id long, g int, cid int, d double"), 3, 7)
    d, want = {(q, g, c): x for q, g, c, x in table}, []
    for q in range(5):
        sums = {}
        for i, g, c in codes:
            if (q, g, c) in d:
                sums[i] = sums.get(i, 0.0) + d[q, g, c]
        best = sorted((round(x, 9), i) for i, x in sums.items())[:7]
        want += [(q, r, i, x) for r, (x, i) in enumerate(best, 1)]
    assert [(a, b, c, round(x, 9)) for a, b, c, x in rows(found, "query_id", "rnk", "vec_id", "distance")] == want


@pytest.mark.parametrize("name", METRICS)
def test_blocks_give_what_a_join_gives(spark, monkeypatch, name):
    """With few rows a chunk, several blocks of the base and steps of a few products."""
    for limit, n in (("CHUNK", 20), ("STEP", 30), ("HELD", 4)):
        monkeypatch.setattr(blocks, limit, n)
    v = vectors(spark, n=60, dims=12)
    q = knn.as_queries(v, "vec_id < 11")
    every = knn.score(knn.overlaps(v, q), knn.norms(v), knn.norms(q, key="query_id"), name)
    found = blocks.nearest(v, q, 6, name)
    assert rows(knn.top_k(found, 6), "query_id", "rnk", "vec_id", "distance") == rows(knn.top_k(every, 6), "query_id", "rnk", "vec_id", "distance")
    assert rows(found.groupBy("query_id").sum("met"), "query_id", "sum(met)") == rows(every.groupBy("query_id").count(), "query_id", "count")


def test_rounding_is_sparks(spark):
    x = [0.0009765625, 0.1234567895, 1 / 3, 2.5e-10, 5e-10, 123456.0000000005, 7e7, 1e-12, -0.0000000005]
    want = [r.y for r in spark.createDataFrame([(i, a) for i, a in enumerate(x)], "i int, x double").selectExpr("i", "round(x, 9) + 0.0 as y").orderBy("i").collect()]
    assert blocks.half_up(np.array(x)).tolist() == want


@pytest.mark.parametrize("name", ["cosine", "euclidean", "dot"])
def test_every_node_has_its_nearest_before_it(spark, name):
    """Those without an entry in common too, where there are no nearer ones."""
    v = vectors(spark, n=50, dims=40)
    turn = {r.vec_id: r.turn for r in graph.insertion(v.select("vec_id").distinct()).collect()}
    every = spark.createDataFrame([(a, b) for a in turn for b in turn if turn[b] < turn[a]], "query_id long, vec_id long")
    want = rows(knn.rerank(every, v, knn.as_queries(v, "true"), 5, name), "query_id", "vec_id")
    assert rows(graph.edges(v, 5, name), "src", "dst") == sorted(want + [(b, a) for a, b in want])


def test_pivots_of_deep_nodes(spark):
    """Their numbers times a coefficient don't fit a long."""
    at = spark.createDataFrame([(i, 0, 2**58 + i % 2) for i in range(10)], "vec_id long, tree int, node long")
    assert trees.pivots(at, 1).count() == 4


def test_search_of_leaves_makes_no_row_for_every_mate(spark, monkeypatch):
    v = vectors(spark)
    q, forest = knn.as_queries(v, "vec_id < 8"), trees.Forest.fit(v, 2, 6, "cosine")
    mates = forest.down(q, v, "query_id").join(forest.leaves, ["tree", "node"]).select("query_id", "vec_id")
    want = rows(knn.rerank(mates, v, q, 9, "cosine"), "query_id", "rnk", "vec_id", "distance")
    monkeypatch.setattr(trees, "rerank", None, raising=False)
    assert rows(forest.search(v, q, 9), "query_id", "rnk", "vec_id", "distance") == want
