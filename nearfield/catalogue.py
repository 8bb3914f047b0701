"""Registered queries of the vector engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import benchmark
from nearfield.functions import metrics
from nearfield.functions.distances import METRICS
from nearfield.functions.vectors import PRIME, coefficients, from_arrays, norms, renumber, split_by_position, to_arrays
from nearfield.index import PRESETS, TAGS, create_index, load_index
from nearfield.operators import graph, kmeans, knn, lsh, pq, trees
from nearfield.plans import store
from nearfield.sources import files, sinks
from nearfield.sources import vectors as src

K = 10
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PURCHASE = "purchase AS (SELECT o_custkey AS vec_id, CAST(l_partkey AS INTEGER) AS idx, sum(l_quantity) AS val FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"
NORMS = "norms AS (SELECT vec_id, sum(val * val) AS n2, count(*) AS nnz FROM purchase GROUP BY 1)"


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases for queries that read them several times: joined and summed once."""
    return store.cut(src.purchase(spark, sf))


def every_hundredth(v: DataFrame) -> DataFrame:
    return knn.as_queries(v, F.col("vec_id") % 100 == 0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def hash_sql(x: str, seed: int, j: int) -> str:
    a, b = coefficients(seed, j)
    return f"(({a}::BIGINT * (({x}) % {PRIME}) + {b}) % {PRIME})"


def distance_sql(name: str) -> str:
    cos = "(CASE WHEN qn2 = 0 OR bn2 = 0 THEN 0.0 ELSE dot / (sqrt(qn2) * sqrt(bn2)) END)"
    return {
        "dot": "dot", "inner_product": "-dot", "euclidean": "sqrt(greatest(qn2 + bn2 - 2 * dot, 0.0))", "cosine": f"1 - {cos}",
        "jaccard": "1 - (CASE WHEN qnnz + bnnz = 0 THEN 1.0 ELSE inter / (qnnz + bnnz - inter) END)", "angular": f"acos(least(1.0, greatest(-1.0, {cos}))) / 3.141592653589793",
    }[name]


def pairs_sql(where: str = "vec_id % 100 = 0") -> str:
    return f"""WITH {PURCHASE}, {NORMS},
        q AS (SELECT vec_id AS query_id, idx, val AS qv FROM purchase WHERE {where}),
        o AS (SELECT query_id, vec_id, sum(qv * val) AS dot, count(*) AS inter FROM q JOIN purchase USING (idx) GROUP BY 1, 2),
        p AS (SELECT a.vec_id AS query_id, b.vec_id, coalesce(dot, 0.0) AS dot, coalesce(inter, 0) AS inter, a.n2 AS qn2, a.nnz AS qnnz, b.n2 AS bn2, b.nnz AS bnnz
              FROM (SELECT * FROM norms WHERE {where}) a CROSS JOIN norms b LEFT JOIN o ON o.query_id = a.vec_id AND o.vec_id = b.vec_id)"""


def knn_sql(name: str, k: int = K, base: str = "true") -> str:
    return f"""{pairs_sql()}, d AS (SELECT query_id, vec_id, {distance_sql(name)} AS d FROM p WHERE {base}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rnk FROM d)
        SELECT query_id, rnk::INTEGER AS rnk, vec_id, round(round(d, 9), 6) + 0.0 AS distance FROM r WHERE rnk <= {k}"""


# --- sources -----------------------------------------------------------------

query("vec_purchase", f"WITH {PURCHASE} SELECT * FROM purchase")(src.purchase)

TERMS = r"terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(regexp_replace(text, '[\r\n\t]+', ' ', 'g')), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2)"
IDF = "n AS (SELECT count(DISTINCT doc_id) AS n FROM terms), idf AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM terms GROUP BY 1)"


@query("vec_doc_tf", f"WITH {TERMS} SELECT * FROM terms")
def vec_doc_tf(spark, sf):
    return src.terms(src.table(spark, sf, "documents"))


@query("vec_doc_tfidf", f"WITH {TERMS}, {IDF}, raw AS (SELECT doc_id, term, tf * idf AS w FROM terms JOIN idf USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1) SELECT doc_id, term, round(w / norm, 6) + 0.0 AS w FROM raw JOIN l USING (doc_id)")
def vec_doc_tfidf(spark, sf):
    return rounded(src.tfidf(src.terms(src.table(spark, sf, "documents"))), "w")


@query("vec_embed_sparse", "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS idx, unnest(embedding) AS x FROM embeddings) SELECT vec_id, idx::INTEGER AS idx, round(x::DOUBLE, 6) + 0.0 AS val FROM e WHERE abs(x) >= 0.15")
def vec_embed_sparse(spark, sf):
    return rounded(src.sparse_embeddings(src.table(spark, sf, "embeddings")), "val")


@query("array_form", f"WITH {PURCHASE} SELECT vec_id, list(idx ORDER BY idx)::VARCHAR AS indices, len(list(idx))::INTEGER AS nnz FROM purchase GROUP BY 1")
def array_form(spark, sf):
    return to_arrays(src.purchase(spark, sf)).select("vec_id", F.concat(F.lit("["), F.array_join("indices", ", "), F.lit("]")).alias("indices"), F.size("values").alias("nnz"))


# --- norms, postings, statistics --------------------------------------------


@query("norms_nnz", f"WITH {PURCHASE}, {NORMS} SELECT * FROM norms")
def norms_nnz(spark, sf):
    return norms(src.purchase(spark, sf))


@query("inverted_postings", f"WITH {PURCHASE} SELECT idx, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last, sum(val) AS total FROM purchase GROUP BY 1")
def inverted_postings(spark, sf):
    return src.purchase(spark, sf).groupBy("idx").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.sum("val").alias("total"))


@query("sparsity_hist", f"WITH {PURCHASE}, {NORMS} SELECT nnz, count(*) AS n FROM norms GROUP BY 1")
def sparsity_hist(spark, sf):
    return metrics.sparsity_histogram(norms(src.purchase(spark, sf)))


@query("sparsity_mean_median", f"WITH {PURCHASE}, {NORMS} SELECT round(avg(nnz), 6) + 0.0 AS mean, median(nnz)::DOUBLE AS median FROM norms")
def sparsity_mean_median(spark, sf):
    return rounded(metrics.mean_median(norms(src.purchase(spark, sf)), "nnz"), "mean")


@query("nn_distance_hist", f"WITH d AS ({knn_sql('euclidean', 1, 'query_id <> vec_id')}) SELECT floor(distance / 10)::BIGINT AS bin, count(*) AS n FROM d GROUP BY 1")
def nn_distance_hist(spark, sf):
    v = purchases(spark, sf)
    near = knn.knn(v, every_hundredth(v), 2, "euclidean").filter("query_id <> vec_id").groupBy("query_id").agg(F.min("distance").alias("d"))
    return near.groupBy(F.floor(F.round("d", 6) / 10).alias("bin")).agg(F.count("*").alias("n"))


@query("renumber", "SELECT c_custkey AS vec_id, (row_number() OVER (ORDER BY c_custkey) - 1)::INTEGER AS position FROM customer WHERE c_custkey % 7 <> 0")
def renumber_query(spark, sf):
    return renumber(src.table(spark, sf, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("vec_id")))


# --- exact search ---------------------------------------------------------------

for _name in METRICS:

    @query(f"dist_{_name}", f"{pairs_sql()} SELECT query_id, vec_id, round(round({distance_sql(_name)}, 9), 6) + 0.0 AS distance FROM p WHERE inter > 0")
    def dist(spark, sf, name=_name):
        v = purchases(spark, sf)
        q = every_hundredth(v)
        return rounded(knn.score(knn.overlaps(v, q), norms(v), norms(q, key="query_id"), name), "distance").select("query_id", "vec_id", "distance")

    @query(f"knn_{_name}", knn_sql(_name))
    def exact(spark, sf, name=_name):
        v = purchases(spark, sf)
        return rounded(knn.knn(v, every_hundredth(v), K, name), "distance").select("query_id", "rnk", "vec_id", "distance")


@query("knn_after_remove", knn_sql("cosine", K, "vec_id % 3 <> 0"))
def knn_after_remove(spark, sf):
    v = purchases(spark, sf)
    gone = v.filter("vec_id % 3 = 0").select("vec_id").distinct()
    return rounded(knn.knn(knn.remove(v, gone), every_hundredth(v), K, "cosine"), "distance").select("query_id", "rnk", "vec_id", "distance")


@query("knn_after_add", knn_sql("euclidean"))
def knn_after_add(spark, sf):
    v = purchases(spark, sf)
    index = create_index("linscan", "euclidean").fit(v.filter("vec_id % 2 = 0")).add(v.filter("vec_id % 2 = 1"))
    return rounded(index.search(every_hundredth(v), K), "distance").select("query_id", "rnk", "vec_id", "distance")


@query("centroid_top", f"WITH {PURCHASE}, {NORMS} SELECT vec_id, n2 FROM norms ORDER BY n2 DESC, vec_id LIMIT 10")
def centroid_top(spark, sf):
    return norms(src.purchase(spark, sf)).select("vec_id", "n2").orderBy(F.desc("n2"), "vec_id").limit(10)


# --- locality-sensitive hashing ---------------------------------------------

#: One table for all functions, as the benchmark's preset has it, with ten functions.
LSH = {"n_buckets": 32, "hashes": 10}
HASHES, BUCKETS = LSH["hashes"], LSH["n_buckets"]
MINHASH = f"sig AS ({' UNION ALL '.join(f'SELECT vec_id, {j} AS j, min({hash_sql('idx + 1', 1, j)}) AS h FROM purchase GROUP BY 1' for j in range(HASHES))})"


def _simhash_sql() -> str:
    bit = lambda j, b: f"(CASE WHEN sum(val * (CASE WHEN {hash_sql('idx + 1', 1001, j * 64 + b)} < {PRIME // 2} THEN 1 ELSE -1 END)) > 0 THEN {1 << b} ELSE 0 END)"
    return f"sig AS ({' UNION ALL '.join(f'SELECT vec_id, {j} AS j, ({" + ".join(bit(j, b) for b in range(lsh.BITS))})::BIGINT AS h FROM purchase GROUP BY 1' for j in range(HASHES))})"


def _buckets_sql(sig: str) -> str:
    return f"{sig}, b AS (SELECT DISTINCT vec_id, 0 AS j, h % {BUCKETS} AS bucket FROM sig)"


CANDIDATES = "c AS (SELECT DISTINCT x.vec_id AS query_id, y.vec_id FROM b x JOIN b y USING (j, bucket) WHERE x.vec_id % 100 = 0)"


def ranked_sql(candidates: str, metric: str, where: str = "true") -> str:
    """The K nearest of the pairs in c."""
    return f"""{candidates}, d AS (SELECT query_id, vec_id, {distance_sql(metric)} AS d FROM p JOIN c USING (query_id, vec_id) WHERE {where}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rnk FROM d)
        SELECT query_id, rnk::INTEGER AS rnk, vec_id, round(round(d, 9), 6) + 0.0 AS distance FROM r WHERE rnk <= {K}"""


def _lsh_sql(sig: str, where: str = "true") -> str:
    return f"{pairs_sql()}, {_buckets_sql(sig)}, {ranked_sql(CANDIDATES, 'jaccard', where)}"


@query("minhash_signature", f"WITH {PURCHASE}, {MINHASH} SELECT vec_id, j::INTEGER AS j, h FROM sig")
def minhash_signature(spark, sf):
    return lsh.minhash(src.purchase(spark, sf), HASHES)


@query("simhash_signature", f"WITH {PURCHASE}, {_simhash_sql()} SELECT vec_id, j::INTEGER AS j, h FROM sig")
def simhash_signature(spark, sf):
    return lsh.simhash(src.purchase(spark, sf), HASHES)


@query("lsh_buckets", f"WITH {PURCHASE}, {_buckets_sql(MINHASH)} SELECT vec_id, j::INTEGER AS j, bucket FROM b")
def lsh_buckets(spark, sf):
    index = create_index("lsh-minhash", "jaccard", **LSH).fit(src.purchase(spark, sf))
    return index.table


@query("minhash_candidates", f"WITH {PURCHASE}, {_buckets_sql(MINHASH)}, {CANDIDATES} SELECT * FROM c")
def minhash_candidates(spark, sf):
    v = purchases(spark, sf)
    return lsh.candidates(lsh.signed(v, "minhash", **LSH), lsh.signed(every_hundredth(v), "minhash", key="query_id", **LSH), BUCKETS)


def _band_sql(band: int) -> str:
    times = " ".join(f"WHEN {j} THEN {coefficients(j, 2)[0]}" for j in range(HASHES))
    return f"b AS (SELECT vec_id, j // {band} AS j, sum((h * (CASE j {times} END)::BIGINT) % {PRIME})::BIGINT % {PRIME} AS bucket FROM sig GROUP BY 1, 2)"


@query("lsh_banded_candidates", f"WITH {PURCHASE}, {MINHASH}, {_band_sql(2)}, {CANDIDATES} SELECT * FROM c")
def lsh_banded_candidates(spark, sf):
    v, how = purchases(spark, sf), {"n_buckets": None, "hashes": HASHES, "shared": False, "band": 2}
    return lsh.candidates(lsh.signed(v, **how), lsh.signed(every_hundredth(v), key="query_id", **how))


def _nearest(index, v):
    return rounded(index.search(every_hundredth(v), K), "distance").select("query_id", "rnk", "vec_id", "distance")


@query("lsh_minhash_knn", _lsh_sql(MINHASH))
def lsh_minhash_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("lsh-minhash", "jaccard", **LSH).fit(v), v)


@query("lsh_simhash_knn", _lsh_sql(_simhash_sql()))
def lsh_simhash_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("lsh-simhash", "jaccard", **LSH).fit(v), v)


def halves(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    return v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1")


def thirds(v: DataFrame) -> DataFrame:
    """Ids to remove: every third, and one that isn't there."""
    return v.filter("vec_id % 3 = 0").select("vec_id").distinct().union(v.sparkSession.createDataFrame([(-5,)], "vec_id long"))


@query("lsh_after_add", _lsh_sql(MINHASH))
def lsh_after_add(spark, sf):
    v = purchases(spark, sf)
    old, new = halves(v)
    return _nearest(create_index("lsh-minhash", "jaccard", **LSH).fit(old).add(new), v)


@query("lsh_after_remove", _lsh_sql(MINHASH, "vec_id % 3 <> 0"))
def lsh_after_remove(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("lsh-minhash", "jaccard", **LSH).fit(v).remove(thirds(v)), v)


# --- k-means and quantisation ---------------------------------------------------

PARTS, CLUSTERS = 4, 8


def _init_sql(points: str, out: str, k: int) -> str:
    return f"""{out} AS (SELECT p.g, cid, idx, val FROM {points} p JOIN (SELECT g, vec_id, row_number() OVER (PARTITION BY g ORDER BY {hash_sql("vec_id + 1", 1, 0)}, vec_id) - 1 AS cid
        FROM (SELECT DISTINCT g, vec_id FROM {points})) i USING (g, vec_id) WHERE cid < {k})"""


def _assign_sql(points: str, centers: str, out: str) -> str:
    return f"""{out}_d AS (SELECT p.g, vec_id, cid, sum(p.val * c.val) AS dot FROM {points} p JOIN {centers} c USING (g, idx) GROUP BY 1, 2, 3),
        {out}_p AS (SELECT g, vec_id, sum(val * val) AS qn2 FROM {points} GROUP BY 1, 2), {out}_c AS (SELECT g, cid, sum(val * val) AS bn2 FROM {centers} GROUP BY 1, 2),
        {out}_r AS (SELECT p.g, p.vec_id, c.cid, sqrt(greatest(qn2 + bn2 - 2 * coalesce(dot, 0.0), 0.0)) AS distance FROM {out}_p p JOIN {out}_c c USING (g) LEFT JOIN {out}_d d ON d.g = p.g AND d.vec_id = p.vec_id AND d.cid = c.cid),
        {out} AS (SELECT g, vec_id, cid, distance FROM (SELECT *, row_number() OVER (PARTITION BY g, vec_id ORDER BY round(distance, 9), cid) AS r FROM {out}_r) WHERE r = 1)"""


def _update_sql(points: str, assigned: str, centers: str, out: str, turn: int = 0) -> str:
    order = hash_sql("vec_id + 1", 1, 21 + turn)
    return f"""{out}_n AS (SELECT g, cid, count(*) AS size FROM {assigned} GROUP BY 1, 2), {out}_s AS (SELECT p.g, cid, idx, sum(val) AS s FROM {points} p JOIN {assigned} a USING (g, vec_id) GROUP BY 1, 2, 3),
        {out}_e AS (SELECT g, cid, row_number() OVER (PARTITION BY g ORDER BY cid) AS r FROM (SELECT DISTINCT g, cid FROM {centers}) ANTI JOIN {out}_n USING (g, cid)),
        {out}_f AS (SELECT g, cid, vec_id FROM (SELECT g, vec_id, row_number() OVER (PARTITION BY g ORDER BY {order}, vec_id) AS r FROM (SELECT DISTINCT g, vec_id FROM {points})) JOIN {out}_e USING (g, r)),
        {out} AS (SELECT c.g, c.cid, c.idx, coalesce(s, 0.0) / size AS val FROM {centers} c JOIN {out}_n n ON n.g = c.g AND n.cid = c.cid LEFT JOIN {out}_s t ON t.g = c.g AND t.cid = c.cid AND t.idx = c.idx
            UNION ALL SELECT f.g, f.cid, p.idx, p.val FROM {out}_f f JOIN {points} p USING (g, vec_id) UNION ALL SELECT c.g, c.cid, c.idx, c.val FROM {centers} c JOIN {out}_e USING (g, cid) ANTI JOIN {out}_f USING (g, cid))"""


def _split_sql(source: str, parts: int, out: str, key: str = "vec_id") -> str:
    return f"""{out} AS (SELECT {key}, idx, val, (CASE WHEN p < (n % {parts}) * (n // {parts} + 1) THEN p // (n // {parts} + 1) ELSE n % {parts} + (p - (n % {parts}) * (n // {parts} + 1)) // greatest(n // {parts}, 1) END)::INTEGER AS g
        FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY idx) - 1 AS p, count(*) OVER (PARTITION BY {key}) AS n FROM {source}))"""


ONE = "pts AS (SELECT 0 AS g, * FROM purchase)"
STEP1 = f"{ONE}, {_init_sql('pts', 'c0', CLUSTERS)}, {_assign_sql('pts', 'c0', 'a0')}, {_update_sql('pts', 'a0', 'c0', 'c1')}"


def _one(spark, sf):
    return purchases(spark, sf).withColumn("g", F.lit(0))


@query("kmeans_assign", f"WITH {PURCHASE}, {ONE}, {_init_sql('pts', 'c0', CLUSTERS)}, {_assign_sql('pts', 'c0', 'a0')} SELECT vec_id, cid::INTEGER AS cid, round(distance, 6) + 0.0 AS distance FROM a0")
def kmeans_assign(spark, sf):
    p = _one(spark, sf)
    return rounded(kmeans.assign(p, kmeans.initial(p, CLUSTERS)), "distance").drop("g")


@query("kmeans_1step", f"WITH {PURCHASE}, {STEP1} SELECT cid::INTEGER AS cid, idx, round(val, 6) + 0.0 AS val FROM c1")
def kmeans_1step(spark, sf):
    return rounded(kmeans.lloyd(_one(spark, sf), CLUSTERS, 1, 0.0), "val").drop("g")


@query("kmeans_3step", f"WITH {PURCHASE}, {STEP1}, {_assign_sql('pts', 'c1', 'a1')}, {_update_sql('pts', 'a1', 'c1', 'c2', 1)}, {_assign_sql('pts', 'c2', 'a2')}, {_update_sql('pts', 'a2', 'c2', 'c3', 2)} SELECT cid::INTEGER AS cid, idx, round(val, 6) + 0.0 AS val FROM c3")
def kmeans_3step(spark, sf):
    return rounded(kmeans.lloyd(_one(spark, sf), CLUSTERS, 3, 0.0), "val").drop("g")


@query("kmeans_init", f"WITH {PURCHASE}, {ONE}, {_init_sql('pts', 'c0', CLUSTERS)} SELECT cid::INTEGER AS cid, idx, val FROM c0")
def kmeans_init(spark, sf):
    return kmeans.initial(_one(spark, sf), CLUSTERS).drop("g")


@query("kmeans_reseed", f"WITH {PURCHASE}, {ONE}, {_init_sql('pts', 'c0', CLUSTERS)}, {_assign_sql('pts', 'c0', 'every')}, a0 AS (SELECT * FROM every WHERE cid NOT IN (2, 5)), {_update_sql('pts', 'a0', 'c0', 'c1')} SELECT cid::INTEGER AS cid, idx, round(val, 6) + 0.0 AS val FROM c1")
def kmeans_reseed(spark, sf):
    p = _one(spark, sf)
    centers = kmeans.initial(p, CLUSTERS)
    return rounded(kmeans.update(p, kmeans.assign(p, centers).filter("cid not in (2, 5)"), centers), "val").drop("g")


@query("kmeans_stop", f"WITH {PURCHASE}, {STEP1} SELECT cid::INTEGER AS cid, idx, round(val, 6) + 0.0 AS val FROM c1")
def kmeans_stop(spark, sf):
    return rounded(kmeans.lloyd(_one(spark, sf), CLUSTERS, 5, 1e9), "val").drop("g")


BOOKS = f"{_split_sql('purchase', PARTS, 'pts')}, {_init_sql('pts', 'c0', CLUSTERS)}, {_assign_sql('pts', 'c0', 'a0')}, {_update_sql('pts', 'a0', 'c0', 'c1')}, {_assign_sql('pts', 'c1', 'codes')}"


@query("pq_split", f"WITH {PURCHASE}, {_split_sql('purchase', PARTS, 'pts')} SELECT vec_id, idx, val, g AS m FROM pts")
def pq_split(spark, sf):
    return split_by_position(src.purchase(spark, sf), PARTS)


@query("pq_codes", f"WITH {PURCHASE}, {BOOKS} SELECT vec_id, g, cid::INTEGER AS cid FROM codes")
def pq_codes(spark, sf):
    v = purchases(spark, sf)
    return pq.encode(v, pq.train(v, PARTS, CLUSTERS, 1, 0.0), PARTS)


def _pq_sql(where: str = "true", found: str | None = None) -> str:
    return f"""t_d AS (SELECT p.g, vec_id AS query_id, cid, sum(p.val * c.val) AS dot FROM pts p JOIN c1 c USING (g, idx) WHERE vec_id % 100 = 0 GROUP BY 1, 2, 3),
        t_p AS (SELECT g, vec_id AS query_id, sum(val * val) AS qn2 FROM pts WHERE vec_id % 100 = 0 GROUP BY 1, 2), t_c AS (SELECT g, cid, sum(val * val) AS bn2 FROM c1 GROUP BY 1, 2),
        t AS (SELECT p.g, p.query_id, c.cid, sqrt(greatest(qn2 + bn2 - 2 * coalesce(dot, 0.0), 0.0)) AS d FROM t_p p JOIN t_c c USING (g) LEFT JOIN t_d ON t_d.g = p.g AND t_d.query_id = p.query_id AND t_d.cid = c.cid),
        s AS (SELECT query_id, vec_id, sum(d) AS d FROM codes JOIN t USING (g, cid) WHERE {where} GROUP BY 1, 2), ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rnk FROM s)
        {", " + found if found else f"SELECT query_id, rnk::INTEGER AS rnk, vec_id, round(d, 6) + 0.0 AS distance FROM ranks WHERE rnk <= {K}"}"""


PQ = {"parts": PARTS, "clusters": CLUSTERS, "iterations": 1, "tolerance": 0.0}


@query("pq_knn", f"WITH {PURCHASE}, {BOOKS}, {_pq_sql()}")
def pq_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("pq", "euclidean", **PQ).fit(v), v)


@query("pq_after_remove", f"WITH {PURCHASE}, {BOOKS}, {_pq_sql('vec_id % 3 <> 0')}")
def pq_after_remove(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("pq", "euclidean", **PQ).fit(v).remove(thirds(v)), v)


HALF_BOOKS = f"{_split_sql('purchase', PARTS, 'pts')}, half AS (SELECT * FROM pts WHERE vec_id % 2 = 0), {_init_sql('half', 'c0', CLUSTERS)}, {_assign_sql('half', 'c0', 'a0')}, {_update_sql('half', 'a0', 'c0', 'c1')}, {_assign_sql('pts', 'c1', 'codes')}"


@query("pq_after_add", f"WITH {PURCHASE}, {HALF_BOOKS} SELECT vec_id, g, cid::INTEGER AS cid FROM codes")
def pq_after_add(spark, sf):
    old, new = halves(purchases(spark, sf))
    return create_index("pq", "euclidean", **PQ).fit(old).add(new).codes


@query("pq_rerank_knn", f"{pairs_sql()}, {BOOKS}, {_pq_sql(found=ranked_sql('c AS (SELECT query_id, vec_id FROM ranks WHERE rnk <= 100)', 'euclidean'))}")
def pq_rerank_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("pq", "euclidean", rerank=100, **PQ).fit(v), v)


@query("ivf_coarse", f"WITH {PURCHASE}, {STEP1}, {_assign_sql('pts', 'c1', 'a1')} SELECT cid::INTEGER AS list, count(*) AS n FROM a1 GROUP BY 1")
def ivf_coarse(spark, sf):
    p = _one(spark, sf)
    return kmeans.assign(p, kmeans.lloyd(p, CLUSTERS, 1, 0.0)).groupBy(F.col("cid").alias("list")).agg(F.count("*").alias("n"))


COARSE, PROBES = 6, 3
IVF = PQ | {"coarse": COARSE, "nprobe": PROBES}


def _ivf_sql(base: str = "true") -> str:
    """lists and codes of all vectors, by clusters and codebooks of those that base selects."""
    return f"""{_split_sql("purchase", PARTS, "cut")}, one AS (SELECT 0 AS g, * FROM purchase), ones AS (SELECT * FROM one WHERE {base}),
        {_init_sql("ones", "k0", COARSE)}, {_assign_sql("ones", "k0", "l0")}, {_update_sql("ones", "l0", "k0", "k1")}, {_assign_sql("one", "k1", "lists")},
        pts AS (SELECT cid * {PARTS} + c.g AS g, vec_id, idx, val FROM cut c JOIN (SELECT vec_id, cid FROM lists) USING (vec_id)), mine AS (SELECT * FROM pts WHERE {base}),
        {_init_sql("mine", "c0", CLUSTERS)}, {_assign_sql("mine", "c0", "a0")}, {_update_sql("mine", "a0", "c0", "c1")}, {_assign_sql("pts", "c1", "codes")}"""


PROBE = f"""pr_d AS (SELECT vec_id, cid, sum(p.val * c.val) AS dot FROM one p JOIN k1 c USING (g, idx) GROUP BY 1, 2), pr_c AS (SELECT cid, sum(val * val) AS bn2 FROM k1 GROUP BY 1),
    pr AS (SELECT n.vec_id AS query_id, c.cid AS list, row_number() OVER (PARTITION BY n.vec_id ORDER BY round(sqrt(greatest(n2 + bn2 - 2 * coalesce(dot, 0.0), 0.0)), 9), c.cid) AS r
        FROM (SELECT vec_id, sum(val * val) AS n2 FROM purchase WHERE vec_id % 100 = 0 GROUP BY 1) n CROSS JOIN pr_c c LEFT JOIN pr_d d ON d.vec_id = n.vec_id AND d.cid = c.cid),
    probes AS (SELECT query_id, list FROM pr WHERE r <= {PROBES})"""
PROBED = f"""qs AS (SELECT query_id, list * {PARTS} + c.g AS g, idx, val FROM cut c JOIN probes ON query_id = vec_id), t_d AS (SELECT q.g, query_id, cid, sum(q.val * c.val) AS dot FROM qs q JOIN c1 c USING (g, idx) GROUP BY 1, 2, 3),
    t_p AS (SELECT g, query_id, sum(val * val) AS qn2 FROM qs GROUP BY 1, 2), t_c AS (SELECT g, cid, sum(val * val) AS bn2 FROM c1 GROUP BY 1, 2),
    t AS (SELECT p.g, p.query_id, c.cid, sqrt(greatest(qn2 + bn2 - 2 * coalesce(dot, 0.0), 0.0)) AS d FROM t_p p JOIN t_c c USING (g) LEFT JOIN t_d ON t_d.g = p.g AND t_d.query_id = p.query_id AND t_d.cid = c.cid)"""


def _ivfpq_sql(base: str = "true", where: str = "true") -> str:
    return f"""WITH {PURCHASE}, {_ivf_sql(base)}, {PROBE}, {PROBED}, s AS (SELECT query_id, vec_id, sum(d) AS d FROM codes JOIN t USING (g, cid) WHERE {where} GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rnk FROM s) SELECT query_id, rnk::INTEGER AS rnk, vec_id, round(d, 6) + 0.0 AS distance FROM r WHERE rnk <= {K}"""


@query("ivf_probe", f"WITH {PURCHASE}, {_ivf_sql()}, {PROBE} SELECT query_id, list::INTEGER AS list FROM probes")
def ivf_probe(spark, sf):
    v = purchases(spark, sf)
    return create_index("ivfpq", "euclidean", **IVF).fit(v).inverted.probes(every_hundredth(v), PROBES)


@query("ivfpq_codes", f"WITH {PURCHASE}, {_ivf_sql()} SELECT vec_id, g::INTEGER AS g, cid::INTEGER AS cid FROM codes")
def ivfpq_codes(spark, sf):
    return create_index("ivfpq", "euclidean", **IVF).fit(purchases(spark, sf)).inverted.codes


@query("ivfpq_knn", _ivfpq_sql())
def ivfpq_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("ivfpq", "euclidean", **IVF).fit(v), v)


@query("ivfpq_after_add", _ivfpq_sql("vec_id % 2 = 0"))
def ivfpq_after_add(spark, sf):
    v = purchases(spark, sf)
    old, new = halves(v)
    return _nearest(create_index("ivfpq", "euclidean", **IVF).fit(old).add(new), v)


@query("ivfpq_after_remove", _ivfpq_sql(where="vec_id % 3 <> 0"))
def ivfpq_after_remove(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("ivfpq", "euclidean", **IVF).fit(v).remove(thirds(v)), v)


# --- trees and graphs -------------------------------------------------------------


TREES = {"trees": 16, "max_points": 300}
#: Levels that the SQL below unrolls; those beyond the forest's depth are empty.
DEPTH = 14


def _tree_sql(base: str = "true") -> str:
    """leaves (tree, vec_id, node) of all vectors in a forest grown on those that base selects."""
    a, b = coefficients(1, 1)
    order = f"(({b}::BIGINT * (({hash_sql('vec_id + 1', 1, 1)} + tree * 7919 + node * 104729) % {PRIME}) + {a}) % {PRIME})"
    out = [f"n0 AS MATERIALIZED (SELECT vec_id, n2, t AS tree, 1::BIGINT AS node, 0::BIGINT AS before, 0 AS stuck, {base} AS own FROM norms, range({TREES['trees']}) r(t))"]
    for x in range(DEPTH):
        out.append(f"""z{x} AS (SELECT tree, node, count(*) FILTER (WHERE own) AS n FROM n{x} GROUP BY 1, 2), m{x} AS MATERIALIZED (SELECT vec_id, n2, tree, node, own, n AS before, CASE WHEN n = before THEN stuck + 1 ELSE 0 END AS stuck FROM n{x} JOIN z{x} USING (tree, node)),
            i{x} AS MATERIALIZED (SELECT * FROM m{x} WHERE before > {TREES["max_points"]} AND stuck < {trees.STUCK}),
            v{x} AS MATERIALIZED (SELECT tree, node, vec_id AS pivot, n2 AS bn2, row_number() OVER (PARTITION BY tree, node ORDER BY {order}, vec_id) AS side FROM i{x} WHERE own QUALIFY side <= 2),
            e{x} AS (SELECT tree, side, i.vec_id, sum(a.val * b.val) AS dot FROM i{x} i JOIN v{x} v USING (tree, node) JOIN purchase a ON a.vec_id = i.vec_id JOIN purchase b ON b.vec_id = v.pivot AND b.idx = a.idx GROUP BY 1, 2, 3),
            g{x} AS (SELECT i.tree, i.vec_id, i.n2, i.node, i.before, i.stuck, i.own, side, round(1 - coalesce(dot, 0.0) / sqrt(i.n2 * bn2), 9) AS d FROM i{x} i JOIN v{x} USING (tree, node) LEFT JOIN e{x} e USING (tree, side, vec_id)),
            n{x + 1} AS MATERIALIZED (SELECT vec_id, any_value(n2) AS n2, tree, node * 2 + CASE WHEN max(CASE WHEN side = 1 THEN d END) < max(CASE WHEN side = 2 THEN d END) THEN 0 ELSE 1 END AS node, any_value(before) AS before, any_value(stuck) AS stuck, any_value(own) AS own FROM g{x} GROUP BY tree, vec_id, node)""")
    leaves = " UNION ALL ".join(f"SELECT tree, vec_id, node FROM m{x} WHERE before <= {TREES['max_points']} OR stuck >= {trees.STUCK}" for x in range(DEPTH))
    return f"{', '.join(out)}, leaves AS ({leaves})"


MATES = "c AS (SELECT DISTINCT x.vec_id AS query_id, y.vec_id FROM leaves x JOIN leaves y USING (tree, node) WHERE x.vec_id % 100 = 0)"


@query("tree_leaves", f"WITH {PURCHASE}, {NORMS}, {_tree_sql()} SELECT vec_id, tree::INTEGER AS tree, node FROM leaves")
def tree_leaves(spark, sf):
    return create_index("annoy", "cosine", **TREES).fit(purchases(spark, sf)).forest.leaves.select("vec_id", "tree", "node")


@query("tree_knn", f"{pairs_sql()}, {_tree_sql()}, {ranked_sql(MATES, 'cosine')}")
def tree_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("annoy", "cosine", **TREES).fit(v), v)


@query("tree_after_add", f"WITH {PURCHASE}, {NORMS}, {_tree_sql('vec_id % 2 = 0')} SELECT vec_id, tree::INTEGER AS tree, node FROM leaves")
def tree_after_add(spark, sf):
    old, new = halves(purchases(spark, sf))
    return create_index("annoy", "cosine", **TREES).fit(old).add(new).forest.leaves.select("vec_id", "tree", "node")


@query("tree_after_remove", f"{pairs_sql()}, {_tree_sql()}, {ranked_sql(MATES, 'cosine', 'vec_id % 3 <> 0')}")
def tree_after_remove(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("annoy", "cosine", **TREES).fit(v).remove(thirds(v)), v)


@query("tree_split", f"""{pairs_sql("true").replace("CROSS JOIN norms b", "JOIN piv ON true JOIN norms b ON b.vec_id = piv.vec_id").replace("p AS (", f"piv AS (SELECT vec_id, row_number() OVER (ORDER BY (({coefficients(1, 1)[1]}::BIGINT * (({hash_sql('vec_id + 1', 1, 1)} + 104729) % {PRIME}) + {coefficients(1, 1)[0]}) % {PRIME}), vec_id) AS side FROM norms QUALIFY side <= 2), p AS (").replace("SELECT a.vec_id AS query_id, b.vec_id", "SELECT piv.side, a.vec_id AS query_id, b.vec_id")},
    d AS (SELECT query_id, side, round({distance_sql("cosine")}, 9) AS d FROM p), t AS (SELECT query_id AS vec_id, max(CASE WHEN side = 1 THEN d END) AS d1, max(CASE WHEN side = 2 THEN d END) AS d2 FROM d GROUP BY 1)
    SELECT vec_id, (2 + CASE WHEN d1 < d2 THEN 0 ELSE 1 END)::BIGINT AS node FROM t""")  # fmt: skip
def tree_split(spark, sf):
    v = purchases(spark, sf)
    at = v.select("vec_id").distinct().withColumns({"tree": F.lit(0), "node": F.lit(1).cast("long")})
    return trees.route(at, v, trees.pivots(at, 1), v, "cosine").select("vec_id", "node")


M, EF, LAYERS = 16, 50, 4
#: Rounds of a search that the SQL below unrolls; those after its end change nothing.
ROUNDS = 14


def _level_sql(most: int, key: str = "vec_id") -> str:
    hits = [f"{hash_sql(hash_sql(f'{key} + 1', 1, 2 * j), 1, 2 * j + 1)} < {int(0.5 * PRIME)}" for j in range(most)]
    return "CASE " + " ".join(f"WHEN NOT ({h}) THEN {j}" for j, h in enumerate(hits)) + f" ELSE {most} END"


ALL_PAIRS = f"""{pairs_sql("true")}, pd AS MATERIALIZED (SELECT query_id, vec_id, inter, round({distance_sql("cosine")}, 9) AS d FROM p)"""


def _links_sql(out: str, layer: int = 0, m: int = M) -> str:
    """{out} (src, dst): the graph of the vectors that reach a layer, from pd."""
    return f"""{out}_t AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY {hash_sql("vec_id + 1", 1, 9)}, vec_id) - 1 AS turn FROM norms WHERE {_level_sql(LAYERS)} >= {layer}),
        {out}_r AS (SELECT query_id, pd.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, pd.vec_id) AS rnk FROM pd JOIN {out}_t a ON a.vec_id = query_id JOIN {out}_t b ON b.vec_id = pd.vec_id WHERE b.turn < a.turn),
        {out} AS MATERIALIZED (SELECT query_id AS src, vec_id AS dst FROM {out}_r WHERE rnk <= {m} UNION SELECT vec_id, query_id FROM {out}_r WHERE rnk <= {m})"""


def _beam_sql(out: str, links: str, entry: str, ef: int) -> str:
    """{out} (query_id, vec_id, d, rnk): the search of all queries from entry, unrolled."""
    best = lambda x: f"{out}b{x} AS MATERIALIZED (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rnk FROM {out}k{x} JOIN pd USING (query_id, vec_id) QUALIFY rnk <= {ef})"
    parts = [f"{out}k0 AS MATERIALIZED (SELECT query_id, vec_id FROM {entry})", best(0), f"{out}f0 AS (SELECT query_id, vec_id FROM {out}b0)"]
    for x in range(1, ROUNDS + 1):
        parts += [f"{out}k{x} AS MATERIALIZED (SELECT query_id, vec_id FROM {out}k{x - 1} UNION SELECT query_id, dst FROM {out}f{x - 1} f JOIN {links} l ON l.src = f.vec_id)", best(x), f"{out}f{x} AS MATERIALIZED (SELECT query_id, vec_id FROM {out}b{x} ANTI JOIN {out}k{x - 1} USING (query_id, vec_id))"]
    return f"{', '.join(parts)}, {out} AS (SELECT * FROM {out}b{ROUNDS})"


def _found_sql(cte: str) -> str:
    return f"SELECT query_id, rnk::INTEGER AS rnk, vec_id, round(round(d, 9), 6) + 0.0 AS distance FROM {cte} WHERE rnk <= {K}"


NSW_ENTRY = "en AS (SELECT vec_id AS query_id, (SELECT min(vec_id) FROM norms) AS vec_id FROM norms WHERE vec_id % 100 = 0)"


@query("nsw_edges", f"{ALL_PAIRS}, {_links_sql('g')} SELECT src, dst FROM g")
def nsw_edges(spark, sf):
    return graph.edges(purchases(spark, sf), M, "cosine")


@query("nsw_knn", f"{ALL_PAIRS}, {_links_sql('g')}, {NSW_ENTRY}, {_beam_sql('s', 'g', 'en', EF)} {_found_sql('s')}")
def nsw_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("nsw", "cosine", m=M, ef=EF).fit(v), v)


@query("nsw_after_remove", f"{ALL_PAIRS}, {_links_sql('g')} SELECT src, dst FROM g WHERE src % 3 <> 0 AND dst % 3 <> 0")
def nsw_after_remove(spark, sf):
    v = purchases(spark, sf)
    return create_index("nsw", "cosine", m=M, ef=EF).fit(v).remove(thirds(v)).links


@query("nsw_after_add", f"""{ALL_PAIRS}, {_links_sql("g").replace(f"FROM norms WHERE {_level_sql(LAYERS)} >= 0", "FROM norms WHERE vec_id % 2 = 0")}, t2 AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN CASE WHEN vec_id = (SELECT min(vec_id) FROM norms WHERE vec_id % 2 = 0) THEN 0 ELSE 1 END ELSE 1 + row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) END AS turn FROM norms),
    r2 AS (SELECT query_id, pd.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, pd.vec_id) AS rnk FROM pd JOIN t2 a ON a.vec_id = query_id JOIN t2 b ON b.vec_id = pd.vec_id WHERE query_id % 2 = 1 AND b.turn < a.turn)
    SELECT src, dst FROM g UNION SELECT query_id, vec_id FROM r2 WHERE rnk <= {M} UNION SELECT vec_id, query_id FROM r2 WHERE rnk <= {M}""")
def nsw_after_add(spark, sf):
    old, new = halves(purchases(spark, sf))
    return create_index("nsw", "cosine", m=M, ef=EF).fit(old).add(new).links


@query("hnsw_levels", f"SELECT c_custkey AS vec_id, ({_level_sql(6, 'c_custkey')})::INTEGER AS level FROM customer")
def hnsw_levels(spark, sf):
    return graph.levels(src.table(spark, sf, "customer").select(F.col("c_custkey").alias("vec_id")), 0.5, 6)


HNSW = {"m": M, "max_layers": LAYERS, "ef": EF}
HNSW_LINKS = ", ".join(_links_sql(f"g{n}", n) for n in range(LAYERS + 1))
EVERY_LAYER = " UNION ALL ".join(f"SELECT {n} AS layer, src, dst FROM g{n}" for n in range(LAYERS + 1))


def _layers(index) -> DataFrame:
    out = None
    for n, links in index.layers.links.items():
        one = links.select(F.lit(n).alias("layer"), "src", "dst")
        out = one if out is None else out.unionByName(one)
    return out


@query("hnsw_layer_edges", f"{ALL_PAIRS}, {HNSW_LINKS} {EVERY_LAYER}")
def hnsw_layer_edges(spark, sf):
    return _layers(create_index("hnsw", "cosine", **HNSW).fit(purchases(spark, sf)))


@query("hnsw_after_remove", f"{ALL_PAIRS}, {HNSW_LINKS} SELECT * FROM ({EVERY_LAYER}) WHERE src % 3 <> 0 AND dst % 3 <> 0")
def hnsw_after_remove(spark, sf):
    v = purchases(spark, sf)
    return _layers(create_index("hnsw", "cosine", **HNSW).fit(v).remove(thirds(v)))


def _descent_sql() -> str:
    """s: from the least id of the top layer greedily down, then the search on layer 0."""
    out = [f"en{LAYERS} AS (SELECT vec_id AS query_id, (SELECT arg_min(vec_id, (-lev, vec_id)) FROM (SELECT vec_id, {_level_sql(LAYERS)} AS lev FROM norms)) AS vec_id FROM norms WHERE vec_id % 100 = 0)"]
    for n in range(LAYERS, 0, -1):
        out += [_beam_sql(f"s{n}_", f"g{n}", f"en{n}", 1), f"en{n - 1} AS (SELECT query_id, vec_id FROM s{n}_)"]
    return ", ".join([*out, _beam_sql("s", "g0", "en0", EF)])


@query("hnsw_knn", f"{ALL_PAIRS}, {HNSW_LINKS}, {_descent_sql()} {_found_sql('s')}")
def hnsw_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("hnsw", "cosine", **HNSW).fit(v), v)


@query("hnsw_after_add")
def hnsw_after_add(spark, sf):
    v = purchases(spark, sf)
    old, new = halves(v)
    return _nearest(create_index("hnsw", "cosine", **HNSW).fit(old).add(new), v)


# --- evaluation, generator, persistence -----------------------------------------


@query("recall_at_k", f"WITH t AS ({knn_sql('jaccard')}), r AS ({_lsh_sql(MINHASH)}), h AS (SELECT t.query_id, count(*) AS hits FROM t JOIN r USING (query_id, vec_id) GROUP BY 1) SELECT t.query_id, coalesce(any_value(hits), 0) AS hits, round(coalesce(any_value(hits), 0) / count(*), 6) + 0.0 AS recall, round(coalesce(any_value(hits), 0) / {K}, 6) + 0.0 AS precision, round(CASE WHEN coalesce(any_value(hits), 0) = 0 THEN 0.0 ELSE 2.0 * any_value(hits) / (count(*) + {K}) END, 6) + 0.0 AS f1 FROM t LEFT JOIN h USING (query_id) GROUP BY 1")
def recall_at_k(spark, sf):
    v = purchases(spark, sf)
    q = every_hundredth(v)
    return rounded(metrics.quality(lsh.lsh_knn(v, q, K, "jaccard", **LSH), knn.knn(v, q, K, "jaccard"), K), "recall", "precision", "f1")


@query("scalability_lag", "WITH r(dataset_size, dims, qps) AS (VALUES (1000, 10, 100.0::DOUBLE), (2000, 10, 210.0), (4000, 20, 50.0)), p AS (SELECT *, lag(qps) OVER w AS q, lag(dataset_size) OVER w AS s, lag(dims) OVER w AS m FROM r WINDOW w AS (ORDER BY dataset_size)) SELECT dataset_size, dims, qps, qps / (q / ((dataset_size / s) * (dims / m))) AS scalability_factor FROM p")
def scalability_lag(spark, sf):
    return metrics.scalability(spark.createDataFrame([(1000, 10, 100.0), (2000, 10, 210.0), (4000, 20, 50.0)], "dataset_size int, dims int, qps double"))


@query("metric_spread", "SELECT o_orderpriority AS grp, max(o_totalprice) AS hi, min(o_totalprice) AS lo, arg_max(o_orderkey, o_totalprice) AS hi_label, arg_min(o_orderkey, o_totalprice) AS lo_label, round(max(o_totalprice) - min(o_totalprice), 6) + 0.0 AS spread FROM orders GROUP BY 1")
def metric_spread(spark, sf):
    return rounded(metrics.spread(src.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "grp"), "grp", "o_orderkey", "o_totalprice"), "spread")


def _gen_sql(dim: int, count: int, sparsity: float, seed: int) -> str:
    return f"""SELECT v AS vec_id, i::INTEGER AS idx, round({hash_sql("m", seed, 13)} / {float(PRIME)}, 6) + 0.0 AS val FROM (SELECT v, i, {hash_sql("v * 1000003 + i * 7919 + 1", seed, 11)} AS m FROM range({count}) a(v), range({dim}) b(i))
        WHERE {hash_sql("m", seed, 12)} < {int((1 - sparsity) * PRIME)}"""


@query("gen_vectors", _gen_sql(500, 300, 0.96, 42))
def gen_vectors(spark, sf):
    return rounded(src.generate(spark, 500, 300), "val")


@query("gen_queries", _gen_sql(500, 30, 0.96, 1042).replace("v AS vec_id", "v AS query_id"))
def gen_queries(spark, sf):
    return rounded(src.generate(spark, 500, 30, seed=1042).withColumnRenamed("vec_id", "query_id"), "val")


def _truth_sql(dim: int, count: int, queries: int, seed: int = 42) -> str:
    exact = lambda n, s: _gen_sql(dim, n, 0.96, s).replace(", 6) + 0.0 AS val", ", 15) AS val")
    return f"""WITH b AS ({exact(count, seed)}), q AS ({exact(queries, seed + 1000)}), o AS (SELECT q.vec_id AS query_id, b.vec_id, sum(q.val * b.val) AS dot FROM q JOIN b USING (idx) GROUP BY 1, 2),
        n AS (SELECT vec_id, sum(val * val) AS n2 FROM b GROUP BY 1), m AS (SELECT vec_id AS query_id, sum(val * val) AS n2 FROM q GROUP BY 1),
        d AS (SELECT query_id, vec_id, sqrt(greatest(m.n2 + n.n2 - 2 * coalesce(dot, 0.0), 0.0)) AS d FROM m CROSS JOIN n LEFT JOIN o USING (query_id, vec_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rnk FROM d) SELECT query_id, rnk::INTEGER AS rnk, vec_id, round(round(d, 9), 6) + 0.0 AS distance FROM r WHERE rnk <= {K}"""


@query("gen_groundtruth", _truth_sql(500, 300, 30))
def gen_groundtruth(spark, sf):
    v = src.generate(spark, 500, 300)
    return rounded(knn.knn(v, src.generate(spark, 500, 30, seed=1042).withColumnRenamed("vec_id", "query_id"), K, "euclidean"), "distance").select("query_id", "rnk", "vec_id", "distance")


# --- texts ----------------------------------------------------------------------

PICKED = f"""{TERMS}, picked AS (SELECT doc_id AS query_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY {hash_sql("('0x' || substr(md5(term), 1, 7))::BIGINT + doc_id", 1, 5)}, term) AS r FROM terms WHERE doc_id % 10 = 0) WHERE r <= 5)"""


@query("query_words", f"WITH {PICKED} SELECT query_id, term FROM picked")
def query_words(spark, sf):
    return src.synthesised_queries(src.terms(src.table(spark, sf, "documents")))


@query("tfidf_queries", f"WITH {PICKED}, {IDF}, raw AS (SELECT query_id, term, idf AS w FROM picked JOIN idf USING (term)) SELECT query_id AS doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY query_id)), 6) + 0.0 AS w FROM raw")
def tfidf_queries(spark, sf):
    counted = store.cut(src.terms(src.table(spark, sf, "documents")))
    asked = src.synthesised_queries(counted).select(F.col("query_id").alias("doc_id"), "term", F.lit(1).alias("tf"))
    return rounded(src.tfidf(asked, src.idf_table(counted)), "w")


@query("encoded_terms", f"WITH {TERMS} SELECT doc_id, term, round(ln(1 + tf), 6) + 0.0 AS w FROM terms")
def encoded_terms(spark, sf):
    return rounded(src.encode(src.table(spark, sf, "documents"), src.saturated), "w")


# --- files ----------------------------------------------------------------------

AS_IS = f"WITH {PURCHASE} SELECT * FROM purchase"


@query("msgpack_roundtrip", AS_IS)
def msgpack_roundtrip(spark, sf):
    folder = store.workdir(spark)
    written = sinks.write_vectors(src.purchase(spark, sf), folder, sinks.msgpack_vectors)
    return sinks.named(files.read_msgpack(spark, folder), written, "vec_id").select("vec_id", "idx", "val")


@query("csr_roundtrip", AS_IS)
def csr_roundtrip(spark, sf):
    folder = store.workdir(spark)
    written = sinks.write_vectors(src.purchase(spark, sf), folder, sinks.csr)
    return sinks.named(src.read_csr(spark, folder), written, "vec_id").select("vec_id", "idx", "val")


@query("json_roundtrip", AS_IS)
def json_roundtrip(spark, sf):
    path = store.workdir(spark)
    to_arrays(src.purchase(spark, sf)).write.json(path)
    return from_arrays(src.read_json(spark, path))


def _exact(spark, sf, name: str = "cosine") -> tuple[DataFrame, DataFrame, DataFrame]:
    v = purchases(spark, sf)
    q = every_hundredth(v)
    return v, q, knn.knn(v, q, K, name)


@query("msgpack_truth_roundtrip", f"SELECT query_id, rnk, vec_id FROM ({knn_sql('cosine')})")
def msgpack_truth_roundtrip(spark, sf):
    folder = store.workdir(spark)
    written = sinks.write_truth(_exact(spark, sf)[2].withColumn("score", F.col("distance")), folder, sinks.msgpack_truth)
    return sinks.named(files.read_msgpack_truth(spark, folder), written, "query_id").select("query_id", "rnk", "vec_id")


@query("truth_file_roundtrip", f"SELECT query_id, rnk, vec_id, round(distance::FLOAT::DOUBLE, 5) + 0.0 AS score FROM ({knn_sql('cosine')})")
def truth_file_roundtrip(spark, sf):
    folder = store.workdir(spark)
    written = sinks.write_truth(_exact(spark, sf)[2].withColumn("score", F.round("distance", 6)), folder, sinks.truth_file)
    return sinks.named(src.read_truth(spark, folder), written, "query_id").select("query_id", "rnk", "vec_id", (F.round("score", 5) + 0.0).alias("score"))


@query("truth_mismatches", f"WITH a AS ({knn_sql('euclidean')}), b AS ({knn_sql('cosine')}) SELECT query_id, rnk, a.vec_id AS found, b.vec_id AS truth FROM a JOIN b USING (query_id, rnk) WHERE a.vec_id <> b.vec_id")
def truth_mismatches(spark, sf):
    folder = store.workdir(spark)
    v, q, truth = _exact(spark, sf)
    written = sinks.write_truth(truth.withColumn("score", F.col("distance")), folder, sinks.truth_file)
    known = sinks.named(src.read_truth(spark, folder), written, "query_id").select("query_id", "rnk", "vec_id")
    return metrics.mismatches(knn.knn(v, q, K, "euclidean"), known)


@query("dataset_roundtrip", f"WITH {PURCHASE} SELECT 'vectors' AS part, vec_id AS id, idx::BIGINT AS idx, val FROM purchase UNION ALL SELECT 'queries', vec_id, idx, val FROM purchase WHERE vec_id % 100 = 0 UNION ALL SELECT 'truth', query_id, vec_id, rnk::DOUBLE FROM ({knn_sql('cosine')})")
def dataset_roundtrip(spark, sf):
    path, (v, q, truth) = store.workdir(spark), _exact(spark, sf)
    truth = store.cut(truth)
    for _ in range(2):  # the second replaces the first
        files.save_dataset(v, q, truth, path)
    v, q, t = files.load_dataset(spark, path)
    part = lambda df, name, key, idx, val: df.select(F.lit(name).alias("part"), F.col(key).alias("id"), F.col(idx).cast("long").alias("idx"), F.col(val).cast("double").alias("val"))
    return part(v, "vectors", "vec_id", "idx", "val").unionByName(part(q, "queries", "query_id", "idx", "val")).unionByName(part(t, "truth", "query_id", "vec_id", "rnk"))


# --- indexes --------------------------------------------------------------------


@query("linscan_knn", knn_sql("jaccard"))
def linscan_knn(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("linscan", "jaccard").fit(v), v)


@query("linscan_after_remove", knn_sql("euclidean", K, "vec_id % 3 <> 0"))
def linscan_after_remove(spark, sf):
    v = purchases(spark, sf)
    return _nearest(create_index("linscan", "euclidean").fit(v).remove(thirds(v)), v)


@query("save_load_roundtrip", f"SELECT 'linscan' AS kind, * FROM ({knn_sql('cosine')}) UNION ALL SELECT 'lsh', * FROM ({_lsh_sql(MINHASH)})")
def save_load_roundtrip(spark, sf):
    """Two indexes saved (one over another) and loaded."""
    v, out = purchases(spark, sf), None
    for name, of, params in (("linscan", "cosine", {}), ("lsh-minhash", "jaccard", LSH)):
        path = store.workdir(spark)
        create_index("linscan", "euclidean").fit(v.filter("vec_id % 2 = 0")).save(path)
        create_index(name, of, **params).fit(v).save(path)
        one = _nearest(load_index(spark, path), v).select(F.lit(name.split("-")[0]).alias("kind"), "query_id", "rnk", "vec_id", "distance")
        out = one if out is None else out.unionByName(one)
    return out


@query("index_tags", "SELECT * FROM (VALUES ('lsh', 0), ('annoy', 1), ('pq', 2), ('ivfpq', 3), ('hnsw', 4), ('nsw', 5), ('linscan', 6)) t(kind, tag)")
def index_tags(spark, sf):
    """What saved indexes of every kind say they are."""
    v, rows = src.generate(spark, 30, 40, sparsity=0.7), []
    small = {"pq": {"clusters": 2, "iterations": 1}, "ivfpq": {"clusters": 2, "coarse": 2, "iterations": 1}, "annoy": {"trees": 1, "max_points": 30}, "hnsw": {"max_layers": 1}}
    for kind in TAGS:
        path = store.workdir(spark)
        create_index("lsh-simhash" if kind == "lsh" else kind, "cosine", **small.get(kind, {})).fit(v).save(path)
        meta = store.load(spark, path)[1]
        rows.append((load_index(spark, path).kind, meta["tag"]))
    return spark.createDataFrame(rows, "kind string, tag int")


@query("index_presets", """SELECT * FROM (VALUES ('synthetic', 'hnsw', 'factor', 0.5::DOUBLE), ('synthetic', 'hnsw', 'max_layers', 16.0), ('synthetic', 'hnsw', 'm', 86.0), ('synthetic', 'hnsw', 'ef', 400.0), ('synthetic', 'lsh-simhash', 'n_buckets', 32.0), ('synthetic', 'lsh-simhash', 'hashes', 8.0),
    ('synthetic', 'lsh-minhash', 'n_buckets', 32.0), ('synthetic', 'lsh-minhash', 'hashes', 8.0), ('synthetic', 'pq', 'parts', 3.0), ('synthetic', 'pq', 'clusters', 50.0), ('synthetic', 'pq', 'iterations', 256.0), ('synthetic', 'pq', 'tolerance', 0.01),
    ('synthetic', 'ivfpq', 'parts', 6.0), ('synthetic', 'ivfpq', 'clusters', 256.0), ('synthetic', 'ivfpq', 'coarse', 16.0), ('synthetic', 'ivfpq', 'iterations', 500.0), ('synthetic', 'ivfpq', 'tolerance', 0.01), ('synthetic', 'nsw', 'm', 32.0), ('synthetic', 'nsw', 'ef', 200.0),
    ('synthetic', 'annoy', 'trees', 10.0), ('synthetic', 'annoy', 'max_points', 20.0)) t(preset, kind, parameter, val)""")
def index_presets(spark, sf):
    rows = [("synthetic", kind, name, float(x)) for kind in PRESETS["synthetic"] for name, x in create_index(kind, preset="synthetic").params.items() if name != "kind"]
    return spark.createDataFrame(rows, "preset string, kind string, parameter string, val double")


# --- benchmark ------------------------------------------------------------------


@query("sweep_configurations", "SELECT range AS dims, (range // 10)::BIGINT AS size FROM range(10000, 50001, 10000)")
def sweep_configurations(spark, sf):
    return spark.createDataFrame(list(benchmark.Sweep().configurations()), "dims long, size long")


@query("generate_datasets", "SELECT * FROM (VALUES ('dataset_100_50_1', true, false), ('dataset_200_100_2', true, false)) t(name, made, made_again)")
def generate_datasets(spark, sf):
    """Data sets of a sweep, asked for twice: the second time they are there."""
    sweep, folder = benchmark.Sweep((100, 200, 100), (50, 100, 50), sparsity=0.8), store.workdir(spark)
    once, again = (benchmark.generate_datasets(spark, sweep, [1, 2], folder) for _ in range(2))
    return spark.createDataFrame([(p.rsplit("/", 1)[1], a, b) for (p, a), (_, b) in zip(once, again)], "name string, made boolean, made_again boolean")


@query("benchmark_records", f"SELECT count(DISTINCT vec_id) AS dataset_size, 200::BIGINT AS dataset_dimensionality, 1.0::DOUBLE AS recall FROM ({_gen_sql(200, 120, 0.9, 42)})")
def benchmark_records(spark, sf):
    """A synthetic run of the exact index, as its CSV file has it; times and resources are left out."""
    sweep, path = benchmark.Sweep(sparsity=0.9), store.workdir(spark)
    vectors, asked, truth = benchmark.synthetic(spark, 200, 120, sweep)
    _, run = benchmark.measure(spark, create_index("linscan", "cosine"), vectors, asked, truth, 200, f"{path}/index")
    benchmark.write_csv(spark, [run], benchmark.Run, f"{path}/run.csv")
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/run.csv").selectExpr("bigint(dataset_size) as dataset_size", "bigint(dataset_dimensionality) as dataset_dimensionality", "double(recall) as recall")


@query("benchmark_real", f"WITH {TERMS} SELECT count(DISTINCT doc_id) AS dataset_size, 1.0::DOUBLE AS recall FROM terms")
def benchmark_real(spark, sf):
    """A run on texts: tf-idf vectors of all documents, five-word queries, true neighbours by shared words."""
    vectors, asked, truth = benchmark.real(spark, sf)
    _, run = benchmark.measure(spark, create_index("linscan", "jaccard"), vectors, asked, truth, 0, f"{store.workdir(spark)}/index", timeout=benchmark.TIMEOUT["real"])
    return spark.createDataFrame([(run.dataset_size, run.recall)], "dataset_size long, recall double")


@query("mean_quality", f"WITH h AS (WITH t AS ({knn_sql('jaccard')}), r AS ({_lsh_sql(MINHASH)}), x AS (SELECT t.query_id, count(*) AS hits FROM t JOIN r USING (query_id, vec_id) GROUP BY 1) SELECT t.query_id, coalesce(any_value(hits), 0) AS hits, count(*) AS n FROM t LEFT JOIN x USING (query_id) GROUP BY 1) SELECT round(avg(hits / n), 6) + 0.0 AS recall, round(avg(hits / {K}), 6) + 0.0 AS precision FROM h")
def mean_quality(spark, sf):
    v = purchases(spark, sf)
    q = every_hundredth(v)
    return rounded(metrics.quality(lsh.lsh_knn(v, q, K, "jaccard", **LSH), knn.knn(v, q, K, "jaccard"), K).agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision")), "recall", "precision")


@query("queries_per_second", "SELECT * FROM (VALUES (100::BIGINT, 0.5::DOUBLE, 200.0::DOUBLE), (1, 4.0, 0.25)) t(n, seconds, qps)")
def queries_per_second(spark, sf):
    return spark.createDataFrame([(n, s, metrics.queries_per_second(n, s)) for n, s in ((100, 0.5), (1, 4.0))], "n long, seconds double, qps double")


NEAREST_TRUTH = f"""WITH t AS ({knn_sql('euclidean', 3)}), x AS ({pairs_sql()} SELECT query_id, vec_id, {distance_sql('euclidean')} AS d FROM p)
    SELECT query_id, round(round(min(d), 9), 6) + 0.0 AS distance FROM x WHERE vec_id IN (SELECT vec_id FROM t WHERE query_id <> vec_id) GROUP BY 1"""


@query("nearest_truth", NEAREST_TRUTH)
def nearest_truth(spark, sf):
    v = purchases(spark, sf)
    q = every_hundredth(v)
    return rounded(metrics.nearest_truth(v, q, knn.knn(v, q, 3, "euclidean").filter("query_id <> vec_id"), "euclidean"), "distance")


@query("dataset_statistics", f"WITH {PURCHASE}, {NORMS}, nt AS ({NEAREST_TRUTH}) SELECT 'sparsity' AS what, nnz::DOUBLE AS x, count(*)::DOUBLE AS y FROM norms GROUP BY 2 UNION ALL SELECT 'sparsity_mean_median', round(avg(nnz), 6), median(nnz) FROM norms UNION ALL SELECT 'nearest', floor(distance / 10)::DOUBLE, count(*) FROM nt GROUP BY 2 UNION ALL SELECT 'nearest_mean_median', round(avg(distance), 4), round(median(distance), 4) FROM nt")
def dataset_statistics(spark, sf):
    v = purchases(spark, sf)
    q = every_hundredth(v)
    tables = benchmark.dataset_statistics(v, q, knn.knn(v, q, 3, "euclidean").filter("query_id <> vec_id"), "euclidean", 10)
    places = {"sparsity_mean_median": 6, "nearest_mean_median": 4}
    out = None
    for name, df in tables.items():
        x, y = (F.round(F.col(c).cast("double"), places.get(name, 6)).alias(a) for c, a in zip(df.columns, "xy"))
        one = df.select(F.lit(name).alias("what"), x, y)
        out = one if out is None else out.unionByName(one)
    return out


RUNS = "runs AS (SELECT o_orderpriority AS algo, o_orderkey AS dataset_size, o_totalprice AS qps, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 3 + 1.0 / (o_orderkey % 5 + 1) END AS factor FROM orders)"


def _runs(spark, sf):
    """Orders in the place of a benchmark's records."""
    return src.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("algo"), F.col("o_orderkey").alias("dataset_size"), F.col("o_totalprice").alias("qps"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 3 + 1.0 / (F.col("o_orderkey") % 5 + 1)).alias("factor")
    )


@query("chart_lines", f"WITH {RUNS} SELECT 'qps' AS metric, dataset_size, round(qps, 6) + 0.0 AS value FROM runs WHERE qps IS NOT NULL UNION ALL SELECT 'factor', dataset_size, round(factor, 6) + 0.0 FROM runs WHERE factor IS NOT NULL")
def chart_lines(spark, sf):
    return rounded(metrics.chart_lines(_runs(spark, sf), "dataset_size", "qps", "factor"), "value")


@query("chart_bars", f"WITH {RUNS}, last AS (SELECT algo, arg_max(qps, dataset_size) AS qps, max(dataset_size)::DOUBLE AS dataset_size FROM runs GROUP BY 1), long AS (SELECT 'qps' AS metric, algo, qps AS value FROM last UNION ALL SELECT 'dataset_size', algo, dataset_size FROM last) SELECT metric, algo, round(value, 6) + 0.0 AS value, row_number() OVER (PARTITION BY metric ORDER BY value, algo)::INTEGER AS rnk FROM long")
def chart_bars(spark, sf):
    return rounded(metrics.chart_bars(_runs(spark, sf).drop("factor"), "algo", "dataset_size", "qps", "dataset_size"), "value")


@query("finite_factors", f"WITH {RUNS} SELECT dataset_size, round(factor, 6) + 0.0 AS factor FROM runs WHERE factor IS NOT NULL AND dataset_size % 11 <> 0 AND dataset_size % 13 <> 0")
def finite_factors(spark, sf):
    odd = F.when(F.col("dataset_size") % 11 == 0, float("nan")).when(F.col("dataset_size") % 13 == 0, float("inf")).otherwise(F.col("factor"))
    return rounded(metrics.finite(_runs(spark, sf).select("dataset_size", odd.alias("factor")), "factor"), "factor")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
