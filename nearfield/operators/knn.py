"""Exact k nearest neighbours, set at a time, without a cross join.

Pairs that share an entry meet by idx, and are summed where the query is. Pairs that share none
have a distance that depends on the two norms only, so per query the first
k + (number of overlapping vectors) vectors of one fixed order contain its k
best of those; they are met by an equi-join on their rank. Only queries that
have fewer than k overlapping vectors at a smaller distance than any other
vector can have are filled so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.distances import distance, metric
from nearfield.functions.vectors import norms, ranked
from nearfield.operators import blocks
from nearfield.plans.store import cut


def overlaps(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, dot, inter) of pairs with a shared idx."""
    q = queries.select("query_id", "idx", F.col("val").alias("qv"))
    return q.join(vectors, "idx").groupBy("query_id", "vec_id").agg(F.sum(F.col("qv") * F.col("val")).alias("dot"), F.count("*").alias("inter"))


def top_k(scored: DataFrame, k: int, by: str = "distance") -> DataFrame:
    """The k smallest of each query; ties by id. The window limits each partition before the shuffle."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = Window.partitionBy("query_id").orderBy(F.round(by, 9), "vec_id")
    return scored.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def score(pairs: DataFrame, base: DataFrame, query: DataFrame, name: str) -> DataFrame:
    """Adds distance to pairs (query_id, vec_id, dot, inter); base and query are norms of the two sides."""
    full = pairs.join(base.select("vec_id", F.col("n2").alias("bn2"), F.col("nnz").alias("bnnz")), "vec_id").join(query.select("query_id", F.col("n2").alias("qn2"), F.col("nnz").alias("qnnz")), "query_id")
    # sums of doubles differ in the last places with the order of the rows, so distances have as many places as the order goes by
    return full.withColumn("distance", F.round(distance(name, *(F.col(c) for c in ("dot", "inter", "qn2", "bn2", "qnnz", "bnnz"))), 9) + 0.0)


def least(name: str) -> Column:
    """No vector without an entry in common is nearer to a query (n2, nnz) than this."""
    return {"euclidean": F.sqrt("n2"), "cosine": F.lit(1.0), "jaccard": F.when(F.col("nnz") == 0, 0.0).otherwise(1.0), "angular": F.lit(0.5), "dot": F.lit(0.0), "inner_product": F.lit(0.0)}[name]


def short(scored: DataFrame, query: DataFrame, k: int, name: str) -> DataFrame:
    """(query_id, met, fill): queries with fewer than k overlapping vectors that are nearer than all others can be, and the
    number of places of a fixed order among which the k best of the others are."""
    near = scored.join(query.select("query_id", F.round(least(name), 9).alias("bound")), "query_id").groupBy("query_id").agg(F.count("*").alias("met"), F.count_if(F.col("distance") < F.col("bound")).alias("near"))
    return too_few(query.select("query_id"), near, k)


def too_few(ids: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    return cut(ids.join(counts, "query_id", "left").fillna(0, ["met", "near"]).filter(F.col("near") < k).drop("near").withColumn("fill", F.col("met") + k))


def all_met(found: DataFrame, most: DataFrame, k: int, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, distance): at least all pairs with an entry in common of the queries in `most`, of which found has the k nearest."""
    more, pairs = most.filter(F.col("met") > k), found.select("query_id", "vec_id", "distance")
    if more.isEmpty():
        return pairs
    return pairs.unionByName(overlaps(vectors, queries.join(more, "query_id", "left_semi")).select("query_id", "vec_id", F.lit(0.0).alias("distance")))


def fixed_order(name: str) -> list[str]:
    return ["n2", "vec_id"] if name == "euclidean" else ["vec_id"]


def knn(vectors: DataFrame, queries: DataFrame, k: int, name: str = "cosine", ids: DataFrame | None = None, query_ids: DataFrame | None = None) -> DataFrame:
    """(query_id, rnk, vec_id, distance, score): score is 1 - distance, higher is better."""
    name = metric(name)
    base, query = cut(norms(vectors, ids)), cut(norms(queries, query_ids, "query_id"))
    found = cut(blocks.nearest(vectors, queries, k, name))
    scored = found.select("query_id", "vec_id", "distance")
    most = too_few(query.select("query_id"), found.groupBy("query_id").agg(F.sum("met").alias("met"), F.sum("near").alias("near")), k)
    if most.isEmpty():
        best = top_k(scored, k)
    else:
        places = ranked(base.select("vec_id", "n2"), *fixed_order(name)).select("vec_id", (F.col("position") + 1).alias("r"))
        filler = most.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("fill").cast("long"))).alias("r")).join(places, "r").select("query_id", "vec_id")
        if name == "jaccard":  # an empty query is at distance 0 of empty vectors
            empty = base.filter("nnz = 0").orderBy("vec_id").limit(k).select("vec_id", F.lit(0).alias("z"))
            filler = filler.union(query.filter("nnz = 0").select("query_id", F.lit(0).alias("z")).join(empty, "z").select("query_id", "vec_id")).distinct()
        best = top_k(scored.unionByName(apart(filler, all_met(found, most, k, vectors, queries), base, query, name)), k)
    return best.select("query_id", "rnk", "vec_id", "distance", (1 - F.col("distance")).alias("score"))


def apart(pairs: DataFrame, scored: DataFrame, base: DataFrame, query: DataFrame, name: str) -> DataFrame:
    """(query_id, vec_id, distance) of those of the pairs that aren't among the scored ones, which are all that have an entry in common."""
    alone = pairs.join(scored, ["query_id", "vec_id"], "left_anti").withColumns({"dot": F.lit(0.0), "inter": F.lit(0).cast("long")})
    return score(alone, base, query, name).select("query_id", "vec_id", "distance")


def among(vectors: DataFrame, queries: DataFrame, k: int, name: str, base: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, rnk, vec_id, distance): the k nearest of the pairs that have a group in common, by the tables base (vec_id, ...)
    and asked (query_id, ...), whose other columns are the same and name the groups.

    Exact, and without a row for every such pair: pairs with an entry in common are kept if they have a group in common, and
    queries that have too few of them are filled from the first vectors of each of their groups in a fixed order.
    """
    name, on = metric(name), [c for c in base.columns if c != "vec_id"]
    base, asked, n2, qn2 = cut(base), cut(asked), cut(norms(vectors)), cut(norms(queries, key="query_id"))
    groups = lambda df, key, to: df.groupBy(key).agg(F.collect_set(F.concat_ws("_", *on)).alias(to))
    met = overlaps(vectors, queries).join(groups(base, "vec_id", "bs"), "vec_id").join(groups(asked, "query_id", "qs"), "query_id").filter(F.arrays_overlap("bs", "qs"))
    scored = cut(score(met.drop("bs", "qs"), n2, qn2, name).select("query_id", "vec_id", "distance"))
    most = short(scored, qn2.join(asked.select("query_id").distinct(), "query_id", "left_semi"), k, name)
    fill = most.agg(F.max("fill")).first()[0]
    if fill is None:
        return top_k(scored, k).select("query_id", "rnk", "vec_id", "distance")
    w = Window.partitionBy(*on).orderBy(*fixed_order(name))
    first = base.join(n2.select("vec_id", "n2"), "vec_id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fill).select(*on, "vec_id", "r")
    filler = most.join(asked, "query_id").join(first, on).filter("r <= fill").select("query_id", "vec_id").distinct()
    return top_k(scored.unionByName(apart(filler, scored, n2, qn2, name)), k).select("query_id", "rnk", "vec_id", "distance")


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, name: str) -> DataFrame:
    """Exact distances of candidate pairs (query_id, vec_id), and the k best."""
    pairs = candidates.distinct()
    dots = pairs.join(vectors, "vec_id").join(queries.select("query_id", "idx", F.col("val").alias("qv")), ["query_id", "idx"]).groupBy("query_id", "vec_id").agg(F.sum(F.col("qv") * F.col("val")).alias("dot"), F.count("*").alias("inter"))
    full = pairs.join(dots, ["query_id", "vec_id"], "left").fillna({"dot": 0.0, "inter": 0})
    return top_k(score(full, norms(vectors), norms(queries, key="query_id"), name), k).select("query_id", "rnk", "vec_id", "distance")


def as_queries(vectors: DataFrame, where) -> DataFrame:
    return vectors.filter(where).withColumnRenamed("vec_id", "query_id")


def add(vectors: DataFrame, more: DataFrame) -> DataFrame:
    return vectors.unionByName(more)


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop ids; unknown ids are ignored, the others keep their names."""
    return vectors.join(ids.select("vec_id"), "vec_id", "left_anti")
