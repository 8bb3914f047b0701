"""k-means over sparse vectors, for many groups at once.

Input (g, vec_id, idx, val): every g is a problem of its own (slices of product
quantisation, coarse clusters); all are solved in one job a round. A centre
keeps the support of its seed vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.distances import distance
from nearfield.functions.vectors import coefficients, uniform_hash
from nearfield.plans.store import cut


def initial(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(g, cid, idx, val): k members of each group, first in hash order (fewer if there are fewer)."""
    ids = points.select("g", "vec_id").distinct()
    w = Window.partitionBy("g").orderBy(uniform_hash(F.col("vec_id") + 1, *coefficients(seed, 0)), "vec_id")
    chosen = ids.withColumn("cid", F.row_number().over(w) - 1).filter(F.col("cid") < k)
    return points.join(chosen, ["g", "vec_id"]).select("g", "cid", "idx", "val")


def assign(points: DataFrame, centers: DataFrame, name: str = "euclidean") -> DataFrame:
    """(g, vec_id, cid, distance): the nearest centre, lowest cid on ties."""
    n2 = lambda df, key: df.groupBy("g", key).agg(F.sum(F.col("val") * F.col("val")).alias("n2"), F.count("*").alias("nnz"))
    dots = points.join(centers.withColumnRenamed("val", "cv"), ["g", "idx"]).groupBy("g", "vec_id", "cid").agg(F.sum(F.col("val") * F.col("cv")).alias("dot"), F.count("*").alias("inter"))
    p, c = n2(points, "vec_id"), n2(centers, "cid")
    # a row a centre: as many as the parameters ask for, whatever the number of points
    every = p.withColumnsRenamed({"n2": "qn2", "nnz": "qnnz"}).join(F.broadcast(c.withColumnsRenamed({"n2": "bn2", "nnz": "bnnz"})), "g").join(dots, ["g", "vec_id", "cid"], "left").fillna({"dot": 0.0, "inter": 0})
    scored = every.withColumn("distance", distance(name, *(F.col(x) for x in ("dot", "inter", "qn2", "bn2", "qnnz", "bnnz"))))
    w = Window.partitionBy("g", "vec_id").orderBy(F.round("distance", 9), "cid")
    return scored.withColumn("r", F.row_number().over(w)).filter("r = 1").select("g", "vec_id", "cid", "distance")


def update(points: DataFrame, assigned: DataFrame, centers: DataFrame, seed: int = 1, turn: int = 0) -> DataFrame:
    """Means of the members, over the centre's own indices. Centres without members are set anew: in the order of cid,
    to the first points of the group in another hash order for every turn; if there are too few points they stay."""
    sizes = assigned.groupBy("g", "cid").agg(F.count("*").alias("size"))
    sums = points.join(assigned.select("g", "vec_id", "cid"), ["g", "vec_id"]).groupBy("g", "cid", "idx").agg(F.sum("val").alias("s"))
    known = centers.join(F.broadcast(sizes), ["g", "cid"], "left")  # a row a centre
    moved = known.filter("size is not null").join(sums, ["g", "cid", "idx"], "left").select("g", "cid", "idx", (F.coalesce("s", F.lit(0.0)) / F.col("size")).alias("val"))
    empty = known.filter("size is null").select("g", "cid").distinct().withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("cid")))
    order = Window.partitionBy("g").orderBy(uniform_hash(F.col("vec_id") + 1, *coefficients(seed, 21 + turn)), "vec_id")
    ids = points.select("g", "vec_id").distinct().join(F.broadcast(empty.select("g").distinct()), "g", "left_semi")
    chosen = ids.withColumn("r", F.row_number().over(order)).join(F.broadcast(empty), ["g", "r"]).select("g", "vec_id", "cid")
    fresh = points.join(F.broadcast(chosen), ["g", "vec_id"]).select("g", "cid", "idx", "val")
    stay = known.filter("size is null").join(F.broadcast(chosen), ["g", "cid"], "left_anti").select("g", "cid", "idx", "val")
    return moved.unionByName(fresh).unionByName(stay)


def lloyd(points: DataFrame, k: int, iterations: int, tolerance: float = 0.01, seed: int = 1, name: str = "euclidean") -> DataFrame:
    """Centres (g, cid, idx, val) after at most `iterations` rounds, or when no centre moves by tolerance or more."""
    points = cut(points)
    centers = cut(initial(points, k, seed))
    for turn in range(iterations):
        new = cut(update(points, cut(assign(points, centers, name)), centers, seed, turn))
        both = centers.withColumn("nv", F.lit(0.0)).unionByName(new.select("g", "cid", "idx", F.lit(0.0).alias("val"), F.col("val").alias("nv"))).groupBy("g", "cid", "idx").agg(F.sum("val").alias("val"), F.sum("nv").alias("nv"), F.count("*").alias("n"))
        both = both.groupBy("g", "cid").agg(F.sum(F.col("val") * F.col("nv")).alias("dot"), F.count_if(F.col("n") == 2).alias("inter"), F.sum(F.col("val") * F.col("val")).alias("qn2"), F.sum(F.col("nv") * F.col("nv")).alias("bn2"), F.count("*").alias("nnz"))
        far = both.withColumn("d", distance(name, F.col("dot"), F.col("inter"), F.col("qn2"), F.col("bn2"), F.col("nnz"), F.col("nnz"))).agg(F.max("d")).first()[0]
        centers = new
        if far is None or far < tolerance:
            break
    return centers
