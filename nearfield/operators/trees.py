"""Random-pivot tree forest, grown level by level; all trees and nodes of a level in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.distances import distance
from nearfield.functions.vectors import PRIME, coefficients, norms, uniform_hash
from nearfield.operators.knn import among
from nearfield.plans.store import cut


def pivots(assigned: DataFrame, seed: int) -> DataFrame:
    """(tree, node, side, vec_id): two members of every node, by hash order."""
    a, b = coefficients(seed, 1)
    order = uniform_hash(uniform_hash(F.col("vec_id") + 1, a, b) + F.col("tree") * 7919 + F.col("node") % PRIME * 104729, b, a)  # nodes of deep levels times that leave no room
    w = Window.partitionBy("tree", "node").orderBy(order, "vec_id")
    return assigned.withColumn("side", F.row_number().over(w)).filter("side <= 2").select("tree", "node", "side", "vec_id")


def route(assigned: DataFrame, vectors: DataFrame, chosen: DataFrame, pivot_vectors: DataFrame, name: str, key: str = "vec_id", own: DataFrame | None = None) -> DataFrame:
    """Child of every member: left (2 node) if the first pivot is strictly nearer, else right (2 node + 1). own are the norms of vectors, if known.

    Pivots meet the vectors by idx, as most share nothing; what a vector has of other nodes' pivots falls out.
    """
    piv = chosen.withColumnRenamed("vec_id", "pivot")
    entries = cut(piv.join(pivot_vectors.select(F.col("vec_id").alias("pivot"), "idx", F.col("val").alias("pv")), "pivot"))
    base = entries.groupBy("tree", "node", "side").agg(F.sum(F.col("pv") * F.col("pv")).alias("bn2"), F.count("*").alias("bnnz"))
    dots = vectors.join(entries, "idx").groupBy("tree", "node", key, "side").agg(F.sum(F.col("val") * F.col("pv")).alias("dot"), F.count("*").alias("inter"))
    own = (norms(vectors, key=key) if own is None else own).withColumnsRenamed({"n2": "qn2", "nnz": "qnnz"})
    full = assigned.join(own, key).join(base, ["tree", "node"]).join(dots, ["tree", "node", key, "side"], "left").fillna({"dot": 0.0, "inter": 0})
    d = full.withColumn("d", F.round(distance(name, *(F.col(x) for x in ("dot", "inter", "qn2", "bn2", "qnnz", "bnnz"))), 9))
    both = d.groupBy("tree", "node", key).agg(F.max(F.when(F.col("side") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("side") == 2, F.col("d"))).alias("d2"))
    return both.select("tree", key, (F.col("node") * 2 + F.when(F.col("d1") < F.col("d2"), 0).otherwise(1)).alias("node"))


#: Splits in a row that may leave a node whole, and levels that numbers of nodes have room for.
STUCK = 4
DEEPEST = 60


class Forest:
    def __init__(self, levels: list[DataFrame], leaves: DataFrame, name: str) -> None:
        self.levels, self.leaves, self.name = levels, leaves, name

    @classmethod
    def fit(cls, vectors: DataFrame, trees: int, max_points: int, name: str, seed: int = 1) -> Forest:
        """Split nodes of more than max_points members, until none is left or STUCK splits in a row have left a node whole (identical points never part)."""
        ids = vectors.select("vec_id").distinct()
        now = cut(ids.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumns({"node": F.lit(1).cast("long"), "before": F.lit(0).cast("long"), "stuck": F.lit(0)}))
        levels, done, own = [], None, cut(norms(vectors))
        for _ in range(DEEPEST):
            sizes = now.groupBy("tree", "node").agg(F.count("*").alias("n"))
            now = now.join(sizes, ["tree", "node"]).withColumn("stuck", F.when(F.col("n") == F.col("before"), F.col("stuck") + 1).otherwise(0)).withColumn("before", F.col("n")).drop("n")
            whole = (F.col("before") <= max_points) | (F.col("stuck") >= STUCK)
            now = cut(now)
            rest = now.filter(whole).select("vec_id", "tree", "node")
            done = rest if done is None else done.unionByName(rest)
            now = now.filter(~whole)
            if now.isEmpty():
                break
            chosen = cut(pivots(now.select("vec_id", "tree", "node"), seed))
            levels.append(chosen)
            went = route(now.select("vec_id", "tree", "node"), vectors, chosen, vectors, name, own=own)
            now = cut(went.join(now.select("vec_id", "tree", "before", "stuck"), ["vec_id", "tree"]).select("vec_id", "tree", "node", "before", "stuck"))
        else:
            done = done.unionByName(now.select("vec_id", "tree", "node"))
        return cls(levels, cut(done), name)

    def down(self, vectors: DataFrame, pivot_vectors: DataFrame, key: str = "vec_id") -> DataFrame:
        """(key, tree, node): the leaf of every tree that each vector falls into."""
        trees = self.leaves.select("tree").distinct()
        at = vectors.select(key).distinct().join(F.broadcast(trees)).withColumn("node", F.lit(1).cast("long"))  # a row a tree
        ends, own = None, cut(norms(vectors, key=key))
        for chosen in self.levels:
            inner = chosen.select("tree", "node").distinct()
            stop = at.join(inner, ["tree", "node"], "left_anti")
            ends = stop if ends is None else ends.unionByName(stop)
            at = cut(route(at.join(inner, ["tree", "node"], "left_semi"), vectors, chosen, pivot_vectors, self.name, key, own).select(key, "tree", "node"))
        return (at if ends is None else ends.unionByName(at)).select(key, "tree", "node")

    def add(self, vectors: DataFrame, more: DataFrame) -> Forest:
        """New vectors in the leaves that they fall into."""
        return Forest(self.levels, cut(self.leaves.unionByName(self.down(more, vectors).select(*self.leaves.columns))), self.name)

    def remove(self, ids: DataFrame) -> Forest:
        """Without ids in the leaves; pivots stay, as they only part the space."""
        return Forest(self.levels, cut(self.leaves.join(ids.select("vec_id"), "vec_id", "left_anti").select(*self.leaves.columns)), self.name)

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, pivot_vectors: DataFrame | None = None) -> DataFrame:
        """Queries go down every tree by its pivots; the union of their leaves is ranked exactly."""
        ends = self.down(queries, vectors if pivot_vectors is None else pivot_vectors, "query_id")
        return among(vectors, queries, k, self.name, self.leaves.select("vec_id", "tree", "node"), ends)
