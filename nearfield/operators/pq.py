"""Product quantisation, flat and with an inverted file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.distances import distance
from nearfield.functions.vectors import split_by_position
from nearfield.operators import kmeans
from nearfield.operators.knn import top_k
from nearfield.plans.store import cut


def slices(vectors: DataFrame, parts: int) -> DataFrame:
    return split_by_position(vectors, parts).withColumnRenamed("m", "g")


def train(vectors: DataFrame, parts: int, clusters: int, iterations: int, tolerance: float = 0.01, seed: int = 1, name: str = "euclidean") -> DataFrame:
    """Codebooks (g, cid, idx, val) of all slices, in one job a round."""
    return kmeans.lloyd(slices(vectors, parts), clusters, iterations, tolerance, seed, name)


def encode(vectors: DataFrame, codebooks: DataFrame, parts: int, name: str = "euclidean") -> DataFrame:
    """(vec_id, g, cid)"""
    return kmeans.assign(slices(vectors, parts), codebooks, name).select("vec_id", "g", "cid")


def tables(queries: DataFrame, codebooks: DataFrame, parts: int, name: str) -> DataFrame:
    """(query_id, g, cid, d): distance of each slice of a query to each codeword of that slice."""
    q = split_by_position(queries, parts, "query_id").withColumnRenamed("m", "g")
    # codewords are as many as the parameters ask for
    n2 = lambda df, key, p: df.groupBy("g", key).agg(F.sum(F.col("val") * F.col("val")).alias(f"{p}n2"), F.count("*").alias(f"{p}nnz"))
    dots = q.join(codebooks.withColumnRenamed("val", "cv"), ["g", "idx"]).groupBy("g", "query_id", "cid").agg(F.sum(F.col("val") * F.col("cv")).alias("dot"), F.count("*").alias("inter"))
    every = n2(q, "query_id", "q").join(F.broadcast(n2(codebooks, "cid", "b")), "g").join(dots, ["g", "query_id", "cid"], "left").fillna({"dot": 0.0, "inter": 0})
    return every.select("query_id", "g", "cid", distance(name, *(F.col(x) for x in ("dot", "inter", "qn2", "bn2", "qnnz", "bnnz"))).alias("d"))


def search(codes: DataFrame, queries: DataFrame, codebooks: DataFrame, parts: int, k: int, name: str = "euclidean") -> DataFrame:
    """Sum of the slices' distances, k smallest; no re-ranking."""
    return scan(codes, tables(queries, codebooks, parts, name), parts, k)


#: Codes that one task of a scan compares, and distances or sums that it holds at once.
SCAN_CODES, SCAN_HELD = 200_000, 4_000_000


def scan(codes: DataFrame, table: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, rnk, vec_id, distance): the k vectors of the smallest sums of table (query_id, g, cid, d) over codes (vec_id, g, cid).

    Vectors of one code have one sum, so each code is compared once, with the k least ids that have it. A list (g over parts)
    is compared with the queries that have distances in it only.
    """
    code = codes.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("g", "cid"))).alias("code"))
    first = code.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).filter(F.col("r") <= k)
    members = cut(first.groupBy("code").agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("list", F.floor(F.col("code")[0]["g"] / parts)))
    table = cut(table)
    asked = table.groupBy("query_id", F.floor(F.col("g") / parts).alias("list")).agg(F.collect_list(F.struct("g", "cid", "d")).alias("row"))
    n, m = members.count() // SCAN_CODES + 1, max(table.count() // SCAN_HELD + 1, table.sparkSession.sparkContext.defaultParallelism)
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    dealt = lambda key, size: F.pmod(F.hash(key), F.lit(size))
    left = asked.select("query_id", "list", "row", dealt("query_id", m).alias("qb")).withColumn("cb", every(n))
    right = members.select("least", "list", "code", dealt("least", n).alias("cb")).withColumn("qb", every(m))
    near = left.groupBy("list", "qb", "cb").cogroup(right.groupBy("list", "qb", "cb")).applyInArrow(_sums(k), "query_id long, least long, sum double")
    best = top_k(near.withColumnRenamed("least", "vec_id"), k, "sum").withColumnRenamed("vec_id", "least").drop("rnk").join(members.select("least", "ids"), "least")
    # of the codes behind others that have k vectors already nothing is left
    w, size = Window.partitionBy("query_id"), F.size("ids")
    at = F.round("sum", 9)
    before = F.sum(size).over(w.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum(size).over(Window.partitionBy("query_id", at))
    open_ = best.withColumn("before", before).filter(F.col("before") < k)
    return top_k(open_.select("query_id", F.explode("ids").alias("vec_id"), F.col("sum").alias("distance")), k).select("query_id", "rnk", "vec_id", "distance")


def _flat(column: pa.ChunkedArray, *names: str) -> tuple[np.ndarray, ...]:
    """Row numbers of the structs in a column of lists, and their fields."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, *(values.field(name).to_numpy(zero_copy_only=False) for name in names)


def _sums(k: int):
    """For the queries and codes of a group: the codes whose sums are among the k smallest of a query, up to rounding."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        ids, least = queries.column("query_id").to_numpy(), members.column("least").to_numpy()
        out = [(ids[:0].astype(np.int64), least[:0].astype(np.int64), np.zeros(0))]
        if len(ids) and len(least):
            qrow, qg, qc, d = _flat(queries.column("row"), "g", "cid", "d")
            crow, cg, cc = _flat(members.column("code"), "g", "cid")
            slot = lambda g, c: g.astype(np.int64) << 32 | c
            slots, at = np.unique(slot(qg, qc), return_inverse=True)
            wide = np.full((len(ids), len(slots) + 1), np.nan)
            wide[qrow, at] = d
            place = np.minimum(np.searchsorted(slots, slot(cg, cc)), len(slots) - 1)
            place = np.where(slots[place] == slot(cg, cc), place, len(slots))
            nth = np.arange(len(crow)) - np.searchsorted(crow, crow)
            code = np.full((len(least), nth.max() + 1), len(slots))
            code[crow, nth] = place
            step = max(1, SCAN_HELD // len(least))
            for a in range(0, len(ids), step):
                rows, total, some = wide[a : a + step], None, None
                for column in code.T:
                    one = rows[:, column]
                    there = ~np.isnan(one)
                    one[~there] = 0.0
                    total, some = (one, there) if total is None else (total + one, some | there)
                total[~some] = np.inf
                if len(least) > k:
                    bound = np.partition(total, k - 1, axis=1)[:, k - 1 : k] + 2e-9  # distances are ordered by nine places
                    some &= total <= bound
                q, c = np.nonzero(some)
                out.append((ids[a + q], least[c], total[q, c]))
        return pa.table(dict(zip(("query_id", "least", "sum"), (pa.array(np.concatenate(x)) for x in zip(*out)))))

    return run


class Inverted:
    """Coarse clusters; within each, codebooks of its own. A query probes the nearest nprobe (default k) clusters."""

    def __init__(self, coarse: DataFrame, lists: DataFrame, codebooks: DataFrame, codes: DataFrame, parts: int, name: str) -> None:
        self.coarse, self.lists, self.codebooks, self.codes, self.parts, self.name = coarse, lists, codebooks, codes, parts, name

    @classmethod
    def fit(cls, vectors: DataFrame, parts: int, clusters: int, coarse: int, iterations: int, tolerance: float = 0.01, seed: int = 1, name: str = "euclidean") -> Inverted:
        whole = vectors.withColumn("g", F.lit(0))
        centers = kmeans.lloyd(whole, coarse, iterations, tolerance, seed, name)
        lists = cut(kmeans.assign(whole, centers, name).select("vec_id", F.col("cid").alias("list")))
        sub = cut(cls.parted(vectors, lists, parts))
        books = kmeans.lloyd(sub, clusters, iterations, tolerance, seed, name)
        codes = cut(kmeans.assign(sub, books, name).select("vec_id", "g", "cid"))
        return cls(centers, lists, books, codes, parts, name)

    @staticmethod
    def parted(vectors: DataFrame, lists: DataFrame, parts: int) -> DataFrame:
        return split_by_position(vectors, parts).join(lists, "vec_id").withColumn("g", F.col("list") * parts + F.col("m")).drop("m", "list")

    def add(self, more: DataFrame) -> Inverted:
        """New vectors in their nearest lists, by the codebooks there are."""
        lists = cut(kmeans.assign(more.withColumn("g", F.lit(0)), self.coarse, self.name).select("vec_id", F.col("cid").alias("list")))
        codes = kmeans.assign(self.parted(more, lists, self.parts), self.codebooks, self.name).select("vec_id", "g", "cid")
        return Inverted(self.coarse, cut(self.lists.unionByName(lists)), self.codebooks, cut(self.codes.unionByName(codes)), self.parts, self.name)

    def remove(self, ids: DataFrame) -> Inverted:
        gone = ids.select("vec_id")
        return Inverted(self.coarse, cut(self.lists.join(gone, "vec_id", "left_anti")), self.codebooks, cut(self.codes.join(gone, "vec_id", "left_anti")), self.parts, self.name)

    def probes(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, list): the n nearest coarse clusters."""
        d = tables(queries, self.coarse, 1, self.name)
        w = Window.partitionBy("query_id").orderBy(F.round("d", 9), "cid")
        return d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("query_id", F.col("cid").alias("list"))

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        probed = self.probes(queries, nprobe or k)
        q = split_by_position(queries, self.parts, "query_id").join(probed, "query_id").withColumn("g", F.col("list") * self.parts + F.col("m"))
        n2 = lambda df, keys, p: df.groupBy(*keys).agg(F.sum(F.col("val") * F.col("val")).alias(f"{p}n2"), F.count("*").alias(f"{p}nnz"))
        dots = q.join(self.codebooks.withColumnRenamed("val", "cv"), ["g", "idx"]).groupBy("g", "query_id", "cid").agg(F.sum(F.col("val") * F.col("cv")).alias("dot"), F.count("*").alias("inter"))
        every = n2(q, ["g", "query_id"], "q").join(F.broadcast(n2(self.codebooks, ["g", "cid"], "b")), "g").join(dots, ["g", "query_id", "cid"], "left").fillna({"dot": 0.0, "inter": 0})
        d = every.select("query_id", "g", "cid", distance(self.name, *(F.col(x) for x in ("dot", "inter", "qn2", "bn2", "qnnz", "bnnz"))).alias("d"))
        return scan(self.codes, d, self.parts, k)
