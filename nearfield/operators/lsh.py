"""Locality-sensitive hashing: MinHash and SimHash buckets, exact re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import PRIME, coefficients, uniform_hash
from nearfield.operators.knn import among, rerank

BITS = 4


def minhash(vectors: DataFrame, hashes: int, seed: int = 1, key: str = "vec_id") -> DataFrame:
    """(key, j, h): the least hash of the indices under the j-th function. One aggregation for all functions."""
    wide = vectors.groupBy(key).agg(*(F.min(uniform_hash(F.col("idx") + 1, *coefficients(seed, j))).alias(f"h{j}") for j in range(hashes)))
    return wide.select(key, F.posexplode(F.array(*(f"h{j}" for j in range(hashes)))).alias("j", "h"))


def _sign(idx: Column, seed: int, j: int, bit: int) -> Column:
    return F.when(uniform_hash(idx + 1, *coefficients(seed + 1000, j * 64 + bit)) < PRIME // 2, 1).otherwise(-1)


def simhash(vectors: DataFrame, hashes: int, bits: int = BITS, seed: int = 1, key: str = "vec_id") -> DataFrame:
    """(key, j, h): signs of `bits` random projections, as a number, for each of `hashes` tables."""
    sums = vectors.groupBy(key).agg(*(F.sum(F.col("val") * _sign(F.col("idx"), seed, j, b)).alias(f"s{j}_{b}") for j in range(hashes) for b in range(bits)))
    codes = [sum((F.when(F.col(f"s{j}_{b}") > 0, 1 << b).otherwise(0) for b in range(bits)), F.lit(0)).cast("long") for j in range(hashes)]
    return sums.select(key, F.posexplode(F.array(*codes)).alias("j", "h"))


def buckets(signatures: DataFrame, n: int | None, shared: bool = False, band: int = 1) -> DataFrame:
    """(key, j, bucket): the signature's hash modulo n; without n the hashes of `band` functions (of 64 at most) together, so that
    buckets get no fuller as the table grows. With shared, all functions fill one table."""
    key = next(c for c in ("vec_id", "query_id") if c in signatures.columns)
    if n is None:
        # a sum of the functions' hashes, each times a coefficient of its own
        times = F.lit(0).cast("long")
        for j in range(64):
            times = F.when(F.col("j") == j, F.lit(coefficients(j, 2)[0]).cast("long")).otherwise(times)
        out = signatures.groupBy(key, F.floor(F.col("j") / band).cast("int").alias("j")).agg((F.sum(F.col("h") % PRIME * times % PRIME) % PRIME).alias("bucket"))
    else:
        out = signatures.select(key, "j", F.pmod("h", F.lit(n)).alias("bucket"))
    return out.withColumn("j", F.lit(0)).distinct() if shared else out


#: Buckets that a mask has bits for, and parts that a bucket is dealt to.
MASK, DEALT = 62, 8


def candidates(base: DataFrame, query: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """(query_id, vec_id) of those that share a bucket. With n_buckets, one table of so few buckets: most pairs share several then,
    so a pair is made in the least of them only, told by masks of buckets, and needs no removal of repeats."""
    if n_buckets is None or n_buckets > MASK:
        return query.join(base, ["j", "bucket"]).select("query_id", "vec_id").distinct()
    bit = F.expr("shiftleft(1L, int(bucket))")
    masked = lambda df, key, to: df.groupBy(key).agg(F.bit_or(bit).alias(to), F.collect_set("bucket").alias("all"))
    b = masked(base, "vec_id", "bm").select("vec_id", "bm", F.explode("all").alias("bucket"), F.pmod(F.hash("vec_id"), F.lit(DEALT)).alias("part"))
    q = masked(query, "query_id", "qm").select("query_id", "qm", F.explode("all").alias("bucket")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    common = F.col("bm").bitwiseAND(F.col("qm"))
    return b.join(q, ["bucket", "part"]).filter(common.bitwiseAND(-common) == bit).select("query_id", "vec_id")


def signed(vectors: DataFrame, kind: str = "minhash", n_buckets: int | None = 32, hashes: int = 8, seed: int = 1, shared: bool = True, band: int = 1, key: str = "vec_id") -> DataFrame:
    """The rows of the bucket table that vectors have."""
    if hashes < 2:
        raise ValueError("at least two hash functions")
    return buckets({"minhash": minhash, "simhash": simhash}[kind](vectors, hashes, seed=seed, key=key), n_buckets, shared, band)


def lsh_knn(vectors: DataFrame, queries: DataFrame, k: int, name: str, table: DataFrame | None = None, **how) -> DataFrame:
    """The k nearest of those that share a bucket, by exact distance; `table` is a bucket table built before."""
    base, asked = signed(vectors, **how) if table is None else table, signed(queries, key="query_id", **how)
    if how.get("n_buckets", 32) is not None:  # a fixed number of buckets: candidates are a share of all pairs
        return among(vectors, queries, k, name, base, asked)
    return rerank(candidates(base, asked), vectors, queries, k, name)
