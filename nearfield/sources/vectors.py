"""Sources of sparse vectors: star-schema purchases, texts, dense embeddings, generated data and binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import PRIME, coefficients, uniform_hash
from nearfield.plans.store import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers over parts, by quantity bought."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("vec_id"), F.col("l_partkey").cast("int").alias("idx")).agg(F.sum("l_quantity").alias("val"))


def terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf): line breaks and tabs become spaces, lower case, split at spaces."""
    clean = F.lower(F.regexp_replace("text", r"[\r\n\t]+", " "))
    return docs.select("doc_id", F.explode(F.split(clean, " ")).alias("term")).filter("term <> ''").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def tfidf(counted: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w): smooth idf ln((1 + n) / (1 + df)) + 1, L2-normalised. `fitted` (term, idf) is a vocabulary to use instead of one's own."""
    counted = cut(counted)
    idf = idf_table(counted) if fitted is None else fitted
    raw = counted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("w"))


def idf_table(counted: DataFrame) -> DataFrame:
    n = counted.agg(F.countDistinct("doc_id").alias("n"))
    return counted.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def encode(docs: DataFrame, encoder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, term, w) by an encoder of one's own, such as a pretrained model behind mapInArrow: it gets (doc_id, text)."""
    out = encoder(docs.select("doc_id", "text"))
    if out.columns != ["doc_id", "term", "w"]:
        raise ValueError(f"an encoder gives doc_id, term and w, not {out.columns}")
    return out


def saturated(docs: DataFrame) -> DataFrame:
    """An encoder: log(1 + tf)."""
    return terms(docs).select("doc_id", "term", F.log1p(F.col("tf").cast("double")).alias("w"))


def indexed(weighted: DataFrame) -> DataFrame:
    """(doc_id, term, w) to long form; idx is a hash of the term below 2**31 - 1, so no global dictionary is needed."""
    return weighted.select(F.col("doc_id").alias("vec_id"), F.pmod(F.xxhash64("term"), F.lit(PRIME)).cast("int").alias("idx"), F.col("w").alias("val")).groupBy("vec_id", "idx").agg(F.sum("val").alias("val"))


def synthesised_queries(counted: DataFrame, words: int = 5, every: int = 10, seed: int = 1) -> DataFrame:
    """(query_id, term): `words` terms, by hash order, of every tenth document."""
    key = uniform_hash(F.conv(F.substring(F.md5("term"), 1, 7), 16, 10).cast("long") + F.col("doc_id"), *coefficients(seed, 5))
    w = Window.partitionBy("doc_id").orderBy(key, "term")
    return counted.filter(F.col("doc_id") % every == 0).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= words).select(F.col("doc_id").alias("query_id"), "term")


def sparse_embeddings(emb: DataFrame, threshold: float = 0.15) -> DataFrame:
    return emb.select("vec_id", F.posexplode("embedding").alias("idx", "x")).filter(F.abs("x") >= threshold).select("vec_id", "idx", F.col("x").cast("double").alias("val"))


def generate(spark: SparkSession, dim: int, count: int, low: float = 0.0, high: float = 1.0, sparsity: float = 0.96, seed: int = 42, start: int = 0) -> DataFrame:
    """Each dimension is kept with probability 1 - sparsity, uniform in [low, high): a function of (seed, id, idx) alone."""
    cells = spark.range(start, start + count).select(F.col("id").alias("vec_id"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("idx"))
    mixed = uniform_hash(F.col("vec_id") * 1_000_003 + F.col("idx") * 7_919 + 1, *coefficients(seed, 11))
    keep, value = uniform_hash(mixed, *coefficients(seed, 12)), uniform_hash(mixed, *coefficients(seed, 13))
    return cells.filter(keep < int((1 - sparsity) * PRIME)).select("vec_id", "idx", (F.lit(low) + value / float(PRIME) * (high - low)).alias("val"))


def _csr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column("path"), batch.column("content")):
            data = raw.as_buffer()
            rows, cols, nnz = np.frombuffer(data, "<i8", 3).tolist()
            ptr = np.frombuffer(data, "<i8", rows + 1, 24)
            idx = np.frombuffer(data, "<i4", nnz, 24 + 8 * (rows + 1))
            val = np.frombuffer(data, "<f4", nnz, 24 + 8 * (rows + 1) + 4 * nnz)
            if ptr[0] != 0 or ptr[-1] != nnz or (np.diff(ptr) < 0).any() or (nnz and not (0 <= idx.min() and idx.max() < cols)):
                raise ValueError("not a CSR file")
            ids = np.repeat(np.arange(rows), np.diff(ptr))
            for a in range(0, nnz, 1 << 18):
                s = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(ids[s]), pa.string()), pa.array(ids[s]), pa.array(idx[s]), pa.array(val[s].astype(np.float64))], names=["file", "vec_id", "idx", "val"])


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(file, vec_id, idx, val) of CSR files: int64 rows, columns, entries; int64 row pointers; int32 indices; float32 values. A file has at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_csr, "file string, vec_id long, idx int, val double")


def _truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column("path"), batch.column("content")):
            data = raw.as_buffer()
            n, d = np.frombuffer(data, "<u4", 2).tolist()
            if len(data) != 8 + 8 * n * d:
                raise ValueError("not a ground-truth file")
            ids, scores = np.frombuffer(data, "<i4", n * d, 8), np.frombuffer(data, "<f4", n * d, 8 + 4 * n * d)
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * (n * d), pa.string()), pa.array(np.repeat(np.arange(n), d)), pa.array(np.tile(np.arange(1, d + 1, dtype=np.int32), n)), pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.float64))], names=["file", "query_id", "rnk", "vec_id", "score"])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(file, query_id, rnk, vec_id, score) of ground-truth files: uint32 n and d; int32 ids (n x d); float32 scores (n x d)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_truth, "file string, query_id long, rnk int, vec_id long, score double")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of {vec_id, indices, values}."""
    return spark.read.schema("vec_id long, indices array<int>, `values` array<float>").json(path)
