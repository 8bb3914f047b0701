"""Retrieval quality and distribution statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.operators.knn import knn


def quality(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, recall, precision, f1) by id; recall over the truth's length, precision over k."""
    size = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = results.filter(F.col("rnk") <= k).join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    out = size.join(hits, "query_id", "left").fillna({"hits": 0}).withColumn("recall", F.col("hits") / F.col("n")).withColumn("precision", F.col("hits") / k)
    return out.withColumn("f1", F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision")))).drop("n")


def by_support(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """vec_id replaced by the least id with the same indices: hits then compare supports."""
    support = vectors.groupBy("vec_id").agg(F.array_sort(F.collect_list("idx")).alias("s"))
    least = support.withColumn("same", F.min("vec_id").over(Window.partitionBy("s"))).select("vec_id", "same")
    return rows.join(least, "vec_id").withColumn("vec_id", F.col("same")).drop("same").dropDuplicates(["query_id", "vec_id"])


def queries_per_second(n: int, seconds: float) -> float:
    return n / seconds if seconds else float("inf")


def scalability(runs: DataFrame) -> DataFrame:
    """Adds scalability_factor to (dataset_size, dims, qps): qps over what the run before predicts for the growth; null for the first."""
    w = Window.orderBy("dataset_size")
    prev = {c: F.lag(c).over(w) for c in ("qps", "dataset_size", "dims")}
    return runs.withColumn("scalability_factor", F.col("qps") / (prev["qps"] / ((F.col("dataset_size") / prev["dataset_size"]) * (F.col("dims") / prev["dims"]))))


def sparsity_histogram(norms: DataFrame) -> DataFrame:
    return norms.groupBy("nnz").agg(F.count("*").alias("n"))


def mean_median(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.median(column).alias("median"))


def spread(rows: DataFrame, by: str, label: str, value: str) -> DataFrame:
    """Largest and smallest value of each group, with their labels."""
    return rows.groupBy(by).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.max_by(label, value).alias("hi_label"), F.min_by(label, value).alias("lo_label")).withColumn("spread", F.col("hi") - F.col("lo"))


def nearest_truth(vectors: DataFrame, queries: DataFrame, truth: DataFrame, name: str) -> DataFrame:
    """(query_id, distance) of each query to the nearest vector that is a true neighbour of any query."""
    known = vectors.join(truth.select("vec_id").distinct(), "vec_id", "left_semi")
    return knn(known, queries, 1, name).select("query_id", "distance")


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(bin, n): bin is the value's multiple of width, rounded down."""
    return df.groupBy(F.floor(F.round(column, 6) / width).alias("bin")).agg(F.count("*").alias("n"))


def chart_lines(runs: DataFrame, by: str, *columns: str) -> DataFrame:
    """(metric, by, value): the points of one line for each column, without rows that have no finite value."""
    long = runs.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))).alias("p")).select("p.metric", by, "p.value")
    return finite(long, "value")


def chart_bars(runs: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """(metric, by, value, rnk): the values of each group's last row in `order`, ascending within a metric; ties by name."""
    last = runs.groupBy(by).agg(*(F.max_by(c, order).alias(c) for c in columns))
    bars = chart_lines(last, by, *columns)
    return bars.withColumn("rnk", F.row_number().over(Window.partitionBy("metric").orderBy("value", by)))  # a row a group


def finite(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is a number that isn't infinite."""
    x = F.col(column)
    return df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mismatches(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rnk, found, truth): places at which results and true neighbours name different vectors."""
    found = results.select("query_id", "rnk", F.col("vec_id").alias("found"))
    return found.join(truth.select("query_id", "rnk", F.col("vec_id").alias("truth")), ["query_id", "rnk"]).filter("found <> truth")
