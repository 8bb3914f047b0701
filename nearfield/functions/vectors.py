"""Sparse vectors as relations.

Long form (vec_id, idx, val), unique on (vec_id, idx), is what everything
computes on. `norms` is the companion that also knows empty vectors. Stored
zeros are entries; a missing idx is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.plans.store import cut

PRIME = 2147483647


def from_arrays(df: DataFrame, merge: bool = False) -> DataFrame:
    """(vec_id, indices, values) to long form; duplicate indices raise, or are summed with merge."""
    long = df.select("vec_id", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("vec_id", F.col("e.indices").cast("int").alias("idx"), F.col("e.values").cast("double").alias("val"))
    grouped = long.groupBy("vec_id", "idx").agg(F.sum("val").alias("val"), F.count("*").alias("n"))
    if merge:
        return grouped.drop("n")
    return grouped.withColumn("val", F.when(F.col("n") == 1, F.col("val")).otherwise(F.raise_error(F.lit("duplicate index in a vector")))).drop("n")


def to_arrays(vectors: DataFrame) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("idx", "val")))
    return vectors.groupBy("vec_id").agg(entries.alias("e")).select("vec_id", F.col("e.idx").alias("indices"), F.col("e.val").cast("array<float>").alias("values"))


def norms(vectors: DataFrame, ids: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """(key, n2, nnz): squared norm and entry count; ids adds vectors without entries."""
    out = vectors.groupBy(key).agg(F.sum(F.col("val") * F.col("val")).alias("n2"), F.count("*").alias("nnz"))
    if ids is None:
        return out
    return ids.select(key).join(out, key, "left").select(key, F.coalesce("n2", F.lit(0.0)).alias("n2"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


def split_by_position(vectors: DataFrame, parts: int, key: str = "vec_id") -> DataFrame:
    """Adds m, the balanced slice of the entry list (by position, not by dimension): the first nnz % parts slices hold one more."""
    w = Window.partitionBy(key)
    pos, n = F.row_number().over(w.orderBy("idx")) - 1, F.count("*").over(w)
    small, more = F.floor(F.col("_n") / parts), F.col("_n") % parts
    at = F.when(F.col("_p") < more * (small + 1), F.floor(F.col("_p") / (small + 1))).otherwise(more + F.floor((F.col("_p") - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return vectors.withColumns({"_p": pos, "_n": n}).withColumn("m", at.cast("int")).drop("_p", "_n")


def uniform_hash(x: Column, a: int, b: int) -> Column:
    """(a x + b) mod 2**31 - 1: the same in every engine, never overflows for x below 2**31."""
    return (F.lit(a).cast("long") * (x.cast("long") % PRIME) + F.lit(b)) % PRIME


def coefficients(seed: int, j: int) -> tuple[int, int]:
    """Multiplier and offset of the j-th hash of a seed."""
    a = (1_103_515_245 * (seed + 31 * j + 7) + 12_345) % (PRIME - 1) + 1
    b = (69_069 * (seed + 17 * j + 3) + 5) % PRIME
    return a, b


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Adds position, 0.. in the given order, by a range partition: each part is numbered by itself, after the sizes of those before it."""
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row a part
    return sorted_.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part").withColumn("position", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_part", "_before", "_at")


def renumber(ids: DataFrame) -> DataFrame:
    """Dense positions 0.. in id order, for users of positional ids."""
    return ranked(ids.select("vec_id"), "vec_id").select("vec_id", F.col("position").cast("int").alias("position"))
