"""The five distances as expressions over what an overlap join yields.

dot and inter are the dot product and number of shared entries of a pair;
qn2, bn2, qnnz, bnnz the squared norms and entry counts of its sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("dot", "euclidean", "cosine", "jaccard", "angular", "inner_product")


def metric(name: str) -> str:
    if (low := name.lower()) not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")
    return low


def cosine_similarity(dot: Column, qn2: Column, bn2: Column) -> Column:
    return F.when((qn2 == 0) | (bn2 == 0), F.lit(0.0)).otherwise(dot / F.sqrt(qn2 * bn2))  # exactly 1 for a vector and itself; squares of single floats fit


def jaccard_similarity(inter: Column, qnnz: Column, bnnz: Column) -> Column:
    return F.when(qnnz + bnnz == 0, F.lit(1.0)).otherwise(inter / (qnnz + bnnz - inter))


def distance(name: str, dot: Column, inter: Column, qn2: Column, bn2: Column, qnnz: Column, bnnz: Column) -> Column:
    """Smaller is nearer. `dot` is the raw product, as the metric is defined; `inner_product` its negative."""
    cos = cosine_similarity(dot, qn2, bn2)
    return {
        "dot": dot,
        "inner_product": -dot,
        "euclidean": F.sqrt(F.greatest(qn2 + bn2 - 2 * dot, F.lit(0.0))),
        "cosine": 1 - cos,
        "jaccard": 1 - jaccard_similarity(inter, qnnz, bnnz),
        "angular": F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))) / F.lit(3.141592653589793),
    }[metric(name)]
