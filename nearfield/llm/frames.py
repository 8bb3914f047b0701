"""Materialising intermediate tables and joins that broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.plans.store import cut, workdir

#: Most rows of narrow integers that a join sends to every executor (about 100 MB once hashed).
BROADCAST_ROWS = 1_000_000


def narrow(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint df (already materialised, narrow) for a broadcast if it is counted to have few rows; else leave it to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


__all__ = ["cut", "narrow", "workdir"]
