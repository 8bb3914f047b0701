"""Searches of a stream of queries over a fitted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from nearfield.index import Index


def search_stream(index: Index, queries: DataFrame, k: int, path: str) -> DataStreamWriter:
    """A writer that answers each batch of a stream (query_id, indices, values) with rows below path.

    Every row of the stream is one whole query, so no state is kept. A batch that is run again after a failure
    replaces its own folder, so each query is answered once. Start it with start(), after a checkpointLocation.
    """

    def answer(batch: DataFrame, n: int) -> None:
        rows = batch.select("query_id", F.explode(F.arrays_zip("indices", "values")).alias("e"))
        long = rows.select("query_id", F.col("e.indices").cast("int").alias("idx"), F.col("e.values").cast("double").alias("val"))
        index.search(long, k).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return queries.writeStream.foreachBatch(answer)
