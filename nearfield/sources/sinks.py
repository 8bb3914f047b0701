"""Files of vectors and true neighbours, written by ranges of ids: MessagePack, CSR and ground-truth files.

Ids in a file are positions. Every writer returns (file, id, key): the name of
the file, the position in it and the id that was written there. A file holds at
most FILE_ROWS rows and is written under a name of its attempt, then renamed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.plans.store import cut

FILE_ROWS = 50_000


def _packed_number(x: int | float) -> bytes:
    return struct.pack(">Bd", 0xCB, x) if isinstance(x, float) else struct.pack(">BQ", 0xCF, x)


def _packed_list(items: list) -> bytes:
    return struct.pack(">BI", 0xDD, len(items)) + b"".join(map(_packed_number, items))


def msgpack_vectors(rows: list[dict]) -> bytes:
    """A list of maps {indices, values}."""
    name = lambda s: bytes([0xA0 | len(s)]) + s
    return struct.pack(">BI", 0xDD, len(rows)) + b"".join(b"\x82" + name(b"indices") + _packed_list(r["indices"]) + name(b"values") + _packed_list(r["values"]) for r in rows)


def msgpack_truth(rows: list[dict]) -> bytes:
    """A list of lists of ids."""
    return struct.pack(">BI", 0xDD, len(rows)) + b"".join(_packed_list(r["indices"]) for r in rows)


def csr(rows: list[dict]) -> bytes:
    sizes = [len(r["indices"]) for r in rows]
    idx = np.concatenate([np.asarray(r["indices"], "<i4") for r in rows])
    val = np.concatenate([np.asarray(r["values"], "<f4") for r in rows])
    head = struct.pack("<3q", len(rows), int(idx.max()) + 1 if len(idx) else 0, len(idx))
    return head + np.cumsum([0, *sizes]).astype("<i8").tobytes() + idx.tobytes() + val.tobytes()


def truth_file(rows: list[dict]) -> bytes:
    """Rows of one length: ids, then scores."""
    d = len(rows[0]["indices"])
    if any(len(r["indices"]) != d for r in rows):
        raise ValueError("ground truth of different lengths")
    return struct.pack("<2I", len(rows), d) + np.array([r["indices"] for r in rows], "<i4").tobytes() + np.array([r["values"] for r in rows], "<f4").tobytes()


def _writer(folder: str, encode: Callable[[list[dict]], bytes], file_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n = TaskContext.get(), [], 0
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)

        def flush() -> pa.RecordBatch:
            nonlocal n
            name = f"part-{task.partitionId():05d}-{n:05d}"
            draft = f"{root}/.{name}-{task.taskAttemptId()}"
            fs.create_dir(root)
            with fs.open_output_stream(draft, compression=None) as sink:
                sink.write(encode(held))
            fs.move(draft, f"{root}/{name}")
            n += 1
            return pa.RecordBatch.from_pydict({"file": [name] * len(held), "id": pa.array(range(len(held)), pa.int64()), "key": pa.array([r["key"] for r in held], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == file_rows:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return run


def write(rows: DataFrame, folder: str, encode: Callable[[list[dict]], bytes], file_rows: int = FILE_ROWS) -> DataFrame:
    """rows: key, indices, values (arrays)."""
    ordered = rows.select("key", "indices", "values").repartitionByRange("key").sortWithinPartitions("key")
    return cut(ordered.mapInArrow(_writer(folder, encode, file_rows), "file string, id long, key long"))


def write_vectors(vectors: DataFrame, folder: str, encode: Callable[[list[dict]], bytes] = msgpack_vectors, file_rows: int = FILE_ROWS) -> DataFrame:
    """Long form (vec_id, idx, val), as MessagePack lists or as CSR files."""
    entries = F.array_sort(F.collect_list(F.struct("idx", "val")))
    rows = vectors.groupBy(F.col("vec_id").alias("key")).agg(entries.alias("e")).select("key", F.col("e.idx").alias("indices"), F.col("e.val").alias("values"))
    return write(rows, folder, encode, file_rows)


def write_truth(truth: DataFrame, folder: str, encode: Callable[[list[dict]], bytes] = msgpack_truth, file_rows: int = FILE_ROWS) -> DataFrame:
    """(query_id, rnk, vec_id, score), as MessagePack lists or as ground-truth files."""
    entries = F.array_sort(F.collect_list(F.struct("rnk", "vec_id", "score")))
    rows = truth.groupBy(F.col("query_id").alias("key")).agg(entries.alias("e")).select("key", F.col("e.vec_id").alias("indices"), F.col("e.score").alias("values"))
    return write(rows, folder, encode, file_rows)


def named(read: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """What was read (file, key), with the ids that were written instead of positions."""
    known = written.select(F.col("file").alias("_name"), F.col("id").alias("_id"), F.col("key").alias("_key"))
    name = F.element_at(F.split("file", "/"), -1)
    return read.join(known, (name == F.col("_name")) & (F.col(key) == F.col("_id"))).withColumn(key, F.col("_key")).drop("file", "_name", "_id", "_key")
