"""Token ids in seekable zstandard files.

File layout (the public seekable zstandard format): independent frames with
content checksums, each holding the ids of whole documents, then a skippable
frame with the document table, then a skippable frame with the seek table
(compressed size, decompressed size and checksum of every frame). A reader
takes the seek table from the end of the file, the document table before it,
and decompresses only the frames that hold the documents asked for.

Ids are little-endian, 2 bytes wide if every id of the vocabulary fits, else 4.
A file holds a range of doc_id, in ascending order (null first;
equal doc_ids by a hash of the text), so files in order are the corpus in order. A file is
written under a name of its task attempt and then renamed: a repeated attempt
replaces a file by the same bytes. A file is closed at FILE_BYTES of ids, so no
file or table of documents grows with the corpus. Empty and null texts are the
end id alone; strings of special tokens in a text are those tokens, as the
library has them by default.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import cut, workdir

FRAME_BYTES = 1 << 17
#: Bytes of ids after which a file is closed.
FILE_BYTES = 1 << 28
#: Most bytes of pieces and ids that a worker remembers from task to task, each taken with PIECE bytes of its own.
CACHE_BYTES = 200 << 20
PIECE = 200
NULL_ID = -(1 << 63)

# Fixed values of the seekable zstandard format.
_SKIPPABLE = 0x184D2A5E
_DOC_TABLE = 0x184D2A50
_SEEKABLE = 0x8F92EAB1
_CHECKSUMS = 0x80


class _Whole(Exception):
    """A text that can't be put together from pieces."""


#: Words that the byte-level rule takes as one piece, and the ASCII punctuation after them as another.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\\[-`{-~]*)")


class _Pieces(dict):
    """Ids of pieces between spaces, as bytes; a new piece is learnt when it is asked for."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self.learn(piece)
        return out


class Encoder:
    """A byte-level BPE tokenizer that remembers the ids of pieces between spaces.

    Text is cut where a space or a newline stands between two characters that
    are no white space; the tokenizer's own rule never joins across such a
    place. Plain words go to the library's merges as they are, other pieces
    through its whole rule. Texts with other runs of white space, or with the
    string of a special token, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # ours replaces it
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.newline = self._packed(self._ids("\n"))
        self.model, self.held = self.tok.model, 0
        self.pieces, self.marks = _Pieces(self._learn), _Pieces(self._mark)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {x: byte_level.pre_tokenize_str(chr(x))[0][0] for x in range(0xC0, 0x250)}
        self.space = byte_level.pre_tokenize_str(" ")[0][0]
        self.plain = self.tok.normalizer is None and isinstance(self.tok.pre_tokenizer, pre_tokenizers.ByteLevel)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _mark(self, marks: str) -> bytes:
        return self._packed(self._ids(marks))

    def _learn(self, piece: str) -> bytes:
        self.held += PIECE + 2 * len(piece)
        line = piece[:1] == "\n"
        body = piece[1:] if line else piece
        if self.plain and (m := _PLAIN.fullmatch(body)):
            word = m[1] if body.isascii() else m[1].translate(self.letters)
            out = self._packed([t.id for t in self.model.tokenize(word if line else self.space + word)])
            if m[2]:
                out += self.marks[m[2]]
            return self.newline + out if line else out
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Whole
        return self._packed(self._ids(piece if line else " " + piece))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.pieces.clear()
            self.held = 0
        out, known = [], self.pieces.__getitem__
        for t in texts:
            try:
                if not t or " \n" in t or any(x in t for x in self.special):
                    raise _Whole
                head, *rest = t.replace("\n", " \n").split(" ")
                if not head or head[-1].isspace():
                    raise _Whole
                out.append(self._packed(self._ids(head)) + b"".join(map(known, rest)))
            except _Whole:
                out.append(self._packed(self._ids(t)))
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary, kept for its next task: in a module of this name, as functions that are sent by value bring globals of their own."""
    held = vars(sys.modules.setdefault("nearfield_worker", types.ModuleType("nearfield_worker")))
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class Writer:
    """Appends documents to one file; close() writes the tables."""

    def __init__(self, sink, width: int, frame_bytes: int = FRAME_BYTES) -> None:
        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.pending: list[bytes] = []
        self.size, self.frames, self.docs = 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        self.pending.append(ids)
        self.size += len(ids)
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids) // self.width, len(self.frames)))

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        table = zstandard.ZstdCompressor().compress(np.array(self.docs, "<i8").tobytes())
        self.sink.write(struct.pack("<II", _DOC_TABLE, len(table) + 9) + table + struct.pack("<IIB", len(self.docs), len(table), self.width))
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), _CHECKSUMS, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(seek)) + seek)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _SEEKABLE:
            raise ValueError("not a seekable file")
        start = end - 9 - 12 * n - 8
        seek = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.raw, self.sums = seek.T
        self.offset = np.concatenate([[0], np.cumsum(self.packed)])
        docs, size, self.width = struct.unpack("<IIB", self._at(start - 9, 9))
        table = zstandard.ZstdDecompressor().decompress(self._at(start - 9 - size, size), max_output_size=24 * docs or 1)
        self.docs = np.frombuffer(table, "<i8").reshape(-1, 3)
        ends = np.cumsum(self.docs[:, 1]) * self.width
        base = np.concatenate([[0], np.cumsum(self.raw)])[self.docs[:, 2]]
        self.start, self.end = ends - self.docs[:, 1] * self.width - base, ends - base
        self.have, self.data = -1, b""
        self.decompressed = 0

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if k != self.have:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offset[k]), int(self.packed[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.have, self.data = k, raw
            self.decompressed += 1
        return self.data

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file, as unsigned 32-bit integers."""
        raw = self.frame(int(self.docs[i, 2]))[self.start[i] : self.end[i]]
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int | None) -> np.ndarray:
        """Places of a doc_id in the file, which is in ascending order."""
        key = NULL_ID if doc_id is None else doc_id
        return np.arange(*(int(np.searchsorted(self.docs[:, 0], key, s)) for s in ("left", "right")))


def _write(folder: str, vocabulary: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        part, own = task.partitionId(), encoder(vocabulary)
        end, width = np.array([end_id], own.dtype).tobytes(), own.dtype.itemsize

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    some = batch.slice(a, 256)
                    for doc, ids in zip(some.column("doc_id").to_pylist(), own.encode([t or "" for t in some.column("text").to_pylist()])):
                        yield doc, ids + end

        docs = encoded()
        ahead = next(docs, None)
        for nth in count():
            if ahead is None:
                return
            name, draft = f"ids-{part:06d}-{nth:04d}.zst", f"{root}/.{part}-{task.taskAttemptId()}-{nth}"
            with fs.open_output_stream(draft, compression=None) as sink:
                writer, size = Writer(sink, width), 0
                while ahead is not None and size < file_bytes:
                    writer.add(*ahead)
                    size += len(ahead[1])
                    ahead = next(docs, None)
                writer.close()
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part << 20 | nth]), "path": [f"{folder}/{name}"], "n_docs": pa.array([len(writer.docs)]), "n_ids": pa.array([size // width], pa.int64())})

    return run


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text, write the files to `folder` (a URI all executors reach); one row per file: part, path, n_docs, n_ids, start."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("th")]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("th")
    files = cut(ordered.mapInArrow(_write(folder, vocabulary, end_id, file_bytes), "part long, path string, n_docs long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = pyarrow.fs.FileSystem.from_uri(row["path"])
            with fs.open_input_file(path) as source:
                reader = Reader(source)
                n = len(reader.docs)
                crc = [zlib.crc32(reader.ids(i).tobytes()) for i in range(n)]
            ids, sizes = reader.docs[:, 0], reader.docs[:, 1]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, mask=ids == NULL_ID), "start": pa.array(np.cumsum(sizes) - sizes + row["start"]), "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array(crc, pa.int64()), "file": pa.array(np.full(n, row["part"])), "frame": pa.array(reader.docs[:, 2]),
                }
            )


def read_ids(files: DataFrame) -> DataFrame:
    """Read files of write_ids back: doc_id, start, n_tokens, ids_crc32, file, frame of every document."""
    n = max(1, files.count())
    return files.repartition(n, "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, file long, frame long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the ids of docs and describe each document from the files."""
    return read_ids(write_ids(docs, vocabulary, end_id, folder or workdir(docs.sparkSession)))
