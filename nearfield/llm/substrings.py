"""Removal of long repeated passages: by words (De Bruijn graph) and by bytes (prefix doubling).

Both work on the anchors of `repeats`, about one position in length / 4, whose
strings of k = length // 2 + 1 units are the graph's k-mers and the first ranks.

**By words.** Nodes are the k-mers at anchors that occur more than once; an
edge leads to the next anchor of a text, with its distance. Degrees are counted
over all places and joined to them. An edge is nonbranching if every place of
its first node goes on to the same node at the same distance and every place of
its second comes from there; texts that begin or end at a node count as a
branch. Chains of such edges are compacted to paths, which all their places
pass from end to end, so a path of `length` words or more is a repeated span.

**By bytes.** A position's first rank is that of its k bytes. In each round the
pair of a position's rank and that of the position 1, 2, 4, ... anchors further
on, with their distance, is ranked anew: Spark sorts the pairs that occur more
than once and numbers them; positions whose pair is unique leave, and so do
those whose string has passed `length` bytes, which are repeated spans.

Where a repeated span begins or ends between two anchors, its source
coordinates decide (`repeats.edges`).

Defined cases: null and empty texts have no units and nothing is removed;
repeated rows count as different places; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import cut
from .repeats import KEY, byte_units, covered, edges, folded, repeated, runs, with_spans, word_units

WORDS = 35
BYTES = 400


def _runs_of(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))


def _cut_words(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(i) for i in range(3))):
                found = (text.as_py() or "").encode().split()
                kept, gone = found, np.zeros(0, bool)
                if spans.is_valid:
                    gone = covered(len(found), spans, length)
                    kept = list(compress(found, (~gone).tolist()))
                joined = b" ".join(kept)
                at = _runs_of(gone).tolist()
                out.append((doc.as_py(), len(found), len(found) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode(), [{"lo": a, "hi": b} for a, b in zip(at[::2], at[1::2])]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, _WORD_TYPES)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"])

    return run


_SPAN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_WORD_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _SPAN]


def _beside(step: int) -> Window:
    """The anchor so many places further on in the same text."""
    return Window.partitionBy(*KEY).orderBy("idx").rangeBetween(step, step)


def paths(places: DataFrame, k: int, length: int) -> DataFrame:
    """Adds to anchors the first and last anchor (a, z) of the compacted path that they lie on, and whether it settles their windows."""
    after, before = _beside(1), _beside(-1)
    near = lambda w, sign: F.xxhash64(F.max("kh").over(w), sign * (F.max("at").over(w) - F.col("at")))
    beside = cut(places.withColumns({"out": F.when(F.max("kh").over(after).isNotNull(), near(after, 1)), "in": F.when(F.max("kh").over(before).isNotNull(), near(before, -1))}))
    one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    degrees = beside.groupBy("kh").agg(F.coalesce(one("out"), F.lit(False)).alias("one_out"), F.coalesce(one("in"), F.lit(False)).alias("one_in"))
    known = beside.join(degrees, "kh")
    follows = F.coalesce(F.max("one_out").over(before) & F.col("one_in"), F.lit(False))
    numbered = known.withColumn("path", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("path").over(Window.partitionBy(*KEY).orderBy("idx").rangeBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*KEY, "path")
    ended = numbered.withColumns({"a": F.min("at").over(whole), "z": F.max("at").over(whole)})
    settled = (F.col("z") + k - length >= F.col("a")) & (F.col("at") - F.col("left") >= F.col("a")) & (F.col("at") - F.col("right") <= F.col("z") + k - length)
    return cut(ended.select(*places.columns, "a", "z", settled.alias("settled")))


def debruijn_dedup(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """Per row: n_words, n_removed, kept_text (words joined by a space), its sha256, and the removed word spans."""
    k, found = length // 2 + 1, runs(docs, word_units, length)
    marked = paths(repeated(found), k, length)
    passed = marked.filter(F.col("z") + k - length >= F.col("a")).select(*KEY, F.col("a").alias("lo"), (F.col("z") + k - length).alias("hi")).distinct()
    windows = folded(found).unionByName(passed).unionByName(edges(docs, marked, word_units, length, np.uint64))
    return with_spans(docs, windows).mapInArrow(_cut_words(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<lo:int,hi:int>>")


def _cut_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(i) for i in range(3))):
                data = (text.as_py() or "").encode()
                kept, at = data, []
                if spans.is_valid:
                    at = _runs_of(covered(len(data), spans, length)).tolist()
                    kept = b"".join(data[a:b] for a, b in zip([0, *at[1::2]], [*at[::2], len(data)]))
                out.append((doc.as_py(), len(data), len(data) - len(kept), len(at) // 2, hashlib.sha256(kept).hexdigest(), kept, [{"lo": a, "hi": b} for a, b in zip(at[::2], at[1::2])]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, _BYTE_TYPES)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])

    return run


_BYTE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), _SPAN]


def doubled(places: DataFrame, k: int, length: int) -> DataFrame:
    """Repeated strings of `length` bytes or more that begin at anchors: doc_id, th, idx, at, reach."""
    state = places.select(*KEY, "idx", "at", F.col("kh").alias("rank"), F.lit(k).alias("reach"), F.lit(False).alias("past"))
    past, turn = None, 0
    while True:
        w = _beside(1 << turn)
        pairs = state.withColumns({"next_rank": F.max("rank").over(w), "distance": F.max("at").over(w) - F.col("at"), "next_reach": F.max("reach").over(w)})
        pairs = cut(pairs.filter("not past and next_rank is not null and distance <= reach").select(*KEY, "idx", "at", "rank", "distance", "next_rank", (F.col("distance") + F.col("next_reach")).alias("reach")))
        pair = ["rank", "distance", "next_rank"]
        twice = pairs.groupBy(*pair).agg(F.count("*").alias("n")).filter("n > 1").select(*pair)
        # numbers in the order of the pairs, different from those of other rounds
        ranked = cut(twice.repartitionByRange(*pair).sortWithinPartitions(*pair).withColumn("new", F.shiftleft(F.monotonically_increasing_id(), 6) + turn))
        again = cut(pairs.join(ranked, pair).select(*KEY, "idx", "at", F.col("new").alias("rank"), "reach", (F.col("reach") >= length).alias("past")))
        done = again.filter("past")
        past = done if past is None else past.unionByName(done)
        if again.filter("not past").isEmpty():
            return past.select(*KEY, "idx", "at", "reach")
        state, turn = again.filter("not past").unionByName(past), turn + 1


def suffix_dedup(docs: DataFrame, length: int = BYTES) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, the kept bytes, their sha256, and the removed byte spans."""
    k, found = length // 2 + 1, runs(docs, byte_units, length)
    places = repeated(found)
    long = doubled(places, k, length).withColumn("hi", F.col("at") + F.col("reach") - length)
    # a run is settled if a repeated string from one of the two anchors before it holds its windows
    none = {c: F.lit(None).cast("int") for c in ("kh", "uh", "left", "right", "n")}
    both = places.withColumn("hi", F.lit(None).cast("int")).unionByName(long.drop("reach").withColumns({c: x.cast(places.schema[c].dataType) for c, x in none.items()}))
    lo, hi = F.col("at") - F.col("left"), F.col("at") - F.col("right")
    holds = lambda j: F.coalesce((F.max("at").over(_beside(-j)) <= lo) & (F.max("hi").over(_beside(-j)) >= hi), F.lit(False))
    marked = cut(both.withColumn("settled", holds(1) | holds(2)).filter("kh is not null").drop("hi"))
    windows = folded(found).unionByName(long.select(*KEY, F.col("at").alias("lo"), "hi")).unionByName(edges(docs, marked, byte_units, length, np.uint8))
    return with_spans(docs, windows).mapInArrow(_cut_bytes(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<lo:int,hi:int>>")
