"""Windows of a text that occur more than once in a corpus: what the two substring operators share.

Not every position can be a row. Every window of `length` units is represented
by its anchor, the leftmost smallest hashed k-unit string inside it (k is
length // 2 + 1), which the window's content alone decides: equal windows have
equal anchors at equal places. Consecutive windows with one anchor form one
*run*, about a row for every length / 4 units. Anchors that follow each other
in a text are at most k apart, so their strings touch or overlap, and a chain
of anchors with their distances fixes the whole string from first to last. The
first and the last k units of a text are anchors too.

1. `runs` lists the anchors. 2. `repeated` leaves out those whose string occurs
once: no window around them is repeated. 3. The operator's own method (ranks
that double, or paths of a graph) finds repeated strings of whole chains; runs
inside them are settled. 4. `edges` verifies the others, which lie where a
repeat begins, ends or branches, at their source coordinates: of the runs of
one anchor string, one of each different text is fetched and their windows are
compared one by one.

Results are whole: no count, group or text is capped. Rows are told apart by
doc_id and a hash of the text; rows that agree in both have equal results, and
are different places. Texts are read in pieces of BLOCK units, which bounds
memory. In periodic texts consecutive equal runs are folded, as the windows of
all of them are repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .textkit import U64, Spans, anchor_runs, chunks, mix, word_hashes, words

#: Different strings of one anchor that one task compares; larger groups are dealt.
GROUP_ROWS = 4096
#: Units of one text that are worked on at a time.
BLOCK = 1 << 20

KEY = ("doc_id", "th")


def byte_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, off


def word_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, off)
    return word_hashes(data, starts, ends), first


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def same_row(left: DataFrame, right: DataFrame):
    """Condition of a join on KEY, whose columns are called d and t on the right."""
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))


def as_right(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "d", "th": "t"})


_RUN = "kh long, uh long, doc_id long, th long, idx int, at int, left int, right int, n int"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]


def _pieces(values: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool, bool]]:
    """(units, offsets, units before them, whether the rows begin and end here)."""
    if len(off) > 2 or off[-1] <= 2 * BLOCK:
        yield values, off, 0, True, True
        return
    n = int(off[-1])
    for p in range(0, n - length + 1, BLOCK):
        end = min(n, p + BLOCK + length - 1)
        yield values[p:end], np.array([0, end - p]), p, p == 0, p + BLOCK > n - length


def _runs(units: Callable, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("doc_id"), batch.column("th")
            for r0, _, data, off in chunks(batch.column("text")):
                values, o = units(data, off)
                numbered = 0
                for part, offsets, before, begins, ends in _pieces(values, o, length):
                    columns, numbered = _run_rows(part, offsets, length, k, begins, ends, numbered)
                    if columns:
                        rows = pa.array(r0 + columns.pop("row"))
                        columns["at"] = columns["at"] + before
                        arrays = {c: pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int32), mask=columns["n"] == 0 if c == "kh" else None) for c, x in columns.items()}
                        arrays |= {"doc_id": ids.take(rows), "th": th.take(rows)}
                        yield pa.RecordBatch.from_arrays([arrays[c] for c in _RUN_NAMES], names=_RUN_NAMES)

    return run


def _run_rows(values: np.ndarray, off: np.ndarray, length: int, k: int, begins: bool, ends: bool, numbered: int) -> tuple[dict[str, np.ndarray], int]:
    """Runs and end anchors of some rows in order of their places; n is 0 in a folded stretch, whose windows are known to be repeated."""
    spans = Spans(values)
    strings, a = anchor_runs(spans, off, length, k)
    if not len(a["at"]):
        return {}, numbered
    row, lo, hi, at = (a[c] for c in ("row", "lo", "hi", "at"))
    kh = strings[at]
    # the first and last k units of rows that have windows, where they aren't anchors already
    has = np.unique(row)
    first, last = off[:-1][has], off[1:][has] - k
    lead = first[begins & (at[np.searchsorted(row, has)] > first)]
    tail = last[ends & (at[np.searchsorted(row, has, "right") - 1] < last)]
    extra = np.concatenate([lead, tail])
    uh = spans.hash(lo, hi + length) ^ mix(((at - lo) << 32 | (at - hi)).astype(U64))
    # equal neighbours: the first and last of them stay as rows, and the stretch is settled
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (uh[1:] == uh[:-1]) & (row[1:] == row[:-1]) & (lo[1:] == hi[:-1] + 1)
    inner = same[:-1] & same[1:]
    head, foot = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
    long = foot - head > 1
    head, foot = head[long], foot[long]
    fold_at, fold_hi, fold_row = lo[head], hi[foot], row[head]
    n = np.ones(len(at), np.int64)
    n[head] = foot - head
    keep = ~inner
    x_row = np.searchsorted(off, extra, "right") - 1
    x, f = np.zeros(len(extra), np.int64), np.zeros(len(head), np.int64)
    out = {
        "kh": np.concatenate([kh[keep], strings[extra], f.astype(U64)]), "uh": np.concatenate([uh[keep], strings[extra], f.astype(U64)]),
        "row": np.concatenate([row[keep], x_row, row[head]]), "at": np.concatenate([at[keep], extra, lo[head]]),
        "left": np.concatenate([(at - lo)[keep], x, f]), "right": np.concatenate([(at - hi)[keep], x + 1, lo[head] - hi[foot]]),
        "n": np.concatenate([n[keep], x + 1, f]), "place": np.concatenate([2 * at[keep], 2 * extra, 2 * at[head] + 1]),
    }
    order = np.argsort(out.pop("place"), kind="stable")
    out = {c: v[order] for c, v in out.items()}
    # a folded stretch takes a number too, so that what lies before and after it are no neighbours
    out["idx"] = np.arange(len(order)) - np.searchsorted(out["row"], out["row"]) + numbered
    out["at"] = out["at"] - off[:-1][out["row"]]
    return out, numbered + len(order)


def runs(docs: DataFrame, units: Callable, length: int) -> DataFrame:
    """One row for every run (kh: hash of its anchor string, uh: of its whole string, windows at - left to at - right), end anchor (right = 1, no window) and folded stretch (kh null)."""
    return cut(keyed(docs).mapInArrow(_runs(units, length, length // 2 + 1), _RUN))


def repeated(found: DataFrame) -> DataFrame:
    """The runs and end anchors whose anchor string occurs more than once."""
    twice = found.filter("kh is not null").groupBy("kh").agg(F.sum("n").alias("total")).filter("total > 1").select("kh")
    return cut(found.join(twice, "kh"))


def folded(found: DataFrame) -> DataFrame:
    """Ranges of repeated windows in folded stretches: doc_id, th, lo, hi."""
    return found.filter("kh is null").select(*KEY, F.col("at").alias("lo"), (F.col("at") - F.col("right")).alias("hi"))


_CONTEXT = pa.schema([("kh", pa.int64()), ("salt", pa.int32()), ("parts", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("left", pa.int32()), ("windows", pa.int32()), ("context", pa.binary())])
_CONTEXT_DDL = "kh long, salt int, parts int, n long, doc_id long, th long, lo int, left int, windows int, context binary"


def _contexts(units: Callable, length: int):
    """The units of the runs that are asked for, of every text: bytes, or eight bytes a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("doc_id", "th", "asked")}
                text = batch.column("text")[i]
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                values, _ = units(data, np.array([0, len(data)]))
                yield pa.RecordBatch.from_pylist(
                    [x | {"doc_id": row["doc_id"], "th": row["th"], "context": values[x["lo"] : x["lo"] + x["windows"] - 1 + length].tobytes()} for x in row["asked"]],
                    schema=_CONTEXT,
                )

    return run


_WINDOW = "kh long, core long, salt int, block array<struct<h:long,at:int,done:boolean>>, doc_id long, th long, lo int, hi int"
_WINDOW_NAMES = ["kh", "core", "salt", "block", "doc_id", "th", "lo", "hi"]


def _step(length: int) -> int:
    """Windows of one block: of the length // 2 around an anchor there are about as many blocks as windows in each."""
    return max(1, math.isqrt(length // 2))


def _compare(length: int, dtype):
    """Of contexts sorted by (kh, salt): which windows occur twice in a group.

    Gives ranges of repeated window starts (kh null). Of a group that is dealt
    to several parts it also gives the different window strings, to be counted
    over the parts (done: known to be repeated), a row for each block of
    neighbouring windows of a text. Blocks lie at fixed distances from the
    anchor, so windows that are equal are in blocks of the same core, the units
    that all windows of a block share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows of the group that the batch ends in wait for the next batch
            kh, salt = batch.column("kh").to_numpy(), batch.column("salt").to_numpy()
            at = np.flatnonzero((kh != kh[-1]) | (salt != salt[-1]))
            begin = int(at[-1]) + 1 if len(at) else 0
            if begin or (last is not None and last != (kh[0], salt[0])):
                held.append(batch.slice(0, begin))
                yield from _windows(pa.Table.from_batches(held), length, dtype)
                held = []
            held.append(batch.slice(begin))
            last = (kh[-1], salt[-1])
        if held:
            yield from _windows(pa.Table.from_batches(held), length, dtype)

    return run


def _windows(table: pa.Table, length: int, dtype) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    c = {x: table.column(x).combine_chunks() for x in ("doc_id", "th")}
    kh, salt, n, lo, left, windows, parts = (table.column(x).to_numpy() for x in ("kh", "salt", "n", "lo", "left", "windows", "parts"))
    raw = [x.as_buffer() for x in table.column("context")]
    values = np.frombuffer(b"".join(raw), dtype)
    base = np.cumsum([0, *(x.size // np.dtype(dtype).itemsize for x in raw[:-1])])
    who = np.repeat(np.arange(len(n)), windows)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows)
    spans, step = Spans(values), _step(length)
    cores = spans.hash_all(length - step + 1) if parts.max() > 1 else np.zeros(0, U64)
    hashes = spans.hash_all(length)[base[who] + nth]
    _, first, inverse, count = np.unique(hashes ^ mix(kh.view(U64))[who], return_index=True, return_inverse=True, return_counts=True)
    many = n[who] > 1
    sure = count > 1
    sure[inverse[many]] = True
    hit = sure[inverse] & ~many  # where the whole string is repeated, its windows are settled elsewhere
    start = lo[who] + nth
    new = np.ones(len(who), bool)
    new[1:] = ~hit[:-1] | (who[1:] != who[:-1])
    a = np.flatnonzero(hit & new)
    end = np.ones(len(who), bool)
    end[:-1] = new[1:] | ~hit[1:]
    b = np.flatnonzero(hit & end)
    dealt = np.sort(first[parts[who[first]] > 1])
    owner = who[dealt]
    block = (left[owner] - nth[dealt]) // step
    begin = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(block, prepend=-1))
    of, size = owner[begin], len(a) + len(begin)
    core = cores[base[of] + left[of] - block[begin] * step] ^ mix(block[begin].astype(U64))
    members = pa.StructArray.from_arrays([pa.array(hashes[dealt].view(np.int64)), pa.array(start[dealt].astype(np.int32)), pa.array(sure[inverse[dealt]])], names=["h", "at", "done"])
    ends = np.concatenate([np.zeros(len(a), np.int32), begin, [len(dealt)]]).astype(np.int32)
    none = np.arange(size) < len(a)
    blank = np.zeros(len(a), np.int64)
    whose = pa.array(np.concatenate([who[a], of]))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([blank, kh[of]]), mask=none), pa.array(np.concatenate([blank, core.view(np.int64)]), mask=none), pa.array(np.concatenate([blank, salt[of]]).astype(np.int32), mask=none),
            pa.ListArray.from_arrays(pa.array(ends), members), c["doc_id"].take(whose), c["th"].take(whose),
            pa.array(np.concatenate([start[a], start[dealt[begin]]]).astype(np.int32)), pa.array(np.concatenate([start[b], start[dealt[begin]]]).astype(np.int32)),
        ],
        names=_WINDOW_NAMES,
    )


def edges(docs: DataFrame, marked: DataFrame, units: Callable, length: int, dtype) -> DataFrame:
    """(doc_id, th, lo, hi): ranges of repeated window starts of the runs that are not `settled`, verified by the texts.

    marked: `repeated`'s rows with a column settled.
    """
    real = marked.filter("right <= left")
    # copies of a string are one row, so a group is dealt by how many different strings it has
    per = cut(real.groupBy("kh", "uh").agg(F.sum("n").alias("n"), F.min(F.struct(*KEY, "at", "left", "right")).alias("r"), F.min("settled").alias("settled")))
    copies = per.filter("n > 1 and not settled").select("kh", "uh")
    whole = real.filter("not settled").join(copies, ["kh", "uh"]).select(*KEY, (F.col("at") - F.col("left")).alias("lo"), (F.col("at") - F.col("right")).alias("hi"))
    groups = per.groupBy("kh").agg(F.count("*").alias("strings"), F.min("n").alias("least")).filter("strings > 1 and least = 1").select("kh", F.ceil(F.col("strings") / GROUP_ROWS).cast("int").alias("parts"))
    lo, windows = (F.col("r.at") - F.col("r.left")).alias("lo"), (F.col("r.left") - F.col("r.right") + 1).alias("windows")
    asked = per.join(groups, "kh").select("r.doc_id", "r.th", F.struct("kh", F.pmod(F.hash("uh"), F.col("parts")).alias("salt"), "parts", "n", lo, F.col("r.left").alias("left"), windows).alias("x"))
    # rows that agree in doc_id and text all give the strings asked of one, whose n is over 1 then
    asked = as_right(asked.groupBy(*KEY).agg(F.collect_list("x").alias("asked")))
    texts = keyed(docs)
    contexts = texts.join(asked, same_row(texts, asked)).select(*KEY, "text", "asked").mapInArrow(_contexts(units, length), _CONTEXT_DDL)
    found = cut(contexts.repartition("kh", "salt").sortWithinPartitions("kh", "salt").mapInArrow(_compare(length, dtype), _WINDOW))
    # of dealt groups, only blocks whose core is in several parts can hold windows that are
    across = found.filter("kh is not null")
    shared = across.groupBy("kh", "core").agg(F.min("salt").alias("x"), F.max("salt").alias("y")).filter("x < y").select("kh", "core")
    met = across.join(shared, ["kh", "core"]).select("kh", *KEY, F.inline("block"))
    twice = met.groupBy("kh", "h").agg(F.count("*").alias("c")).filter("c > 1").select("kh", "h")
    more = met.filter("not done").join(twice, ["kh", "h"]).select(*KEY, F.col("at").alias("lo"), F.col("at").alias("hi"))
    return whole.unionByName(found.filter("kh is null").select(*KEY, "lo", "hi")).unionByName(more)


def with_spans(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, text and the ranges of its repeated windows (null: none), for every row of docs."""
    per = as_right(windows.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    texts = keyed(docs)
    return texts.join(per, same_row(texts, per), "left").select("doc_id", "text", "spans")


def covered(n: int, spans: pa.Scalar, length: int) -> np.ndarray:
    """Mask of the units inside the given windows."""
    change = np.zeros(n + 1, np.int64)
    if spans.is_valid:
        lo, hi = (spans.values.field(c).to_numpy() for c in ("lo", "hi"))
        np.add.at(change, lo, 1)
        np.add.at(change, hi + length, -1)
    return np.cumsum(change[:n]) > 0
