"""Mixing sources to target weights, without replacement within a pass.

Each source is the sequence of its documents' words, packed into blocks of
BLOCK words. The mix is a list of slots of one block each, in output shards of
about SHARD_SLOTS slots. How many slots a source has in each shard is drawn from
the multinomial law, given the source's number of slots, by binomial draws down
a binary tree over the shards; a task draws the counts of its own shards only.
The j-th slot of a source takes block P_e(j mod m), where m is its number of
blocks, e = j div m the pass and P_e a pseudorandom permutation of the indexes
(a Feistel network); slots and blocks join by index, and what a document gives
is counted from that join.

Weights repeat 5, 2, 1 over the sources in code point order, null last. A
source's target is at most LIMIT times its size, the excess shared by weight
among the others until none is above. Every draw depends on the seed and keys
alone, so reruns agree. Documents without words take no part (taken 0); a
repeated doc_id, and a repeated row, is a document of its own. Sources are
assumed to be thousands at most: a row for each is held by the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import cut
from .textkit import U64, mix as scrambled

BLOCK = 128
WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = 20_240_601
#: Documents of a source that are numbered together.
BUCKET_ROWS = 10_000
SHARD_SLOTS = 4096
#: Shards whose slots one task makes.
SHARDS_OF_TASK = 64

_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], limit: int = LIMIT) -> list[float]:
    """Shares of sum(sizes) by weight, none above limit times its size."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > limit * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(limit * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def _sized(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "source", F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size")))


def plan(sized: DataFrame) -> list[dict]:
    """Per source: sid, source, rows, size, blocks, target and slots."""
    rows = [r.asDict() for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()]
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in rows], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    for i, (r, t) in enumerate(zip(rows, goal)):
        blocks = -(-r["size"] // BLOCK)
        # the last block is short: slots are counted by the mean length of a block
        r |= {"sid": i, "target": t, "blocks": blocks, "slots": min(LIMIT * blocks, round(t * blocks / r["size"])) if r["size"] else 0}
    return rows


def _numbered(sized: DataFrame, rows: list[dict]) -> DataFrame:
    """Adds sid, source_size, target, start (the document's first word in its source's sequence) and ordinal, which tells rows of one doc_id, text and source apart."""
    known = [(r["source"], r["sid"], r["size"], r["target"], -(-r["rows"] // BUCKET_ROWS)) for r in rows]
    table = sized.sparkSession.createDataFrame(known, "s string, sid int, source_size long, target double, buckets long")
    own = sized.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th"), F.col("buckets"))).drop("buckets")
    per = own.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = cut(per.select("sid", "bucket", before.alias("before")))
    order = Window.partitionBy("sid", "bucket").orderBy("doc_id", "th")
    within = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumns({"within": within, "ordinal": F.row_number().over(order) - F.rank().over(order)})
    return own.join(per, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "bucket")


def permuted(x: np.ndarray, m: int, *key: int) -> np.ndarray:
    """The places of x (below m) in a pseudorandom permutation of 0..m-1: four Feistel rounds, repeated for what falls beyond m."""
    half = max(1, (int(m - 1).bit_length() + 1) // 2)
    mask, keys = U64((1 << half) - 1), scrambled(np.random.default_rng(key).integers(0, 1 << 63, 4).astype(U64))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U64(half), v & mask
        for k in keys:
            left, right = right, left ^ (scrambled(right ^ k) & mask)
        return left << U64(half) | right

    out = once(x.astype(U64))
    while len(beyond := np.flatnonzero(out >= m)):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def shard_counts(slots: int, shards: int, lo: int, hi: int, *key: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a source's slots dealt to all shards: how many the shards lo to hi - 1 have, and how many those before each."""
    first, count = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
    todo = [(0, shards, 0, slots)]
    while todo:
        a, b, before, n = todo.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            first[a - lo], count[a - lo] = before, n
            continue
        middle = (a + b) // 2
        left = int(np.random.default_rng([*key, a, b]).binomial(n, (middle - a) / (b - a))) if n else 0
        todo += [(a, middle, before, left), (middle, b, before + left, n - left)]
    return first, count


def shards_of(rows: list[dict]) -> int:
    return max(1, round(sum(r["slots"] for r in rows) / SHARD_SLOTS))


def _slots(rows: list[dict], shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                lo, hi = task * SHARDS_OF_TASK, min(shards, (task + 1) * SHARDS_OF_TASK)
                drawn = [(r, *shard_counts(r["slots"], shards, lo, hi, seed, r["sid"], 1)) for r in rows if r["slots"]]
                for shard in range(lo, hi):
                    sid, block = [], []
                    for r, first, count in drawn:
                        j = first[shard - lo] + np.arange(count[shard - lo])
                        for turn in np.unique(j // r["blocks"]).tolist():
                            of = j[j // r["blocks"] == turn] - turn * r["blocks"]
                            block.append(permuted(of, r["blocks"], seed, r["sid"], 2, turn))
                            sid.append(np.full(len(of), r["sid"], np.int32))
                    if block:
                        order = np.random.default_rng([seed, shard, 3]).permutation(sum(map(len, block)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), shard)), pa.array(np.arange(len(order))), pa.array(np.concatenate(sid)[order]), pa.array(np.concatenate(block)[order])], names=["shard", "slot", "sid", "block"])

    return run


def slot_table(spark: SparkSession, rows: list[dict], seed: int = SEED) -> DataFrame:
    """The output in order: shard, slot, sid and block, drawn from `plan`'s rows on the executors."""
    slim, shards = [{c: r[c] for c in ("sid", "slots", "blocks")} for r in rows], shards_of(rows)
    tasks = -(-shards // SHARDS_OF_TASK)
    return spark.range(0, tasks, 1, min(tasks, 1 << 16)).mapInArrow(_slots(slim, shards, seed), "shard long, slot long, sid int, block long")


def pieces(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The blocks of every document (a null block where it has no words): its key, block, lo, hi (its words there), times, and the source's figures."""
    sized = _sized(docs)
    rows = plan(sized)
    times = slot_table(docs.sparkSession, rows, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    out = _numbered(sized, rows).withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    out = out.withColumns({"lo": F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0)), "hi": F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size"))})
    dealt = out.filter("block is not null").join(times, ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return dealt.unionByName(out.filter("block is null").withColumn("times", F.lit(0).cast("long")))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, th, sid, ordinal, size, source_size, target, taken, and ranges, its word ranges that are taken with their times."""
    taken = F.coalesce((F.col("hi") - F.col("lo")) * F.col("times"), F.lit(0))
    key = ["doc_id", "th", "sid", "ordinal", "start", "size", "source_size", "target"]
    return pieces(docs, seed).groupBy(*key).agg(F.sum(taken).alias("taken"), F.array_sort(F.collect_list(F.when(F.col("times") > 0, F.struct("lo", "hi", "times")))).alias("ranges"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ranges = r["ranges"]
            spans = None
            for turn in range(max((x["times"] for x in ranges), default=0)):
                runs: list[list[int]] = []
                for x in ranges:
                    if x["times"] > turn:
                        if runs and runs[-1][1] == x["lo"]:
                            runs[-1][1] = x["hi"]
                        else:
                            runs.append([x["lo"], x["hi"]])
                if runs == [[0, r["size"]]]:
                    text = r["text"]
                else:
                    spans = spans or [m.span() for m in word.finditer(r["text"])]
                    text = "\n".join(r["text"][spans[a][0] : spans[b - 1][1]] for a, b in runs)
                out.append({"doc_id": r["doc_id"], "text": text, "lang": r["lang"], "source": r["source"], "n_chars": len(text)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as rows of documents: for each pass, what it takes of a document (pieces joined by a newline)."""
    # sids follow the names of the sources, so rows of one doc_id and text have the same order by either
    dealt = cut(mix(docs, seed).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "sid", "ordinal", "size", "taken", "ranges"))
    twice = cut(dealt.groupBy("d", "t").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("d").alias("rd"), F.col("t").alias("rt")))
    again = F.col("d").eqNullSafe(F.col("rd")) & (F.col("t") == F.col("rt"))
    taken = dealt.filter("taken > 0").drop("taken")
    keyed = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("th"))
    here = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    both = keyed.join(cut(taken.join(twice, again, "left_anti")), here).drop("sid", "ordinal")
    if not twice.isEmpty():  # only repeated rows are numbered, by a shuffle of their texts
        copies = keyed.join(twice, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("th") == F.col("rt")), "left_semi")
        copies = copies.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.asc_nulls_last("source"), "lang")))
        order = Window.partitionBy("d", "t").orderBy("sid", "ordinal")
        numbered = dealt.join(twice, again, "left_semi").withColumn("nth", F.row_number().over(order)).filter("taken > 0").drop("taken")
        both = both.unionByName(copies.join(numbered, here & (F.col("copy") == F.col("nth"))).drop("copy", "nth", "sid", "ordinal"))
    return both.select("doc_id", "text", "lang", "source", "size", "ranges").mapInArrow(_texts, "doc_id long, text string, lang string, source string, n_chars long")


__all__ = ["mix", "mixed_documents", "permuted", "pieces", "plan", "shard_counts", "slot_table", "targets"]
