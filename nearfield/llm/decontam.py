"""Benchmark decontamination: SimHash of item-sized windows, looked up by Hamming blocks.

A document is contaminated by an item of n words if one of its windows of n
words has a weighted Jaccard similarity of THRESHOLD or more to it; shingles
are five consecutive lower-cased words, weighted by how often they occur in the
window or item.

1. A window of weight a and an item of weight b that reach THRESHOLD share a
   weight of 4/9 (a + b) or more, so at least so many of the window's places
   hold a shingle of the item. Every start whose window passes this count is
   taken, wherever the shingles lie in the item; the others need no fingerprint.
2. Windows and items get a 64-bit SimHash over their weighted shingles.
3. Fingerprints are cut into 5 blocks. Two that differ in at most RADIUS = 19
   bits differ in at most 3 bits in some block, so an index of the items under
   all block values up to 3 flips away meets every such pair by equality.
4. Pairs within the radius are verified by their exact similarity.

At similarity 0.8 the expected distance is about 9 bits (standard deviation
2.8); RADIUS lies more than three deviations above it.

Only DataFrame functions are used. Texts or items under five words are one
shingle of all their words; null and empty ones match nothing. Rows with the
same doc_id are reported once, but `decontaminate` drops only those whose text leaks; so are items with the same item_id, by the best
window of any of their texts. A null item_id is an id. A document shorter than an item is one window.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, narrow

SHINGLE = 5
THRESHOLD = 80
RADIUS = 19
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingled(df: DataFrame) -> DataFrame:
    """Adds n (words) and s (shingle hashes in order) from the column text.

    The word hashes are bound to a lambda's variable, so that they are computed
    once for a row and not where the optimizer would repeat their expression.
    """

    def shingles(hashes: Column) -> Column:
        n = F.size(hashes)
        long = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(SHINGLE))))
        short = F.when(n > 0, F.array(F.xxhash64(F.concat(hashes, F.array(F.lit(-1).cast("long")))))).otherwise(F.array().cast("array<long>"))
        return F.struct(n.alias("n"), F.when(n >= SHINGLE, long).otherwise(short).alias("s"))

    hashes = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))
    return df.withColumn("r", F.get(F.transform(F.array(hashes), shingles), F.lit(0))).select(*df.columns, "r.n", "r.s")


def _fingerprint(weighted: DataFrame, *keys: str) -> DataFrame:
    """SimHash of each key over its rows (h, c: shingle and weight)."""
    # the bits go by lambdas: 64 sums are as many expressions for the driver to plan and compile, for windows and again for items
    vote = lambda b: F.aggregate("held", F.lit(0).cast("long"), lambda v, x: v + F.when(F.getbit(x["h"], b) == 1, x["c"]).otherwise(-x["c"]))
    bit = lambda fp, b: F.when(vote(b) > 0, fp.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(fp)
    held = weighted.groupBy(*keys).agg(F.collect_list(F.struct("h", "c")).alias("held"))
    return held.select(*keys, F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit).alias("fp"))


def _block(fp: Column, k: int) -> Column:
    start, width = BLOCKS[k]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(most + 1) for c in combinations(range(width), r)]


def _merged(df: DataFrame) -> DataFrame:
    """Hint df for a merge join: a broadcast by several columns takes 64 MB of the driver's heap at least, however small it is."""
    return df.hint("merge")


def hamming_pairs(left: DataFrame, right: DataFrame, also: str, radius: int = RADIUS) -> DataFrame:
    """Pairs of rows whose fp differ in at most radius bits and that agree in `also`; right is expanded."""
    most = radius // len(BLOCKS)
    key = lambda fp, k: F.array(*(F.struct(F.lit(j).alias("block"), _block(fp, j).alias("value")) for j in k))
    sides = left.withColumn("key", F.explode(key(F.col("fp"), range(len(BLOCKS)))))
    spread = right.withColumnRenamed("fp", "fp2").withColumn("key", F.explode(key(F.col("fp2"), range(len(BLOCKS)))))
    masks = F.when(F.col("key.block") == len(BLOCKS) - 1, F.array(*map(F.lit, _flips(BLOCKS[-1][1], most)))).otherwise(F.array(*map(F.lit, _flips(BLOCKS[0][1], most))))
    spread = spread.withColumn("mask", F.explode(masks)).withColumn("key", F.struct(F.col("key.block").alias("block"), F.col("key.value").bitwiseXOR(F.col("mask")).alias("value"))).drop("mask")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    return sides.join(_merged(spread), ["key", also]).filter(close).drop("key", "fp", "fp2").distinct()


def _starts() -> Column:
    """The starts of all windows with enough places of an item's shingles, from ps (those places in order), n and item_n.

    The i-th to the (i + least - 1)-th place lie in one window for a range of
    starts; the part of it beyond the previous place's range is taken, so that
    no start comes twice.
    """
    weight = lambda n: F.greatest(n - (SHINGLE - 1), F.lit(1))
    size = weight(F.least("n", "item_n"))
    least = F.ceil((size + weight(F.col("item_n"))) * THRESHOLD / (100 + THRESHOLD)).cast("int")
    last = F.greatest(F.col("n") - F.col("item_n"), F.lit(0))

    def fresh(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.get("ps", i + least - 1) - size + 1, F.get("ps", i - 1) + 1)
        high = F.least(F.get("ps", i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    spare = F.size("ps") - least
    return F.when(spare >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(spare, F.lit(0))), fresh)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents: doc_id, item_id, start (first word of the best window), shared, united (weights)."""
    best = _leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "shared", "united"), F.struct(F.col("shared") / F.col("united"), -F.col("start"), "shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.shared", "b.united")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every window that reaches the threshold of an item: doc_id, th (hash of the text), item_id, start, shared, united."""
    # items go by the hash of their text; the ids, which may be null or repeated, are met again at the end
    items = cut(_shingled(benchmark.select("item_id", "text", F.xxhash64("text").alias("item"))).filter("n > 0").select("item_id", "item", "n", "s"))
    ids = items.select("item_id", "item").distinct()
    places = cut(items.dropDuplicates(["item"]).select("item", F.col("n").alias("item_n"), F.posexplode("s").alias("offset", "h")))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    # one row per shingle, of which only those of an item go on (the outer form keeps the optimizer from testing s in a filter of its own)
    found = _shingled(keyed).select("doc_id", "th", "n", F.posexplode_outer("s").alias("pos", "h")).join(narrow(places), "h")
    at = found.groupBy("doc_id", "th", "n", "item", "item_n").agg(F.array_sort(F.collect_set("pos")).alias("ps"))
    starts = at.select("doc_id", "th", "item_n", F.explode(_starts()).alias("start")).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "item_n")).alias("ws"))
    starts = cut(starts).withColumnsRenamed({"doc_id": "d", "th": "t"})
    some = keyed.join(starts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).dropDuplicates(["doc_id", "th"])
    windows = _shingled(some).select("doc_id", "th", "s", F.explode("ws").alias("w")).select("doc_id", "th", "w.start", "w.item_n", F.slice("s", F.col("w.start") + 1, F.greatest(F.col("w.item_n") - (SHINGLE - 1), F.lit(1))).alias("s"))
    weighted = cut(windows.select("doc_id", "th", "start", "item_n", F.explode("s").alias("h")).groupBy("doc_id", "th", "start", "item_n", "h").agg(F.count("*").alias("c")))
    item_weights = places.groupBy("item", "item_n", "h").agg(F.count("*").alias("c"))
    near = hamming_pairs(_fingerprint(weighted, "doc_id", "th", "start", "item_n"), _fingerprint(item_weights, "item", "item_n"), "item_n")
    total = weighted.groupBy("doc_id", "th", "start", "item_n").agg(F.sum("c").alias("total"))
    item_total = item_weights.groupBy("item").agg(F.sum("c").alias("item_total"))
    null_safe = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("th") == F.col("t"), F.col("start") == F.col("st"), F.col("item_n") == F.col("i_n")]
    renamed = lambda df: df.withColumnsRenamed({"doc_id": "d", "th": "t", "start": "st", "item_n": "i_n"})
    shared = near.join(_merged(renamed(weighted)), null_safe).drop("d", "t", "st", "i_n").join(_merged(item_weights.select("item", "h", F.col("c").alias("c2"))), ["item", "h"])
    shared = shared.groupBy("doc_id", "th", "start", "item_n", "item").agg(F.sum(F.least("c", "c2")).alias("shared"))
    exact = shared.join(_merged(renamed(total)), null_safe).drop("d", "t", "st", "i_n").join(item_total, "item").withColumn("united", F.col("total") + F.col("item_total") - F.col("shared"))
    exact = exact.filter(F.col("shared") * 100 >= F.col("united") * THRESHOLD)
    return exact.join(ids, "item").select("doc_id", "th", "item_id", "start", "shared", "united")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item."""
    # by one number, as the texts aren't shuffled for it (see _merged)
    found = cut(_leaks(docs, benchmark).select(F.xxhash64("doc_id", "th", F.col("doc_id").isNull()).alias("leaking")).distinct())
    return docs.join(found, F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"]), docs["doc_id"].isNull()) == found["leaking"], "left_anti")
