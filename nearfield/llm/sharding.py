"""Shards of near-equal bytes: a k-d tree over document metadata.

The dimensions are the text's length, the source, the language and the doc_id
(numbers as they are, strings by their hash). A node that still holds several
shards is split in two along the dimension in which its documents spread most
(relative to the whole corpus), at the weighted median: the value at which the
bytes below are the share of the shards below. Leaves are the shards.

Documents with one text form a group, which is one point of the tree, so a
group stays in one shard. Points of more than LARGE of a shard's bytes would
tip the medians: they are dealt to the shards first, the largest to the emptiest,
and the tree's leaves get the room that is left, as if filled with water. Only a
group that can't fit a shard is dealt into several points, row by row.
Medians are found by histograms that every level refines: per round each open
node sends BINS numbers to the driver, so no task sees all the rows of a node
and nothing the driver holds grows with the corpus (points above LARGE are fewer
than shards / LARGE). Rows with the same value as the median are told apart by
the hash of their text.

Null texts have 8 bytes; nulls are a value of their own in every dimension.
Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import cut

BINS = 512
ROUNDS = 3
LARGE = 0.01
#: Most of a shard that one point takes.
MOST = 0.9
#: Rows of a shard that are numbered together.
BUCKET_ROWS = 10_000

DIMENSIONS = ("length", "source", "lang", "doc")


def _hash01(*cols: Column) -> Column:
    """A hash as a double in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def _rows(docs: DataFrame, shards: int) -> tuple[DataFrame, int, int]:
    """Rows without their text, told apart by rid, with the point (g, part) that each belongs to; their number and bytes."""
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"), F.md5(F.coalesce("text", F.lit(""))).alias("g"),
        F.coalesce(F.length("text"), F.lit(-1)).cast("double").alias("length"), F.coalesce(_hash01("source"), F.lit(-1.0)).alias("source"), F.coalesce(_hash01("lang"), F.lit(-1.0)).alias("lang"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("doc"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = cut(rows)
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    most = MOST * (total or 0) / shards
    # fewer than shards / MOST groups don't fit
    large = cut(rows.groupBy("g").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > most).select("g", F.ceil(F.col("bytes") / (0.9 * most)).cast("int").alias("parts")))
    rows = rows.join(large, "g", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    return rows, n, total or 0


def _dealt(large: list[int], shards: int, rest: int) -> tuple[list[int], list[float]]:
    """The shard of each large point (in descending order), and the room for other bytes in every shard."""
    full, at = [0] * shards, []
    for w in large:
        k = min(range(shards), key=lambda i: (full[i], i))
        at.append(k)
        full[k] += w
    # the level at which the room below it is the rest
    level, order = 0.0, sorted(full)
    for i in range(1, shards + 1):
        level = (rest + sum(order[:i])) / i
        if i == shards or level <= order[i]:
            break
    return at, [max(0.0, level - f) for f in full]


def _case(node: Column, values: dict[int, object], default: object) -> Column:
    """The value of each node: a constant array, which generated code refers to, so that no new code is compiled for new values."""
    return F.coalesce(F.get(F.array(*(F.lit(values.get(k)).cast("double") for k in range(max(values, default=0) + 1))), node), F.lit(default).cast("double"))


def _medians(points: DataFrame, value: Column, active: dict[int, tuple[float, float, float, float]]) -> dict[int, tuple[float, float, int, int]]:
    """For each node (low, high, wanted weight, weight below low): the ends of the bin in which the weight wanted
    is reached, which ROUNDS refinements have made tiny, the weight below it and its own."""
    active, last = dict(active), {}
    for _ in range(ROUNDS):
        low, width = _case(F.col("node"), {n: float(a[0]) for n, a in active.items()}, 0.0), _case(F.col("node"), {n: max((a[1] - a[0]) / BINS, 1e-300) for n, a in active.items()}, 1.0)
        inside = F.floor((value - low) / width)
        binned = points.filter(F.col("node").isin(list(active))).withColumn("bin", F.when(value < low, -1).when(inside >= BINS, BINS).otherwise(inside).cast("int"))
        counts: dict[int, dict[int, int]] = {}
        for r in binned.filter((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy("node", "bin").agg(F.sum("w").alias("w")).collect():
            counts.setdefault(r["node"], {})[r["bin"]] = r["w"]
        for n, (lo, hi, want, below) in active.items():
            step = (hi - lo) / BINS
            for b in range(BINS):
                w = counts.get(n, {}).get(b, 0)
                if below + w >= want or b == BINS - 1:
                    active[n], last[n] = (lo + b * step, lo + (b + 1) * step, want, below), w
                    break
                below += w
    return {n: (a[0], a[1], a[3], last.get(n, 0)) for n, a in active.items()}


def kd_tree(points: DataFrame, room: list[float]) -> tuple[DataFrame, list[dict]]:
    """Adds the shard of every point, in proportion to the shards' room, and gives the splits of the tree from the root."""
    shards = len(room)
    points = cut(points.withColumn("node", F.lit(1)))
    span = points.agg(*(F.min(c).alias(f"lo_{c}") for c in DIMENSIONS), *(F.max(c).alias(f"hi_{c}") for c in DIMENSIONS)).first()
    whole = {c: max((span[f"hi_{c}"] or 0) - (span[f"lo_{c}"] or 0), 1e-9) for c in DIMENSIONS}
    open_nodes, splits, leaves = {1: (0, shards)}, [], {}
    while open_nodes:
        for n in [n for n, (a, b) in open_nodes.items() if b - a == 1]:
            leaves[n] = open_nodes.pop(n)[0]
        if not open_nodes:
            break
        box = {r["node"]: r for r in points.filter(F.col("node").isin(list(open_nodes))).groupBy("node").agg(F.sum("w").alias("w"), *(F.min(c).alias(f"lo_{c}") for c in DIMENSIONS), *(F.max(c).alias(f"hi_{c}") for c in DIMENSIONS)).collect()}
        dims, active = {}, {}
        for n, (a, b) in open_nodes.items():
            if n not in box:
                dims[n], active[n] = DIMENSIONS[0], (0.0, 1.0, 0.0, 0)
                continue
            r = box[n]
            dims[n] = max(DIMENSIONS, key=lambda c: (r[f"hi_{c}"] - r[f"lo_{c}"]) / whole[c])
            lo, hi = r[f"lo_{dims[n]}"], r[f"hi_{dims[n]}"]
            active[n] = (lo, hi + max(abs(hi), 1.0) * 1e-9, r["w"] * sum(room[a : (a + b) // 2]) / (sum(room[a:b]) or 1.0), 0)
        value = F.lit(0.0)
        for c in DIMENSIONS:
            if some := [n for n, d in dims.items() if d == c]:
                value = F.when(F.col("node").isin(some), F.col(c)).otherwise(value)
        found = _medians(points, value, active)
        low, high = _case(F.col("node"), {n: f[0] for n, f in found.items()}, 0.0), _case(F.col("node"), {n: f[1] for n, f in found.items()}, 0.0)
        tied = points.filter(F.col("node").isin(list(found)) & (value >= low) & (value < high))
        ties = _medians(tied, F.col("tie"), {n: (0.0, 1.0, active[n][2], f[2]) for n, f in found.items()})
        # the last bin goes to the side that leaves the smaller error
        at = {n: t[1] if active[n][2] - t[2] > t[2] + t[3] - active[n][2] else t[0] for n, t in ties.items()}
        cut_tie = _case(F.col("node"), at, 0.0)
        goes_right = (value >= high) | ((value >= low) & (F.col("tie") >= cut_tie))
        for n, (a, b) in list(open_nodes.items()):
            splits.append({"node": n, "dimension": dims[n], "at": found[n][0], "below": found[n][1], "tie": at[n]})
            middle = (a + b) // 2
            open_nodes[2 * n], open_nodes[2 * n + 1] = (a, middle), (middle, b)
            del open_nodes[n]
        points = cut(points.withColumn("node", F.when(F.col("node").isin(list(found)), F.col("node") * 2 + goes_right.cast("int")).otherwise(F.col("node"))))
    return points.withColumn("shard", _case(F.col("node"), leaves, 0).cast("int")), splits


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows, n, total = _rows(docs, shards)
    rows = cut(rows)
    points = cut(rows.groupBy("g", "part").agg(F.sum("size").alias("w"), *(F.min(c).alias(c) for c in DIMENSIONS)).withColumn("tie", _hash01("g", "part")))
    limit = LARGE * total / shards
    # fewer than shards / LARGE rows
    large = points.filter(F.col("w") > limit).select("g", "part", "w").orderBy(F.desc("w"), "g", "part").collect()
    at, room = _dealt([r["w"] for r in large], shards, total - sum(r["w"] for r in large))
    first = docs.sparkSession.createDataFrame([(r["g"], r["part"], k) for r, k in zip(large, at)], "g string, part int, shard int")
    placed, _ = kd_tree(points.filter(F.col("w") <= limit), room)
    placed = placed.select("g", "part", "shard").unionByName(first)
    buckets = max(1, -(-n // (shards * BUCKET_ROWS)))
    rows = cut(rows.select("doc_id", "size", "text_crc32", "g", "part", "rid").join(placed, ["g", "part"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g", "rid"), F.lit(buckets)).cast("int")))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "g"))
    out = rows.withColumn("within", within).join(before, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
