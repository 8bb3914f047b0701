"""Similarity join of documents on five-word shingles, Jaccard 0.8 or more.

A document is the set of its hashed shingles. The set's hashes fall into
groups; the vector of group counts is a point. The sum of coordinate
minima of two points bounds the sets' overlap from above, and of two boxes (by
their upper corners) that of all pairs of points in them. `CountTree` is an
R-tree of such points that lists the pairs its bound can't exclude.

One tree over all points can't prune: with a fixed number of random groups the
counts of unrelated documents concentrate, and a box of a few dozen points
bounds everything. So the tree's root is a hash partition that loses nothing.
Order all shingles by a total order; two sets of Jaccard 0.8 share one of the
first |A| - ceil(0.8 |A|) + 1 shingles of each, so the documents under one such
shingle form a subtree, and pairs are sought within subtrees only. The order
puts shingles last that a fixed-size count sketch of the whole corpus finds
frequent, which keeps subtrees small; large ones are dealt in parts.

1. One pass over the text: set size, set hash (equal sets form a class), point,
   and the sketch. 2. Subtrees: shingle -> classes; equal lists are kept once, and
   a shingle counted in more than PART sets is dealt in parts. 3. In a subtree
   that is dealt, each class is compared with the least class of its part; those
   verified link. 4. Subtrees that hold several components go through the tree,
   part by part: of the pairs that its bound leaves, in the order of their
   classes, each that joins two components of the subtree is a link to be
   verified, so there are fewer links than members. 5. Subtrees of which a link
   has failed are searched again: all pairs that are left between components,
   as verified by now, and haven't failed are verified. Those are pairs close
   to the threshold; copies are in one component by then. Such a pair shares
   many subtrees and is listed in the least of them: every class brings the
   least PLACES of the subtrees it is in, and a pair is left out where both have
   been in a lesser one.
Components of the links are exact: a pair is left out only if it can't reach
the threshold or its documents are in one component already.

A point has FINE groups, and for long texts more, a power of two that is at least
an eighth of the set's size (with eight members a group, unrelated sets seem to
share four fifths, where 8 / 9 are needed); adjacent groups are summed to
compare two points of different length, and to get the tree's own COARSE groups.

Texts without words have an empty set and are linked with nothing; with fewer
than five words the whole sequence is one shingle. Rows with equal sets,
repeated rows included, are in one class. A null doc_id never names a component
that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import cut
from .textkit import U64, chunks, lowered, mix, shingle_hashes, shingle_set, word_hashes, words

SHINGLE = 5
#: Groups that the tree's boxes have.
COARSE = 64
#: Least number of groups of a point.
FINE = 256
FANOUT = 16
#: Cells of each row of the sketch, 4 bytes each: a fixed size, sent to every task.
SKETCH = 1 << 17
#: Classes of one subtree that a task holds at a time.
PART = 1024


def sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for r0, r1, data, off in chunks(column):
        data = lowered(data)
        starts, ends, first = words(data, off)
        w = word_hashes(data, starts, ends)
        s = shingle_hashes(w, SHINGLE)
        for i in range(r1 - r0):
            a, b = first[i], first[i + 1]
            yield r0 + i, shingle_set(w[a:b], s[a:b], SHINGLE)


def set_key(s: np.ndarray) -> int:
    return int(np.bitwise_xor(np.sum(mix(s)), mix(np.array([len(s)], U64))[0]).view(np.int64)) if len(s) else 0


def point(s: np.ndarray) -> bytes:
    """Counts of a set's groups as the narrowest unsigned integers that hold the largest, after a byte for their width."""
    bits = max(FINE.bit_length() - 1, (max(len(s) - 1, 0) // 8).bit_length())
    counts = np.bincount((s >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    narrow_type = np.min_scalar_type(int(counts.max()))
    return bytes([narrow_type.itemsize]) + counts.astype(narrow_type).tobytes()


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A point (or rows of points) with fewer groups."""
    return counts.reshape(*counts.shape[:-1], groups, -1).sum(-1, dtype=np.uint32) if counts.shape[-1] > groups else counts.astype(np.uint32)


def _cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s & U64(SKETCH - 1)).astype(np.int64), ((s >> U64(20)) & U64(SKETCH - 1)).astype(np.int64)


_DOC = "kind int, doc_id long, n long, cls long, point binary, task int"
_SLICES = 32


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros((2, SKETCH), np.int32)
    task = TaskContext.get().partitionId()
    for batch in batches:
        ids, out, held, size = batch.column("doc_id").to_pylist(), [], [], 0
        for row, s in sets(batch.column("text")):
            out.append((0, ids[row], len(s), set_key(s), point(s), task))
            held.append(s)
            size += len(s)
            if size > 1 << 18:
                _tally(sketch, held)
                held, size = [], 0
        _tally(sketch, held)
        yield _rows(out)
    parts = sketch.reshape(_SLICES, -1)
    yield _rows([(1, None, k, 0, parts[k].tobytes(), task) for k in range(_SLICES)])


def _tally(sketch: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        for k, cell in enumerate(_cells(np.concatenate(held))):
            sketch[k] += np.bincount(cell, minlength=SKETCH).astype(np.int32)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types)], names=["kind", "doc_id", "n", "cls", "point", "task"])


def _sum_parts(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("point")], axis=0, dtype=np.int64)
    return pa.table({"n": table.column("n").slice(0, 1), "point": pa.array([np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()], pa.binary())})


def _sketch(described: DataFrame) -> np.ndarray:
    """Counts of all cells: 1 MB, whatever the size of the corpus."""
    parts = described.filter("kind = 1").select("n", "point", F.pmod("task", F.lit(64)).alias("group"))
    merged = parts.groupBy("n", "group").applyInArrow(_sum_parts, "n long, point binary").groupBy("n").applyInArrow(_sum_parts, "n long, point binary")
    rows = sorted((r["n"], bytes(r["point"])) for r in merged.collect())
    return np.frombuffer(b"".join(p for _, p in rows), np.int32).reshape(2, -1) if rows else np.zeros((2, SKETCH), np.int32)


def prefix(s: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set's prefix in the global order, and whether each may be in more than PART sets (the sketch never counts too few)."""
    a, b = _cells(s)
    count = np.minimum(sketch[0][a], sketch[1][b]).astype(np.int64)
    limit = 2 * int(sketch[0].sum(dtype=np.int64)) // SKETCH + 64
    level = np.where(count <= limit, 0, np.ceil(np.log2(np.maximum(count, 1) / limit)).astype(np.int64) + 1)
    n = len(s)
    take = np.lexsort((s, level))[: n - (-(-4 * n // 5)) + 1]
    return s[take], count[take] > PART


def _subtrees(sketch: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # the classes of this task's rows
        for batch in batches:
            shingles, classes, often = [], [], []
            for _, s in sets(batch.column("text")):
                key = set_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    p, many = prefix(s, sketch)
                    shingles.append(p.view(np.int64))
                    classes.append(np.full(len(p), key))
                    often.append(many)
            if shingles:
                sh, cl, of = map(np.concatenate, (shingles, classes, often))
                for i in range(0, len(sh), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(sh[j]), pa.array(cl[j].astype(np.int64)), pa.array(of[j])], names=["shingle", "cls", "often"])

    return run


class CountTree:
    """R-tree of count vectors, packed bottom-up in the order of size; `upper` holds each level's upper corners.

    comp: components; pairs of boxes that hold one component only aren't entered.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comp: np.ndarray | None = None) -> None:
        self.order = np.argsort(sizes, kind="stable")
        upper, low, high = points[self.order], sizes[self.order], sizes[self.order]
        least = most = (np.arange(len(sizes)) if comp is None else comp)[self.order]
        self.levels, self.comps = [(upper, low, high)], [(least, most)]
        while len(upper) > 1:
            starts = np.arange(0, len(upper), FANOUT)
            upper, low, high = np.maximum.reduceat(upper, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            least, most = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((upper, low, high))
            self.comps.append((least, most))

    def _possible(self, other: CountTree, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (u, lo, hi), (u2, lo2, hi2) = self.levels[level], other.levels[level]
        keep = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            bound = np.minimum(np.minimum(u[x], u2[y]).sum(1, dtype=np.int64), np.minimum(hi[x], hi2[y]))
            keep[a : a + (1 << 14)] = 9 * bound >= 4 * (lo[x] + lo2[y])  # overlap / union >= 4 / 5
        (least, most), (least2, most2) = self.comps[level], other.comps[level]
        return keep & ~((least[i] == most[i]) & (least2[j] == most2[j]) & (least[i] == least2[j]))

    def pairs(self, other: CountTree | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points (of one tree: each once) that may reach the threshold."""
        own = other is None
        other = self if own else other
        while len(self.levels) < len(other.levels):
            self.levels.append(self.levels[-1])
            self.comps.append(self.comps[-1])
        while len(other.levels) < len(self.levels):
            other.levels.append(other.levels[-1])
            other.comps.append(other.comps[-1])
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                i, j = self._children(i, j, len(self.levels[level][0]), len(other.levels[level][0]), len(self.levels[level + 1][0]), len(other.levels[level + 1][0]))
            if own:
                below = i <= j if level else i < j
                i, j = i[below], j[below]
            keep = self._possible(other, level, i, j)
            i, j = i[keep], j[keep]
        return self.order[i], other.order[j]

    @staticmethod
    def _children(i, j, n, m, up_n, up_m):
        fi, fj = (FANOUT if n > up_n else 1), (FANOUT if m > up_m else 1)
        x = (i[:, None] * fi + np.arange(fi))[:, :, None].repeat(fj, 2).ravel()
        y = (j[:, None] * fj + np.arange(fj))[:, None, :].repeat(fi, 1).ravel()
        inside = (x < n) & (y < m)
        return x[inside], y[inside]


class Points:
    """Points of several lengths, folded to a common one where they are compared."""

    def __init__(self, column: pa.Array) -> None:
        self.raw = [x.as_buffer() for x in column]
        width = np.array([x[0] for x in self.raw], np.int64)
        self.groups = (np.array([x.size for x in self.raw], np.int64) - 1) // np.maximum(width, 1)
        self.fine = np.zeros((len(self.raw), FINE), np.uint32)
        for w, groups in set(zip(width.tolist(), self.groups.tolist())):
            of = np.flatnonzero((width == w) & (self.groups == groups))
            cells = np.frombuffer(b"".join([self.raw[i] for i in of.tolist()]), np.uint8).reshape(len(of), -1)[:, 1:]
            self.fine[of] = folded(np.ascontiguousarray(cells).view(f"u{w}"), FINE)

    def row(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw[i], f"u{self.raw[i][0]}", offset=1)

    def coarse(self, of: slice = slice(None)) -> np.ndarray:
        return folded(self.fine[of], COARSE)

    def reach(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the summed minima of rows a and b reach the threshold."""
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), PAIRS):
            x, y = a[k : k + PAIRS], b[k : k + PAIRS]
            keep[k : k + PAIRS] = 9 * np.minimum(self.fine[x], self.fine[y]).sum(1, dtype=np.int64) >= 4 * (sizes[x] + sizes[y])
        for k in np.flatnonzero(keep & (np.minimum(self.groups[a], self.groups[b]) > FINE)).tolist():
            x, y = self.row(a[k]), self.row(b[k])
            groups = min(len(x), len(y))
            keep[k] = 9 * int(np.minimum(folded(x, groups), folded(y, groups)).sum(dtype=np.int64)) >= 4 * int(sizes[a[k]] + sizes[b[k]])
        return keep


_LINK = "shingle long, p int, q int, a long, b long"
#: Pairs that are bounded at a time.
PAIRS = 1 << 12
#: Points that fit one box: each is compared with every other.
BOX = 32
#: Subtrees that a class brings to the second search, the least of its own.
PLACES = 16


def _group_links(points: Points, of: slice, cls: np.ndarray, comp: np.ndarray, sizes: np.ndarray, side: np.ndarray, no: set, met: np.ndarray) -> list[tuple[int, int]]:
    """Links between components among the points `of` a subtree (or of two parts of one).

    met: a row of lesser subtrees for each point (0: none); pairs that share one are listed there.
    """
    n = of.stop - of.start
    if side.max() == 0 and n <= BOX:
        a, b = np.triu_indices(n, 1)
    elif side.max() == 0:
        a, b = CountTree(points.coarse(of), sizes, comp).pairs()
    else:
        coarse, x, y = points.coarse(of), np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if not len(x) or not len(y):
            return []
        a, b = CountTree(coarse[x], sizes[x], comp[x]).pairs(CountTree(coarse[y], sizes[y], comp[y]))
        a, b = x[a], y[b]
    possible = (comp[a] != comp[b]) & (9 * np.minimum(sizes[a], sizes[b]) >= 4 * (sizes[a] + sizes[b]))
    a, b = a[possible], b[possible]
    if not len(a):
        return []
    first, second = np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
    order = np.lexsort((second, first))  # subtrees with the same members then propose the same links
    a, b, out, whole = a[order], b[order], [], np.zeros(of.stop, np.int64)
    whole[of] = sizes
    for k in range(0, len(a), PAIRS):
        i, j = a[k : k + PAIRS], b[k : k + PAIRS]
        apart = comp[i] != comp[j]
        if met.any():
            apart &= ~((met[i][:, :, None] == met[j][:, None, :]) & (met[i] != 0)[:, :, None]).any((1, 2))
        i, j = i[apart], j[apart]
        near = points.reach(i + of.start, j + of.start, whole) if len(i) else np.zeros(0, bool)
        for u, v in zip(i[near].tolist(), j[near].tolist()):
            if comp[u] != comp[v]:
                pair = (int(min(cls[u], cls[v])), int(max(cls[u], cls[v])))
                if pair not in no:
                    out.append(pair)
                    if not no:
                        comp[comp == comp[v]] = comp[u]
    return out


_KEY = ("shingle", "p", "q")


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every group of rows that are sorted by _KEY, by the pairs that the tree can't exclude; if some have failed (rows of kind 1), all other pairs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.array([batch.column(c).to_numpy() for c in _KEY])
        if held and (np.array([held[-1].column(c)[-1].as_py() for c in _KEY]) != key[:, 0]).any():
            yield from _links(pa.Table.from_batches(held))
            held = []
        # rows of the group that the batch ends in wait for the next batch
        others = np.flatnonzero((key != key[:, -1:]).any(0))
        begin = int(others[-1]) + 1 if len(others) else 0
        if begin:
            yield from _links(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
    if held:
        yield from _links(pa.Table.from_batches(held))


def _links(table: pa.Table) -> Iterator[pa.RecordBatch]:
    key = np.array([table.column(c).to_numpy() for c in _KEY])
    kind, cls, comp, sizes, side = (table.column(c).to_numpy() for c in ("kind", "cls", "comp", "n", "side"))
    starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])).tolist()
    points = Points(table.column("point").filter(pa.array(kind == 0)))
    met = _lesser(table)
    at, out, of = np.concatenate([[0], np.cumsum(kind == 0)]), [], []
    for a, b in zip(starts, [*starts[1:], len(kind)]):
        old = kind[a:b] == 1
        no = set(zip(cls[a:b][old].tolist(), comp[a:b][old].tolist()))
        new = np.flatnonzero(~old) + a
        if len(new) > 1:
            local = np.unique(comp[new], return_inverse=True)[1]
            found = _group_links(points, slice(int(at[a]), int(at[b])), cls[new], local, sizes[new], side[new], no, met[new])
            out += found
            of += [a] * len(found)
    rows = np.array(of, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(key[0][rows].astype(np.int64)), pa.array(key[1][rows].astype(np.int32)), pa.array(key[2][rows].astype(np.int32)), pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())],
        names=[*_KEY, "a", "b"],
    )


def _lesser(table: pa.Table) -> np.ndarray:
    """Of every row, its class's subtrees that come before the row's own; 0 fills up."""
    lists = table.column("places").combine_chunks()
    out = np.zeros((table.num_rows, PLACES), np.int64)
    size = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return np.where(out < table.column("place").to_numpy()[:, None], out, 0)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes whose points' summed minima reach the threshold."""
    for batch in batches:
        n = batch.num_rows
        if n:
            points = Points(pa.chunked_array([batch.column("pa"), batch.column("pb")]))
            sizes = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            keep = points.reach(np.arange(n), np.arange(n) + n, sizes)
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(set_key(s), s.tobytes()) for _, s in sets(batch.column("text"))]
        for a in range(0, len(out), 256):
            cls, raw = zip(*out[a : a + 256])
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(raw, pa.binary())], names=["cls", "shingles"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link; sets are read from the representatives' texts."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "rep"), "cls").select("rep").distinct()
    chosen = docs.join(need, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text")
    known = cut(chosen.mapInArrow(_set_rows, "cls long, shingles binary").dropDuplicates(["cls"]))
    left = pairs.join(known.withColumnsRenamed({"cls": "a", "shingles": "sa"}), "a")
    return left.join(known.withColumnsRenamed({"cls": "b", "shingles": "sb"}), "b").select("a", "b", "sa", "sb").mapInArrow(_overlap, "a long, b long")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    docs = docs.select("doc_id", "text")
    described = cut(docs.mapInArrow(_describe, _DOC))
    rows = described.filter("kind = 0")
    sketch = _sketch(described)
    classes = cut(rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("point").alias("point")))
    flat = cut(docs.mapInArrow(_subtrees(sketch), "shingle long, cls long, often boolean"))
    # the shingles that are in more than PART sets, counted; a class that several tasks have met counts for each
    hot = flat.filter("often").groupBy("shingle").agg(F.count("*").alias("sets")).filter(F.col("sets") > PART).select("shingle", F.ceil(F.col("sets") / PART).cast("int").alias("parts"))
    dealt = flat.filter("often").join(hot, "shingle", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    each = flat.filter("not often").withColumns({"parts": F.lit(1), "part": F.lit(0)}).unionByName(dealt).drop("often")
    lists = each.repartition("shingle", "part").groupBy("shingle", "part", "parts").agg(F.sort_array(F.collect_set("cls")).alias("list"))
    small = lists.filter("parts = 1 and size(list) > 1").groupBy("list").agg(F.min("shingle").alias("shingle"), F.first("part").alias("part"), F.first("parts").alias("parts"))
    subtrees = cut(small.select("shingle", "part", "parts", "list").unionByName(lists.filter("parts > 1").select("shingle", "part", "parts", "list")))
    # step 3: stars around the least class of each part, and of all parts of a subtree
    dealt = subtrees.filter("parts > 1")
    star = dealt.select(F.col("list")[0].alias("a"), F.explode("list").alias("b"))
    heads = dealt.groupBy("shingle").agg(F.min(F.col("list")[0]).alias("a")).join(dealt.select("shingle", F.col("list")[0].alias("b")), "shingle").select("a", "b")
    known = classes.select("cls", "n", "point")
    pairs = cut(star.unionByName(heads).filter("a < b").distinct())
    asked = cut(known.join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi"))
    at = lambda c: asked.withColumnsRenamed({"cls": c, "n": f"n{c}", "point": f"p{c}"})
    near = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_bounded, "a long, b long")
    links = cut(_verified(cut(near), docs, classes))
    # steps 4 and 5
    failed = None
    for again in (False, True):
        comps = cut(components(links, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("comp")))
        found = cut(_search(subtrees, known, comps, failed))
        good = cut(_verified(found.select("a", "b").distinct(), docs, classes))
        links = links.unionByName(good)
        if again:
            break
        failed = cut(found.join(good.hint("merge"), ["a", "b"], "left_anti"))  # a broadcast by two columns takes 64 MB of the driver's heap
        if failed.isEmpty():
            break
    last = components(links, "a", "b")
    named = last.join(classes.select("cls", "rep"), F.col("node") == F.col("cls")).select("cls", "component", "rep")
    lowest = named.groupBy("component").agg(F.min("rep").alias("least"))
    class_id = classes.select("cls", "rep").join(named.select("cls", "component"), "cls", "left").join(lowest, "component", "left").select("cls", F.coalesce("least", "rep").alias("component_id"))
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(class_id, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def _search(subtrees: DataFrame, known: DataFrame, comps: DataFrame, failed: DataFrame | None) -> DataFrame:
    """Links that the trees of subtrees with several components propose; after the first search only of those in which one has failed."""
    place = subtrees.select("shingle", "part", F.explode("list").alias("cls")).join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = place.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("shingle")
    if failed is not None:
        mixed = mixed.join(failed.select("shingle").distinct(), "shingle")
    # a subtree in k parts is compared part by part with itself and every other
    o, part = F.sequence(F.lit(0), F.col("parts") - 1), F.col("part")
    pair = F.when(F.col("parts") == 1, F.array(F.struct(part.alias("p"), part.alias("q"), F.lit(0).alias("side")))).otherwise(
        F.transform(o, lambda x: F.struct(F.least(part, x).alias("p"), F.greatest(part, x).alias("q"), F.when(part == x, 0).when(part < x, 1).otherwise(2).alias("side")))
    )
    members = subtrees.join(mixed, "shingle", "left_semi").withColumn("pair", pair).select("shingle", F.explode("list").alias("cls"), "pair")
    spread = lambda rows: rows.withColumn("x", F.explode("pair")).select("shingle", "x.p", "x.q", "x.side", *(c for c in rows.columns if c not in ("shingle", "pair")))
    described = lambda rows: rows.join(known, "cls").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    columns = ("side", "cls", "comp", "n", "point", F.lit(0).alias("kind"))
    if failed is None:
        searched = spread(described(members)).select(*_KEY, *columns, F.lit(0).cast("long").alias("place"), F.lit(None).cast("array<long>").alias("places"))
    else:
        only = failed.select(*_KEY).distinct().hint("merge")
        narrow = cut(spread(members).join(only, list(_KEY), "left_semi").withColumn("place", F.xxhash64(*_KEY)))
        # where p and q differ, two classes of one side aren't compared
        least = narrow.filter("p = q").groupBy("cls").agg(F.slice(F.array_sort(F.collect_set("place")), 1, PLACES).alias("places"))
        old = failed.select(*_KEY, F.lit(0).alias("side"), F.col("a").alias("cls"), F.col("b").alias("comp"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("point"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("array<long>").alias("places"))
        searched = described(narrow.join(least, "cls", "left")).select(*_KEY, *columns, "place", "places").unionByName(old)
    return searched.repartition(*_KEY).sortWithinPartitions(*_KEY, F.desc("kind")).mapInArrow(_tree_links, _LINK)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the row of the smallest doc_id of every component (a null doc_id is its own, kept)."""
    keep = similar(docs).filter("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["stays"]), "left_semi")
