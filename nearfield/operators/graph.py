"""Navigable small-world graphs, flat and layered.

Nodes are inserted in the order of a hash of their ids; each is linked, both
ways, to the m nearest of those before it, found exactly. Early nodes have few
to choose from, so their links are long, which is what a search needs to get
about. All insertions are one job: pairs that share an entry, later against
earlier; a node that has too few of those is linked to others before it in the
order of their distance, then of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import PRIME, coefficients, norms, ranked, uniform_hash
from nearfield.operators import blocks
from nearfield.operators.knn import all_met, apart, fixed_order, overlaps, score, too_few, top_k
from nearfield.plans.store import cut


def insertion(ids: DataFrame, seed: int = 1) -> DataFrame:
    """(vec_id, turn): places in the order of insertion."""
    order = uniform_hash(F.col("vec_id") + 1, *coefficients(seed, 9))
    return ranked(ids.select("vec_id").withColumn("order", order), "order", "vec_id").select("vec_id", F.col("position").alias("turn"))


def nearest_before(vectors: DataFrame, turns: DataFrame, m: int, name: str) -> DataFrame:
    """(src, dst): for each of the vectors that are asked, the m nearest of those inserted before it, both ways; turns are (vec_id, turn, asked)."""
    found = cut(blocks.before(vectors, turns, m, name))
    base = cut(norms(vectors))
    query = base.withColumnRenamed("vec_id", "query_id")
    counts = found.groupBy("query_id").agg(F.sum("met").alias("met"), F.sum("near").alias("near"))
    most = too_few(turns.filter("asked and turn > 0").select(F.col("vec_id").alias("query_id"), "turn"), counts, m)
    scored = found.select("query_id", "vec_id", "distance")
    fill, last = most.agg(F.max("fill"), F.max("turn")).first()
    if fill is not None:
        known = all_met(found, most, m, vectors, vectors.withColumnRenamed("vec_id", "query_id"))
        scored = scored.unionByName(apart(first_before(base, turns, most, fill, last, name), known, base, query, name))
    best = top_k(scored, m)
    one = best.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"))
    return one.union(one.select("dst", "src"))  # of two, one was there first, so none is there twice


def first_before(base: DataFrame, turns: DataFrame, most: DataFrame, fill: int, last: int, name: str) -> DataFrame:
    """(query_id, vec_id): pairs that hold the first `fill` vectors of a fixed order before each of `most` (query_id, turn, fill).

    Turns before one are as many runs of 2**l turns as it has bits, so each run's first are found once for all.
    """
    bits = F.explode(F.sequence(F.lit(0), F.lit(max(last.bit_length() - 1, 0)))).alias("l")
    run = F.expr("shiftright(turn, l)")
    asked = most.select("query_id", "fill", "turn", bits).filter(run % 2 == 1).select("query_id", "fill", "l", (run - 1).alias("run"))
    runs = turns.filter(F.col("turn") < last).join(base.select("vec_id", "n2"), "vec_id").select("vec_id", "n2", "turn", bits).filter(run % 2 == 0).select("vec_id", "n2", "l", run.alias("run"))
    w = Window.partitionBy("l", "run").orderBy(*fixed_order(name))
    first = runs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fill)
    return asked.join(first, ["l", "run"]).filter("r <= fill").select("query_id", "vec_id")


def edges(vectors: DataFrame, m: int, name: str, seed: int = 1) -> DataFrame:
    """(src, dst) of the whole graph; no self links or repeats."""
    return nearest_before(vectors, cut(insertion(vectors.select("vec_id").distinct(), seed).withColumn("asked", F.lit(True))), m, name)


def insert(links: DataFrame, vectors: DataFrame, more: DataFrame, m: int, name: str) -> DataFrame:
    """The links with new vectors inserted after the others, in the order of their ids."""
    old, new = vectors.select("vec_id").distinct(), more.select("vec_id").distinct()
    start = old.count()
    turns = cut(old.withColumn("turn", F.lit(0).cast("long")).unionByName(ranked(new, "vec_id").select("vec_id", (F.col("position") + max(start, 1)).alias("turn"))))
    least = turns.agg(F.min("vec_id").alias("vec_id"))
    turns = turns.join(F.broadcast(least.withColumn("first", F.lit(True))), "vec_id", "left").withColumn("turn", F.when(F.col("first"), F.lit(0).cast("long")).when(F.col("turn") == 0, F.lit(1).cast("long")).otherwise(F.col("turn") + 1)).drop("first") if start else turns
    turns = cut(turns.join(new.withColumn("asked", F.lit(True)), "vec_id", "left").fillna(False, ["asked"]))
    return links.union(nearest_before(vectors.unionByName(more), turns, m, name)).distinct()


def levels(ids: DataFrame, factor: float = 0.5, max_layers: int = 16, seed: int = 1) -> DataFrame:
    """(vec_id, level): geometric, by successive hashes below factor; independent of partitioning."""
    hit = [uniform_hash(uniform_hash(F.col("vec_id") + 1, *coefficients(seed, 2 * j)), *coefficients(seed, 2 * j + 1)) < int(factor * PRIME) for j in range(max_layers)]
    level = F.lit(max_layers)
    for j in reversed(range(max_layers)):
        level = F.when(~hit[j], j).otherwise(level)
    return ids.select("vec_id", level.alias("level"))


def of_layer(vectors: DataFrame, of: DataFrame, layer: int) -> DataFrame:
    return cut(vectors.join(of.filter(F.col("level") >= layer).select("vec_id"), "vec_id", "left_semi")) if layer else vectors


def layer_edges(vectors: DataFrame, of: DataFrame, layer: int, m: int, name: str) -> DataFrame:
    return edges(of_layer(vectors, of, layer), m, name)


class Distances:
    """Distances of pairs of queries and vectors, for searches that ask for some in every round: pairs that share an entry are scored once for all."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, name: str) -> None:
        self.base, self.query, self.name = cut(norms(vectors)), cut(norms(queries, key="query_id")), name
        self.scored = cut(score(overlaps(vectors, queries), self.base, self.query, name).select("query_id", "vec_id", "distance"))

    def of(self, pairs: DataFrame) -> DataFrame:
        """(query_id, vec_id, distance) of pairs without repeats."""
        met = cut(pairs.join(self.scored, ["query_id", "vec_id"]).select("query_id", "vec_id", "distance"))
        return met.unionByName(apart(pairs, met, self.base, self.query, self.name))


def beam(vectors: DataFrame, queries: DataFrame, links: DataFrame, entry: DataFrame, ef: int, name: str, distances: Distances | None = None) -> DataFrame:
    """Best-first search of all queries at once: those that newly entered the ef best bring in their neighbours, until none enters.

    entry (query_id, vec_id) are the starts; gives (query_id, rnk, vec_id, distance), ef of each query.
    No pair is scored twice, so the search ends.
    """
    distances = distances or Distances(vectors, queries, name)
    known = cut(entry.select("query_id", "vec_id").distinct())
    seen = cut(top_k(distances.of(known), ef).select("query_id", "rnk", "vec_id", "distance"))
    fresh = seen
    while not fresh.isEmpty():
        new = fresh.join(links, fresh["vec_id"] == links["src"]).select("query_id", F.col("dst").alias("vec_id")).distinct()
        new = cut(new.join(known, ["query_id", "vec_id"], "left_anti"))
        known = known.unionByName(new)
        reached = distances.of(new).withColumn("fresh", F.lit(True))
        best = top_k(seen.select("query_id", "vec_id", "distance", F.lit(False).alias("fresh")).unionByName(reached), ef)
        best = cut(best.select("query_id", "rnk", "vec_id", "distance", "fresh"))
        seen, fresh = best.drop("fresh"), best.filter("fresh")
    return seen


class Layered:
    def __init__(self, of: DataFrame, links: dict[int, DataFrame], name: str) -> None:
        self.of, self.links, self.name = of, links, name

    @classmethod
    def fit(cls, vectors: DataFrame, m: int, name: str, factor: float = 0.5, max_layers: int = 16, seed: int = 1) -> Layered:
        of = cut(levels(vectors.select("vec_id").distinct(), factor, max_layers, seed))
        top = of.agg(F.max("level")).first()[0] or 0
        return cls(of, {layer: cut(layer_edges(vectors, of, layer, m, name)) for layer in range(top + 1)}, name)

    def add(self, vectors: DataFrame, more: DataFrame, m: int, factor: float, max_layers: int, seed: int) -> Layered:
        """With new vectors, linked on every layer that they reach; the tallest may open new layers."""
        new = cut(levels(more.select("vec_id").distinct(), factor, max_layers, seed))
        of = cut(self.of.unionByName(new))
        top = of.agg(F.max("level")).first()[0] or 0
        none = self.links[0].limit(0)
        return Layered(of, {n: cut(insert(self.links.get(n, none), of_layer(vectors, self.of, n), of_layer(more, new, n), m, self.name)) for n in range(top + 1)}, self.name)

    def remove(self, ids: DataFrame) -> Layered:
        of = cut(self.of.join(ids.select("vec_id"), "vec_id", "left_anti"))
        top = of.agg(F.max("level")).first()[0] or 0
        return Layered(of, {n: cut(remove(df, ids)) for n, df in self.links.items() if n <= top}, self.name)

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, ef: int = 50) -> DataFrame:
        """From the entry point (least id of the top layer) greedily down, then a beam of max(ef, k) on layer 0."""
        start = self.of.agg(F.max_by("vec_id", F.struct("level", -F.col("vec_id"))).alias("vec_id"))
        at = queries.select("query_id").distinct().join(F.broadcast(start))  # one row
        distances = Distances(vectors, queries, self.name)
        for layer in sorted(self.links, reverse=True):
            if layer:
                at = beam(vectors, queries, self.links[layer], at, 1, self.name, distances).select("query_id", "vec_id")
        return beam(vectors, queries, self.links[0], at, max(ef, k), self.name, distances).filter(F.col("rnk") <= k)


def remove(links: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("vec_id")
    return links.join(gone, links["src"] == gone["vec_id"], "left_anti").join(gone, links["dst"] == gone["vec_id"], "left_anti")
