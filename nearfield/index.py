"""Interchangeable indexes: fit, add, remove, search, save, load."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.distances import metric
from nearfield.operators import graph, knn, lsh, pq, trees
from nearfield.plans import store


class Index(ABC):
    """A set of vectors and a way to search it. Ids are stable; unknown ids to remove are ignored; fit may be repeated.

    add and remove change the structure that fit has built, and don't build it anew.
    """

    kind: str

    def __init__(self, name: str = "cosine", **params) -> None:
        self.metric, self.params, self.vectors = metric(name), params, None

    def fit(self, vectors: DataFrame) -> Index:
        self.vectors = vectors
        self._build()
        return self

    def add(self, more: DataFrame) -> Index:
        self._extend(more)
        self.vectors = knn.add(self.vectors, more)
        return self

    def remove(self, ids: DataFrame) -> Index:
        self._drop(ids.select("vec_id"))
        self.vectors = knn.remove(self.vectors, ids)
        return self

    @abstractmethod
    def _build(self) -> None: ...

    @abstractmethod
    def _extend(self, more: DataFrame) -> None:
        """Take in new vectors; self.vectors are still the old ones."""

    @abstractmethod
    def _drop(self, ids: DataFrame) -> None: ...

    @abstractmethod
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    @abstractmethod
    def _tables(self) -> dict[str, DataFrame]:
        """What _build made, by name."""

    @abstractmethod
    def _restore(self, tables: dict[str, DataFrame]) -> None:
        """The reverse of _tables."""

    def save(self, path: str) -> None:
        store.save({"vectors": self.vectors} | self._tables(), {"kind": self.kind, "tag": TAGS[self.kind], "metric": self.metric, "params": self.params}, path)


class LinScan(Index):
    """Exact search over an inverted index: the entries, written in the order of idx."""

    kind = "linscan"

    def _build(self) -> None:
        self.postings = store.cut(self.vectors.repartition("idx").sortWithinPartitions("idx", "vec_id"))

    def _extend(self, more: DataFrame) -> None:
        self.postings = self.postings.unionByName(more.select(*self.postings.columns))

    def _drop(self, ids: DataFrame) -> None:
        self.postings = knn.remove(self.postings, ids)

    def _tables(self) -> dict[str, DataFrame]:
        return {"postings": self.postings}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.postings = tables["postings"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return knn.knn(self.postings, queries, k, self.metric)


class Lsh(Index):
    kind = "lsh"

    def _build(self) -> None:
        self.table = store.cut(lsh.signed(self.vectors, **self.params))

    def _extend(self, more: DataFrame) -> None:
        self.table = self.table.unionByName(lsh.signed(more, **self.params))

    def _drop(self, ids: DataFrame) -> None:
        self.table = knn.remove(self.table, ids)

    def _tables(self) -> dict[str, DataFrame]:
        return {"buckets": self.table}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.table = tables["buckets"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return lsh.lsh_knn(self.vectors, queries, k, self.metric, self.table, **self.params)


class Annoy(Index):
    """Pivots are kept with their entries, so that they outlive the removal of their vectors."""

    kind = "annoy"

    def _build(self) -> None:
        self.forest = trees.Forest.fit(self.vectors, self.params.get("trees", 10), self.params.get("max_points", 20), self.metric, self.params.get("seed", 1))
        self.pivots = self._pivots()

    def _pivots(self) -> DataFrame:
        ids = None
        for level in self.forest.levels:
            ids = level.select("vec_id") if ids is None else ids.union(level.select("vec_id"))
        return store.cut(self.vectors.limit(0) if ids is None else self.vectors.join(ids.distinct(), "vec_id", "left_semi"))

    def _extend(self, more: DataFrame) -> None:
        self.forest = self.forest.add(self.pivots, more)

    def _drop(self, ids: DataFrame) -> None:
        self.forest = self.forest.remove(ids)

    def _tables(self) -> dict[str, DataFrame]:
        return {"leaves": self.forest.leaves, "pivots": self.pivots} | {f"level{i}": df for i, df in enumerate(self.forest.levels)}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.forest, self.pivots = trees.Forest([tables[f"level{i}"] for i in range(sum(t.startswith("level") for t in tables))], tables["leaves"], self.metric), tables["pivots"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.forest.search(self.vectors, queries, k, self.pivots)


class Pq(Index):
    """With `rerank`, so many of the best by codes are ranked by their exact distance."""

    kind = "pq"

    def _build(self) -> None:
        p = self.params
        self.parts = p.get("parts", 3)
        self.books = pq.train(self.vectors, self.parts, p.get("clusters", 50), p.get("iterations", 8), p.get("tolerance", 0.01), p.get("seed", 1), self.metric)
        self.codes = store.cut(pq.encode(self.vectors, self.books, self.parts, self.metric))

    def _extend(self, more: DataFrame) -> None:
        self.codes = store.cut(self.codes.unionByName(pq.encode(more, self.books, self.parts, self.metric)))

    def _drop(self, ids: DataFrame) -> None:
        self.codes = knn.remove(self.codes, ids)

    def _tables(self) -> dict[str, DataFrame]:
        return {"books": self.books, "codes": self.codes}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.parts, self.books, self.codes = self.params.get("parts", 3), tables["books"], tables["codes"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        more = self.params.get("rerank")
        found = pq.search(self.codes, queries, self.books, self.parts, max(k, more or 0), self.metric)
        return knn.rerank(found.select("query_id", "vec_id"), self.vectors, queries, k, self.metric) if more else found


class IvfPq(Index):
    kind = "ivfpq"

    def _build(self) -> None:
        p = self.params
        self.inverted = pq.Inverted.fit(self.vectors, p.get("parts", 3), p.get("clusters", 50), p.get("coarse", 16), p.get("iterations", 8), p.get("tolerance", 0.01), p.get("seed", 1), self.metric)

    def _extend(self, more: DataFrame) -> None:
        self.inverted = self.inverted.add(more)

    def _drop(self, ids: DataFrame) -> None:
        self.inverted = self.inverted.remove(ids)

    def _tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self.inverted, name) for name in ("coarse", "lists", "codebooks", "codes")}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.inverted = pq.Inverted(*(tables[name] for name in ("coarse", "lists", "codebooks", "codes")), self.params.get("parts", 3), self.metric)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        more = self.params.get("rerank")
        found = self.inverted.search(queries, max(k, more or 0), self.params.get("nprobe") or k)
        return knn.rerank(found.select("query_id", "vec_id"), self.vectors, queries, k, self.metric) if more else found


class Nsw(Index):
    kind = "nsw"

    def _build(self) -> None:
        self.links = store.cut(graph.edges(self.vectors, self.params.get("m", 16), self.metric, self.params.get("seed", 1)))

    def _extend(self, more: DataFrame) -> None:
        self.links = store.cut(graph.insert(self.links, self.vectors, more, self.params.get("m", 16), self.metric))

    def _drop(self, ids: DataFrame) -> None:
        self.links = store.cut(graph.remove(self.links, ids))

    def _tables(self) -> dict[str, DataFrame]:
        return {"links": self.links}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.links = tables["links"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        start = self.vectors.agg(F.min("vec_id").alias("vec_id"))
        entry = queries.select("query_id").distinct().join(F.broadcast(start))  # one row
        return graph.beam(self.vectors, queries, self.links, entry, max(self.params.get("ef", 50), k), self.metric).filter(F.col("rnk") <= k)


class Hnsw(Index):
    kind = "hnsw"

    def _shape(self) -> tuple[int, float, int, int]:
        p = self.params
        return p.get("m", 16), p.get("factor", 0.5), p.get("max_layers", 6), p.get("seed", 1)

    def _build(self) -> None:
        m, factor, most, seed = self._shape()
        self.layers = graph.Layered.fit(self.vectors, m, self.metric, factor, most, seed)

    def _extend(self, more: DataFrame) -> None:
        self.layers = self.layers.add(self.vectors, more, *self._shape())

    def _drop(self, ids: DataFrame) -> None:
        self.layers = self.layers.remove(ids)

    def _tables(self) -> dict[str, DataFrame]:
        return {"levels": self.layers.of} | {f"layer{n}": df for n, df in self.layers.links.items()}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.layers = graph.Layered(tables["levels"], {int(t.removeprefix("layer")): df for t, df in tables.items() if t.startswith("layer")}, self.metric)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.layers.search(self.vectors, queries, k, self.params.get("ef", 50))


KINDS = {c.kind: c for c in (Lsh, Annoy, Pq, IvfPq, Hnsw, Nsw, LinScan)}
# The numbers that tell saved indexes apart.
TAGS = {"lsh": 0, "annoy": 1, "pq": 2, "ivfpq": 3, "hnsw": 4, "nsw": 5, "linscan": 6}

# The parameters of the benchmark's synthetic and real runs.
PRESETS = {
    "synthetic": {
        "hnsw": {"factor": 0.5, "max_layers": 16, "m": 86, "ef": 400}, "lsh-simhash": {"n_buckets": 32, "hashes": 8}, "lsh-minhash": {"n_buckets": 32, "hashes": 8}, "pq": {"parts": 3, "clusters": 50, "iterations": 256, "tolerance": 0.01},
        "ivfpq": {"parts": 6, "clusters": 256, "coarse": 16, "iterations": 500, "tolerance": 0.01}, "nsw": {"m": 32, "ef": 200}, "linscan": {}, "annoy": {"trees": 10, "max_points": 20},
    },
    "real": {
        "hnsw": {"factor": 0.5, "max_layers": 32, "m": 86, "ef": 500}, "lsh-simhash": {"n_buckets": 32, "hashes": 8}, "lsh-minhash": {"n_buckets": 32, "hashes": 8}, "pq": {"parts": 3, "clusters": 50, "iterations": 256, "tolerance": 0.01},
        "ivfpq": {"parts": 16, "clusters": 5000, "coarse": 1024, "iterations": 1000, "tolerance": 0.01}, "nsw": {"m": 32, "ef": 200}, "linscan": {}, "annoy": {"trees": 25, "max_points": 50},
    },
}


def create_index(name: str, metric_name: str = "cosine", preset: str | None = None, **params) -> Index:
    """linscan, lsh-minhash, lsh-simhash, annoy, pq, ivfpq, nsw or hnsw; `preset` (synthetic or real) gives the parameters that aren't set, `seed` is one."""
    if name not in PRESETS["synthetic"]:
        raise ValueError(f"unknown index {name!r}")
    if preset is not None:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}")
        params = PRESETS[preset][name] | params
    if name.startswith("lsh-"):
        return Lsh(metric_name, kind=name.removeprefix("lsh-"), **params)
    return KINDS[name](metric_name, **params)


def load_index(spark: SparkSession, path: str) -> Index:
    """A saved index, ready to search: nothing is fitted again."""
    tables, meta = store.load(spark, path)
    if meta.get("kind") not in KINDS or TAGS[meta["kind"]] != meta.get("tag"):
        raise ValueError(f"{path} holds no known index: kind {meta.get('kind')!r}, tag {meta.get('tag')!r}")
    index = KINDS[meta["kind"]](meta["metric"], **meta["params"])
    index.vectors = tables["vectors"]
    index._restore(tables)
    return index
