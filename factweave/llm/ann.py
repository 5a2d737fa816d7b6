"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and code books are fitted on a sample of at most ``sample`` vectors; every vector is indexed. A query visits the lists
nearest to it. How many, is measured: for at most HELD_OUT vectors that are not in the sample the exact neighbours among all rows
are found in one pass, and as many lists are visited as give them the recall ``target``. Lists that hold too few rows for an
answer are no end: a query goes on until it has ``k`` rows.

In the lists visited, distances come from one table a query of its parts against the code books (asymmetric: the query is not
quantised). With the residual's norm, which is stored beside the code, that distance bounds the true one from both sides: every
row whose lower bound is not above the k-th smallest upper bound is ranked by its exact distance, so that nothing near is lost,
however many rows share a code.

Vectors that are null, zero, or that hold null or non-finite components take no part, nor do rows with a null ``vec_id``.
Vectors of each length are a search of their own. ``vec_id`` is a key: rows that repeat one count once. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factweave.llm.store import outlive

PARTS, SAMPLE, SAMPLE_VALUES, TARGET, HELD_OUT = 16, 20_000, 1 << 23, 0.95, 256
BLOCK, LEAST_BLOCK = 8192, 256  # rows of a cell: most, fewer of long vectors, and least; queries of a cell: most


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, less each row's own square."""
    return (centers**2).sum(1)[None] - 2 * rows @ centers.T


def kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(part, centers).argmin(1) for part in np.array_split(rows, max(1, len(rows) // 4096))])
        n = np.bincount(own, minlength=len(centers))
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(n)
        centers[full] = np.add.reduceat(rows[order], np.concatenate(([0], np.cumsum(n[full])[:-1])), axis=0) / n[full, None]
    return centers


class Index:
    """Coarse centroids and, for each part of the residual, a code book of up to 256 entries."""

    def __init__(self, rows: np.ndarray, lists: int, parts: int = PARTS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = rows.shape[1]
        self.parts = next(p for p in range(min(parts, self.dim), 0, -1) if self.dim % p == 0)
        self.centers = kmeans(rows, min(lists, len(rows)), 12, rng)
        residual = rows - self.centers[self.lists(rows)]
        self.books = np.stack([kmeans(part, min(256, len(rows)), 8, rng) for part in self._cut(residual)])
        self.reach = math.sqrt((self.centers**2).sum(1).max()) + math.sqrt((self.books**2).sum(2).max(1).sum())

    def _cut(self, rows: np.ndarray) -> np.ndarray:
        return rows.reshape(len(rows), self.parts, -1).swapaxes(0, 1)

    def lists(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([_nearest(part, self.centers).argmin(1) for part in np.array_split(rows, max(1, len(rows) // 4096))])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, the distance of each row to what its code stands for, and the part of a squared distance that hangs
        on list and code alone."""
        own = self.lists(rows)
        parts = self._cut(rows - self.centers[own])
        codes = np.stack([_nearest(p, b).argmin(1) for p, b in zip(parts, self.books, strict=True)], 1)
        coded = np.stack([b[c] for b, c in zip(self.books, codes.T, strict=True)])
        missed = np.sqrt(((parts - coded) ** 2).sum((0, 2)))
        fixed = (coded**2).sum((0, 2)) + 2 * (coded * self._cut(self.centers[own])).sum((0, 2))
        return own, codes.astype(np.uint8), missed, fixed

    def order(self, rows: np.ndarray) -> np.ndarray:
        """Lists of each row, nearest first."""
        return np.argsort(_nearest(rows, self.centers), axis=1, kind="stable")

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one query: squared distances to the centroids, and -2 times its products with the code books."""
        return ((self.centers - query) ** 2).sum(1), -2 * (self.books * query.reshape(self.parts, 1, -1)).sum(2)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Of the rows (vec_id, v) of each length: it, the rows, and their vectors as a matrix."""
    for batch in batches:
        lengths = batch.column(1).value_lengths()
        for dim in lengths.unique().to_pylist():
            own = batch.filter(pc.equal(lengths, dim))
            yield dim, own, np.asarray(own.column(1).flatten()).reshape(-1, dim)


def _raw(rows: np.ndarray, kind: str) -> pa.Array:
    raw, m = rows.astype(kind).tobytes(), rows.shape[1] * np.dtype(kind).itemsize
    return pa.array([raw[i : i + m] for i in range(0, len(raw), m)], pa.binary())


class Cell:
    """Coded rows of some lists, sorted by list and id, that queries search."""

    def __init__(self, index: Index, lists: np.ndarray, ids: np.ndarray, codes: np.ndarray, missed: np.ndarray, fixed: np.ndarray, rows: np.ndarray):
        self.index, self.lists, self.ids, self.missed, self.fixed, self.rows = index, lists, ids, missed, fixed, rows
        self.place = codes.astype(np.int64) + np.arange(codes.shape[1]) * index.books.shape[1]
        self.bounds = np.searchsorted(lists, np.arange(len(index.centers) + 1))
        self.once = np.append(True, (ids[1:] != ids[:-1]) | (lists[1:] != lists[:-1]))[: len(ids)]

    def closest(self, query_id: int, q: np.ndarray, visits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact distances of the ``k`` rows nearest to ``q`` in the lists it visits, by distance and id."""
        to_center, table = self.index.tables(q)
        span = [np.arange(self.bounds[x], self.bounds[x + 1]) for x in visits]
        at = np.concatenate([*span, np.zeros(0, np.int64)])
        at = at[self.ids[at] != query_id]
        guess = np.sqrt(np.maximum(to_center[self.lists[at]] + self.fixed[at] + table.reshape(-1)[self.place[at]].sum(1), 0))
        upper, once = guess + self.missed[at], self.once[at]
        if once.sum() > k:  # a not-a-number is no reason to drop a row
            limit = np.partition(upper[once], k - 1)[k - 1]
            at = at[~(guess - self.missed[at] > limit + 1e-6 * (limit + math.sqrt((q**2).sum()) + self.index.reach))]
        exact = np.sqrt(((self.rows[at] - q) ** 2).sum(1))
        order = np.lexsort((self.ids[at], exact))
        near, exact = self.ids[at][order], exact[order]
        first = np.sort(np.unique(near, return_index=True)[1])[:k]
        return near[first], exact[first]


def _exact(batches: Iterator[pa.RecordBatch], asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, held: str) -> Iterator[pa.RecordBatch]:
    """Of the rows (dim, list, vec_id, v) of a task, vectors as raw numbers of kind ``held``, the ``k`` nearest to each query in ``asked`` (of each length: ids, vectors)."""
    best = {dim: (np.full((len(ids), k), np.inf), np.full((len(ids), k), -1), np.zeros((len(ids), k), np.int64)) for dim, (ids, _) in asked.items()}
    for batch in batches:
        dims, lists, ids = (np.asarray(batch.column(i)) for i in range(3))
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            v = np.frombuffer(b"".join(batch.column(3).take(pa.array(own)).to_pylist()), held).reshape(-1, dim).astype(float)
            query_ids, q = asked[dim]
            d = np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T, 0)
            d[query_ids[:, None] == ids[own][None]] = np.inf
            far, where, which = best[dim]
            far, where, which = np.hstack((far, d)), np.hstack((where, np.tile(lists[own], (len(q), 1)))), np.hstack((which, np.tile(ids[own], (len(q), 1))))
            pick = np.argpartition(far, k - 1, axis=1)[:, :k]
            best[dim] = tuple(np.take_along_axis(x, pick, 1) for x in (far, where, which))
    for dim, (far, where, which) in best.items():
        found = np.isfinite(far)
        query = np.repeat(asked[dim][0], found.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), dim, "i4")), pa.array(query), pa.array(where[found].astype("i4")), pa.array(which[found]), pa.array(far[found])], names=["dim", "query_id", "list", "vec_id", "d"])


def _measured(index: DataFrame, models: dict[int, Index], held_out: dict[int, tuple[np.ndarray, np.ndarray]], k: int, target: float, held: str) -> dict[int, int]:
    """Of each length, the least number of lists that gives the held-out queries the recall ``target``."""
    near = index.select("dim", "list", "vec_id", "v").mapInArrow(lambda batches: _exact(batches, held_out, k, held), "dim int, query_id long, list int, vec_id long, d double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("dim", "query_id").orderBy("d", "vec_id"))).filter(F.col("r") <= k)
    found = best.select("dim", "query_id", "list").toPandas()  # at most HELD_OUT * k rows a length
    out = {}
    for dim, (ids, q) in held_out.items():
        place = np.argsort(models[dim].order(q), axis=1)
        mine = found[found["dim"] == dim]
        row = {query: i for i, query in enumerate(ids.tolist())}
        depth = np.sort([place[row[query], x] for query, x in zip(mine["query_id"], mine["list"], strict=True)])
        out[dim] = int(depth[min(len(depth) - 1, math.ceil(target * len(depth)) - 1)]) + 1 if len(depth) else len(models[dim].centers)
    return out


def _grouped(sizes: list[tuple[int, int]], block: int) -> tuple[dict[int, int], dict[int, int]]:
    """(group of each list, blocks of each group): short lists share a group, a long one is a group in blocks of its own."""
    group, across, held = {}, {}, 0
    for which, n in sorted(sizes):
        if not across or held + n > block:
            across[len(across)], held = 1, 0
        group[which] = len(across) - 1
        held += n
        across[group[which]] = math.ceil(held / block)
    return group, across


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, lists: int | None = None, probes: int | None = None, parts: int = PARTS, sample: int = SAMPLE, target: float = TARGET
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the ``k`` nearest found of each row whose vec_id ``every`` divides.

    ``lists`` is 4 * sqrt(rows) unless given, and an eighth of the sample at most; ``probes`` is measured unless given. The
    sample has at most ``sample`` vectors and SAMPLE_VALUES components.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    per_length = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    counts = {r["dim"]: r["n"] for r in per_length.filter("n > 1 and asked > 0").collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    models: dict[int, Index] = {}
    held_out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, n in counts.items():
        aside = min(HELD_OUT, n // 2)
        drawn = rows.filter(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(aside + max(1, min(sample, SAMPLE_VALUES // dim))).toArrow().combine_chunks()
        ids, v = drawn["vec_id"].to_numpy(), np.asarray(drawn["v"].combine_chunks().flatten()).reshape(-1, dim)
        ids, first = np.unique(ids[:aside], return_index=True)
        held_out[dim] = ids, v[first]
        models[dim] = Index(v[aside:], lists or max(1, min(4 * math.isqrt(n), (len(v) - aside) // 8)), parts)
    shared = spark.sparkContext.broadcast(models)
    rows = rows.filter(F.size("v").isin(list(models)))
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, v in _by_length(batches):
            which, codes, missed, fixed = shared.value[dim].encode(v)
            columns = [pa.array(np.full(len(v), dim, "i4")), pa.array(which, pa.int32()), own.column(0), _raw(codes, "u1"), pa.array(missed), pa.array(fixed), _raw(v, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "list", "vec_id", "code", "missed", "fixed", "v"])

    index = outlive(rows.mapInArrow(coded, "dim int, list int, vec_id long, code binary, missed double, fixed double, v binary"), "index")
    visits = dict.fromkeys(models, probes) if probes else _measured(index, models, held_out, k, target, kind)
    sizes = index.groupBy("dim", "list").agg(F.count_distinct("vec_id").alias("ids"), F.count("*").alias("n")).collect()  # one row a list
    shape: dict[int, tuple[dict[int, int], np.ndarray]] = {}
    across: list[tuple[int, int, int]] = []
    for dim, model in models.items():
        mine = [(r["list"], r["n"]) for r in sizes if r["dim"] == dim]
        share = sum(n for _, n in mine) // int(spark.conf.get("spark.sql.shuffle.partitions"))  # a cell a task, unless that is too many rows
        group, blocks = _grouped(mine, max(min(LEAST_BLOCK, BLOCK), min(share, BLOCK * 64 // max(dim, 64))))
        held = np.zeros(len(model.centers), np.int64)
        for r in sizes:
            if r["dim"] == dim:
                held[r["list"]] = r["ids"]
        shape[dim] = group, held
        across += [(dim, g, n) for g, n in blocks.items()]
    plan = spark.sparkContext.broadcast(shape)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once a group of lists that it visits, with those lists."""
        for dim, own, v in _by_length(batches):
            group, held = plan.value[dim]
            order = shared.value[dim].order(v)
            enough = (np.cumsum(held[order], axis=1) <= k).sum(1) + 1  # its own row is among them
            at, groups, which = [], [], []
            for i, n in enumerate(np.maximum(enough, visits[dim]).tolist()):
                mine: dict[int, list[int]] = {}
                for x in order[i, :n].tolist():
                    if x in group:
                        mine.setdefault(group[x], []).append(x)
                at += [i] * len(mine)
                groups += mine.keys()
                which += mine.values()
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), dim, "i4")), pa.array(groups, pa.int32()), own.column(0).take(pick), _raw(v, kind).take(pick), pa.array(which, pa.list_(pa.int32()))],
                names=["dim", "group", "query_id", "q", "lists"],
            )

    where = F.broadcast(spark.createDataFrame([(dim, x, g) for dim, (group, _) in shape.items() for x, g in group.items()], "dim int, list int, group int"))  # one row a list
    asked = rows.filter(F.col("vec_id") % every == 0).mapInArrow(visited, "dim int, group int, query_id long, q binary, lists array<int>")
    down = {(r["dim"], r["group"]): r["down"] for r in asked.groupBy("dim", "group").agg(F.ceil(F.count("*") / BLOCK).alias("down")).collect()}
    cells = F.broadcast(spark.createDataFrame([(dim, g, n, down[dim, g]) for dim, g, n in across if (dim, g) in down], "dim int, group int, across long, down long"))
    dealt = index.join(where, ["dim", "list"]).join(cells, ["dim", "group"])
    dealt = dealt.select("dim", "group", "list", "vec_id", "code", "missed", "fixed", "v", F.pmod(F.xxhash64("vec_id"), "across").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("r"))
    asked = asked.join(cells, ["dim", "group"])
    asked = asked.select("dim", "group", "query_id", "q", "lists", F.pmod(F.xxhash64("query_id"), "down").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("c"))

    def cell(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values(["list", "vec_id"], kind="stable")
            codes, v = (np.frombuffer(b"".join(left[c]), of).reshape(len(left), -1) for c, of in (("code", np.uint8), ("v", kind)))
            here = Cell(shared.value[int(key[0])], left["list"].to_numpy(), left["vec_id"].to_numpy(), codes, left["missed"].to_numpy(), left["fixed"].to_numpy(), v.astype(float))
            for query_id, q, mine in zip(right["query_id"], right["q"], right["lists"], strict=True):
                near, exact = here.closest(query_id, np.frombuffer(q, kind).astype(float), mine, k)
                out["query_id"].append(np.full(len(near), query_id))
                out["vec_id"].append(near)
                out["score"].append(exact)
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, "f8" if c == "score" else "i8") for c, x in out.items()})

    found = dealt.groupBy("dim", "group", "r", "c").cogroup(asked.groupBy("dim", "group", "r", "c")).applyInPandas(cell, "query_id long, vec_id long, score double")
    scored = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return (
        scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
