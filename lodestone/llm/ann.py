"""Nearest neighbours by inner product, from a vantage-point tree per shard.

Vectors are put into the cells of a few centres; a cell's rows make up one shard
or, dealt by hash, several. A query searches its own cell first, and after that
the cells only whose bound, its product with the centre plus its length times
the cell's radius, reaches the k-th best score that it has.

Within a shard the largest inner product becomes the smallest Euclidean
distance: one more coordinate brings every vector to the length of the
longest. Blocks of queries go down a tree together, nearer child first; a
child is left out for those queries whose triangle-inequality bound, times a
factor, exceeds the distance of their k-th nearest so far. Factor one leaves
out nothing that could be nearer, so the search is exact; larger ones trade
recall for time. Scores are sums in the order of the coordinates, in double
precision, on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import lowest, staged

#: A centre for so many times the root of the number of vectors.
ROOTS = 1 / 16
#: Vectors of a shard, of a leaf, and queries that go down a tree together.
SHARD, LEAF, BLOCK = 8192, 128, 1024
K, EVERY, FACTOR = 20, 20, 1.0
LAST = np.iinfo(np.int64).max


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in the order of the coordinates."""
    return np.cumsum(q * x, axis=1)[:, -1] if len(q) else np.zeros(0)


class Tree:
    """ids (ascending within equal vectors) and their vectors, as rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K, leaf: int = LEAF):
        # of equal vectors, more than k + 1 can never be among the k nearest of a query
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        self.ids, self.vectors, self.k = ids[place <= k], vectors[place <= k], k
        norms = (self.vectors**2).sum(1)
        self.square = float(norms.max())
        lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(self.square - norms, 0))])
        self.leaf, self.nodes = leaf, []
        self.visited = 0
        self._build(lifted, np.arange(len(lifted)), np.random.default_rng(len(lifted)))

    def _build(self, lifted: np.ndarray, rows: np.ndarray, rng) -> int:
        """Nodes are (vantage point, ((child, least, most distance), ...)) or rows."""
        number = len(self.nodes)
        self.nodes.append(None)
        if len(rows) > self.leaf:
            some = lifted[rng.choice(rows, min(len(rows), 8), replace=False)]
            probe = lifted[rng.choice(rows, min(len(rows), 64), replace=False)]
            spread = [np.var(np.linalg.norm(probe - v, axis=1)) for v in some]
            point = some[int(np.argmax(spread))]
            away = np.linalg.norm(lifted[rows] - point, axis=1)
            middle = np.median(away)
            near = away <= middle
            if near.all():
                near = away < middle
            if near.any() and not near.all():
                children = []
                for side in (near, ~near):
                    children.append((self._build(lifted, rows[side], rng), away[side].min(), away[side].max()))
                self.nodes[number] = (point, children)
                return number
        self.nodes[number] = rows
        return number

    def search(self, ids: np.ndarray, queries: np.ndarray, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest rows of each query, ties to smaller
        ids; LAST and -inf where there are fewer. A row with the query's id is
        its own and takes no part."""
        self.best = np.full((len(ids), self.k), -np.inf)
        self.found = np.full((len(ids), self.k), LAST)
        self.query_ids, self.queries, self.factor = ids, queries, factor
        self.lengths = (queries**2).sum(1)
        self.slack = 1e-9 * (self.lengths + self.square)
        self._visit(0, np.arange(len(ids)))
        return self.found, self.best

    def _reach(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th nearest so far."""
        square = self.lengths[active] + self.square - 2 * self.best[active, -1]
        return np.sqrt(np.maximum(square, 0) + self.slack[active])

    def _visit(self, number: int, active: np.ndarray) -> None:
        node = self.nodes[number]
        if not isinstance(node, tuple):
            self._leaf(node, active)
            return
        point, children = node
        square = self.lengths[active] + self.square - 2 * (self.queries[active] @ point[:-1])
        away = np.sqrt(np.maximum(square, 0))
        bounds = [np.maximum(np.maximum(low - away, away - high), 0) for _, low, high in children]
        first = bounds[0] <= bounds[1]
        for turn in (0, 1):
            for side, (child, _, _) in enumerate(children):
                mine = first == (side == turn)
                go = mine & (bounds[side] * self.factor <= self._reach(active)) if mine.any() else mine
                if go.any():
                    self._visit(child, active[go])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        self.visited += len(active) * len(rows)
        rough = self.queries[active] @ self.vectors[rows].T
        open_ = rough >= (self.best[active, -1] - self.slack[active])[:, None]
        open_ &= self.ids[rows][None, :] != self.query_ids[active][:, None]
        some = open_.any(1)
        if not some.any():
            return
        active, open_ = active[some], open_[some]
        i, j = np.nonzero(open_)
        scores = np.full(open_.shape, -np.inf)
        scores[i, j] = exact(self.queries[active[i]], self.vectors[rows[j]])
        own = np.where(open_, self.ids[rows][None, :], LAST)
        scores = np.concatenate([self.best[active], scores], 1)
        own = np.concatenate([self.found[active], own], 1)
        order = np.lexsort((own, -scores), axis=1)[:, : self.k]
        self.best[active] = np.take_along_axis(scores, order, 1)
        self.found[active] = np.take_along_axis(own, order, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """id, vector (doubles) and dim of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def nearest(block: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each vector, its distance)."""
    square = (block**2).sum(1)[:, None] - 2 * block @ centres.T + (centres**2).sum(1)
    at = square.argmin(1)
    return at, np.linalg.norm(block - centres[at], axis=1)


def _blocks(batch: pa.RecordBatch, dim: str, vector: str) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, dim, their vectors) of each dim of a batch."""
    dims = batch.column(dim).to_numpy()
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield rows, d, batch.column(vector).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d)


def placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with their cell and the distance to its centre."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, d, block in _blocks(batch, "dim", "vector") if batch.num_rows else ():
                cell[at], away[at] = nearest(block, held.value.get(d, np.zeros((1, d))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "dim", "vector")), pa.array(cell), pa.array(away)], ["id", "dim", "vector", "cell", "away"])

    return rows.select("id", "dim", "vector").mapInArrow(run, "id long, dim int, vector array<double>, cell int, away double")


def routed(queries: DataFrame, cells: dict[int, tuple[np.ndarray, ...]], factor: float) -> DataFrame:
    """A row for each query and other cell that may hold one of its k nearest;
    ``cells``: of each dim, numbers, centres and radii. kth: its score so far."""
    held = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, d, block in _blocks(batch, "dim", "vector") if batch.num_rows else ():
                numbers, centres, radii = held.value[d]
                some = batch.take(pa.array(at))
                length = np.linalg.norm(block, axis=1)
                bound = block @ centres.T + length[:, None] * radii[None] / factor
                slack = 1e-9 * (1 + np.abs(bound))
                open_ = bound + slack >= some.column("kth").to_numpy()[:, None]
                open_ &= numbers[None] != some.column("cell").to_numpy()[:, None]
                i, j = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(i)) for c in ("id", "dim", "vector")), pa.array(numbers[j].astype(np.int32))], ["id", "dim", "vector", "cell"])

    return queries.select("id", "dim", "vector", "cell", "kth").mapInArrow(run, "id long, dim int, vector array<double>, cell int")


def descended(base: DataFrame, asked: DataFrame, shards: DataFrame, tasks: int, k: int, factor: float) -> DataFrame:
    """query_id, vec_id and score of the k nearest in each shard of the cells
    that the rows of ``asked`` name. A task gets a shard's rows, then its
    queries in blocks: it never holds more than its tree and a block."""
    asked = asked.join(F.broadcast(shards), ["dim", "cell"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("dim", "cell", "part", F.lit(1).alias("kind"), "id", "vector")
    dealt = base.unionByName(asked).repartition(tasks, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in range(4)])
            ids = batch.column(4).to_numpy()
            turn = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            edges = [0, *turn.tolist(), len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                own = batch.column(5).slice(a, b - a)
                block = own.flatten().to_numpy().reshape(b - a, int(keys[0, a]))
                if at != tuple(keys[:3, a]):
                    at, tree, held = tuple(keys[:3, a]), None, []
                if keys[3, a] == 0:
                    held.append((ids[a:b], block))
                    continue
                if tree is None and held:
                    tree, held = Tree(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), k), []
                for c in range(0, b - a if tree else 0, BLOCK):
                    asked_ids = ids[a + c : min(b, a + c + BLOCK)]
                    found, best = tree.search(asked_ids, block[c : c + BLOCK], factor)
                    real = found != LAST
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked_ids, real.sum(1))), pa.array(found[real]), pa.array(best[real])], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """Of each shard's k nearest, the k nearest."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each query.

    Queries are the rows whose vec_id is a multiple of ``every``, candidates
    all rows but those with the query's vec_id. Vectors that are null, zero,
    or hold null or a non-finite number take no part, and vectors of other
    lengths are no candidates. A vec_id that is repeated is one query (its
    least vector) and as many candidates; of those that tie, equal ids come in
    any order, being equal. Fewer candidates than k are all returned, and an
    empty table gives no rows.
    """
    rows = usable(vectors)
    count = rows.count()
    picks = lowest(rows.select("id", "dim", "vector"), "id", max(1, round(count**0.5 * ROOTS))).collect()
    centres = {d: np.array([r.vector for r in picks if r.dim == d]) for d in {r.dim for r in picks}}
    cells = staged(placed(rows, centres), "cells")
    known = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("dim", "cell").collect()  # a row a cell
    shards = cells.sparkSession.createDataFrame([(r.dim, r.cell, -(-r.n // shard)) for r in known], "dim int, cell int, parts int")
    of = {d: [r for r in known if r.dim == d] for d in {r.dim for r in known}}
    bounds = {d: (np.array([r.cell for r in rs]), centres.get(d, np.zeros((1, d)))[[r.cell for r in rs]], np.array([r.radius for r in rs])) for d, rs in of.items()}
    tasks = max(1, sum(-(-r.n // shard) for r in known))

    split = cells.join(F.broadcast(shards), ["dim", "cell"])
    base = split.select("dim", "cell", F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "vector")
    queries = cells.filter(F.col("id") % every == 0).groupBy("dim", "id").agg(F.min(F.struct("vector", "cell")).alias("own")).select("dim", "id", "own.vector", "own.cell")
    near = staged(best(descended(base, queries, shards, tasks, k, factor), k), "near")
    kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    open_ = queries.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    far = descended(base, routed(open_, bounds, factor), shards, tasks, k, factor)
    return best(near.drop("rank").unionByName(far), k)
