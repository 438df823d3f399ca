"""Approximate nearest neighbours: a vantage-point tree per shard, each built once.

A top tree over a bounded sample parts space into cells; every vector is routed to the
cell it lies in, and a cell of more than ``SHARD_ROWS`` vectors is dealt into shards by
hash, so that a hot cell (a very common vector) is many shards.  Every shard builds a
vantage-point tree over all its vectors, once, and answers the queries sent to it.

A query's k-th distance within the sample bounds its k-th distance among all vectors.
It is sent to the cells that the triangle inequality lets hold something nearer: a cell's
bound times ``factor`` must not exceed it.  Within a tree a child is left out when its
bound times ``factor`` exceeds the k-th distance so far.  ``factor`` 1 is exact search;
greater values prune more and may lose neighbours.  A shard returns only what is within
the bound, k at most, and the best k of a query's are chosen by a partial sort.

Distances are sums over components in their order, in double precision, so the same pair
has the same distance wherever it is measured.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows with a null vec_id; vectors are compared with those of the
same length only; equal distances go to the smaller vec_id; rows that repeat a vec_id
are queries each and candidates each, also of one another; fewer candidates than k give
fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Vectors of a shard, about; queries of a block that a shard's task searches at once.
SHARD_ROWS, BLOCK = 20_000, 1_024
#: Vectors that the top tree is fitted on, by smallest hash, and the least of them in a cell.
SAMPLE, CELL = 8_192, 16
LEAF = 64
FACTOR = 1.0


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances, the components summed one after another; shapes broadcast as in ``rows - to``."""
    total = (rows[..., 0] - to[..., 0]) ** 2
    for j in range(1, rows.shape[-1]):
        total += (rows[..., j] - to[..., j]) ** 2
    return np.sqrt(total)


class VantageTree:
    """A tree over the rows of ``x``; leaves hold at most LEAF rows, or rows equally far from their vantage point."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x = x
        #: (vantage row, left, right, low/high of left, low/high of right), or a leaf's rows
        self.nodes: list = []
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][1 + side] = me
            d = None
            if len(rows) > leaf:
                pick = rows[(len(rows) * 7919 + 17) % len(rows)]
                d = distances(x[rows], x[pick])
                if d.max() == d.min():
                    d = None
            if d is None:
                self.nodes.append(rows)
                continue
            middle = np.median(d)
            inner = d <= middle
            if inner.all():
                inner = d < middle
            self.nodes.append([pick, None, None, d[inner].min(), d[inner].max(), d[~inner].min(), d[~inner].max()])
            todo.append((rows[~inner], me, 1))
            todo.append((rows[inner], me, 0))

    def search(self, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, ids: np.ndarray, rows_: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (infinite where there are too few) of the k nearest of each query within its limit; the row ``own`` is left out.

        ``ids`` and ``rows_`` are the vec_id and the row number of each vector of the tree.
        """
        n = len(queries)
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

        def visit(rows: np.ndarray, some: np.ndarray) -> None:
            for a in range(0, len(rows), 4 * LEAF):  # leaves of equal vectors can be long
                part = rows[a : a + 4 * LEAF]
                for b in range(0, len(some), 512):
                    q = some[b : b + 512]
                    d = distances(queries[q][:, None, :], self.x[part][None, :, :])
                    d = np.where((rows_[part] == own[q][:, None]) | (d > limit[q][:, None]), np.inf, d)
                    who = np.broadcast_to(ids[part], d.shape)
                    d, who = np.concatenate([best_d[q], d], 1), np.concatenate([best_i[q], who], 1)
                    order = np.lexsort((who, d), axis=-1)[:, :k]
                    best_d[q], best_i[q] = np.take_along_axis(d, order, 1), np.take_along_axis(who, order, 1)

        # first each query's nearest leaf, for a bound to prune with; then every leaf that may hold better
        todo = [(0, np.arange(n))]
        done: dict[int, np.ndarray] = {}
        while todo:
            at, some = todo.pop()
            node = self.nodes[at]
            if not len(some):
                continue
            if isinstance(node, np.ndarray):
                visit(node, some)
                done[at] = some
                continue
            d = distances(queries[some], self.x[node[0]])
            left = d - node[4] <= node[5] - d
            todo += [(node[1], some[left]), (node[2], some[~left])]
        stack = [(0, np.arange(n), np.zeros(n))]
        while stack:
            at, some, bound = stack.pop()
            alive = bound * factor <= np.minimum(best_d[some, k - 1], limit[some])
            some, bound = some[alive], bound[alive]
            if not len(some):
                continue
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                visit(node, np.setdiff1d(some, done[at], assume_unique=True) if at in done else some)
                continue
            d = distances(queries[some], self.x[node[0]])
            for child, low, high in ((node[2], node[5], node[6]), (node[1], node[3], node[4])):
                stack.append((child, some, np.maximum(bound, _gap(low, d, high))))
        return best_i, best_d


def _gap(low: np.ndarray | float, d: np.ndarray, high: np.ndarray | float) -> np.ndarray:
    """The least distance of a query at ``d`` from the vantage point to what is between ``low`` and ``high`` of it, less what rounding may add."""
    top = np.where(np.isfinite(high), high, 0.0)
    return np.maximum(low - d, d - high) - 1e-12 * (d + low + top)


class Cells:
    """The top tree: parts space by distances to vantage points of a sample; cells are numbered as its leaves come."""

    def __init__(self, x: np.ndarray, cells: int) -> None:
        self.x = x
        self.tree = VantageTree(x, max(CELL, -(-len(x) // cells)))
        self.number = {at: i for i, at in enumerate(i for i, node in enumerate(self.tree.nodes) if isinstance(node, np.ndarray))}

    def home(self, v: np.ndarray) -> np.ndarray:
        """The cell of each vector: at every node the inner child up to its farthest sample, else the outer one."""
        out = np.zeros(len(v), np.int64)
        todo = [(0, np.arange(len(v)))]
        while todo:
            at, some = todo.pop()
            node = self.tree.nodes[at]
            if isinstance(node, np.ndarray):
                out[some] = self.number[at]
                continue
            inner = distances(v[some], self.x[node[0]]) <= node[4]
            todo += [(node[1], some[inner]), (node[2], some[~inner])]
        return out

    def reached(self, q: np.ndarray, limit: np.ndarray, factor: float) -> list[np.ndarray]:
        """For each query the cells that may hold a vector within its limit, its home among them."""
        who, where = [np.arange(len(q))], [self.home(q)]
        stack = [(0, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            at, some, bound = stack.pop()
            alive = bound * factor <= limit[some]
            some, bound = some[alive], bound[alive]
            node = self.tree.nodes[at]
            if isinstance(node, np.ndarray):
                who.append(some)
                where.append(np.full(len(some), self.number[at]))
            elif len(some):
                d = distances(q[some], self.x[node[0]])
                stack.append((node[1], some, np.maximum(bound, _gap(0.0, d, node[4]))))
                stack.append((node[2], some, np.maximum(bound, _gap(node[4], d, np.inf))))
        pairs = np.unique(np.concatenate(who) * len(self.tree.nodes) + np.concatenate(where))
        return np.split(pairs % len(self.tree.nodes), np.searchsorted(pairs // len(self.tree.nodes), np.arange(1, len(q))))


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): the vectors that take part, in double precision, numbered and written once."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, which rows) of a column of vectors."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


def _sampled(vectors: DataFrame, sample: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of the sample, by length."""
    t = vectors.orderBy(F.xxhash64("row", "vec_id"), "row").limit(sample).select("row", "v").toArrow()
    v = t.column("v").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64()))
    rows = t.column("row").to_numpy()
    return {d: (rows[own], _matrix(v.take(pa.array(own)))) for d, own in _by_length(v)}


def _routed(vectors: DataFrame, sent) -> DataFrame:
    """(row, vec_id, v, cell): cells as ``length:number``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = sent.value
        for batch in batches:
            for d, own in _by_length(batch.column(2)):
                part = batch.take(pa.array(own))
                home = tops[d][2].home(_matrix(part.column(2))) if d in tops else np.zeros(len(own), np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f"{d}:{c}" for c in home.tolist()])], ["row", "vec_id", "v", "cell"])

    return vectors.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v array<double>, cell string")


def _asked(queries: DataFrame, sent, k: int, factor: float) -> DataFrame:
    """(row, vec_id, v, bound, cell) for every cell that a query is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = sent.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                for d, own in _by_length(batch.column(2)):
                    part = batch.take(pa.array(own))
                    bound, cells = np.full(len(own), np.inf), [np.zeros(1, np.int64)] * len(own)
                    if d in tops:
                        rows, x, top = tops[d]
                        q = _matrix(part.column(2))
                        if len(x) > k:
                            far = distances(q[:, None, :], x[None, :, :])
                            far[part.column(0).to_numpy()[:, None] == rows] = np.inf
                            bound = np.partition(far, k - 1, axis=1)[:, k - 1]
                        cells = top.reached(q, bound, factor)
                    again = pa.array(np.repeat(np.arange(len(own)), [len(c) for c in cells]))
                    yield pa.RecordBatch.from_arrays(
                        [*part.take(again).columns, pa.array(bound).take(again), pa.array([f"{d}:{c}" for some in cells for c in some.tolist()])],
                        ["row", "vec_id", "v", "bound", "cell"],
                    )

    return queries.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v array<double>, bound double, cell string")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors other than itself. ``queries`` are rows of ``vectors``, as ``usable`` returns them."""
    spark = vectors.sparkSession
    shards = max(1, -(-vectors.count() // shard_rows))
    tops = {d: (rows, x, Cells(x, shards)) for d, (rows, x) in _sampled(vectors, sample).items()}
    sent = spark.sparkContext.broadcast(tops)  # ``sample`` vectors at most
    routed = materialize(_routed(vectors, sent), "routed")
    parts = materialize(routed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")), "cells")
    nothing = F.lit(None).cast("double")
    there = routed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "row", "vec_id", "v", nothing.alias("bound"))
    asked = _asked(queries, sent, k, factor).join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "row", "vec_id", "v", "bound")
    dealt = there.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    found = materialize(dealt.mapInArrow(_searcher(k, factor), "row long, query_id long, vec_id long, score double"), "neighbours")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, factor: float):
    """Searches one shard after another: its vectors come first and make its tree, then its queries, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, ids, rows = None, [], None, None, None
        for whole in batches:
            if not whole.num_rows:
                continue
            name = np.array([f"{c}/{p}" for c, p in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True)])
            kind = whole.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (kind[1:] != kind[:-1])]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(name)], strict=True):
                part = whole.slice(a, b - a)
                if name[a] != at:
                    at, held, tree = name[a], [], None
                if kind[a] == 0:
                    held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5)).copy()))
                    continue
                if tree is None:
                    if not held:
                        continue
                    rows, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    held, tree = [], VantageTree(x)
                for c in range(0, part.num_rows, BLOCK):
                    some = part.slice(c, BLOCK)
                    own = some.column(3).to_numpy()
                    got, far = tree.search(_matrix(some.column(5)), own, some.column(6).to_numpy(), ids, rows, k, factor)
                    there = np.isfinite(far)
                    of = np.repeat(np.arange(len(own)), there.sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(own[of]), some.column(4).take(pa.array(of)), pa.array(got[there]), pa.array(far[there])], ["row", "query_id", "vec_id", "score"])

    return run


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: vec_id divisible by 100 against all, 10 nearest, exactly."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
