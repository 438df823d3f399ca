"""MinHash near-duplicates by SetSketch registers.

Each text becomes its set of word shingles, and the set a sketch of ``M``
registers: for every register the smallest of the exponentially distributed
values that the elements draw there, truncated to a level of a geometric scale.
Sketches merge by taking the larger level, and equal levels of two sketches
betray similar sets.  The steps:

1. sketch every text; texts with equal sets become one node (partial aggregation);
2. band the registers; every node meets the smallest node of each of its buckets,
   which makes stars: two nodes that share a bucket share that star;
3. every node is held against its star's centre by the joint likelihood estimate; those
   that stay under the threshold (the minor nodes) are held against the whole star, in
   tiles of bounded size: nodes with no partner near the threshold go no further;
4. the full sets of the rest are compared, first with their centre's, which gives a first
   labelling by connected components; then minor nodes, whose label isn't their centre's,
   with the whole star, in tiles, likeliest pairs first, until what a tile's links connect
   is connected;
5. connected components over all verified links.

No bucket is capped, no pair list is emitted: a tile returns at most one row for
each of its nodes.  Nodes that link with their centre (nearly all of a large group of
copies) cost one comparison each; only r minor nodes of a star of n cost tiles, about
r * n / CHUNK**2 of them, which Spark spreads over tasks.

Defined results: null or wordless texts have an empty set and link with nothing;
fewer than ``k`` words make one shingle of the whole sequence; rows that repeat a
doc_id or a text keep their own output row; a null doc_id takes no part in naming
a component, and such a row is never kept unless its component has no id at all;
an empty table gives an empty table; columns other than doc_id and text are ignored;
a text of any length is one set, made whole, so a task holds the longest text's set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, materialize, release, table
from .kernels import GOLDEN, U64, mix, shingle_sets

#: Registers, and registers in a band: pairs at 0.85 are missed by all bands once in 1e8, at 0.8 once in 3e5.
M, ROWS = 160, 5
#: The levels of a register are powers of this.
LEVEL = 1.02
#: Nodes in a chunk of a star; a tile holds two chunks.
CHUNK = 512
#: Standard errors of the estimate under the threshold from which a pair isn't compared exactly.
SIGMAS = 5.0


def sketch(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """SetSketch levels (uint16) of each set, one row a set; an empty set has zeros.

    An element's draws are a Poisson process of rate m whose arrivals fall on
    uniform registers, so each register sees an exponential minimum.  Only arrivals
    before (ln m + 6) / n are made: with n elements a register stays empty (level 0)
    once in 400 sets.
    """
    out = np.zeros((len(sets), m), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.any():
        return out
    least = np.full((len(sets), m), np.inf)
    flat = least.reshape(-1)
    classes = np.where(sizes > 0, np.log2(np.maximum(sizes, 1)).astype(int), -1)
    for c in np.unique(classes[classes >= 0]).tolist():
        limit = (math.log(m) + 6) / (1 << c)
        steps = math.ceil(m * limit + 6 * math.sqrt(m * limit)) + 2
        members = np.flatnonzero(classes == c)
        per = max(1, 1_500_000 // (steps << (c + 1)))
        for a in range(0, len(members), per):
            some = members[a : a + per]
            h = np.concatenate([sets[i] for i in some])
            owner = np.repeat(some, sizes[some])
            at = np.zeros(len(h))
            state = mix(h)
            for i in range(1, steps + 1):  # as many rounds as the most arrivals; the survivors shrink fast
                r = mix(state + U64((i * GOLDEN) & (2**64 - 1)))
                at = at - np.log(((r >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52) / m
                alive = at <= limit
                if not alive.all():
                    at, state, owner, r = at[alive], state[alive], owner[alive], r[alive]
                    if not len(at):
                        break
                np.minimum.at(flat, owner * m + (mix(r) % U64(m)).astype(np.int64), at)
    with np.errstate(divide="ignore"):
        level = np.floor(1200.0 - np.log(least) / math.log(LEVEL))
    out[:] = np.where(np.isfinite(least), np.clip(level, 1, 65535), 0).astype(np.uint16)
    return out


def joint_estimate(plus: np.ndarray, minus: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of two sketched sets of known sizes.

    ``plus`` registers are greater in a, ``minus`` in b, the rest equal.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    best, found = np.full(u.shape, -np.inf), np.zeros(u.shape)
    shrink = (LEVEL - 1) / LEVEL

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 1e-9) * shrink) / math.log(LEVEL)

    for g in np.linspace(0, 1, 51):
        j = g * top
        a, b = p(u - v * j), p(v - u * j)
        score = plus * np.log(a) + minus * np.log(b) + (m - plus - minus) * np.log(np.maximum(1 - a - b, 1e-9))
        better = score > best
        best, found = np.where(better, score, best), np.where(better, j, found)
    return found


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, name (16 bytes naming the set) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                sets = shingle_sets(batch.column(1), k)
                columns = [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_name(s) for s in sets], pa.binary()),
                    pa.array([row.tobytes() for row in sketch(sets)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "name", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, name binary, sketch binary")


def _elements(docs: DataFrame, k: int) -> DataFrame:
    """name and elements of the set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                sets = shingle_sets(batch.column(0), k)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["name", "elements"])

    return docs.select("text").mapInArrow(run, "name binary, elements array<long>")


def _name(elements: np.ndarray) -> bytes | None:
    """128 bits that name a set: two independent sums over its mixed elements, and its size."""
    if not len(elements):
        return None
    a = int(mix(elements ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64))
    b = int(mix(elements + U64(0x1234567890ABCDEF)).sum(dtype=U64)) + len(elements) * GOLDEN
    return mix(np.array([a, b & (2**64 - 1)], dtype=U64)).tobytes()


def _bands(nodes: DataFrame, rows: int) -> DataFrame:
    """A row (bucket, node) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes_ = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(nodes_):
                continue
            levels = _levels(batch.column(1).to_pylist())
            bands = levels.shape[1] // rows
            h = np.zeros((len(nodes_), bands), dtype=U64)
            for r in range(rows):
                h = mix(h * U64(3) + levels[:, r : bands * rows : rows].astype(U64) + U64(1))
            h = mix(h + np.arange(bands, dtype=U64) * U64(GOLDEN))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes_, bands))], ["bucket", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "bucket long, node long")


def _levels(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint16).reshape(len(sketches), -1)


def _near_centre(pairs: DataFrame, threshold: int) -> DataFrame:
    """(star, node, main): whether the estimate lets each node link with its star's centre, which is main itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            star, node, n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            a, b = _levels(batch.column(4).to_pylist()), _levels(batch.column(5).to_pylist())
            possible = 100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
            e = joint_estimate((a > b).sum(1), (a < b).sum(1), M, n_a.astype(float), n_b.astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((star == node) | possible & (e >= _margin(threshold)))], ["star", "node", "main"])

    return pairs.select("star", "node", "n", "n_star", "sketch", "sketch_star").mapInArrow(run, "star long, node long, main boolean")


def _margin(threshold: int) -> float:
    t = threshold / 100
    return t - SIGMAS * math.sqrt(max(t * (1 - t), 1e-4) / M)


def _placed(members: DataFrame) -> DataFrame:
    """(star, lo, hi, chunk, node) of members (star, node, main): each star's nodes in chunks by hash, and each chunk in its tiles.

    The first chunks are of minor nodes and meet every chunk; those of main nodes meet the
    minor ones only, so a star without minor nodes has no tile.
    """
    size = F.count_if(~F.col("main")).alias("minor"), F.count_if(F.col("main")).alias("others")
    sizes = materialize(members.groupBy("star").agg(*size).where("minor > 0"), "sizes")  # so that the join below is one that Spark can split
    first, chunks = F.ceil(F.col("minor") / CHUNK).cast("int"), F.ceil(F.col("others") / CHUNK).cast("int")
    placed = members.join(sizes.select("star", first.alias("first"), chunks.alias("rest")), "star")
    placed = placed.withColumn("chunk", F.when(F.col("main"), F.col("first") + F.pmod(F.xxhash64("node"), F.greatest("rest", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("first"))).cast("int"))
    upto = F.col("first") - 1 + F.when(F.col("main"), 0).otherwise(F.col("rest"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), upto))).select("star", "chunk", "node", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))


def _by_tile(rows: DataFrame, handle: Callable[[tuple, list], list], schema: str) -> DataFrame:
    """``handle(key, rows of a tile)`` for every tile (star, lo, hi); a tile is bounded by two chunks."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None
        for batch in batches:
            out: list = []
            for row in zip(*(_values(c) for c in batch.columns), strict=True):
                if row[:3] != key:
                    if len(held) > 1:
                        out += handle(key, held)
                    held, key = [], row[:3]
                held.append(row[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
        if len(held) > 1 and (out := handle(key, held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return rows.repartition("star", "lo", "hi").sortWithinPartitions("star", "lo", "hi", "node").mapInArrow(run, schema)


def _values(column: pa.Array) -> list:
    """Python values; sets of elements as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _likely(key: tuple, side: np.ndarray, sizes: np.ndarray, levels: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of a tile that sizes and the likelihood estimate leave possible, with the estimate.

    In a tile of two chunks only pairs across them; pairs within a chunk have a tile of their own.
    """
    margin = _margin(threshold)
    found = []
    for i in range(len(sizes) - 1):
        others = np.arange(i + 1, len(sizes))
        if key[1] != key[2]:
            others = others[side[others] != side[i]]
        lo, hi = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * lo >= threshold * hi]
        if not len(others):
            continue
        others = others[(levels[others] == levels[i]).sum(1) >= (margin - 0.08) * M]
        if not len(others):
            continue
        plus, minus = (levels[i] > levels[others]).sum(1), (levels[i] < levels[others]).sum(1)
        e = joint_estimate(plus, minus, M, np.full(len(others), float(sizes[i])), sizes[others].astype(float))
        ok = e >= margin
        found.append((np.full(ok.sum(), i), others[ok], e[ok]))
    if not found:
        return (np.zeros(0, int),) * 2 + (np.zeros(0),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _screen(threshold: int) -> Callable[[tuple, list], list]:
    """Nodes of a tile that may link with another of it, as (star, node)."""

    def handle(key: tuple, rows: list) -> list:
        i, j, _ = _likely(key, np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), _levels([r[3] for r in rows]), threshold)
        return [(key[0], rows[at][1]) for at in np.unique(np.concatenate([i, j])).tolist()]

    return handle


def _verify(threshold: int) -> Callable[[tuple, list], list]:
    """(a, b): each node of a tile that full sets link to others of it, and the smallest of those."""

    def handle(key: tuple, rows: list) -> list:
        sizes = np.array([r[2] for r in rows])
        i_, j_, e = _likely(key, np.array([r[0] for r in rows]), sizes, _levels([r[3] for r in rows]), threshold)
        held: dict[int, int] = {}
        parent = [held.setdefault(r[5], i) for i, r in enumerate(rows)]  # what earlier links connect is connected

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in np.argsort(-e, kind="stable").tolist():
            i, j = int(i_[at]), int(j_[at])
            if (a := root(i)) == (b := root(j)):
                continue
            common = len(np.intersect1d(rows[i][4], rows[j][4], assume_unique=True))
            if 100 * common >= threshold * (sizes[i] + sizes[j] - common):
                parent[max(a, b)] = min(a, b)
        return [(rows[i][1], rows[r][1]) for i in range(len(rows)) if (r := root(i)) != i and (rows[i][5] != rows[r][5])]

    return handle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Alternating large-star and small-star steps until nothing is left to do, each written to
    the shared folder; the driver sees only whether a step was the last.  The least neighbour
    of each node is written before edges meet it, so that Spark can split a hub's edges.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if e.isEmpty():
        return e.selectExpr("u as node", "v as root")
    done = False
    while not done:
        both = e.select("u", "v").unionAll(e.selectExpr("v as u", "u as v"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct(), "large")
        own = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(own, "u").selectExpr("v as u", "m as v").where("u <> v").unionAll(own.selectExpr("u", "m as v")).distinct()
        after = materialize(small, "edges")
        # every node points at one smallest node that points nowhere: done
        again = after.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").select("u").unionAll(after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").selectExpr("v as u"))
        done = again.isEmpty()
        discard(e, least, large, own)
        e = after
    return e.selectExpr("u as node", "v as root").unionAll(e.selectExpr("v as node", "v as root").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    ``threshold`` is in hundredths: documents link when 100 * common >= threshold * union.
    """
    spark = docs.sparkSession
    made = materialize(_sketched(docs, k), "sketched")
    nodes = made.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, then only read
    sketches = nodes.select("node", "n", "sketch")
    buckets = _bands(nodes, rows)
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("star"), F.count("*").alias("c")).where("c > 1").select("bucket", "star")
    stars = materialize(buckets.join(heads, "bucket").select("star", "node").distinct(), "stars")
    release(spark)
    centres = sketches.select(F.col("node").alias("star"), F.col("n").alias("n_star"), F.col("sketch").alias("sketch_star"))
    near = materialize(_near_centre(stars.join(sketches, "node").join(centres, "star"), threshold), "near")
    release(spark)
    tiles = _placed(near).join(sketches, "node").select("star", "lo", "hi", "chunk", "node", "n", "sketch")
    straight = near.where("main and star <> node")
    found = _by_tile(tiles, _screen(threshold), "star long, node long").unionAll(straight.select("star", "node")).unionAll(straight.select("star", F.col("star").alias("node")))
    likely = materialize(found.distinct(), "likely")
    release(spark)
    wanted = nodes.join(likely.select("node").distinct(), "node", "left_semi").select("name", "node", "id")
    texts = docs.select("doc_id", "text").join(wanted.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    elements = _elements(texts, k).join(wanted.select("name", "node"), "name").groupBy("node").agg(F.first("elements").alias("elements"))
    sets = materialize(elements.join(sketches, "node"), "elements")
    release(spark)
    both = straight.select("star", "node").join(sets.select("node", "n", "elements"), "node").join(sets.select(F.col("node").alias("star"), F.col("n").alias("n_star"), F.col("elements").alias("elements_star")), "star")
    common = F.size(F.array_intersect("elements", "elements_star"))
    straight = materialize(both.withColumn("common", common).where(100 * F.col("common") >= threshold * (F.col("n") + F.col("n_star") - F.col("common"))).select(F.col("node").alias("a"), F.col("star").alias("b")), "links")
    release(spark)
    labels = components(straight)
    members = likely.join(labels.withColumnRenamed("root", "label"), "node", "left").join(labels.select(F.col("node").alias("star"), F.col("root").alias("label_star")), "star", "left")
    members = members.select("star", "node", F.coalesce("label", "node").alias("label"), (F.coalesce("label", "node") == F.coalesce("label_star", "star")).alias("main"))
    members = materialize(members, "members")
    tiles = _placed(members).join(sets, "node").join(labels.withColumnRenamed("root", "label"), "node", "left").select("star", "lo", "hi", "chunk", "node", "n", "sketch", "elements", F.coalesce("label", "node").alias("label"))
    more = materialize(_by_tile(tiles, _verify(threshold), "a long, b long"), "links")
    found = components(straight.unionAll(more).unionAll(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    discard(stars, near, likely, sets, straight, labels, members, more)
    release(spark)
    named = found.join(nodes.select("node", "id"), "node")
    roots = named.groupBy("root").agg(F.min("id").alias("component_id"))
    member = named.join(roots, "root").select("node", "component_id")
    ids = nodes.select("name", "node", "id").join(member, "node", "left").select("name", F.coalesce("component_id", "id").alias("component_id"))
    out = made.select("doc_id", "n", "name").join(ids, "name", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document, distinct 3-word shingles, similarity 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, threshold=85)
