"""Approximate nearest neighbours by inner product: inverted lists scanned with early abandonment.

Vectors get one more component that gives all the same length, so the largest inner product is the smallest distance, and are rotated at
random. In each probed list, distances grow block of columns by block of columns; after d of D columns a pair is abandoned when its
partial distance, scaled by D / d, is larger than the query's k-th best distance by more than a random rotation explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewright.llm.common import cut, rows_of
from tradewright.llm.topk import best_of, by_width, query_blocks

PAIRS = 1 << 17  # pairs gathered at once
STRIP = 1 << 20  # distances held at once


def real_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles.

    NULL ids and vectors, zero vectors, and vectors with a NULL or non-finite component take no part; rows with the same vec_id stand
    for one vector, the smallest.
    """
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    one = embeddings.where(ok & ~bad & ~zero).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("e"))
    return one.select("vec_id", F.col("e").cast("array<double>").alias("v"))


@dataclass
class Model:
    """What is learnt from the bounded sample: the rotation and the centroids; `length` is the largest norm of all vectors."""

    width: int
    length: float
    rotation: np.ndarray
    centroids: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_lists: np.ndarray

    def rotated(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.length**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, extra[:, None]]) @ self.rotation

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        """Squared, to the centroids."""
        return (rotated * rotated).sum(axis=1)[:, None] - 2 * rotated @ self.centroids.T + (self.centroids**2).sum(axis=1)


def fit(vectors: DataFrame, width: int, lists: int, sample: int, seed: int) -> Model:
    """k-means over at most `sample` vectors chosen by a hash of the id."""
    mine = vectors.where(F.size("v") == width)
    length = mine.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    rows = mine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x, rng = rows_of(rows.column("v").combine_chunks(), width), np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((width + 1, width + 1)))[0]
    model = Model(width, length, rotation, np.zeros((0, 0)), rows.column("vec_id").to_numpy(), x, np.zeros(0, int))
    points = model.rotated(x, False)
    model.centroids = points[rng.permutation(len(points))[:lists]].copy()
    for _ in range(8):
        near = model.distances(points).argmin(axis=1)
        for c in range(len(model.centroids)):
            if (near == c).any():
                model.centroids[c] = points[near == c].mean(axis=0)
    model.sample_lists = model.distances(points).argmin(axis=1)
    return model


def index(vectors: DataFrame, models, lists: int, rows_per_task: int) -> tuple[DataFrame, dict]:
    """The vectors with their list, laid out so that a task reads few lists, and the lists' sizes. A large list is split over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            for width, at in by_width(v):
                model = Model(**models.value[width])
                near = model.distances(model.rotated(rows_of(v.take(pa.array(at)), width), False)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), v.take(pa.array(at)), pa.array(near, pa.int32()), pa.array(np.full(len(at), width), pa.int32())], names=["vec_id", "v", "list", "width"])

    assigned = cut(vectors.mapInArrow(run, "vec_id long, v array<double>, list int, width int"))
    sizes = {(r["width"], r["list"]): r["count"] for r in assigned.groupBy("width", "list").count().collect()}  # lists per width at most
    total = sum(sizes.values())
    tasks = max(1, round(total / rows_per_task))
    laid = assigned.repartitionByRange(max(tasks, 16), "width", "list", F.xxhash64("vec_id")).sortWithinPartitions("width", "list")
    return cut(laid), sizes


@dataclass
class Block:
    """Queries of one width as a broadcast holds them."""

    ids: np.ndarray
    original: np.ndarray
    rotated: np.ndarray
    probes: np.ndarray
    bound: np.ndarray  # squared distance of the k-th best known so far


def prepare(rows: pa.Table, models: dict, sizes: dict, k: int, probes: int) -> dict[int, Block]:
    """Which lists each query probes, and a first bound on the distance of its k-th best.

    The bound is the distance of the 2k-th best among the sample's rows in the probed lists. All 2k are candidates, so even if tests
    wrongly abandon some of them, k remain.
    """
    blocks, v = {}, rows.column("v").combine_chunks()
    for width, at in by_width(v):
        model = models[width]
        ids, x = rows.column("vec_id").to_numpy()[at], rows_of(v.take(pa.array(at)), width)
        q = model.rotated(x, True)
        order = model.distances(q).argsort(axis=1)
        size = np.array([sizes.get((width, c), 0) for c in range(len(model.centroids))])
        before = np.cumsum(size[order], axis=1) - size[order]
        wanted = (np.arange(len(size))[None, :] < probes) | (before < k + 1)
        probe = np.zeros_like(wanted)
        np.put_along_axis(probe, order, wanted, axis=1)
        bound = np.full(len(ids), np.inf)
        if len(model.sample_ids) > 2 * k:
            for i in range(0, len(ids), 256):
                scores = x[i:i + 256] @ model.sample.T
                scores[(ids[i:i + 256, None] == model.sample_ids[None, :]) | ~probe[i:i + 256][:, model.sample_lists]] = -np.inf
                bound[i:i + 256] = -np.partition(-scores, 2 * k - 1, axis=1)[:, 2 * k - 1]
            bound = (x * x).sum(axis=1) + model.length**2 - 2 * bound
        blocks[width] = Block(ids, x, q, probe, bound * (1 + 1e-9) + 1e-12)
    return blocks


def survivors(block: Block, mine: np.ndarray, bound: np.ndarray, points: np.ndarray, columns: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in mine, row of points) that no test abandons."""
    wide = points.shape[1]
    queries, limit = block.rotated[mine], bound[mine]

    def passes(partial, seen, lim):
        if seen == wide:
            return partial <= lim
        return partial * (wide / seen) <= lim * (1 + epsilon / np.sqrt(seen)) ** 2

    d = min(columns, wide)
    a, b = queries[:, :d], points[:, :d]
    first = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)
    i, j = np.nonzero(passes(first, d, limit[:, None]))
    partial = first[i, j]
    while d < wide:
        to = min(d + columns, wide)
        for at in range(0, len(i), PAIRS):
            part = queries[i[at:at + PAIRS], d:to] - points[j[at:at + PAIRS], d:to]
            partial[at:at + PAIRS] += np.einsum("ij,ij->i", part, part)
        d = to
        keep = passes(partial, d, limit[i])
        i, j, partial = i[keep], j[keep], partial[keep]
    return i, j


def scan(indexed: DataFrame, shared, models, k: int, columns: int, epsilon: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {w: Block(**b) for w, b in shared.value.items()}
        fitted = {w: Model(**m) for w, m in models.value.items()}
        bounds = {w: b.bound.copy() for w, b in blocks.items()}
        best = {w: [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] for w in blocks}
        for batch in batches:
            lists, v, all_ids = batch.column("list").to_numpy(), batch.column("v"), batch.column("vec_id").to_numpy()
            for width, at in by_width(v):
                if width not in blocks:
                    continue
                block, bound = blocks[width], bounds[width]
                x, ids = rows_of(v.take(pa.array(at)), width), all_ids[at]
                points = fitted[width].rotated(x, False)
                for one in np.unique(lists[at]):
                    rows, mine_all = np.flatnonzero(lists[at] == one), np.flatnonzero(block.probes[:, one])
                    step = max(1, STRIP // max(1, len(rows)))
                    for s in range(0, len(mine_all), step):
                        mine = mine_all[s:s + step]
                        i, j = survivors(block, mine, bound, points[rows], columns, epsilon)
                        q, c = mine[i], rows[j]
                        own = block.ids[q] != ids[c]
                        q, c = q[own], c[own]
                        score = np.concatenate([(block.original[q[p:p + PAIRS]] * x[c[p:p + PAIRS]]).sum(axis=1) for p in range(0, len(q), PAIRS)] or [np.zeros(0)])
                        Q, C, S = (np.concatenate(z) for z in zip(best[width], (q, ids[c], score)))
                        top = best_of(Q, C, S, k)
                        best[width] = [Q[top], C[top], S[top]]
                    Q, _, S = best[width]
                    last = np.flatnonzero(np.bincount(Q, minlength=len(block.ids)) >= k)
                    worst = S[np.searchsorted(Q, last, side="right") - 1]
                    norm = (block.original[last] ** 2).sum(axis=1) + fitted[width].length ** 2
                    bound[last] = np.minimum(bound[last], (norm - 2 * worst) * (1 + 1e-9) + 1e-12)
        for width, (q, c, s) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(blocks[width].ids[q]), pa.array(c), pa.array(s)], names=["query_id", "vec_id", "score"])

    return indexed.mapInArrow(run, "query_id long, vec_id long, score double")


def search(embeddings: DataFrame, k: int = 20, every: int = 20, lists: int = 64, probes: int = 48, sample: int = 4096,
           columns: int = 16, epsilon: float = 2.1, block: int = 4096, rows_per_task: int = 16384, seed: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, nearest first, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows but the query's own; vectors of another length are no
    candidates. The centroids come from at most `sample` vectors, every vector is indexed. A query probes the `probes` nearest lists, and more
    until they hold k candidates, so small tables are searched whole. Scores are inner products of the original vectors in
    double precision. Query blocks of about `block` rows are broadcast one after the other. See real_vectors for which rows
    take part; an empty table gives no row.
    """
    spark = embeddings.sparkSession
    vectors = cut(real_vectors(embeddings))
    widths = [r[0] for r in vectors.select(F.size("v")).distinct().collect()]  # lengths of vectors: a handful
    models = {w: fit(vectors, w, lists, sample, seed) for w in widths}
    shared_models = spark.sparkContext.broadcast({w: vars(m) for w, m in models.items()})
    found = None
    if widths:
        indexed, sizes = index(vectors, shared_models, lists, rows_per_task)
        for rows in query_blocks(vectors, every, block):
            shared = spark.sparkContext.broadcast({w: vars(b) for w, b in prepare(rows, models, sizes, k, probes).items()})
            hits = scan(indexed, shared, shared_models, k, columns, epsilon)
            part = cut(hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k))
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return found.select("query_id", "rank", "vec_id", "score")
