"""Exact top-k search by distributed histogram selection.

Scores are integer inner products. Per block of queries, every pass scores all vectors and adds up global histograms of the scores in the
interval that holds a query's k-th best; the interval shrinks to the bin that holds it until its width is one. A last pass keeps the
scores at or above that value and breaks ties by vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewright.llm.common import cut, rows_of

BINS = 256
STRIP = 1 << 20  # scores held at once in a task


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component, for the vectors that take part.

    A NULL vector or id, and a vector with a NULL or non-finite component, takes no part. Rows with the same vec_id stand for one
    vector, the smallest. Other columns are ignored.
    """
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = embeddings.where(ok & ~bad).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("e"))
    return one.select("vec_id", F.transform("e", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def by_width(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The lengths that occur, each with the positions of its rows."""
    widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for w in np.unique(widths):
        yield int(w), np.flatnonzero(widths == w)


def query_blocks(vectors: DataFrame, every: int, size: int) -> Iterator[pa.Table]:
    """The rows whose id is divisible by `every`, in blocks of about `size` by a hash of the id: a block is what a broadcast holds."""
    mine = vectors.where(F.col("vec_id") % every == 0)
    blocks = math.ceil(mine.count() / size)
    for k in range(blocks):
        yield mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).toArrow()


def bin_width(span: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-span // BINS))


class Scorer:
    """Scores of a block of queries against batches of vectors of the same width; a query's own row scores nothing."""

    def __init__(self, block: pa.Table, exact_in_double: bool):
        ids = block.column("vec_id").to_numpy()
        vectors = block.column("v").combine_chunks()
        self.kind = np.float64 if exact_in_double else np.int64
        self.sets = {}
        for width, at in by_width(vectors):
            order = at[np.argsort(ids[at])]
            self.sets[width] = (order, ids[order], rows_of(vectors.take(pa.array(order)), width).astype(self.kind))

    def strips(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query positions, vec_ids, scores, which of them count) of a strip of the batch."""
        all_ids, vectors = batch.column("vec_id").to_numpy(), batch.column("v")
        for width, at in by_width(vectors):
            if width not in self.sets:
                continue
            queries, query_ids, q = self.sets[width]
            x, ids = rows_of(vectors.take(pa.array(at)), width).astype(self.kind), all_ids[at]
            step = max(1, STRIP // len(queries))
            for i in range(0, len(ids), step):
                scores = (q @ x[i:i + step].T).astype(np.int64)
                yield queries, ids[i:i + step], scores, query_ids[:, None] != ids[None, i:i + step]


def histogram_pass(vectors: DataFrame, shared, lo, span, need) -> DataFrame:
    """(query, n_above, bin): the bin of its interval that holds a query's k-th best score.

    A task reports a query's bins from the top only until they hold what is still needed: lower ones can't hold the k-th best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, low, size, want = Scorer(*shared.value), lo.value, span.value, need.value
        wide = bin_width(size)
        counts = np.zeros((len(low), BINS), np.int64)
        for batch in batches:
            for queries, _, scores, valid in scorer.strips(batch):
                offset = scores - low[queries, None]
                valid = valid & (offset >= 0) & (offset < size[queries, None])
                bins = offset // wide[queries, None]
                flat = (np.arange(len(queries))[:, None] * BINS + bins)[valid]
                counts[queries] += np.bincount(flat, minlength=len(queries) * BINS).reshape(-1, BINS)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < want[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b]), pa.array(want[q])], names=["query", "bin", "n", "need"])

    parts = vectors.mapInArrow(run, "query int, bin int, n long, need long").groupBy("query", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    running = F.sum("n").over(Window.partitionBy("query").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("running", running).where("running >= need and running - n < need").select("query", "bin", (F.col("running") - F.col("n")).alias("n_above"))


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def final_pass(vectors: DataFrame, shared, least, ids, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, floor = Scorer(*shared.value), least.value
        held: list[list[np.ndarray]] = [[], [], []]

        def shrink() -> None:
            q, i, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in held)
            best = best_of(q, i, s, k)
            held[:] = [q[best]], [i[best]], [s[best]]

        pending = 0
        for batch in batches:
            for queries, cand, scores, valid in scorer.strips(batch):
                a, b = np.nonzero(valid & (scores >= floor[queries, None]))
                for into, x in zip(held, (queries[a], cand[b], scores[a, b])):
                    into.append(x)
                pending += len(a)
                if pending > STRIP:
                    shrink()
                    pending = 0
        shrink()
        q, i, s = (x[0] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(ids.value[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores (all, if fewer), ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but the query's own. Vectors of other lengths than
    the query's have no inner product with it. See integer_vectors for which rows take part. About `block` queries are broadcast at a time and
    each block is finished before the next, so neither a task nor the driver holds more than that. Scores must fit a long.
    """
    spark = embeddings.sparkSession
    vectors = cut(integer_vectors(embeddings))
    size = F.transform("v", lambda x: F.abs(x))
    most, width = vectors.agg(F.max(F.array_max(size)), F.max(F.size("v"))).first()
    bound = (most or 0) ** 2 * max(width or 0, 1)
    found = None
    for rows in query_blocks(vectors, every, block):
        shared = spark.sparkContext.broadcast((rows, bound < 2**53))
        ids = rows.column("vec_id").to_numpy()
        n = len(ids)
        lo, span, need = np.full(n, -bound, np.int64), np.full(n, min(2 * bound + 1, 2**63 - 1), np.int64), np.full(n, k, np.int64)
        open_ = np.ones(n, bool)
        while open_.any():
            wide = bin_width(span)
            send = [spark.sparkContext.broadcast(x) for x in (lo.copy(), span, np.where(open_, need, 0))]
            bins = histogram_pass(vectors, shared, *send).toPandas()  # at most one row per query of the block
            seen = np.zeros(n, bool)
            q = bins["query"].to_numpy()
            seen[q] = True
            lo[open_ & ~seen] = -bound  # fewer candidates than k: all are wanted
            lo[q] += bins["bin"].to_numpy() * wide[q]
            need[q] -= bins["n_above"].to_numpy()
            span = wide
            open_ &= seen & (wide > 1)
        hits = final_pass(vectors, shared, spark.sparkContext.broadcast(lo), spark.sparkContext.broadcast(ids), k)
        part = cut(hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    return found.select("query_id", "rank", "vec_id", "score")
