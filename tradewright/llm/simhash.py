"""SimHash near-duplicates: fingerprints, exact comparison in tiles, and the components of the links.

Distinct fingerprints are sorted into cells by the population counts of their two halves and cut into tiles. Two fingerprints that differ in
at most `radius` bits have counts that differ by at most that, so other tile pairs are skipped; the rest are compared whole with
numpy's exclusive-or and bit count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewright.llm.common import cut, extended, release, salted_join, utf8, whole_row

STRIP = 1 << 20  # pairs compared at once


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The majority of the bits of the XXH64 hashes of the word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        votes += np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """docs, but for the text, with its fingerprint fp as a signed long."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fp)], names=[*kept, "fp"])

    return docs.mapInArrow(run, extended(docs, kept, "fp long"))


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the links between (and, if a is b, within) two tiles: values and the least value they reach."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = back[:len(a)], back[len(a):]
    root = np.arange(len(nodes))
    step = max(1, STRIP // len(b))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= radius)
        i, j = ia[at + i], ib[j]
        different = i != j
        i, j = i[different], j[different]
        while len(i):
            i, j = root[i], root[j]
            open_ = i != j
            i, j = i[open_], j[open_]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root[root] != root).any():
                root = root[root]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def links(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """(a, b) values within `radius` bits, as many as keep everything connected that is; prints has each fp once."""
    pop = lambda x: F.bit_count(x).cast("int")
    cell = prints.select("fp", pop(F.shiftrightunsigned("fp", 32)).alias("hi"), pop(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"))
    counts = {(r["hi"], r["lo"]): r["count"] for r in cell.groupBy("hi", "lo").count().collect()}  # at most 33 * 33 cells
    tiles = np.ones((33, 33), int)
    for (hi, lo), n in counts.items():
        tiles[hi, lo] = -(-n // tile)
    many = F.array(*(F.lit(int(x)) for x in tiles.ravel()))
    at = lambda hi, lo: F.get(many, hi * 33 + lo)
    packed = cut(cell.withColumn("tile", F.pmod(F.xxhash64("fp"), at(F.col("hi"), F.col("lo")).cast("long")).cast("int")).groupBy("hi", "lo", "tile").agg(F.collect_list("fp").alias("a")))
    steps = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]
    near = F.explode(F.array(*(F.struct((F.col("hi") + x).alias("hi"), (F.col("lo") + y).alias("lo")) for x, y in steps)))
    pairs = packed.select("hi", "lo", "tile", "a", near.alias("to")).where("to.hi <= 32 and to.lo between 0 and 32")
    same = (F.col("to.hi") == F.col("hi")) & (F.col("to.lo") == F.col("lo"))
    pairs = pairs.withColumn("to_tile", F.explode(F.sequence(F.when(same, F.col("tile")).otherwise(0), at(F.col("to.hi"), F.col("to.lo")) - 1)))
    others = packed.select(F.col("hi").alias("to_hi"), F.col("lo").alias("to_lo"), F.col("tile").alias("to_tile"), F.col("a").alias("b"))
    pairs = pairs.select("a", F.col("to.hi").alias("to_hi"), F.col("to.lo").alias("to_lo"), "to_tile").join(others, ["to_hi", "to_lo", "to_tile"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = linked(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, F.xxhash64(F.get("a", F.lit(0)), F.get("b", F.lit(0)))).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes that have an edge, by contraction.

    In each round every node joins its neighbour of least rank, itself included; ranks are hashes that change with the round, so chains
    shrink by a share whatever their order. Each round's tables are written, so lost executors only re-read them.
    """
    edges = cut(edges.where("a <> b").distinct())
    mapping = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: E731, B023
        best = F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("to")))
        hook = both.groupBy("a").agg(best.alias("best")).select(F.col("a").alias("node"), F.least(F.struct(rank("a").alias("rank"), F.col("a").alias("to")), "best")["to"].alias("root"))
        hook = cut(hook)
        if mapping is None:
            fresh = hook
        else:
            fresh = cut(mapping.join(hook.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            release(mapping)
        a, b = (hook.select(F.col("node").alias(c), F.col("root").alias(f"new_{c}")) for c in "ab")
        smaller = edges.join(a, "a").join(b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).where("a <> b")
        smaller = cut(smaller.distinct())
        release(edges)
        mapping, edges, turn = fresh, smaller, turn + 1
    return mapping if mapping is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(rows: DataFrame, radius: int = 3, tile: int = 8192) -> DataFrame:
    """rows (doc_id, fp and others) with `root`, the same for all rows of a component, and component_id, its smallest doc_id."""
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many")))
    roots = components(links(prints.select("fp"), radius, tile)).select(F.col("node").alias("fp"), "root")
    rooted = cut(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    grouped = cut(rooted.join(least, "root").where("many > 1 or prints > 1").select("fp", "root", "component_id", "many"))
    total = prints.agg(F.sum("many")).first()[0] or 0
    joined = salted_join(rows, grouped, ["fp"], "many", total, F.col("doc_id"))
    alone = F.col("root").isNull()
    return joined.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))).withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    Rows are linked whose fingerprints differ in at most `radius` bits; component_id is the smallest doc_id that a row reaches, its own included.
    NULL, empty and wordless texts have fingerprint 0 and are linked like any other. Rows with the same doc_id each give a row. A row without
    doc_id gets the smallest id of its component, NULL if there is none. Other columns are ignored.
    """
    found = near_groups(cut(with_fingerprints(docs.select("doc_id", "text"))), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The row with the smallest doc_id of each component (one of them, if rows repeat), with all its columns."""
    whole, columns = whole_row(docs)
    packed = docs.select("doc_id", "text", whole)
    prints = cut(with_fingerprints(packed.select("doc_id", "text")))
    groups = near_groups(prints, radius)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("root"), F.col("fp"), F.col("doc_id"))
    first = kept.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("first")).select("first.doc_id", "first.fp")
    rows = with_fingerprints(packed)
    chosen = rows.join(first, (rows["fp"] == first["fp"]) & rows["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy("doc_id"))
    return chosen.withColumn("rank", rank).where("rank = 1").select(*columns.values())
