"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewright.session import cut, release

__all__ = ["cut", "extended", "held_out", "labelled_sample", "per_row", "release", "rows_of", "salted_join", "slices", "sweep", "table", "utf8", "whole_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose labels are never learnt from; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of labelled rows that are not held out: at most bound / 2 of either label, chosen by a hash of doc_id over all labels.

    The ids are found first, without texts, so texts of other rows never move. Labels other
    than 0 and 1 and rows without a text take no part; of several labels for one id the largest counts.
    """
    mine = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    mine = mine.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    first, second = (mine.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(bound // 2) for y in (0, 1))
    chosen = first.unionByName(second)
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "id")  # at most `bound` rows of two numbers


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The values as bytes, NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of neighbouring items that add up to about `most`."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def per_row(df: DataFrame, column: str, function, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """The columns of df other than `column`, and those that function(list of bytes) makes of it, batch by batch."""
    kept = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = function()
        for batch in batches:
            made = work(utf8(batch.column(column)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(made[n], t) for n, t in fields.items()], names=[*kept, *fields])

    return df.mapInArrow(run, extended(df, kept, schema))


def extended(df: DataFrame, kept: list[str], schema: str) -> StructType:
    """The schema of the kept columns and the new ones; as an object, since names inside a type can't be quoted in text."""
    return StructType([df.schema[c] for c in kept] + StructType.fromDDL(schema).fields)


def whole_row(docs: DataFrame, but: tuple[str, ...] = (), name: str = "whole") -> tuple[Column, dict[str, Column]]:
    """A struct `name` of a row's columns, and what gives each of them back; whatever they are called, none clashes with what stands beside it."""
    names = [c for c in docs.columns if c not in but]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(names))).alias(name), {c: F.col(f"{name}.c{i}").alias(c) for i, c in enumerate(names)}


def rows_of(array: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), width)


SALTS = 64


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are written: its cleaner works on what the driver's JVM has collected.

    Memory that the driver's Python has freed goes back to the system too, where the C library can do that.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    spark.sparkContext._jvm.System.gc()


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], many: str, total: int, spread: Column) -> DataFrame:
    """rows left-joined with a table that has each key once and, in column `many`, how many rows have it.

    Keys of more than a thousandth of the rows are hot. There are at most a thousand of them, so their list is broadcast; their rows are
    spread by `spread` over SALTS copies of the table's row. Every other key fits a partition.
    """
    is_hot = F.col(many) * 1000 > total
    hot = unique.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_hot, SALTS - 1).otherwise(0).cast("long"))))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot").join(copies.drop(many), [*keys, "_salt"], "left").drop("_salt")
