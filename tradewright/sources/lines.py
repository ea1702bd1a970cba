"""Raw JSON lines with their place in the files, and decoding under an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`value` and `file_pos`: file, split offset and row number in the split, so file order is explicit."""
    return (
        spark.read.text(path).filter(F.length(F.trim("value")) > 0)
        .select("value", F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")).alias("file_pos"))
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one JSON value each (API pages, listings)."""
    return spark.read.text(path, wholetext=True).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"),
                          F.lit(0).cast("long").alias("row")).alias("file_pos"))


def parse(lines: DataFrame, schema: str | StructType, out: str = "r") -> DataFrame:
    """Parses `value`; malformed lines are dropped."""
    parsed = lines.withColumn(out, F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.filter(F.get_json_object("value", "$").isNotNull() & F.col(out).isNotNull()).drop("value")


def text_or_null(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(col), F.lit(""))


def rows_of(pages: DataFrame, array: str, carry: list[str] | None = None) -> DataFrame:
    """One row per element of a page's array as `p`, placed by page then element."""
    return pages.select(*(carry or []), "file_pos", F.posexplode(array).alias("_i", "p")).withColumn(
        "file_pos", F.struct("file_pos", F.col("_i").alias("i"))).drop("_i")
