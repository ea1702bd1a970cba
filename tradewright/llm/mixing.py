"""Mixing sources to target weights with DataFrame functions only.

Every source is a stream of its documents in a pseudo-random order, pass after pass. The stream is cut at the source's target,
counted in words, and divided into blocks of equal words. A splitting tree deals the blocks out: at each node a random half
of the blocks goes left, whatever their sources, so the counts per source follow the multivariate hypergeometric
distribution and sum exactly to the quotas. Each leaf is an output shard; its rows are ordered by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.llm.common import whole_row

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """One row per source (column skey): its words, its weight by position, and its target.

    A target above cap * words stops there and the excess is shared out again by weight. In order of cap * words / weight the
    sources that stop come first, so the final level is that of the first source that does not stop. The two ordered
    windows hold one row per source, not per document.
    """
    per = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (F.lit(float(share)) * everything - before) / still)
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))
    final = F.coalesce(F.min(free).over(Window.partitionBy()).getField("level"), F.lit(float("inf")))
    return per.select("skey", "source_size", F.least("most", final * F.col("weight")).alias("target"))


def deal_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(skey, block, shard) for the blocks 0 .. quota - 1 of each source, by the splitting tree; `shards` is a power of two."""
    units = quotas.select("skey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("block")).withColumn("shard", F.lit(0))
    for level in range(int(math.log2(shards))):
        draw = F.md5(F.concat_ws("|", F.lit(f"{seed}-{level}"), "skey", F.col("block").cast("string")))
        node = Window.partitionBy("shard")
        right = F.row_number().over(node.orderBy(draw, "skey", "block")) > F.floor(F.count(F.lit(1)).over(node) / 2)
        units = units.select("skey", "block", (F.col("shard") * 2 + right.cast("int")).alias("shard"))
    return units


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: int = 2, shards: int = 16, blocks: int = 4096,
        seed: int = 10, keep: str | None = None) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, text, source).

    doc_id, size (words), source_size, target (words of its source to take), copies, taken = size * copies, and for each pass
    the shard that gets this copy (shard_1 ..; NULL: not taken). keep names a column of docs to carry along.

    The number of blocks is about `blocks` for all sources together (each source rounds up), so the tree's tables are bounded by
    blocks + sources. The running word counts come from (source, hash bucket) totals and a window inside each bucket:
    a hot source is spread over 4096 buckets. A copy is taken if its middle word lies before the target, so a source ends
    within half a document of it. NULL text and texts without words have size 0 and are carried once. NULL is a source of its
    own, last. Repeated rows are mixed as rows of their own; ties of the hash go by doc_id, size and text, so reruns agree.
    Other columns are ignored, and an empty table gives no row.
    """
    text = F.col("text")
    sized = docs.select(
        "doc_id", "source", words(text).alias("size"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("draw"),
        F.xxhash64(text).alias("tie"), *([F.col(keep).alias("kept")] if keep else []))
    sized = sized.withColumn("bucket", F.substring("draw", 1, 3))
    totals = sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(totals, list(weights), share, cap)
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("skey", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start")).join(targets, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("draw", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["skey", "bucket"])
    placed = placed.withColumn("before", F.col("start") + F.col("run"))
    block_words = F.greatest(F.sum("target").over(Window.partitionBy()) / blocks, F.lit(1.0))
    quotas = targets.withColumn("block_words", block_words).where("target > 0")
    quotas = quotas.select("skey", "block_words", (F.floor(F.col("target") / F.col("block_words")) + 1).alias("quota"))
    dealt = deal_blocks(quotas, shards, seed).join(quotas.select("skey", "block_words"), "skey")
    unit = quotas.agg(F.max("block_words").alias("block_words"))
    placed = placed.join(F.broadcast(unit))  # one row
    copies = F.lit(0)
    for k in range(cap):
        at = F.col("before") + k * F.col("source_size")
        takes = F.when(F.col("size") > 0, at + F.col("size") / 2 <= F.col("target")).otherwise(F.lit(k == 0))
        copies = copies + takes.cast("int")
        block = F.when(takes, F.floor(F.least(at, F.col("target")) / F.coalesce(F.col("block_words"), F.lit(1.0))))
        one = dealt.select(F.col("skey"), F.col("block").alias(f"block_{k + 1}"), F.col("shard").alias(f"shard_{k + 1}"))
        placed = placed.withColumn(f"block_{k + 1}", block).join(one, ["skey", f"block_{k + 1}"], "left")
        placed = placed.withColumn(f"shard_{k + 1}", F.when(takes, F.coalesce(f"shard_{k + 1}", F.lit(0))))
    placed = placed.withColumn("copies", copies)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
                         *(f"shard_{k + 1}" for k in range(cap)), *(["kept"] if keep else []))


def mixture(docs: DataFrame, seed: int = 10, cap: int = 2, **options) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with all their columns, dealt to shards and shuffled in each."""
    whole, columns = whole_row(docs, name="kept")
    packed = docs.select("doc_id", "text", "source", whole.alias("whole"))
    plan = mix(packed, seed=seed, cap=cap, keep="whole", **options)
    taken = plan.select("kept", F.explode(F.array(*(F.struct(F.col(f"shard_{k + 1}").alias("shard"), F.lit(k).alias("pass")) for k in range(cap)))).alias("copy"))
    taken = taken.where("copy.shard is not null")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("copy.pass").cast("string"), columns["doc_id"].cast("string")))
    return taken.select("kept", "copy.shard", order.alias("place")).repartition("shard").sortWithinPartitions("shard", "place").select(*columns.values())
