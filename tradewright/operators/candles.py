"""Price context from candles: features, as-of joins and interval extremes, without range-join nested loops.

Candles are keyed (symbol, open_ms) on a fixed step. Their number is bounded by time, not by the trades, so
windows per symbol are safe; trades meet them only through equi-joins on a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.config import HOUR_MS


def clean_candles(df: DataFrame, end_ms: int | None = None, position: str = "file_pos") -> DataFrame:
    """First row per (symbol, open_ms) in file order, nothing at or after `end_ms`."""
    from tradewright.operators.quality import first_wins

    kept = df if end_ms is None else df.filter(F.col("open_ms") < end_ms)
    return first_wins(kept, ["symbol", "open_ms"], position)


def _rows(before: int, after: int):
    return Window.partitionBy("symbol").orderBy("open_ms").rowsBetween(before, after)


def with_features(candles: DataFrame) -> DataFrame:
    """Adds candle number, momentum, the three MA200 conventions, range position and realised volatility.

    ma_incl: 200 closes ending here; ma_ctx: 201 closes ending here; ma_prior: the 200 closes before this one.
    """
    w = Window.partitionBy("symbol").orderBy("open_ms")
    c = F.col("close")
    hi, lo = F.max("high").over(_rows(-168, 0)), F.min("low").over(_rows(-168, 0))
    df = candles.withColumn("i", F.row_number().over(w) - 1).withColumn("_ret", c / F.lag("close").over(w) - 1)
    full = F.col("i") >= 200
    return df.select(
        "*",
        *[(c / F.lag("close", k).over(w) - 1).alias(f"r{k}") for k in (4, 24, 72)],
        F.when(F.col("i") >= 199, F.avg("close").over(_rows(-199, 0))).alias("ma_incl"),
        F.when(full, F.avg("close").over(_rows(-200, 0))).alias("ma_ctx"),
        F.when(full, F.avg("close").over(_rows(-200, -1))).alias("ma_prior"),
        F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(F.lit(0.5)).alias("range_pos"),
        (F.stddev_pop("_ret").over(_rows(-72, 0)) * F.sqrt(F.lit(24.0))).alias("vol"),
    ).drop("_ret")


def dense_grid(candles: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """One row per step from a symbol's first to last candle; `src` is the last candle at or before the step."""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    spans = candles.select("symbol", "open_ms", F.lead("open_ms").over(w).alias("_next"))
    until = F.greatest(F.col("open_ms"), F.coalesce(F.col("_next") - step_ms, F.col("open_ms")))
    return spans.select("symbol", F.col("open_ms").alias("src"),
                        F.explode(F.sequence("open_ms", until, F.lit(step_ms).cast("long"))).alias("slot_ms"))


def as_of(trades: DataFrame, candles: DataFrame, columns: list[str], at: str = "opened_ms",
          step_ms: int = HOUR_MS) -> DataFrame:
    """Joins each trade to the last candle with open_ms <= `at`; trades before the first candle get NULLs.

    The time is floored to the step and clamped to the last candle, then equi-joined on the gap-filled grid.
    """
    ends = candles.groupBy("symbol").agg(F.max("open_ms").alias("_last"))
    filled = dense_grid(candles, step_ms).join(
        candles.select("symbol", F.col("open_ms").alias("src"), *columns), ["symbol", "src"])
    floored = F.floor(F.col(at) / step_ms) * step_ms
    return (
        trades.join(ends, "symbol", "left")
        .withColumn("slot_ms", F.least(floored, F.col("_last")).cast("long"))
        .join(filled, ["symbol", "slot_ms"], "left").drop("slot_ms", "_last")
        .withColumnRenamed("src", "candle_ms")
    )


def range_table(candles: DataFrame, levels: int, step_ms: int = HOUR_MS) -> DataFrame:
    """Extremes over 2**k steps starting at each step, for k = 0 .. levels-1 (missing steps add nothing)."""
    dense = dense_grid(candles, step_ms).join(
        candles.select("symbol", F.col("open_ms").alias("slot_ms"), "high", "low"), ["symbol", "slot_ms"], "left")
    ahead = Window.partitionBy("symbol").orderBy("slot_ms")
    df = dense.select("symbol", (F.col("slot_ms") / step_ms).cast("long").alias("slot"), "slot_ms",
                      F.col("high").alias("h0"), F.col("low").alias("l0"))
    for k in range(1, levels):
        half = 2 ** (k - 1)
        df = df.select("*", F.greatest(f"h{k - 1}", F.lead(f"h{k - 1}", half).over(ahead)).alias(f"h{k}"),
                       F.least(f"l{k - 1}", F.lead(f"l{k - 1}", half).over(ahead)).alias(f"l{k}"))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h"), F.col(f"l{k}").alias("l"))
                      for k in range(levels)])
    return df.select("symbol", "slot", F.explode(pairs).alias("_x")).select("symbol", "slot", "_x.k", "_x.h", "_x.l")


def interval_extremes(trades: DataFrame, candles: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """Adds `hi` and `lo`: highest high and lowest low of the candles with opened_ms <= open_ms <= closed_ms.

    Any interval is covered by two overlapping power-of-two ranges, so every trade joins exactly twice,
    however long it was open. The longest history of a symbol tells how many powers are needed.
    """
    span = candles.groupBy("symbol").agg(
        (F.min("open_ms") / step_ms).cast("long").alias("_min"), (F.max("open_ms") / step_ms).cast("long").alias("_max"))
    longest = span.agg(F.max(F.col("_max") - F.col("_min") + 1)).first()[0] or 1
    table = range_table(candles, longest.bit_length(), step_ms)
    first = F.greatest(F.ceil(F.col("opened_ms") / step_ms), F.col("_min"))
    last = F.least(F.floor(F.col("closed_ms") / step_ms), F.col("_max"))
    bounded = (
        trades.join(span, "symbol", "left").withColumn("_i", first).withColumn("_j", last)
        .withColumn("_k", F.when(F.col("_j") >= F.col("_i"), F.length(F.bin(F.col("_j") - F.col("_i") + 1)) - 1))
        .withColumn("_j", F.col("_j") - F.pow(F.lit(2.0), F.col("_k")).cast("long") + 1)
    )
    left = table.select("symbol", F.col("slot").alias("_i"), F.col("k").alias("_k"), F.col("h").alias("_h1"), F.col("l").alias("_l1"))
    right = table.select("symbol", F.col("slot").alias("_j"), F.col("k").alias("_k"), F.col("h").alias("_h2"), F.col("l").alias("_l2"))
    return (
        bounded.join(left, ["symbol", "_k", "_i"], "left").join(right, ["symbol", "_k", "_j"], "left")
        .withColumn("hi", F.greatest("_h1", "_h2")).withColumn("lo", F.least("_l1", "_l2"))
        .drop("_i", "_j", "_k", "_min", "_max", "_h1", "_l1", "_h2", "_l2")
    )


def excursions(trades: DataFrame, candles: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """Worst (`mae`) and best (`mfe`) excursion of every trade with at least one candle in its life."""
    long = F.lower("side") == "long"
    up, down = F.col("hi") / F.col("avg_cost") - 1, F.col("lo") / F.col("avg_cost") - 1
    fall, rise = 1 - F.col("hi") / F.col("avg_cost"), 1 - F.col("lo") / F.col("avg_cost")
    return (
        interval_extremes(trades.filter(F.col("avg_cost") > 0), candles, step_ms)
        .filter(F.col("hi").isNotNull())
        .withColumn("mae", F.when(long, down).otherwise(fall)).withColumn("mfe", F.when(long, up).otherwise(rise))
        .drop("hi", "lo")
    )


def regime(ma: str = "ma_incl") -> Column:
    """+1 above the moving average, -1 below; NULL without history."""
    return F.when(F.col(ma).isNotNull(), F.when(F.col("close") > F.col(ma), 1).otherwise(-1))
