"""Drawdown screens over equity series and over trades.

Each screen gives one row per trader: `depth` (in the unit of its basis) and `trough_ts`, the first instant of
the deepest point. A breach is covered when the visible positions start no later than the trough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.config import DAY_MS, SCOPE, TRADER
from tradewright.operators.ordering import AUTO, _resolve, exclusive_prefix, running_max, split_by_order, split_hot

# Exchanges differ on what a trader without a series gets: passed as safe, or rejected as unproven.
PASSES_WITHOUT_SERIES = {"ratio", "level", "trades"}


def _peaked(series: DataFrame, value: Column) -> DataFrame:
    """Equity series are daily or weekly, so a trader's series is short and one window per trader is right."""
    upto = Window.partitionBy(*TRADER).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("_v", value).withColumn("_peak", F.max("_v").over(upto))


def _deepest(df: DataFrame, drop: Column) -> DataFrame:
    """Largest drop and the earliest time it was reached."""
    return df.withColumn("_drop", drop).groupBy(*TRADER).agg(
        F.max("_drop").alias("depth"),
        F.max_by("ts", F.struct(F.col("_drop"), -F.col("ts"))).alias("trough_ts"))


def ratio_screen(series: DataFrame) -> DataFrame:
    """Peak to trough of 1 + percent/100, as a negative fraction of the peak."""
    peaked = _peaked(series, 1 + F.col("value") / 100.0)
    drop = F.when(F.col("_peak") != 0, (F.col("_peak") - F.col("_v")) / F.col("_peak")).otherwise(F.lit(0.0))
    return _deepest(peaked, drop).select(
        *TRADER, (-F.greatest(F.lit(0.0), F.col("depth"))).alias("depth"),
        F.when(F.col("depth") > 0, F.col("trough_ts")).alias("trough_ts"))


def level_screen(series: DataFrame) -> DataFrame:
    """The lowest level of the series; not a drawdown."""
    return series.groupBy(*TRADER).agg(
        F.min("value").alias("depth"), F.min_by("ts", F.struct("value", "ts")).alias("trough_ts"))


def points_screen(series: DataFrame) -> DataFrame:
    """Peak to trough of a cumulative fraction, in percentage points."""
    return _deepest(_peaked(series, F.col("value")), (F.col("_peak") - F.col("_v")) * 100.0)


def principal_screen(series: DataFrame, principal: DataFrame) -> DataFrame:
    """Peak to trough of a money series over the trader's principal, in percentage points.

    Traders without a positive principal drop out, which rejects them.
    """
    usable = series.join(principal.filter(F.col("principal") > 0), TRADER)
    return _deepest(_peaked(usable, F.col("value") / F.col("principal") * 100.0), F.col("_peak") - F.col("_v"))


def positional_series(traders: DataFrame, values: str, end_ms: DataFrame) -> DataFrame:
    """A series without timestamps: its last value belongs to the end of its scope, one day per step back."""
    long = traders.select(*TRADER, F.size(values).alias("_len"), F.posexplode(values).alias("_i", "value"))
    return (
        long.join(F.broadcast(end_ms), SCOPE)  # one row per scope
        .select(*TRADER, (F.col("series_end_ms") - (F.col("_len") - 1 - F.col("_i")).cast("bigint") * DAY_MS).alias("ts"), "value")
        .filter(F.col("value").isNotNull())
    )


def running_pnl(rows: DataFrame, hot=AUTO) -> DataFrame:
    """Cumulative PnL and its running peak per trader, by close; a hot trader's history is chunked."""
    hot = _resolve(hot, rows, TRADER)
    order = ["closed_ms", "position_key"]
    slim = rows.select(*TRADER, *order, "pnl")
    if hot is None:
        return _running_by_window(slim, order)
    cold, big = split_hot(slim, TRADER, hot)
    chunked = split_by_order(big, TRADER, order)
    summed = exclusive_prefix(chunked, TRADER, "_chunk", order, "pnl", "_before").withColumn(
        "cum_pnl", F.col("_before") + F.col("pnl"))
    peaked = running_max(summed, TRADER, "_chunk", order, "cum_pnl", "peak_pnl").drop("_before", "_chunk")
    return _running_by_window(cold, order).unionByName(peaked)


def trade_screen(rows: DataFrame, hot=AUTO) -> DataFrame:
    """Drop of cumulative PnL from its running peak, trade by trade, once the peak is positive.

    Traders whose cumulative PnL was never positive have no row.
    """
    drop = (F.col("cum_pnl") - F.col("peak_pnl")) / F.col("peak_pnl")
    return (
        running_pnl(rows, hot).filter(F.col("peak_pnl") > 0).withColumn("_drop", drop).groupBy(*TRADER)
        .agg(F.min("_drop").alias("depth"), F.min_by("closed_ms", F.struct("_drop", "closed_ms")).alias("trough_ts"))
    )


def _running_by_window(df: DataFrame, order: list[str]) -> DataFrame:
    upto = Window.partitionBy(*TRADER).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum_pnl", F.sum("pnl").over(upto)).withColumn("peak_pnl", F.max("cum_pnl").over(upto))


def monthly_screen(rows: DataFrame) -> DataFrame:
    """The same proxy on monthly sums, for traders with at least two months (report only)."""
    by_month = rows.groupBy(*TRADER, "month").agg(F.sum("pnl").alias("pnl"))
    upto = Window.partitionBy(*TRADER).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        by_month.withColumn("_months", F.count(F.lit(1)).over(Window.partitionBy(*TRADER)))
        .withColumn("_cum", F.sum("pnl").over(upto)).withColumn("_peak", F.max("_cum").over(upto))
    )
    drop = F.when(F.col("_peak") > 0, (F.col("_cum") - F.col("_peak")) / F.col("_peak"))
    return placed.filter(F.col("_months") >= 2).withColumn("_drop", drop).groupBy(*TRADER).agg(
        F.min("_drop").alias("depth"),
        F.min_by(F.when(F.col("_drop").isNotNull(), F.col("month")), F.struct(F.coalesce("_drop", F.lit(9.0)), "month"))
        .alias("trough_month"), F.max("_months").alias("n_months"))


def covered(kind: str, threshold: float = -0.20, points: float = 20.0) -> Column:
    """Does the trader pass? Reads depth, trough_ts and window_start_ms."""
    if kind == "trades":  # built from the same window, so never hidden by it
        return F.col("depth").isNull() | (F.col("depth") >= threshold)
    shallow = F.col("depth") >= threshold if kind in ("ratio", "level") else F.col("depth") < points
    seen = F.coalesce(F.col("window_start_ms") <= F.col("trough_ts"), F.lit(False))
    return F.when(F.col("depth").isNull(), F.lit(kind in PASSES_WITHOUT_SERIES)).otherwise(shallow | seen)
