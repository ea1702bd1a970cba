"""Streaming variants of two batch jobs; without late rows they give the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewright.config import DetectConfig


def _clusters(closes: DataFrame, config: DetectConfig) -> DataFrame:
    return (
        closes.groupBy("exchange", "trader_id", F.window("closed_ts", "1 second"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("net"))
        .filter((F.col("n") >= config.mass_close_positions) & (F.col("net") < 0))
        .select("exchange", "trader_id", F.unix_seconds("window.start").alias("second"), "n", "net")
    )


def mass_close_stream(closes: DataFrame, delay: str = "1 minute", config: DetectConfig = DetectConfig()) -> DataFrame:
    """Losing same-second clusters per trader from a stream with `closed_ts`, `exchange`, `trader_id`, `pnl`; exchanges may share ids."""
    return _clusters(closes.withWatermark("closed_ts", delay), config)


def dedup_stream(rows: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """First arrival per key within the watermark delay."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def live_mass_closes(closes: DataFrame, delay: str = "1 minute", config: DetectConfig = DetectConfig()) -> DataFrame:
    """Clusters of a stream that delivers positions more than once: two stateful steps, one after the other, in append mode.

    A position (exchange, trader_id, position_key) counts on its first arrival within the delay, and a second's cluster is given out when the
    watermark has passed it. State is bounded by the positions of one delay. Rows later than the watermark are dropped by either step.
    """
    return _clusters(dedup_stream(closes, ["exchange", "trader_id", "position_key"], "closed_ts", delay), config)
