"""Snapshot-over-snapshot comparison: who improves, who decays, who changed style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.config import BAD, TRADER
from tradewright.functions.columns import clamp


def monthly_slope(monthly_alpha: str = "monthly_alpha") -> Column:
    """Least-squares slope of the monthly means on 0, 1, 2, ...; NULL under three months."""
    ys = F.map_values(monthly_alpha)
    k = F.size(ys)
    mean_x = (k - 1) / 2.0
    mean_y = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / k
    products = F.transform(ys, lambda y, i: (i - mean_x) * (y - mean_y))
    squares = F.transform(ys, lambda y, i: (i - mean_x) * (i - mean_x))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(k >= 3, total(products) / total(squares))


def with_previous(detected: DataFrame, summary: DataFrame) -> DataFrame:
    """Joins each trader's row of the preceding snapshot of the same exchange, prefixed `prev_`."""
    dated = detected.join(
        F.broadcast(summary.select("snapshot_date", "exchange", "prev_date", "snapshot_no")),  # one row per snapshot
        ["snapshot_date", "exchange"], "left")
    old = detected.select(
        F.col("snapshot_date").alias("prev_date"), "exchange", "trader_id",
        *[F.col(c).alias(f"prev_{c}") for c in ("alpha", "lev_med", "marg_med")])
    return dated.join(old, ["prev_date", "exchange", "trader_id"], "left")


def _moved(name: str) -> Column:
    now, then = F.nullif(F.col(name), F.lit(0.0)), F.nullif(F.col(f"prev_{name}"), F.lit(0.0))
    return F.coalesce((now / then > 2) | (now / then < 0.5), F.lit(False))


def trend(detected: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds `trend_bonus` and the cross-snapshot flags."""
    both = F.col("alpha").isNotNull() & F.col("prev_alpha").isNotNull()
    slope_bonus = F.coalesce(clamp(monthly_slope() * 100, -2.0, 2.0), F.lit(0.0))
    direction = F.signum(F.col("alpha") - F.col("prev_alpha"))
    added = F.array_compact(F.array(
        F.when((F.col("alpha") < 0) & (F.col("prev_alpha") < 0), F.lit("decopy_2neg")),
        F.when(F.col("alpha") < F.col("prev_alpha"), F.lit("alpha_decay")),
        F.when(_moved("lev_med") | _moved("marg_med"), F.lit("style_drift"))))
    return (
        with_previous(detected, summary)
        .withColumn("trend_bonus", F.when(both, clamp((slope_bonus + direction) / 2, -2.0, 2.0)).otherwise(slope_bonus))
        .withColumn("flags", F.array_union("flags", added))
        .select(*detected.columns, "prev_date", "snapshot_no", "prev_alpha", "trend_bonus")
    )


def new_disqualified_incumbents(roster: DataFrame, trended: DataFrame) -> DataFrame:
    """Members of the preceding roster whose current flags disqualify them."""
    members = roster.select(F.col("snapshot_date").alias("prev_date"), "exchange", "trader_id",
                            F.col("nick").alias("prev_nick"))
    bad = F.array_sort(F.array_intersect("flags", F.array(*[F.lit(f) for f in BAD])))
    return (
        trended.join(members, ["prev_date", "exchange", "trader_id"])
        .withColumn("bad_flags", bad).filter(F.size("bad_flags") > 0)
        .select(*TRADER, F.col("prev_nick").alias("nick"), "bad_flags")
    )
