"""Per-trader metrics over the valid rows (those with a price return)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.config import DAY_MS, SCOPE, TRADER, DetectConfig
from tradewright.functions import columns as fc
from tradewright.operators.alpha import cell_table, leave_self_out, self_dominance, with_alpha
from tradewright.operators.ordering import AUTO, group_quantiles, hot_keys, index_quantile, median, position_in_group
from tradewright.session import cut


def _sd(total: str, squares: str, low: str, high: str, n: str) -> Column:
    """Population sd from mergeable sums; exactly 0 when all values are equal."""
    mean = F.col(total) / F.col(n)
    variance = F.greatest(F.lit(0.0), F.col(squares) / F.col(n) - mean * mean)
    return F.when(F.col(low) == F.col(high), F.lit(0.0)).otherwise(F.sqrt(variance))


def profile(alpha_rows: DataFrame, hot=AUTO, min_alphas: int = 5, keys: list[str] = TRADER) -> DataFrame:
    """Counts, means and extremes per trader, the alphas split in two halves by open time, and monthly alphas.

    Rows without an alpha sort behind those with one, so `pos < cnt` numbers exactly the alphas. Everything is
    summed per (trader, month) first and then per trader, so the months cost no second pass.
    """
    ordered = alpha_rows.withColumn(
        "_when", F.when(F.col("alpha").isNull(), F.lit(10**15)).otherwise(F.lit(0)) + F.col("opened_ms"))
    placed = position_in_group(ordered, keys, ["_when", "position_key"], hot, counted=F.col("alpha"))
    half1 = F.when(F.col("pos") < F.floor(F.col("cnt") / 2), F.col("alpha"))
    half2 = F.when(F.col("pos") >= F.floor(F.col("cnt") / 2), F.col("alpha"))
    win, loss = F.when(F.col("pr") > 0, F.col("pr")), F.when(F.col("pr") < 0, F.col("pr"))
    pnl = fc.zero_if_null("pnl")
    by_month = placed.groupBy(*keys, "month").agg(
        F.min(F.struct("opened_ms", "position_key", "nick")).alias("_first"),
        F.count(F.lit(1)).alias("n"), F.count("alpha").alias("n_alpha"), F.sum("alpha").alias("_a"),
        F.sum(F.col("alpha") * F.col("alpha")).alias("_a2"), F.min("alpha").alias("_a_lo"), F.max("alpha").alias("_a_hi"),
        F.sum(half1).alias("_h1"), F.count(half1).alias("_n1"), F.sum(half2).alias("_h2"), F.count(half2).alias("_n2"),
        F.count("alpha_incl").alias("n_alpha_incl"), F.sum("alpha_incl").alias("_i"),
        F.sum(F.col("alpha_incl") * F.col("alpha_incl")).alias("_i2"),
        F.min("alpha_incl").alias("_i_lo"), F.max("alpha_incl").alias("_i_hi"),
        F.count(win).alias("n_win"), F.sum(win).alias("_win"), F.count(loss).alias("n_loss"), F.sum(loss).alias("_loss"),
        F.min(loss).alias("worst_loss"), F.sum(pnl).alias("total_pnl"), F.max(pnl).alias("best_pnl"),
        F.min("opened_ms").alias("window_start_ms"), F.max("closed_ms").alias("last_closed_ms"),
    )
    sums = ["n", "n_alpha", "_a", "_a2", "_h1", "_n1", "_h2", "_n2", "n_alpha_incl", "_i", "_i2", "n_win", "_win",
            "n_loss", "_loss", "total_pnl"]
    lows, highs = ["_a_lo", "_i_lo", "worst_loss", "window_start_ms", "_first"], ["_a_hi", "_i_hi", "best_pnl", "last_closed_ms"]
    entry = F.when(F.col("n_alpha") >= min_alphas, F.struct("month", (F.col("_a") / F.col("n_alpha")).alias("mean")))
    out = by_month.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months_active"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("monthly_alpha"),
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
    sd, sd_incl = _sd("_a", "_a2", "_a_lo", "_a_hi", "n_alpha"), _sd("_i", "_i2", "_i_lo", "_i_hi", "n_alpha_incl")
    return out.select(
        *keys, F.col("_first.nick").alias("nick"), "n", "n_alpha", "months_active", "monthly_alpha",
        (F.col("_a") / F.nullif(F.col("n_alpha"), F.lit(0))).alias("alpha"),
        (F.col("_i") / F.nullif(F.col("n_alpha_incl"), F.lit(0))).alias("alpha_incl"),
        (F.col("_h1") / F.nullif(F.col("_n1"), F.lit(0))).alias("alpha_h1"),
        (F.col("_h2") / F.nullif(F.col("_n2"), F.lit(0))).alias("alpha_h2"),
        "n_win", "n_loss", (F.col("n_win") / F.col("n") * 100).alias("wr"),
        fc.payoff(F.col("_win") / F.nullif(F.col("n_win"), F.lit(0)),
                  F.col("_loss") / F.nullif(F.col("n_loss"), F.lit(0))).alias("payoff"),
        "worst_loss", "total_pnl", "best_pnl", "window_start_ms", "last_closed_ms",
        F.when(F.col("total_pnl") > 0, F.col("best_pnl") / F.col("total_pnl") * 100).alias("conc_top1"),
        ((F.col("last_closed_ms") - F.col("window_start_ms")) / float(DAY_MS)).alias("span_days"),
        sd.alias("_sd"), sd_incl.alias("_sd_incl"), "n_alpha_incl",
    ).withColumn("t_stat", fc.t_stat(F.col("alpha"), F.col("_sd"), F.col("n_alpha"))).withColumn(
        "t_incl", fc.t_stat(F.col("alpha_incl"), F.col("_sd_incl"), F.col("n_alpha_incl"))).drop(
        "_sd", "_sd_incl", "n_alpha_incl")


def trader_metrics(rows: DataFrame, min_cell: int, snapshot: DataFrame | None = None,
                   config: DetectConfig = DetectConfig()) -> DataFrame:
    """The metrics table: one row per (snapshot, exchange, trader) with at least one valid row."""
    valid = rows.filter(F.col("pr").isNotNull())
    hot = hot_keys(valid, TRADER)
    cells = cell_table(valid, min_cell)
    benchmark = cut(leave_self_out(valid, cells))  # read twice
    alpha_rows = with_alpha(valid, cells, benchmark)
    sizes = group_quantiles(
        valid.select(*TRADER, F.nullif(F.col("leverage"), F.lit(0.0)).alias("lev"),
                     fc.zero_if_null("margin").alias("margin"), fc.zero_if_null("dur_h").alias("dur_h")),
        TRADER, {"lev_med": median("lev"), "lev_p90": index_quantile("lev", 0.9),
                 "marg_med": median("margin"), "dur_med": median("dur_h")}, hot)
    out = (
        profile(alpha_rows, hot, config.min_monthly_alphas)
        .join(sizes, TRADER)
        .join(self_dominance(cells, benchmark, SCOPE), TRADER, "left")
        .withColumn("ruin", F.col("worst_loss") * F.col("lev_med") * 100)
        .withColumn("n_alpha_dropped_self_dominated", F.coalesce("n_alpha_dropped_self_dominated", F.lit(0)))
        .withColumn("max_cell_share", F.coalesce("max_cell_share", F.lit(0.0)))
    )
    if snapshot is None:
        out = out.withColumn("mdd", F.lit(None).cast("double"))
    else:
        out = out.join(snapshot.select(*TRADER, "mdd"), TRADER, "left")
    return out.select(
        *TRADER, "nick", "n", "n_alpha", "alpha", "t_stat", "payoff", "wr", "conc_top1", "ruin", "mdd", "lev_med",
        "lev_p90", "marg_med", "dur_med", "months_active", "alpha_h1", "alpha_h2", "monthly_alpha",
        "n_alpha_dropped_self_dominated", "max_cell_share")


def trader_totals(positions: DataFrame) -> DataFrame:
    """Last close, last open, realised PnL and gross winnings over all rows, valid or not."""
    return positions.groupBy(*TRADER).agg(
        F.max("closed_ms").alias("last_close"), F.max("opened_ms").alias("last_open"),
        F.sum("pnl").alias("realized"),
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(F.lit(0.0))).alias("gross_win"))


def mass_close_clusters(positions: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """Losing clusters of closes in the same second: trader, second, rows, net."""
    return (
        positions.filter(F.col("closed_ms").isNotNull())
        .groupBy(*TRADER, F.floor(F.col("closed_ms") / 1000).alias("second"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("net"))
        .filter((F.col("n") >= config.mass_close_positions) & (F.col("net") < 0))
    )


def mass_close_traders(positions: DataFrame, totals: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """Traders with a cluster that erased a share of everything they ever won."""
    clusters = mass_close_clusters(positions, config).groupBy(*TRADER).agg(F.min("net").alias("worst_net"))
    return (
        clusters.join(totals.select(*TRADER, "gross_win"), TRADER)
        .filter(-F.col("worst_net") >= config.mass_close_share * fc.zero_if_null("gross_win"))
        .select(*TRADER, "worst_net")
    )


def open_unrealized(open_positions: DataFrame) -> DataFrame:
    return open_positions.groupBy(*TRADER).agg(F.sum("unrealized_pnl").alias("unrealized"))


def snapshot_summary(positions: DataFrame) -> DataFrame:
    """One row per (snapshot, exchange) with its trader and position counts and the preceding snapshot."""
    per_trader = positions.groupBy(*TRADER).agg(F.count(F.lit(1)).alias("_n"))
    sizes = per_trader.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("n_traders"), F.sum("_n").alias("n_positions"))
    w = Window.partitionBy("exchange").orderBy("snapshot_date")
    return sizes.withColumn("prev_date", F.lag("snapshot_date").over(w)).withColumn(
        "snapshot_no", F.row_number().over(w))
