"""The hard-filter funnels: an ordered cascade whose first failing filter is the rejection reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.config import SCOPE, TRADER, FunnelConfig
from tradewright.operators import screens
from tradewright.operators.alpha import cell_table, leave_self_out, self_dominance, with_alpha
from tradewright.operators.metrics import profile
from tradewright.operators.ordering import AUTO, _resolve, group_quantiles, index_quantile, median, ordinal_rank
from tradewright.session import cut


def position_concentration(rows: DataFrame, kind: str) -> DataFrame:
    """Largest PnL of one logical position per trader; fills closing together are one position."""
    second = F.floor(F.col("closed_ms") / 1000)
    symbol_id = "symbol_id" if "symbol_id" in rows.columns else "symbol"
    by = {"order": None, "symbol_ms": ["symbol", F.col("closed_ms").alias("_close")],
          "symbol_id_second": [symbol_id, second.alias("_close")]}[kind]
    if by is None:
        return rows.groupBy(*TRADER).agg(F.max("pnl").alias("best_position"))
    return rows.groupBy(*TRADER, *by).agg(F.sum("pnl").alias("_pnl")).groupBy(*TRADER).agg(
        F.max("_pnl").alias("best_position"))


def funnel_metrics(rows: DataFrame, config: FunnelConfig, hot=AUTO) -> DataFrame:
    """Per-trader metrics of the funnels over rows with a valid return `pr`."""
    valid = rows.filter(F.col("pr").isNotNull())
    hot = _resolve(hot, valid, TRADER)
    cells = cell_table(valid, config.min_cell)
    benchmark = cut(leave_self_out(valid, cells))  # read twice
    symbols = valid.groupBy(*TRADER, "symbol").agg(
        F.max((F.col("month") == F.lit(config.active_month or "")).cast("int")).alias("_active"))
    sizes = group_quantiles(valid, TRADER, {
        "lev_med": median("leverage"), "lev_p90": index_quantile("leverage", 0.9),
        "marg_med": median("margin"), "dur_med": median("dur_h")}, hot)
    out = (
        profile(with_alpha(valid, cells, benchmark), hot)
        .join(symbols.groupBy(*TRADER).agg(F.count(F.lit(1)).alias("n_syms"), F.max("_active").alias("_active")), TRADER)
        .join(sizes, TRADER)
        .join(position_concentration(valid, config.concentration), TRADER)
        .join(self_dominance(cells, benchmark, SCOPE), TRADER, "left")
    )
    return (
        out.withColumn("alpha_h2", F.coalesce("alpha_h2", F.lit(0.0)))
        .withColumn("conc", F.when(F.col("total_pnl") > 0, F.col("best_position") / F.col("total_pnl") * 100))
        .withColumn("active", F.lit(True) if config.active_month is None else F.col("_active") == 1)
        .drop("_active")
    )


def filters(cfg: FunnelConfig) -> dict[str, Column]:
    """Filter name -> "this trader fails it", in cascade order."""
    c = F.col
    out = {
        "sample": (c("n") < cfg.min_n) | (c("n_alpha") < cfg.min_n_alpha),
        "single_pair": c("n_syms") < 2,
        "one_sided": (c("n_win") == 0) | (c("n_loss") == 0),
        "win_rate": c("wr") > cfg.wr_max,
        "payoff": c("payoff") < cfg.payoff_min,
        "net_negative": c("total_pnl") <= 0,
        "concentration": c("conc") > cfg.conc_max,
    }
    if cfg.open_loss:
        known = F.lit(True) if cfg.open_loss == "always" else F.coalesce(c("has_upl"), F.lit(False))
        out["open_loss"] = known & (F.coalesce(c("upl_sum"), F.lit(0.0)) < -cfg.open_loss_share * F.abs("total_pnl"))
    out |= {
        "t_stat": c("t_stat") < cfg.t_min,
        "alpha_h2": c("alpha_h2") <= 0,
        "leverage": c("lev_p90") > cfg.lev_p90_max,
        "margin": c("marg_med") < cfg.margin_min,
        "duration": c("dur_med") < cfg.dur_min_h,
    }
    if cfg.active_month:
        out["inactive_month"] = ~c("active")
    out["drawdown"] = ~screens.covered(cfg.drawdown, cfg.drawdown_threshold, cfg.drawdown_points)
    if cfg.native_mdd:
        out["native_mdd"] = c("native_mdd") > cfg.drawdown_points
        out["lifetime_mdd"] = (c("lifetime_mdd") > cfg.drawdown_points) & (c("span_days") > cfg.native_window_days)
    return out


def hidden_loss(cfg: FunnelConfig) -> Column:
    by_rate = F.col("wr") > cfg.wr_max
    if cfg.hidden_mdd is not None:
        by_rate = by_rate | F.coalesce(F.col("mdd30") > cfg.hidden_mdd, F.lit(False))
    if not cfg.open_loss:
        return by_rate
    known = F.lit(True) if cfg.open_loss == "always" else F.coalesce(F.col("has_upl"), F.lit(False))
    return by_rate | (known & (F.coalesce("upl_neg_sum", F.lit(0.0)) < -cfg.hidden_loss_share * F.abs("total_pnl")))


def funnel(rows: DataFrame, config: FunnelConfig, screen: DataFrame, open_sums: DataFrame | None = None,
           headline: DataFrame | None = None, hot=AUTO) -> DataFrame:
    """Every trader with `failed` (all filters it fails), `reject_reason` (the first; NULL = survivor) and a score.

    `screen` holds depth and trough_ts per trader; `headline` may bring what the source publishes of a trader: headline_pnl, native_mdd,
    lifetime_mdd, mdd30, lead_days, locate_days. An unpublished age counts as zero days.
    """
    df = funnel_metrics(rows, config, hot).join(screen, TRADER, "left")
    if open_sums is None:
        df = df.withColumn("upl_sum", F.lit(None).cast("double")).withColumn("upl_neg_sum", F.lit(None).cast("double"))
        df = df.withColumn("n_open", F.lit(None).cast("long")).withColumn("has_upl", F.lit(None).cast("boolean"))
    else:
        df = df.join(open_sums, TRADER, "left")
    for name in ("headline_pnl", "native_mdd", "lifetime_mdd", "mdd30", "lead_days", "locate_days"):
        if headline is None or name not in headline.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    if headline is not None:
        df = df.drop(*[c for c in headline.columns if c not in TRADER]).join(headline, TRADER, "left")
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in filters(config).items()]))
    fresh = F.lit(False) if config.age is None else F.coalesce(config.age, F.lit(0.0)) < config.fresh_days
    return (
        df.withColumn("failed", failed).withColumn("reject_reason", F.get("failed", F.lit(0)))
        .withColumn("hidden_loss", hidden_loss(config))
        .withColumn("fresh_start", fresh)
        .withColumn("headline_ratio", F.col("total_pnl") / F.nullif(F.col("headline_pnl"), F.lit(0.0)))
        .withColumn("score", F.col("t_stat") * 0.5 + F.col("alpha") * 100 * 0.3 + F.col("payoff") * 0.2)
    )


def rejection_counts(funnelled: DataFrame) -> DataFrame:
    """Histogram of the first failing filter; survivors count under 'survivor', so the counts sum to all traders."""
    return funnelled.groupBy(*SCOPE, F.coalesce("reject_reason", F.lit("survivor")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_traders"))


def survivors(funnelled: DataFrame) -> DataFrame:
    """Survivors with their place by score; survivors are not limited in number, so the ranking is chunked."""
    left = funnelled.filter(F.col("reject_reason").isNull()).withColumn("_neg", -F.col("score"))
    return ordinal_rank(left, SCOPE, "_neg", "trader_id", "place").withColumn("place", F.col("place") + 1).drop("_neg")


def closest_misses(funnelled: DataFrame, limit: int = 10) -> DataFrame:
    """Rejected traders with the highest t, and everything that stopped them."""
    order = Window.partitionBy(*SCOPE).orderBy(F.col("t_stat").desc(), "trader_id")
    return (
        funnelled.filter(F.col("reject_reason").isNotNull()).withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
    )
