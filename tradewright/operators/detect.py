"""The screening battery: every rule is one boolean column, and `flags` lists the rules that fired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.config import DAY_MS, SCOPE, TRADER, DetectConfig
from tradewright.functions.columns import iso_date_ms, zero_if_null
from tradewright.operators.metrics import mass_close_traders, open_unrealized, trader_totals


def copiers_losing(cfg: DetectConfig) -> Column:
    """Copiers lost real money: enough of them, and a material loss per head or against the lead's own gains."""
    pnl, count, lead = F.col("copier_pnl"), F.col("copier_count_total"), zero_if_null("realized")
    per_head = pnl / F.nullif(count, F.lit(0)) <= -cfg.copiers_max_avg_loss
    against_lead = (lead > 0) & (pnl <= -cfg.copiers_max_lead_share * lead)
    return (pnl < 0) & (count >= cfg.copiers_min) & (per_head | against_lead)


def rules(cfg: DetectConfig) -> dict[str, Column]:
    """Flag name -> condition, in listing order. A NULL condition does not fire."""
    c = F.col
    months = F.map_values("monthly_alpha")
    good_months = F.size(F.filter(months, lambda v: v > 0))
    return {
        "insufficient": (c("n") < cfg.min_n) | (c("n_alpha") < cfg.min_n_alpha) | (c("months_active") < cfg.min_months),
        "loss_hider": (c("n") >= cfg.loss_hider_min_n) & (
            F.coalesce(c("wr") > cfg.loss_hider_wr, F.lit(False)) | c("payoff").isNull()
            | ((c("payoff") < cfg.loss_hider_payoff) & (c("mdd") > cfg.mdd_high))),
        "open_loss_divergence": c("unrealized") < -2 * F.greatest(F.lit(1.0), zero_if_null("realized")),
        "lottery": c("conc_top1") > cfg.lottery_conc,
        "roi_artifact": (c("roi") > cfg.roi_artifact) & (
            (zero_if_null("alpha") <= 0) | (zero_if_null("t_stat") < cfg.roi_artifact_t)),
        "ruin_risk": F.coalesce(c("lev_p90") > cfg.lev_p90_max, F.lit(False)) | (c("ruin") < cfg.ruin_min),
        "not_copyable": F.coalesce(c("marg_med") < cfg.margin_min, F.lit(False)) | (c("dur_med") < cfg.dur_min_h),
        "no_alpha": zero_if_null("t_stat") < cfg.t_min,
        "mdd_high": c("mdd") >= cfg.mdd_high,
        "alpha_decay": c("alpha_h2") < c("alpha_h1"),
        "inactive": c("last_close") < c("max_close") - cfg.inactive_days * DAY_MS,
        "went_dark": c("last_open") < c("max_open") - cfg.went_dark_days * DAY_MS,
        "mass_close_loss": c("worst_net").isNotNull(),
        "no_listing_data": ~c("listed"),
        "copiers_losing": copiers_losing(cfg),
        "fresh_start": iso_date_ms("snapshot_date") - c("start_time") < cfg.fresh_start_days * DAY_MS,
        "regime_onesided": (F.size(months) >= 2) & (good_months / F.size(months) < 0.5),
        "thin_benchmark": c("max_cell_share") > cfg.thin_benchmark_share,
    }


def detect(metrics: DataFrame, snapshot: DataFrame, positions: DataFrame, open_positions: DataFrame | None = None,
           config: DetectConfig = DetectConfig()) -> DataFrame:
    """Adds `flags`, plus the facts the rules read that later stages report."""
    totals = trader_totals(positions)
    clocks = totals.groupBy(*SCOPE).agg(F.max("last_close").alias("max_close"), F.max("last_open").alias("max_open"))
    facts = (
        metrics.join(totals, TRADER, "left").join(F.broadcast(clocks), SCOPE, "left")  # one row per snapshot
        .join(mass_close_traders(positions, totals, config), TRADER, "left")
        .join(snapshot.select(*TRADER, "roi", "start_time", "listed", "copier_pnl", "copier_count_total"), TRADER, "left")
    )
    if open_positions is None:
        facts = facts.withColumn("unrealized", F.lit(None).cast("double"))
    else:
        facts = facts.join(open_unrealized(open_positions), TRADER, "left")
    fired = [F.when(condition, F.lit(name)) for name, condition in rules(config).items()]
    return facts.withColumn("flags", F.array_compact(F.array(*fired))).select(
        *metrics.columns, "realized", "roi", "start_time", "listed", "copier_pnl", "copier_count_total", "flags")
