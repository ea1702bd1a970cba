"""Thresholds of the screens. Every value is a parameter; the defaults are the published rules."""

from __future__ import annotations

from dataclasses import dataclass

DAY_MS = 86_400_000
HOUR_MS = 3_600_000

SCOPE = ["snapshot_date", "exchange"]
# The most selective key first: sorts then settle most comparisons on the first column.
TRADER = ["trader_id", *SCOPE]
CELL = ["symbol", "month", "side", *SCOPE]

# The flag vocabulary, in the order in which flags are listed.
DISQUALIFYING = [
    "insufficient", "loss_hider", "open_loss_divergence", "lottery", "roi_artifact", "ruin_risk",
    "not_copyable", "no_alpha", "went_dark", "mass_close_loss", "no_listing_data", "copiers_losing",
]
WARNINGS = [
    "mdd_high", "alpha_decay", "inactive", "fresh_start", "regime_onesided", "thin_benchmark", "style_drift",
]
NOT_A_DEFECT = ["insufficient", "no_listing_data"]
BAD = [*DISQUALIFYING, "decopy_2neg"]


@dataclass(frozen=True)
class DetectConfig:
    min_n: int = 60
    min_n_alpha: int = 40
    min_months: int = 3
    loss_hider_min_n: int = 20
    loss_hider_wr: float = 92.0
    loss_hider_payoff: float = 0.5
    mdd_high: float = 35.0
    lottery_conc: float = 30.0
    roi_artifact: float = 300.0
    roi_artifact_t: float = 2.0
    lev_p90_max: float = 25.0
    ruin_min: float = -500.0
    margin_min: float = 50.0
    dur_min_h: float = 0.5
    t_min: float = 2.5
    inactive_days: int = 30
    went_dark_days: int = 21
    mass_close_positions: int = 5
    mass_close_share: float = 0.50
    copiers_min: int = 10
    copiers_max_avg_loss: float = 50.0
    copiers_max_lead_share: float = 0.50
    fresh_start_days: int = 120
    thin_benchmark_share: float = 0.40
    min_monthly_alphas: int = 5


@dataclass(frozen=True)
class RankConfig:
    w_t: float = 0.40
    w_alpha: float = 0.25
    w_payoff: float = 0.20
    w_trend: float = 0.15
    warning_factor: float = 0.9
    seats: int = 5
    pool_a: float = 0.70
    pool_b: float = 0.30
    cap_a: float = 0.20
    cap_b: float = 0.10
    first_run_min_n: int = 300
    weight_move: float = 0.10


@dataclass(frozen=True)
class FunnelConfig:
    exchange: str
    min_cell: int = 8
    min_n: int = 15
    min_n_alpha: int = 8
    t_min: float = 2.5
    wr_max: float = 92.0
    payoff_min: float = 0.5
    conc_max: float = 30.0
    lev_p90_max: float = 25.0
    margin_min: float = 50.0
    dur_min_h: float = 0.5
    # None: no open-position screen; "always": missing open rows count as zero;
    # "known": only where the source publishes unrealised PnL.
    open_loss: str | None = None
    open_loss_share: float = 0.5
    hidden_loss_share: float = 0.2
    active_month: str | None = None
    # ratio | level | points | principal | trades
    drawdown: str = "level"
    drawdown_threshold: float = -0.20
    drawdown_points: float = 20.0
    native_mdd: bool = False
    native_window_days: int = 90
    # order | symbol_ms | symbol_id_second
    concentration: str = "order"
    # what tells a trader's age: span_days | lead_days | locate_days; None: not judged
    age: str | None = None
    fresh_days: int = 120
    # a published 30-day drawdown above this hints at hidden losses; None: not judged
    hidden_mdd: float | None = None


# The published screen of each exchange.
FUNNELS = {
    "binance": FunnelConfig("binance", min_cell=20, min_n=60, min_n_alpha=40, active_month="2026-08",
                            drawdown="ratio"),
    "okx": FunnelConfig("okx", open_loss="always", drawdown="level", age="lead_days"),
    "bybit": FunnelConfig("bybit", open_loss="known", drawdown="level", concentration="symbol_ms", age="locate_days"),
    "bitget": FunnelConfig("bitget", drawdown="points", native_mdd=True, concentration="symbol_id_second", age="span_days"),
    "kucoin": FunnelConfig("kucoin", open_loss="always", drawdown="principal", age="span_days"),
    "phemex": FunnelConfig("phemex", drawdown="trades", hidden_mdd=0.4),
}
