"""Named queries over the test tables: one per operator of the blueprint, each on the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewright.config import FUNNELS, SCOPE, TRADER
from tradewright.functions import columns as fc
from tradewright.operators import candles as cd
from tradewright.operators import funnel as fn
from tradewright.operators import metrics as mt
from tradewright.operators import quality as ql
from tradewright.operators import rank as rk
from tradewright.operators import screens as sc
from tradewright.operators import stats as st
from tradewright.operators.alpha import cell_benchmark, cell_table, leave_self_out, with_alpha
from tradewright.operators.ordering import group_quantiles, index_quantile, median, slot_quantile
from tradewright.plans import ingest as ig
from tradewright.plans import raw_lines as rl
from tradewright.plans import studies as sd
from tradewright.plans import testbed as tb
from tradewright.plans.analysis import Analysis, analyse
from tradewright.session import stage_dir
from tradewright.sources import publish as pb

Query = Callable[[SparkSession, str], DataFrame]
MIN_CELL = 20


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison across engines; money columns get two digits by name."""
    return df.select(*[
        F.round(f.name, special.get(f.name, digits)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return tb.staged(spark, sf, tb.positions)


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).filter(F.col("pr").isNotNull())


def _alpha_rows(spark: SparkSession, sf: str) -> DataFrame:
    def alpha_rows(spark, sf):
        valid = _valid(spark, sf)
        cells = cell_table(valid, MIN_CELL)
        return with_alpha(valid, cells, leave_self_out(valid, cells))

    return tb.staged(spark, sf, alpha_rows)


_ANALYSES: dict[tuple, Analysis] = {}
_STORES: dict[tuple, str] = {}


def _analysis(spark: SparkSession, sf: str, min_cell: int = MIN_CELL) -> Analysis:
    """The two-snapshot analysis; its stage tables are shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf, min_cell)
    if key not in _ANALYSES:
        _ANALYSES[key] = analyse(
            tb.staged(spark, sf, tb.two_snapshots), tb.trader_snapshot(spark, sf, (tb.PREVIOUS, tb.CURRENT)),
            tb.open_positions(spark, sf), min_cell)
    return _ANALYSES[key]


def forget() -> None:
    _ANALYSES.clear()
    _STORES.clear()
    tb.forget_stages()


def _candles(spark: SparkSession, sf: str) -> DataFrame:
    return tb.staged(spark, sf, tb.candles)


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    return tb.staged(spark, sf, tb.candle_trades)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Positions to roster: benchmark, metrics, flags, trend, score, tiers and weights."""
    rows = _analysis(spark, sf).roster_rows()
    return rounded(rows.withColumn("warnings", F.array_join("warnings", ",")).drop("start_time", "prev_date"))


def ranking(spark: SparkSession, sf: str, min_cell: int = MIN_CELL) -> DataFrame:
    """The ranked universe behind the roster, seated or not."""
    t = _analysis(spark, sf, min_cell).tiered
    return rounded(t.select(*TRADER, "nick", "n", "n_alpha", "alpha", "t_stat", "payoff", "score", "tier", "weight",
                            F.array_join(F.array_sort("flags"), ",").alias("flags")))


# ---- positions, cells, metrics ------------------------------------------------------------------------------

def _d(value: Callable[[DataFrame], DataFrame], **digits: int) -> Query:
    return lambda s, p: rounded(value(_positions(s, p)), **digits)


def cell_benchmarks(s, p):
    return rounded(cell_benchmark(_positions(s, p), MIN_CELL).select("symbol", "month", "side", "n_cell", "bench"))


def leave_self_out_table(s, p):
    valid = _valid(s, p)
    cells = cell_table(valid, MIN_CELL)
    return rounded(leave_self_out(valid, cells).join(cells.select("cell_no", "symbol", "month", "side"), "cell_no").drop("cell_no"))


def trader_metric_table(s, p):
    m = mt.trader_metrics(_positions(s, p), MIN_CELL, tb.trader_snapshot(s, p))
    m = m.withColumn("monthly_alpha", F.array_join(F.transform(F.map_entries("monthly_alpha"), lambda e: F.concat(
        e["key"], F.lit(":"), F.format_number(e["value"], 4))), ","))
    return rounded(m.drop("exchange"))


def clocks(s, p):
    t = mt.trader_totals(_positions(s, p))
    return t.groupBy(*SCOPE).agg(F.max("last_close").alias("max_close"), F.max("last_open").alias("max_open"))


def detected(s, p):
    d = _analysis(s, p).detected
    return d.select(*TRADER, F.array_join("flags", ",").alias("flags"))


def trended(s, p):
    t = _analysis(s, p).trended
    return rounded(t.select(*TRADER, "prev_date", "trend_bonus", F.array_join(F.array_sort("flags"), ",").alias("flags")))


def tiered(s, p):
    return rounded(_analysis(s, p).tiered.select(*TRADER, "score", "tier", "weight"))


def exclusions(s, p):
    e = rk.notable_exclusions(_analysis(s, p).tiered)
    return rounded(e.withColumn("flags", F.array_join(F.array_sort("flags"), ",")))


def tier_changes(s, p):
    d = _analysis(s, p).diff()
    return d.withColumn("added_a", F.array_join("added_a", ",")).withColumn("removed_a", F.array_join("removed_a", ","))


def disqualified(s, p):
    d = _analysis(s, p).new_disqualified()
    return d.withColumn("bad_flags", F.array_join("bad_flags", ","))


# ---- funnels ------------------------------------------------------------------------------------------------

def _screen(s, p, name: str) -> DataFrame:
    kind = FUNNELS[name].drawdown
    series = tb.staged(s, p, tb.equity_series)
    fraction = series.withColumn("value", F.col("value") / 100.0)
    if kind == "ratio":
        return sc.ratio_screen(series)
    if kind == "level":
        return sc.level_screen(fraction)
    if kind == "points":
        return sc.points_screen(fraction)
    if kind == "principal":
        return sc.principal_screen(series.withColumn("value", F.col("value") * 2000.0), _principal(s, p))
    return sc.trade_screen(_valid(s, p))


def _principal(s, p) -> DataFrame:
    return tb.trader_snapshot(s, p).select(*TRADER, (F.col("aum") / 40.0 - 5000.0).alias("principal"))


def _headline(s, p) -> DataFrame:
    return tb.trader_snapshot(s, p).select(
        *TRADER, (F.col("roi") * 10.0).alias("headline_pnl"), (F.col("mdd") / 2.0).alias("native_mdd"), F.col("mdd").alias("lifetime_mdd"),
        (F.col("mdd") / 100.0).alias("mdd30"), (F.col("mdd") * 4.0).alias("lead_days"), (F.col("mdd") * 3.0).alias("locate_days"))


def _funnel(name: str) -> Query:
    cfg = FUNNELS[name]
    if cfg.active_month:
        from dataclasses import replace
        cfg = replace(cfg, active_month="2001-10")

    def build(s, p):
        def funnelled(s, p):
            rows = _valid(s, p)
            if name in ("bybit", "bitget", "kucoin"):
                rows = ql.load_with_accounting(_positions(s, p))[0]
            opens = ql.open_sums(tb.open_positions(s, p), cfg.open_loss == "always") if cfg.open_loss else None
            return fn.funnel(rows, cfg, _screen(s, p, name), opens, _headline(s, p))
        funnelled.__name__ = f"funnel_{name}"
        return tb.staged(s, p, funnelled)

    return build


def _funnel_rows(name: str) -> Query:
    return lambda s, p: rounded(_funnel(name)(s, p).select(
        "trader_id", "n", "n_alpha", "n_syms", "alpha", "t_stat", "t_incl", "alpha_h2", "wr", "payoff", "lev_p90", "marg_med", "dur_med",
        "conc", F.array_join("failed", ",").alias("failed"), "reject_reason", "hidden_loss", "fresh_start"), conc=3)


def _screen_rows(name: str) -> Query:
    def build(s, p):
        cfg = FUNNELS[name]
        window = _valid(s, p).groupBy(*TRADER).agg(F.min("opened_ms").alias("window_start_ms"))
        judged = window.join(_screen(s, p, name), TRADER, "left").withColumn(
            "covered", sc.covered(cfg.drawdown, cfg.drawdown_threshold, cfg.drawdown_points))
        return rounded(judged.select("trader_id", "depth", "trough_ts", "covered"), 4)
    return build


def drawdown_bases(s, p):
    window = _valid(s, p).groupBy(*TRADER).agg(F.min("opened_ms").alias("window_start_ms"))
    native = tb.trader_snapshot(s, p).select(*TRADER, F.col("mdd").alias("depth"))
    return sd.drawdown_bases(window, {
        "level": (_screen(s, p, "okx"), sc.covered("level")), "points": (_screen(s, p, "bitget"), sc.covered("points")),
        "native": (native, ~F.coalesce(F.col("depth") > 20, F.lit(False)))}).drop("exchange", "snapshot_date")


def misses(s, p):
    return rounded(fn.closest_misses(_funnel("okx")(s, p)).select(
        "place", "trader_id", "t_stat", F.array_join("failed", ",").alias("failed")))


def funnel_order(s, p):
    return rounded(fn.survivors(_funnel("bybit")(s, p)).select("place", "trader_id", "score"))


# ---- quality ------------------------------------------------------------------------------------------------

def _lines_as_rows(s, p) -> DataFrame:
    return tb.spread(tb.table(s, p, "lineitem")).select(
        F.expr("if(l_orderkey % 50 = 0, null, l_orderkey)").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_no"),
        F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"),
        F.expr("l_returnflag = 'R'").alias("is_raw"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("file_pos"))


def _survivors(how: str) -> Query:
    def build(s, p):
        rows, keys = _lines_as_rows(s, p), ["order_id", "line_no"]
        if how == "shaped":
            out = ql.dedup(rows, keys, [F.col("is_raw").asc(), F.col("file_pos").desc()])
        else:
            out = (ql.first_wins if how == "first" else ql.last_wins)(rows, keys, "file_pos")
        return out.select("order_id", "line_no", "part", F.round("price", 2).alias("price"))
    return build


def drop_accounting(s, p):
    bad = _positions(s, p).withColumn("leverage", F.when(F.col("position_key") % 41 == 0, 0.0).otherwise(F.col("leverage"))).withColumn(
        "side", F.when(F.col("position_key") % 43 == 0, "Merged").otherwise(F.col("side"))).withColumn(
        "roi", F.when(F.col("position_key") % 47 == 0, F.lit(None)).when(F.col("position_key") % 53 == 0, 99.0 * F.col("leverage")).otherwise(F.col("roi")))
    return ql.load_with_accounting(bad)[1]


def return_bases(s, p):
    rows = _positions(s, p).select(
        "trader_id", *[F.when(F.col("avg_cost") > 0, fc.price_return(k)).alias(k) for k in ("price", "roi", "net")])
    return rounded(rows.groupBy("trader_id").agg(*[F.avg(k).alias(f"mean_{k}") for k in ("price", "roi", "net")], F.count("price").alias("n")))


def buckets(s, p):
    rows = _trades(s, p)
    return rounded(rows.groupBy(
        fc.duration_bucket().alias("duration"), fc.leverage_bucket().alias("leverage_band"), fc.weekday("opened_ms").alias("weekday"),
        fc.six_hour_block("opened_ms").alias("block"), fc.liquidation_band().alias("liquidation")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fc.local_hour("opened_ms").cast("long")).alias("hours")))


def snapshot_violations(s, p):
    summary = _analysis(s, p).summary
    other = summary.withColumn("exchange", F.lit("phemex")).filter(F.col("snapshot_date") == tb.PREVIOUS)
    return ql.validate_snapshots(summary.unionByName(other))


def cap_flags(s, p):
    rows = tb.raw_positions(s, p)
    closed = rows.filter(F.col("_flag") != "R").select("trader_id")
    opened = rows.filter(F.col("_flag") == "R").select("trader_id", F.when(F.col("position_key") % 2 == 0, F.lit("")).alias("close_time"))
    manifest = tb.table(s, p, "supplier").select(F.col("s_suppkey").cast("string").alias("trader_id"))
    return ql.recompute_cap_flags(closed, opened, manifest, cap=450)


def headline_ratio(s, p):
    return rounded(ql.headline_vs_computed(_positions(s, p), _headline(s, p).select(*TRADER, "headline_pnl")).select(
        "trader_id", "computed_pnl", "headline_pnl", "ratio"), computed_pnl=2, ratio=3)


def pnl_identity(s, p):
    rows = _positions(s, p).withColumn("closed_pnl", F.col("pnl") + F.col("notional") * 0.0006).withColumn(
        "exchange_fee", F.col("notional") * 0.0005).withColumn("funding_fee", F.col("notional") * 0.0001)
    return rounded(ql.internal_pnl_identity(rows).select("trader_id", "ratio"), 4)


def net_gross(s, p):
    return rounded(ql.net_vs_gross(_positions(s, p), ["symbol"]), 4)


def overview(s, p):
    return rounded(ql.overview(_positions(s, p)).withColumn("first_day", F.col("first_day").cast("string")).withColumn(
        "last_day", F.col("last_day").cast("string")))


def universe(s, p):
    return ql.universe_funnel(tb.trader_snapshot(s, p), _positions(s, p), _valid(s, p)).drop(*SCOPE)


def uniqueness(s, p):
    return ql.key_uniqueness(_lines_as_rows(s, p), ["order_id", "line_no"])


# ---- joins, windows, sets -----------------------------------------------------------------------------------

def halves(s, p):
    h = sd.own_halves(_valid(s, p))
    return rounded(h.groupBy("trader_id", "half").agg(F.count(F.lit(1)).alias("n"), F.avg("pr").alias("mean_pr"), F.min("opened_ms").alias("first_ms")))


def calendar_cut(s, p):
    h = sd.calendar_halves(_valid(s, p))
    return rounded(h.groupBy("half", F.col("cut_ms").cast("long").alias("cut_ms")).agg(F.count(F.lit(1)).alias("n"), F.avg("pr").alias("mean_pr")))


def candle_features(s, p):
    f = cd.with_features(_candles(s, p))
    return rounded(f.select("symbol", "open_ms", "i", "close", "r4", "r24", "r72", "ma_incl", "ma_ctx", "ma_prior", "range_pos", "vol"))


def as_of_trades(s, p):
    j = cd.as_of(_trades(s, p), _candles(s, p), ["close"])
    return rounded(j.select("position_key", "candle_ms", "close"))


def interval_excursions(s, p):
    e = cd.excursions(_trades(s, p), _candles(s, p))
    return rounded(e.select("position_key", "mae", "mfe"), 9)


def cumulative_pnl(s, p):
    return rounded(sc.running_pnl(_valid(s, p)).select("trader_id", "position_key", "cum_pnl", "peak_pnl"), 2)


def tied_ranks(s, p):
    per = _valid(s, p).groupBy("trader_id").agg(F.count(F.lit(1)).alias("n"))
    r = st.ranked(st.ranked(per.withColumn("m", (F.col("n") % 20).cast("double")), ["m"]).withColumnRenamed("rank_m", "avg_rank"), ["m"], "ordinal")
    return r.select("trader_id", "avg_rank", F.col("rank_m").cast("long").alias("ordinal"))


def quantile_edges(s, p):
    return rounded(group_quantiles(_positions(s, p), ["symbol", "side"], {
        "dur_med": median("dur_h"), "lev_p75": index_quantile("leverage", 0.75), "margin_p90": index_quantile("margin", 0.90),
        "tercile1": slot_quantile("margin", 1, 3), "tercile2": slot_quantile("margin", 2, 3),
        "dur_p90": sd.exclusive_quantile("dur_h", 9, 10)}))


def historical_ids(s, p):
    rows = tb.staged(s, p, tb.two_snapshots)
    cur = rows.filter(F.col("snapshot_date") == tb.CURRENT).select("trader_id")
    prev = rows.filter(F.col("snapshot_date") == tb.PREVIOUS).select("trader_id")
    return prev.union(cur).distinct()


def not_listed_ids(s, p):
    listed = tb.trader_snapshot(s, p).filter("listed").select("trader_id")
    return _positions(s, p).select("trader_id").distinct().join(listed, "trader_id", "left_anti")


def detail_ids(s, p):
    a = _analysis(s, p)
    return rk.detail_candidates(a.tiered, a.roster, a.summary)


# ---- studies ------------------------------------------------------------------------------------------------

def correlations(s, p):
    return rounded(sd.style_vs_skill(_positions(s, p)))


def mann_whitney(s, p):
    long = _valid(s, p).select("symbol", "side", "pr")
    return rounded(st.mann_whitney_cells(long, ["side"], "symbol", "pr"))


def pooled(s, p):
    per = sd.pooled_halves(_positions(s, p), True)
    return rounded(st.spearman(per, {"rho": ("exp1", "exp2")}))


def slopes(s, p):
    return rounded(st.ols_slope(_alpha_rows(s, p), ["trader_id"], "opened_ms", "alpha"))


def detectable(s, p):
    n = _valid(s, p).groupBy("symbol").agg(F.countDistinct("trader_id").alias("n"))
    return rounded(st.detectable_rho(n, "n"))


def _paths(s, p):
    def paths(s, p):
        return sd.exit_paths(_trades(s, p), _candles(s, p))
    return tb.staged(s, p, paths)


def _rule_rows(s, p):
    def rule_rows(s, p):
        return sd.rule_rows(_trades(s, p), _candles(s, p))
    return tb.staged(s, p, rule_rows)


def _signals(s, p):
    def signals(s, p):
        return sd.signal_trades(_candles(s, p))
    return tb.staged(s, p, signals)


def _store(s, p) -> str:
    key = (s.sparkContext.applicationId, p)
    if key not in _STORES:
        _STORES[key] = rl.ingested(s, p)
    return _STORES[key]


def ingested_sizes(s, p):
    """What each table of the store holds when one exchange has delivered nothing for the older snapshot the second time."""
    store = rl.ingested(s, p, vanish=True)
    parts = [ig.stored(s, store, t).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).withColumn("stored_table", F.lit(t)) for t in ig.TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ingested_traders(s, p):
    _, traders = ig.load(s, _store(s, p))
    return rounded(traders.select(*TRADER, "nick", "roi", "aum", "mdd", "start_time", "listed", "copier_pnl", "copier_count_total", "retired"), 4)


def ingested_ranking(s, p):
    """Raw lines of two exchanges to tiers: the ingest job and the analysis of what it has stored."""
    tiers = analyse(*ig.load(s, _store(s, p)), None, MIN_CELL).tiered
    return rounded(tiers.select(*TRADER, "n", "n_alpha", "alpha", "t_stat", F.array_join(F.array_sort("flags"), ",").alias("flags"), "score", "tier", "weight"))


def published_report(s, p):
    """What a reader of the latest report finds."""
    root = f"{stage_dir(s)}/stage-report-{uuid.uuid4().hex}"
    pb.publish(s, _analysis(s, p).report_tables(), root, tb.CURRENT)
    pb.promote(s, root, tb.CURRENT)
    counts = [t.agg(F.count(F.lit(1)).alias("n")).withColumn("report_table", F.lit(name)) for name, t in pb.read(s, root).items()]
    return reduce(DataFrame.unionByName, counts)


def copy_scale(s, p):
    minimum = tb.table(s, p, "part").groupBy(F.col("p_type").alias("symbol")).agg((F.max("p_size") * 1.0).alias("min_notional"))
    return rounded(sd.copy_scaling(_positions(s, p), tb.trader_snapshot(s, p), minimum).drop(*SCOPE), 3)


def drift(s, p):
    return rounded(sd.cell_drift(tb.staged(s, p, tb.two_snapshots), tb.PREVIOUS, tb.CURRENT).drop("exchange"))


def vanished(s, p):
    rows = tb.staged(s, p, tb.two_snapshots)
    kept = rows.filter(~((F.col("snapshot_date") == tb.CURRENT) & (F.col("opened_ms") < 870000000000)))
    return sd.vanished_history(kept, tb.trader_snapshot(s, p), tb.PREVIOUS, tb.CURRENT)


def _cols(build: Query, *columns: str) -> Query:
    return lambda s, p: rounded(build(s, p).select(*columns), 4)


QUERIES: dict[str, Query] = {
    "s1_read_binance": _cols(rl.binance, "trader_id", "symbol", "side", "opened_ms", "closed_ms", "dur_h", "leverage", "notional", "margin", "pnl", "partial"),
    "s2_read_phemex": lambda s, p: rounded(rl.phemex(s, p).select(
        "trader_id", "position_key", "symbol", "side", "opened_ms", "leverage", "notional", "pnl"), 4, leverage=9),
    "s3_read_okx": _cols(lambda s, p: rl.ps.read_okx(rl.okx_lines(s, p)), "trader_id", "position_key", "side", "opened_ms", "closed_ms", "leverage", "notional", "pnl"),
    "s4_read_bybit": _cols(rl.bybit, "trader_id", "position_key", "symbol", "leverage", "notional", "pnl"),
    "s5_read_bitget": _cols(rl.bitget, "trader_id", "position_key", "side", "leverage", "roi", "pnl", "is_raw"),
    "s6_read_kucoin": _cols(rl.kucoin, "trader_id", "symbol", "opened_ms", "closed_ms", "leverage", "pnl"),
    "s7_listing": rl.listing, "s9_open_sums": lambda s, p: rounded(rl.open_sums(s, p).drop(*SCOPE), 4),
    "s13_bybit_pages": _cols(rl.bybit_pages, "trader_id", "position_key", "side", "leverage", "pnl", "roi", "margin", "opened_ms"),
    "s14_bitget_pages": _cols(rl.bitget_pages, "trader_id", "position_key", "side", "leverage", "pnl", "roi", "opened_ms"),
    "s15_kucoin_open": _cols(rl.kucoin_open_pages, "trader_id", "symbol", "side", "unrealized_pnl", "realized_pnl", "trade_fee", "opened_ms"),
    "s16_split_closed_open": rl.split_open, "s17_pivot_and_metric_text": lambda s, p: rounded(rl.metric_text(s, p)),
    "s19_unify_traders": lambda s, p: rl.unified(s, p), "s21_statuses": rl.statuses,
    "s22_detail": lambda s, p: rounded(rl.details(s, p).select("trader_id", "retired", "copier_pnl", "copier_count_total")),
    "k2_ingest_sizes": ingested_sizes, "k2_ingest_traders": ingested_traders, "k2_ingest_ranking": ingested_ranking,
    "s13_bybit_open": lambda s, p: rounded(rl.bybit_open(s, p).drop("file_pos", "leader_user_id"), 8),
    "s13_bybit_traders": lambda s, p: rounded(rl.bybit_traders(s, p).select(
        "trader_id", "nick", "leader_user_id", "win_rate_7d", "win_rate_3w", "locate_days", "wallet_balance", "n_followers")),
    "s10_bybit_yields": lambda s, p: rounded(rl.bybit_yields(s, p)), "s10_bitget_returns": lambda s, p: rounded(rl.bitget_returns(s, p)),
    "s14_bitget_open": _cols(rl.bitget_open, "trader_id", "position_key", "symbol_id", "side", "leverage", "avg_cost", "size", "margin", "opened_ms"),
    "s14_bitget_cycles": _cols(rl.bitget_cycles, "trader_id", "nick", "cycle_days", "aum", "max_drawdown", "n_trades", "n_loss"),
    "s14_bitget_details": lambda s, p: rounded(rl.bitget_details(s, p).drop("file_pos")),
    "s15_kucoin_leaders": lambda s, p: rounded(rl.kucoin_leaders(s, p).select(
        "trader_id", "nick", "principal", "days_as_leader", "total_pnl", "d7_pnl", F.size("pnl_series_90d").alias("n_days"))),
    "s15_kucoin_summaries": lambda s, p: rl.kucoin_summaries(s, p).drop("file_pos"), "s23_okx_stats": lambda s, p: rounded(rl.okx_stats(s, p).drop("file_pos")),
    "t5_positional_series": lambda s, p: rounded(rl.kucoin_positional(s, p).drop(*SCOPE), 4),
    "s20_board_pages": rl.board_pages, "k5_published_report": published_report,
    "s24_assemble_records": rl.records, "s10_equity_points": lambda s, p: rounded(rl.equity_points(s, p)),
    "s11_latest_status": lambda s, p: rounded(rl.manifest(s, p), 2), "s12_candle_file": lambda s, p: rounded(rl.candle_file(s, p), 2),
    "s20_leaderboards": lambda s, p: rounded(rl.leaderboards(s, p), 2), "s23_recommend_list": lambda s, p: rounded(rl.recommended(s, p), 2),
    "roster": flagship,
    "a1_cell_benchmark": cell_benchmarks,
    "a2_leave_self_out": leave_self_out_table,
    "a3_trader_metrics": trader_metric_table,
    "a5_position_concentration": lambda s, p: rounded(
        fn.position_concentration(_positions(s, p), "symbol_id_second").select("trader_id", "best_position"), 2),
    "a6_trader_totals": _d(lambda r: mt.trader_totals(r).drop(*SCOPE), realized=2, gross_win=2),
    "a7_mass_close_clusters": _d(lambda r: mt.mass_close_clusters(r).drop(*SCOPE), net=2),
    "a7_mass_close_traders": _d(lambda r: mt.mass_close_traders(r, mt.trader_totals(r)).drop(*SCOPE), worst_net=2),
    "a8_open_unrealized": lambda s, p: rounded(mt.open_unrealized(tb.open_positions(s, p)).drop(*SCOPE), 2),
    "a9_by_symbol": _d(sd.by_symbol, pnl=2, vol=2),
    "a10_by_symbol_without_lottery": _d(sd.by_symbol_without_lottery, pnl=2, vol=2),
    "a11_best_pair": _d(sd.best_pair, pnl=2, total_pnl=2),
    "a11_best_pair_frequency": _d(lambda r: sd.best_pair_frequency(sd.best_pair(r))),
    "a12_symbol_profile": _d(sd.symbol_profile, long_pnl=2, short_pnl=2, avg_win=2, avg_loss=2),
    "a12_symbol_breakdowns": _d(sd.symbol_breakdowns, pnl=2),
    "a12_top_symbol_traders": _d(lambda df: sd.top_symbol_traders(df).drop(*TRADER), pnl=2),
    "a13_pair_select": _d(sd.pair_select, usd=2, med_usd=2),
    "a14_pair_stability": _d(sd.pair_stability, usd=2),
    "a15_behaviour_quartiles": _d(sd.behaviour_quartiles),
    "a16_duration_profile": lambda s, p: rounded(sd.duration_profile(sd.quartile_rows(_positions(s, p)))),
    "a17_elite_out_of_sample": _d(sd.elite_out_of_sample),
    "a18_regime_cells": lambda s, p: rounded(sd.regime_cells(_trades(s, p), _candles(s, p))),
    "a19_rules_oos": lambda s, p: rounded(sd.rules_oos(_trades(s, p), _candles(s, p))),
    "a20_entry_context": lambda s, p: rounded(sd.entry_context(_trades(s, p), _candles(s, p))),
    "a20_momentum_side": lambda s, p: rounded(sd.momentum_side(_trades(s, p), _candles(s, p))),
    "a21_excursion_profile": lambda s, p: rounded(sd.excursion_profile(_paths(s, p))),
    "a21_capture_profile": lambda s, p: rounded(sd.capture_profile(_paths(s, p))),
    "a21_excursion_by_duration": lambda s, p: rounded(sd.excursion_by_duration(_paths(s, p))),
    "a21_liquidation_risk": lambda s, p: rounded(sd.liquidation_risk(_paths(s, p))),
    "a22_rejection_counts": lambda s, p: fn.rejection_counts(_funnel("okx")(s, p)).drop(*SCOPE),
    "d1_dedup_first_wins": _survivors("first"), "d1_dedup_last_wins": _survivors("last"),
    "d3_dedup_shaped_beats_raw": _survivors("shaped"),
    "d4_return_bases": return_bases, "d7_drop_accounting": drop_accounting, "d10_buckets": buckets,
    "d9_partial_share": lambda s, p: rounded(sd.partial_share(_positions(s, p))),
    "q1_snapshot_violations": snapshot_violations, "q2_cap_flags": cap_flags, "q3_headline_ratio": headline_ratio,
    "q4_pnl_identity": pnl_identity, "q5_net_vs_gross": net_gross, "q6_universe_funnel": universe, "q7_overview": overview,
    "q8_key_uniqueness": uniqueness,
    "j7_not_listed": not_listed_ids, "j9_as_of": as_of_trades, "j10_interval_excursions": interval_excursions,
    "w1_own_halves": halves, "w2_calendar_cut": calendar_cut, "w3_candle_features": candle_features,
    "w7_cumulative_pnl": cumulative_pnl, "w9_clocks": clocks, "w11_tied_ranks": tied_ranks, "o5_quantile_edges": quantile_edges,
    "u1_historical_ids": historical_ids, "u2_detail_candidates": detail_ids,
    "r1_detect": detected, "r2_trend": trended, "r3_new_disqualified": disqualified, "r5_tiers": tiered,
    "r6_unallocated": lambda s, p: rk.unallocated(_analysis(s, p).roster),
    "r8_removed": lambda s, p: _analysis(s, p).removed(), "r9_snapshot_diff": tier_changes,
    "r10_portfolio_ages": lambda s, p: rk.portfolio_ages(_analysis(s, p).roster_rows()).withColumn("opened_on", F.col("opened_on").cast("string")),
    "r11_notable_exclusions": exclusions,
    **{f"r12_funnel_{name}": _funnel_rows(name) for name in FUNNELS},
    "o2_funnel_survivors": funnel_order,
    "t1_ratio_screen": _screen_rows("binance"), "t2_level_screen": _screen_rows("okx"), "t3_points_screen": _screen_rows("bitget"),
    "t5_principal_screen": _screen_rows("kucoin"), "t6_trade_screen": _screen_rows("phemex"),
    "t7_monthly_screen": lambda s, p: rounded(sc.monthly_screen(_valid(s, p)).drop(*SCOPE), 4),
    "m2_style_correlations": correlations, "m5_mann_whitney": mann_whitney, "m9_ols_slope": slopes, "m14_detectable_rho": detectable,
    "m10_composite_ranking": lambda s, p: rounded(sd.composite_ranking(_positions(s, p)), 4),
    "e1_persistence": lambda s, p: rounded(sd.persistence(_positions(s, p))),
    "e1_persistence_calendar": lambda s, p: rounded(sd.persistence(_positions(s, p), "calendar")),
    "e3_style_persistence": lambda s, p: rounded(sd.style_persistence(_positions(s, p))), "o4_symbol_extremes": _d(sd.symbol_extremes, pnl=2, vol=2),
    "e1_persistence_ordinal": lambda s, p: rounded(sd.persistence_ordinal(_positions(s, p))),
    "e1_persistence_thirds": lambda s, p: rounded(sd.persistence_thirds(_positions(s, p))),
    "e2_pooled_rho": pooled,
    "e2_pooled_persistence": lambda s, p: rounded(sd.pooled_persistence(_positions(s, p))),
    "e4_regime_adaptation": lambda s, p: rounded(sd.regime_adaptation(_trades(s, p), _candles(s, p))),
    "e8_rule_overlay": lambda s, p: rounded(sd.rule_overlay(_rule_rows(s, p))),
    "e8_rule_significance": lambda s, p: rounded(sd.rule_significance(_rule_rows(s, p))),
    "e9_signal_event_study": lambda s, p: rounded(sd.signal_event_study(_signals(s, p)), 4),
    "e9_signal_by_year": lambda s, p: rounded(sd.signal_by_year(_signals(s, p), _candles(s, p)), 4),
    "e10_random_entry_baseline": lambda s, p: rounded(sd.random_entry_baseline(_candles(s, p), _signals(s, p)), 4),
    "e14_entry_containment": lambda s, p: rounded(sd.entry_containment(_trades(s, p), _candles(s, p))),
    "e15_vanished_history": vanished,
    "e16_flag_fire_rates": lambda s, p: rounded(sd.flag_fire_rates(_analysis(s, p).detected)),
    "e16_gate_grid": lambda s, p: sd.gate_grid(_analysis(s, p).detected),
    "e17_stop_level_grid": lambda s, p: rounded(sd.stop_level_grid(_rule_rows(s, p))),
    "e18_window_alpha": lambda s, p: rounded(sd.window_alpha(_alpha_rows(s, p), 978307200000).drop(*SCOPE)),
    "e19_clustered_t": lambda s, p: rounded(sd.clustered_t(_alpha_rows(s, p)).drop(*SCOPE)),
    "e20_equity_floor_cost": lambda s, p: sd.equity_floor_cost(tb.trader_snapshot(s, p)).drop(*SCOPE),
    "e21_copy_scaling": copy_scale,
    "e22_hedge_overlap": lambda s, p: rounded(sd.hedge_overlap(_positions(s, p)).drop(*SCOPE)),
    "e22_alpha_without_hedges": lambda s, p: rounded(sd.alpha_without_hedges(_positions(s, p)).drop(*SCOPE)),
    "e23_cell_drift": drift,
    "e24_marginal_flag_cost": lambda s, p: sd.marginal_flag_cost(_analysis(s, p).trended),
    "e25_closest_misses": misses,
    "e26_broad_pairs": _d(sd.broad_pairs, usd=2, med_usd=2),
    "e27_drawdown_bases": drawdown_bases,
    "e28_relative_thresholds": lambda s, p: rounded(sd.relative_thresholds(_trades(s, p), _candles(s, p))),
}
