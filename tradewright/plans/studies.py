"""The research studies as table-to-table jobs over canonical positions and candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.config import BAD, CELL, SCOPE, TRADER
from tradewright.functions import columns as fc
from tradewright.operators import stats
from tradewright.operators.alpha import cell_benchmark, cell_table, leave_self_out, with_alpha
from tradewright.operators.candles import as_of, excursions, regime, with_features
from tradewright.operators.ordering import (
    AUTO, exclusive_quantile, group_quantiles, hot_keys, index_quantile, median, ordinal_rank, position_in_group, prefix_in_group,
    slot_quantile,
)
from tradewright.session import cut


# ---- splits -------------------------------------------------------------------------------------------------

def own_halves(rows: DataFrame, order: str = "opened_ms", keys: list[str] | None = None, hot=AUTO) -> DataFrame:
    """half = 0 for the first n div 2 positions of each trader's own history."""
    placed = position_in_group(rows, keys or ["trader_id"], [order, "position_key"], hot)
    return placed.withColumn("half", (F.col("pos") >= F.floor(F.col("cnt") / 2)).cast("int")).drop("pos", "cnt")


def calendar_halves(rows: DataFrame, order: str = "opened_ms") -> DataFrame:
    """half by one cut for everybody: the element n div 2 of all times in order."""
    edge = group_quantiles(rows, [], {"cut_ms": slot_quantile(order, 1, 2)})
    return rows.crossJoin(F.broadcast(edge)).withColumn("half", (F.col(order) >= F.col("cut_ms")).cast("int"))  # one row


def net_returns(rows: DataFrame, bound: float = 3.0) -> DataFrame:
    return rows.filter(F.col("notional") > 0).withColumn("net", F.col("pnl") / F.col("notional")).filter(
        F.abs("net") <= bound)


def cohorts(df: DataFrame, value: str, parts: int, at_least_one: bool = True, ident: str = "trader_id") -> DataFrame:
    """Best and worst n div parts traders by `value` as cohort 'top' / 'bottom'."""
    r = ordinal_rank(df.withColumn("_neg", -F.col(value)), [], "_neg", ident, "_place")
    n = r.agg(F.count(F.lit(1)).alias("_traders"))
    size = F.floor(F.col("_traders") / parts)
    size = F.greatest(F.lit(1), size) if at_least_one else size
    cohort = F.when(F.col("_place") < size, "top").when(F.col("_place") >= F.col("_traders") - size, "bottom")
    return r.crossJoin(F.broadcast(n)).withColumn("cohort", cohort).filter(F.col("cohort").isNotNull()).drop(
        "_neg", "_place", "_traders")  # one row


# ---- descriptive --------------------------------------------------------------------------------------------

def by_symbol(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("wr"), F.sum("notional").alias("vol"))


def symbol_extremes(rows: DataFrame, best: int = 12, worst: int = 6) -> DataFrame:
    """The symbols that made most and those that made least, from either end of one order."""
    per = cut(by_symbol(rows))
    ends = []
    for name, k, pnl in (("best", best, F.col("pnl").desc()), ("worst", worst, F.col("pnl").asc())):
        ends.append(per.withColumn("place", F.row_number().over(Window.orderBy(pnl, "symbol"))).filter(F.col("place") <= k).withColumn("end_of", F.lit(name)))
    return ends[0].unionByName(ends[1])


def by_symbol_without_lottery(rows: DataFrame, share: float = 0.30) -> DataFrame:
    """`by_symbol` after dropping each trader's best trade where it makes more than `share` of a positive net."""
    best = rows.groupBy("trader_id").agg(
        F.sum("pnl").alias("_net"), F.max_by("position_key", F.struct("pnl", "position_key")).alias("_best"),
        F.max("pnl").alias("_top"))
    lottery = best.filter((F.col("_net") > 0) & (F.col("_top") > share * F.col("_net"))).select(
        "trader_id", F.col("_best").alias("position_key"))
    return by_symbol(rows.join(lottery, ["trader_id", "position_key"], "left_anti"))


def best_pair(rows: DataFrame, min_positions: int = 8) -> DataFrame:
    """Each trader's most profitable symbol with enough positions."""
    per = rows.groupBy("trader_id", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("wr"))
    ok = F.when(F.col("n") >= min_positions, F.struct("pnl", "symbol", "n", "wr"))
    out = per.groupBy("trader_id").agg(
        F.max_by(ok, F.when(ok.isNotNull(), F.struct("pnl", "symbol"))).alias("b"), F.sum("pnl").alias("total_pnl"))
    return out.filter(F.col("b").isNotNull()).select(
        "trader_id", F.col("b.symbol").alias("symbol"), F.col("b.n").alias("n"), F.col("b.pnl").alias("pnl"),
        F.col("b.wr").alias("wr"), "total_pnl")


def best_pair_frequency(best: DataFrame) -> DataFrame:
    return best.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_traders"))


def symbol_profile(rows: DataFrame) -> DataFrame:
    """Per symbol: sides, winners and losers with their middle duration, average win and loss."""
    closed = rows.filter(F.col("closed_ms").isNotNull() & F.col("opened_ms").isNotNull())
    long, win = fc.is_long(), F.col("pnl") > 0
    sums = closed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(long, 1)).alias("long_n"),
        F.sum(F.when(long, F.col("pnl"))).alias("long_pnl"), F.count(F.when(~long, 1)).alias("short_n"),
        F.sum(F.when(~long, F.col("pnl"))).alias("short_pnl"), F.count(F.when(win, 1)).alias("wins"),
        F.avg(F.when(win, F.col("pnl"))).alias("avg_win"), F.avg(F.when(~win, F.col("pnl"))).alias("avg_loss"))
    split = closed.withColumn("_dw", F.when(win, F.col("dur_h"))).withColumn("_dl", F.when(~win, F.col("dur_h")))
    mids = group_quantiles(split, ["symbol"], {
        "dur_win": slot_quantile("_dw", 1, 2), "dur_loss": slot_quantile("_dl", 1, 2)})
    return sums.join(mids, "symbol").withColumn("loss_win_ratio", F.abs(F.col("avg_loss") / F.nullif(F.col("avg_win"), F.lit(0.0))))


def symbol_breakdowns(rows: DataFrame) -> DataFrame:
    """n, pnl and win rate per symbol by duration, leverage and local opening hour, in one pass."""
    closed = rows.filter(F.col("closed_ms").isNotNull())
    dims = F.array(
        F.struct(F.lit("duration").alias("dimension"), fc.duration_bucket().alias("bucket")),
        F.struct(F.lit("leverage").alias("dimension"), fc.leverage_bucket().alias("bucket")),
        F.struct(F.lit("hour").alias("dimension"), F.lpad(fc.local_hour("opened_ms").cast("string"), 2, "0").alias("bucket")))
    return (
        closed.select("symbol", "pnl", F.explode(dims).alias("_d")).groupBy("symbol", "_d.dimension", "_d.bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("wr"))
    )


def top_symbol_traders(rows: DataFrame, k: int = 8) -> DataFrame:
    """The `k` traders who made most on each symbol; a nick is only a label, which several may share."""
    per = rows.groupBy(*TRADER, "symbol").agg(F.max("nick").alias("nick"), F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("symbol").orderBy(F.col("pnl").desc(), "nick", *TRADER)
    return per.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def pair_select(rows: DataFrame, value: str = "roi", min_traders: int = 20, min_positions: int = 100) -> DataFrame:
    """Symbols with equal weight per trader: mean per trader, then the median over traders."""
    valid = rows.filter(F.col(value).isNotNull())
    v = F.col(value)
    per = valid.groupBy("symbol", "trader_id").agg(
        F.avg(v).alias("_mean"), F.sum("pnl").alias("_usd"), F.count(F.lit(1)).alias("_n"),
        F.count(F.when(v > 0, 1)).alias("_nw"), F.sum(F.when(v > 0, v)).alias("_w"),
        F.count(F.when(v < 0, 1)).alias("_nl"), F.sum(F.when(v < 0, v)).alias("_l"), F.sum(v).alias("_v"))
    per = cut(per)
    out = per.groupBy("symbol").agg(
        F.sum("_n").alias("npos"), F.count(F.lit(1)).alias("ntr"), F.sum("_usd").alias("usd"),
        (F.avg((F.col("_mean") > 0).cast("double")) * 100).alias("pct_win"), F.count(F.when(F.col("_mean") > 0, 1)).alias("n_winners"),
        F.max("_usd").alias("_top"), (F.sum("_nw") / F.sum("_n") * 100).alias("wr"),
        ((F.sum("_w") / F.nullif(F.sum("_nw"), F.lit(0))) / F.abs(F.sum("_l") / F.nullif(F.sum("_nl"), F.lit(0)))).alias("payoff"),
        (F.sum("_v") / F.sum("_n")).alias("expectancy"))
    return (
        out.filter((F.col("ntr") >= min_traders) & (F.col("npos") >= min_positions))
        .withColumn("top1", F.when(F.col("usd") > 0, F.col("_top") / F.col("usd") * 100)).drop("_top")
        .join(group_quantiles(per, ["symbol"], {"med_value": median("_mean"), "med_usd": median("_usd")}), "symbol")
    )


def pair_stability(rows: DataFrame, min_half: int = 30) -> DataFrame:
    """`pair_select` on the price return, with the median of each calendar half and whether both are positive."""
    halved = calendar_halves(rows.filter(F.col("pr").isNotNull()), "closed_ms")
    split = halved.withColumn("_h1", F.when(F.col("half") == 0, F.col("pr"))).withColumn(
        "_h2", F.when(F.col("half") == 1, F.col("pr")))
    n = split.groupBy("symbol").agg(F.count("_h1").alias("_n1"), F.count("_h2").alias("_n2"))
    meds = group_quantiles(split, ["symbol"], {"m1": median("_h1"), "m2": median("_h2"), "lev_med": median("leverage")})
    both = meds.join(n, "symbol").select(
        "symbol", F.when(F.col("_n1") > min_half, F.col("m1")).alias("m1"),
        F.when(F.col("_n2") > min_half, F.col("m2")).alias("m2"), "lev_med")
    return pair_select(rows, "pr").select("symbol", "npos", "ntr", "usd", "med_value", "pct_win").join(both, "symbol").withColumn(
        "stable", F.coalesce((F.col("m1") > 0) & (F.col("m2") > 0), F.lit(False)))


def broad_pairs(rows: DataFrame) -> DataFrame:
    """Symbols that many traders win on: enough rows, traders and winners, no dominating trader, positive median."""
    c = F.col
    return pair_select(rows, "roi", 5, 10).filter(
        (c("n_winners") >= 3) & (c("top1") < 60) & (c("med_value") > 0))


# ---- behaviour ----------------------------------------------------------------------------------------------

def _cohort_sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.avg((v > 0).cast("double")) * 100).alias("wr"),
        (F.avg(F.when(v > 0, v)) / F.abs(F.avg(F.when(v < 0, v)))).alias("payoff"),
        (F.avg(fc.is_long().cast("double")) * 100).alias("pct_long"),
        (F.avg((F.col("isolated") == "Cross").cast("double")) * 100).alias("pct_cross"))


def quartile_rows(rows: DataFrame, min_positions: int = 10) -> DataFrame:
    """Positions of the best and worst quartile of traders by mean return on margin, per symbol-wide input."""
    valid = rows.filter(F.col("pr").isNotNull())
    scores = valid.groupBy("trader_id").agg(F.avg("roi").alias("mean_roi"), F.count(F.lit(1)).alias("n_trader"))
    picked = cohorts(scores.filter(F.col("n_trader") >= min_positions), "mean_roi", 4)
    return valid.join(picked, "trader_id")


def behaviour_quartiles(rows: DataFrame) -> DataFrame:
    picked = cut(quartile_rows(rows))
    split = picked.withColumn("_w", F.when(F.col("pr") > 0, F.col("pr"))).withColumn(
        "_l", F.when(F.col("pr") < 0, -F.col("pr")))
    q = group_quantiles(split, ["cohort"], {
        "med_loss": median("_l"), "med_win": median("_w"), "dur_med": median("dur_h"),
        "dur_p90": exclusive_quantile("dur_h", 9, 10), "lev_med": median("leverage"),
        "lev_p90": exclusive_quantile("leverage", 9, 10)})
    sizes = picked.filter(F.col("notional") > 0).groupBy("cohort", "trader_id").agg(
        F.count(F.lit(1)).alias("_n"), (F.stddev_samp("notional") / F.avg("notional")).alias("_cv"))
    counts = picked.groupBy("cohort", "trader_id").agg(F.count(F.lit(1)).alias("n_pos"))
    cv = group_quantiles(sizes.filter(F.col("_n") > 3), ["cohort"], {"size_cv_med": median("_cv")})
    per = group_quantiles(counts, ["cohort"], {"pos_per_trader_med": median("n_pos")})
    return _cohort_sums(picked, ["cohort"], "pr").join(q, "cohort").join(per, "cohort").join(cv, "cohort", "left")


def duration_profile(rows: DataFrame, variant: str = "month") -> DataFrame:
    """n, median return and win rate per cohort and duration bucket."""
    b = rows.withColumn("bucket", fc.duration_bucket("dur_h", variant))
    sums = b.groupBy("cohort", "bucket").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("pr") > 0).cast("double")) * 100).alias("wr"))
    return sums.join(group_quantiles(b, ["cohort", "bucket"], {"med_pr": median("pr")}), ["cohort", "bucket"])


def elite_rows(rows: DataFrame, min_positions: int = 30) -> DataFrame:
    """Second-half positions of the traders whose first-half net mean put them in the top or bottom third."""
    halved = calendar_halves(net_returns(rows))
    scores = halved.filter(F.col("half") == 0).groupBy("trader_id").agg(
        F.avg("net").alias("score"), F.count(F.lit(1)).alias("_n"))
    picked = cohorts(scores.filter(F.col("_n") >= min_positions), "score", 3, at_least_one=False)
    return halved.filter(F.col("half") == 1).join(picked.select("trader_id", "cohort"), "trader_id")


def elite_out_of_sample(rows: DataFrame, keys: tuple[str, ...] = ("cohort", "symbol")) -> DataFrame:
    e = cut(elite_rows(rows))
    k = list(keys)
    traders = e.groupBy(*k, "trader_id").agg(F.lit(1).alias("_x")).groupBy(*k).agg(F.count(F.lit(1)).alias("n_traders"))
    q = group_quantiles(e, k, {"med_net": median("net"), "dur_med": median("dur_h"), "lev_med": median("leverage")})
    return _cohort_sums(e, k, "net").join(traders, k).join(q, k)


# ---- persistence --------------------------------------------------------------------------------------------

def persistence(rows: DataFrame, split: str = "own", min_half: int = 10, value: str = "pr", n_perm: int = 10_000,
                n_boot: int = 2_000) -> DataFrame:
    """Does win rate, payoff or expectancy of the first half predict the second? One row per metric."""
    valid = rows.filter(F.col(value).isNotNull())
    halved = own_halves(valid) if split == "own" else calendar_halves(valid)
    per = cut(stats.halves_profile(halved, value, min_half))
    parts = []
    for name in ("wr", "payoff", "exp"):
        a, b = f"{name}1", f"{name}2"
        parts.append(
            stats.permutation_p(per, a, b, n_perm).crossJoin(stats.bootstrap_ci(per, a, b, n_boot))  # one row each
            .withColumn("metric", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def persistence_thirds(rows: DataFrame, min_positions: int = 20) -> DataFrame:
    """Second-half medians of the traders picked as top or bottom third on the first half (split by close)."""
    valid = rows.filter(F.col("pr").isNotNull())
    per = stats.halves_profile(own_halves(valid, "closed_ms"), "pr", 1, one_sided_ok=True).filter(
        F.col("n1") + F.col("n2") >= min_positions)
    return group_quantiles(cohorts(per, "exp1", 3), ["cohort"], {
        "med_exp1": median("exp1"), "med_exp2": median("exp2"), "med_wr2": median("wr2")})


def persistence_ordinal(rows: DataFrame, min_positions: int = 20) -> DataFrame:
    valid = rows.filter(F.col("pr").isNotNull())
    per = stats.halves_profile(own_halves(valid, "closed_ms"), "pr", 1, one_sided_ok=True).filter(
        F.col("n1") + F.col("n2") >= min_positions)
    return stats.spearman(per, {"rho_return": ("exp1", "exp2"), "rho_wr": ("wr1", "wr2")}, "ordinal")


def demeaned(rows: DataFrame, min_rows: int = 10) -> DataFrame:
    """net minus the mean of its symbol x side x half cell, for cells with enough rows."""
    halved = calendar_halves(net_returns(rows))
    keys = ["symbol", "side", "half"]
    means = halved.groupBy(*keys).agg(F.avg("net").alias("_mean"), F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= min_rows)
    return halved.join(means, keys).withColumn("net_dm", F.col("net") - F.col("_mean")).drop("_mean", "_n")


def pooled_halves(rows: DataFrame, demean: bool, min_half: int = 30) -> DataFrame:
    base = demeaned(rows) if demean else calendar_halves(net_returns(rows))
    return stats.halves_profile(base, "net_dm" if demean else "net", min_half, one_sided_ok=True)


def pooled_persistence(rows: DataFrame, n_perm: int = 10_000, n_boot: int = 2_000) -> DataFrame:
    parts = []
    for name, demean in (("raw", False), ("demeaned", True)):
        per = cut(pooled_halves(rows, demean))
        parts.append(stats.permutation_p(per, "exp1", "exp2", n_perm).crossJoin(
            stats.bootstrap_ci(per, "exp1", "exp2", n_boot)).withColumn("control", F.lit(name)))  # one row each
    return parts[0].unionByName(parts[1])


def style_vs_skill(rows: DataFrame, min_positions: int = 20) -> DataFrame:
    """Are win rate and payoff one style axis? Pearson and Spearman across traders, one row."""
    valid = rows.filter(F.col("pr").isNotNull())
    v = F.col("pr")
    per = valid.groupBy("trader_id").agg(
        F.count(F.lit(1)).alias("n_pos"), F.avg((v > 0).cast("double")).alias("wr"),
        (F.avg(F.when(v > 0, v)) / F.abs(F.avg(F.when(v < 0, v)))).alias("payoff"), F.avg(v).alias("exp"),
    ).filter((F.col("n_pos") >= min_positions) & F.col("payoff").isNotNull())
    r = stats.ranked(cut(per), ["wr", "payoff", "exp"], "ordinal")
    pairs = [("wr", "payoff"), ("wr", "exp"), ("payoff", "exp")]
    return r.agg(F.count(F.lit(1)).alias("n"),
                 *[stats.correlation(a, b).alias(f"pearson_{a}_{b}") for a, b in pairs],
                 *[stats.correlation(f"rank_{a}", f"rank_{b}").alias(f"spearman_{a}_{b}") for a, b in pairs])


def style_persistence(rows: DataFrame, min_positions: int = 30) -> DataFrame:
    """Which of win rate, payoff and expectancy carries over from a trader's own first half to the second? Rank correlations, one row."""
    per = stats.halves_profile(own_halves(rows.filter(F.col("pr").isNotNull())), "pr", 1).filter(F.col("n1") + F.col("n2") >= min_positions)
    return stats.spearman(per, {f"rho_{m}": (f"{m}1", f"{m}2") for m in ("wr", "payoff", "exp")}, "ordinal")


def partial_share(rows: DataFrame, tolerance: float = 0.02) -> DataFrame:
    p = fc.partial_close("closed_volume", "max_oi", tolerance)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(p, 1)).alias("n_partial"),
                    F.avg(p.cast("double")).alias("share"))


# ---- candle studies -----------------------------------------------------------------------------------------

def with_regime(trades: DataFrame, candles: DataFrame) -> DataFrame:
    sign = fc.side_sign("side", "loose")
    joined = as_of(trades, with_features(candles), ["close", "ma_incl"])
    return joined.withColumn("regime", regime()).filter(F.col("regime").isNotNull()).withColumn(
        "pr", fc.price_return("price")).filter((F.col("avg_cost") > 0) & (F.col("avg_close") > 0) & (F.abs("pr") <= 3)).withColumn(
        "aligned", (sign == F.col("regime")).cast("double"))


def regime_cells(trades: DataFrame, candles: DataFrame) -> DataFrame:
    r = cut(with_regime(trades, candles))
    keys = ["regime", "side"]
    sums = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("pr") > 0).cast("double")) * 100).alias("wr"),
                                F.avg("aligned").alias("aligned_share"))
    return sums.join(group_quantiles(r, keys, {"med_pr": median("pr")}), keys)


def regime_adaptation(trades: DataFrame, candles: DataFrame, min_positions: int = 30) -> DataFrame:
    """Does trading with the regime persist per trader, and does it pay?"""
    halved = own_halves(with_regime(trades, candles))
    per = halved.groupBy("trader_id").agg(
        F.count(F.lit(1)).alias("n_pos"), F.avg(F.when(F.col("half") == 0, F.col("aligned"))).alias("a1"),
        F.avg(F.when(F.col("half") == 1, F.col("aligned"))).alias("a2"),
        F.avg(F.when(F.col("half") == 1, F.col("pr"))).alias("r2")).filter(F.col("n_pos") >= min_positions)
    per = cut(per)
    rho = stats.spearman(per, {"rho_alignment": ("a1", "a2"), "rho_return": ("a1", "r2")}, "ordinal")
    mid = group_quantiles(per, [], {"_mid": median("a1")})
    split = per.crossJoin(F.broadcast(mid))  # one row
    high = F.when(F.col("a1") >= F.col("_mid"), F.col("r2"))
    low = F.when(F.col("a1") < F.col("_mid"), F.col("r2"))
    meds = group_quantiles(split.withColumn("_hi", high).withColumn("_lo", low), [], {
        "med_r2_high": median("_hi"), "med_r2_low": median("_lo")})
    return rho.crossJoin(meds)  # one row each


def entry_features(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Trades with the price context known at entry, halved by calendar."""
    feats = with_features(candles).filter(F.col("i") >= 200)
    ctx = feats.select("symbol", "open_ms", "r4", "r24", "r72", (F.col("close") / F.col("ma_ctx") - 1).alias("ma"),
                       "range_pos", "vol", "i")
    all_candles = candles.join(ctx, ["symbol", "open_ms"], "left")
    joined = as_of(net_returns(trades), all_candles, ["r4", "r24", "r72", "ma", "range_pos", "vol", "i"])
    return calendar_halves(joined.filter(F.col("i").isNotNull()).drop("i"))


FEATURES = ["r4", "r24", "r72", "ma", "range_pos", "vol"]


def _compare_periods(df: DataFrame, features: dict[str, Column], value: str, floor: int = 30) -> DataFrame:
    """Per cell of each feature: n and median in both periods, sign agreement, and z of the cell against the rest in the second.

    All features share one ranking of the second period. A row stands in one cell of each feature; those copies are made and counted inside a task,
    and of their values only the few in the middle of a cell move.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), c.alias("cell")) for name, c in features.items()])
    slim = cut(df.select("half", F.col(value).alias("v"), cells.alias("cells")))
    second = slim.filter(F.col("half") == 1).withColumn("_all", F.lit(0))
    ranks = stats.value_ranks(second.select("_all", "v"), ["_all"], "v").select(
        F.lit(1).alias("half"), "v", (F.col("lo") + (F.col("c") + 1) / 2.0).alias("_rank"))
    long = slim.join(ranks, ["half", "v"], "left").select("half", "v", "_rank", F.explode("cells").alias("_f")).select("half", "v", "_rank", "_f.*")
    long = long.filter(F.col("cell").isNotNull())
    sums = long.groupBy("feature", "cell").agg(
        F.count(F.when(F.col("half") == 0, F.col("v"))).alias("n1"), F.count(F.when(F.col("half") == 1, F.col("v"))).alias("n2"), F.sum("_rank").alias("_r"))
    meds = cell_benchmark(long.select("half", "v", "feature", "cell"), 1, ["feature", "cell", "half"], "v").groupBy("feature", "cell").agg(
        *[F.max(F.when(F.col("half") == i, F.col("bench"))).alias(f"med{i + 1}") for i in (0, 1)])
    z = stats.rank_sum_z(F.col("_r"), F.col("n2"), F.col("_n") - F.col("n2"))
    found = sums.filter((F.col("n1") >= floor) & (F.col("n2") >= floor)).join(meds, ["feature", "cell"])
    return found.join(F.broadcast(second.agg(F.count(F.lit(1)).alias("_n")))).select(  # one row
        "feature", "cell", "n1", "n2", "med1", "med2", z.alias("z"), ((F.col("med1") > 0) == (F.col("med2") > 0)).alias("consistent"))


def entry_context(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Tercile cells of every feature; the edges come from the first period only."""
    df = cut(entry_features(trades, candles))
    edges = group_quantiles(df.filter(F.col("half") == 0), [], {
        f"{f}_{i}": slot_quantile(f, i, 3) for f in FEATURES for i in (1, 2)})
    cell = lambda f: F.when(F.col(f) < F.col(f"{f}_1"), "low").when(F.col(f) < F.col(f"{f}_2"), "mid").otherwise("high")
    return _compare_periods(df.crossJoin(F.broadcast(edges)), {f: cell(f) for f in FEATURES}, "net")  # one row


def momentum_side(trades: DataFrame, candles: DataFrame) -> DataFrame:
    side = F.concat(F.when(F.col("r24") > 0, "up").otherwise("down"), F.lit("+"), F.col("side"))
    return _compare_periods(cut(entry_features(trades, candles)), {"momentum x side": side}, "net")


def exit_paths(trades: DataFrame, candles: DataFrame) -> DataFrame:
    return excursions(net_returns(trades), candles).withColumn("amae", F.abs("mae"))


def excursion_profile(paths: DataFrame) -> DataFrame:
    """Adverse excursion of winners and losers; the winners' tail is where a stop belongs."""
    g = paths.filter(F.col("net") != 0).withColumn("outcome", F.when(F.col("net") > 0, "winner").otherwise("loser"))
    n = g.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return n.join(group_quantiles(g, ["outcome"], {
        "mae_med": median("amae"), "mae_p75": index_quantile("amae", 0.75), "mae_p90": index_quantile("amae", 0.90),
        "mae_p95": index_quantile("amae", 0.95)}), "outcome")


def capture_profile(paths: DataFrame) -> DataFrame:
    cap = paths.filter(F.col("mfe") > 0.001).withColumn("cap", fc.clamp(F.col("net") / F.col("mfe"), -1.0, 2.0))
    return group_quantiles(cap, [], {"cap_med": median("cap"), "cap_p25": exclusive_quantile("cap", 1, 4),
                                     "cap_p75": exclusive_quantile("cap", 3, 4)})


def excursion_by_duration(paths: DataFrame, floor: int = 30) -> DataFrame:
    b = paths.withColumn("bucket", fc.duration_bucket("dur_h", "short"))
    n = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= floor)
    return n.join(group_quantiles(b, ["bucket"], {
        "mfe_med": median("mfe"), "mae_med": median("amae"), "net_med": median("net")}), "bucket")


def liquidation_risk(paths: DataFrame, floor: int = 30) -> DataFrame:
    b = paths.withColumn("band", fc.liquidation_band()).filter(F.col("band").isNotNull())
    sums = b.groupBy("band").agg(F.count(F.lit(1)).alias("n"),
                                 F.avg((F.col("amae") * F.col("leverage") > 0.8).cast("double")).alias("consumed_share"))
    return sums.filter(F.col("n") >= floor).join(group_quantiles(b, ["band"], {"mae_med": median("amae")}), "band")


def rules_oos(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Eight structural features, judged in the first period and checked in the second."""
    r = cut(calendar_halves(with_regime(trades, candles)))
    label = F.when(F.col("regime") == 1, "bull").otherwise("bear")
    partial = fc.partial_close("closed_volume", "max_oi", 0.02)
    features = {
        "duration": fc.duration_bucket(), "leverage": fc.leverage_bucket(), "side": F.col("side"),
        "regime x side": F.concat(label, F.lit("+"), F.col("side")), "margin": F.col("isolated"),
        "partial close": F.when(partial, "partial").otherwise("full"), "day of week": fc.weekday("opened_ms"),
        "hour UTC": fc.six_hour_block("opened_ms"),
    }
    return _compare_periods(r, features, "pr")


def rule_rows(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Trades with momentum, distance to the prior MA200 and adverse excursion, halved, with first-period edges."""
    feats = with_features(candles).filter(F.col("i") >= 200)
    ctx = feats.select("symbol", "open_ms", F.col("r24").alias("m24"), F.col("r72").alias("m72"),
                       (F.col("close") / F.col("ma_prior") - 1).alias("ma"))
    joined = as_of(net_returns(trades), candles.join(ctx, ["symbol", "open_ms"], "left"), ["m24", "m72", "ma"])
    known = joined.filter(F.col("m24").isNotNull() & F.col("m72").isNotNull() & F.col("ma").isNotNull())
    df = cut(calendar_halves(excursions(known, candles).drop("mfe")))
    edges = group_quantiles(df.filter(F.col("half") == 0), [], {f"{c}_q": slot_quantile(c, 2, 3) for c in ("m24", "m72", "ma")})
    return df.crossJoin(F.broadcast(edges))  # one row


def overlay(net: str = "net", stop: float | Column = 0.024) -> Column:
    stop = F.lit(stop) if isinstance(stop, float) else stop
    return F.when(F.col("mae") <= -stop, -stop).otherwise(F.col(net))


def conjunctive_rules() -> dict[str, Column]:
    c = F.col
    r1 = (c("m24") > c("m24_q")) & (c("m72") > c("m72_q")) & (c("ma") > c("ma_q"))
    r2 = r1 & (c("leverage") <= 25)
    return {"R1": r1, "R2": r2, "R3": r2 & (c("dur_h") >= 1)}


def rule_overlay(rows: DataFrame, floor: int = 30) -> DataFrame:
    """Five rule sets in two periods: count, mean, median, win rate and sum of the stopped outcome."""
    stopped = overlay()
    sets = [F.struct(F.lit("all").alias("rule"), F.lit(True).alias("ok"), F.col("net").alias("v")),
            F.struct(F.lit("all stopped").alias("rule"), F.lit(True).alias("ok"), stopped.alias("v"))]
    sets += [F.struct(F.lit(n).alias("rule"), c.alias("ok"), stopped.alias("v")) for n, c in conjunctive_rules().items()]
    long = rows.select("half", F.explode(F.array(*sets)).alias("_s")).filter("_s.ok").select("half", "_s.rule", "_s.v")
    keys = ["half", "rule"]
    sums = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), (F.avg((F.col("v") > 0).cast("double")) * 100).alias("wr"),
        F.sum("v").alias("total")).filter(F.col("n") >= floor)
    return sums.join(group_quantiles(long, keys, {"med": median("v")}), keys)


def rule_significance(rows: DataFrame, n_iter: int = 20_000) -> DataFrame:
    second = rows.filter(F.col("half") == 1).withColumn("v", overlay()).withColumn("picked", conjunctive_rules()["R3"])
    return stats.mean_permutation_p(second, "v", "picked", n_iter)


def stop_level_grid(rows: DataFrame, stops: tuple[float, ...] = (0.01, 0.02, 0.024, 0.05, 0.10)) -> DataFrame:
    """Mean outcome per stop level and period, beside no stop."""
    means = F.array(*[F.struct(F.lit(s).alias("stop"), F.avg(overlay(stop=s)).alias("mean_stopped")) for s in stops])
    per = rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), means.alias("_means"), F.avg("net").alias("mean_free"))
    return per.select("half", "n", F.explode("_means").alias("_m"), "mean_free").select("half", "_m.stop", "n", "_m.mean_stopped", "mean_free")


def relative_thresholds(trades: DataFrame, candles: DataFrame, hours: int = 720, share: float = 2 / 3) -> DataFrame:
    """The momentum rule with the symbol's own trailing percentile as threshold; outcome per period."""
    feats = with_features(candles)
    trailing = Window.partitionBy("symbol").orderBy("open_ms").rowsBetween(-hours, -1)
    fired = feats.select("symbol", "open_ms", *[
        (F.col(c) > F.percentile(c, F.lit(share)).over(trailing)).alias(f"hot_{c}") for c in ("r24", "r72")], "i")
    joined = as_of(net_returns(trades), candles.join(fired, ["symbol", "open_ms"], "left"), ["hot_r24", "hot_r72", "i"])
    df = calendar_halves(joined.filter(F.col("i") >= 200)).withColumn(
        "picked", F.coalesce(F.col("hot_r24") & F.col("hot_r72"), F.lit(False)))
    return df.groupBy("half", "picked").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean"))


def entry_containment(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Is the entry price inside the candle of its open? Partial share and duration inside and outside."""
    j = as_of(trades, candles, ["high", "low"]).filter(F.col("low").isNotNull())
    j = j.withColumn("inside", (F.col("avg_cost") >= F.col("low")) & (F.col("avg_cost") <= F.col("high")))
    sums = j.groupBy("inside").agg(
        F.count(F.lit(1)).alias("n"), F.avg(fc.partial_close("closed_volume", "max_oi", 0.02).cast("double")).alias("partial_share"))
    return sums.join(group_quantiles(j, ["inside"], {"dur_med": median("dur_h")}), "inside")


# ---- signals on candles -------------------------------------------------------------------------------------

def _non_overlapping(indices: Column, hold: Column) -> Column:
    """Greedy selection: take an index when it is at least `hold` after the last one taken."""
    start = F.struct(F.lit(-(10**9)).cast("long").alias("last"), F.array().cast("array<bigint>").alias("picks"))
    step = lambda s, i: F.when(i - s["last"] >= hold, F.struct(i.alias("last"), F.concat(s["picks"], F.array(i)).alias("picks"))).otherwise(s)
    return F.aggregate(indices, start, step, lambda s: s["picks"])


def signal_trades(candles: DataFrame, holds: tuple[int, ...] = (24, 48, 72, 120), th24: float = 0.0055,
                  th72: float = 0.0063, fee: float = 0.0008) -> DataFrame:
    """Long entries when the momentum signal fires, one at a time per symbol and holding period.

    A symbol's firing hours are an array bounded by its candles; the selection is a fold over it.
    """
    w = Window.partitionBy("symbol").orderBy("open_ms")
    feats = with_features(candles).withColumn("n_candles", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    ahead = feats.select("symbol", "open_ms", "i", "r24", "r72", "close", "ma_incl", "n_candles",
                         *[F.lead("close", h).over(w).alias(f"_exit{h}") for h in holds])
    exits = cut(ahead.withColumn("_e", F.explode(F.array(*[
        F.struct(F.lit(h).cast("long").alias("hold"), F.col(f"_exit{h}").alias("exit")) for h in holds]))).select(
        "symbol", "open_ms", "i", "r24", "r72", "close", "ma_incl", "n_candles", "_e.hold",
        (F.col("_e.exit") / F.col("close") - 1 - fee).alias("ret")))
    fires = (F.col("i") >= 200) & (F.col("i") < F.col("n_candles") - F.col("hold")) & (F.col("r24") > th24) & (
        F.col("r72") > th72) & (F.col("close") > F.col("ma_incl"))
    picks = exits.filter(fires).groupBy("symbol", "hold").agg(
        F.sort_array(F.collect_list(F.col("i").cast("long"))).alias("_is")).select(
        "symbol", "hold", F.explode(_non_overlapping(F.col("_is"), F.col("hold"))).alias("i"))
    return exits.join(picks, ["symbol", "hold", "i"]).select("symbol", "hold", "i", "open_ms", "ret")


def signal_event_study(trades: DataFrame) -> DataFrame:
    """Per symbol and holding period: n, mean, median, win rate, compounded equity and its drawdown."""
    keys = ["symbol", "hold"]
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    curve = trades.withColumn("_eq", F.product(1 + F.col("ret")).over(upto)).withColumn(
        "_peak", F.greatest(F.lit(1.0), F.max("_eq").over(upto)))
    sums = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("wr"),
        F.product(1 + F.col("ret")).alias("equity"), F.max((F.col("_peak") - F.col("_eq")) / F.col("_peak")).alias("mdd"))
    return sums.join(group_quantiles(trades, keys, {"med": median("ret")}), keys)


def signal_by_year(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Signal result per symbol, hold and year beside buy-and-hold."""
    year = lambda c: F.year(F.timestamp_millis(c))
    w = Window.partitionBy("symbol").orderBy("open_ms")
    hold = candles.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).groupBy(
        "symbol", year("open_ms").alias("year")).agg((F.product(1 + F.col("_r")) - 1).alias("buy_and_hold"))
    sig = trades.groupBy("symbol", "hold", year("open_ms").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.product(1 + F.col("ret")).alias("equity"))
    return sig.join(hold, ["symbol", "year"], "left")


def random_entry_baseline(candles: DataFrame, real: DataFrame, hold: int = 72, n_sims: int = 200, fee: float = 0.0008,
                          seed: int = 1000) -> DataFrame:
    """Random entries at the rule's frequency and holding period: how many simulations do as well?"""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    one = Window.partitionBy("symbol")
    mine = real.filter(F.col("hold") == hold).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("target"), F.avg("ret").alias("real_mean"))
    base = candles.select("symbol", (F.row_number().over(w) - 1).cast("long").alias("i"),
                          (F.lead("close", hold).over(w) / F.col("close") - 1 - fee).alias("ret"),
                          F.count(F.lit(1)).over(one).alias("_n"))
    allowed = base.filter((F.col("i") >= 200) & (F.col("i") < F.col("_n") - hold)).join(mine, "symbol")
    drawn = allowed.withColumn("sim", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_sims).cast("long")))).withColumn(
        "_draw", stats.mix(F.col("sim"), F.col("i"), seed))
    order = Window.partitionBy("symbol", "sim").orderBy("_draw", "i")
    kept = drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.col("target"))
    picks = kept.groupBy("symbol", "sim").agg(F.sort_array(F.collect_list("i")).alias("_is")).select(
        "symbol", "sim", F.explode(_non_overlapping(F.col("_is"), F.lit(hold))).alias("i"))
    sims = picks.join(base.select("symbol", "i", "ret"), ["symbol", "i"]).groupBy("symbol", "sim").agg(F.avg("ret").alias("mean"))
    return sims.join(mine, "symbol").groupBy("symbol", "target", "real_mean").agg(
        F.avg("mean").alias("random_mean"),
        ((F.count(F.when(F.col("mean") >= F.col("real_mean"), 1)) + 1) / F.lit(float(n_sims + 1))).alias("p"))


# ---- composite ranking --------------------------------------------------------------------------------------

def composite_ranking(rows: DataFrame, min_cell: int = 20, top: int = 12, min_n: int = 40, min_alphas: int = 30) -> DataFrame:
    """z(alpha) on net returns against the whole cell, with consistency, trend and risk terms."""
    both = net_returns(rows).filter(F.col("pr").isNotNull())
    keys = ["symbol", "month", "side"]
    sizes = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_cell).drop("_n")
    bench = sizes.join(group_quantiles(both, keys, {"_bench": median("net")}), keys)
    a = both.join(bench, keys, "left").withColumn("alpha", F.col("net") - F.col("_bench"))
    hot = hot_keys(both, ["trader_id"])
    halved = own_halves(a, hot=hot)
    v = F.col("pr")
    per = halved.groupBy("trader_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("alpha").alias("n_alpha"), F.avg("alpha").alias("alpha"), F.avg("pr").alias("pr"),
        F.avg((v > 0).cast("double")).alias("wr"), F.sum("pnl").alias("pnl"), F.max("pnl").alias("_best"),
        *[F.avg(F.when(F.col("half") == h, F.col("alpha"))).alias(f"_m{h}") for h in (0, 1)],
        *[F.count(F.when(F.col("half") == h, F.col("alpha"))).alias(f"_c{h}") for h in (0, 1)],
    ).filter((F.col("n") >= min_n) & (F.col("n_alpha") >= min_alphas))
    per = (
        per.join(group_quantiles(both, ["trader_id"], {"lev_med": median("leverage")}, hot), "trader_id")
        .join(stats.ols_slope(a, ["trader_id"], "opened_ms", "alpha"), "trader_id", "left")
        .withColumn("conc", F.when(F.col("pnl") > 0, F.col("_best") / F.col("pnl") * 100))
    )
    spread = per.agg(F.avg("alpha").alias("_mean"), F.stddev_pop("alpha").alias("_sd"))
    c = F.col
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    consistent = (c("_c0") >= 10) & (c("_c1") >= 10) & (c("_m0") > 0) & (c("_m1") > 0)
    score = (
        3.0 * F.when(c("_sd") > 0, (c("alpha") - c("_mean")) / c("_sd")).otherwise(0.0) + 1.5 * one(consistent)
        + one(c("slope") > 0) - one(c("lev_med") > 25) - 1.5 * one(c("conc") > 40) - 0.5 * one(c("n") < 60))
    return per.crossJoin(F.broadcast(spread)).withColumn("score", score).orderBy(  # one row
        F.col("score").desc(), "trader_id").limit(top).select(
        "trader_id", "n", "alpha", "pr", "wr", "lev_med", "slope", "conc", "score")


# ---- snapshot studies ---------------------------------------------------------------------------------------

def vanished_history(positions: DataFrame, snapshot: DataFrame, older: str, newer: str) -> DataFrame:
    """Positions of the older snapshot that the newer one no longer serves, per exchange."""
    keys = ["exchange", "trader_id", "position_key"]
    old = positions.filter(F.col("snapshot_date") == older)
    new = positions.filter(F.col("snapshot_date") == newer).select(*keys)
    starts = snapshot.filter(F.col("snapshot_date") == newer).select("exchange", "trader_id", "start_time")
    gone = old.join(new, keys, "left_anti").join(starts, ["exchange", "trader_id"], "left").withColumn(
        "_before", F.coalesce(F.col("opened_ms") < F.col("start_time"), F.lit(False)))
    per = gone.groupBy("exchange", "trader_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_before"), 1)).alias("_nb"),
        F.sum(F.when(F.col("_before"), F.col("pnl"))).alias("_pnl"))
    return per.groupBy("exchange").agg(
        F.sum("_n").alias("n_vanished"), F.count(F.lit(1)).alias("n_traders"), F.sum("_nb").alias("n_before_start"),
        F.count(F.when(F.col("_nb") > 0, 1)).alias("n_traders_before"),
        F.count(F.when(F.col("_pnl") < 0, 1)).alias("n_net_negative_before"))


def flag_fire_rates(detected: DataFrame) -> DataFrame:
    """How often each flag fires, among all traders and among the listed."""
    totals = detected.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("listed"), 1)).alias("_listed"))
    fired = detected.select(*SCOPE, "listed", F.explode("flags").alias("flag")).groupBy(*SCOPE, "flag").agg(
        F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("listed"), 1)).alias("n_listed"))
    return fired.join(F.broadcast(totals), SCOPE).select(  # one row per snapshot
        *SCOPE, "flag", "n_all", (F.col("n_all") / F.col("_all") * 100).alias("pct_all"), "n_listed",
        (F.col("n_listed") / F.nullif(F.col("_listed"), F.lit(0)) * 100).alias("pct_listed"))


def _only_gate(gate: str) -> Column:
    return F.size(F.array_except(F.array_intersect("flags", F.array(*[F.lit(b) for b in BAD])), F.array(F.lit(gate)))) == 0


def gate_grid(detected: DataFrame, counts=(3, 10, 47), per_head=(25.0, 50.0, 100.0), shares=(0.25, 0.5, 1.0)) -> DataFrame:
    """Copier gate under a grid of thresholds: traders it fires on, and those it leaves as survivors."""
    grid = F.array(*[F.struct(F.lit(a).alias("min_count"), F.lit(b).alias("max_loss"), F.lit(c).alias("max_share"))
                     for a in counts for b in per_head for c in shares])
    g = detected.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")
    lead = fc.zero_if_null("realized")
    fires = F.coalesce(
        (F.col("copier_pnl") < 0) & (F.col("copier_count_total") >= F.col("min_count"))
        & ((F.col("copier_pnl") / F.nullif(F.col("copier_count_total"), F.lit(0)) <= -F.col("max_loss"))
           | ((lead > 0) & (F.col("copier_pnl") <= -F.col("max_share") * lead))), F.lit(False))
    return g.groupBy(*SCOPE, "min_count", "max_loss", "max_share").agg(
        F.count(F.when(fires, 1)).alias("n_fires"),
        F.count(F.when(~fires & _only_gate("copiers_losing"), 1)).alias("n_survivors"))


def marginal_flag_cost(detected: DataFrame) -> DataFrame:
    """Traders excluded by one disqualifier alone."""
    bad = F.array_intersect("flags", F.array(*[F.lit(b) for b in BAD]))
    return detected.withColumn("_bad", bad).filter(F.size("_bad") == 1).groupBy(
        *SCOPE, F.get("_bad", F.lit(0)).alias("flag")).agg(F.count(F.lit(1)).alias("n_traders"))


def window_alpha(alpha_rows: DataFrame, since_ms: int) -> DataFrame:
    """Alpha and t on recent positions, benchmarked in the full snapshot."""
    recent = alpha_rows.filter((F.col("opened_ms") >= since_ms) & F.col("alpha").isNotNull())
    per = recent.groupBy(*TRADER).agg(F.count(F.lit(1)).alias("n"), F.avg("alpha").alias("alpha"), F.stddev_pop("alpha").alias("_sd"))
    return per.withColumn("t_stat", fc.t_stat(F.col("alpha"), F.col("_sd"), F.col("n"))).drop("_sd")


def clustered_t(alpha_rows: DataFrame) -> DataFrame:
    """t with each (symbol, month, side) cluster counted once by its mean alpha."""
    clusters = alpha_rows.filter(F.col("alpha").isNotNull()).groupBy(*TRADER, "symbol", "month", "side").agg(F.avg("alpha").alias("_m"))
    per = clusters.groupBy(*TRADER).agg(F.count(F.lit(1)).alias("n_clusters"), F.avg("_m").alias("alpha"), F.stddev_pop("_m").alias("_sd"))
    return per.withColumn("t_clustered", fc.t_stat(F.col("alpha"), F.col("_sd"), F.col("n_clusters"))).drop("_sd")


def equity_floor_cost(snapshot: DataFrame, floors: tuple[float, ...] = (1e3, 5e3, 1e4, 1e5, 1e6)) -> DataFrame:
    return snapshot.select(*SCOPE, "aum", F.explode(F.array(*[F.lit(f) for f in floors])).alias("floor")).groupBy(*SCOPE, "floor").agg(
        F.count(F.when(F.col("aum") < F.col("floor"), 1)).alias("n_flagged"), F.count(F.lit(1)).alias("n_traders"))


def copy_scaling(rows: DataFrame, equity: DataFrame, min_notional: DataFrame, capitals: tuple[float, ...] = (500.0, 1000.0, 5000.0)) -> DataFrame:
    """Copying with a capital: orders that fall below the exchange minimum and the worst oversizing."""
    sized = rows.join(equity.select(*TRADER, "aum").filter(F.col("aum") > 0), TRADER).join(min_notional, "symbol")
    g = sized.withColumn("capital", F.explode(F.array(*[F.lit(c) for c in capitals]))).withColumn(
        "_scaled", F.col("notional") * F.col("capital") / F.col("aum"))
    below = F.col("_scaled") < F.col("min_notional")
    return g.groupBy(*TRADER, "capital").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(below, 1)).alias("n_below"),
        F.max(F.when(below & (F.col("_scaled") > 0), F.col("min_notional") / F.col("_scaled"))).alias("worst_oversize"))


def hedge_legs(rows: DataFrame) -> DataFrame:
    """Marks positions that overlap in time with an opposite position of the same trader and symbol.

    Opening and closing instants are put on one time line per trader and symbol and the opposite side's open
    count is read off it: a leg overlaps when an opposite leg is open at its start or starts before its end.
    No pairs are formed. The time line of a hot (trader, symbol) is chunked.
    """
    keys = ["exchange", "snapshot_date", "trader_id", "symbol"]
    closed = rows.filter(F.col("closed_ms").isNotNull() & (F.col("closed_ms") > F.col("opened_ms")))
    slim = closed.select(*keys, "position_key", "side", "opened_ms", "closed_ms")
    # An end (0) comes before a start (2) of the same instant, so that the state just before a start counts the legs that end with it, and the
    # state before an end does not count those that start with it. Each mark asks for the state that its own leg needs: two rows a leg.
    marks = slim.select(*keys, "position_key", "side", F.explode(F.array(
        F.struct(F.col("opened_ms").alias("t"), F.lit(2).alias("o")), F.struct(F.col("closed_ms").alias("t"), F.lit(0).alias("o")))).alias("_m")).select(
        *keys, "position_key", "side", "_m.*")
    unit = F.when(fc.is_long(), F.lit(1).cast("long")).when(~fc.is_long(), F.lit(2**31))  # a leg without a side is opposite to none
    # Opposite legs that started before my end minus those that ended by my start = opposite legs overlapping me.
    hot = hot_keys(slim, keys)
    weighed = marks.withColumns({"_w": F.when(F.col("o") == 2, unit).otherwise(0), "_w2": F.when(F.col("o") == 0, unit).otherwise(0)})
    started = prefix_in_group(weighed, keys, ["t", "o"], "_w", "_started", hot)
    both = prefix_in_group(started, keys, ["t", "o"], "_w2", "_ended", hot)
    long_of = lambda c: (F.col(c) % F.lit(2**31)).cast("long")
    short_of = lambda c: F.floor(F.col(c) / F.lit(2**31)).cast("long")
    opp = lambda c: F.when(fc.is_long(), short_of(c)).otherwise(long_of(c))
    return both.groupBy(*keys, "position_key", "side").agg(
        (F.max(F.when(F.col("o") == 0, opp("_started"))) - F.max(F.when(F.col("o") == 2, opp("_ended")))).alias("n_overlaps"))


def alpha_without_hedges(rows: DataFrame, min_cell: int = 20) -> DataFrame:
    """For traders who hedge: alpha and t of all their positions, and again in a market from which every hedge leg is taken out.

    A leg that overlaps an opposite one hedges, whichever of the two came first or encloses the other. The second benchmark is made of the
    remaining positions of everyone, so neither side of the comparison holds a hedge.
    """
    keys = [*TRADER, "symbol", "position_key"]
    legs = hedge_legs(rows).filter(F.col("n_overlaps") > 0).select(*keys, F.lit(True).alias("_hedge"))
    marked = cut(rows.filter(F.col("pr").isNotNull()).select(*keys, "month", "side", "pr").join(legs, keys, "left"))

    def per_trader(part: DataFrame, tag: str) -> DataFrame:
        cells = cell_table(part, min_cell)
        al = with_alpha(part, cells, leave_self_out(part, cells))
        per = al.groupBy(*TRADER).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.count("_hedge").alias(f"_h_{tag}"), F.count("alpha").alias("_n"),
                                      F.avg("alpha").alias(f"alpha_{tag}"), F.stddev_pop("alpha").alias("_sd"))
        return per.withColumn(f"t_{tag}", fc.t_stat(F.col(f"alpha_{tag}"), F.col("_sd"), F.col("_n"))).drop("_sd", "_n")

    whole = per_trader(marked, "all").filter(F.col("_h_all") > 0).withColumnRenamed("_h_all", "n_hedge_legs")
    return whole.join(per_trader(marked.filter(F.col("_hedge").isNull()), "unhedged").drop("_h_unhedged"), TRADER, "left")


def hedge_overlap(rows: DataFrame) -> DataFrame:
    """Overlapping opposite pairs per snapshot, and the share of traders who hedge."""
    legs = hedge_legs(rows)
    per = legs.groupBy(*TRADER).agg(
        F.sum(F.when(fc.is_long(), F.col("n_overlaps")).otherwise(0)).alias("_pairs"),
        F.count(F.when(F.col("n_overlaps") > 0, 1)).alias("_legs"))
    return per.groupBy(*SCOPE).agg(
        F.sum("_pairs").alias("n_pairs"), F.sum("_legs").alias("n_hedged_legs"),
        F.avg((F.col("_legs") > 0).cast("double")).alias("share_traders"))


def cell_drift(rows: DataFrame, older: str, newer: str, shrink: float = 0.5) -> DataFrame:
    """Rows and median of each cell in two snapshots, flagging benchmarks that shrank."""
    valid = rows.filter(F.col("pr").isNotNull())
    n = valid.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    cells = n.join(group_quantiles(valid, CELL, {"bench": median("pr")}), CELL)
    keys = ["exchange", "symbol", "month", "side"]
    side = lambda d, s: cells.filter(F.col("snapshot_date") == d).select(
        *keys, F.col("n").alias(f"n_{s}"), F.col("bench").alias(f"bench_{s}"))
    both = side(older, "old").join(side(newer, "new"), keys, "full")
    return both.withColumn("shrank", F.col("n_old").isNotNull() & (F.coalesce("n_new", F.lit(0)) < shrink * F.col("n_old")))


def drawdown_bases(window: DataFrame, screens_by_name: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """How many traders each drawdown basis rejects on one population."""
    parts = []
    for name, (screen, passes) in screens_by_name.items():
        judged = window.join(screen, TRADER, "left")
        parts.append(judged.groupBy(*SCOPE).agg(
            F.count(F.when(~passes, 1)).alias("n_rejected"), F.count(F.lit(1)).alias("n_traders")).withColumn("basis", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
