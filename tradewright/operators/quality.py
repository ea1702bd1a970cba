"""Deduplication with explicit survivors, drop accounting, snapshot gates and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.config import SCOPE, TRADER
from tradewright.operators.ordering import AUTO, group_quantiles, index_quantile, median


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keeps the first row of each key by `order`; rows with a NULL key have no identity and all pass.

    The rank limit keeps one row per key and task before the shuffle, so a key with many copies stays cheap.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    first = Window.partitionBy(*keys).orderBy(*order)
    unique = df.filter(known).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")
    return unique.unionByName(df.filter(~known))


def first_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return dedup(df, keys, [F.col(position).asc()])


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return dedup(df, keys, [F.col(position).desc()])


def missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.agg(F.count(F.when(missing, 1)).alias("n_missing_key"), F.count(F.lit(1)).alias("n_rows"))


def drop_reason(bound: float = 3.0) -> Column:
    """First reason to drop a position of a ratio-based source; NULL keeps it."""
    unread = F.lit(False)
    for c in ("pnl", "roi", "leverage", "opened_ms", "closed_ms", "margin"):
        unread = unread | F.col(c).isNull()
    return (
        F.when(unread, "parse").when(F.col("leverage") <= 0, "lev<=0")
        .when(~F.lower(F.coalesce("side", F.lit(""))).isin("long", "short"), "side")
        .when(F.abs(F.col("roi") / F.col("leverage")) > bound, "|pr|>3")
    )


def load_with_accounting(df: DataFrame, bound: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(kept rows with pr, count per bucket). Each row is in exactly one bucket."""
    judged = df.withColumn("drop_reason", drop_reason(bound))
    kept = judged.filter(F.col("drop_reason").isNull()).drop("drop_reason").withColumn(
        "pr", F.col("roi") / F.col("leverage"))
    return kept, judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def validate_snapshots(summary: DataFrame, required: str = "binance", low: float = 0.5, high: float = 1.5) -> DataFrame:
    """Violations per snapshot: the required exchange missing, an exchange that vanished, sizes out of range."""
    dates = summary.select("snapshot_date").distinct()
    exchanges = summary.select("exchange").distinct()
    grid = dates.crossJoin(exchanges)  # a handful of dates times a handful of exchanges
    w = Window.partitionBy("exchange").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(summary.select(*SCOPE, "n_traders", "n_positions"), SCOPE, "left")
    for c in ("n_traders", "n_positions"):
        filled = filled.withColumn(f"prev_{c}", F.last(c, ignorenulls=True).over(w))

    def off(c: str) -> Column:
        prev = F.nullif(F.col(f"prev_{c}"), F.lit(0))
        return F.col(c).isNotNull() & ((F.col(c) < low * prev) | (F.col(c) > high * prev))

    gone = F.col("n_positions").isNull()
    found = F.array_compact(F.array(
        F.when(gone & (F.col("exchange") == required), "required_missing"),
        F.when(gone & F.col("prev_n_positions").isNotNull(), "vanished"),
        F.when(off("n_traders"), "n_traders"), F.when(off("n_positions"), "n_positions")))
    return filled.select(*SCOPE, F.explode(found).alias("violation"))


def recompute_cap_flags(closed: DataFrame, open_rows: DataFrame, manifest: DataFrame, cap: int = 100) -> DataFrame:
    """History length per trader: closed rows plus open rows that came from history (they carry a close time)."""
    n_closed = closed.groupBy("trader_id").agg(F.count(F.lit(1)).alias("_closed"))
    n_open = open_rows.filter(F.col("close_time").isNotNull()).groupBy("trader_id").agg(F.count(F.lit(1)).alias("_open"))
    n_hist = F.coalesce("_closed", F.lit(0)) + F.coalesce("_open", F.lit(0))
    return (
        manifest.join(n_closed, "trader_id", "left").join(n_open, "trader_id", "left")
        .withColumn("n_hist", n_hist).withColumn("closed_capped", F.col("n_hist") >= cap).drop("_closed", "_open")
    )


def headline_vs_computed(rows: DataFrame, headline: DataFrame) -> DataFrame:
    sums = rows.groupBy(*TRADER).agg(F.sum("pnl").alias("computed_pnl"))
    return sums.join(headline, TRADER, "left").withColumn(
        "ratio", F.col("computed_pnl") / F.nullif(F.col("headline_pnl"), F.lit(0.0)))


def internal_pnl_identity(rows: DataFrame) -> DataFrame:
    """Realised PnL over closed PnL minus fees, per trader."""
    return rows.groupBy(*TRADER).agg(
        F.sum("pnl").alias("realized"),
        F.sum(F.col("closed_pnl") - F.col("exchange_fee") - F.col("funding_fee")).alias("recomputed"),
    ).withColumn("ratio", F.col("realized") / F.nullif(F.col("recomputed"), F.lit(0.0)))


def net_vs_gross(rows: DataFrame, keys: list[str], hot=AUTO) -> DataFrame:
    """Reported net PnL against the gross move of the prices: residual in bps, its sign, and sign flips."""
    gross = F.col("notional") * (F.col("avg_close") / F.col("avg_cost") - 1) * F.when(
        F.lower("side") == "long", 1).otherwise(-1)
    priced = rows.filter((F.col("avg_cost") > 0) & (F.col("notional") > 0)).withColumn("_gross", gross).withColumn(
        "bps", (F.col("pnl") - F.col("_gross")) / F.col("notional") * 10000)
    shares = priced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("bps") < 0).cast("double")).alias("share_negative"),
        F.avg((F.signum("pnl") != F.signum("_gross")).cast("double")).alias("share_sign_flip"))
    return shares.join(group_quantiles(priced, keys, {"bps_median": median("bps")}, hot), keys)


def overview(rows: DataFrame) -> DataFrame:
    """One row about the whole input: traders, positions, range, sizes, leverage, margin mode."""
    per_trader = rows.groupBy("trader_id").agg(F.count(F.lit(1)).alias("n_pos"))
    base = rows.agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.min(F.to_date(F.timestamp_millis("opened_ms"))).alias("first_day"),
        F.max(F.to_date(F.timestamp_millis("opened_ms"))).alias("last_day"),
        F.max("leverage").alias("lev_max"),
        (F.avg((F.col("isolated") == "Isolated").cast("double")) * 100).alias("pct_isolated"))
    traders = per_trader.agg(F.count(F.lit(1)).alias("n_traders"), F.max("n_pos").alias("n_pos_max"))
    lev = group_quantiles(rows, [], {"lev_med": median("leverage"), "lev_p90": index_quantile("leverage", 0.9)})
    sizes = group_quantiles(per_trader, [], {"n_pos_med": median("n_pos")})
    return base.crossJoin(traders).crossJoin(lev).crossJoin(sizes)  # four one-row tables


def universe_funnel(listing: DataFrame, positions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Traders per snapshot at each step: listed, with positions, with metrics."""
    steps = [("1 listed", listing), ("2 with positions", positions), ("3 with metrics", metrics)]
    parts = [
        df.select(*TRADER).distinct().groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_traders"))
        .withColumn("step", F.lit(name)) for name, df in steps]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in excess of distinct keys."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                       (F.sum("_n") - F.count(F.lit(1))).alias("n_excess"))


def open_sums(open_rows: DataFrame, missing_is_zero: bool = False) -> DataFrame:
    """Open positions per trader: sum, loss sum, count, and whether any unrealised PnL is known."""
    upl = F.coalesce("unrealized_pnl", F.lit(0.0)) if missing_is_zero else F.col("unrealized_pnl")
    return open_rows.groupBy(*TRADER).agg(
        F.coalesce(F.sum(upl), F.lit(0.0)).alias("upl_sum"),
        F.coalesce(F.sum(F.when(upl < 0, upl)), F.lit(0.0)).alias("upl_neg_sum"),
        F.count(F.lit(1)).alias("n_open"), F.bool_or(upl.isNotNull()).alias("has_upl"))
