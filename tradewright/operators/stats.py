"""Rank statistics and resampling over per-trader tables, distributed at any number of traders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.operators.ordering import (
    average_rank, exclusive_prefix, global_positions, group_quantiles, hot_keys, index_quantile, ordinal_rank, prefix_in_group, value_ranks,
)
from tradewright.operators import resampling
from tradewright.session import cut

# Fixed values of the portable draw: plain integer arithmetic below 2**62, so any SQL engine repeats it.
MODULUS = resampling.MODULUS


def mix(step: Column, slot: Column, seed: int) -> Column:
    """Deterministic pseudo-random integer in [0, MODULUS) for (step, slot)."""
    h = ((slot + 1) * 1103515245 + (step + 1) * 12345677 + seed) % MODULUS
    h = (h * h + slot) % MODULUS
    h = (h * 48271 + step) % MODULUS
    return (h * h + slot * 7) % MODULUS


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson, 0 where a side is constant."""
    return F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))


def ranked(df: DataFrame, columns: list[str], ties: str = "average", keys: list[str] | None = None,
           ident: str = "trader_id") -> DataFrame:
    """Adds rank_<column>; ties share their mean rank, or (ordinal) follow the ident."""
    for c in columns:
        if ties == "average":
            df = average_rank(df, keys or [], c, f"rank_{c}")
        else:
            df = ordinal_rank(df, keys or [], c, ident, f"rank_{c}")
    return df


def spearman(df: DataFrame, pairs: dict[str, tuple[str, str]], ties: str = "average") -> DataFrame:
    """One row: n and one rank correlation per named pair."""
    columns = sorted({c for pair in pairs.values() for c in pair})
    r = ranked(cut(df.select("trader_id", *columns)), columns, ties)
    return r.agg(F.count(F.lit(1)).alias("n"),
                 *[correlation(f"rank_{a}", f"rank_{b}").alias(name) for name, (a, b) in pairs.items()])


def numbered(df: DataFrame, ident: str = "trader_id") -> DataFrame:
    """Adds `slot`: 0-based position by ident as text."""
    return global_positions(df.withColumn("_ident", F.col(ident).cast("string")), ["_ident"], "slot").drop("_ident")


def _repeated(df: DataFrame, n_iter: int, seed: int) -> DataFrame:
    """Every row once per iteration with its draw; the number of iterations is a fixed parameter."""
    return df.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_iter).cast("long")))).withColumn(
        "draw", mix(F.col("step"), F.col("slot"), seed))


def _shuffled(df: DataFrame, n_iter: int, seed: int) -> DataFrame:
    """`place`: position of each row in the iteration's random order."""
    chunked = _repeated(df, n_iter, seed).withColumn("_chunk", F.floor(F.col("draw") / 2**26).cast("int"))
    return exclusive_prefix(chunked, ["step"], "_chunk", ["draw", "slot"], F.lit(1), "place").drop("_chunk")


def _held(base: DataFrame, columns: list[str], limit: int) -> list | None:
    """The columns as Arrow arrays in order of slot, if the table has at most `limit` rows."""
    if base.count() > limit:
        return None
    rows = base.select("slot", *columns).toArrow().sort_by("slot")  # at most `limit` rows of a few numbers
    return [rows.column(c).combine_chunks() for c in columns]


def permutation_p(df: DataFrame, a: str, b: str, n_iter: int = 10_000, seed: int = 42, ident: str = "trader_id",
                  held_rows: int = resampling.HELD_ROWS) -> DataFrame:
    """Two-sided permutation p of the rank correlation: (hits + 1) / (n_iter + 1).

    A task works its iterations out over the whole table; only a table of more than `held_rows` rows is put in order by a shuffle an iteration.
    """
    base = cut(numbered(ranked(cut(df.select(ident, a, b)), [a, b]), ident).select(
        "slot", F.col(f"rank_{a}").alias("x"), F.col(f"rank_{b}").alias("y")))
    observed = base.agg(F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("rho"))
    held = _held(base, ["x", "y"], held_rows)
    if held is None:
        partners = base.select(F.col("slot").alias("place"), F.col("y").alias("py"))
        sims = _shuffled(base.select("slot", "x"), n_iter, seed).join(partners, "place").groupBy("step").agg(
            correlation("x", "py").alias("r"))
    else:
        x, y = (v.cast("double").to_numpy(zero_copy_only=False) for v in held)
        sims = resampling.per_step(df.sparkSession, n_iter if len(x) else 0, resampling.permuted, (x, y), seed)
    return sims.join(F.broadcast(observed)).groupBy("n", "rho").agg(  # one row
        ((F.count(F.when(F.abs("r") >= F.abs("rho") - 1e-12, 1)) + 1) / F.lit(float(n_iter + 1))).alias("p"))


def bootstrap_ci(df: DataFrame, a: str, b: str, n_iter: int = 2_000, seed: int = 42, ident: str = "trader_id",
                 held_rows: int = resampling.HELD_ROWS) -> DataFrame:
    """95% interval of the rank correlation; ranks are recomputed inside every resample."""
    base = cut(numbered(df.select(ident, a, b), ident))
    held = _held(base, [a, b], held_rows)
    if held is None:
        sims = _resample_ranks(base, a, b, n_iter, seed)
    else:
        sims = resampling.per_step(df.sparkSession, n_iter if len(held[0]) else 0, resampling.resampled, tuple(v.cast("double") for v in held), seed)
    return group_quantiles(sims.select("r"), [], {
        "ci_low": index_quantile("r", 0.025), "ci_high": index_quantile("r", 0.975)})


def _resample_ranks(base: DataFrame, a: str, b: str, n_iter: int, seed: int) -> DataFrame:
    """`r` of each resample, by shuffles."""
    n = base.agg(F.count(F.lit(1)).alias("n"))
    drawn = (
        _repeated(base.select("slot"), n_iter, seed).join(F.broadcast(n))  # one row
        .select("step", (F.col("draw") % F.col("n")).alias("slot"))
        .groupBy("step", "slot").agg(F.count(F.lit(1)).alias("copies"))
    )
    sample = cut(drawn.join(base.select("slot", a, b), "slot"))
    for c in (a, b):
        counts = sample.groupBy("step", c).agg(F.sum("copies").alias("c"))
        ranks = prefix_in_group(counts, ["step"], [c], "c", "lo", hot_keys(counts, ["step"])).select(
            "step", c, (F.col("lo") + (F.col("c") + 1) / 2.0).alias(f"rank_{c}"))
        sample = sample.join(ranks, ["step", c])
    x, y, w = F.col(f"rank_{a}"), F.col(f"rank_{b}"), F.col("copies")
    sims = sample.groupBy("step").agg(
        F.sum(w).alias("_n"), F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"), F.sum(w * x * y).alias("_xy"),
        F.sum(w * x * x).alias("_xx"), F.sum(w * y * y).alias("_yy"))
    m = F.col("_n")
    spread = (m * F.col("_xx") - F.col("_x") ** 2) * (m * F.col("_yy") - F.col("_y") ** 2)
    rho = F.when(spread > 0, (m * F.col("_xy") - F.col("_x") * F.col("_y")) / F.sqrt(spread)).otherwise(F.lit(0.0))
    return sims.select(rho.alias("r"))


def mean_permutation_p(df: DataFrame, value: str, label: str, n_iter: int = 20_000, seed: int = 11,
                       ident: str = "position_key") -> DataFrame:
    """Two-sided permutation p of the difference of means between label true and false."""
    base = cut(numbered(df.select(ident, value, label), ident))
    observed = cut(base.agg(
        F.count(F.when(F.col(label), 1)).alias("n_a"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(label), F.col(value))).alias("mean_a"), F.avg(F.when(~F.col(label), F.col(value))).alias("mean_b")))
    sims = _split_sums(base.select("slot", F.col(value).alias("v")), observed.select("n_a", "n"), n_iter, seed).select(
        F.abs(F.try_divide("sum_a", "in_a") - F.try_divide("sum_b", "in_b")).alias("gap"))
    hits = sims.join(F.broadcast(observed)).agg(
        F.count(F.when(F.col("gap") >= F.abs(F.col("mean_a") - F.col("mean_b")) - 1e-15, 1)).alias("hits"))
    return observed.crossJoin(hits).select(  # two one-row tables
        "n_a", (F.col("n") - F.col("n_a")).alias("n_b"), "mean_a", "mean_b",
        ((F.col("hits") + 1) / F.lit(float(n_iter + 1))).alias("p"))


def _split_sums(df: DataFrame, sizes: DataFrame, n_iter: int, seed: int) -> DataFrame:
    """Per iteration: sum and count of `v` over the `n_a` rows with the smallest draws (sum_a, in_a) and over the others (sum_b, in_b).

    Draws are summed per iteration and chunk of draws where they are made; chunks are narrow around the expected n_a-th draw.
    Only the rows of the chunk that holds the n_a-th draw are put in order.
    """
    n, n_a = F.greatest(F.col("n"), F.lit(1)).cast("double"), F.col("n_a")
    width = F.greatest(F.sqrt(n_a * (n - n_a) / n) * (1.5 * MODULUS) / n, F.lit(1.0))
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(  # one row
        sizes.select((n_a * float(MODULUS) / n).alias("_middle"), width.alias("_width"))))
    chunk = F.floor((F.col("draw") - F.col("_middle")) / F.col("_width"))
    drawn = _repeated(spread, n_iter, seed).select(
        "slot", "v", "draw", (F.col("step") * 16 + F.greatest(F.least(chunk, F.lit(5)), F.lit(-5)) + 8).alias("_key"))
    step = F.floor(F.col("_key") / 16).alias("step")
    before = Window.partitionBy("step").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut(
        drawn.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"), F.sum("v").alias("s"), F.count("v").alias("m"))
        .select(step, "*").withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .join(F.broadcast(sizes.select("n_a"))).withColumn("_left", n_a - F.col("_before")))
    mixed = (F.col("_left") > 0) & (F.col("_left") < F.col("_rows"))
    ordered = Window.partitionBy("_key").orderBy("draw", "slot")
    edges = drawn.join(F.broadcast(chunks.filter(mixed).select("_key", "_left")), "_key").select(  # at most one row per iteration
        step, (F.row_number().over(ordered) <= F.col("_left")).alias("a"), F.col("v").alias("s"),
        F.when(F.col("v").isNotNull(), 1).otherwise(0).cast("long").alias("m"))
    parts = chunks.filter(~mixed).select("step", (F.col("_left") > 0).alias("a"), "s", "m").unionByName(edges)
    return parts.groupBy("step").agg(*[
        F.sum(F.when(side, F.col(c))).alias(f"{out}_{name}")
        for name, side in (("a", F.col("a")), ("b", ~F.col("a"))) for c, out in (("s", "sum"), ("m", "in"))])


def rank_sum_z(rank_sum: Column, na: Column, nb: Column, floor: int = 20) -> Column:
    """z of a rank sum over na rows against nb others; 0 where either side is small."""
    u = rank_sum - na * (na + 1) / 2.0
    return F.when((na >= floor) & (nb >= floor), (u - na * nb / 2.0) / F.sqrt(na * nb * (na + nb + 1) / 12.0)).otherwise(F.lit(0.0))


def mann_whitney_cells(df: DataFrame, keys: list[str], cell: str, value: str, floor: int = 20) -> DataFrame:
    """z of every cell against the rest of its group, from one ranking per group."""
    counts = df.groupBy(*keys, value, cell).agg(F.count(F.lit(1)).alias("_cc"))
    ranks = value_ranks(df, keys, value).select(*keys, value, (F.col("lo") + (F.col("c") + 1) / 2.0).alias("_rank"))
    per_cell = counts.join(ranks, [*keys, value]).groupBy(*keys, cell).agg(
        F.sum(F.col("_cc") * F.col("_rank")).alias("_r"), F.sum("_cc").alias("_na"))
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    na, nb = F.col("_na"), F.col("_n") - F.col("_na")
    z = rank_sum_z(F.col("_r"), na, nb, floor)
    return per_cell.join(totals, keys).select(*keys, cell, F.col("_na").alias("n_cell"), nb.alias("n_rest"), z.alias("z"))


def ols_slope(df: DataFrame, keys: list[str], time: str, value: str, min_rows: int = 10) -> DataFrame:
    """Least-squares slope on time scaled to [0, 1]; NULL with too few rows or a single instant."""
    agg = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(value, F.col(time) / F.lit(1e12)).alias("_slope"),
        F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    return agg.select(*keys, F.when((F.col("_n") >= min_rows) & (F.col("_hi") > F.col("_lo")),
                                    F.col("_slope") * (F.col("_hi") - F.col("_lo")) / F.lit(1e12)).alias("slope"))


def halves_profile(df: DataFrame, value: str, min_rows: int, keys: list[str] | None = None, one_sided_ok: bool = False) -> DataFrame:
    """Per trader: wr, payoff and expectancy of each half (columns wr1, wr2, ...), both halves qualifying.

    `df` has a 0/1 column `half`.
    """
    keys = keys or ["trader_id"]
    v = F.col(value)
    per = df.groupBy(*keys, "half").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("exp"), F.avg((v > 0).cast("double")).alias("wr"),
        F.avg(F.when(v > 0, v)).alias("_w"), F.avg(F.when(v < 0, v)).alias("_l"))
    ok = F.col("n") >= min_rows
    if not one_sided_ok:
        ok = ok & F.col("_w").isNotNull() & F.col("_l").isNotNull()
    per = per.filter(ok).withColumn("payoff", F.col("_w") / F.abs("_l"))
    wide = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_halves"),
        *[F.max(F.when(F.col("half") == h, F.col(c))).alias(f"{c}{h + 1}")
          for h in (0, 1) for c in ("n", "wr", "payoff", "exp")])
    return wide.filter(F.col("_halves") == 2).drop("_halves")


def detectable_rho(df: DataFrame, n: str) -> DataFrame:
    """Smallest correlation found with 80% power among n traders."""
    return df.withColumn("rho_min", F.when(F.col(n) > 3, F.tanh(F.lit(2.8) / F.sqrt(F.col(n) - 3.0))))
