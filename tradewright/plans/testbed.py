"""Maps the star-schema test tables to the canonical inputs of the jobs (positions, listings, candles, ...).

The mapping only renames and derives columns; all rows of the tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewright.config import DAY_MS, HOUR_MS
from tradewright.functions.columns import guarded_price_return, month_of
from tradewright.session import configure, cut

CURRENT, PREVIOUS, EXCHANGE = "2002-01-01", "2000-01-01", "binance"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small file that cannot be split would keep the whole map stage in one task; spread it over the cores.

    With as many splits as cores, as on any large input, this does nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed positions, one per line item; traders are suppliers and symbols are part types."""
    line, part = spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part")
    ship_ms = "unix_millis(cast(l_shipdate as timestamp))"
    month_end_ms = "unix_millis(cast(last_day(cast(l_shipdate as date)) as timestamp)) + 86399000"
    jitter = ("((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber) % 9973 - 4986)"
              " / 9973.0D * 0.004D")
    edge = f"(l_discount - 0.05D) + (l_suppkey % 7 - 3) * 0.002D + (l_tax - 0.04D) / 10.0D + {jitter}"
    return (
        line.join(part.select("p_partkey", "p_type", "p_retailprice"), line.l_partkey == part.p_partkey)
        .select(
            F.lit(EXCHANGE).alias("exchange"),
            F.col("l_suppkey").cast("string").alias("trader_id"),
            F.expr("concat('Supplier#', lpad(cast(l_suppkey as string), 9, '0'))").alias("nick"),
            F.col("p_type").alias("symbol"),
            F.expr("if(l_linestatus = 'O', 'Long', 'Short')").alias("side"),
            F.expr(f"{ship_ms} + (l_orderkey % 86400) * 1000").alias("opened_ms"),
            F.expr("l_quantity * l_linenumber / 4.0D").alias("_dur"),
            F.expr(f"if(l_suppkey % 10 = 0, {month_end_ms}, null)").alias("_month_end"),
            F.col("l_extendedprice").alias("notional"),
            F.expr("cast(l_linenumber * if(l_suppkey % 5 = 0, 5, 3) as double)").alias("leverage"),
            F.expr("if(l_orderkey % 97 = 0, 0.0D, p_retailprice)").alias("avg_cost"),
            F.expr("p_retailprice").alias("_price"),
            F.expr(edge).alias("_edge"),
            F.expr("if(l_linestatus = 'O', 1, -1)").alias("_sign"),
            F.expr("l_returnflag = 'A'").alias("partial"),
            F.col("l_quantity").alias("max_oi"),
            F.expr("l_quantity * if(l_returnflag = 'A', 0.9D, 1.0D)").alias("closed_volume"),
            F.expr("if(l_orderkey % 3 > 0, 'Cross', 'Isolated')").alias("isolated"),
            F.expr("(l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey").alias("position_key"),
            F.col("l_shipdate").cast("date").alias("_ship"), F.col("l_returnflag").alias("_flag"),
        )
        .withColumn("closed_ms", F.coalesce(
            "_month_end", F.col("opened_ms") + (F.col("_dur") * HOUR_MS).cast("long")))
        .withColumn("dur_h", (F.col("closed_ms") - F.col("opened_ms")) / float(HOUR_MS))
        .withColumn("margin", F.col("notional") / F.col("leverage"))
        .withColumn("avg_close", F.col("_price") * (1 + F.col("_sign") * F.col("_edge")))
        .withColumn("pnl", F.col("notional") * (F.col("_edge") - 0.0008))
        .withColumn("roi", F.col("_edge") * F.col("leverage"))
        .withColumn("month", month_of("opened_ms"))
        .drop("_dur", "_month_end", "_price", "_edge", "_sign")
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshot with the guarded price return."""
    return (
        raw_positions(spark, sf_dir).drop("_ship", "_flag")
        .withColumn("snapshot_date", F.lit(CURRENT)).withColumn("pr", guarded_price_return())
    )


def two_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshot and an older one that saw only the positions of its time."""
    dates = F.when(F.col("_ship") < F.lit(PREVIOUS).cast("date"), F.array(F.lit(PREVIOUS), F.lit(CURRENT))).otherwise(
        F.array(F.lit(CURRENT)))
    return (
        raw_positions(spark, sf_dir).withColumn("snapshot_date", F.explode(dates)).drop("_ship", "_flag")
        .withColumn("pr", guarded_price_return())
    )


def trader_snapshot(spark: SparkSession, sf_dir: str, dates: tuple[str, ...] = (CURRENT,)) -> DataFrame:
    """Listing and copier fields per trader; NULL where never measured."""
    return table(spark, sf_dir, "supplier").select(
        F.explode(F.array(*[F.lit(d) for d in dates])).alias("snapshot_date"),
        F.lit(EXCHANGE).alias("exchange"),
        F.col("s_suppkey").cast("string").alias("trader_id"), F.col("s_name").alias("nick"),
        (F.col("s_acctbal") / 10.0).alias("roi"),
        F.expr("cast((s_suppkey * 37) % 100 as double)").alias("mdd"),
        F.expr("case when s_nationkey % 4 = 1 then null else s_nationkey % 4 <> 0 end").alias("listed"),
        F.expr("cast(s_suppkey % 50 as bigint)").alias("copier_count_total"),
        F.expr("if(s_suppkey % 6 = 0, null, s_acctbal - 4000.0D)").alias("copier_pnl"),
        F.expr("if(s_suppkey % 9 = 0, null, 1009843200000 - (s_suppkey % 400) * 86400000)").alias("start_time"),
        F.expr("s_acctbal * 1000.0D").alias("aum"),
    )


def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rows: the returned line items of the last month, with an unrealised PnL (unknown for some)."""
    return (
        raw_positions(spark, sf_dir).filter((F.col("_flag") == "R") & (F.col("_ship") >= F.lit("2001-01-01").cast("date")))
        .select(F.lit(CURRENT).alias("snapshot_date"), "exchange", "trader_id", "symbol", "side", "notional",
                F.expr("if(position_key % 5 = 0, null, pnl * -2.0D)").alias("unrealized_pnl"))
    )


def equity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cumulative PnL per trader, in percent of a fixed principal."""
    from pyspark.sql import Window

    daily = (
        raw_positions(spark, sf_dir).filter(F.col("closed_ms").isNotNull())
        .groupBy("exchange", "trader_id", (F.floor(F.col("closed_ms") / DAY_MS) * DAY_MS).cast("long").alias("ts"))
        .agg(F.sum("pnl").alias("_pnl"))
    )
    w = Window.partitionBy("exchange", "trader_id").orderBy("ts")
    return daily.select(F.lit(CURRENT).alias("snapshot_date"), "exchange", "trader_id", "ts",
                        (F.sum("_pnl").over(w) / 200000.0 * 100.0).alias("value"))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly OHLC of the event values per event type; hours without events are gaps."""
    ev = spread(table(spark, sf_dir, "events")).select(
        F.col("event_type").alias("symbol"), F.col("event_id"), F.col("value"),
        F.expr("unix_millis(cast(ts as timestamp))").alias("ms"))
    order = F.struct("ms", "event_id")
    return (
        ev.groupBy("symbol", (F.floor(F.col("ms") / HOUR_MS) * HOUR_MS).cast("long").alias("open_ms"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
             F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("trades"))
    )


def candle_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per event on the symbol of its event type, entered at the event's value."""
    edge = "((event_id * 7919) % 9973 - 4986) / 9973.0D * 0.08D + (user_id % 7 - 3) * 0.002D"
    return spread(table(spark, sf_dir, "events")).select(
        F.lit(EXCHANGE).alias("exchange"), F.lit(CURRENT).alias("snapshot_date"),
        F.col("event_id").alias("position_key"), F.col("user_id").cast("string").alias("trader_id"),
        F.concat(F.lit("user"), F.col("user_id")).alias("nick"), F.col("event_type").alias("symbol"),
        F.expr("if(event_id % 5 < 3, 'Long', 'Short')").alias("side"),
        F.expr("unix_millis(cast(ts as timestamp))").alias("opened_ms"),
        F.expr("unix_millis(cast(ts as timestamp)) + cast(value * 3600000 as bigint)").alias("closed_ms"),
        F.col("value").alias("dur_h"), F.col("value").alias("avg_cost"),
        F.expr("1000.0D + event_id % 977").alias("notional"),
        F.expr("cast(1 + event_id % 80 as double)").alias("leverage"),
        F.expr(f"(1000.0D + event_id % 977) * ({edge})").alias("pnl"),
        F.expr(f"value * (1 + if(event_id % 5 < 3, 1, -1) * ({edge}))").alias("avg_close"),
        F.expr("if(event_id % 3 > 0, 'Cross', 'Isolated')").alias("isolated"),
        F.expr("cast(1 + event_id % 50 as double)").alias("max_oi"),
        F.expr("(1 + event_id % 50) * if(event_id % 4 = 0, 0.9D, 1.0D)").alias("closed_volume"),
    )


_STAGED: dict[tuple, DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """The stage table of `build(spark, sf_dir)`: written once per application, as the ingest job would."""
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
    if key not in _STAGED:
        _STAGED[key] = cut(build(spark, sf_dir))
    return _STAGED[key]


def forget_stages() -> None:
    """Makes the next query write its stage tables again (for timing)."""
    _STAGED.clear()
