"""Closed and open positions of six exchanges, from raw or shaped JSON lines to canonical columns.

Numbers arrive as text; anything unreadable becomes NULL. Ids are text everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.functions import columns as fc
from tradewright.operators.quality import dedup, first_wins, last_wins
from tradewright.sources.lines import parse, rows_of

BINANCE_RAW = (
    "portfolioId string, nick string, roi double, pnl double, aum double, winRate double, mdd double, n_pos int, "
    "positions array<struct<symbol:string, side:string, leverage:string, isolated:string, avgCost:string, "
    "avgClosePrice:string, closingPnl:string, roi:string, maxOpenInterest:string, closedVolume:string, "
    "opened:bigint, closed:bigint>>")
PHEMEX_RAW = (
    "userId string, nick string, n_pos int, positions array<struct<positionId:string, symbol:string, currency:string, "
    "side:string, posSide:string, size:string, closedPnl:string, exchangeFee:string, fundingFee:string, "
    "realizedPnl:string, openPrice:string, closePrice:string, openPositionVal:string, margin:string, roi:string, "
    "openedTime:bigint, createdAt:bigint, updatedTime:bigint, closedTime:bigint>>")
OKX_ROW = (
    "uniqueCode string, nickName string, leadDays string, subPosId string, instId string, posSide string, lever string, "
    "mgnMode string, margin string, openAvgPx string, closeAvgPx string, openTime string, closeTime string, pnl string, "
    "pnlRatio string, subPos string, ccy string, upl string")
BYBIT_ROW = (
    "leaderMark string, leaderUserId string, nickName string, orderId string, symbol string, side string, leverage double, "
    "entry_price double, close_price double, size double, pnl_usd double, roi double, margin double, open_fee double, "
    "close_fee double, funding_fee double, started_ms bigint, closed_ms bigint, follower_num int, full_closed boolean, upl double")
BITGET_ROW = (
    "traderUid string, displayName string, orderNo string, symbolId string, productCode string, side string, "
    "openLevel string, openAvgPrice string, closeAvgPrice string, openDealCount string, closeDealCount string, netProfit string, "
    "returnRate string, openFee string, closeFee string, capitalFee string, openMarginCount string, openTime string, "
    "closeTime string, marginMode string, position int, teacherId string, teacherName string")
KUCOIN_ROW = (
    "leadConfigId string, nickName string, symbol string, side string, positionSide string, leverage double, marginMode string, "
    "pnl double, pnlRatio double, posMargin double, closeQty double, avgEntryPrice double, avgClosePrice double, "
    "multiplier double, currency string, startTime bigint, endTime bigint, unrealisedPnl string")

CANONICAL = ["exchange", "trader_id", "nick", "symbol", "side", "opened_ms", "closed_ms", "dur_h", "notional", "leverage",
             "margin", "avg_cost", "avg_close", "pnl", "roi", "position_key", "file_pos"]


def _canonical(df: DataFrame, exchange: str, **columns: Column) -> DataFrame:
    out = df.select("file_pos", *[c.alias(name) for name, c in columns.items()]).withColumn("exchange", F.lit(exchange))
    if "dur_h" not in columns:
        out = out.withColumn("dur_h", fc.duration_h("opened_ms", "closed_ms"))
    extra = [c for c in out.columns if c not in CANONICAL]
    return out.select(*CANONICAL, *extra)


def read_binance(lines: DataFrame) -> DataFrame:
    """No id is published: a digest of what a position doesn't change is its key, and rows equal in all of it share one."""
    rows = rows_of(parse(lines, BINANCE_RAW).select("r.*", "file_pos"), "positions",
                   ["portfolioId", "nick", "roi", "pnl", "aum", "winRate", "mdd"])
    p = lambda c: F.col(f"p.{c}")
    lev = F.coalesce(F.nullif(fc.to_double(p("leverage")), F.lit(0.0)), F.lit(1.0))
    notional = fc.to_double(p("maxOpenInterest")) * fc.to_double(p("avgCost"))
    own = [F.col("portfolioId"), *map(p, ("symbol", "side", "opened", "closed", "avgCost", "avgClosePrice", "maxOpenInterest", "closedVolume"))]
    key = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in own]))
    return _canonical(
        rows, "binance", trader_id=F.col("portfolioId"), nick=F.col("nick"), symbol=p("symbol"), side=p("side"),
        opened_ms=p("opened"), closed_ms=p("closed"), notional=notional, leverage=lev, margin=notional / lev,
        avg_cost=fc.to_double(p("avgCost")), avg_close=fc.to_double(p("avgClosePrice")), pnl=fc.to_double(p("closingPnl")),
        roi=fc.to_double(p("roi")), position_key=key, isolated=p("isolated"),
        max_oi=fc.to_double(p("maxOpenInterest")), closed_volume=fc.to_double(p("closedVolume")),
        partial=fc.partial_close(fc.to_double(p("closedVolume")), fc.to_double(p("maxOpenInterest"))),
        p_roi=F.col("roi"), p_pnl=F.col("pnl"), p_aum=F.col("aum"), p_win_rate=F.col("winRate"), p_mdd=F.col("mdd"))


def read_phemex(lines: DataFrame, funnel_side: bool = False) -> DataFrame:
    """`funnel_side` takes Buy/Sell as the side, because posSide may be Merged."""
    rows = rows_of(parse(lines, PHEMEX_RAW).select("r.*", "file_pos"), "positions", ["userId", "nick"])
    p = lambda c: F.col(f"p.{c}")
    notional, margin = fc.to_double(p("openPositionVal")), fc.to_double(p("margin"))
    by_order = F.when(p("side") == "Buy", "Long").when(p("side") == "Sell", "Short")
    out = _canonical(
        rows, "phemex", trader_id=F.col("userId"), nick=F.col("nick"), symbol=p("symbol"),
        side=by_order if funnel_side else p("posSide"),
        opened_ms=F.coalesce(F.nullif(p("openedTime"), F.lit(0)), p("createdAt")),
        closed_ms=F.coalesce(F.nullif(p("updatedTime"), F.lit(0)), p("closedTime")), notional=notional,
        leverage=fc.derived_leverage(notional, margin), margin=margin, avg_cost=fc.to_double(p("openPrice")),
        avg_close=fc.to_double(p("closePrice")), pnl=fc.to_double(p("realizedPnl")), roi=fc.to_double(p("roi")),
        position_key=p("positionId"), closed_pnl=fc.to_double(p("closedPnl")), exchange_fee=fc.to_double(p("exchangeFee")),
        funding_fee=fc.to_double(p("fundingFee")))
    # Position ids are scoped per trader.
    return first_wins(out, ["trader_id", "position_key"], "file_pos")


def read_okx(lines: DataFrame) -> DataFrame:
    r = parse(lines, OKX_ROW).select("r.*", "file_pos")
    lev = F.coalesce(F.nullif(fc.to_double("lever"), F.lit(0.0)), F.lit(1.0))
    out = _canonical(
        r, "okx", trader_id=F.col("uniqueCode"), nick=F.col("nickName"), symbol=F.col("instId"), side=F.col("posSide"),
        opened_ms=fc.to_long("openTime"), closed_ms=fc.to_long("closeTime"), notional=fc.to_double("margin") * lev,
        leverage=lev, margin=fc.to_double("margin"), avg_cost=fc.to_double("openAvgPx"), avg_close=fc.to_double("closeAvgPx"),
        pnl=fc.to_double("pnl"), roi=fc.to_double("pnlRatio"), position_key=F.col("subPosId"), lead_days=fc.to_double("leadDays"))
    return first_wins(out, ["trader_id", "position_key"], "file_pos")


def read_bybit(lines: DataFrame) -> DataFrame:
    """Rows without an order id have no identity and pass undeduplicated."""
    r = parse(lines, BYBIT_ROW).select("r.*", "file_pos")
    out = _canonical(
        r, "bybit", trader_id=F.col("leaderMark"), nick=F.col("nickName"), symbol=F.col("symbol"), side=F.col("side"),
        opened_ms=F.col("started_ms"), closed_ms=F.col("closed_ms"), notional=F.col("margin") * F.col("leverage"),
        leverage=F.col("leverage"), margin=F.col("margin"), avg_cost=F.col("entry_price"), avg_close=F.col("close_price"),
        pnl=F.col("pnl_usd"), roi=F.col("roi"), position_key=F.col("orderId"))
    return first_wins(out, ["position_key"], "file_pos")


def is_raw_row() -> Column:
    """An undecoded Bitget row carries the API's own `position` or `teacherName`."""
    return F.col("position").isNotNull() | F.col("teacherName").isNotNull()


def read_bitget(lines: DataFrame) -> DataFrame:
    """Shaped and raw rows in one file: raw ones are decoded, and a shaped row always beats a raw duplicate."""
    r = parse(lines, BITGET_ROW).select("r.*", "file_pos").withColumn("is_raw", is_raw_row())
    raw_side = F.when(F.col("position") == 1, "long").when(F.col("position") == 0, "short")
    rate = fc.to_double("returnRate")
    out = _canonical(
        r, "bitget", trader_id=F.coalesce("traderUid", "teacherId"), nick=F.coalesce("displayName", "teacherName"),
        symbol=F.col("productCode"), side=F.when(F.col("is_raw"), raw_side).otherwise(F.col("side")),
        opened_ms=fc.to_long("openTime"), closed_ms=fc.to_long("closeTime"),
        notional=fc.to_double("openMarginCount") * fc.to_double("openLevel"), leverage=fc.to_double("openLevel"),
        margin=fc.to_double("openMarginCount"), avg_cost=fc.to_double("openAvgPrice"), avg_close=fc.to_double("closeAvgPrice"),
        pnl=fc.to_double("netProfit"), roi=F.when(F.col("is_raw"), rate / 100.0).otherwise(rate),
        position_key=F.col("orderNo"), symbol_id=F.col("symbolId"), is_raw=F.col("is_raw"))
    return prefer_shaped(out)


def prefer_shaped(df: DataFrame) -> DataFrame:
    return dedup(df, ["trader_id", "position_key"], [F.col("is_raw").asc(), F.col("file_pos").desc()])


def read_kucoin(lines: DataFrame) -> DataFrame:
    """No id is published; trader, symbol and both times identify a position, and the last copy wins."""
    r = parse(lines, KUCOIN_ROW).select("r.*", "file_pos")
    out = _canonical(
        r, "kucoin", trader_id=F.col("leadConfigId"), nick=F.col("nickName"), symbol=F.col("symbol"), side=F.col("side"),
        opened_ms=F.col("startTime"), closed_ms=F.col("endTime"), notional=F.col("posMargin") * F.col("leverage"),
        leverage=F.col("leverage"), margin=F.col("posMargin"), avg_cost=F.col("avgEntryPrice"), avg_close=F.col("avgClosePrice"),
        pnl=F.col("pnl"), roi=F.col("pnlRatio"), position_key=F.concat_ws("|", "leadConfigId", "symbol", "startTime", "endTime"))
    return last_wins(out, ["trader_id", "symbol", "opened_ms", "closed_ms"], "file_pos")


def read_open_upl(lines: DataFrame, exchange: str) -> DataFrame:
    """Open rows as (exchange, trader_id, unrealized_pnl). OKX and KuCoin read failures as zero; Bybit stays unknown."""
    schema, trader, upl = {"okx": (OKX_ROW, "uniqueCode", "upl"), "kucoin": (KUCOIN_ROW, "leadConfigId", "unrealisedPnl"),
                           "bybit": (BYBIT_ROW, "leaderMark", "upl")}[exchange]
    r = parse(lines, schema).select("r.*")
    value = fc.to_double(upl) if exchange == "bybit" else fc.zero_if_null(fc.to_double(upl))
    return r.select(F.lit(exchange).alias("exchange"), F.col(trader).alias("trader_id"), value.alias("unrealized_pnl"))


def split_closed_open(history: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OKX history rows without a close time are still open; the current list wins on the same position."""
    closed = history.filter(F.col("closed_ms").isNotNull())
    still = history.filter(F.col("closed_ms").isNull())
    known = current.filter(F.col("position_key").isNotNull()).select("trader_id", "position_key")
    return closed, current.unionByName(still.join(known, ["trader_id", "position_key"], "left_anti"), allowMissingColumns=True)


def assemble_records(rows: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Back to nested records: one per trader and page of `page_rows` positions, each with the trader's n_pos.

    A trader's positions can be most of the input, so they are paged instead of collected into one record.
    """
    from tradewright.operators.ordering import position_in_group

    placed = position_in_group(rows, ["exchange", "trader_id"], ["opened_ms", "position_key"])
    item = F.struct("opened_ms", "position_key", "symbol", "side", "closed_ms", "leverage", "notional", "pnl")
    return placed.groupBy("exchange", "trader_id", F.floor(F.col("pos") / page_rows).alias("page")).agg(
        F.max("cnt").alias("n_pos"), F.sort_array(F.collect_list(item)).alias("positions"))
