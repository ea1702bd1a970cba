"""API pages: decoders for scaled fields, nested metrics, leaderboards, series, details and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.config import TRADER
from tradewright.functions import columns as fc
from tradewright.operators.quality import first_wins, last_wins
from tradewright.sources.lines import parse, rows_of, text_or_null

# Response codes.
DETAIL_OK, DETAIL_RETIRED = "000000", "11012028"
OKX_NOT_FOUND, BITGET_PROTECTED = "60004", "30066"
TERMINAL_STATUSES = {"okx": ["ok", "not_found"], "kucoin": ["ok", "not_found"], "bybit": ["ok", "protected"], "bitget": ["ok", "protected"]}

BYBIT_HISTORY_PAGE = (
    "leaderMark string, leaderUserId string, nickName string, result struct<openTradeInfoProtection:int, data:array<struct<"
    "orderId:string, symbol:string, side:string, leverageE2:string, entryPrice:string, closedPrice:string, size:string, "
    "orderNetProfitE8:string, orderNetProfitRateE4:string, orderCostE8:string, openCumExecFeeE8:string, "
    "closeCumExecFeeE8:string, cumFundingFeeE8:string, startedTimeE3:string, closedTimeE3:string, followerNum:int, "
    "closedType:string, fullClosed:boolean>>>")
BITGET_HISTORY_PAGE = (
    "traderUid string, displayName string, code string, data struct<nextFlag:boolean, rows:array<struct<orderNo:string, "
    "symbolId:string, productCode:string, position:int, openLevel:string, openAvgPrice:string, closeAvgPrice:string, "
    "netProfit:string, returnRate:string, openMarginCount:string, openFee:string, closeFee:string, capitalFee:string, "
    "openTime:string, closeTime:string>>>")
KUCOIN_HISTORY_PAGE = (
    "leadConfigId string, nickName string, success boolean, code string, data struct<items:array<struct<symbol:string, "
    "positionDirection:string, positionSide:string, leverage:string, marginMode:string, pnl:string, pnlRatio:string, "
    "posMargin:string, closeQty:string, avgEntryPrice:string, avgClosePrice:string, multiplier:string, currency:string, "
    "startTime:bigint, endTime:bigint>>>")
KUCOIN_OPEN_PAGE = (
    "leadConfigId string, nickName string, success boolean, data array<struct<symbol:string, positionDirection:string, "
    "leverage:string, pnl:string, pnlRatio:string, realisedPnl:string, avgEntryPrice:string, markPrice:string, "
    "posMargin:string, position:string, multiplier:string, startTime:bigint, extendPositionResponse:struct<"
    "liquidationPrice:string, cumulativeTradeFee:string, cumulativeFundingFee:string>>>")
BINANCE_DETAIL_PAGE = (
    "portfolioId string, code string, data struct<status:string, copierPnl:string, currentCopyCount:string, "
    "totalCopyCount:string, aumAmount:string, marginBalance:string, fixedAmountMinCopyUsd:string, lastTradeTime:string, "
    "positionShow:boolean>")


def _buy_sell(c: str) -> Column:
    return F.when(F.col(c) == "Buy", "long").when(F.col(c) == "Sell", "short")


def decode_bybit_history(pages: DataFrame) -> DataFrame:
    """Integer-scaled fields; the E3 times are already milliseconds."""
    rows = rows_of(parse(pages, BYBIT_HISTORY_PAGE).select("r.*", "file_pos"), "result.data", ["leaderMark", "leaderUserId", "nickName"])
    return rows.select(
        F.col("leaderMark").alias("trader_id"), F.col("nickName").alias("nick"), F.col("p.orderId").alias("position_key"),
        F.col("p.symbol").alias("symbol"), _buy_sell("p.side").alias("side"), fc.scaled("p.leverageE2", 2).alias("leverage"),
        fc.to_double("p.entryPrice").alias("avg_cost"), fc.to_double("p.closedPrice").alias("avg_close"),
        fc.scaled("p.orderNetProfitE8", 8).alias("pnl"), fc.scaled("p.orderNetProfitRateE4", 4).alias("roi"),
        fc.scaled("p.orderCostE8", 8).alias("margin"), fc.scaled("p.openCumExecFeeE8", 8).alias("open_fee"),
        fc.scaled("p.closeCumExecFeeE8", 8).alias("close_fee"), fc.scaled("p.cumFundingFeeE8", 8).alias("funding_fee"),
        fc.to_long("p.startedTimeE3").alias("opened_ms"), fc.to_long("p.closedTimeE3").alias("closed_ms"), "file_pos")


def decode_bitget_history(pages: DataFrame) -> DataFrame:
    rows = rows_of(parse(pages, BITGET_HISTORY_PAGE).select("r.*", "file_pos"), "data.rows", ["traderUid", "displayName"])
    return rows.select(
        F.col("traderUid").alias("trader_id"), F.col("displayName").alias("nick"), F.col("p.orderNo").alias("position_key"),
        F.col("p.productCode").alias("symbol"), F.col("p.symbolId").alias("symbol_id"),
        F.when(F.col("p.position") == 1, "long").when(F.col("p.position") == 0, "short").alias("side"),
        fc.to_double("p.openLevel").alias("leverage"), fc.to_double("p.openAvgPrice").alias("avg_cost"),
        fc.to_double("p.closeAvgPrice").alias("avg_close"), fc.to_double("p.netProfit").alias("pnl"),
        fc.percent_text("p.returnRate").alias("roi"), fc.to_double("p.openMarginCount").alias("margin"),
        fc.to_long("p.openTime").alias("opened_ms"), fc.to_long("p.closeTime").alias("closed_ms"), "file_pos")


def decode_kucoin_history(pages: DataFrame) -> DataFrame:
    rows = rows_of(parse(pages, KUCOIN_HISTORY_PAGE).select("r.*", "file_pos"), "data.items", ["leadConfigId", "nickName"])
    return rows.select(
        F.col("leadConfigId").alias("trader_id"), F.col("nickName").alias("nick"), F.col("p.symbol").alias("symbol"),
        _direction(), fc.to_double("p.leverage").alias("leverage"), fc.to_double("p.pnl").alias("pnl"),
        fc.to_double("p.pnlRatio").alias("roi"), fc.to_double("p.posMargin").alias("margin"),
        fc.to_double("p.avgEntryPrice").alias("avg_cost"), fc.to_double("p.avgClosePrice").alias("avg_close"),
        F.coalesce(fc.to_double("p.multiplier"), F.lit(1.0)).alias("multiplier"),
        F.col("p.startTime").alias("opened_ms"), F.col("p.endTime").alias("closed_ms"), "file_pos")


def _direction() -> Column:
    return F.when(F.col("p.positionDirection") == "Long", "long").when(F.col("p.positionDirection") == "Short", "short").alias("side")


def decode_kucoin_open(pages: DataFrame) -> DataFrame:
    """Here `pnl` is unrealised; the realised part and the fees have their own fields."""
    rows = rows_of(parse(pages, KUCOIN_OPEN_PAGE).select("r.*", "file_pos"), "data", ["leadConfigId", "nickName"])
    return rows.select(
        F.col("leadConfigId").alias("trader_id"), F.col("p.symbol").alias("symbol"), _direction(),
        fc.to_double("p.leverage").alias("leverage"), fc.to_double("p.pnl").alias("unrealized_pnl"),
        fc.to_double("p.realisedPnl").alias("realized_pnl"), fc.to_double("p.posMargin").alias("margin"),
        fc.to_double("p.extendPositionResponse.liquidationPrice").alias("liquidation_price"),
        fc.to_double("p.extendPositionResponse.cumulativeTradeFee").alias("trade_fee"),
        fc.to_double("p.extendPositionResponse.cumulativeFundingFee").alias("funding_fee"),
        F.col("p.startTime").alias("opened_ms"))


def decode_detail(pages: DataFrame) -> DataFrame:
    """Copier record per portfolio. Blank or absent stays NULL; a retired portfolio is an answer with no fields."""
    r = parse(pages, BINANCE_DETAIL_PAGE).select("r.*", "file_pos")
    answered = F.col("code").isin(DETAIL_RETIRED) | ((F.col("code") == DETAIL_OK) & F.col("data").isNotNull())
    retired = F.col("code") == DETAIL_RETIRED
    keep = lambda c: F.when(~retired, c)
    num = lambda c: keep(fc.to_double(text_or_null(f"data.{c}")))
    whole = lambda c: keep(fc.to_double(text_or_null(f"data.{c}")).cast("bigint"))
    return r.filter(answered).select(
        F.col("portfolioId").alias("trader_id"), "code", retired.alias("retired"), keep(F.col("data.status")).alias("status"),
        num("copierPnl").alias("copier_pnl"), whole("currentCopyCount").alias("copier_count_current"),
        whole("totalCopyCount").alias("copier_count_total"), num("aumAmount").alias("aum_amount"),
        num("marginBalance").alias("margin_balance"), num("fixedAmountMinCopyUsd").alias("min_copy_usd"),
        whole("lastTradeTime").alias("last_trade_ms"), keep(F.col("data.positionShow")).alias("position_show"), "file_pos")


def latest_detail(details: DataFrame) -> DataFrame:
    return last_wins(details.filter(F.col("trader_id").isNotNull()), ["trader_id"], "file_pos")


SAVED_DETAIL = (
    "portfolioId string, code string, retired string, copierPnl string, currentCopyCount string, totalCopyCount string, "
    "aumAmount string, marginBalance string, fixedAmountMinCopyUsd string")


def read_saved_detail(lines: DataFrame) -> DataFrame:
    """Detail records as the collector saves them, flat and with `retired` decided: the last line of a trader wins, malformed ones are dropped."""
    r = parse(lines, SAVED_DETAIL).select("r.*", "file_pos")
    whole = lambda c: fc.to_double(c).cast("bigint")
    return latest_detail(r.select(
        F.col("portfolioId").alias("trader_id"), F.coalesce(F.col("retired") == "true", F.lit(False)).alias("retired"),
        fc.to_double("copierPnl").alias("copier_pnl"), whole("currentCopyCount").alias("copier_count_current"),
        whole("totalCopyCount").alias("copier_count_total"), fc.to_double("aumAmount").alias("aum_amount"),
        fc.to_double("marginBalance").alias("margin_balance"), fc.to_double("fixedAmountMinCopyUsd").alias("min_copy_usd"), "file_pos"))


def pivot_items(items: str | Column, code: str = "showColumnCode", value: str = "comparedValue") -> Column:
    """[{code, value}, ...] as a map; the last entry of a code wins."""
    entries = F.filter(fc.col(items), lambda m: m[code].isNotNull())
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, m: F.map_concat(
        F.map_filter(acc, lambda k, _v: k != m[code]), F.create_map(m[code], m[value])))


def pivot_columns(names: str | Column, values: str | Column) -> Column:
    """Column names and values shipped as two lists, zipped by position; the last value of a name wins."""
    return pivot_items(F.arrays_zip(fc.col(names).alias("n"), fc.col(values).alias("v")), "n", "v")


def leaderboard(pages: DataFrame, ident: str, keep: str, place: str = "file_pos") -> DataFrame:
    """Page rows deduplicated by trader; which copy wins differs by source."""
    return last_wins(pages, [ident], place) if keep == "last" else first_wins(pages, [ident], place)


def read_listing(rows: DataFrame, exchange: str) -> DataFrame:
    """(exchange, trader_id, start_time, listed): a row without a start time is still listed."""
    ident = "leadPortfolioId" if exchange == "binance" else "userId"
    r = parse(rows, f"{ident} string, startTime bigint").select("r.*", "file_pos").filter(F.col(ident).isNotNull())
    return last_wins(r, [ident], "file_pos").select(
        F.lit(exchange).alias("exchange"), F.col(ident).alias("trader_id"),
        F.nullif(F.col("startTime"), F.lit(0)).alias("start_time"), F.lit(True).alias("listed"))


def with_listing(traders: DataFrame, listing: DataFrame | None) -> DataFrame:
    """No listing file: unknown for all. With one: absent traders are not listed."""
    if listing is None:
        return traders.withColumn("start_time", F.lit(None).cast("long")).withColumn("listed", F.lit(None).cast("boolean"))
    return traders.join(listing, ["exchange", "trader_id"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def latest_status(manifest: DataFrame, exchange: str, ident: str = "trader_id") -> DataFrame:
    """The last terminal entry of the append-only manifest per trader."""
    return last_wins(manifest.filter(F.col("status").isin(TERMINAL_STATUSES[exchange])), [ident], "file_pos")


def extract_status(pages: DataFrame, exchange: str) -> DataFrame:
    """ok / protected / not_found / error per trader, from the response itself rather than its HTTP code."""
    r = parse(pages, "trader string, code string, success boolean, result struct<openTradeInfoProtection:int>").select("r.*")
    status = {
        "okx": F.when(F.col("code") == OKX_NOT_FOUND, "not_found").when(F.col("code") == "0", "ok"),
        "bybit": F.when(F.col("result.openTradeInfoProtection") == 1, "protected").when(F.col("result").isNotNull(), "ok"),
        "bitget": F.when(F.col("code") == BITGET_PROTECTED, "protected").when(F.col("code") == "00000", "ok"),
        "kucoin": F.when(~F.coalesce("success", F.lit(False)), "not_found").otherwise("ok"),
    }[exchange]
    severity = F.when(F.col("s") == "error", 3).when(F.col("s") == "protected", 2).when(F.col("s") == "ok", 1).otherwise(0)
    return r.withColumn("s", F.coalesce(status, F.lit("error"))).groupBy(F.col("trader").alias("trader_id")).agg(
        F.max_by("s", severity).alias("status"))


def equity_points(rows: DataFrame, array: str, ts: str, value: str, scale: float = 1.0) -> DataFrame:
    """Nested series to (trader keys, ts, value); unreadable points are dropped."""
    return (
        rows.select(*TRADER, F.explode(array).alias("_p"))
        .select(*TRADER, fc.to_long(F.col("_p")[ts]).alias("ts"), (fc.to_double(F.col("_p")[value]) * scale).alias("value"))
        .filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    )


# Source fields that become common columns; all others go to extra_json.
UNIFIED = ["exchange", "trader_id", "nickname", "pnl_usd", "roi", "aum_usd", "followers", "win_rate", "extra_json"]
UNIFIED_FIELDS = {
    "okx": {"trader_id": "uniqueCode", "nickname": "nickName", "pnl_usd": "pnl", "roi": "pnlRatio", "aum_usd": "aum",
            "followers": "copyTraderNum", "win_rate": "winRatio"},
    "bybit": {"trader_id": "leaderUserId", "nickname": "nickName", "pnl_usd": "total_all_follow_profit", "roi": "roi",
              "followers": "currentFollowerCount", "win_rate": "win_rate"},
}


def unify_traders(lines_by_exchange: dict[str, DataFrame]) -> DataFrame:
    """Common columns plus the residual fields as JSON; last row per (exchange, trader); unknown exchanges ignored."""
    parts = []
    for exchange, fields in UNIFIED_FIELDS.items():
        if exchange not in lines_by_exchange:
            continue
        r = parse(lines_by_exchange[exchange], "map<string,string>", "m")
        mapped = F.array(*[F.lit(f) for f in fields.values()])
        named = {c: F.try_element_at("m", F.lit(fields[c])) if c in fields else F.lit("") for c in UNIFIED[1:-1]}
        parts.append(r.select(
            F.lit(exchange).alias("exchange"), *[v.alias(c) for c, v in named.items()],
            F.to_json(F.map_filter("m", lambda k, _v: ~F.array_contains(mapped, k))).alias("extra_json"), "file_pos"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return last_wins(out, ["exchange", "trader_id"], "file_pos").select(*UNIFIED)


# Listing field -> published column.
RECOMMEND_FIELDS = {"userId": "trader_id", "nickName": "nick", "pnlRate30d": "roi30", "pnl30d": "pnl30",
                    "tradeWinRate30d": "wr30", "aum": "aum", "followerCount": "followers", "mdd30d": "mdd30",
                    "showPosition": "show_position"}


def project_recommend_list(lines: DataFrame) -> DataFrame:
    r = parse(lines, "map<string,string>", "m")
    text = ("trader_id", "nick", "show_position")
    return last_wins(r.select(*[
        (F.try_element_at("m", F.lit(k)) if c in text else fc.to_double(F.try_element_at("m", F.lit(k)))).alias(c)
        for k, c in RECOMMEND_FIELDS.items()], "file_pos"), ["trader_id"], "file_pos").withColumn(
        "show_position", F.col("show_position") == "true")
