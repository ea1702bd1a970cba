"""Decoders as data: a page is a table of fields, from which the schema and the column expressions are generated.

A field names its place in the page, how its text is read, and what stands for a missing or unreadable value: NULL (unknown) or a fixed
default where the source's absence means zero. Every leaf is read as text, so a number in quotes and a bare one decode alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewright.functions import columns as fc
from tradewright.sources.lines import parse
from tradewright.sources.pages import leaderboard


@dataclass(frozen=True)
class Field:
    """`path`: dotted place below the row, or, with a leading dot, below the page. Several places: the first that is not NULL counts."""

    path: str | tuple[str, ...]
    kind: str = "text"  # text | number | whole | flag | choice | series | values
    digits: int = 0  # the number ships as an integer scaled by 10**digits
    default: float | None = None
    choices: dict[str, str] | None = None
    point: tuple[str, str] = ("ts", "value")  # of a series: the places of time and value in a point

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.path,) if isinstance(self.path, str) else self.path


@dataclass(frozen=True)
class Page:
    """`rows`: the array that holds one row per element; None: the page is one row. `ok`: codes that mark an answer; other pages give no row."""

    fields: dict[str, Field]
    rows: str | None = None
    ok: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _nested(leaves: dict[str, T.DataType]) -> T.StructType:
    tree: dict[str, dict] = {}
    for path, leaf in leaves.items():
        head, _, rest = path.partition(".")
        tree.setdefault(head, {})[rest] = leaf
    return T.StructType([T.StructField(head, below[""] if list(below) == [""] else _nested({k: v for k, v in below.items() if k})) for head, below in tree.items()])


def schema(page: Page) -> T.StructType:
    """The schema that reads exactly the fields of the page."""
    top: dict[str, T.DataType] = {path: T.StringType() for path in page.ok}
    row: dict[str, T.DataType] = {}
    for f in page.fields.values():
        leaf = {"series": T.ArrayType(_nested({p: T.StringType() for p in f.point})), "values": T.ArrayType(T.StringType())}.get(f.kind, T.StringType())
        for path in f.paths:
            (top if path.startswith(".") or page.rows is None else row)[path.lstrip(".")] = leaf
    if page.rows is not None:
        top[page.rows] = T.ArrayType(_nested(row))
    return _nested(top)


def _distinct(kind: T.DataType) -> T.DataType:
    """The same type with names that also differ when case doesn't count, as SQL wants them; keys of JSON may differ by case alone."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_distinct(kind.elementType))
    if not isinstance(kind, T.StructType):
        return kind
    lower = [f.name.lower() for f in kind.fields]
    return T.StructType([T.StructField(_name(f.name, lower[:i].count(lower[i])), _distinct(f.dataType)) for i, f in enumerate(kind.fields)])


def _name(name: str, seen: int) -> str:
    return f"{name}__{seen}" if seen else name


def _place(kind: T.DataType, path: str) -> str:
    """Where a path of the page lies after _distinct."""
    out = []
    for part in path.split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        names = [f.name for f in kind.fields]
        i = names.index(part)
        out.append(_name(part, [n.lower() for n in names[:i]].count(part.lower())))
        kind = kind.fields[i].dataType
    return ".".join(out)


def read(f: Field, of) -> Column:
    """The field's value; `of` maps a path to its column."""
    found = F.coalesce(*map(of, f.paths)) if len(f.paths) > 1 else of(f.paths[0])
    if f.kind == "series":
        point = lambda p: F.struct(fc.to_long(p[f.point[0]]).alias("ts"), (fc.to_double(p[f.point[1]]) / float(10 ** f.digits)).alias("value"))
        known = F.filter(F.transform(found, point), lambda p: p["ts"].isNotNull() & p["value"].isNotNull())
        return F.array_sort(known)
    if f.kind == "values":  # a series without times; unreadable entries are no days
        return F.filter(F.transform(found, fc.to_double), lambda v: v.isNotNull())
    if f.kind == "choice":
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in f.choices.items() for x in pair]), found)
    made = {"text": lambda: found, "flag": lambda: found.try_cast("boolean"), "whole": lambda: fc.to_long(found),
            "number": lambda: fc.scaled(found, f.digits) if f.digits else fc.to_double(found)}[f.kind]()
    return made if f.default is None else F.coalesce(made, F.lit(f.default).cast("bigint" if f.kind == "whole" else "double"))


def decode(lines: DataFrame, page: Page) -> DataFrame:
    """One row per element of the page's array, or per page, with its place in the files. Malformed lines and pages that are no answer give none."""
    shape = schema(page)
    at = lambda path: _place(shape, path)
    pages = parse(lines, shape).select(F.col("r").cast(_distinct(shape)).alias("r"), "file_pos")
    for path, codes in page.ok.items():
        pages = pages.filter(F.col(f"r.{at(path)}").isin(*codes))
    if page.rows is not None:
        inner = at(page.rows)
        pages = pages.select("r", "file_pos", F.posexplode(f"r.{inner}").alias("_i", "p"))
        pages = pages.withColumn("file_pos", F.struct("file_pos", F.col("_i").alias("i")))
    below = lambda path: at(f"{page.rows}.{path}").removeprefix(at(page.rows) + ".")
    of = lambda path: F.col(f"p.{below(path)}" if page.rows is not None and not path.startswith(".") else f"r.{at(path.lstrip('.'))}")
    return pages.select(*[read(f, of).alias(name) for name, f in page.fields.items()], "file_pos")


def text(*path: str) -> Field:
    return Field(path)


def number(*path: str, digits: int = 0, default: float | None = None) -> Field:
    return Field(path, "number", digits, default)


def whole(*path: str, default: int | None = None) -> Field:
    return Field(path, "whole", 0, default)


def series(path: str, ts: str, value: str, digits: int = 0) -> Field:
    return Field(path, "series", digits, point=(ts, value))


# The pages of each source, field by field.
BYBIT_SIDES, BITGET_SIDES = {"Buy": "long", "Sell": "short"}, {"1": "long", "0": "short"}
BYBIT_OPEN = Page({
    "trader_id": text(".leaderMark"), "leader_user_id": text(".leaderUserId"), "nick": text(".nickName"), "symbol": text("symbol"),
    "side": Field("side", "choice", choices=BYBIT_SIDES), "side_raw": text("side"), "leverage": number("leverageE2", digits=2, default=0.0),
    "entry_price": number("entryPrice", default=0.0), "size": number("size", "sizeX", default=0.0), "margin": number("orderCostE8", digits=8, default=0.0),
    "stop_loss": number("stopLossPrice"), "take_profit": number("takeProfitPrice"),
    # none is published for certain: where all are absent the value is unknown, not zero
    "unrealized_pnl": number("unrealisedPnlE8", "uPnlE8", "positionPnlE8", "unRealisedPnlE8", digits=8),
}, rows="result.data")
BYBIT_TRADER = Page({
    "trader_id": text(".leaderMark"), "nick": text(".nickName"), "leader_user_id": text("result.leaderUserId"),
    "win_rate_7d": number("result.last7DaysWinRateE4", digits=4, default=0.0), "win_rate_3w": number("result.last3WeeksWinRateE4", digits=4, default=0.0),
    "yield_7d": number("result.last7DaysYieldE8", digits=8, default=0.0), "follower_yield_7d": number("result.last7DaysFollowerYieldE8", digits=8, default=0.0),
    "n_transactions": whole("result.cumHistoryTransactionsCount"), "n_followers_ever": whole("result.cumFollowerCount"), "locate_days": whole("result.locateDays"),
    "n_followers": whole("result.currentFollowerCount"), "max_followers": whole("result.maxFollowerCount"), "n_profit": whole("result.profitCount"),
    "n_loss": whole("result.lossCount"), "wallet_balance": number("result.walletBalanceE8", digits=8, default=0.0),
})
BYBIT_YIELD = Page({
    "trader_id": text(".leaderMark"), "duration": text(".duration"), "series": series("result.yieldTrend", "statisticDate", "totalYieldRateE4", 4)})
BITGET_OPEN = Page({
    "trader_id": text(".traderUid"), "nick": text(".displayName"), "position_key": text("orderNo"), "symbol_id": text("symbolId"),
    "side": Field("position", "choice", choices=BITGET_SIDES), "leverage": number("openLevel", default=0.0), "avg_cost": number("openAvgPrice", default=0.0),
    "size": number("openDealCount", default=0.0), "margin": number("openMarginCount", default=0.0), "opened_ms": whole("openTime"),
}, rows="data.items", ok={"code": ("00000",)})
BITGET_CYCLE = Page({
    "trader_id": text(".traderUid"), "nick": text(".displayName"), "cycle_days": whole(".cycleTime"),
    "roi_series": series("data.roiRows.rows", "dataTime", "amount"), "pnl_series": series("data.pnlRows.rows", "dataTime", "amount"),
    "net_series": series("data.netProfitKlineDTO.rows", "dataTime", "amount"),
    **{name: number(f"data.statisticsDTO.{path}", default=0.0) for name, path in (
        ("aum", "aum"), ("profit_rate", "profitRate"), ("max_drawdown", "maxRetracement"), ("win_rate", "winningRate"),
        ("largest_profit", "largestProfit"), ("largest_loss", "largestLoss"))},
    **{name: whole(f"data.statisticsDTO.{path}") for name, path in (
        ("n_trades", "totalTrades"), ("n_profit", "profitTrades"), ("n_loss", "lossTrades"))},
}, ok={"code": ("00000",)})
BITGET_DETAIL = Page({
    "trader_id": text(".traderUid"), "aum": number("data.aum", default=0.0), "followers": whole("data.followerCount"),
    "profit_share": number("data.distributeRatio", default=0.0),
    **{f"follow_profit_{d}d": number(f"data.followProfits.day{d}", default=0.0) for d in (7, 30, 90, 180)},
}, ok={"code": ("00000",)})
BITGET_DETAIL_METRICS = Page({
    "trader_id": text(".traderUid"), "code": text("showColumnCode"), "value": number("comparedValue", default=0.0)}, rows="data.itemVoList", ok={"code": ("00000",)})
BITGET_METRICS = {"max_retracement": "mdd", "profit_rate": "roi", "total_winning_rate": "win_rate", "income": "total_income"}
KUCOIN_LEADER = Page({
    "trader_id": text("leadConfigId"), "nick": text("nickName"), "currency": text("currency"), "n_copiers": whole("currentCopyUserCount", default=0),
    "max_copiers": whole("maxCopyUserCount", default=0), "principal": number("leadPrincipal", default=0.0), "lead_amount": number("leadAmount", default=0.0),
    "days_as_leader": whole("daysAsLeader", default=0), "follower_pnl": number("followerPnl", default=0.0),
    **{f"{name}_{what}": number(f"{path}{suffix}", default=0.0) for name, path in (("total", "total"), ("d90", "ninetyDay"), ("d30", "thirtyDay"), ("d7", "sevenDay"))
       for what, suffix in (("pnl", "Pnl"), ("ratio", "PnlRatio"))},
    **{f"pnl_series_{d}d": Field(path, "values") for d, path in ((30, "totalPnlDate"), (90, "ninetyDayPnlDate"), (7, "sevenDayPnlDate"))},
    "trades_7d": whole("sevenDayTradeCount", default=0), "trades_30d": whole("thirtyDayTradeCount", default=0),
}, rows="data.items")
KUCOIN_SUMMARY = Page({
    "trader_id": text(".leadConfigId"), "uid": text("data.uid"), "followers": whole("data.followersSum", default=0), "following": whole("data.followingSum", default=0),
    "copied_traders": whole("data.alreadyCopyTraders", default=0), "allowed_copiers": whole("data.allowCopyTraders", default=0),
    "lead_days": whole("data.leadDays", default=0), "position_visibility": text("data.positionVisibility"), "on_leaderboard": Field("data.onLeaderboard", "flag"),
}, ok={"success": ("true",)})
OKX_STATS = Page({
    "trader_id": text(".uniqueCode"), "win_ratio": number("winRatio"), "profit_days": whole("profitDays"), "loss_days": whole("lossDays"),
    "invest_amount": number("investAmt"), "avg_position_value": number("avgSubPosNotional"), "copier_pnl": number("curCopyTraderPnl"),
}, rows="data", ok={"code": ("0",)})


def bitget_details(lines: DataFrame) -> DataFrame:
    """The detail page with its coded metrics as columns; a metric's last entry counts, an absent one is zero."""
    metrics = decode(lines, BITGET_DETAIL_METRICS).filter(F.col("code").isin(*BITGET_METRICS))
    wide = metrics.groupBy("trader_id").agg(*[
        F.max_by(F.when(F.col("code") == c, F.col("value")), F.when(F.col("code") == c, F.col("file_pos"))).alias(name) for c, name in BITGET_METRICS.items()])
    return decode(lines, BITGET_DETAIL).join(wide, "trader_id", "left").fillna(0.0, list(BITGET_METRICS.values()))


def dated_series(rows: DataFrame, keys: list[str], column: str, keep: Column | None = None, scale: float = 1.0) -> DataFrame:
    """(keys, ts, value) of the series of the rows that `keep` selects: one window of a source that ships several."""
    rows = rows if keep is None else rows.filter(keep)
    return rows.select(*keys, F.explode(column).alias("_p")).select(*keys, F.col("_p.ts").alias("ts"), (F.col("_p.value") * scale).alias("value"))


BYBIT_WINDOW, BITGET_WINDOW = "90D", 90


def bybit_yields(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The 90-day yield trend only; the shorter one of the same trader is another series."""
    return dated_series(decode(lines, BYBIT_YIELD), keys, "series", F.col("duration") == BYBIT_WINDOW)


def bitget_returns(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The 90-day return series; percent numbers as fractions."""
    return dated_series(decode(lines, BITGET_CYCLE), keys, "roi_series", F.col("cycle_days") == BITGET_WINDOW, 0.01)


@dataclass(frozen=True)
class Board:
    """Where a source's leaderboard pages hold their rows, what identifies a trader, and which copy of one counts."""

    rows: str
    ident: str
    keep: str
    answer: str
    ok: str


# The leaderboard pages of five sources.
BOARDS = {
    "binance": Board("$.data.list", "leadPortfolioId", "last", "$.code", "000000"),
    "okx": Board("$.data[0].ranks", "uniqueCode", "last", "$.code", "0"),
    "bybit": Board("$.result.leaderDetails", "leaderUserId", "last", "$.retCode", "0"),
    "bitget": Board("$.data.rows", "traderUid", "first", "$.code", "200"),
    "kucoin": Board("$.data.items", "leadConfigId", "first", "$.success", "true"),
}


def board_rows(pages: DataFrame, exchange: str) -> DataFrame:
    """(exchange, trader_id, row, place): one row per trader of all pages, as a map of its published fields.

    A trader moves between pages while they are collected. Copies are ordered by file, page within it and row within that, and the first or the last
    one counts, as the source has it. Rows without an id and pages that are no answer give nothing.
    """
    board = BOARDS[exchange]
    answers = pages.filter(F.get_json_object("value", board.answer) == board.ok)
    rows = answers.select("file_pos", F.posexplode(F.from_json(F.get_json_object("value", board.rows), "array<map<string,string>>")).alias("_i", "row"))
    found = rows.select(F.lit(exchange).alias("exchange"), F.try_element_at("row", F.lit(board.ident)).alias("trader_id"), "row",
                        F.struct("file_pos", "_i").alias("place")).filter(F.col("trader_id").isNotNull())
    return leaderboard(found, "trader_id", board.keep, "place")
