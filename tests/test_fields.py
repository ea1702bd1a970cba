"""Decoding by field tables: defaults against unknown, alternative and case-differing places, answers against errors, series."""

import json

from conftest import rows
from pyspark.sql import functions as F

from tradewright.operators import screens as sc
from tradewright.sources import fields as fl


def lines(spark, docs):
    text = [(d if isinstance(d, str) else json.dumps(d), i) for i, d in enumerate(docs)]
    return spark.createDataFrame(text, "value string, i long").select(
        "value", F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("i").alias("row")).alias("file_pos"))


def test_open_positions_with_unknown_or_alternative_pnl(spark):
    page = lambda **p: {"leaderMark": "m", "nickName": "n", "result": {"data": [{"symbol": "S", "side": "Sell", "leverageE2": "1250", **p}]}}
    docs = [page(unrealisedPnlE8="100000000"), page(unRealisedPnlE8=-250000000, uPnlE8=None), page(size=None, sizeX=3, stopLossPrice="x"), {"leaderMark": "e", "result": {"data": []}}, "{broken"]
    got = rows(fl.decode(lines(spark, docs), fl.BYBIT_OPEN), "file_pos")
    assert [(r["unrealized_pnl"], r["size"], r["stop_loss"], r["margin"]) for r in got] == [(1.0, 0.0, None, 0.0), (-2.5, 0.0, None, 0.0), (None, 3.0, None, 0.0)]
    assert {(r["trader_id"], r["side"], r["side_raw"], r["leverage"]) for r in got} == {("m", "short", "Sell", 12.5)}


def test_series_keep_one_window_and_readable_points(spark):
    docs = [{"leaderMark": "m", "duration": d, "result": {"yieldTrend": [{"statisticDate": "20", "totalYieldRateE4": "500"}, {"statisticDate": 10, "totalYieldRateE4": -100},
             {"statisticDate": "x", "totalYieldRateE4": 1}, {"statisticDate": 30}]}} for d in ("90D", "7D")]
    assert [(r["ts"], r["value"]) for r in rows(fl.bybit_yields(lines(spark, docs), ["trader_id"]), "ts")] == [(10, -0.01), (20, 0.05)]
    point = lambda v: {"roiRows": {"rows": [{"dataTime": "1", "amount": v}]}}
    docs = [{"traderUid": "t", "cycleTime": c, "code": code, "data": point(v)} for c, code, v in ((90, "00000", "-3.43"), (30, "00000", "9"), (90, "30066", "8"))]
    assert [(r["ts"], round(r["value"], 9)) for r in rows(fl.bitget_returns(lines(spark, docs), ["trader_id"]))] == [(1, -0.0343)]


def test_coded_metrics_and_defaults(spark):
    metric = lambda c, v: {"showColumnCode": c, "comparedValue": v}
    docs = [{"traderUid": "a", "code": "00000", "data": {"aum": "5", "itemVoList": [metric("income", "1"), metric("income", "7"), metric("profit_rate", "bad")], "followProfits": {"day7": "2"}}},
            {"traderUid": "b", "code": "00000", "data": {}}, {"traderUid": "c", "code": "1", "data": {"aum": "5"}}]
    got = {r["trader_id"]: r for r in rows(fl.bitget_details(lines(spark, docs)))}
    assert set(got) == {"a", "b"}
    assert (got["a"]["total_income"], got["a"]["roi"], got["a"]["aum"], got["a"]["follow_profit_7d"], got["a"]["followers"]) == (7.0, 0.0, 5.0, 2.0, None)
    assert (got["b"]["total_income"], got["b"]["aum"]) == (0.0, 0.0)


def test_open_cycle_info_summary_and_stats(spark):
    got = rows(fl.decode(lines(spark, [{"traderUid": "t", "code": "00000", "data": {"items": [{"orderNo": 1, "position": 0, "openTime": "5"}]}}, {"traderUid": "u", "code": "30066"}]), fl.BITGET_OPEN))
    assert [(r["trader_id"], r["position_key"], r["side"], r["opened_ms"], r["leverage"]) for r in got] == [("t", "1", "short", 5, 0.0)]
    info = rows(fl.decode(lines(spark, [{"leaderMark": "m", "result": {"locateDays": "x", "walletBalanceE8": 250000000}}]), fl.BYBIT_TRADER))[0]
    assert (info["locate_days"], info["wallet_balance"], info["yield_7d"]) == (None, 2.5, 0.0)
    summary = rows(fl.decode(lines(spark, [{"leadConfigId": 5, "success": True, "data": {"leadDays": 9, "onLeaderboard": True}}, {"leadConfigId": 6, "success": False}]), fl.KUCOIN_SUMMARY))
    assert [(r["trader_id"], r["lead_days"], r["followers"], r["on_leaderboard"]) for r in summary] == [("5", 9, 0, True)]
    stats = rows(fl.decode(lines(spark, [{"uniqueCode": "q", "code": "0", "data": [{"winRatio": "0.5"}]}, {"uniqueCode": "r", "code": "50001", "data": []}]), fl.OKX_STATS))
    assert [(r["trader_id"], r["win_ratio"], r["invest_amount"]) for r in stats] == [("q", 0.5, None)]


def test_positional_series_is_dated_from_its_end(spark):
    docs = [{"data": {"items": [{"leadConfigId": 1, "leadPrincipal": "1000", "ninetyDayPnlDate": ["0", "100", "n/a", "-50", 20]},
                                {"leadConfigId": 2, "leadPrincipal": "0", "ninetyDayPnlDate": ["0", "-9"]}, {"leadConfigId": 3, "leadPrincipal": "5"}]}}]
    leaders = fl.decode(lines(spark, docs), fl.KUCOIN_LEADER).withColumns({"snapshot_date": F.lit("d"), "exchange": F.lit("kucoin")})
    end = spark.createDataFrame([("d", "kucoin", 100 * 86_400_000)], "snapshot_date string, exchange string, series_end_ms long")
    series = sc.positional_series(leaders, "pnl_series_90d", end)
    got = {r["ts"] // 86_400_000: r["value"] for r in rows(series.filter("trader_id = 1"))}
    assert got == {97: 0.0, 98: 100.0, 99: -50.0, 100: 20.0}
    screen = {r["trader_id"]: (r["depth"], r["trough_ts"] // 86_400_000) for r in rows(sc.principal_screen(series, leaders.select("snapshot_date", "exchange", "trader_id", "principal")))}
    assert screen == {"1": (15.0, 99)}
