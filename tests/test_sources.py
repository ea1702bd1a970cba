"""Decoders, deduplication and sinks on rows in the shapes the sources ship."""

import json
import tempfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tradewright.functions import columns as fc
from tradewright.sources import lines as ln
from tradewright.sources import pages as pg
from tradewright.sources import positions as ps
from tradewright.sources import sinks


def lines(spark, docs):
    text = [(d if isinstance(d, str) else json.dumps(d), i) for i, d in enumerate(docs)]
    return spark.createDataFrame(text, "value string, i long").select(
        "value", F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("i").alias("row")).alias("file_pos"))


def test_parse_metric_and_scaled(spark):
    df = spark.createDataFrame([("+5.54%",), ("1,234.5",), ("-",), ("--",), ("",), ("N/A",), (None,), ("-3%",)], "s string")
    assert [r[0] for r in df.select(fc.parse_metric("s")).collect()] == [5.54, 1234.5, None, None, None, None, None, -3.0]
    got = spark.createDataFrame([("500",), ("x",)], "s string").select(fc.scaled("s", 2)).collect()
    assert [r[0] for r in got] == [5.0, None]
    assert spark.createDataFrame([("5E+1",)], "s string").select(fc.to_double("s")).first()[0] == 50.0


def test_binance_and_phemex(spark):
    doc = {"portfolioId": "9007199254740993", "nick": "n", "roi": 1.5, "positions": [
        {"symbol": "BTC", "side": "Long", "leverage": "0", "isolated": "Cross", "avgCost": "100", "avgClosePrice": "110", "closingPnl": "x",
         "roi": "0.1", "maxOpenInterest": "2", "closedVolume": "1.5", "opened": 3_600_000, "closed": 7_200_000},
        {"symbol": "ETH", "side": "Short", "leverage": "10", "avgCost": "50", "maxOpenInterest": "4", "opened": 1, "closed": None}]}
    a, b = rows(ps.read_binance(lines(spark, [doc, "not json"])), "symbol")
    assert a["trader_id"] == "9007199254740993" and a["leverage"] == 1.0 and a["notional"] == 200.0 and a["dur_h"] == 1.0
    assert a["pnl"] is None and a["partial"] is True and a["p_pnl"] is None
    assert b["margin"] == 20.0 and b["dur_h"] is None
    again = {r["position_key"] for r in rows(ps.read_binance(lines(spark, ["", {**doc, "nick": "renamed"}])))}
    assert again == {a["position_key"], b["position_key"]} and len(again) == 2 and None not in again
    ph = {"userId": 7, "nick": "p", "positions": [
        {"positionId": 1, "symbol": "X", "side": "Buy", "posSide": "Merged", "openPositionVal": "100", "margin": "20", "realizedPnl": "1", "closedPnl": "2",
         "openedTime": 0, "createdAt": 5, "updatedTime": 10},
        {"positionId": 1, "symbol": "DUP", "openPositionVal": "1", "margin": "0"}]}
    got = rows(ps.read_phemex(lines(spark, [ph, {**ph, "userId": 8}])), "trader_id")
    assert [(r["trader_id"], r["symbol"], r["side"], r["leverage"], r["opened_ms"]) for r in got] == [("7", "X", "Merged", 5.0, 5), ("8", "X", "Merged", 5.0, 5)]
    assert rows(ps.read_phemex(lines(spark, [ph]), funnel_side=True))[0]["side"] == "Long"


def test_okx_bybit_kucoin_dedup(spark):
    okx = [{"uniqueCode": "u", "subPosId": "1", "lever": "5E+1", "margin": "10", "openTime": "1", "closeTime": "", "pnl": "1"},
           {"uniqueCode": "u", "subPosId": "1", "lever": "2", "margin": "10", "pnl": "2"}]
    got = rows(ps.read_okx(lines(spark, okx)))
    assert len(got) == 1 and got[0]["leverage"] == 50.0 and got[0]["notional"] == 500.0 and got[0]["closed_ms"] is None
    by = [{"leaderMark": "m", "orderId": "a", "pnl_usd": 1.0}, {"leaderMark": "m", "orderId": "a", "pnl_usd": 2.0}, {"leaderMark": "m"}, {"leaderMark": "m"}]
    assert sorted(str(r["pnl"]) for r in rows(ps.read_bybit(lines(spark, by)))) == ["1.0", "None", "None"]
    ku = [{"leadConfigId": 5, "symbol": "S", "startTime": 1, "endTime": 2, "pnl": p} for p in (1.0, 2.0)]
    assert [r["pnl"] for r in rows(ps.read_kucoin(lines(spark, ku)))] == [2.0]


@pytest.mark.parametrize("flip", [False, True])
def test_bitget_shaped_beats_raw_in_either_order(spark, flip):
    shaped = {"traderUid": "t", "displayName": "d", "orderNo": "1", "side": "short", "returnRate": 5.58, "openLevel": 10, "netProfit": 3.0}
    raw = {"teacherId": "t", "teacherName": "d", "orderNo": "1", "position": 1, "returnRate": "558", "openLevel": "10", "netProfit": "4"}
    got = rows(ps.read_bitget(lines(spark, [raw, shaped] if flip else [shaped, raw])))
    assert len(got) == 1 and got[0]["side"] == "short" and got[0]["roi"] == 5.58
    only = rows(ps.read_bitget(lines(spark, [raw])))[0]
    assert only["side"] == "long" and only["roi"] == pytest.approx(5.58) and only["trader_id"] == "t"


def test_page_decoders(spark):
    by = {"leaderMark": "m", "result": {"openTradeInfoProtection": 0, "data": [{"orderId": "1", "symbol": "S", "side": "Sell", "leverageE2": "1000",
          "orderNetProfitE8": "-150000000", "orderNetProfitRateE4": "-250", "orderCostE8": "500000000", "startedTimeE3": "1700000000000"}]}}
    r = rows(pg.decode_bybit_history(lines(spark, [by])))[0]
    assert (r["side"], r["leverage"], r["pnl"], r["roi"], r["margin"], r["opened_ms"]) == ("short", 10.0, -1.5, -0.025, 5.0, 1700000000000)
    bg = {"traderUid": "t", "code": "00000", "data": {"rows": [{"orderNo": "1", "position": 0, "returnRate": "11.68", "netProfit": "2"}]}}
    assert rows(pg.decode_bitget_history(lines(spark, [bg])))[0]["roi"] == pytest.approx(0.1168)
    ko = {"leadConfigId": 1, "success": True, "data": [{"symbol": "S", "positionDirection": "Long", "pnl": "-3", "realisedPnl": "1", "extendPositionResponse": {"cumulativeTradeFee": "0.5"}}]}
    k = rows(pg.decode_kucoin_open(lines(spark, [ko])))[0]
    assert (k["unrealized_pnl"], k["realized_pnl"], k["trade_fee"], k["side"]) == (-3.0, 1.0, 0.5, "long")
    kh = {"leadConfigId": 1, "success": True, "data": {"items": [{"symbol": "S", "positionDirection": "Short", "pnl": "7", "startTime": 1, "endTime": 2}]}}
    assert rows(pg.decode_kucoin_history(lines(spark, [kh])))[0]["multiplier"] == 1.0


def test_detail_keeps_unknown_apart_from_zero(spark):
    docs = [{"portfolioId": "a", "code": "000000", "data": {"copierPnl": " ", "totalCopyCount": "12.0", "aumAmount": "0", "status": "ACTIVE"}},
            {"portfolioId": "b", "code": "11012028", "data": None}, {"portfolioId": "c", "code": "11012005", "data": None}, "{broken",
            {"portfolioId": "a", "code": "000000", "data": {"copierPnl": "-5.5"}}]
    all_rows = pg.decode_detail(lines(spark, docs))
    got = {r["trader_id"]: r for r in rows(pg.latest_detail(all_rows))}
    assert set(got) == {"a", "b"} and got["a"]["copier_pnl"] == -5.5 and got["a"]["aum_amount"] is None
    assert got["b"]["retired"] is True and got["b"]["status"] is None
    first = [r for r in rows(all_rows) if r["trader_id"] == "a" and r["aum_amount"] == 0.0]
    assert first[0]["copier_count_total"] == 12 and first[0]["copier_pnl"] is None


def test_listing_status_pivots(spark):
    listing = pg.read_listing(lines(spark, [{"leadPortfolioId": "a", "startTime": 5}, {"leadPortfolioId": "b"}]), "binance")
    traders = spark.createDataFrame([("binance", x) for x in "abc"], "exchange string, trader_id string")
    assert [(r["trader_id"], r["start_time"], r["listed"]) for r in rows(pg.with_listing(traders, listing), "trader_id")] == [
        ("a", 5, True), ("b", None, True), ("c", None, False)]
    assert {r["listed"] for r in rows(pg.with_listing(traders, None))} == {None}
    st = pg.extract_status(lines(spark, [{"trader": "x", "code": "30066"}, {"trader": "y", "code": "00000"}]), "bitget")
    assert {r["trader_id"]: r["status"] for r in rows(st)} == {"x": "protected", "y": "ok"}
    ku = pg.extract_status(lines(spark, [{"trader": "z", "success": False, "code": "200"}]), "kucoin")
    assert rows(ku)[0]["status"] == "not_found"
    df = spark.sql("select array(named_struct('showColumnCode','a','comparedValue','1'), named_struct('showColumnCode','a','comparedValue','2')) i, array('MDD','ROI','MDD') n, array('9','+5%','-') v")
    r = df.select(pg.pivot_items("i").alias("m"), pg.pivot_columns("n", "v").alias("c")).first()
    assert r["m"] == {"a": "2"} and r["c"] == {"ROI": "+5%", "MDD": "-"}


def test_unify_and_recommend(spark):
    okx = [{"uniqueCode": "u", "nickName": "n", "pnl": "1", "extra": "e"}, {"uniqueCode": "u", "nickName": "n2", "pnl": "2", "extra": "e2"}]
    by = [{"leaderUserId": "9", "nickName": "b", "roi": "5", "page": "1"}]
    got = rows(pg.unify_traders({"okx": lines(spark, okx), "bybit": lines(spark, by), "other": None}), "exchange")
    assert [(r["exchange"], r["trader_id"], r["nickname"], r["aum_usd"]) for r in got] == [("bybit", "9", "b", ""), ("okx", "u", "n2", None)]
    assert json.loads(got[1]["extra_json"]) == {"extra": "e2"}
    rec = rows(pg.project_recommend_list(lines(spark, [{"userId": 3, "nickName": "x", "mdd30d": "0.5", "showPosition": True}])))[0]
    assert rec["trader_id"] == "3" and rec["mdd30"] == 0.5 and rec["show_position"] is True


def test_split_and_assemble(spark):
    cols = "exchange string, trader_id string, position_key string, opened_ms long, closed_ms long, symbol string, side string, leverage double, notional double, pnl double"
    hist = spark.createDataFrame([("okx", "t", "1", 1, 2, "S", "long", 1.0, 1.0, 1.0), ("okx", "t", "2", 1, None, "S", "long", 1.0, 1.0, 1.0),
                                  ("okx", "t", "3", 1, None, "S", "long", 1.0, 1.0, 1.0)], cols)
    cur = spark.createDataFrame([("okx", "t", "3", 1, None, "S", "long", 1.0, 1.0, 9.0)], cols)
    closed, opened = ps.split_closed_open(hist, cur)
    assert [r["position_key"] for r in rows(closed)] == ["1"]
    assert [(r["position_key"], r["pnl"]) for r in rows(opened, "position_key")] == [("2", 1.0), ("3", 9.0)]
    pages = rows(ps.assemble_records(hist, page_rows=2), "page")
    assert [(r["n_pos"], len(r["positions"])) for r in pages] == [(3, 2), (3, 1)]


def test_open_upl_unknown_versus_zero(spark):
    docs = [{"uniqueCode": "u", "upl": "bad"}, {"uniqueCode": "u", "upl": "-2"}]
    assert sorted(r["unrealized_pnl"] for r in rows(ps.read_open_upl(lines(spark, docs), "okx"))) == [-2.0, 0.0]
    assert rows(ps.read_open_upl(lines(spark, [{"leaderMark": "m", "upl": None}]), "bybit"))[0]["unrealized_pnl"] is None


def test_series_points(spark):
    df = spark.createDataFrame([("t", "d", "e", [("10", "1.5"), ("x", "2"), ("20", None)])],
                               "trader_id string, snapshot_date string, exchange string, s array<struct<ts:string,v:string>>")
    assert [(r["ts"], r["value"]) for r in rows(pg.equity_points(df, "s", "ts", "v", 0.01))] == [(10, 0.015)]


def test_files_and_sinks(spark):
    root = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame([('{"uniqueCode":"u","subPosId":"1","margin":"1"}',), ("",)], "value string").coalesce(1).write.text(f"{root}/in")
    assert len(rows(ps.read_okx(ln.read_lines(spark, f"{root}/in")))) == 1
    df = spark.createDataFrame([("2026-01-01", "a", "t", 1), ("2026-01-01", "b", "t", 2)], "snapshot_date string, exchange string, trader_id string, v int")
    for _ in range(2):
        sinks.replace_snapshot(df, f"{root}/t")
    assert sinks.read_table(spark, f"{root}/t").count() == 2
    sinks.replace_snapshot(df.filter("exchange = 'a'").withColumn("v", F.lit(9)).withColumn("extra", F.lit(1)), f"{root}/t")
    assert {(r["exchange"], r["v"], r["extra"]) for r in rows(sinks.read_table(spark, f"{root}/t"))} == {("a", 9, 1), ("b", 2, None)}
    sinks.clear_snapshot(spark, f"{root}/t", "2026-01-01", "b")
    assert sinks.read_table(spark, f"{root}/t").count() == 1
    sinks.write_flat(df, f"{root}/csv", ["v", "trader_id"])
    assert spark.read.option("header", True).csv(f"{root}/csv").columns == ["v", "trader_id"]
    assert sinks.add_missing_columns(df, {"listed": "boolean", "v": "int"}).columns[-1] == "listed"
    roster = spark.createDataFrame([("t", "2026-01-01", "a", 1, "n")], "trader_id string, snapshot_date string, exchange string, rank_now int, nick string")
    gone = spark.createDataFrame([("x", "2026-01-01", "a", "nx", "why")], "trader_id string, snapshot_date string, exchange string, nick string, reason string")
    sinks.write_roster(roster, gone, f"{root}/roster")
    sinks.publish(spark, f"{root}/roster", f"{root}/latest", "2026-01-01")
    doc = spark.read.json(f"{root}/latest").first()
    assert doc["traders"][0]["nick"] == "n" and doc["removed"][0]["reason"] == "why"


def test_split_reads_decoded_rows(spark):
    """Both sides of the split read one stage table: no side decodes the lines again, which made plans that outgrew the driver."""
    from tradewright.plans import raw_lines as rl

    counts = rl.split_open(spark, "/root/testdata/sf0.001")
    assert "from_json" not in counts._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in rows(counts):
        got[r["kind"]] = got.get(r["kind"], 0) + r["n"]
    decoded = ps.read_okx(rl.okx_lines(spark, "/root/testdata/sf0.001")).selectExpr("closed_ms is null o").groupBy("o").count()
    assert got == {"open" if r["o"] else "closed": r["count"] for r in decoded.collect()}
