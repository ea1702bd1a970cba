"""Analysis operators on small hand-written rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tradewright.config import FUNNELS, DetectConfig
from tradewright.functions.columns import guarded_price_return, month_of
from tradewright.operators import funnel as fn
from tradewright.operators import quality as ql
from tradewright.operators import rank as rk
from tradewright.operators import screens as sc
from tradewright.operators.detect import detect
from tradewright.operators.metrics import trader_metrics

JUL = 1_783_036_800_000  # 2026-07-03
POSITION = ("snapshot_date string, exchange string, trader_id string, nick string, symbol string, side string, opened_ms long, "
            "closed_ms long, dur_h double, notional double, leverage double, margin double, avg_cost double, avg_close double, "
            "pnl double, position_key long")


def position(trader, pr, key, opened=JUL, symbol="BTC", avg_cost=100.0, pnl=None, lev=5.0):
    return ("2026-08-28", "binance", trader, trader, symbol, "Long", opened, opened + 3_600_000, 1.0, 1000.0, lev, 200.0,
            avg_cost, 100.0 * (1 + pr), 1000.0 * pr if pnl is None else pnl, key)


def frame(spark, data):
    return spark.createDataFrame(data, POSITION).withColumn("pr", guarded_price_return()).withColumn("month", month_of("opened_ms"))


def test_alpha_basics(spark):
    data = [position(f"crowd{i}", 0.0, i) for i in range(21)]
    data += [position("T", p, 100 + i, JUL + i) for i, p in enumerate([0.02, 0.02, 0.02, 0.02, -0.01])]
    data.append(position("T", 0.5, 200, avg_cost=0.0))  # invalid: not counted
    m = {r["trader_id"]: r for r in rows(trader_metrics(frame(spark, data), 20))}
    t = m["T"]
    assert t["n"] == 5 and t["n_alpha"] == 5
    assert t["alpha"] == pytest.approx(0.014) and t["payoff"] == pytest.approx(2.0)
    assert t["wr"] == pytest.approx(80) and t["ruin"] == pytest.approx(-5) and t["months_active"] == 1
    assert m["crowd0"]["payoff"] is None and m["crowd0"]["t_stat"] == 0.0


def test_self_dominated_and_solo_cells(spark):
    data = [position("A", 0.05, i) for i in range(6)] + [position("B", 0.01, 10 + i) for i in range(3)]
    m = {r["trader_id"]: r for r in rows(trader_metrics(frame(spark, data), 8))}
    assert m["A"]["alpha"] == pytest.approx(0.04) and m["A"]["max_cell_share"] == pytest.approx(6 / 9)
    assert m["B"]["max_cell_share"] == pytest.approx(3 / 9)
    solo = rows(trader_metrics(frame(spark, [position("A", 0.05, i) for i in range(8)]), 8))[0]
    assert (solo["alpha"], solo["n"], solo["n_alpha"]) == (None, 8, 0)
    assert solo["n_alpha_dropped_self_dominated"] == 8 and solo["max_cell_share"] == 1.0


def test_metrics_do_not_depend_on_hot_split(spark):
    import random
    rng = random.Random(3)
    data = [position(f"t{rng.randrange(4)}", rng.uniform(-0.1, 0.1), i, JUL + rng.randrange(90) * 86_400_000 // 2,
                     rng.choice(["BTC", "ETH"]), lev=float(rng.randrange(1, 30))) for i in range(400)]
    df = frame(spark, data).cache()
    plain = rows(trader_metrics(df, 5), "trader_id")
    spark.conf.set("spark.tradewright.hotGroupRows", "20")
    try:
        hot = rows(trader_metrics(df, 5), "trader_id")
    finally:
        spark.conf.unset("spark.tradewright.hotGroupRows")
    for a, b in zip(plain, hot):
        for k in a:
            assert a[k] == (pytest.approx(b[k]) if isinstance(a[k], (float, dict)) else b[k]), k


METRICS = dict(trader_id="t", snapshot_date="2026-08-28", exchange="binance", nick="t", n=100, n_alpha=80, alpha=0.01, t_stat=4.0,
               payoff=1.5, wr=60.0, conc_top1=10.0, ruin=-50.0, mdd=10.0, lev_med=5.0, lev_p90=10.0, marg_med=100.0, dur_med=5.0,
               months_active=4, alpha_h1=0.01, alpha_h2=0.02, monthly_alpha={"2026-07": 0.01}, n_alpha_dropped_self_dominated=0, max_cell_share=0.1)
METRICS_SCHEMA = ("trader_id string, snapshot_date string, exchange string, nick string, n long, n_alpha long, alpha double, t_stat double, "
                  "payoff double, wr double, conc_top1 double, ruin double, mdd double, lev_med double, lev_p90 double, marg_med double, "
                  "dur_med double, months_active long, alpha_h1 double, alpha_h2 double, monthly_alpha map<string,double>, "
                  "n_alpha_dropped_self_dominated long, max_cell_share double")
SNAP = dict(trader_id="t", snapshot_date="2026-08-28", exchange="binance", roi=50.0, start_time=1_600_000_000_000, listed=True,
            copier_pnl=None, copier_count_total=None)
SNAP_SCHEMA = ("trader_id string, snapshot_date string, exchange string, roi double, start_time long, listed boolean, "
               "copier_pnl double, copier_count_total long")

CASES = [
    ({}, {}, []),
    (dict(n=59), {}, ["insufficient"]),
    (dict(payoff=None), {}, ["loss_hider"]),
    (dict(wr=93.0), {}, ["loss_hider"]),
    (dict(payoff=0.4, mdd=36.0), {}, ["loss_hider", "mdd_high"]),
    (dict(payoff=0.4, mdd=None), {}, []),
    (dict(conc_top1=31.0), {}, ["lottery"]),
    (dict(t_stat=1.0), dict(roi=301.0), ["roi_artifact", "no_alpha"]),
    (dict(t_stat=None), {}, ["no_alpha"]),
    (dict(lev_p90=26.0), {}, ["ruin_risk"]),
    (dict(ruin=-501.0, lev_p90=None), {}, ["ruin_risk"]),
    (dict(marg_med=49.0), {}, ["not_copyable"]),
    (dict(dur_med=0.4), {}, ["not_copyable"]),
    (dict(t_stat=2.5), {}, []),
    (dict(mdd=64.0), {}, ["mdd_high"]),
    (dict(alpha_h2=0.005), {}, ["alpha_decay"]),
    ({}, dict(listed=False), ["no_listing_data"]),
    ({}, dict(listed=None), []),
    ({}, dict(copier_pnl=-600.0, copier_count_total=10), ["copiers_losing"]),
    ({}, dict(copier_pnl=-600.0, copier_count_total=9), []),
    ({}, dict(copier_pnl=-300.0, copier_count_total=1000), ["copiers_losing"]),  # half of the lead's 500
    ({}, dict(start_time=1_780_000_000_000), ["fresh_start"]),
    (dict(monthly_alpha={"a": -0.1, "b": -0.2, "c": 0.1}), {}, ["regime_onesided"]),
    (dict(max_cell_share=0.41), {}, ["thin_benchmark"]),
]


def test_every_flag(spark):
    ms, sn, ps = [], [], []
    for i, (m, s, _) in enumerate(CASES):
        ms.append(tuple({**METRICS, **m, "trader_id": f"t{i}"}.values()))
        sn.append(tuple({**SNAP, **s, "trader_id": f"t{i}"}.values()))
        ps.append(position(f"t{i}", 0.1, i, pnl=500.0))
    got = detect(spark.createDataFrame(ms, METRICS_SCHEMA), spark.createDataFrame(sn, SNAP_SCHEMA), frame(spark, ps))
    flags = {r["trader_id"]: r["flags"] for r in rows(got)}
    for i, (m, s, want) in enumerate(CASES):
        assert flags[f"t{i}"] == want, (m, s)


def test_liveness_mass_close_and_open_loss(spark):
    day = 86_400_000
    ps = [position("live", 0.1, 1, JUL + 100 * day, pnl=50.0), position("dark", 0.1, 2, JUL + 78 * day, pnl=50.0),
          position("idle", 0.1, 3, JUL + 60 * day, pnl=50.0)]
    ps += [position("dead", -0.1, 10 + i, JUL + 100 * day, pnl=-20.0) for i in range(5)] + [position("dead", 0.1, 20, JUL + 99 * day, pnl=100.0)]
    ids = ["live", "dark", "idle", "dead"]
    opens = spark.createDataFrame([("2026-08-28", "binance", "live", -101.0)], "snapshot_date string, exchange string, trader_id string, unrealized_pnl double")
    got = detect(spark.createDataFrame([tuple({**METRICS, "trader_id": i}.values()) for i in ids], METRICS_SCHEMA),
                 spark.createDataFrame([tuple({**SNAP, "trader_id": i}.values()) for i in ids], SNAP_SCHEMA), frame(spark, ps), opens)
    assert {r["trader_id"]: r["flags"] for r in rows(got)} == {
        "live": ["open_loss_divergence"], "dark": ["went_dark"], "idle": ["inactive", "went_dark"], "dead": ["mass_close_loss"]}


def test_allocation_keeps_its_rules(spark):
    import random
    rng = random.Random(9)
    data, pools = [], {}
    for g in range(40):
        n = {"A": rng.randrange(0, 6), "B": rng.randrange(0, 3)}
        for t, other, share in (("A", "B", 0.7), ("B", "A", 0.3)):
            pools[f"s{g}", t] = share if n[other] else 1.0
            data += [(f"s{g}", "x", f"{t}{i}", t, rng.uniform(0.1, 6)) for i in range(n[t])]
    got = rows(rk.allocate(spark.createDataFrame(data, "snapshot_date string, exchange string, trader_id string, tier string, score double")))
    groups = {}
    for r in got:
        groups.setdefault((r["snapshot_date"], r["tier"]), []).append(r)
    for (g, t), members in groups.items():
        cap = 0.2 if t == "A" else 0.1
        assert all(0 <= r["weight"] <= cap + 1e-12 for r in members)
        assert sum(r["weight"] for r in members) <= pools[g, t] + 0.025 * len(members) + 1e-9  # weights are rounded to twentieths
        by_score = [r["weight"] for r in sorted(members, key=lambda r: r["score"])]
        assert by_score == sorted(by_score)


def test_allocation_by_example(spark):
    schema = "snapshot_date string, exchange string, trader_id string, tier string, score double"
    data = [("d", "x", "a", "A", 6.0), ("d", "x", "b", "A", 1.0), ("d", "x", "c", "A", 1.0), ("d", "x", "z", "B", 1.0)]
    got = {r["trader_id"]: r["weight"] for r in rows(rk.allocate(spark.createDataFrame(data, schema)))}
    # 70% by score is 52.5%, 8.75%, 8.75%; the first stops at 20% and its excess lifts the others to their caps too
    assert got == pytest.approx({"a": 0.2, "b": 0.2, "c": 0.2, "z": 0.1})


def series(spark, values, trader="t"):
    return spark.createDataFrame([("2026-08-28", "x", trader, i * 10, float(v)) for i, v in enumerate(values)],
                                 "snapshot_date string, exchange string, trader_id string, ts long, value double")


def test_drawdown_screens(spark):
    r = rows(sc.ratio_screen(series(spark, [0, 100, 20, 50])))[0]
    assert r["depth"] == pytest.approx(-0.4) and r["trough_ts"] == 20
    assert rows(sc.level_screen(series(spark, [0.1, -0.3, -0.3])))[0]["trough_ts"] == 10
    p = rows(sc.points_screen(series(spark, [0.0, 0.3, 0.05, 0.2])))[0]
    assert p["depth"] == pytest.approx(25.0) and p["trough_ts"] == 20
    judged = spark.createDataFrame([(None, None, 5), (-0.1, 3, 5), (-0.3, 3, 5), (-0.3, 6, 5)], "depth double, trough_ts long, window_start_ms long")
    assert [x[0] for x in judged.select(sc.covered("level")).collect()] == [True, True, False, True]
    judged = judged.withColumn("depth", F.col("depth") * -100)
    assert [x[0] for x in judged.select(sc.covered("points")).collect()] == [False, True, False, True]


@pytest.mark.parametrize("hot", [False, True])
def test_trade_screen(spark, hot):
    data = [position("t", 0, i, JUL + i * 86_400_000, pnl=p) for i, p in enumerate([-5.0, 20.0, -6.0, 10.0, -9.5])]
    data += [position("never", 0, 50 + i, JUL + i, pnl=-1.0) for i in range(3)]
    df = frame(spark, data)
    keys = df.select("trader_id", "snapshot_date", "exchange").distinct() if hot else None
    got = {r["trader_id"]: r for r in rows(sc.trade_screen(df, keys))}
    assert set(got) == {"t"} and got["t"]["depth"] == pytest.approx(-0.5)


def test_scaled_position_fails_concentration(spark):
    data = [position("t", 0.05, i, JUL + 1000 * i, pnl=300.0) for i in range(3)]
    data = [d[:7] + (JUL + 9_000_000,) + d[8:] for d in data] + [position("t", 0.01, 10 + i, JUL + i * 86_400_000, pnl=60.0) for i in range(20)]
    df = frame(spark, data)
    order = rows(fn.position_concentration(df, "order"))[0]["best_position"]
    scaled = rows(fn.position_concentration(df, "symbol_id_second"))[0]["best_position"]
    assert (order, scaled) == (300.0, 900.0)


def test_funnel_buckets_sum_to_universe(spark):
    import random
    rng = random.Random(4)
    data = [position(f"t{rng.randrange(8)}", rng.gauss(0.01, 0.02), i, JUL + rng.randrange(60) * 86_400_000, rng.choice(["BTC", "ETH"])) for i in range(500)]
    df = frame(spark, data)
    f = fn.funnel(df, FUNNELS["phemex"], sc.trade_screen(df))
    counts = rows(fn.rejection_counts(f))
    assert sum(r["n_traders"] for r in counts) == 8
    for r in rows(f):
        assert r["reject_reason"] == (r["failed"][0] if r["failed"] else None)


def test_age_and_drawdown_as_the_source_publishes_them(spark):
    data = [position(t, 0.01 - 0.02 * (i % 2), 10 * k + i, JUL + i * 86_400_000, pnl=5.0 - 6.0 * (i % 2)) for k, t in enumerate(("old", "new", "silent")) for i in range(4)]
    df = frame(spark, data)
    key = df.select("trader_id", "snapshot_date", "exchange").distinct()
    published = spark.createDataFrame([("old", 400.0, 0.1), ("new", 5.0, 0.5)], "trader_id string, lead_days double, mdd30 double")
    known = key.join(published, "trader_id")

    def flags(exchange, name):
        return {r["trader_id"]: r[name] for r in rows(fn.funnel(df, FUNNELS[exchange], sc.trade_screen(df), headline=known))}

    assert flags("okx", "fresh_start") == {"old": False, "new": True, "silent": True}
    assert flags("kucoin", "fresh_start") == {"old": True, "new": True, "silent": True}
    assert set(flags("phemex", "fresh_start").values()) == {False}
    assert flags("phemex", "hidden_loss") == {"old": False, "new": True, "silent": False}


def test_dedup_rules(spark):
    df = spark.createDataFrame([("a", 1, 10, True), ("a", 2, 20, False), ("a", 3, 30, True), (None, 4, 40, True), (None, 5, 50, True)],
                               "k string, file_pos int, v int, is_raw boolean")
    first = sorted(r["v"] for r in rows(ql.first_wins(df, ["k"], "file_pos")))
    last = sorted(r["v"] for r in rows(ql.last_wins(df, ["k"], "file_pos")))
    shaped = sorted(r["v"] for r in rows(ql.dedup(df, ["k"], [F.col("is_raw").asc(), F.col("file_pos").desc()])))
    assert (first, last, shaped) == ([10, 40, 50], [30, 40, 50], [20, 40, 50])
    assert rows(ql.missing_keys(df, ["k"])) == [{"n_missing_key": 2, "n_rows": 5}]
    assert DetectConfig().min_n == 60


def test_allocation_fills_up_to_the_caps(spark):
    """Against raising one common level of weight per score until the pool is spent or all stand at the cap."""
    import random
    rng = random.Random(4)
    data, want = [], {}
    for g in range(60):
        tiers = {"A": [rng.choice([1.0, 2.0, rng.uniform(0.01, 9)]) for _ in range(rng.randrange(0, 6))], "B": [rng.uniform(0.1, 3) for _ in range(rng.randrange(0, 6))]}
        for t, scores in tiers.items():
            cap = {"A": 0.2, "B": 0.1}[t]
            pool = {"A": 0.7, "B": 0.3}[t] if tiers["A"] and tiers["B"] else 1.0
            low, high = 0.0, 1e3
            for _ in range(200):
                level = (low + high) / 2
                low, high = (level, high) if sum(min(cap, level * s) for s in scores) < pool else (low, level)
            for i, s in enumerate(scores):
                data.append((f"s{g}", "x", f"{t}{i}", t, s))
                want[f"s{g}", f"{t}{i}"] = min(cap, low * s)
    got = rows(rk.allocate(spark.createDataFrame(data, "snapshot_date string, exchange string, trader_id string, tier string, score double")))
    assert len(got) == len(want)
    for r in got:
        assert abs(r["weight"] - want[r["snapshot_date"], r["trader_id"]]) <= 0.025 + 1e-6, r
