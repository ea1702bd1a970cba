"""Candle joins, rank statistics, hedges and streams against brute force."""

import random
import tempfile
from itertools import product

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tradewright.config import DetectConfig
from tradewright.operators import candles as cd
from tradewright.operators import stats as st
from tradewright.plans import studies as sd
from tradewright.streaming.live import dedup_stream, live_mass_closes, mass_close_stream

H = 3_600_000


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(2)
    candles = [(s, h * H, 10.0 + rng.random(), 12.0 + rng.random(), 9.0 - rng.random(), 10.0 + rng.random())
               for s in ("A", "B") for h in range(100, 180) if rng.random() < 0.7]
    trades = []
    for i in range(300):
        o = rng.randrange(95 * H, 190 * H)
        trades.append((i, rng.choice("AB"), rng.choice(["Long", "Short"]), o, o + rng.randrange(0, 60 * H), 10.0))
    return (spark.createDataFrame(candles, "symbol string, open_ms long, open double, high double, low double, close double"), candles,
            spark.createDataFrame(trades, "position_key long, symbol string, side string, opened_ms long, closed_ms long, avg_cost double"), trades)


def test_as_of(market):
    cdf, candles, tdf, trades = market
    got = {r["position_key"]: r["candle_ms"] for r in rows(cd.as_of(tdf, cdf, ["close"]))}
    for k, s, _, o, _, _ in trades:
        before = [c[1] for c in candles if c[0] == s and c[1] <= o]
        assert got[k] == (max(before) if before else None)


def test_interval_extremes(market):
    cdf, candles, tdf, trades = market
    long = [(1000, "A", "Long", 0, 10**6 * H, 10.0), (1001, "B", "Short", 101 * H, 178 * H, 10.0)]
    tdf, trades = tdf.unionByName(tdf.sparkSession.createDataFrame(long, tdf.schema)), trades + long
    got = {r["position_key"]: r for r in rows(cd.interval_extremes(tdf, cdf))}
    assert got.keys() == {t[0] for t in trades}
    for k, s, _, o, c, _ in trades:
        seg = [x for x in candles if x[0] == s and o <= x[1] <= c]
        assert got[k]["hi"] == (max(x[3] for x in seg) if seg else None)
        assert got[k]["lo"] == (min(x[4] for x in seg) if seg else None)


def test_mann_whitney(spark):
    rng = random.Random(8)
    data = [("f", rng.choice(["x", "y", "z"]), float(rng.randrange(15))) for _ in range(200)] + [("f", "tiny", 1.0)] * 3
    got = {r["cell"]: r["z"] for r in rows(st.mann_whitney_cells(spark.createDataFrame(data, "feature string, cell string, v double"), ["feature"], "cell", "v"))}
    for cell in ("x", "y", "z", "tiny"):
        a, b = [v for _, c, v in data if c == cell], [v for _, c, v in data if c != cell]
        u = sum((x > y) + 0.5 * (x == y) for x, y in product(a, b))
        na, nb = len(a), len(b)
        want = 0.0 if na < 20 or nb < 20 else (u - na * nb / 2) / (na * nb * (na + nb + 1) / 12) ** 0.5
        assert got[cell] == pytest.approx(want)


def test_resampling_behaves(spark):
    rng = random.Random(1)
    linked = [(f"t{i}", float(i), i + rng.gauss(0, 3)) for i in range(40)]
    df = spark.createDataFrame(linked, "trader_id string, a double, b double")
    p = rows(st.permutation_p(df, "a", "b", 200))[0]
    ci = rows(st.bootstrap_ci(df, "a", "b", 100))[0]
    assert p["p"] == pytest.approx(1 / 201) and p["rho"] > 0.8 and ci["ci_low"] < p["rho"] <= ci["ci_high"] + 0.05
    noise = spark.createDataFrame([(f"t{i}", rng.random(), rng.random()) for i in range(40)], "trader_id string, a double, b double")
    assert 0.02 < rows(st.permutation_p(noise, "a", "b", 200))[0]["p"] <= 1
    draws = spark.range(1000).select((st.mix(F.lit(3).cast("long"), F.col("id"), 42) / st.MODULUS).alias("u"))
    m = draws.agg(F.avg("u"), F.stddev("u"), F.min("u"), F.max("u")).first()
    assert abs(m[0] - 0.5) < 0.05 and abs(m[1] - 0.2887) < 0.03 and m[2] >= 0 and m[3] < 1


def test_hedge_overlaps(spark):
    rng = random.Random(6)
    data = []
    for i in range(150):
        o = rng.randrange(0, 400) * 1_000_000
        data.append(("x", "d", f"t{rng.randrange(3)}", rng.choice("AB"), i, rng.choice(["Long", "Short"]), o, o + rng.randrange(1, 40) * 1_000_000))
    df = spark.createDataFrame(data, "exchange string, snapshot_date string, trader_id string, symbol string, position_key long, side string, opened_ms long, closed_ms long")
    got = {r["position_key"]: r["n_overlaps"] for r in rows(sd.hedge_legs(df))}
    lower = df.withColumn("side", F.lower("side"))
    assert {r["position_key"]: r["n_overlaps"] for r in rows(sd.hedge_legs(lower))} == got
    assert rows(sd.hedge_overlap(lower)) == rows(sd.hedge_overlap(df))
    for a in data:
        want = sum(a[2:4] == b[2:4] and a[5] != b[5] and b[6] < a[7] and b[7] > a[6] for b in data)
        assert got[a[4]] == want


def test_a_leg_is_two_marks(spark):
    """Touching legs don't overlap, legs that start or end together do, a leg without a side is opposite to none; no more than two rows a leg are sorted."""
    data = [("Long", 0, 10), ("Short", 10, 20), ("Short", 0, 10), ("Long", 15, 20), (None, 5, 18), ("Long", 30, 30)]
    df = spark.createDataFrame([("x", "d", "t", "A", i, *r) for i, r in enumerate(data)],
                               "exchange string, snapshot_date string, trader_id string, symbol string, position_key long, side string, opened_ms long, closed_ms long")
    legs = sd.hedge_legs(df)
    assert {r["position_key"]: r["n_overlaps"] for r in rows(legs)} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}
    plan = legs._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(" in plan and plan.split("explode(array(")[1].split("\n")[0].count("struct(") <= 2


def test_alpha_without_hedges(spark):
    """Nested, touching and crossing intervals in either case of the side; the second benchmark is made of unhedged positions only."""
    day = 86_400_000
    spans = [("h", "Long", 0, 10), ("h", "short", 2, 3), ("h", "LONG", 20, 22), ("h", "Short", 22, 24), ("h", "long", 30, 35), ("h", "Long", 31, 33),
             ("c", "Short", 0, 5), ("c", "long", 4, 8), ("n", "Long", 0, 9), ("n", "Long", 1, 9), ("m", "Short", 0, 9), ("o", "Long", 3, 3)]
    data = [("x", "d", t, "A", i, side, a * day, b * day, "1970-01", (i * 37 % 11 - 5) / 100) for i, (t, side, a, b) in enumerate(spans)]
    schema = "exchange string, snapshot_date string, trader_id string, symbol string, position_key long, side string, opened_ms long, closed_ms long, month string, pr double"
    df = spark.createDataFrame(data, schema).withColumn("side", F.initcap("side"))
    rec = [(r[2], r[5].capitalize(), r[6], r[7], r[9]) for r in data]
    hedge = [any(b[0] == a[0] and b[1] != a[1] and b[2] < a[3] and b[3] > a[2] and b[3] > b[2] and a[3] > a[2] for b in rec) for a in rec]
    assert sum(hedge) == 4

    def mean_alpha(trader, part):
        out = []
        for t, side, _, _, pr in part:
            others = sorted(x[4] for x in part if x[1] == side and x[0] != trader)
            if t == trader and others:
                out.append(pr - (others[(len(others) - 1) // 2] + others[len(others) // 2]) / 2)
        return sum(out) / len(out) if out else None

    got = {r["trader_id"]: r for r in rows(sd.alpha_without_hedges(df, 1))}
    assert set(got) == {"h", "c"}
    rest = [a for a, g in zip(rec, hedge) if not g]
    for t, r in got.items():
        assert r["n_hedge_legs"] == 2 and r["n_all"] == sum(a[0] == t for a in rec)
        assert r["alpha_all"] == pytest.approx(mean_alpha(t, rec))
        assert (r["n_unhedged"] or 0) == sum(a[0] == t for a in rest)
        assert r["alpha_unhedged"] == (None if mean_alpha(t, rest) is None else pytest.approx(mean_alpha(t, rest)))
    lower = {r["trader_id"]: (r["n_hedge_legs"], r["n_unhedged"]) for r in rows(sd.alpha_without_hedges(df.withColumn("side", F.lower("side")), 1))}
    assert lower == {t: (r["n_hedge_legs"], r["n_unhedged"]) for t, r in got.items()}


def test_greedy_selection(spark):
    df = spark.createDataFrame([([200, 201, 230, 248, 300, 310],)], "i array<long>")
    assert df.select(sd._non_overlapping(F.col("i"), F.lit(24))).first()[0] == [200, 230, 300]


def test_streams_equal_batch(spark):
    root = tempfile.mkdtemp(prefix="run-")
    base = spark.sql("select timestamp_seconds(1700000000 + id div 6) closed_ts, 'x' exchange, concat('t', id % 2) trader_id, if(id % 2 = 0, -1.0D, 1.0D) pnl, id % 40 k from range(60)")
    late = spark.sql("select timestamp_seconds(1700009999) closed_ts, 'x' exchange, 'end' trader_id, 0.0D pnl, 99L k")
    dense = base.withColumn("closed_ts", F.expr("timestamp_seconds(1700000000 + (k div 20))"))
    dense.unionByName(late).coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(dense.schema).parquet(f"{root}/in")
    q = mass_close_stream(stream).writeStream.outputMode("append").format("memory").queryName("mass").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("mass").collect()))
    want = sorted(map(tuple, dense.groupBy("exchange", "trader_id", F.unix_seconds("closed_ts").alias("second")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("net")).filter("n >= 5 and net < 0").collect()))
    assert got == want and got
    q = dedup_stream(spark.readStream.schema(dense.schema).parquet(f"{root}/in"), ["k"], "closed_ts").writeStream.outputMode("append").format(
        "memory").queryName("dd").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dd").count() == 41


def test_live_clusters_count_each_position_once(spark):
    """Repeated deliveries, one id on two exchanges, and a row far too late; against the batch result over distinct positions in time."""
    root = tempfile.mkdtemp(prefix="run-")
    schema = "seq int, closed_ts long, exchange string, trader_id string, position_key string, pnl double"
    base = [(1, 1_700_000_000 + i // 8, "a" if i % 2 else "b", "same", f"p{i}", -1.0) for i in range(64)]
    again = [(2, *r[1:]) for r in base[:40]] + [(2, 1_700_000_003, "a", "same", f"q{i}", -2.0) for i in range(3)]
    ahead = [(3, 1_700_009_000, "a", "end", "z", 0.0)]
    late = [(4, 1_700_000_000, "a", "same", f"late{i}", -9.0) for i in range(9)] + [(4, 1_700_019_000, "a", "end", "zz", 0.0)]
    schema_ts = schema.replace("closed_ts long", "closed_ts timestamp")
    for part in (base, again, ahead, late):  # one micro-batch each
        spark.createDataFrame(part, schema).withColumn("closed_ts", F.timestamp_seconds("closed_ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema_ts).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        q = live_mass_closes(stream, "1 minute", DetectConfig(mass_close_positions=4)).writeStream.outputMode("append").format("parquet").option(
            "checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").select("exchange", "trader_id", "second", "n", "net").collect())
    distinct = {(r[2], r[3], r[4]): r for r in base + again}.values()
    counts = {}
    for _, second, exchange, trader, _, pnl in distinct:
        n, net = counts.get((exchange, trader, second), (0, 0.0))
        counts[exchange, trader, second] = (n + 1, net + pnl)
    assert got == sorted((*k, *v) for k, v in counts.items() if v[0] >= 4) and len(got) == 16
