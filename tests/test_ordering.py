import math
import random
import statistics as st
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tradewright.operators import alpha as al
from tradewright.operators import ordering as od

LIMITS = [10_000, 3]  # all groups ordinary / nearly all groups hot


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    recs = []
    for i in range(600):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(6)}"
        recs.append((g, f"t{rng.randrange(5)}", rng.choice([-0.5, 0.0, 0.01, rng.uniform(-2, 2)]),
                     rng.choice([None, rng.uniform(0, 5000)]), 1_600_000_000_000 + rng.randrange(40) * 50_000_000, i))
    recs += [("solo", "t9", 0.1 * i, 1.0, 1_600_000_000_000, 1000 + i) for i in range(6)]
    recs.append(("tiny", "t1", 0.2, None, 1_600_000_000_000, 2000))
    return spark.createDataFrame(recs, "g string, t string, v double, w double, ms long, k long").cache(), recs


@pytest.mark.parametrize("limit", LIMITS)
def test_quantiles_match_definition(data, limit):
    df, recs = data
    wanted = {"med": od.median("v"), "p90": od.index_quantile("v", 0.9), "q": od.exclusive_quantile("v", 9, 10),
              "wmed": od.median("w"), "cut": od.slot_quantile("ms", 1, 3)}
    got = {r["g"]: r for r in rows(od.group_quantiles(df, ["g"], wanted, od.hot_keys(df, ["g"], limit)))}
    groups = defaultdict(list)
    for r in recs:
        groups[r[0]].append(r)
    assert set(got) == set(groups)
    for g, v in groups.items():
        xs = sorted(r[2] for r in v)
        ws = [r[3] for r in v if r[3] is not None]
        ms = sorted(r[4] for r in v)
        assert got[g]["med"] == st.median(xs)
        assert got[g]["p90"] == xs[int(0.9 * len(xs))]
        assert got[g]["cut"] == ms[len(ms) // 3]
        assert got[g]["wmed"] == (st.median(ws) if ws else None)
        if len(xs) > 1:
            assert math.isclose(got[g]["q"], st.quantiles(xs, n=10)[8], abs_tol=1e-12)


def test_quantiles_of_everything(data):
    df, recs = data
    got = rows(od.group_quantiles(df, [], {"med": od.median("v"), "cut": od.slot_quantile("ms", 1, 2)}))
    xs, ms = [r[2] for r in recs], sorted(r[4] for r in recs)
    assert got == [{"med": st.median(xs), "cut": float(ms[len(ms) // 2])}]


@pytest.mark.parametrize("limit", LIMITS)
def test_groups_without_values_or_key_give_a_row(spark, limit):
    df = spark.createDataFrame([("a", None)] * 5 + [("b", 1.0)] * 4 + [(None, 2.0)] * 4 + [(None, None)], "g string, v double")
    got = od.group_quantiles(df, ["g"], {"med": od.median("v"), "p": od.index_quantile("v", 0.9)}, od.hot_keys(df, ["g"], limit))
    assert {r["g"]: (r["med"], r["p"]) for r in rows(got)} == {"a": (None, None), "b": (1.0, 1.0), None: (2.0, 2.0)}
    for none in (df.filter("g = 'a'"), df.limit(0)):
        assert rows(od.group_quantiles(none, [], {"med": od.median("v")})) == [{"med": None}]


def test_ordinal_rank_keeps_missing_values(spark):
    df = spark.createDataFrame([("x", 2.0), ("y", None), ("z", 1.0), ("w", None)], "t string, v double")
    assert {r["t"]: r["pos"] for r in rows(od.ordinal_rank(df, [], "v", "t", "pos"))} == {"w": 0, "y": 1, "z": 2, "x": 3}


@pytest.mark.parametrize("limit", LIMITS)
def test_positions(data, limit):
    df, recs = data
    got = rows(od.position_in_group(df, ["g"], ["ms", "k"], od.hot_keys(df, ["g"], limit)))
    assert len(got) == len(recs)
    expect = {}
    groups = defaultdict(list)
    for r in recs:
        groups[r[0]].append((r[4], r[5]))
    for g, v in groups.items():
        for i, (_, k) in enumerate(sorted(v)):
            expect[k] = (i, len(v))
    assert {r["k"]: (r["pos"], r["cnt"]) for r in got} == expect


def test_ranks(data):
    df, recs = data
    got = {r["k"]: r for r in rows(od.ordinal_rank(od.average_rank(df, ["g"], "v", "avg"), ["g"], "v", "k", "ord"))}
    groups = defaultdict(list)
    for r in recs:
        groups[r[0]].append(r)
    for v in groups.values():
        for pos, r in enumerate(sorted(v, key=lambda r: (r[2], str(r[5])))):
            below, same = sum(x[2] < r[2] for x in v), sum(x[2] == r[2] for x in v)
            assert got[r[5]]["ord"] == pos
            assert got[r[5]]["avg"] == below + (same + 1) / 2


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("min_cell", [1, 7])
def test_leave_self_out_matches_definition(data, limit, min_cell):
    df, recs = data
    cells = al.cell_table(df, min_cell, ["g"], "v")
    bench = al.leave_self_out(df, cells, ["g"], "t", "v", "k", limit).join(cells.select("g", "cell_no"), "cell_no")
    got = {(r["g"], r["t"]): r for r in rows(bench)}
    groups = defaultdict(list)
    for r in recs:
        groups[r[0]].append(r)
    expect = {}
    for g, v in groups.items():
        if len(v) >= min_cell:
            for t in {r[1] for r in v}:
                others = [r[2] for r in v if r[1] != t]
                expect[g, t] = (len(v), len(v) - len(others), st.median(r[2] for r in v),
                                st.median(others) if others else None)
    assert {k: (r["n_cell"], r["n_own"], r["bench"], r["lso"]) for k, r in got.items()} == expect


def test_leave_self_out_ignores_partitioning(data):
    df, _ = data
    cells = al.cell_table(df, 3, ["g"], "v")
    a = rows(al.leave_self_out(df.repartition(1), cells, ["g"], "t", "v", "k"), "cell_no", "t")
    b = rows(al.leave_self_out(df.repartition(13), cells, ["g"], "t", "v", "k"), "cell_no", "t")
    assert a == b


def exchanges(df):
    """Hash exchanges of the plan without AQE and broadcasts."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def plain_plans(spark):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_prefix_moves_the_rows_once(spark, plain_plans):
    df = spark.createDataFrame([("a", None, 1, 2.0), (None, 3, 1, 1.0), (None, None, 2, 5.0)], "g string, h int, c int, v double")
    out = od.exclusive_prefix(df, ["g", "h"], "c", ["v"], F.lit(1), "p")
    assert exchanges(out) == 4 and out.count() == 3  # rows; totals; their windows; their way to the join
    assert exchanges(od.running_max(df, ["g", "h"], "c", ["v"], "v", "p")) == 4


@pytest.mark.parametrize("column", ["ident", "price", "ms", "same"])
def test_splitters_are_even(spark, plain_plans, column):
    """Ids of one prefix, prices of one level, times of one day, and equal rows: no range has more than twice its share."""
    df = spark.range(40_000).selectExpr("concat('Supplier#0000', lpad(cast(id as string), 9, '0')) ident", "100 + (id * 7919 % 40000) / 1e7D price",
                                        "1700000000000 + id * 2000 ms", "1 same", "'hot' g", "id k")
    sizes = [r["count"] for r in od.split_by_order(df.repartition(8), ["g"], [column]).groupBy("_chunk").count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 40_000 and len(sizes) == parts and max(sizes) <= 2 * 40_000 / parts
    got = od.global_positions(df, [column], "pos")
    assert [r["pos"] for r in got.orderBy("pos").select("pos").collect()] == list(range(40_000))
    assert got.selectExpr(f"min_by({column}, pos) = min({column}) and max_by({column}, pos) = max({column}) ok").first()["ok"]


def test_global_positions_take_nulls_and_nothing(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "x string")
    assert [r["x"] for r in od.global_positions(df, ["x"], "p").orderBy("p").collect()] == [None, "a", "b", "b"]
    assert od.global_positions(df.limit(0), ["x"], "p").count() == 0


def test_hot_groups_keep_rows_without_time_or_key(spark):
    from pyspark.sql import functions as F

    from tradewright.operators.ordering import position_in_group

    data = [("a", t, k) for k, t in enumerate([1, None, 3, None, 5])] + [(None, t, k) for k, t in enumerate([None, 2])]
    df = spark.createDataFrame(data, "g string, t long, k long")
    order = [F.col("t"), F.col("k")]
    plain = position_in_group(df, ["g"], order, hot=None)
    hot = position_in_group(df, ["g"], order, hot=df.select("g").distinct())
    key = lambda d: sorted((str(r["g"]), str(r["t"]), r["k"], r["pos"], r["cnt"]) for r in d.collect())
    assert key(plain) == key(hot) and len(key(hot)) == 7


@pytest.mark.parametrize("widest, limit", [(256, 1_000_000), (256, 3), (2, 3)])
def test_middle_of_odd_distributions(spark, monkeypatch, widest, limit):
    """Ties, a gap in the very middle, outliers beyond any histogram, one trader with most rows: medians by sorting."""
    monkeypatch.setattr(al, "WIDEST", widest)
    rng = random.Random(3)
    cells = {
        "ties": [1.0] * 40 + [2.0] * 40, "gap": [-1.0] * 5 + [1.0] * 5, "outliers": [1e300, -1e300, 1e-300, 0.0] + [rng.random() for _ in range(60)],
        "same": [0.5] * 30, "two": [1.0, 3.0], "one": [7.0], "near": [1.0 + i * 2 ** -52 for i in range(50)], "mixed": [rng.choice([0.0, -0.0, 0.25, rng.gauss(0, 1)]) for _ in range(200)]}
    data = [(g, f"t{0 if rng.random() < 0.5 else rng.randint(1, 9)}", v) for g, values in cells.items() for v in values]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "g string, t string, v double, k long")
    table = al.cell_table(df, 1, ["g"], "v")
    got = {(r["g"], r["t"]): r for r in al.leave_self_out(df, table, ["g"], "t", "v", "k", limit).join(table.select("g", "cell_no"), "cell_no").collect()}
    middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 if v else None
    assert set(got) == {(g, t) for g, t, _ in data}
    for (g, t), r in got.items():
        whole, others = [v for h, _, v in data if h == g], [v for h, u, v in data if h == g and u != t]
        assert (r["n_cell"], r["n_own"], r["bench"], r["lso"]) == (len(whole), len(whole) - len(others), middle(whole), middle(others)), (g, t)
    bench = {r["g"]: r["bench"] for r in al.cell_benchmark(df, 1, ["g"], "v").collect()}
    assert bench == {g: middle(v) for g, v in cells.items()}


def test_cell_medians_move_few_values(spark, data):
    """No window runs over the rows themselves: each one's input is an aggregate of them."""
    df = spark.range(20_000).selectExpr("cast(id % 3 as string) g", "cast(id % 50 as string) t", "(id * 7919 % 10007) / 1000.0D v", "id k")
    table = al.cell_table(df, 3, ["g"], "v")
    bounds = al.narrowed(df.join(table, "g").select("cell_no", "v"), table.selectExpr("cell_no", "n_cell div 2 _from", "n_cell div 2 _to", "_low", "_high", "0L _below")).collect()
    assert all(r["_inside"] < 20_000 / 3 / 20 for r in bounds)


def test_only_the_asked_ranks_of_a_cell_are_kept(spark):
    """However many rows a bin of the histogram leaves in range, what every (cell, trader) row is joined with is as short as the ranks asked for."""
    df = spark.range(30_000).selectExpr("cast(id % 2 as string) g", "(id * 7919 % 30011) / 1000.0D v")
    table = al.cell_table(df, 1, ["g"], "v")
    mine = df.join(table, "g").select("cell_no", "v")
    cells = table.selectExpr("cell_no", "n_cell", "_low", "_high", "n_cell div 2 - 2 _from", "n_cell div 2 + 2 _to")
    got = {r["cell_no"]: r for r in al.middle_values(mine, cells, 1_000_000).collect()}
    for cell, g in [(r["cell_no"], r["g"]) for r in table.collect()]:
        values = sorted(r["v"] for r in df.filter(F.col("g") == g).collect())
        mid = len(values) // 2
        assert got[cell]["_values"] == values[mid - 2:mid + 3] and got[cell]["_from"] == mid - 2
        assert [x["at"] for x in got[cell]["at_v"]] == list(range(mid - 2, mid + 3))
    heavy = spark.range(3000).selectExpr("if(id % 10 < 8, 1.0D, 1.0D + id) v", "0L cell_no")
    bounds = heavy.groupBy("cell_no").agg(F.count("v").alias("n_cell"), F.min("v").alias("_low"), F.max("v").alias("_high")).selectExpr("*", "1490L _from", "1510L _to")
    r = al.middle_values(heavy, bounds, 1_000_000).first()
    assert r["_values"] == [1.0] * 21 and [(x["at"], x["v"], x["_c"]) for x in r["at_v"]] == [(0, 1.0, 2400)]
