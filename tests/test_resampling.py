"""The registered resampling queries at the published counts against a plain loop over the iterations."""

import __spark_entry__ as entry
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tradewright.operators import resampling
from tradewright.operators import stats as st
from tradewright.plans import catalog, studies as sd

SF, RULES_SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # on the smallest tables no trade meets the rule
N_PERM, N_BOOT, N_RULE = 10_000, 2_000, 20_000


def draws(step, n, seed):
    m, slot = st.MODULUS, np.arange(n, dtype=np.int64)
    h = ((slot + 1) * 1103515245 + (step + 1) * 12345677 + seed) % m
    h = (h * h + slot) % m
    h = (h * 48271 + step) % m
    return (h * h + slot * 7) % m


def mean_ranks(v):
    v = np.asarray(v)
    low = np.searchsorted(np.sort(v), v)
    return (low + np.searchsorted(np.sort(v), v, "right") + 1) / 2


def rho(x, y):
    return 0.0 if np.ptp(x) == 0 or np.ptp(y) == 0 else np.corrcoef(x, y)[0, 1]


def by_loop(per, a, b):
    data = sorted((str(r["trader_id"]), r[a], r[b]) for r in per.collect())
    va, vb = (np.array([r[i] for r in data]) for i in (1, 2))
    n, x, y = len(data), mean_ranks(va), mean_ranks(vb)
    seen = rho(x, y)
    hits = 0
    for step in range(1, N_PERM + 1):
        order = np.lexsort((np.arange(n), draws(step, n, 42)))
        hits += abs(rho(x[order], y)) >= abs(seen) - 1e-12
    sims = []
    for step in range(1, N_BOOT + 1):
        pick = draws(step, n, 42) % n
        sims.append(rho(mean_ranks(va[pick]), mean_ranks(vb[pick])))
    sims.sort()
    return n, seen, (hits + 1) / (N_PERM + 1), sims[int(0.025 * N_BOOT)], sims[int(0.975 * N_BOOT)]


def gap_by_loop(data, n_iter, seed=11):
    """p of the difference of means of (ident, value, label) rows."""
    data = sorted(data, key=lambda r: str(r[0]))
    v = np.array([np.nan if r[1] is None else r[1] for r in data])
    label = np.array([r[2] for r in data], bool)
    mean = lambda part: part[~np.isnan(part)].mean() if (~np.isnan(part)).any() else np.nan
    seen, n_a, hits = abs(mean(v[label]) - mean(v[~label])), label.sum(), 0
    for step in range(1, n_iter + 1):
        w = v[np.lexsort((np.arange(len(v)), draws(step, len(v), seed)))]
        hits += abs(mean(w[:n_a]) - mean(w[n_a:])) >= seen - 1e-15
    return (hits + 1) / (n_iter + 1)


def agree(got, want):
    for name, value in zip(("n", "rho", "p", "ci_low", "ci_high"), want):
        assert got[name] == pytest.approx(value, abs=2e-6), (name, got)


def test_persistence_runs_the_published_counts(spark):
    valid = catalog._positions(spark, SF).filter(F.col("pr").isNotNull())
    per = st.halves_profile(sd.own_halves(valid), "pr", 10)
    got = {r["metric"]: r for r in rows(entry.queries()["e1_persistence"](spark, SF))}
    for metric in ("wr", "payoff", "exp"):
        agree(got[metric], by_loop(per, f"{metric}1", f"{metric}2"))


def test_pooled_persistence_runs_the_published_counts(spark):
    got = {r["control"]: r for r in rows(entry.queries()["e2_pooled_persistence"](spark, SF))}
    for control, demean in (("raw", False), ("demeaned", True)):
        agree(got[control], by_loop(sd.pooled_halves(catalog._positions(spark, SF), demean), "exp1", "exp2"))


def test_rule_significance_runs_the_published_count(spark):
    second = catalog._rule_rows(spark, RULES_SF).filter("half = 1").select(
        "position_key", sd.overlay().alias("v"), sd.conjunctive_rules()["R3"].alias("picked"))
    got = rows(entry.queries()["e8_rule_significance"](spark, RULES_SF))[0]
    assert got["n_a"] > 0
    assert got["p"] == pytest.approx(gap_by_loop([tuple(r) for r in second.collect()], N_RULE), abs=2e-6)


@pytest.mark.parametrize("picked", [0, 1, 7, 20, 39, 40])
def test_mean_permutation_splits_where_the_sorted_draws_do(spark, picked):
    data = [(i, None if i % 9 == 4 else float((i * 7) % 5), (i * 11) % 40 < picked) for i in range(40)]
    got = rows(st.mean_permutation_p(spark.createDataFrame(data, "position_key long, v double, ok boolean"), "v", "ok", 300))[0]
    assert (got["n_a"], got["n_b"]) == (picked, 40 - picked)
    assert got["p"] == pytest.approx(gap_by_loop(data, 300) if 0 < picked < 40 else 1 / 301)


def test_iterations_in_a_task_agree_with_shuffles(spark):
    """Ties, missing values, an empty table and one of a single row: a task that holds the table gives what shuffles give, and shuffles nothing."""
    rng = np.random.default_rng(4)
    data = [(f"t{i}", None if i % 11 == 0 else float(rng.integers(0, 9)), None if i % 13 == 0 else float(rng.normal())) for i in range(60)]
    for part in (data, data[1:2], []):
        df = spark.createDataFrame(part, "trader_id string, a double, b double")
        for test in (st.permutation_p, st.bootstrap_ci):
            want, got = (rows(test(df, "a", "b", 40, held_rows=limit)) for limit in (-1, 1_000))
            assert len(got) == len(want)
            for g, w in zip(got, want):
                assert {k: None if v is None else pytest.approx(v, abs=1e-12) for k, v in w.items()} == g
    step = spark.range(5).select((F.col("id") * 4001).alias("s")).crossJoin(spark.range(2_000))
    mixed = step.select("s", "id", st.mix(F.col("s"), F.col("id"), 42).alias("h")).orderBy("s", "id").collect()
    assert [r["h"] for r in mixed] == [int(h) for s in range(5) for h in resampling.draws(s * 4001, 2_000, 42)]
    df = spark.createDataFrame(data, "trader_id string, a double, b double")
    held = st.permutation_p(df, "a", "b", 40)
    assert "mapinarrow" in held._jdf.queryExecution().optimizedPlan().toString().lower() and "Window" not in held._jdf.queryExecution().optimizedPlan().toString()
