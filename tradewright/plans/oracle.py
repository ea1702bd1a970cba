"""SQL twins of the registered queries, in the naive definition (self joins, range joins, sorted lists)."""

from __future__ import annotations

from tradewright.config import BAD, NOT_A_DEFECT, WARNINGS


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def med(x: str, cond: str = "TRUE") -> str:
    """Middle of the sorted list: the mean of its two middle elements."""
    a = f"list_sort(list({x}) FILTER (WHERE ({cond}) AND ({x}) IS NOT NULL))"
    return f"(({a})[(len({a}) - 1) // 2 + 1] + ({a})[len({a}) // 2 + 1]) / 2"


def idx(x: str, p: str, cond: str = "TRUE") -> str:
    """sorted[floor(p * n)]"""
    a = f"list_sort(list({x}) FILTER (WHERE ({cond}) AND ({x}) IS NOT NULL))"
    return f"({a})[CAST(least(floor({p} * len({a})), len({a}) - 1) AS BIGINT) + 1]"


def slot(x: str, num: int, den: int, cond: str = "TRUE") -> str:
    a = f"list_sort(list({x}) FILTER (WHERE ({cond}) AND ({x}) IS NOT NULL))"
    return f"({a})[least({num} * len({a}) // {den}, len({a}) - 1) + 1]"


def excl(x: str, num: int, den: int, cond: str = "TRUE") -> str:
    a = f"list_sort(list({x}) FILTER (WHERE ({cond}) AND ({x}) IS NOT NULL))"
    n = f"len({a})"
    j = f"greatest(1, least({num} * ({n} + 1) // {den}, {n} - 1))"
    d = f"({num} * ({n} + 1) - {j} * {den})"
    return f"(({a})[{j}] * ({den} - {d}) + ({a})[{j} + 1] * {d}) / {den}"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


def payoff(x: str) -> str:
    return f"avg({x}) FILTER (WHERE {x} > 0) / abs(avg({x}) FILTER (WHERE {x} < 0))"


def share(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END)"


def t_of(x: str) -> str:
    return f"CASE WHEN count({x}) >= 2 AND stddev_pop({x}) > 0 THEN avg({x}) / (stddev_pop({x}) / sqrt(count({x}))) ELSE 0 END"


POS0 = """pos0 AS (
  SELECT *, (closed_ms - opened_ms) / 36e5 AS dur_h, notional / leverage AS margin,
    price * (1 + sgn * edge) AS avg_close, notional * (edge - 8e-4) AS pnl, edge * leverage AS roi,
    strftime(make_timestamp(opened_ms * 1000), '%Y-%m') AS month
  FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS trader_id, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS nick, p_type AS symbol,
      CASE WHEN l_linestatus = 'O' THEN 'Long' ELSE 'Short' END AS side, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sgn,
      epoch_ms(l_shipdate) + (l_orderkey % 86400) * 1000 AS opened_ms,
      CASE WHEN l_suppkey % 10 = 0 THEN epoch_ms(CAST(last_day(l_shipdate) AS TIMESTAMP)) + 86399000
        ELSE epoch_ms(l_shipdate) + (l_orderkey % 86400) * 1000 + CAST(l_quantity * l_linenumber / 4e0 * 3600000 AS BIGINT) END AS closed_ms,
      l_extendedprice AS notional, CAST(l_linenumber * (CASE WHEN l_suppkey % 5 = 0 THEN 5 ELSE 3 END) AS DOUBLE) AS leverage,
      CASE WHEN l_orderkey % 97 = 0 THEN 0e0 ELSE p_retailprice END AS avg_cost, p_retailprice AS price,
      (l_discount - 5e-2) + (l_suppkey % 7 - 3) * 2e-3 + (l_tax - 4e-2) / 1e1
        + ((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber) % 9973 - 4986) / 9973e0 * 4e-3 AS edge,
      l_returnflag = 'A' AS partial, l_quantity AS max_oi,
      l_quantity * (CASE WHEN l_returnflag = 'A' THEN 9e-1 ELSE 1e0 END) AS closed_volume,
      CASE WHEN l_orderkey % 3 > 0 THEN 'Cross' ELSE 'Isolated' END AS isolated,
      (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey AS position_key, CAST(l_shipdate AS DATE) AS ship, l_returnflag AS flag
    FROM lineitem JOIN part ON l_partkey = p_partkey))"""
PR = """CASE WHEN avg_cost > 0 AND avg_close > 0 AND notional > 0 AND leverage > 0 AND abs((avg_close / avg_cost - 1) * sgn) <= 3
  THEN (avg_close / avg_cost - 1) * sgn END AS pr"""
POS = f"{POS0}, pos AS (SELECT '2002-01-01' AS snapshot_date, 'binance' AS exchange, *, {PR} FROM pos0)"
POS2 = f"""{POS0}, pos AS (SELECT '2002-01-01' AS snapshot_date, 'binance' AS exchange, *, {PR} FROM pos0
  UNION ALL SELECT '2000-01-01', 'binance', *, {PR} FROM pos0 WHERE ship < DATE '2000-01-01')"""
V = "v AS (SELECT * FROM pos WHERE pr IS NOT NULL)"
SUP = """sup AS (SELECT d.snapshot_date, CAST(s_suppkey AS VARCHAR) AS trader_id, s_name AS nick, s_acctbal / 1e1 AS roi,
  CAST((s_suppkey * 37) % 100 AS DOUBLE) AS mdd, CASE WHEN s_nationkey % 4 = 1 THEN NULL ELSE s_nationkey % 4 <> 0 END AS listed,
  s_suppkey % 50 AS copier_count_total, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal - 4e3 END AS copier_pnl,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1009843200000 - (s_suppkey % 400) * 86400000 END AS start_time, s_acctbal * 1e3 AS aum
  FROM supplier, (VALUES ('2002-01-01'), ('2000-01-01')) d(snapshot_date))"""
SUP1 = SUP.replace(", ('2000-01-01')", "")
OPEN = """opn AS (SELECT trader_id, symbol, side, notional, CASE WHEN position_key % 5 = 0 THEN NULL ELSE pnl * -2e0 END AS upl
  FROM pos0 WHERE flag = 'R' AND ship >= DATE '2001-01-01')"""
EQUITY = """eq AS (SELECT trader_id, ts, sum(p) OVER (PARTITION BY trader_id ORDER BY ts) / 2e5 * 1e2 AS value FROM (
  SELECT trader_id, closed_ms // 86400000 * 86400000 AS ts, sum(pnl) AS p FROM pos0 GROUP BY ALL))"""


def alpha_ctes(min_cell: int = 20, value: str = "pr", source: str = "v") -> str:
    """Leave-self-out by definition: the median over all rows of the cell that belong to others."""
    c = "snapshot_date, symbol, month, side"
    return f"""cells AS (SELECT {c}, count(*) AS n_cell, {med(value)} AS bench FROM {source} GROUP BY {c} HAVING count(*) >= {min_cell}),
own AS (SELECT {c}, trader_id, count(*) AS n_own FROM {source} GROUP BY {c}, trader_id),
others AS (SELECT {', '.join('o.' + x for x in c.split(', '))}, o.trader_id, {med('w.' + value)} AS lso
  FROM own o JOIN {source} w ON o.snapshot_date = w.snapshot_date AND o.symbol = w.symbol AND o.month = w.month AND o.side = w.side
    AND o.trader_id <> w.trader_id GROUP BY ALL),
lso AS (SELECT * FROM own JOIN cells USING ({c}) LEFT JOIN others USING ({c}, trader_id)),
al AS (SELECT x.*, x.{value} - l.lso AS alpha, x.{value} - l.bench AS alpha_incl FROM {source} x LEFT JOIN lso l USING ({c}, trader_id))"""


def metrics_ctes() -> str:
    k = "snapshot_date, trader_id"
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {k}, alpha IS NULL ORDER BY opened_ms, position_key) - 1 AS pos,
  count(alpha) OVER (PARTITION BY {k}) AS na FROM al),
mon AS (SELECT {k}, month, count(alpha) AS c, avg(alpha) AS m FROM al GROUP BY ALL),
mons AS (SELECT {k}, count(*) AS months_active, count(*) FILTER (WHERE c >= 5) AS n_months, count(*) FILTER (WHERE c >= 5 AND m > 0) AS n_good,
  list_sort(list({{'month': month, 'm': m}}) FILTER (WHERE c >= 5)) AS months FROM mon GROUP BY ALL),
slope AS (SELECT {k}, CASE WHEN count(*) >= 3 THEN regr_slope(m, i) END AS slope FROM (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY month) AS i FROM mon WHERE c >= 5) GROUP BY ALL),
dom AS (SELECT {k}, CAST(sum(CASE WHEN n_own = n_cell THEN n_own ELSE 0 END) AS BIGINT) AS dropped, max(n_own / n_cell) AS top_share FROM lso GROUP BY ALL),
base AS (SELECT {k}, arg_min(nick, opened_ms * 10000 + position_key % 10000) AS nick, count(*) AS n, count(alpha) AS n_alpha, avg(alpha) AS alpha,
  {t_of('alpha')} AS t_stat, {payoff('pr')} AS payoff, {share('pr > 0')} * 100 AS wr,
  CASE WHEN sum(pnl) > 0 THEN max(pnl) / sum(pnl) * 100 END AS conc_top1, min(pr) FILTER (WHERE pr < 0) * {med('leverage')} * 100 AS ruin,
  {med('leverage')} AS lev_med, {idx('leverage', '9e-1')} AS lev_p90, {med('margin')} AS marg_med, {med('dur_h')} AS dur_med,
  avg(alpha) FILTER (WHERE pos < na // 2) AS alpha_h1, avg(alpha) FILTER (WHERE pos >= na // 2) AS alpha_h2,
  {t_of('alpha_incl')} AS t_incl, count(DISTINCT symbol) AS n_syms, sum(pnl) AS total_pnl, max(pnl) AS best_pnl,
  count(*) FILTER (WHERE pr > 0) AS n_win, count(*) FILTER (WHERE pr < 0) AS n_loss, min(opened_ms) AS window_start_ms,
  (max(closed_ms) - min(opened_ms)) / 864e5 AS span_days
  FROM num GROUP BY ALL),
met AS (SELECT b.*, m.months_active, m.n_months, m.n_good, m.months, s.slope, coalesce(d.dropped, 0) AS dropped, coalesce(d.top_share, 0) AS top_share
  FROM base b JOIN mons m USING ({k}) LEFT JOIN slope s USING ({k}) LEFT JOIN dom d USING ({k}))"""


def detect_ctes() -> str:
    k = "snapshot_date, trader_id"
    rules = {
        "insufficient": "n < 60 OR n_alpha < 40 OR months_active < 3",
        "loss_hider": "n >= 20 AND (wr > 92 OR payoff IS NULL OR (payoff < 0.5 AND mdd > 35))",
        "open_loss_divergence": "upl < -2 * greatest(1e0, coalesce(realized, 0))",
        "lottery": "conc_top1 > 30",
        "roi_artifact": "roi > 300 AND (coalesce(alpha, 0) <= 0 OR coalesce(t_stat, 0) < 2)",
        "ruin_risk": "lev_p90 > 25 OR ruin < -500",
        "not_copyable": "marg_med < 50 OR dur_med < 0.5",
        "no_alpha": "coalesce(t_stat, 0) < 2.5",
        "mdd_high": "mdd >= 35",
        "alpha_decay": "alpha_h2 < alpha_h1",
        "inactive": "last_close < max_close - 30::BIGINT * 86400000",
        "went_dark": "last_open < max_open - 21::BIGINT * 86400000",
        "mass_close_loss": "mass IS NOT NULL",
        "no_listing_data": "NOT listed",
        "copiers_losing": "copier_pnl < 0 AND copier_count_total >= 10 AND (copier_pnl / copier_count_total <= -50"
                          " OR (coalesce(realized, 0) > 0 AND copier_pnl <= -0.5 * realized))",
        "fresh_start": "epoch_ms(CAST(snapshot_date AS TIMESTAMP)) - start_time < 120::BIGINT * 86400000",
        "regime_onesided": "n_months >= 2 AND n_good / n_months < 0.5",
        "thin_benchmark": "top_share > 0.40",
    }
    cases = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules.items())
    return f"""tot AS (SELECT {k}, max(closed_ms) AS last_close, max(opened_ms) AS last_open, sum(pnl) AS realized,
  sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gross_win FROM pos GROUP BY ALL),
clk AS (SELECT snapshot_date, max(last_close) AS max_close, max(last_open) AS max_open FROM tot GROUP BY ALL),
clu AS (SELECT {k}, closed_ms // 1000 AS second, count(*) AS n, sum(pnl) AS net FROM pos GROUP BY ALL HAVING count(*) >= 5 AND sum(pnl) < 0),
mass AS (SELECT {k}, min(net) AS mass FROM clu JOIN tot USING ({k}) WHERE -net >= 0.5 * gross_win GROUP BY ALL),
unr AS (SELECT '2002-01-01' AS snapshot_date, trader_id, sum(upl) AS upl FROM opn GROUP BY ALL),
det AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS flags FROM met JOIN tot USING ({k}) JOIN clk USING (snapshot_date)
  LEFT JOIN mass USING ({k}) LEFT JOIN (SELECT * EXCLUDE (nick) FROM sup) USING ({k}) LEFT JOIN unr USING ({k}))"""


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def rank_ctes() -> str:
    return f"""snaps AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS prev_date,
  row_number() OVER (ORDER BY snapshot_date) AS snapshot_no FROM (SELECT DISTINCT snapshot_date FROM pos)),
trn0 AS (SELECT d.*, s.prev_date, s.snapshot_no, o.alpha AS prev_alpha, o.lev_med AS prev_lev, o.marg_med AS prev_marg,
  coalesce(greatest(-2, least(2, d.slope * 100)), 0) AS sb
  FROM det d JOIN snaps s USING (snapshot_date) LEFT JOIN det o ON o.snapshot_date = s.prev_date AND o.trader_id = d.trader_id),
trn AS (SELECT * EXCLUDE (flags), CASE WHEN alpha IS NOT NULL AND prev_alpha IS NOT NULL
    THEN greatest(-2, least(2, (sb + sign(alpha - prev_alpha)) / 2)) ELSE sb END AS trend_bonus,
  list_sort(list_distinct(list_concat(flags, list_filter([CASE WHEN alpha < 0 AND prev_alpha < 0 THEN 'decopy_2neg' END,
    CASE WHEN alpha < prev_alpha THEN 'alpha_decay' END,
    CASE WHEN lev_med / nullif(prev_lev, 0) > 2 OR lev_med / nullif(prev_lev, 0) < 0.5 OR marg_med / nullif(prev_marg, 0) > 2
      OR marg_med / nullif(prev_marg, 0) < 0.5 THEN 'style_drift' END], lambda x: x IS NOT NULL)))) AS flags FROM trn0),
sco AS (SELECT *, list_sort(list_intersect(flags, {_list(BAD)})) AS bad, list_sort(list_intersect(flags, {_list(WARNINGS)})) AS warnings,
  (0.40 * t_stat + 0.25 * coalesce(alpha, 0) * 100 + 0.20 * coalesce(payoff, 0) + 0.15 * trend_bonus)
    * pow(9e-1, len(list_intersect(flags, {_list(WARNINGS)}))) AS score,
  row_number() OVER (PARTITION BY trader_id ORDER BY snapshot_date) AS seen FROM trn),
seat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY score DESC, trader_id) AS rank_now,
  CASE WHEN len(warnings) = 0 AND (seen >= 2 OR (snapshot_no <= 1 AND n > 300)) THEN 'A' ELSE 'B' END AS tier
  FROM sco WHERE len(bad) = 0 AND score > 0) WHERE rank_now <= 5),
w0 AS (SELECT *, CASE WHEN tier = 'A' THEN 0.2e0 ELSE 0.1e0 END AS cap, CASE WHEN na2 * nb = 0 THEN 1e0 WHEN tier = 'A' THEN 0.7e0 ELSE 0.3e0 END AS pool,
  row_number() OVER (PARTITION BY snapshot_date, tier ORDER BY score DESC, trader_id) AS k
  FROM (SELECT *, count(*) FILTER (WHERE tier = 'A') OVER (PARTITION BY snapshot_date) AS na2,
    count(*) FILTER (WHERE tier = 'B') OVER (PARTITION BY snapshot_date) AS nb FROM seat)),
lev AS (SELECT snapshot_date, tier, m, any_value(cap) AS c, (any_value(pool) - m * any_value(cap)) / sum(score) AS per_score, max(score) AS top
  FROM w0, range(0, 5) t(m) WHERE k > m GROUP BY snapshot_date, tier, m),
lev1 AS (SELECT snapshot_date, tier, min(m) AS m, arg_min(per_score, m) AS per_score FROM lev WHERE per_score * top <= c + 1e-12 GROUP BY ALL),
ros AS (SELECT w.* EXCLUDE (pool, k), least(round_even((CASE WHEN l.m IS NULL OR k <= l.m THEN cap ELSE l.per_score * score END) * 20, 0) / 20, cap) AS weight
  FROM w0 w LEFT JOIN lev1 l USING (snapshot_date, tier)),
tie AS (SELECT s.*, coalesce(r.tier, CASE WHEN len(list_filter(s.bad, lambda x: NOT list_contains({_list(NOT_A_DEFECT)}, x))) = 0 THEN 'W' ELSE 'X' END) AS tier,
  coalesce(r.weight, 0) AS weight FROM sco s LEFT JOIN ros r USING (snapshot_date, trader_id)),
prv AS (SELECT s.snapshot_date, r.trader_id, r.nick, r.tier AS tier_prev, r.weight AS weight_prev FROM snaps s JOIN ros r ON r.snapshot_date = s.prev_date)"""


CHAIN_M = _with(POS, V, alpha_ctes())
CHAIN_D = _with(POS2, V, SUP, OPEN, alpha_ctes(), metrics_ctes(), detect_ctes())
CHAIN_R = _with(POS2, V, SUP, OPEN, alpha_ctes(), metrics_ctes(), detect_ctes(), rank_ctes())
P = _with(POS)
PV = _with(POS, V)
EX = "'binance' AS exchange"

SQL: dict[str, str] = {
    "roster": CHAIN_R + f"""SELECT trader_id, snapshot_date, {EX}, nick, tier, {r('weight')} AS weight, {r('score', 3)} AS score, {r('alpha')} AS alpha,
  {r('t_stat')} AS t_stat, {r('payoff')} AS payoff, {r('lev_med')} AS lev_med, {r('mdd')} AS mdd, n, n_alpha, {r('roi')} AS roi,
  {r('copier_pnl')} AS copier_pnl, copier_count_total, array_to_string(warnings, ',') AS warnings,
  (SELECT count(*) + 1 FROM sco o, sco s WHERE o.snapshot_date = q.prev_date AND s.snapshot_date = q.prev_date AND s.trader_id = q.trader_id
    AND (o.score > s.score OR (o.score = s.score AND o.trader_id < s.trader_id)) HAVING q.prev_alpha IS NOT NULL) AS rank_prev,
  rank_now, {r('alpha - prev_alpha')} AS alpha_delta FROM ros q""",
    "a1_cell_benchmark": PV + f"""SELECT symbol, month, side, count(*) AS n_cell, {r(med('pr'))} AS bench FROM v GROUP BY ALL HAVING count(*) >= 20""",
    "a2_leave_self_out": CHAIN_M + f"SELECT symbol, month, side, trader_id, n_cell, n_own, {r('bench')} AS bench, {r('lso')} AS lso FROM lso",
    "a3_trader_metrics": _with(POS, V, SUP1, alpha_ctes(), metrics_ctes()) + f"""SELECT trader_id, snapshot_date, m.nick, n, n_alpha, {r('alpha')} AS alpha,
  {r('t_stat')} AS t_stat, {r('payoff')} AS payoff, {r('wr')} AS wr, {r('conc_top1')} AS conc_top1, {r('ruin')} AS ruin, {r('mdd')} AS mdd,
  {r('lev_med')} AS lev_med, {r('lev_p90')} AS lev_p90, {r('marg_med')} AS marg_med, {r('dur_med')} AS dur_med, months_active,
  {r('alpha_h1')} AS alpha_h1, {r('alpha_h2')} AS alpha_h2,
  coalesce(array_to_string(list_transform(months, lambda x: x.month || ':' || printf('%.4f', x.m)), ','), '') AS monthly_alpha,
  dropped AS n_alpha_dropped_self_dominated, {r('top_share')} AS max_cell_share FROM met m LEFT JOIN sup USING (snapshot_date, trader_id)""",
    "a5_position_concentration": P + f"""SELECT trader_id, {r('max(p)', 2)} AS best_position FROM (
  SELECT trader_id, symbol, closed_ms // 1000 AS s, sum(pnl) AS p FROM pos GROUP BY ALL) GROUP BY ALL""",
    "a6_trader_totals": P + f"""SELECT trader_id, max(closed_ms) AS last_close, max(opened_ms) AS last_open, {r('sum(pnl)', 2)} AS realized,
  {r('sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)', 2)} AS gross_win FROM pos GROUP BY ALL""",
    "a7_mass_close_clusters": P + f"""SELECT trader_id, closed_ms // 1000 AS second, count(*) AS n, {r('sum(pnl)', 2)} AS net
  FROM pos GROUP BY ALL HAVING count(*) >= 5 AND sum(pnl) < 0""",
    "a7_mass_close_traders": P + f"""SELECT trader_id, {r('min(net)', 2)} AS worst_net FROM (
  SELECT trader_id, closed_ms // 1000 AS s, sum(pnl) AS net FROM pos GROUP BY ALL HAVING count(*) >= 5 AND sum(pnl) < 0)
  JOIN (SELECT trader_id, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS g FROM pos GROUP BY ALL) USING (trader_id)
  WHERE -net >= 0.5 * g GROUP BY ALL""",
    "a8_open_unrealized": _with(POS0, OPEN) + f"SELECT trader_id, {r('sum(upl)', 2)} AS unrealized FROM opn GROUP BY ALL",
    "a9_by_symbol": P + f"""SELECT symbol, count(*) AS n, {r('sum(pnl)', 2)} AS pnl, count(*) FILTER (WHERE pnl > 0) AS wins, {r(share('pnl > 0'))} AS wr,
  {r('sum(notional)', 2)} AS vol FROM pos GROUP BY ALL""",
    "a10_by_symbol_without_lottery": _with(POS, """best AS (SELECT trader_id, sum(pnl) AS net, max(pnl) AS top, arg_max(position_key, pnl) AS k FROM pos GROUP BY ALL)""") + f"""
SELECT symbol, count(*) AS n, {r('sum(pnl)', 2)} AS pnl, count(*) FILTER (WHERE pnl > 0) AS wins, {r(share('pnl > 0'))} AS wr,
  {r('sum(notional)', 2)} AS vol FROM pos p WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.trader_id = p.trader_id AND b.k = p.position_key
  AND b.net > 0 AND b.top > 0.30 * b.net) GROUP BY ALL""",
    "a11_best_pair": _with(POS, f"""per AS (SELECT trader_id, symbol, count(*) AS n, sum(pnl) AS pnl, {share('pnl > 0')} AS wr FROM pos GROUP BY ALL)""") + f"""
SELECT trader_id, symbol, n, {r('pnl', 2)} AS pnl, {r('wr')} AS wr, {r('total', 2)} AS total_pnl FROM (
  SELECT *, row_number() OVER (PARTITION BY trader_id ORDER BY pnl DESC, symbol DESC) AS rn FROM per WHERE n >= 8)
  JOIN (SELECT trader_id, sum(pnl) AS total FROM per GROUP BY ALL) USING (trader_id) WHERE rn = 1""",
    "a11_best_pair_frequency": _with(POS, "per AS (SELECT trader_id, symbol, count(*) AS n, sum(pnl) AS pnl FROM pos GROUP BY ALL)") + """
SELECT symbol, count(*) AS n_traders FROM (SELECT *, row_number() OVER (PARTITION BY trader_id ORDER BY pnl DESC, symbol DESC) AS rn FROM per WHERE n >= 8)
  WHERE rn = 1 GROUP BY ALL""",
    "a12_symbol_profile": P + f"""SELECT symbol, count(*) AS n, count(*) FILTER (WHERE side = 'Long') AS long_n, {r("sum(pnl) FILTER (WHERE side = 'Long')", 2)} AS long_pnl,
  count(*) FILTER (WHERE side <> 'Long') AS short_n, {r("sum(pnl) FILTER (WHERE side <> 'Long')", 2)} AS short_pnl, count(*) FILTER (WHERE pnl > 0) AS wins,
  {r('avg(pnl) FILTER (WHERE pnl > 0)', 2)} AS avg_win, {r('avg(pnl) FILTER (WHERE pnl <= 0)', 2)} AS avg_loss,
  {r(slot('dur_h', 1, 2, 'pnl > 0'))} AS dur_win, {r(slot('dur_h', 1, 2, 'pnl <= 0'))} AS dur_loss,
  {r('abs(avg(pnl) FILTER (WHERE pnl <= 0) / avg(pnl) FILTER (WHERE pnl > 0))')} AS loss_win_ratio FROM pos GROUP BY ALL""",
    "a12_top_symbol_traders": P + f"""SELECT symbol, nick, n, {r('pnl', 2)} AS pnl, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, nick) AS place
  FROM (SELECT symbol, nick, count(*) AS n, sum(pnl) AS pnl FROM pos GROUP BY ALL)) WHERE place <= 8""",
    "w9_clocks": P + "SELECT snapshot_date, exchange, max(closed_ms) AS max_close, max(opened_ms) AS max_open FROM pos GROUP BY ALL",
    "r1_detect": CHAIN_D + f"SELECT trader_id, snapshot_date, {EX}, array_to_string(flags, ',') AS flags FROM det",
    "r2_trend": CHAIN_R + f"SELECT trader_id, snapshot_date, {EX}, prev_date, {r('trend_bonus')} AS trend_bonus, array_to_string(flags, ',') AS flags FROM trn",
    "r3_new_disqualified": CHAIN_R + f"""SELECT p.trader_id, p.snapshot_date, {EX}, p.nick, array_to_string(s.bad, ',') AS bad_flags
  FROM prv p JOIN sco s USING (snapshot_date, trader_id) WHERE len(s.bad) > 0""",
    "r5_tiers": CHAIN_R.replace("\nal AS (", "\nal AS MATERIALIZED (").replace("\nsco AS (", "\nsco AS MATERIALIZED (") + f"SELECT trader_id, snapshot_date, {EX}, {r('score')} AS score, tier, {r('weight')} AS weight FROM tie",
    "r6_unallocated": CHAIN_R + f"SELECT snapshot_date, {EX}, greatest(0, round(1 - sum(weight), 2)) AS unallocated FROM ros GROUP BY ALL",
    "r8_removed": CHAIN_R + f"""SELECT p.trader_id, p.snapshot_date, {EX}, p.nick, CASE WHEN len(t.bad) > 0 THEN array_to_string(t.bad, ', ')
  WHEN t.bad IS NOT NULL THEN 'out of the top-5 by score' ELSE 'out of the universe' END AS reason
  FROM prv p LEFT JOIN tie t USING (snapshot_date, trader_id) WHERE NOT EXISTS (SELECT 1 FROM ros r WHERE r.snapshot_date = p.snapshot_date AND r.trader_id = p.trader_id)""",
    "r9_snapshot_diff": CHAIN_R + f""", pr2 AS (SELECT coalesce(p.snapshot_date, r.snapshot_date) AS snapshot_date, coalesce(r.nick, p.nick) AS nick, tier_prev, weight_prev,
  r.tier AS tier_now, r.weight AS weight_now FROM prv p FULL JOIN ros r ON p.snapshot_date = r.snapshot_date AND p.trader_id = r.trader_id),
agg AS (SELECT snapshot_date, coalesce(array_to_string(list_sort(list(nick) FILTER (WHERE tier_now = 'A' AND coalesce(tier_prev, '') <> 'A')), ','), '') AS added_a,
  coalesce(array_to_string(list_sort(list(nick) FILTER (WHERE tier_prev = 'A' AND coalesce(tier_now, '') <> 'A')), ','), '') AS removed_a,
  count(*) FILTER (WHERE weight_prev IS NOT NULL AND (weight_now IS NULL OR abs(weight_now - weight_prev) > 0.1)) AS n_weight_moves,
  count(*) FILTER (WHERE weight_prev IS NOT NULL AND weight_now IS NULL) AS n_left FROM pr2 GROUP BY ALL)
SELECT s.snapshot_date, {EX}, s.prev_date, coalesce(added_a, '') AS added_a, coalesce(removed_a, '') AS removed_a, coalesce(n_weight_moves, 0) AS n_weight_moves,
  coalesce(n_left, 0) AS n_left, coalesce(nd, 0) AS n_new_disqualified,
  s.prev_date IS NULL OR added_a <> '' OR removed_a <> '' OR n_weight_moves > 0 OR n_left > 0 OR coalesce(nd, 0) > 0 AS material
  FROM snaps s LEFT JOIN agg USING (snapshot_date) LEFT JOIN (SELECT snapshot_date, count(*) AS nd FROM prv JOIN sco USING (snapshot_date, trader_id)
  WHERE len(bad) > 0 GROUP BY ALL) USING (snapshot_date)""",
    "r10_portfolio_ages": CHAIN_R + f"""SELECT trader_id, snapshot_date, {EX}, nick, CAST(CAST(make_timestamp(start_time * 1000) AS DATE) AS VARCHAR) AS opened_on,
  date_diff('day', CAST(make_timestamp(start_time * 1000) AS DATE), CAST(snapshot_date AS DATE)) AS age_days FROM ros""",
    "r11_notable_exclusions": CHAIN_R + f"""SELECT trader_id, snapshot_date, {EX}, nick, {r('roi')} AS roi, array_to_string(flags, ',') AS flags, place FROM (
  SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY roi DESC NULLS LAST, trader_id) AS place FROM tie WHERE tier = 'X') WHERE place <= 10""",
    "u2_detail_candidates": CHAIN_R + f"""SELECT trader_id, snapshot_date, {EX} FROM tie WHERE (score IS NULL OR score > 0)
  AND len(list_intersect(flags, {_list([b for b in BAD if b != 'copiers_losing'])})) = 0 UNION SELECT trader_id, snapshot_date, {EX} FROM prv""",
    "e16_flag_fire_rates": CHAIN_D + f""", f AS (SELECT snapshot_date, listed, unnest(flags) AS flag FROM det),
t AS (SELECT snapshot_date, count(*) AS a, count(*) FILTER (WHERE listed) AS l FROM det GROUP BY ALL)
SELECT snapshot_date, {EX}, flag, count(*) AS n_all, {r('count(*) / any_value(a) * 100')} AS pct_all, count(*) FILTER (WHERE listed) AS n_listed,
  {r('count(*) FILTER (WHERE listed) / any_value(l) * 100')} AS pct_listed FROM f JOIN t USING (snapshot_date) GROUP BY snapshot_date, flag""",
    "e16_gate_grid": CHAIN_D + f""", g AS (SELECT *, coalesce(copier_pnl < 0 AND copier_count_total >= min_count AND (copier_pnl / copier_count_total <= -max_loss
  OR (coalesce(realized, 0) > 0 AND copier_pnl <= -max_share * realized)), FALSE) AS fires FROM det,
  (VALUES (3), (10), (47)) a(min_count), (VALUES (25e0), (50e0), (100e0)) b(max_loss), (VALUES (0.25e0), (0.5e0), (1e0)) c(max_share))
SELECT snapshot_date, {EX}, min_count, max_loss, max_share, count(*) FILTER (WHERE fires) AS n_fires,
  count(*) FILTER (WHERE NOT fires AND len(list_intersect(flags, {_list([b for b in BAD if b != 'copiers_losing'])})) = 0) AS n_survivors FROM g GROUP BY ALL""",
    "e24_marginal_flag_cost": CHAIN_R + f"SELECT snapshot_date, {EX}, bad[1] AS flag, count(*) AS n_traders FROM sco WHERE len(bad) = 1 GROUP BY ALL",
    "e18_window_alpha": CHAIN_M + f"""SELECT trader_id, count(*) AS n, {r('avg(alpha)')} AS alpha, {r(t_of('alpha'))} AS t_stat FROM al
  WHERE alpha IS NOT NULL AND opened_ms >= 978307200000 GROUP BY ALL""",
    "e19_clustered_t": CHAIN_M + f"""SELECT trader_id, count(*) AS n_clusters, {r('avg(m)')} AS alpha, {r(t_of('m'))} AS t_clustered FROM (
  SELECT trader_id, symbol, month, side, avg(alpha) AS m FROM al WHERE alpha IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "m9_ols_slope": CHAIN_M + f"""SELECT trader_id, {r('CASE WHEN count(*) >= 10 AND max(opened_ms) > min(opened_ms) THEN regr_slope(alpha, x) END')} AS slope FROM (
  SELECT *, (opened_ms - min(opened_ms) OVER (PARTITION BY trader_id)) / (max(opened_ms) OVER (PARTITION BY trader_id) - min(opened_ms) OVER (PARTITION BY trader_id)) AS x
  FROM al WHERE alpha IS NOT NULL) GROUP BY ALL""",
    "j7_not_listed": _with(POS, SUP1) + "SELECT DISTINCT trader_id FROM pos WHERE trader_id NOT IN (SELECT trader_id FROM sup WHERE listed)",
    "u1_historical_ids": _with(POS2) + "SELECT DISTINCT trader_id FROM pos",
    "d4_return_bases": P + f"""SELECT trader_id, {r('avg((avg_close / avg_cost - 1) * sgn)')} AS mean_price, {r('avg(roi / leverage)')} AS mean_roi,
  {r('avg(pnl / notional)')} AS mean_net, count(*) AS n FROM pos WHERE avg_cost > 0 GROUP BY ALL""",
    "d7_drop_accounting": P + """SELECT CASE WHEN k % 47 = 0 THEN 'parse' WHEN k % 41 = 0 THEN 'lev<=0' WHEN k % 43 = 0 THEN 'side' WHEN k % 53 = 0 THEN '|pr|>3'
  ELSE 'kept' END AS bucket, count(*) AS n_rows FROM (SELECT position_key AS k FROM pos) GROUP BY ALL""",
    "d9_partial_share": P + f"""SELECT count(*) AS n, count(*) FILTER (WHERE abs(closed_volume - max_oi) / max_oi > 0.02) AS n_partial,
  {r(share('abs(closed_volume - max_oi) / max_oi > 0.02'))} AS share FROM pos""",
    "q1_snapshot_violations": """SELECT '2002-01-01' AS snapshot_date, 'phemex' AS exchange, 'vanished' AS violation
  UNION ALL SELECT '2002-01-01', 'binance', 'n_positions' FROM (SELECT count(*) AS c, count(*) FILTER (WHERE l_shipdate < DATE '2000-01-01') AS p FROM lineitem)
  WHERE c > 1.5 * p OR c < 0.5 * p""",
    "q2_cap_flags": _with(POS0) + """SELECT CAST(s_suppkey AS VARCHAR) AS trader_id, coalesce(c, 0) AS n_hist, coalesce(c, 0) >= 450 AS closed_capped FROM supplier
  LEFT JOIN (SELECT trader_id, count(*) AS c FROM pos0 WHERE flag <> 'R' OR position_key % 2 = 0 GROUP BY ALL) ON trader_id = CAST(s_suppkey AS VARCHAR)""",
    "q3_headline_ratio": _with(POS, SUP1) + f"""SELECT trader_id, {r('sum(pnl)', 2)} AS computed_pnl, {r('any_value(roi2)')} AS headline_pnl,
  {r('sum(pnl) / nullif(any_value(roi2), 0)', 3)} AS ratio FROM pos LEFT JOIN (SELECT trader_id, roi * 10 AS roi2 FROM sup) USING (trader_id) GROUP BY ALL""",
    "q4_pnl_identity": P + f"""SELECT trader_id, {r('sum(pnl) / nullif(sum(pnl + notional * 6e-4 - notional * 5e-4 - notional * 1e-4), 0)', 4)} AS ratio FROM pos GROUP BY ALL""",
    "q5_net_vs_gross": P + f"""SELECT symbol, count(*) AS n, {r(share('bps < 0'), 4)} AS share_negative, {r(share('sign(pnl) <> sign(gross)'), 4)} AS share_sign_flip,
  {r(med('bps'), 4)} AS bps_median FROM (SELECT *, (pnl - gross) / notional * 10000 AS bps FROM (
  SELECT *, notional * (avg_close / avg_cost - 1) * sgn AS gross FROM pos WHERE avg_cost > 0 AND notional > 0)) GROUP BY ALL""",
    "q6_universe_funnel": _with(POS, SUP1) + """SELECT count(DISTINCT trader_id) AS n_traders, '1 listed' AS step FROM sup
  UNION ALL SELECT count(DISTINCT trader_id), '2 with positions' FROM pos UNION ALL SELECT count(DISTINCT trader_id), '3 with metrics' FROM pos WHERE pr IS NOT NULL""",
    "q7_overview": P + f"""SELECT (SELECT count(*) FROM pos) AS n_positions, (SELECT CAST(CAST(make_timestamp(min(opened_ms) * 1000) AS DATE) AS VARCHAR) FROM pos) AS first_day,
  (SELECT CAST(CAST(make_timestamp(max(opened_ms) * 1000) AS DATE) AS VARCHAR) FROM pos) AS last_day, (SELECT max(leverage) FROM pos) AS lev_max,
  (SELECT {r(share("isolated = 'Isolated'") + ' * 100')} FROM pos) AS pct_isolated, count(*) AS n_traders, max(c) AS n_pos_max,
  (SELECT {med('leverage')} FROM pos) AS lev_med, (SELECT {idx('leverage', '9e-1')} FROM pos) AS lev_p90, {med('c')} AS n_pos_med
  FROM (SELECT trader_id, count(*) AS c FROM pos GROUP BY ALL)""",
    "q8_key_uniqueness": """SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(c) - count(*) AS BIGINT) AS n_excess FROM (
  SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_orderkey END AS o, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)""",
}

_LINES = """l AS (SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_orderkey END AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part,
  l_extendedprice AS price, l_returnflag = 'R' AS is_raw, l_partkey, l_suppkey FROM lineitem)"""
for _name, _order in (("d1_dedup_first_wins", "l_partkey, l_suppkey, price"), ("d1_dedup_last_wins", "l_partkey DESC, l_suppkey DESC, price DESC"),
                      ("d3_dedup_shaped_beats_raw", "is_raw, l_partkey DESC, l_suppkey DESC, price DESC")):
    SQL[_name] = _with(_LINES) + f"""SELECT order_id, line_no, part, round(price, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_no ORDER BY {_order}) AS rn
  FROM l WHERE order_id IS NOT NULL) WHERE rn = 1 UNION ALL SELECT order_id, line_no, part, round(price, 2) FROM l WHERE order_id IS NULL"""


# ---- screens and funnels ------------------------------------------------------------------------------------

_DEEP = """pk AS (SELECT trader_id, ts, {v} AS x, max({v}) OVER (PARTITION BY trader_id ORDER BY ts) AS peak FROM {src}),
dr AS (SELECT trader_id, ts, {drop} AS d FROM pk),
dd AS (SELECT trader_id, max(d) AS depth0, min(ts) FILTER (WHERE d = m) AS trough_ts FROM (SELECT *, max(d) OVER (PARTITION BY trader_id) AS m FROM dr) GROUP BY ALL)"""
SCREENS = {
    "binance": [EQUITY, _DEEP.format(v="1 + value / 1e2", src="eq", drop="CASE WHEN peak <> 0 THEN (peak - x) / peak ELSE 0 END"),
                "scr AS (SELECT trader_id, -greatest(0, depth0) AS depth, CASE WHEN depth0 > 0 THEN trough_ts END AS trough_ts FROM dd)"],
    "okx": [EQUITY, "scr AS (SELECT trader_id, min(f) AS depth, arg_min(ts, f) AS trough_ts FROM (SELECT trader_id, ts, value / 1e2 AS f FROM eq ORDER BY ts) GROUP BY ALL)"],
    "bitget": [EQUITY, _DEEP.format(v="value / 1e2", src="eq", drop="(peak - x) * 1e2"), "scr AS (SELECT trader_id, depth0 AS depth, trough_ts FROM dd)"],
    "kucoin": [EQUITY, """pri AS (SELECT CAST(s_suppkey AS VARCHAR) AS trader_id, s_acctbal * 1e3 / 4e1 - 5e3 AS principal FROM supplier),
eqp AS (SELECT trader_id, ts, value * 2e3 / principal * 1e2 AS pct FROM eq JOIN pri USING (trader_id) WHERE principal > 0)""",
               _DEEP.format(v="pct", src="eqp", drop="peak - x"), "scr AS (SELECT trader_id, depth0 AS depth, trough_ts FROM dd)"],
    "phemex": ["""cu AS (SELECT trader_id, closed_ms, position_key, sum(pnl) OVER w AS cum FROM v WINDOW w AS (PARTITION BY trader_id ORDER BY closed_ms, position_key ROWS UNBOUNDED PRECEDING)),
cp AS (SELECT *, max(cum) OVER (PARTITION BY trader_id ORDER BY closed_ms, position_key ROWS UNBOUNDED PRECEDING) AS peak FROM cu),
cd AS (SELECT trader_id, closed_ms, (cum - peak) / peak AS d FROM cp WHERE peak > 0),
scr AS (SELECT trader_id, min(d) AS depth, min(closed_ms) FILTER (WHERE d = m) AS trough_ts FROM (SELECT *, min(d) OVER (PARTITION BY trader_id) AS m FROM cd) GROUP BY ALL)"""],
}
SCREENS["bybit"] = SCREENS["okx"]
COVERED = {
    "binance": "depth IS NULL OR depth >= -0.20 OR coalesce(window_start_ms <= trough_ts, FALSE)",
    "okx": "depth IS NULL OR depth >= -0.20 OR coalesce(window_start_ms <= trough_ts, FALSE)",
    "bitget": "depth IS NOT NULL AND (depth < 20 OR coalesce(window_start_ms <= trough_ts, FALSE))",
    "kucoin": "depth IS NOT NULL AND (depth < 20 OR coalesce(window_start_ms <= trough_ts, FALSE))",
    "phemex": "depth IS NULL OR depth >= -0.20",
}
COVERED["bybit"] = COVERED["okx"]
for _name, _ex in (("t1_ratio_screen", "binance"), ("t2_level_screen", "okx"), ("t3_points_screen", "bitget"), ("t5_principal_screen", "kucoin"), ("t6_trade_screen", "phemex")):
    SQL[_name] = _with(POS, V, *SCREENS[_ex]) + f"""SELECT trader_id, {r('depth', 4)} AS depth, trough_ts, {COVERED[_ex]} AS covered FROM (
  SELECT trader_id, min(opened_ms) AS window_start_ms FROM v GROUP BY ALL) LEFT JOIN scr USING (trader_id)"""
SQL["t7_monthly_screen"] = PV[:-1] + f""", mp AS (SELECT trader_id, month, sum(pnl) AS p FROM v GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY trader_id ORDER BY month) AS cum, count(*) OVER (PARTITION BY trader_id) AS nm FROM mp),
k AS (SELECT *, max(cum) OVER (PARTITION BY trader_id ORDER BY month) AS peak FROM c),
d AS (SELECT *, CASE WHEN peak > 0 THEN (cum - peak) / peak END AS d FROM k WHERE nm >= 2)
SELECT trader_id, {r('min(d)', 4)} AS depth, min(month) FILTER (WHERE d = m) AS trough_month, max(nm) AS n_months
  FROM (SELECT *, min(d) OVER (PARTITION BY trader_id) AS m FROM d) GROUP BY ALL"""


def funnel_ctes(name: str) -> str:
    ratio_based = name in ("bybit", "bitget", "kucoin")
    min_cell = 20 if name == "binance" else 8
    n, na = (60, 40) if name == "binance" else (15, 8)
    upl = "upl" if name == "bybit" else "coalesce(upl, 0)"
    known = "coalesce(has_upl, FALSE)" if name == "bybit" else "TRUE"
    best = {"bybit": "symbol, closed_ms", "bitget": "symbol, closed_ms // 1000"}.get(name)
    src = "fv AS (SELECT * REPLACE (roi / leverage AS pr) FROM pos)" if ratio_based else "fv AS (SELECT * FROM v)"
    best_sql = (f"SELECT trader_id, max(p) AS best_position FROM (SELECT trader_id, {best}, sum(pnl) AS p FROM fv GROUP BY ALL) GROUP BY ALL" if best
                else "SELECT trader_id, max(pnl) AS best_position FROM fv GROUP BY ALL")
    f = {"sample": f"n < {n} OR n_alpha < {na}", "single_pair": "n_syms < 2", "one_sided": "n_win = 0 OR n_loss = 0", "win_rate": "wr > 92",
         "payoff": "payoff < 0.5", "net_negative": "total_pnl <= 0", "concentration": "conc > 30"}
    if name in ("okx", "bybit", "kucoin"):
        f["open_loss"] = f"{known} AND coalesce(upl_sum, 0) < -0.5 * abs(total_pnl)"
    f |= {"t_stat": "t_stat < 2.5", "alpha_h2": "coalesce(alpha_h2, 0) <= 0", "leverage": "lev_p90 > 25", "margin": "marg_med < 50", "duration": "dur_med < 0.5"}
    if name == "binance":
        f["inactive_month"] = "NOT active"
    f["drawdown"] = f"NOT ({COVERED[name]})"
    if name == "bitget":
        f |= {"native_mdd": "mdd / 2 > 20", "lifetime_mdd": "mdd > 20 AND span_days > 90"}
    cases = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in f.items())
    hidden = "wr > 92" if "open_loss" not in f else f"wr > 92 OR ({known} AND coalesce(upl_neg, 0) < -0.2 * abs(total_pnl))"
    if name == "phemex":
        hidden += " OR coalesce(mdd / 1e2 > 4e-1, FALSE)"
    return ",\n".join([
        src, alpha_ctes(min_cell, "pr", "fv"), metrics_ctes(), *SCREENS[name],
        f"opx AS (SELECT trader_id, coalesce(sum({upl}), 0) AS upl_sum, coalesce(sum({upl}) FILTER (WHERE {upl} < 0), 0) AS upl_neg, bool_or({upl} IS NOT NULL) AS has_upl FROM opn GROUP BY ALL)",
        f"bst AS ({best_sql})", "act AS (SELECT trader_id, bool_or(month = '2001-10') AS active FROM fv GROUP BY ALL)",
        "fm AS (SELECT *, CASE WHEN total_pnl > 0 THEN best_position / total_pnl * 100 END AS conc FROM met JOIN bst USING (trader_id) JOIN act USING (trader_id)"
        " LEFT JOIN scr USING (trader_id) LEFT JOIN opx USING (trader_id) LEFT JOIN (SELECT trader_id, mdd FROM sup) USING (trader_id))",
        f"fun AS (SELECT *, {hidden} AS hidden_loss, list_filter([{cases}], lambda x: x IS NOT NULL) AS failed FROM fm)"])


FRESH = {"okx": "coalesce(mdd * 4e0, 0) < 120", "bybit": "coalesce(mdd * 3e0, 0) < 120", "bitget": "span_days < 120",
         "kucoin": "span_days < 120", "binance": "FALSE", "phemex": "FALSE"}
for _name in SCREENS:
    _base =_with(POS, V, SUP1, OPEN, funnel_ctes(_name))
    SQL[f"r12_funnel_{_name}"] = _base + f"""SELECT trader_id, n, n_alpha, n_syms, {r('alpha')} AS alpha, {r('t_stat')} AS t_stat, {r('t_incl')} AS t_incl,
  {r('coalesce(alpha_h2, 0)')} AS alpha_h2, {r('wr')} AS wr, {r('payoff')} AS payoff, {r('lev_p90')} AS lev_p90, {r('marg_med')} AS marg_med, {r('dur_med')} AS dur_med,
  {r('conc', 3)} AS conc, array_to_string(failed, ',') AS failed, failed[1] AS reject_reason, hidden_loss, {FRESH[_name]} AS fresh_start FROM fun"""
    if _name == "okx":
        SQL["a22_rejection_counts"] = _base + "SELECT coalesce(failed[1], 'survivor') AS reason, count(*) AS n_traders FROM fun GROUP BY ALL"
        SQL["e25_closest_misses"] = _base + f"""SELECT place, trader_id, {r('t_stat')} AS t_stat, array_to_string(failed, ',') AS failed FROM (
  SELECT *, row_number() OVER (ORDER BY t_stat DESC, trader_id) AS place FROM fun WHERE len(failed) > 0) WHERE place <= 10"""
    if _name == "bybit":
        SQL["o2_funnel_survivors"] = _base + f"""SELECT row_number() OVER (ORDER BY t_stat * 0.5 + alpha * 100 * 0.3 + payoff * 0.2 DESC, trader_id) AS place, trader_id,
  {r('t_stat * 0.5 + alpha * 100 * 0.3 + payoff * 0.2')} AS score FROM fun WHERE len(failed) = 0"""
_okx = SCREENS["okx"][1].replace("scr AS", "s1 AS")
_bit = [x.replace("scr AS", "s2 AS") for x in SCREENS["bitget"][1:]]
SQL["e27_drawdown_bases"] = _with(POS, V, SUP1, EQUITY, _okx, *_bit, "win AS (SELECT trader_id, min(opened_ms) AS window_start_ms FROM v GROUP BY ALL)") + f"""
SELECT count(*) FILTER (WHERE NOT ({COVERED['okx']})) AS n_rejected, count(*) AS n_traders, 'level' AS basis FROM win LEFT JOIN s1 USING (trader_id)
UNION ALL SELECT count(*) FILTER (WHERE NOT ({COVERED['bitget']})), count(*), 'points' FROM win LEFT JOIN s2 USING (trader_id)
UNION ALL SELECT count(*) FILTER (WHERE mdd > 20), count(*), 'native' FROM win LEFT JOIN sup USING (trader_id)"""

# ---- windows, splits, quantiles -----------------------------------------------------------------------------

CUT = "cut AS (SELECT {x} AS cut_ms FROM {src})"
SQL["w1_own_halves"] = PV + f"""SELECT trader_id, half, count(*) AS n, {r('avg(pr)')} AS mean_pr, min(opened_ms) AS first_ms FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY trader_id ORDER BY opened_ms, position_key) - 1 >= count(*) OVER (PARTITION BY trader_id) // 2 THEN 1 ELSE 0 END AS half FROM v) GROUP BY ALL"""
SQL["w2_calendar_cut"] = _with(POS, V, CUT.format(x=slot("opened_ms", 1, 2), src="v")) + f"""SELECT CASE WHEN opened_ms >= cut_ms THEN 1 ELSE 0 END AS half, cut_ms,
  count(*) AS n, {r('avg(pr)')} AS mean_pr FROM v, cut GROUP BY ALL"""
SQL["w7_cumulative_pnl"] = _with(POS, V, SCREENS["phemex"][0].split(",\ncd AS")[0]) + f"SELECT trader_id, position_key, {r('cum', 2)} AS cum_pnl, {r('peak', 2)} AS peak_pnl FROM cp"
SQL["w11_tied_ranks"] = PV[:-1] + """, p AS (SELECT trader_id, (count(*) % 20) AS m FROM v GROUP BY trader_id)
SELECT trader_id, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS avg_rank, row_number() OVER (ORDER BY m, trader_id) - 1 AS ordinal FROM p"""
SQL["o5_quantile_edges"] = P + f"""SELECT symbol, side, {r(med('dur_h'))} AS dur_med, {r(idx('leverage', '75e-2'))} AS lev_p75, {r(idx('margin', '9e-1'))} AS margin_p90,
  {r(slot('margin', 1, 3))} AS tercile1, {r(slot('margin', 2, 3))} AS tercile2, {r(excl('dur_h', 9, 10))} AS dur_p90 FROM pos GROUP BY ALL"""

# ---- candles ------------------------------------------------------------------------------------------------

CAN = """can AS (SELECT event_type AS symbol, epoch_ms(ts) // 3600000 * 3600000 AS open_ms, arg_min(value, (epoch_ms(ts), event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (epoch_ms(ts), event_id)) AS close FROM events GROUP BY ALL)"""
FEAT = """feat AS (SELECT *, CASE WHEN i >= 199 THEN avg(close) OVER (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS ma_incl,
  CASE WHEN i >= 200 THEN avg(close) OVER (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 200 PRECEDING AND CURRENT ROW) END AS ma_ctx,
  CASE WHEN i >= 200 THEN avg(close) OVER (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) END AS ma_prior,
  close / lag(close, 4) OVER w - 1 AS r4, close / lag(close, 24) OVER w - 1 AS r24, close / lag(close, 72) OVER w - 1 AS r72,
  CASE WHEN hh > ll THEN (close - ll) / (hh - ll) ELSE 0.5 END AS range_pos,
  stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 72 PRECEDING AND CURRENT ROW) * sqrt(24e0) AS vol
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_ms) - 1 AS i, close / lag(close) OVER (PARTITION BY symbol ORDER BY open_ms) - 1 AS ret,
    max(high) OVER (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) AS hh,
    min(low) OVER (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) AS ll FROM can)
  WINDOW w AS (PARTITION BY symbol ORDER BY open_ms))"""
TRD = """trd0 AS (SELECT event_id AS position_key, CAST(user_id AS VARCHAR) AS trader_id, event_type AS symbol, CASE WHEN event_id % 5 < 3 THEN 'Long' ELSE 'Short' END AS side,
  CASE WHEN event_id % 5 < 3 THEN 1 ELSE -1 END AS sgn, epoch_ms(ts) AS opened_ms, epoch_ms(ts) + CAST(trunc(value * 3600000) AS BIGINT) AS closed_ms, value AS dur_h,
  value AS avg_cost, 1000 + event_id % 977 AS notional, CAST(1 + event_id % 80 AS DOUBLE) AS leverage,
  ((event_id * 7919) % 9973 - 4986) / 9973e0 * 8e-2 + (user_id % 7 - 3) * 2e-3 AS edge, CASE WHEN event_id % 3 > 0 THEN 'Cross' ELSE 'Isolated' END AS isolated,
  event_id % 4 = 0 AS partial FROM events),
trd AS (SELECT *, (1e3 + (notional - 1000)) * edge AS pnl, (1e3 + (notional - 1000)) * edge / (1e3 + (notional - 1000)) AS net, avg_cost * (1 + sgn * edge) AS avg_close,
  (avg_cost * (1 + sgn * edge) / avg_cost - 1) * sgn AS pr FROM trd0)"""
C = _with(CAN, FEAT, TRD)
DUR = lambda e: "CASE " + " ".join(f"WHEN dur_h < {x} THEN '{n}'" for x, n in e[:-1]) + f" WHEN dur_h IS NOT NULL THEN '{e[-1][1]}' END"
DUR_WEEK = DUR([(1, "<1h"), (4, "1-4h"), (12, "4-12h"), (24, "12-24h"), (72, "1-3d"), (168, "3-7d"), (0, ">7d")])
DUR_MONTH = DUR([(1, "<1h"), (4, "1-4h"), (12, "4-12h"), (24, "12-24h"), (72, "1-3d"), (168, "3-7d"), (720, "7-30d"), (0, ">30d")])
DUR_SHORT = DUR([(1, "<1h"), (4, "1-4h"), (12, "4-12h"), (24, "12-24h"), (72, "1-3d"), (0, ">3d")])
LEV = "CASE WHEN leverage <= 5 OR leverage IS NULL THEN '<=5x' WHEN leverage <= 20 THEN '6-20x' WHEN leverage <= 50 THEN '21-50x' ELSE '>50x' END"
LIQ = "CASE WHEN leverage <= 10 THEN '<=10x' WHEN leverage <= 25 THEN '11-25x' WHEN leverage <= 60 THEN '26-60x' ELSE '>60x' END"
DOW = "['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(make_timestamp(opened_ms * 1000))]"
BLOCK = "lpad(CAST(hour(make_timestamp(opened_ms * 1000)) // 6 * 6 AS VARCHAR), 2, '0') || '-' || lpad(CAST(hour(make_timestamp(opened_ms * 1000)) // 6 * 6 + 5 AS VARCHAR), 2, '0') || 'h'"
LOCAL_HOUR = "hour(make_timestamp((opened_ms - 5 * 3600000) * 1000))"
ASOF = """ao AS (SELECT t.*, f.open_ms AS candle_ms, f.close, f.high, f.low, f.i, f.r4, f.r24, f.r72, f.ma_incl, f.ma_ctx, f.ma_prior, f.range_pos, f.vol
  FROM trd t ASOF LEFT JOIN feat f ON t.symbol = f.symbol AND t.opened_ms >= f.open_ms)"""
EXC = """exc AS (SELECT *, CASE WHEN sgn = 1 THEN lo / avg_cost - 1 ELSE 1 - hi / avg_cost END AS mae, CASE WHEN sgn = 1 THEN hi / avg_cost - 1 ELSE 1 - lo / avg_cost END AS mfe,
  abs(CASE WHEN sgn = 1 THEN lo / avg_cost - 1 ELSE 1 - hi / avg_cost END) AS amae FROM (
  SELECT t.*, (SELECT max(high) FROM can c WHERE c.symbol = t.symbol AND c.open_ms BETWEEN t.opened_ms AND t.closed_ms) AS hi,
    (SELECT min(low) FROM can c WHERE c.symbol = t.symbol AND c.open_ms BETWEEN t.opened_ms AND t.closed_ms) AS lo FROM {src} t WHERE avg_cost > 0) WHERE hi IS NOT NULL)"""
CE = _with(CAN, TRD, EXC.format(src="trd"))
SQL["d10_buckets"] = _with(TRD) + f"""SELECT {DUR_WEEK} AS duration, {LEV} AS leverage_band, {DOW} AS weekday, {BLOCK} AS block, {LIQ} AS liquidation, count(*) AS n,
  CAST(sum({LOCAL_HOUR}) AS BIGINT) AS hours FROM trd GROUP BY ALL"""
SQL["a12_symbol_breakdowns"] = P + " UNION ALL ".join(
    f"SELECT symbol, '{d}' AS dimension, {e} AS bucket, count(*) AS n, {r('sum(pnl)', 2)} AS pnl, {r(share('pnl > 0'))} AS wr FROM pos GROUP BY ALL"
    for d, e in (("duration", DUR_WEEK), ("leverage", LEV), ("hour", f"lpad(CAST({LOCAL_HOUR} AS VARCHAR), 2, '0')")))
SQL["w3_candle_features"] = _with(CAN, FEAT) + "SELECT symbol, open_ms, i, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("close", "r4", "r24", "r72", "ma_incl", "ma_ctx", "ma_prior", "range_pos", "vol")) + " FROM feat"
SQL["j9_as_of"] = _with(CAN, FEAT, TRD, ASOF) + f"SELECT position_key, candle_ms, {r('close')} AS close FROM ao"
SQL["j10_interval_excursions"] = CE + f"SELECT position_key, {r('mae', 9)} AS mae, {r('mfe', 9)} AS mfe FROM exc"
SQL["a21_excursion_profile"] = CE + f"""SELECT CASE WHEN net > 0 THEN 'winner' ELSE 'loser' END AS outcome, count(*) AS n, {r(med('amae'))} AS mae_med,
  {r(idx('amae', '75e-2'))} AS mae_p75, {r(idx('amae', '90e-2'))} AS mae_p90, {r(idx('amae', '95e-2'))} AS mae_p95 FROM exc WHERE net <> 0 GROUP BY ALL"""
SQL["a21_capture_profile"] = CE + f"""SELECT {r(med('cap'))} AS cap_med, {r(excl('cap', 1, 4))} AS cap_p25, {r(excl('cap', 3, 4))} AS cap_p75
  FROM (SELECT greatest(-1, least(2, net / mfe)) AS cap FROM exc WHERE mfe > 0.001)"""
SQL["a21_excursion_by_duration"] = CE + f"""SELECT {DUR_SHORT} AS bucket, count(*) AS n, {r(med('mfe'))} AS mfe_med, {r(med('amae'))} AS mae_med, {r(med('net'))} AS net_med
  FROM exc GROUP BY ALL HAVING count(*) >= 30"""
SQL["a21_liquidation_risk"] = CE + f"""SELECT {LIQ} AS band, count(*) AS n, {r(share('amae * leverage > 0.8'))} AS consumed_share, {r(med('amae'))} AS mae_med
  FROM exc GROUP BY ALL HAVING count(*) >= 30"""
REG = ("reg AS (SELECT *, CASE WHEN close > ma_incl THEN 1 ELSE -1 END AS regime, CASE WHEN sgn = (CASE WHEN close > ma_incl THEN 1 ELSE -1 END) THEN 1e0 ELSE 0e0 END AS aligned"
       " FROM ao WHERE ma_incl IS NOT NULL AND avg_cost > 0 AND avg_close > 0 AND abs(pr) <= 3)")
CR = (CAN, FEAT, TRD, ASOF, REG)
SQL["a18_regime_cells"] = _with(*CR) + f"""SELECT regime, side, count(*) AS n, {r(share('pr > 0') + ' * 100')} AS wr, {r('avg(aligned)')} AS aligned_share, {r(med('pr'))} AS med_pr FROM reg GROUP BY ALL"""
SQL["e4_regime_adaptation"] = _with(*CR, """hv AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY trader_id ORDER BY opened_ms, position_key) - 1 >= count(*) OVER (PARTITION BY trader_id) // 2
    THEN 1 ELSE 0 END AS half FROM reg)""", """pt AS (SELECT trader_id, avg(aligned) FILTER (WHERE half = 0) AS a1, avg(aligned) FILTER (WHERE half = 1) AS a2, avg(pr) FILTER (WHERE half = 1) AS r2
  FROM hv GROUP BY ALL HAVING count(*) >= 30)""", """rk AS (SELECT *, row_number() OVER (ORDER BY a1, trader_id) AS k1, row_number() OVER (ORDER BY a2, trader_id) AS k2,
  row_number() OVER (ORDER BY r2, trader_id) AS k3 FROM pt)""", f"mid AS (SELECT {med('a1')} AS m FROM pt)") + f"""SELECT count(*) AS n, {r('coalesce(corr(k1, k2), 0)')} AS rho_alignment,
  {r('coalesce(corr(k1, k3), 0)')} AS rho_return, {r(med('r2', 'a1 >= m'))} AS med_r2_high, {r(med('r2', 'a1 < m'))} AS med_r2_low FROM rk, mid"""


def compare_ctes(src: str, value: str) -> str:
    """n and median per period, and z by definition: ranks of the pooled second period."""
    return f"""nn AS (SELECT feature, cell, count(*) FILTER (WHERE half = 0) AS n1, count(*) FILTER (WHERE half = 1) AS n2, {med(value, 'half = 0')} AS med1,
  {med(value, 'half = 1')} AS med2 FROM {src} GROUP BY ALL),
rr AS (SELECT feature, cell, rank() OVER (PARTITION BY feature ORDER BY {value}) + (count(*) OVER (PARTITION BY feature, {value}) - 1) / 2 AS rk,
  count(*) OVER (PARTITION BY feature) AS tot FROM {src} WHERE half = 1),
zz AS (SELECT feature, cell, sum(rk) AS s, CAST(count(*) AS DOUBLE) AS na, any_value(tot) - count(*) AS nb FROM rr GROUP BY ALL)
SELECT feature, cell, n1, n2, {r('med1')} AS med1, {r('med2')} AS med2, {r('CASE WHEN na >= 20 AND nb >= 20 THEN (s - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb * (na + nb + 1) / 12) ELSE 0 END')} AS z,
  (med1 > 0) = (med2 > 0) AS consistent FROM nn JOIN zz USING (feature, cell) WHERE n1 >= 30 AND n2 >= 30"""


def calendar(src: str, out: str) -> str:
    return f"{out} AS (SELECT x.*, CASE WHEN opened_ms >= (SELECT {slot('opened_ms', 1, 2)} FROM {src}) THEN 1 ELSE 0 END AS half FROM {src} x)"


_rules = {"duration": DUR_WEEK, "leverage": LEV, "side": "side", "regime x side": "CASE WHEN regime = 1 THEN 'bull' ELSE 'bear' END || '+' || side", "margin": "isolated",
          "partial close": "CASE WHEN partial THEN 'partial' ELSE 'full' END", "day of week": DOW, "hour UTC": BLOCK}
SQL["a19_rules_oos"] = _with(*CR, calendar("reg", "rh"), "lng AS (" + " UNION ALL ".join(
    f"SELECT pr, half, '{k}' AS feature, {e} AS cell FROM rh" for k, e in _rules.items()) + ")")[:-1] + ",\n" + compare_ctes("lng", "pr")
ENT = """ent0 AS (SELECT *, close / ma_ctx - 1 AS ma FROM ao WHERE i >= 200 AND abs(net) <= 3)"""
_terc = ", ".join(f"{slot(f, i, 3)} AS {f}_{i}" for f in ("r4", "r24", "r72", "ma", "range_pos", "vol") for i in (1, 2))
SQL["a20_entry_context"] = _with(CAN, FEAT, TRD, ASOF, ENT, calendar("ent0", "ent"), f"edg AS (SELECT {_terc} FROM ent WHERE half = 0)", "lng AS (" + " UNION ALL ".join(
    f"SELECT net, half, '{f}' AS feature, CASE WHEN {f} < {f}_1 THEN 'low' WHEN {f} < {f}_2 THEN 'mid' ELSE 'high' END AS cell FROM ent, edg"
    for f in ("r4", "r24", "r72", "ma", "range_pos", "vol")) + ")")[:-1] + ",\n" + compare_ctes("lng", "net")
SQL["a20_momentum_side"] = _with(CAN, FEAT, TRD, ASOF, ENT, calendar("ent0", "ent"),
                                 "lng AS (SELECT net, half, 'momentum x side' AS feature, CASE WHEN r24 > 0 THEN 'up' ELSE 'down' END || '+' || side AS cell FROM ent)")[:-1] + ",\n" + compare_ctes("lng", "net")
RUL = (CAN, FEAT, TRD, ASOF, "kn AS (SELECT * EXCLUDE (r24, r72, high, low), r24 AS m24, r72 AS m72, close / ma_prior - 1 AS ma FROM ao WHERE i >= 200 AND abs(net) <= 3)",
       EXC.format(src="kn"), calendar("exc", "rul0"),
       f"qq AS (SELECT {slot('m24', 2, 3)} AS m24_q, {slot('m72', 2, 3)} AS m72_q, {slot('ma', 2, 3)} AS ma_q FROM rul0 WHERE half = 0)",
       "rul AS (SELECT *, CASE WHEN mae <= -0.024 THEN -0.024e0 ELSE net END AS st, m24 > m24_q AND m72 > m72_q AND ma > ma_q AS r1 FROM rul0, qq)")
SQL["e8_rule_overlay"] = _with(*RUL, "lng AS (" + " UNION ALL ".join(f"SELECT half, '{n}' AS rule, {v} AS v FROM rul WHERE {c}" for n, v, c in (
    ("all", "net", "TRUE"), ("all stopped", "st", "TRUE"), ("R1", "st", "r1"), ("R2", "st", "r1 AND leverage <= 25"), ("R3", "st", "r1 AND leverage <= 25 AND dur_h >= 1"))) + ")") + f"""
SELECT half, rule, count(*) AS n, {r('avg(v)')} AS mean, {r(share('v > 0') + ' * 100')} AS wr, {r('sum(v)')} AS total, {r(med('v'))} AS med FROM lng GROUP BY ALL HAVING count(*) >= 30"""
SQL["e17_stop_level_grid"] = _with(*RUL) + f"""SELECT half, stop, count(*) AS n, {r('avg(CASE WHEN mae <= -stop THEN -stop ELSE net END)')} AS mean_stopped, {r('avg(net)')} AS mean_free
  FROM rul, (VALUES (1e-2), (2e-2), (24e-3), (5e-2), (1e-1)) s(stop) GROUP BY ALL"""
SQL["e14_entry_containment"] = _with(CAN, FEAT, TRD, ASOF) + f"""SELECT avg_cost >= low AND avg_cost <= high AS inside, count(*) AS n, {r(share('partial'))} AS partial_share,
  {r(med('dur_h'))} AS dur_med FROM ao WHERE low IS NOT NULL GROUP BY ALL"""
SQL["e28_relative_thresholds"] = _with(CAN, FEAT, TRD, """ft AS (SELECT symbol, open_ms, i, r24 > quantile_cont(r24, 0.6666666666666666) OVER w AS h24, r72 > quantile_cont(r72, 0.6666666666666666) OVER w AS h72
  FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING))""",
    "aj AS (SELECT t.*, f.h24, f.h72 FROM trd t ASOF JOIN ft f ON t.symbol = f.symbol AND t.opened_ms >= f.open_ms WHERE f.i >= 200 AND abs(net) <= 3)", calendar("aj", "ah")) + f"""
SELECT half, coalesce(h24 AND h72, FALSE) AS picked, count(*) AS n, {r('avg(net)')} AS mean FROM ah GROUP BY ALL"""

# ---- studies over positions ---------------------------------------------------------------------------------


def pair_sql(value: str, min_tr: int, min_n: int, src: str = "pos") -> str:
    return f"""pp AS (SELECT symbol, trader_id, avg({value}) AS m, sum(pnl) AS u FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL),
ps AS (SELECT symbol, count(*) AS npos, {share(value + ' > 0')} * 100 AS wr, {payoff(value)} AS payoff, avg({value}) AS expectancy FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL),
pa AS (SELECT symbol, count(*) AS ntr, sum(u) AS usd, {share('m > 0')} * 100 AS pct_win, count(*) FILTER (WHERE m > 0) AS n_winners,
  CASE WHEN sum(u) > 0 THEN max(u) / sum(u) * 100 END AS top1, {med('m')} AS med_value, {med('u')} AS med_usd FROM pp GROUP BY ALL),
pair AS (SELECT * FROM pa JOIN ps USING (symbol) WHERE ntr >= {min_tr} AND npos >= {min_n})"""


_pair_cols = f"""symbol, npos, ntr, {r('usd', 2)} AS usd, {r('pct_win')} AS pct_win, n_winners, {r('wr')} AS wr, {r('payoff')} AS payoff, {r('expectancy')} AS expectancy,
  {r('top1')} AS top1, {r('med_value')} AS med_value, {r('med_usd', 2)} AS med_usd"""
SQL["a13_pair_select"] = _with(POS, pair_sql("roi", 20, 100)) + f"SELECT {_pair_cols} FROM pair"
SQL["e26_broad_pairs"] = _with(POS, pair_sql("roi", 5, 10)) + f"SELECT {_pair_cols} FROM pair WHERE n_winners >= 3 AND top1 < 60 AND med_value > 0"
SQL["a14_pair_stability"] = _with(POS, V, pair_sql("pr", 20, 100), CUT.format(x=slot("closed_ms", 1, 2), src="v"), f"""hs AS (SELECT symbol,
  CASE WHEN count(*) FILTER (WHERE closed_ms < cut_ms) > 30 THEN {med('pr', 'closed_ms < cut_ms')} END AS m1,
  CASE WHEN count(*) FILTER (WHERE closed_ms >= cut_ms) > 30 THEN {med('pr', 'closed_ms >= cut_ms')} END AS m2, {med('leverage')} AS lev_med FROM v, cut GROUP BY ALL)""") + f"""
SELECT symbol, npos, ntr, {r('usd', 2)} AS usd, {r('med_value')} AS med_value, {r('pct_win')} AS pct_win, {r('m1')} AS m1, {r('m2')} AS m2, {r('lev_med')} AS lev_med,
  coalesce(m1 > 0 AND m2 > 0, FALSE) AS stable FROM pair JOIN hs USING (symbol)"""
QUART = """qs AS (SELECT trader_id, avg(roi) AS s FROM v GROUP BY ALL HAVING count(*) >= 10),
qr AS (SELECT trader_id, CASE WHEN k <= greatest(1, n // 4) THEN 'top' WHEN k > n - greatest(1, n // 4) THEN 'bottom' END AS cohort FROM (
  SELECT trader_id, row_number() OVER (ORDER BY s DESC, trader_id) AS k, count(*) OVER () AS n FROM qs)),
qv AS (SELECT v.*, cohort FROM v JOIN qr USING (trader_id) WHERE cohort IS NOT NULL)"""
_sums = lambda x: f"count(*) AS n, {r(f'avg({x})')} AS mean, {r(share(x + ' > 0') + ' * 100')} AS wr, {r(payoff(x))} AS payoff, " \
    + r(share("side = 'Long'") + " * 100") + " AS pct_long, " + r(share("isolated = 'Cross'") + " * 100") + " AS pct_cross"
SQL["a15_behaviour_quartiles"] = _with(POS, V, QUART, f"""cvq AS (SELECT cohort, {med('c')} AS pos_per_trader_med, {med('cv', 'c > 3')} AS size_cv_med FROM (
  SELECT cohort, trader_id, count(*) AS c, stddev_samp(notional) / avg(notional) AS cv FROM qv GROUP BY ALL) GROUP BY ALL)""") + f"""
SELECT cohort, {_sums('pr')}, {r(med('-pr', 'pr < 0'))} AS med_loss, {r(med('pr', 'pr > 0'))} AS med_win, {r(med('dur_h'))} AS dur_med, {r(excl('dur_h', 9, 10))} AS dur_p90,
  {r(med('leverage'))} AS lev_med, {r(excl('leverage', 9, 10))} AS lev_p90, {r('any_value(pos_per_trader_med)')} AS pos_per_trader_med, {r('any_value(size_cv_med)')} AS size_cv_med
  FROM qv JOIN cvq USING (cohort) GROUP BY cohort"""
SQL["a16_duration_profile"] = _with(POS, V, QUART) + f"SELECT cohort, {DUR_MONTH} AS bucket, count(*) AS n, {r(share('pr > 0') + ' * 100')} AS wr, {r(med('pr'))} AS med_pr FROM qv GROUP BY ALL"
NET = "nt AS (SELECT *, pnl / notional AS net FROM pos WHERE notional > 0 AND abs(pnl / notional) <= 3)"
SQL["a17_elite_out_of_sample"] = _with(POS, NET, calendar("nt", "nh"), "es AS (SELECT trader_id, avg(net) AS s FROM nh WHERE half = 0 GROUP BY ALL HAVING count(*) >= 30)",
    """er AS (SELECT trader_id, CASE WHEN k <= n // 3 THEN 'top' WHEN k > n - n // 3 THEN 'bottom' END AS cohort FROM (SELECT trader_id, row_number() OVER (ORDER BY s DESC, trader_id) AS k, count(*) OVER () AS n FROM es))""",
    "ev AS (SELECT nh.*, cohort FROM nh JOIN er USING (trader_id) WHERE half = 1 AND cohort IS NOT NULL)") + f"""SELECT cohort, symbol, {_sums('net')}, count(DISTINCT trader_id) AS n_traders,
  {r(med('net'))} AS med_net, {r(med('dur_h'))} AS dur_med, {r(med('leverage'))} AS lev_med FROM ev GROUP BY ALL"""


def halves_sql(src: str, value: str, min_rows: int, both: bool = True) -> str:
    ok = f"count(*) >= {min_rows}" + (f" AND count(*) FILTER (WHERE {value} > 0) > 0 AND count(*) FILTER (WHERE {value} < 0) > 0" if both else "")
    return f"""hp AS (SELECT trader_id, half, count(*) AS n, {share(value + ' > 0')} AS wr, {payoff(value)} AS payoff, avg({value}) AS exp FROM {src} GROUP BY ALL HAVING {ok}),
hw AS (SELECT a.trader_id, a.n AS n1, b.n AS n2, a.wr AS wr1, b.wr AS wr2, a.payoff AS payoff1, b.payoff AS payoff2, a.exp AS exp1, b.exp AS exp2
  FROM hp a JOIN hp b ON a.trader_id = b.trader_id AND a.half = 0 AND b.half = 1)"""


OWN = "oh AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY trader_id ORDER BY {t}, position_key) - 1 >= count(*) OVER (PARTITION BY trader_id) // 2 THEN 1 ELSE 0 END AS half FROM v)"
AVG_RANK = "rank() OVER ({p}ORDER BY {x}) + (count(*) OVER (PARTITION BY {q}{x}) - 1) / 2e0"
SQL["e1_persistence_ordinal"] = _with(POS, V, OWN.format(t="closed_ms"), halves_sql("oh", "pr", 1, False), "hk AS (SELECT *, " + ", ".join(
    f"row_number() OVER (ORDER BY {x}, trader_id) AS k_{x}" for x in ("exp1", "exp2", "wr1", "wr2")) + " FROM hw WHERE n1 + n2 >= 20)") + f"""
SELECT count(*) AS n, {r('coalesce(corr(k_exp1, k_exp2), 0)')} AS rho_return, {r('coalesce(corr(k_wr1, k_wr2), 0)')} AS rho_wr FROM hk"""
SQL["e1_persistence_thirds"] = _with(POS, V, OWN.format(t="closed_ms"), halves_sql("oh", "pr", 1, False), """hc AS (SELECT *, CASE WHEN k <= greatest(1, n // 3) THEN 'top' WHEN k > n - greatest(1, n // 3) THEN 'bottom' END AS cohort
  FROM (SELECT *, row_number() OVER (ORDER BY exp1 DESC, trader_id) AS k, count(*) OVER () AS n FROM hw WHERE n1 + n2 >= 20))""") + f"""
SELECT cohort, {r(med('exp1'))} AS med_exp1, {r(med('exp2'))} AS med_exp2, {r(med('wr2'))} AS med_wr2 FROM hc WHERE cohort IS NOT NULL GROUP BY ALL"""
DEMEAN = ("gm AS (SELECT symbol, side, half, avg(net) AS gmean FROM nh GROUP BY ALL HAVING count(*) >= 10)", "dm AS (SELECT nh.*, net - gmean AS net_dm FROM nh JOIN gm USING (symbol, side, half))")
SQL["e2_pooled_rho"] = _with(POS, NET, calendar("nt", "nh"), *DEMEAN, halves_sql("dm", "net_dm", 30, False), "hk AS (SELECT " + ", ".join(
    AVG_RANK.format(p="", q="", x=x) + f" AS k_{x}" for x in ("exp1", "exp2")) + " FROM hw)") + f"SELECT count(*) AS n, {r('coalesce(corr(k_exp1, k_exp2), 0)')} AS rho FROM hk"

# Resampling draws the same integers as the Spark job.
M = 2147483647


def mix_sql(step: str, slot_: str, seed: int) -> str:
    h1 = f"((({slot_} + 1) * 1103515245 + ({step} + 1) * 12345677 + {seed}) % {M})"
    h2 = f"(({h1} * {h1} + {slot_}) % {M})"
    h3 = f"(({h2} * 48271 + {step}) % {M})"
    return f"(({h3} * {h3} + {slot_} * 7) % {M})"


def resample_sql(tag: str, a: str, b: str, src: str, n_perm: int, n_boot: int, seed: int = 42) -> str:
    """Permutation p and bootstrap interval of the rank correlation, by definition."""
    return f"""b{tag} AS (SELECT row_number() OVER (ORDER BY trader_id) - 1 AS slot, {a} AS a, {b} AS b, {AVG_RANK.format(p='', q='', x=a)} AS x, {AVG_RANK.format(p='', q='', x=b)} AS y FROM {src}),
o{tag} AS (SELECT count(*) AS n, coalesce(corr(x, y), 0) AS rho FROM b{tag}),
p{tag} AS (SELECT step, slot, x, row_number() OVER (PARTITION BY step ORDER BY {mix_sql('step', 'slot', seed)}, slot) - 1 AS place FROM b{tag}, range(1, {n_perm + 1}) s(step)),
s{tag} AS (SELECT step, coalesce(corr(p.x, q.y), 0) AS r FROM p{tag} p JOIN b{tag} q ON p.place = q.slot GROUP BY step),
d{tag} AS (SELECT step, {mix_sql('step', 'slot', seed)} % (SELECT n FROM o{tag}) AS pick FROM b{tag}, range(1, {n_boot + 1}) s(step)),
e{tag} AS (SELECT step, {AVG_RANK.format(p='PARTITION BY step ', q='step, ', x='a')} AS ka, {AVG_RANK.format(p='PARTITION BY step ', q='step, ', x='b')} AS kb FROM d{tag} JOIN b{tag} ON pick = slot),
f{tag} AS (SELECT step, coalesce(CASE WHEN isnan(corr(ka, kb)) THEN 0 ELSE corr(ka, kb) END, 0) AS r FROM e{tag} GROUP BY step),
g{tag} AS (SELECT n, {r('rho')} AS rho, {r(f'((SELECT count(*) FROM s{tag} WHERE abs(r) >= abs(rho) - 1e-12) + 1) / {n_perm + 1}e0')} AS p,
  (SELECT {r(idx('r', '25e-3'))} FROM f{tag}) AS ci_low, (SELECT {r(idx('r', '975e-3'))} FROM f{tag}) AS ci_high FROM o{tag})"""


SQL["e1_persistence"] = _with(POS, V, OWN.format(t="opened_ms"), halves_sql("oh", "pr", 10), *[
    resample_sql(m, f"{m}1", f"{m}2", "hw", 10_000, 2_000) for m in ("wr", "payoff", "exp")]) + " UNION ALL ".join(f"SELECT *, '{m}' AS metric FROM g{m}" for m in ("wr", "payoff", "exp"))
SQL["e2_pooled_persistence"] = _with(POS, NET, calendar("nt", "nh"), *DEMEAN, halves_sql("nh", "net", 30, False).replace("hp ", "hpr ").replace("hw ", "hwr "),
                                     halves_sql("dm", "net_dm", 30, False), resample_sql("raw", "exp1", "exp2", "hwr", 10_000, 2_000), resample_sql("dem", "exp1", "exp2", "hw", 10_000, 2_000)) \
    + "SELECT *, 'raw' AS control FROM graw UNION ALL SELECT *, 'demeaned' AS control FROM gdem"
SQL["e8_rule_significance"] = _with(*RUL, "b AS (SELECT row_number() OVER (ORDER BY CAST(position_key AS VARCHAR)) - 1 AS slot, st AS v, r1 AND leverage <= 25 AND dur_h >= 1 AS pk FROM rul WHERE half = 1)",
    "o AS (SELECT count(*) FILTER (WHERE pk) AS n_a, count(*) FILTER (WHERE NOT pk) AS n_b, avg(v) FILTER (WHERE pk) AS ma, avg(v) FILTER (WHERE NOT pk) AS mb FROM b)",
    f"pl AS (SELECT step, v, row_number() OVER (PARTITION BY step ORDER BY {mix_sql('step', 'slot', 11)}, slot) - 1 AS place FROM b, range(1, 20001) s(step))",
    "sm AS (SELECT step, abs(avg(v) FILTER (WHERE place < n_a) - avg(v) FILTER (WHERE place >= n_a)) AS gap FROM pl, o GROUP BY step)") + f"""
SELECT n_a, n_b, {r('ma')} AS mean_a, {r('mb')} AS mean_b, {r('((SELECT count(*) FROM sm WHERE gap >= abs(ma - mb) - 1e-15) + 1) / 20001e0')} AS p FROM o"""
_pf = f"per AS (SELECT trader_id, {share('pr > 0')} AS wr, {payoff('pr')} AS payoff, avg(pr) AS exp FROM v GROUP BY ALL HAVING count(*) >= 20 AND {payoff('pr')} IS NOT NULL)"
SQL["m2_style_correlations"] = _with(POS, V, _pf, "k AS (SELECT *, " + ", ".join(f"row_number() OVER (ORDER BY {x}, trader_id) AS k_{x}" for x in ("wr", "payoff", "exp")) + " FROM per)") + "SELECT count(*) AS n, " + ", ".join(
    f"{r(f'coalesce(corr({a}, {b}), 0)')} AS pearson_{a}_{b}, {r(f'coalesce(corr(k_{a}, k_{b}), 0)')} AS spearman_{a}_{b}" for a, b in (("wr", "payoff"), ("wr", "exp"), ("payoff", "exp"))) + " FROM k"
SQL["m5_mann_whitney"] = PV[:-1] + f""", rr AS (SELECT side, symbol, rank() OVER (PARTITION BY side ORDER BY pr) + (count(*) OVER (PARTITION BY side, pr) - 1) / 2e0 AS rk,
  count(*) OVER (PARTITION BY side) AS tot FROM v), zz AS (SELECT side, symbol, sum(rk) AS s, CAST(count(*) AS DOUBLE) AS na, any_value(tot) - count(*) AS nb FROM rr GROUP BY ALL)
SELECT side, symbol, CAST(na AS BIGINT) AS n_cell, CAST(nb AS BIGINT) AS n_rest, {r('CASE WHEN na >= 20 AND nb >= 20 THEN (s - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb * (na + nb + 1) / 12) ELSE 0 END')} AS z FROM zz"""
SQL["m14_detectable_rho"] = PV + f"SELECT symbol, count(DISTINCT trader_id) AS n, {r('CASE WHEN count(DISTINCT trader_id) > 3 THEN tanh(2.8e0 / sqrt(count(DISTINCT trader_id) - 3e0)) END')} AS rho_min FROM v GROUP BY ALL"
SQL["m10_composite_ranking"] = _with(POS, "bt AS (SELECT *, pnl / notional AS net FROM pos WHERE pr IS NOT NULL AND abs(pnl / notional) <= 3)",
    f"bc AS (SELECT symbol, month, side, {med('net')} AS bench FROM bt GROUP BY ALL HAVING count(*) >= 20)",
    "ba AS (SELECT bt.*, net - bench AS alpha, CASE WHEN row_number() OVER (PARTITION BY trader_id ORDER BY opened_ms, position_key) - 1 >= count(*) OVER (PARTITION BY trader_id) // 2 THEN 1 ELSE 0 END AS half FROM bt LEFT JOIN bc USING (symbol, month, side))",
    """bl AS (SELECT trader_id, CASE WHEN count(*) >= 10 AND max(x) > 0 THEN regr_slope(alpha, x) END AS slope FROM (
  SELECT trader_id, alpha, (opened_ms - min(opened_ms) OVER (PARTITION BY trader_id)) / nullif(max(opened_ms) OVER (PARTITION BY trader_id) - min(opened_ms) OVER (PARTITION BY trader_id), 0) AS x FROM ba WHERE alpha IS NOT NULL) GROUP BY ALL)""",
    f"""bp AS (SELECT trader_id, count(*) AS n, avg(alpha) AS alpha, avg(pr) AS pr, {share('pr > 0')} AS wr, {med('leverage')} AS lev_med, CASE WHEN sum(pnl) > 0 THEN max(pnl) / sum(pnl) * 100 END AS conc,
  count(alpha) FILTER (WHERE half = 0) >= 10 AND count(alpha) FILTER (WHERE half = 1) >= 10 AND avg(alpha) FILTER (WHERE half = 0) > 0 AND avg(alpha) FILTER (WHERE half = 1) > 0 AS cons
  FROM ba GROUP BY ALL HAVING count(*) >= 40 AND count(alpha) >= 30)""",
    """bs AS (SELECT *, 3 * (alpha - avg(alpha) OVER ()) / stddev_pop(alpha) OVER () + CASE WHEN cons THEN 1.5 ELSE 0 END + CASE WHEN slope > 0 THEN 1 ELSE 0 END - CASE WHEN lev_med > 25 THEN 1 ELSE 0 END
  - CASE WHEN conc > 40 THEN 1.5 ELSE 0 END - CASE WHEN n < 60 THEN 0.5 ELSE 0 END AS score FROM bp LEFT JOIN bl USING (trader_id))""") + "SELECT trader_id, n, " + ", ".join(
    f"{r(x, 4)} AS {x}" for x in ("alpha", "pr", "wr", "lev_med", "slope", "conc", "score")) + " FROM bs ORDER BY bs.score DESC, trader_id LIMIT 12"
SQL["e15_vanished_history"] = _with(POS2, SUP1, "old AS (SELECT * FROM pos WHERE snapshot_date = '2000-01-01')",
    "gone AS (SELECT o.*, coalesce(o.opened_ms < s.start_time, FALSE) AS before FROM old o LEFT JOIN sup s USING (trader_id) WHERE o.opened_ms < 870000000000)",
    "g AS (SELECT trader_id, count(*) AS n, count(*) FILTER (WHERE before) AS nb, sum(pnl) FILTER (WHERE before) AS p FROM gone GROUP BY ALL)") + """
SELECT 'binance' AS exchange, CAST(sum(n) AS BIGINT) AS n_vanished, count(*) AS n_traders, CAST(sum(nb) AS BIGINT) AS n_before_start, count(*) FILTER (WHERE nb > 0) AS n_traders_before,
  count(*) FILTER (WHERE p < 0) AS n_net_negative_before FROM g"""
SQL["e20_equity_floor_cost"] = _with(SUP1) + "SELECT floor, count(*) FILTER (WHERE aum < floor) AS n_flagged, count(*) AS n_traders FROM sup, (VALUES (1e3), (5e3), (1e4), (1e5), (1e6)) f(floor) GROUP BY ALL"
SQL["e21_copy_scaling"] = _with(POS, SUP1, "mn AS (SELECT p_type AS symbol, max(p_size) * 1e0 AS min_notional FROM part GROUP BY ALL)",
    "sc AS (SELECT trader_id, capital, min_notional, notional * capital / aum AS scaled FROM pos JOIN sup USING (trader_id) JOIN mn USING (symbol), (VALUES (5e2), (1e3), (5e3)) c(capital) WHERE aum > 0)") + f"""
SELECT trader_id, capital, count(*) AS n, count(*) FILTER (WHERE scaled < min_notional) AS n_below, {r('max(min_notional / scaled) FILTER (WHERE scaled < min_notional AND scaled > 0)', 3)} AS worst_oversize FROM sc GROUP BY ALL"""
SQL["e22_hedge_overlap"] = _with(POS, "lg AS (SELECT * FROM pos WHERE closed_ms > opened_ms)",
    """ov AS (SELECT a.trader_id, a.symbol, a.side, a.position_key, count(b.position_key) AS c FROM lg a LEFT JOIN lg b ON a.trader_id = b.trader_id AND a.symbol = b.symbol AND a.side <> b.side
  AND b.opened_ms < a.closed_ms AND b.closed_ms > a.opened_ms GROUP BY ALL)""",
    "pt AS (SELECT trader_id, sum(CASE WHEN side = 'Long' THEN c ELSE 0 END) AS p, count(*) FILTER (WHERE c > 0) AS l FROM ov GROUP BY ALL)") + f"""
SELECT CAST(sum(p) AS BIGINT) AS n_pairs, CAST(sum(l) AS BIGINT) AS n_hedged_legs, {r(share('l > 0'))} AS share_traders FROM pt"""
_PER = "SELECT trader_id, count(*) AS n, avg(alpha) AS alpha, " + t_of("alpha") + " AS t FROM al GROUP BY ALL"
SQL["e22_alpha_without_hedges"] = _with(POS, """hl AS (SELECT p.*, EXISTS (SELECT 1 FROM pos b WHERE b.trader_id = p.trader_id AND b.symbol = p.symbol AND b.side <> p.side AND b.closed_ms > b.opened_ms
  AND p.closed_ms > p.opened_ms AND b.opened_ms < p.closed_ms AND b.closed_ms > p.opened_ms) AS hedge FROM pos p WHERE pr IS NOT NULL)""",
    f"whole AS ({_with('v AS (SELECT * FROM hl)', alpha_ctes())} {_PER})", f"rest AS ({_with('v AS (SELECT * FROM hl WHERE NOT hedge)', alpha_ctes())} {_PER})",
    "h AS (SELECT trader_id, count(*) AS n_hedge_legs FROM hl WHERE hedge GROUP BY ALL)") + f"""
SELECT trader_id, whole.n AS n_all, n_hedge_legs, {r('whole.alpha')} AS alpha_all, {r('whole.t')} AS t_all, rest.n AS n_unhedged, {r('rest.alpha')} AS alpha_unhedged, {r('rest.t')} AS t_unhedged
  FROM h JOIN whole USING (trader_id) LEFT JOIN rest USING (trader_id)"""
SQL["e23_cell_drift"] = _with(POS2, V, f"cb AS (SELECT snapshot_date, symbol, month, side, count(*) AS n, {med('pr')} AS b FROM v GROUP BY ALL)",
    "o AS (SELECT * FROM cb WHERE snapshot_date = '2000-01-01')", "w AS (SELECT * FROM cb WHERE snapshot_date = '2002-01-01')") + f"""
SELECT coalesce(o.symbol, w.symbol) AS symbol, coalesce(o.month, w.month) AS month, coalesce(o.side, w.side) AS side, o.n AS n_old, {r('o.b')} AS bench_old, w.n AS n_new, {r('w.b')} AS bench_new,
  o.n IS NOT NULL AND coalesce(w.n, 0) < 0.5 * o.n AS shrank FROM o FULL JOIN w ON o.symbol = w.symbol AND o.month = w.month AND o.side = w.side"""

_SIGNAL = (
    CAN, FEAT, "hx AS (SELECT f.*, hold, count(*) OVER (PARTITION BY symbol, hold) AS nc FROM feat f, (VALUES (24), (48), (72), (120)) h(hold))",
    "fr AS (SELECT symbol, hold, i FROM hx WHERE i >= 200 AND i < nc - hold AND r24 > 0.0055 AND r72 > 0.0063 AND close > ma_incl)",
    """pk AS (SELECT symbol, hold, min(i) AS i FROM fr GROUP BY ALL UNION ALL
  SELECT p.symbol, p.hold, min(f.i) AS i FROM pk p JOIN fr f ON f.symbol = p.symbol AND f.hold = p.hold AND f.i >= p.i + p.hold GROUP BY p.symbol, p.hold)""",
    """sg AS (SELECT pk.symbol, pk.hold, pk.i, a.open_ms, b.close / a.close - 1 - 8e-4 AS ret FROM pk JOIN feat a ON a.symbol = pk.symbol AND a.i = pk.i
  JOIN feat b ON b.symbol = pk.symbol AND b.i = pk.i + pk.hold)""")
_R = lambda *ctes: _with(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)
SQL["e9_signal_event_study"] = _R(*_SIGNAL, "cu AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol, hold ORDER BY i) AS eq FROM sg)",
    "cv AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol, hold ORDER BY i)) AS peak FROM cu)") + f"""
SELECT symbol, hold, count(*) AS n, {r('avg(ret)', 4)} AS mean, {r(share('ret > 0') + ' * 100', 4)} AS wr, {r('product(1 + ret)', 4)} AS equity,
  {r('max((peak - eq) / peak)', 4)} AS mdd, {r(med('ret'), 4)} AS med FROM cv GROUP BY ALL"""
SQL["e9_signal_by_year"] = _R(*_SIGNAL, """bh AS (SELECT symbol, year(make_timestamp(open_ms * 1000)) AS year, product(1 + ret) - 1 AS b FROM (
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY open_ms) - 1 AS ret FROM can) GROUP BY ALL)""") + f"""
SELECT symbol, hold, year, count(*) AS n, {r('avg(ret)', 4)} AS mean, {r('product(1 + ret)', 4)} AS equity, {r('any_value(b)', 4)} AS buy_and_hold
  FROM (SELECT *, year(make_timestamp(open_ms * 1000)) AS year FROM sg) LEFT JOIN bh USING (symbol, year) GROUP BY symbol, hold, year"""

# ---- sources ------------------------------------------------------------------------------------------------

ITEMS = """it AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey AS k, CAST(l_suppkey AS VARCHAR) AS t, 'P' || (l_partkey % 50) AS sym, l_orderkey AS o,
  l_linenumber AS ln, l_quantity AS qty, l_extendedprice AS px, l_discount AS disc, l_tax AS tax, l_returnflag AS flag, l_linestatus AS st, epoch_ms(l_shipdate) AS ms FROM lineitem)"""
FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM it{where}) WHERE rn = 1)"
SQL["s1_read_binance"] = _with(ITEMS) + f"""SELECT t AS trader_id, sym AS symbol, CASE WHEN st = 'O' THEN 'Long' ELSE 'Short' END AS side, ms AS opened_ms,
  CASE WHEN flag <> 'R' THEN ms + 3600000 * ln END AS closed_ms, CASE WHEN flag <> 'R' THEN CAST(ln AS DOUBLE) END AS dur_h, lev AS leverage, {r('qty * tax', 4)} AS notional,
  {r('qty * tax / lev', 4)} AS margin, CASE WHEN ln <> 3 THEN {r('px', 4)} END AS pnl, flag = 'A' AND 1 < qty AS partial FROM (SELECT *, CASE WHEN ln = 7 THEN 1e0 ELSE ln END AS lev FROM it)"""
SQL["s2_read_phemex"] = _with(ITEMS, FIRST.format(keys="t, o", order="k", where="")) + f"""SELECT t AS trader_id, CAST(o AS VARCHAR) AS position_key, sym AS symbol, CASE WHEN st = 'O' THEN 'Long' ELSE 'Short' END AS side,
  CASE WHEN ln = 2 THEN ms - 1 ELSE ms END AS opened_ms, {r('CASE WHEN ln = 7 THEN 0 ELSE px / qty END', 9)} AS leverage, {r('px', 4)} AS notional, {r('disc', 4)} AS pnl FROM f"""
SQL["s3_read_okx"] = _with(ITEMS, FIRST.format(keys="t, o", order="k", where="")) + f"""SELECT t AS trader_id, CAST(o AS VARCHAR) AS position_key, CASE WHEN st = 'O' THEN 'long' ELSE 'short' END AS side, ms AS opened_ms,
  CASE WHEN flag <> 'R' THEN ms + 60000 END AS closed_ms, CAST(ln AS DOUBLE) AS leverage, {r('qty * ln', 4)} AS notional, {r('disc', 4)} AS pnl FROM f"""
SQL["s4_read_bybit"] = _with(ITEMS, FIRST.format(keys="o", order="k, CAST(t AS BIGINT)", where=" WHERE o % 50 <> 0")) + f"""SELECT t AS trader_id, CASE WHEN o % 50 <> 0 THEN CAST(o AS VARCHAR) END AS position_key, sym AS symbol,
  CAST(ln AS DOUBLE) AS leverage, {r('qty * ln', 4)} AS notional, {r('disc', 4)} AS pnl FROM (SELECT * EXCLUDE (rn) FROM f UNION ALL SELECT * FROM it WHERE o % 50 = 0)"""
SQL["s5_read_bitget"] = _with(ITEMS, FIRST.format(keys="t, o", order="flag = 'R', k DESC", where=" WHERE o % 50 <> 0")) + f"""SELECT t AS trader_id, CASE WHEN o % 50 <> 0 THEN CAST(o AS VARCHAR) END AS position_key,
  CASE WHEN st = 'O' THEN 'long' ELSE 'short' END AS side, CAST(ln AS DOUBLE) AS leverage, {r('qty', 4)} AS roi, {r('px', 4)} AS pnl, flag = 'R' AS is_raw
  FROM (SELECT * EXCLUDE (rn) FROM f UNION ALL SELECT * FROM it WHERE o % 50 = 0)"""
SQL["s6_read_kucoin"] = _with(ITEMS, FIRST.format(keys="t, ms, ms + o % 5", order="k DESC", where=" WHERE o % 50 <> 0")) + f"""SELECT t AS trader_id, CASE WHEN o % 50 <> 0 THEN 'S' END AS symbol, ms AS opened_ms, ms + o % 5 AS closed_ms,
  CAST(ln AS DOUBLE) AS leverage, {r('px', 4)} AS pnl FROM (SELECT * EXCLUDE (rn) FROM f UNION ALL SELECT * FROM it WHERE o % 50 = 0)"""
SQL["s7_listing"] = """SELECT 'binance' AS exchange, CAST(s_suppkey AS VARCHAR) AS trader_id, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 THEN s_suppkey * 1000 END AS start_time,
  s_suppkey % 4 <> 0 AS listed FROM supplier"""
SQL["s9_open_sums"] = _with(ITEMS) + f"""SELECT t AS trader_id, {r("sum(CASE WHEN flag = 'A' THEN 0 ELSE tax END)", 4)} AS upl_sum, 0e0 AS upl_neg_sum, count(*) AS n_open, TRUE AS has_upl FROM it GROUP BY ALL"""
SQL["s13_bybit_pages"] = _with(ITEMS) + f"""SELECT t AS trader_id, CAST(k AS VARCHAR) AS position_key, CASE WHEN st = 'O' THEN 'long' ELSE 'short' END AS side, CAST(ln AS DOUBLE) AS leverage, {r('px', 4)} AS pnl,
  {r('disc', 4)} AS roi, {r('qty', 4)} AS margin, ms AS opened_ms FROM it"""
SQL["s14_bitget_pages"] = _with(ITEMS) + f"""SELECT t AS trader_id, CAST(k AS VARCHAR) AS position_key, CASE WHEN st = 'O' THEN 'long' ELSE 'short' END AS side, CAST(ln AS DOUBLE) AS leverage, {r('px', 4)} AS pnl,
  {r('qty', 4)} AS roi, ms AS opened_ms FROM it"""
SQL["s15_kucoin_open"] = _with(ITEMS) + f"""SELECT t AS trader_id, sym AS symbol, CASE WHEN st = 'O' THEN 'long' ELSE 'short' END AS side, {r('px', 4)} AS unrealized_pnl, {r('disc', 4)} AS realized_pnl,
  {r('tax', 4)} AS trade_fee, ms AS opened_ms FROM it"""
SQL["s16_split_closed_open"] = _with(ITEMS, FIRST.format(keys="t, o", order="k", where="")) + "SELECT t AS trader_id, CASE WHEN flag = 'R' THEN 'open' ELSE 'closed' END AS kind, count(*) AS n FROM f GROUP BY ALL"
SQL["s17_pivot_and_metric_text"] = "SELECT c_custkey AS trader_id, round(c_acctbal, 2) AS pnl, CAST(c_nationkey AS DOUBLE) AS roi, CAST(NULL AS DOUBLE) AS rank FROM customer"
SQL["s19_unify_traders"] = """SELECT 'okx' AS exchange, CAST(s_nationkey AS VARCHAR) AS trader_id, arg_max(s_name, s_suppkey) AS nickname, CAST(arg_max(s_acctbal, s_suppkey) AS VARCHAR) AS pnl_usd, NULL AS roi,
  NULL AS aum_usd, NULL AS followers, NULL AS win_rate, '{}' AS extra_json FROM supplier GROUP BY s_nationkey
UNION ALL SELECT 'bybit', CAST(c_custkey AS VARCHAR), c_name, NULL, NULL, '', CAST(c_nationkey AS VARCHAR), NULL, '{"segment":"' || c_mktsegment || '"}' FROM customer"""
SQL["s21_statuses"] = """SELECT CAST(o_custkey AS VARCHAR) AS trader_id, CASE WHEN bool_or(o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0) THEN 'error' WHEN bool_or(o_orderkey % 97 = 0) THEN 'protected' ELSE 'ok' END AS status
  FROM orders GROUP BY ALL"""
SQL["s22_detail"] = """SELECT CAST(s_suppkey AS VARCHAR) AS trader_id, s_suppkey % 7 = 0 AS retired, CASE WHEN s_suppkey % 7 > 1 AND s_suppkey % 5 <> 0 THEN s_acctbal END AS copier_pnl,
  CASE WHEN s_suppkey % 7 > 1 THEN s_nationkey END AS copier_count_total FROM supplier WHERE s_suppkey % 7 <> 1"""
SQL["s24_assemble_records"] = P + """SELECT trader_id, page, max(c) AS n_pos, count(*) AS n_in_page, min(opened_ms) AS first_ms FROM (
  SELECT *, (row_number() OVER (PARTITION BY trader_id ORDER BY opened_ms, position_key) - 1) // 100 AS page, count(*) OVER (PARTITION BY trader_id) AS c FROM pos) GROUP BY trader_id, page"""
SQL["s10_equity_points"] = "SELECT CAST(user_id AS VARCHAR) AS trader_id, event_id AS ts, round(value * 1e-2, 6) AS value FROM events"
SQL["s11_latest_status"] = """SELECT CAST(o_custkey AS VARCHAR) AS trader_id, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'ok' ELSE 'protected' END, o_orderkey) AS status,
  round(arg_max(o_totalprice, o_orderkey), 2) AS amount FROM orders WHERE o_orderkey % 3 < 2 GROUP BY ALL"""
SQL["s12_candle_file"] = """SELECT event_type AS symbol, epoch_ms(ts) // 3600000 * 3600000 AS open_ms, round(arg_min(value, event_id), 2) AS close FROM events
  WHERE epoch_ms(ts) // 3600000 * 3600000 < 1706000000000 GROUP BY ALL"""
SQL["s20_leaderboards"] = """SELECT CAST(o_custkey AS VARCHAR) AS trader_id, 'first' AS kept, round(arg_min(o_totalprice, o_orderkey), 2) AS amount FROM orders GROUP BY ALL
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'last', round(arg_max(o_totalprice, o_orderkey), 2) FROM orders GROUP BY ALL"""
SQL["s23_recommend_list"] = """SELECT CAST(c_custkey AS VARCHAR) AS trader_id, c_name AS nick, round(c_acctbal, 2) AS pnl30, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS mdd30,
  CAST(NULL AS DOUBLE) AS roi30, c_custkey % 2 = 0 AS show_position FROM customer"""


# The ingest job: both exchanges have the same positions; one derives leverage and publishes neither listing nor details.
ING_SUP = """sup AS (SELECT d.snapshot_date, CAST(s_suppkey AS VARCHAR) AS trader_id, s_name AS nick, s_acctbal / 1e1 AS roi, s_acctbal * 1e3 AS aum,
  CAST((s_suppkey * 37) % 100 AS DOUBLE) AS mdd, s_suppkey % 5 <> 0 AS listed,
  CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 50 END AS copier_count_total, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal - 4e3 END AS copier_pnl,
  CASE WHEN s_suppkey % 6 <> 0 THEN FALSE END AS retired,
  CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 9 <> 0 THEN 1009843200000 - (s_suppkey % 400) * 86400000 END AS start_time
  FROM supplier, (VALUES ('2002-01-01'), ('2000-01-01')) d(snapshot_date))"""
ING_NONE = ING_SUP.replace("s_acctbal / 1e1 AS roi, s_acctbal * 1e3 AS aum", "NULL::DOUBLE AS roi, NULL::DOUBLE AS aum").replace("FROM supplier,", "FROM supplier JOIN (SELECT 1 WHERE FALSE) ON TRUE,")
PHEMEX2 = POS2.replace(", pos AS (", ", pos1 AS (SELECT * REPLACE ('u' || trader_id AS trader_id, notional / margin AS leverage) FROM pos0), pos AS (").replace("FROM pos0 WHERE ship", "FROM pos1 WHERE ship").replace(
    "'binance', *", "'phemex', *").replace("'binance' AS exchange", "'phemex' AS exchange").replace("FROM pos0\n  UNION", "FROM pos1\n  UNION")


def _ingested(positions: str, sup: str) -> str:
    chain = _with(positions, V, sup, OPEN + "", alpha_ctes(), metrics_ctes(), detect_ctes(), rank_ctes()).replace("ship >= DATE '2001-01-01')", "FALSE)")
    return chain.replace("\nal AS (", "\nal AS MATERIALIZED (").replace("\nsco AS (", "\nsco AS MATERIALIZED (")


_RANKING = " UNION ALL ".join(f"""SELECT * FROM ({_ingested(positions, sup)} SELECT trader_id, snapshot_date, '{ex}' AS exchange, n, n_alpha, {r('alpha')} AS alpha,
  {r('t_stat')} AS t_stat, array_to_string(flags, ',') AS flags, {r('score')} AS score, tier, {r('weight')} AS weight FROM tie)"""
    for ex, positions, sup in (("binance", POS2, ING_SUP), ("phemex", PHEMEX2, ING_NONE)))
SQL["k2_ingest_ranking"] = _RANKING
SQL["k2_ingest_traders"] = _with(POS2, ING_SUP, "tr AS (SELECT DISTINCT snapshot_date, trader_id, nick FROM pos)") + f"""
SELECT trader_id, snapshot_date, 'binance' AS exchange, tr.nick, {r('roi', 4)} AS roi, {r('aum', 4)} AS aum, mdd, start_time, listed, {r('copier_pnl', 4)} AS copier_pnl, copier_count_total, retired
  FROM tr LEFT JOIN sup USING (snapshot_date, trader_id)
UNION ALL SELECT 'u' || trader_id, snapshot_date, 'phemex', nick, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tr"""
SQL["k2_ingest_sizes"] = _with(POS2, "c AS (SELECT snapshot_date, exchange, count(*) AS p, count(DISTINCT trader_id) AS t FROM pos GROUP BY ALL)",
    "b AS (SELECT * FROM c UNION ALL SELECT snapshot_date, 'phemex', p, t FROM c WHERE snapshot_date = '2002-01-01')") + """
SELECT snapshot_date, exchange, unnest([p, t, 1]) AS n, unnest(['positions', 'trader_snapshot', 'snapshots']) AS stored_table FROM b"""


# Pages decoded by field tables.
_ITEM = """it AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey AS k, CAST(l_suppkey AS VARCHAR) AS t, 'nick' || l_suppkey AS nick, 'P' || (l_partkey % 50) AS sym,
  l_orderkey AS o, l_linenumber AS ln, l_quantity AS qty, l_extendedprice AS px, l_tax AS tax, l_returnflag AS flag, l_linestatus AS st, epoch_ms(l_shipdate) AS ms FROM lineitem)"""
SQL["s13_bybit_open"] = _with(_ITEM) + """SELECT t AS trader_id, nick, sym AS symbol, CASE WHEN st = 'O' THEN 'long' ELSE 'short' END AS side, CASE WHEN st = 'O' THEN 'Buy' ELSE 'Sell' END AS side_raw,
  ln::DOUBLE AS leverage, CASE WHEN ln = 3 THEN 0e0 ELSE px END AS entry_price, qty AS size, qty AS margin, CASE WHEN ln = 4 THEN tax END AS stop_loss, NULL::DOUBLE AS take_profit,
  round(CASE flag WHEN 'A' THEN k % 1000000 WHEN 'R' THEN k % 777777 END / 1e8, 8) AS unrealized_pnl FROM it"""
SQL["s13_bybit_traders"] = f"""SELECT CAST(s_suppkey AS VARCHAR) AS trader_id, s_name AS nick, CAST(s_nationkey AS VARCHAR) AS leader_user_id, {r('(s_suppkey * 137 % 10000) / 1e4')} AS win_rate_7d,
  {r('CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey * 91 % 10000) / 1e4 ELSE 0 END')} AS win_rate_3w, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey::BIGINT END AS locate_days,
  {r('s_acctbal')} AS wallet_balance, NULL::BIGINT AS n_followers FROM supplier"""
SQL["s10_bybit_yields"] = f"SELECT CAST(user_id AS VARCHAR) AS trader_id, event_id AS ts, {r('round(value * 1e4) / 1e4')} AS value FROM events WHERE event_id % 3 <> 0"
SQL["s10_bitget_returns"] = f"SELECT CAST(user_id AS VARCHAR) AS trader_id, event_id AS ts, {r('value * 1e-2')} AS value FROM events WHERE event_id % 4 <> 0 AND event_id % 7 <> 0"
SQL["s14_bitget_open"] = _with(_ITEM) + """SELECT t AS trader_id, CAST(k AS VARCHAR) AS position_key, sym AS symbol_id, CASE WHEN st = 'O' THEN 'long' ELSE 'short' END AS side, ln::DOUBLE AS leverage,
  CASE WHEN ln = 3 THEN 0e0 ELSE px END AS avg_cost, 0e0 AS size, qty AS margin, ms AS opened_ms FROM it WHERE o % 11 <> 0"""
SQL["s14_bitget_cycles"] = """SELECT CAST(s_suppkey AS VARCHAR) AS trader_id, s_name AS nick, CASE WHEN s_suppkey % 3 = 0 THEN 30 ELSE 90 END::BIGINT AS cycle_days, s_acctbal AS aum,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 97 ELSE 0 END::DOUBLE AS max_drawdown, (s_suppkey % 13)::BIGINT AS n_trades, NULL::BIGINT AS n_loss FROM supplier WHERE s_suppkey % 10 <> 0"""
SQL["s14_bitget_details"] = """SELECT CAST(s_suppkey AS VARCHAR) AS trader_id, s_acctbal AS aum, s_suppkey::BIGINT AS followers, 0e0 AS profit_share, (s_suppkey * 3)::DOUBLE AS follow_profit_7d,
  CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 5 ELSE 0 END::DOUBLE AS follow_profit_30d, 0e0 AS follow_profit_90d, 0e0 AS follow_profit_180d, (s_suppkey % 89)::DOUBLE AS mdd, 0e0 AS roi,
  0e0 AS win_rate, s_acctbal AS total_income FROM supplier"""
_KC = """kc AS (SELECT c_custkey AS k, c_name, c_acctbal, list_filter(list_transform(range(0, 60), lambda i: CASE WHEN (c_custkey + i) % 17 <> 0 THEN ((c_custkey * 7919 + i * 104729) % 997 - 300) * (i + 1) END),
  lambda v: v IS NOT NULL) AS s FROM customer)"""
SQL["s15_kucoin_leaders"] = _with(_KC) + """SELECT CAST(k AS VARCHAR) AS trader_id, c_name AS nick, c_acctbal AS principal, CASE WHEN k % 3 <> 0 THEN k % 211 ELSE 0 END::BIGINT AS days_as_leader,
  c_acctbal AS total_pnl, 0e0 AS d7_pnl, CASE WHEN k % 7 <> 0 THEN len(s)::INT END AS n_days FROM kc"""
SQL["s15_kucoin_summaries"] = """SELECT CAST(s_suppkey AS VARCHAR) AS trader_id, CAST(s_suppkey * 2 AS VARCHAR) AS uid, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END::BIGINT AS followers, 0::BIGINT AS following,
  0::BIGINT AS copied_traders, 0::BIGINT AS allowed_copiers, (s_suppkey % 50)::BIGINT AS lead_days, NULL::VARCHAR AS position_visibility, s_suppkey % 3 = 0 AS on_leaderboard FROM supplier WHERE s_suppkey % 9 <> 0"""
SQL["s23_okx_stats"] = f"""SELECT CAST(s_suppkey AS VARCHAR) AS trader_id, {r('s_suppkey % 100 / 1e2')} AS win_ratio, s_nationkey::BIGINT AS profit_days, NULL::BIGINT AS loss_days,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS invest_amount, NULL::DOUBLE AS avg_position_value, NULL::DOUBLE AS copier_pnl FROM supplier WHERE s_suppkey % 8 <> 0"""
SQL["t5_positional_series"] = _with(_KC, "pt AS (SELECT k, unnest(range(1, len(s) + 1)) AS i, len(s) AS n, unnest(s) / c_acctbal * 1e2 AS v FROM kc WHERE k % 7 <> 0 AND c_acctbal > 0)",
    "pk AS (SELECT *, max(v) OVER (PARTITION BY k ORDER BY i) - v AS d FROM pt)", "mx AS (SELECT k, max(d) AS depth FROM pk GROUP BY ALL)") + f"""
SELECT CAST(k AS VARCHAR) AS trader_id, {r('depth', 4)} AS depth, 1009843200000 - (n - min(i)) * 86400000 AS trough_ts FROM pk JOIN mx USING (k) WHERE d = depth GROUP BY k, n, depth"""
SQL["s20_board_pages"] = """WITH o AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey END AS c, ['binance', 'okx', 'bybit', 'bitget', 'kucoin'][o_orderkey % 5 + 1] AS exchange
  FROM orders WHERE (o_orderkey // 20) % 13 <> 0)
SELECT exchange, CAST(c AS VARCHAR) AS trader_id, CASE WHEN exchange IN ('bitget', 'kucoin') THEN min(o) ELSE max(o) END AS kept FROM o WHERE c IS NOT NULL GROUP BY exchange, c"""
SQL["k5_published_report"] = " UNION ALL ".join(f"SELECT '{t}' AS report_table, count(*) AS n FROM ({q})" for t, q in (
    ("roster", SQL["roster"]), ("changes", SQL["r9_snapshot_diff"]), ("removed", SQL["r8_removed"]), ("ages", SQL["r10_portfolio_ages"]), ("exclusions", SQL["r11_notable_exclusions"])))

SQL["e1_persistence_calendar"] = _with(POS, V, calendar("v", "oh"), halves_sql("oh", "pr", 10), *[
    resample_sql(m, f"{m}1", f"{m}2", "hw", 10_000, 2_000) for m in ("wr", "payoff", "exp")]) + " UNION ALL ".join(f"SELECT *, '{m}' AS metric FROM g{m}" for m in ("wr", "payoff", "exp"))
SQL["e3_style_persistence"] = _with(POS, V, OWN.format(t="opened_ms"), halves_sql("oh", "pr", 1), "hk AS (SELECT *, " + ", ".join(
    f"row_number() OVER (ORDER BY {x}, trader_id) AS k_{x}" for m in ("wr", "payoff", "exp") for x in (f"{m}1", f"{m}2")) + " FROM hw WHERE n1 + n2 >= 30)") + "SELECT count(*) AS n, " + ", ".join(
    f"{r(f'coalesce(corr(k_{m}1, k_{m}2), 0)')} AS rho_{m}" for m in ("wr", "payoff", "exp")) + " FROM hk"
SQL["o4_symbol_extremes"] = " UNION ALL ".join(P_ + f"SELECT * FROM (SELECT symbol, count(*) AS n, {r('sum(pnl)', 2)} AS pnl, count(*) FILTER (WHERE pnl > 0) AS wins, {r(share('pnl > 0'))} AS wr, {r('sum(notional)', 2)} AS vol, "
    f"row_number() OVER (ORDER BY sum(pnl) {d}, symbol) AS place, '{e}' AS end_of FROM pos GROUP BY symbol) WHERE place <= {k})" for P_, e, k, d in (("SELECT * FROM (" + P, "best", 12, "DESC"), ("SELECT * FROM (" + P, "worst", 6, "ASC")))
