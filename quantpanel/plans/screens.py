"""Registered queries of patterns, gates, windows and the risk model; registered on import, beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantpanel.operators import gates as gt
from quantpanel.operators import labels as lab
from quantpanel.operators import market as mk
from quantpanel.operators import patterns as pt
from quantpanel.operators import sectors as se
from quantpanel.sources import bars as src

from .catalog import _PANEL, _S, _SCORED, _SECTOR, _avg, _scored, query

_I = f"i0 AS MATERIALIZED (SELECT *, {_avg('close', 20)} AS ma_20, {_avg('close', 60)} AS ma_60, {_avg('volume', 5)} AS v5, {_avg('volume', 20)} AS v20, row_number() OVER ({_S}) AS idx, count(*) OVER (PARTITION BY symbol) AS n_bars FROM bars),"
_TOP = f"""{_I} v0 AS MATERIALIZED (SELECT *, count(*) OVER ({_S} ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING) = 81 AND high >= max(high) OVER ({_S} ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS peak, min(low) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS la, bool_or(low < ma_60) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS broke,
close > open AND high > low AND (close - low) / (high - low) >= 0.6 AND (high - greatest(open, close)) / (high - low) <= 0.35 AND abs(close - open) / (high - low) >= 0.25 AND count(*) OVER ({_S} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) = 90 AND volume > max(volume) OVER ({_S} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS launch FROM i0),
old AS MATERIALIZED (SELECT symbol, idx AS i0, trade_date AS old_high_date, high AS old_high, (high - la) / high AS max_drawdown, n_bars - idx AS days_since_old_high FROM v0 WHERE peak AND broke AND n_bars > 90 AND idx <= n_bars - 60 AND (high - la) / high >= 0.1),
fb AS MATERIALIZED (SELECT o.symbol, o.i0, min(b.idx) AS higher, min(CASE WHEN launch THEN b.idx END) AS breakout FROM old o JOIN (SELECT symbol, idx, high, launch FROM v0) b ON o.symbol = b.symbol AND b.idx > o.i0 AND b.high > o.old_high GROUP BY 1, 2),
ev AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i0 DESC) AS k FROM old LEFT JOIN fb USING (symbol, i0) WHERE higher IS NULL OR higher = breakout),"""


@query(f"{_TOP} --- SELECT e.symbol, old_high_date, old_high, max_drawdown, days_since_old_high, b.trade_date AS breakout_date FROM ev e LEFT JOIN bars_i b ON b.symbol = e.symbol AND b.idx = e.breakout WHERE k = 1".replace("---", "bars_i AS (SELECT symbol, trade_date, idx FROM i0), ---"), "old_high max_drawdown", "symbol old_high_date days_since_old_high breakout_date")
def volume_top(spark, sf_dir):
    """Old highs and breakouts (PT1a-PT1c)."""
    return pt.volume_top(src.bars_of(spark, sf_dir)).select("symbol", "old_high_date", "old_high", "max_drawdown", "days_since_old_high", "breakout_date")


@query(f"""{_TOP} e0 AS (SELECT * FROM ev WHERE k = 1), e1 AS (SELECT e.symbol, b.idx, b.trade_date, b.close, b.high, b.volume, b.ma_20, b.v5, b.v20, e.old_high_date, e.old_high, e.breakout, b.n_bars, first_value(b.close) OVER (PARTITION BY b.symbol ORDER BY b.idx) AS c0, b.close >= b.ma_20 * 0.98 AS ok FROM e0 e JOIN i0 b ON b.symbol = e.symbol AND b.idx >= coalesce(e.breakout, b.n_bars)),
e2 AS (SELECT symbol, old_high_date, any_value(old_high) AS old_high, any_value(breakout) AS breakout, max(trade_date) AS trade_date, arg_max(close, idx) AS close, arg_max(volume, idx) AS volume, arg_max(ma_20, idx) AS ma_20, arg_max(v5, idx) AS v5, arg_max(v20, idx) AS v20, max(idx) - min(idx) AS days, max(high) / any_value(c0) - 1 AS ext, bool_and(ok) AS held FROM e1 GROUP BY 1, 2),
--- SELECT *, CASE WHEN breakout IS NULL AND (old_high - close) / old_high BETWEEN 0 AND 0.05 AND volume / v20 <= 1.5 THEN 'pre_breakout' WHEN breakout IS NOT NULL AND days BETWEEN 1 AND 10 AND ext <= 0.1 AND held AND close > old_high THEN 'breakout' WHEN breakout IS NOT NULL AND days BETWEEN 1 AND 10 AND ext <= 0.1 AND held AND close < old_high AND close >= ma_20 * 0.98 AND volume < v5 THEN 'follow_through' END AS state FROM e2""", "close", "symbol old_high_date trade_date state")
def volume_top_states(spark, sf_dir):
    """Patterns before, at and after the breakout (PT1-PT3)."""
    return pt.volume_top_states(src.bars_of(spark, sf_dir)).select("symbol", "old_high_date", "trade_date", "state", "close")


@query()
def pattern_report(spark, sf_dir):
    """All patterns of the last bars (PT0, PT4, PT6-PT8); the least mean amount fits the supplied volumes."""
    return pt.pattern_report(src.bars_of(spark, sf_dir), least_amount=100.0, keep=src.held)


@query(f"{_I} a0 AS (SELECT *, close / lag(close, 4) OVER ({_S}) - 1 AS rise, {_avg('amount', 20)} AS am FROM i0), --- SELECT symbol FROM a0 WHERE idx > n_bars - 196 GROUP BY symbol HAVING max(n_bars) >= 200 AND max(CASE WHEN idx = n_bars THEN am END) >= 100 AND max(rise) >= 0.1", "", "symbol")
def pattern_eligible(spark, sf_dir):
    """Symbols that the patterns look at (PT0, PT0b, PT0c)."""
    return pt.eligible(src.bars_of(spark, sf_dir), least_amount=100.0)


_RISE = " AND ".join(f"lag({c}, {n}) OVER ({_S}) > 0 AND {c} > lag({c}, {n}) OVER ({_S})" for c in ("ma_20", "ma_60") for n in (1, 10))
_AROUND, _BEFORE = f"OVER ({_S} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)", f"OVER ({_S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(f"""{_I} t0 AS (SELECT *, coalesce(ma_20 > ma_60 AND close > ma_60 AND close > ma_20 AND {_RISE}, false) AS trend, count(*) {_AROUND} = 11 AND count(*) {_BEFORE} = 20 AND high >= max(high) {_AROUND} AND high >= max(high) {_BEFORE} AS top, close >= ma_20 * 1.01 AND (abs(low - ma_20) <= least(0.5, ma_20 * 0.01) OR low < ma_20) AND v5 / v20 <= 0.95 AS touch FROM i0),
t1 AS (SELECT symbol, max(trade_date) AS trade_date, arg_max(trend, idx) AS trend_up, max(CASE WHEN top THEN trade_date END) AS recent_high_date, max(CASE WHEN touch AND idx > n_bars - 2 THEN trade_date END) AS ma20_touch_date FROM t0 WHERE n_bars >= 70 AND idx > n_bars - 10 GROUP BY 1), --- SELECT *, trend_up AND recent_high_date IS NOT NULL AND ma20_touch_date IS NOT NULL AS matched FROM t1""", "", "symbol trade_date trend_up recent_high_date ma20_touch_date matched")
def trend_pullback(spark, sf_dir):
    """Trend pullback and its conditions (PT5)."""
    return pt.trend_pullback(src.bars_of(spark, sf_dir))


_INDEX = f"{_PANEL} ix AS (SELECT *, exp(sum(ln(1 + equal_return)) OVER (ORDER BY trade_date)) AS v FROM mkt),"


def _index(spark, sf_dir):
    return mk.market_index(mk.daily_market(mk.symbol_panel(src.bars_of(spark, sf_dir))))


@query(f"{_INDEX} g0 AS (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN avg(v) OVER w END AS m FROM ix WINDOW w AS (ORDER BY trade_date ROWS 19 PRECEDING)), g1 AS (SELECT *, m / lag(m, 5) OVER (ORDER BY trade_date) - 1 AS slope FROM g0), --- SELECT trade_date, v AS equal_index, slope AS ma20_slope, CASE WHEN v > m AND slope > 0 AND breadth_ma20 >= 0.45 AND limit_down / stock_count <= 0.03 THEN 0 ELSE 1 END AS gate FROM g1", "equal_index ma20_slope", "trade_date gate")
def market_gate(spark, sf_dir):
    """Rule gate of each day (M9)."""
    return gt.market_gate(_index(spark, sf_dir))


@query(f"{_INDEX} t0 AS (SELECT trade_date, ln(v / lag(v) OVER (ORDER BY trade_date)) AS lr FROM ix), t1 AS (SELECT *, CASE WHEN count(lr) OVER w >= 100 THEN quantile_cont(lr, 0.05) OVER w END AS threshold FROM t0 WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)), --- SELECT trade_date, threshold, CASE WHEN threshold IS NOT NULL THEN (lr < threshold)::INT END AS tail_event FROM t1", "threshold", "trade_date tail_event")
def index_tail_events(spark, sf_dir):
    """Tail events of the index."""
    return gt.index_tail_events(_index(spark, sf_dir))


@query("d0 AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM bars)), n0 AS (SELECT count(*) AS n FROM d0), s0 AS (SELECT unnest(range(0, n - 1261 + 1, 250)) AS s FROM n0), --- SELECT 'wf_' || lpad(CAST(s // 250 + 1 AS VARCHAR), 2, '0') AS window_id, a.trade_date AS train_start, b.trade_date AS train_end, c.trade_date AS valid_start, e.trade_date AS valid_end FROM s0 JOIN d0 a ON a.i = s JOIN d0 b ON b.i = s + 999 JOIN d0 c ON c.i = s + 1011 JOIN d0 e ON e.i = s + 1260", "", "window_id train_start train_end valid_start valid_end")
def walk_forward_windows(spark, sf_dir):
    """Walk-forward windows of 1000 and 250 days with an embargo of 11 (V7)."""
    return gt.walk_forward(src.bars_of(spark, sf_dir), 1000, 250, 250, 11)


@query(f"{_SCORED} rr0 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS risk_rank, count(*) OVER (PARTITION BY trade_date) AS n FROM s1), --- SELECT symbol, trade_date, risk_rank, risk_rank / n AS risk_percentile, risk_rank <= greatest(1, ceil(n * 0.2::DOUBLE)) AS excluded FROM rr0", "risk_percentile", "symbol trade_date risk_rank excluded")
def risk_exclusion(spark, sf_dir):
    """Risk ranks and exclusion."""
    return gt.exclude_risk(_scored(spark, sf_dir), "score").drop("score", "outcome")


@query(f"{_SCORED} rr0 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY md5(strftime(trade_date, '%Y-%m-%d') || ':' || symbol), symbol) AS pick FROM s1), {_INDEX} oo AS (SELECT trade_date, avg(outcome) AS outcome FROM rr0 WHERE pick <= 5 GROUP BY 1), f AS (SELECT trade_date, lead(v, 5) OVER (ORDER BY trade_date) / v - 1 AS benchmark FROM ix), --- SELECT trade_date, outcome, benchmark, outcome - benchmark AS excess FROM oo JOIN f USING (trade_date)", "outcome benchmark excess", "trade_date")
def random_excess(spark, sf_dir):
    """A seeded random selection against the market."""
    daily = gt.seeded_top(_scored(spark, sf_dir), 5).groupBy("trade_date").agg(F.avg("outcome").alias("outcome"))
    return gt.benchmark_excess(daily, _index(spark, sf_dir))


_W = "PARTITION BY sector_label ORDER BY trade_date"


def _mean(c: str, n: int, f: str = "avg") -> str:
    return f"CASE WHEN count({c}) OVER ({_W} ROWS {n - 1} PRECEDING) >= {n} THEN {f}({c}) OVER ({_W} ROWS {n - 1} PRECEDING) END"


def _linear(c: str, lo: float, hi: float) -> str:
    return f"coalesce(greatest(0, least(100, ({c} - ({lo})) / ({hi - lo}) * 100)), 50)"


@query(f"""{_SECTOR} x0 AS (SELECT *, exp(sum(ln(1 + ret)) OVER ({_W})) AS v FROM si), x1 AS (SELECT *, 100 * (v / lag(v, 5) OVER ({_W}) - 1) AS return_5d, 100 * (v / lag(v, 20) OVER ({_W}) - 1) AS return_20d, {_mean('v', 5)} AS m5, {_mean('v', 20)} AS m20, {_mean('v', 20, 'min')} AS low20 FROM x0),
x2 AS (SELECT *, 100 * (m5 / lag(m5, 5) OVER ({_W}) - 1) AS ma5_slope_pct, 100 * (m20 / lag(m20, 5) OVER ({_W}) - 1) AS ma20_slope_pct, coalesce(v <= low20 * 1.002, false) AS at_low FROM x1),
x3 AS (SELECT *, bool_or(at_low) OVER ({_W} ROWS 4 PRECEDING) AS new_low_in_5d, v > m20 AS above_ma20, ({_mean('ret', 5, 'stddev_samp')}) / ({_mean('ret', 20, 'stddev_samp')}) AS volatility_ratio, avg((ret > 0)::INT) OVER ({_W} ROWS 2 PRECEDING) AS up_ratio_3d, row_number() OVER (PARTITION BY sector_label ORDER BY trade_date DESC) AS k FROM x2),
pf AS (SELECT sector_label, trade_date, sum(pct_change * amount) / nullif(sum(amount), 0) AS aw, avg((pct_change > 0)::INT) AS up_ratio FROM bars JOIN members USING (symbol) GROUP BY 1, 2),
--- SELECT *, round(0.25 * {_linear('return_5d', -3.0, 8.0)} + 0.25 * {_linear('return_20d', -8.0, 18.0)} + 0.15 * {_linear('ma5_slope_pct', -0.8, 1.2)} + 0.2 * {_linear('aw', -2.0, 5.0)} + 0.15 * {_linear('up_ratio', 0.35, 0.8)}, 2) AS short_score FROM x3 LEFT JOIN pf USING (sector_label, trade_date) WHERE k = 1""", "return_5d return_20d ma5_slope_pct ma20_slope_pct volatility_ratio up_ratio_3d short_score", "sector_label trade_date new_low_in_5d above_ma20")
def sector_technicals(spark, sf_dir):
    """Technical state of each sector."""
    days = se.sector_days(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir))
    return gt.sector_technicals(se.sector_index(days), days)


@query(f"rr0 AS (SELECT *, round(coalesce(pct_change / 100, close / lag(close) OVER ({_S}) - 1), 6) AS daily_return, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM bars), --- SELECT symbol, trade_date, daily_return FROM rr0 WHERE k = 1", "daily_return", "symbol trade_date")
def daily_returns(spark, sf_dir):
    """Daily-return table of the last bars."""
    return gt.limit_days(src.bars_of(spark, sf_dir))


@query()
def tail_risk_scores(spark, sf_dir):
    """Fitted tail risk of the last bar of each symbol (V1, V5)."""
    features = ["log_return", "return_5d", "return_60d", "vol_20", "range_pct"]
    bars = src.bars_of(spark, sf_dir)
    panel = lab.base_features(bars).select("symbol", "trade_date", *features)
    labels = lab.tail_risk(bars).select("symbol", "trade_date", "risk_label")
    model = gt.tail_risk_model(panel.join(labels, ["symbol", "trade_date"]), features, "risk_label")
    return gt.score_last(model, panel, features)
