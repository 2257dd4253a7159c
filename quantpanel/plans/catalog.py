"""The registered queries over the supplied tables, and SQL that gives the same rows.

Doubles are rounded to 6 digits in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.operators import backtest as bt
from quantpanel.operators import indicators as ind
from quantpanel.operators import labels as lab
from quantpanel.operators import leaders as ld
from quantpanel.operators import market as mk
from quantpanel.operators import quality as ql
from quantpanel.operators import scores as sc
from quantpanel.operators import sectors as se
from quantpanel.sources import bars as src
from quantpanel.streaming import quotes as qs

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

_BARS = """d AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS trade_date, avg(l_extendedprice) AS e, max(l_tax) AS tx, max(l_discount) AS ds, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
r0 AS (SELECT *, 0.1 * (e / avg(e) OVER (PARTITION BY symbol) - 1) AS r FROM d),
c0 AS (SELECT *, round(10 * exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY trade_date)), 4) AS close FROM r0),
o0 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), close) AS open FROM c0),
bars AS (SELECT symbol, trade_date, open, close, round(greatest(open, close) * (1 + tx / 4) + 0.0000001::DOUBLE, 4) AS high, round(least(open, close) * (1 - ds / 4) + 0.0000001::DOUBLE, 4) AS low, volume, volume * close AS amount, 100 * r AS pct_change FROM o0),
members AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, 'industry' AS sector_type, r_name AS sector_label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_S = "PARTITION BY symbol ORDER BY trade_date"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = "", plain: str = "", recursive: bool = False):
    """Register a query; sql is what follows WITH, its double and other columns are listed."""

    def keep(f):
        def declared(spark, sf_dir):
            src.release()
            return _rounded(f(spark, sf_dir))

        _QUERIES[f.__name__] = declared
        _QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            columns = [*plain.split(), *[f"round({c}, 6) AS {c}" for c in doubles.split()]]
            ctes, _, last = sql.rpartition("---")
            _SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{_BARS}{', ' + ctes.strip().rstrip(',') if ctes.strip() else ''} SELECT {', '.join(columns)} FROM ({last.strip()}) q"
        return f

    return keep


def _avg(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER ({_S} ROWS {n - 1} PRECEDING) >= {n} THEN avg({c}) OVER ({_S} ROWS {n - 1} PRECEDING) END"


_MOVING = f"m1 AS (SELECT *, {_avg('close', 20)} AS ma_20, {_avg('close', 60)} AS ma_60, {_avg('volume', 20)} AS volume_ma_20, close / lag(close) OVER ({_S}) - 1 AS return_1d, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM bars),"


@query(f"{_MOVING} --- SELECT symbol, trade_date, close, ma_20, close / ma_20 - 1 AS distance_to_ma20, volume / volume_ma_20 AS volume_ratio_20 FROM m1 WHERE n = 1", "close ma_20 distance_to_ma20 volume_ratio_20", "symbol trade_date")
def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last bar of each symbol with its distance to the mean (PT0, I1, I4)."""
    return ind.last_rows(ind.add_moving(src.bars_of(spark, sf_dir))).select("symbol", "trade_date", "close", "ma_20", "distance_to_ma20", "volume_ratio_20")


@query("--- SELECT * FROM bars", "open close high low volume amount pct_change", "symbol trade_date")
def bars_source(spark, sf_dir):
    """Derived bars."""
    return src.bars_of(spark, sf_dir)


@query(f"{_MOVING} --- SELECT symbol, trade_date, ma_20, ma_60, return_1d, CASE WHEN count(return_1d) OVER ({_S} ROWS 9 PRECEDING) >= 10 THEN stddev_samp(return_1d) OVER ({_S} ROWS 9 PRECEDING) * sqrt(10) END AS volatility_10d, CASE WHEN count(close) OVER ({_S} ROWS 9 PRECEDING) >= 10 THEN close / max(close) OVER ({_S} ROWS 9 PRECEDING) - 1 END AS drawdown_10d FROM m1", "ma_20 ma_60 return_1d volatility_10d drawdown_10d", "symbol trade_date")
def indicators_moving(spark, sf_dir):
    """Moving indicators of every bar."""
    return ind.add_moving(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", "ma_20", "ma_60", "return_1d", "volatility_10d", "drawdown_10d")


@query(f"p AS (SELECT *, lag(close) OVER ({_S}) AS pc FROM bars), --- SELECT symbol, trade_date, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range FROM p", "true_range", "symbol trade_date")
def true_range(spark, sf_dir):
    """True range."""
    return src.bars_of(spark, sf_dir).select("symbol", "trade_date", ind.true_range().alias("true_range"))


_EMA = f"""b1 AS MATERIALIZED (SELECT symbol, trade_date, close, volume, high, low, row_number() OVER ({_S}) AS i, greatest(high - low, abs(high - lag(close) OVER ({_S})), abs(low - lag(close) OVER ({_S}))) AS tr FROM bars),
em AS (SELECT symbol, i, close AS fast, close AS slow, NULL::DOUBLE AS dea, tr AS atr FROM b1 WHERE i = 1
UNION ALL SELECT b.symbol, b.i, 2.0::DOUBLE / 13 * b.close + 11.0::DOUBLE / 13 * e.fast, 2.0::DOUBLE / 27 * b.close + 25.0::DOUBLE / 27 * e.slow,
CASE WHEN b.i < 26 THEN NULL ELSE coalesce(0.8::DOUBLE * e.dea, 0) + CASE WHEN e.dea IS NULL THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END * ((2.0::DOUBLE / 13 * b.close + 11.0::DOUBLE / 13 * e.fast) - (2.0::DOUBLE / 27 * b.close + 25.0::DOUBLE / 27 * e.slow)) END,
CASE WHEN b.i < 14 THEN e.atr + b.tr WHEN b.i = 14 THEN (e.atr + b.tr) / 14 ELSE (e.atr * 13 + b.tr) / 14 END FROM em e JOIN b1 b ON b.symbol = e.symbol AND b.i = e.i + 1),
ind AS (SELECT b1.*, CASE WHEN i >= 26 THEN fast - slow END AS dif, CASE WHEN i >= 34 THEN dea END AS dea, CASE WHEN i >= 14 THEN atr END AS atr, count(*) OVER (PARTITION BY symbol) AS n FROM b1 JOIN em USING (symbol, i)),"""


@query(f"{_EMA} --- SELECT symbol, trade_date, close, dif AS macd_dif, dea AS macd_dea, 2 * (dif - dea) AS macd_hist, atr AS atr_14, atr / close AS atr_pct_14, CASE WHEN atr / close < 0.03 THEN 'low' WHEN atr / close < 0.06 THEN 'medium' WHEN atr IS NOT NULL THEN 'high' END AS atr_regime, close - 2 * atr AS atr_stop_2, close + 2 * atr AS atr_take_2, round(100 * least(0.4::DOUBLE, 0.02::DOUBLE / (1.7::DOUBLE * atr / close)), 2) AS position_percent FROM ind WHERE i = n", "close macd_dif macd_dea macd_hist atr_14 atr_pct_14 atr_stop_2 atr_take_2 position_percent", "symbol trade_date atr_regime", True)
def atr_snapshot(spark, sf_dir):
    """MACD, ATR14, levels, regime and position of the last bar."""
    df = ind.last_rows(ind.add_recurrences(src.bars_of(spark, sf_dir)))
    return df.withColumn("position_percent", ind.position_percent(F.col("atr_pct_14"))).select("symbol", "trade_date", "close", "macd_dif", "macd_dea", "macd_hist", "atr_14", "atr_pct_14", "atr_regime", "atr_stop_2", "atr_take_2", "position_percent")


def _pivots(price: str, word: str, up: str, down: str) -> str:
    before, after = (f"{word}({price}) OVER ({_S} ROWS BETWEEN {x})" for x in ("2 PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND 2 FOLLOWING"))
    return f"p_{price} AS (SELECT symbol, i, n, dif, {price} AS v, lead(trade_date, 2) OVER ({_S}) AS confirm_date, {price} {up} {before} AND {price} {up} {after} AND i > 2 AND i < n - 1 AS turn FROM ind), s_{price} AS (SELECT symbol, max(confirm_date) AS d FROM (SELECT *, lag(v) OVER (PARTITION BY symbol ORDER BY i) AS v0, lag(dif) OVER (PARTITION BY symbol ORDER BY i) AS d0 FROM p_{price} WHERE turn) x WHERE v {up} v0 AND dif {down} d0 AND i + 2 > n - 15 GROUP BY symbol),"


@query(f"""{_EMA} {_pivots('high', 'max', '>', '<')} {_pivots('low', 'min', '<', '>')} x0 AS (SELECT *, dif - dea AS u, lag(dif - dea) OVER ({_S}) AS u0, lag(close, 5) OVER ({_S}) AS c0, {_avg('volume', 5)} AS v5 FROM ind), x1 AS (SELECT *, lag(v5, 5) OVER ({_S}) AS v0 FROM x0),
x2 AS (SELECT symbol, coalesce(bool_or(u0 <= 0 AND u > 0), false) AS g, coalesce(bool_or(u0 >= 0 AND u < 0), false) AS d, max(CASE WHEN i = n THEN u END) AS u, max(CASE WHEN i = n THEN CASE WHEN close > c0 AND v5 < 0.9 * v0 THEN 'price_up_volume_down' WHEN close < c0 AND v5 > 1.1 * v0 THEN 'price_down_volume_up' ELSE 'none' END END) AS divergence FROM x1 WHERE i > n - 3 GROUP BY symbol),
--- SELECT symbol, CASE WHEN g THEN 'golden_cross' WHEN x2.d THEN 'dead_cross' WHEN u > 0 THEN 'above_signal' WHEN u <= 0 THEN 'below_signal' END AS macd_state, h.d AS top, l.d AS bottom, divergence FROM x2 LEFT JOIN s_high h USING (symbol) LEFT JOIN s_low l USING (symbol)""", "", "symbol macd_state top bottom divergence", True)
def macd_state(spark, sf_dir):
    """MACD cross state, divergences and volume-price divergence."""
    bars = src.bars_of(spark, sf_dir)
    df = ind.add_recurrences(bars)
    div = ind.divergences(df).groupBy("symbol").pivot("kind", ["top", "bottom"]).agg(F.max("signal_date"))
    return ind.cross_state(df).join(div, "symbol", "left").join(ind.volume_price_divergence(bars).select("symbol", "divergence"), "symbol", "left")


@query(f"v AS (SELECT *, lag(close, 5) OVER ({_S}) AS c0, {_avg('volume', 5)} AS v5 FROM bars), w AS (SELECT *, lag(v5, 5) OVER ({_S}) AS v0, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM v), --- SELECT symbol, trade_date, CASE WHEN close > c0 AND v5 < 0.9 * v0 THEN 'price_up_volume_down' WHEN close < c0 AND v5 > 1.1 * v0 THEN 'price_down_volume_up' ELSE 'none' END AS divergence FROM w WHERE n = 1", "", "symbol trade_date divergence")
def volume_price(spark, sf_dir):
    """Volume-price divergence."""
    return ind.volume_price_divergence(src.bars_of(spark, sf_dir))


@query(f"x AS (SELECT *, close / lag(close) OVER ({_S}) - 1 AS r, high - low <= 0.0005 * close AS locked FROM bars), --- SELECT symbol, min(trade_date) AS first_date, max(trade_date) AS last_date, count(DISTINCT trade_date) AS trading_days, count(*) FILTER (volume = 0) AS zero_volume_days, sum(CASE WHEN locked AND r >= 0.095 THEN 1 ELSE 0 END)::BIGINT AS locked_up, sum(CASE WHEN locked AND r <= -0.095 THEN 1 ELSE 0 END)::BIGINT AS locked_down, count(DISTINCT trade_date) >= 120 AS eligible FROM x GROUP BY symbol", "", "symbol first_date last_date trading_days zero_volume_days locked_up locked_down eligible")
def audit(spark, sf_dir):
    """Audit of each symbol (Q1, Q2)."""
    return ql.audit(src.bars_of(spark, sf_dir)).select("symbol", "first_date", "last_date", "trading_days", "zero_volume_days", "locked_up", "locked_down", "eligible")


@query("a AS (SELECT symbol, count(DISTINCT trade_date) AS n FROM bars GROUP BY symbol), --- SELECT count(*) AS symbols, sum(n)::BIGINT AS rows, min(n) AS min_days, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_days, max(n) AS max_days, sum(CASE WHEN n >= 120 THEN 1 ELSE 0 END)::BIGINT AS eligible FROM a", "median_days", "symbols rows min_days max_days eligible")
def audit_summary(spark, sf_dir):
    """Audit totals (Q3)."""
    return ql.audit_summary(ql.audit(src.bars_of(spark, sf_dir)))


@query(f"x AS (SELECT *, ln(close / lag(close) OVER ({_S})) AS lr FROM bars), y AS (SELECT *, CASE WHEN count(lr) OVER ({_S} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) >= 100 THEN quantile_cont(lr, 0.05) OVER ({_S} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) END AS th FROM x), z AS (SELECT *, CASE WHEN lr < th THEN 1 ELSE 0 END AS tail_event FROM y), --- SELECT symbol, trade_date, th AS threshold, tail_event, lead(tail_event) OVER ({_S}) AS risk_label FROM z", "threshold", "symbol trade_date tail_event risk_label")
def tail_risk(spark, sf_dir):
    """Tail events and labels (L2)."""
    return lab.tail_risk(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", "threshold", "tail_event", "risk_label")


@query(f"x AS (SELECT *, ln(close / lag(close) OVER ({_S})) AS lr FROM bars), --- SELECT symbol, trade_date, lr AS log_return, close / lag(close, 5) OVER ({_S}) - 1 AS return_5d, close / lag(close, 60) OVER ({_S}) - 1 AS return_60d, CASE WHEN count(lr) OVER ({_S} ROWS 19 PRECEDING) >= 20 THEN stddev_samp(lr) OVER ({_S} ROWS 19 PRECEDING) END AS vol_20, (high - low) / close AS range_pct, lead(close, 5) OVER ({_S}) / close - 1 AS future_return_5d, min(close) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / close - 1 AS future_min_return_5d FROM x", "log_return return_5d return_60d vol_20 range_pct future_return_5d future_min_return_5d", "symbol trade_date")
def base_features(spark, sf_dir):
    """Base features and outcomes (L1)."""
    return lab.base_features(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", "log_return", "return_5d", "return_60d", "vol_20", "range_pct", "future_return_5d", "future_min_return_5d")


_BARRIER = f"""x AS (SELECT *, lag(close) OVER ({_S}) AS pc, row_number() OVER ({_S}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM x),
a AS (SELECT *, {_avg('tr', 14)} AS atr, lead(open) OVER ({_S}) AS entry FROM t), e AS (SELECT symbol, trade_date, i, n, entry, entry - atr AS stop, entry + 2 * atr AS take FROM a WHERE entry > 0 AND atr > 0),
f AS (SELECT e.symbol, e.trade_date, e.entry, e.stop, e.take, least(e.i + 20, e.n) AS last, min(CASE WHEN b.low <= stop THEN b.i END) AS d, min(CASE WHEN b.high >= take THEN b.i END) AS u, min(b.low) / e.entry - 1 AS worst FROM e JOIN x b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 1 AND e.i + 20 GROUP BY e.symbol, e.trade_date, e.entry, e.stop, e.take, e.i, e.n),
g AS (SELECT symbol, trade_date, entry, worst, coalesce(least(d, u), last) AS at, CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN 'down_first' WHEN u IS NOT NULL THEN 'up_first' ELSE 'timeout' END AS barrier_outcome, stop, take FROM f),"""


_TOUCH = "CASE barrier_outcome WHEN 'down_first' THEN stop WHEN 'up_first' THEN take ELSE x.close END"


@query(f"{_BARRIER} --- SELECT g.symbol, g.trade_date, barrier_outcome, CASE WHEN barrier_outcome = 'down_first' THEN 1 ELSE 0 END AS risk_label, x.trade_date AS exit_date, {_TOUCH} AS exit_price, {_TOUCH} / entry - 1 AS barrier_return, worst AS barrier_max_drawdown FROM g JOIN x ON x.symbol = g.symbol AND x.i = g.at", "exit_price barrier_return barrier_max_drawdown", "symbol trade_date barrier_outcome risk_label exit_date")
def triple_barrier(spark, sf_dir):
    """Barrier labels with exits (L4)."""
    return lab.triple_barrier(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", "barrier_outcome", "risk_label", "exit_date", "exit_price", "barrier_return", "barrier_max_drawdown")


@query(f"{_BARRIER} h AS (SELECT barrier_outcome AS o, CASE WHEN barrier_outcome = 'down_first' THEN 1 ELSE 0 END AS l FROM g), --- SELECT o AS barrier_outcome, count(*) AS n_rows, avg(l) AS label_rate FROM h GROUP BY o UNION ALL SELECT 'ALL', count(*), avg(l) FROM h", "label_rate", "barrier_outcome n_rows")
def barrier_distribution(spark, sf_dir):
    """Label distribution with its total."""
    return lab.label_distribution(lab.triple_barrier(src.bars_of(spark, sf_dir)))


_K = "99.0::DOUBLE / 101"
_CUSUM = f"""c1 AS MATERIALIZED (SELECT symbol, trade_date, close, low, row_number() OVER ({_S}) AS i, ln(close / lag(close) OVER ({_S})) AS r FROM bars),
ew AS (SELECT symbol, i, 1.0::DOUBLE AS w, 1.0::DOUBLE AS q, r AS m, 0.0::DOUBLE AS s FROM c1 WHERE i = 2
UNION ALL SELECT c.symbol, c.i, {_K} * w + 1, ({_K}) * ({_K}) * q + 1, m + (r - m) / ({_K} * w + 1), {_K} * s + {_K} * w / ({_K} * w + 1) * (r - m) * (r - m) FROM ew e JOIN c1 c ON c.symbol = e.symbol AND c.i = e.i + 1),
vo AS (SELECT symbol, i, CASE WHEN i > 100 THEN sqrt(s / w * (w * w) / (w * w - q)) END AS vol FROM ew), th AS (SELECT symbol, avg(vol) AS h FROM vo GROUP BY 1 HAVING avg(vol) > 0),
c2 AS MATERIALIZED (SELECT c1.symbol, i, r, h FROM c1 JOIN th USING (symbol) WHERE i > 1),
cu AS (SELECT symbol, 1::BIGINT AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS hit FROM th
UNION ALL SELECT c.symbol, c.i, CASE WHEN NOT least(0, dn + r) < -h AND greatest(0, up + r) > h THEN 0 ELSE greatest(0, up + r) END, CASE WHEN least(0, dn + r) < -h THEN 0 ELSE least(0, dn + r) END, least(0, dn + r) < -h OR greatest(0, up + r) > h FROM cu u JOIN c2 c ON c.symbol = u.symbol AND c.i = u.i + 1),
ce AS (SELECT c1.*, vol, h FROM cu JOIN c1 USING (symbol, i) JOIN th USING (symbol) LEFT JOIN vo USING (symbol, i) WHERE hit),"""


@query(f"{_CUSUM} --- SELECT symbol, trade_date AS event_date, vol, h AS threshold FROM ce", "vol threshold", "symbol event_date", True)
def cusum_events(spark, sf_dir):
    """CUSUM events, deviation and threshold."""
    return lab.cusum_events(src.bars_of(spark, sf_dir))


@query(f"{_CUSUM} k0 AS (SELECT *, max(i) OVER (PARTITION BY symbol) AS n FROM c1), k1 AS (SELECT e.symbol, e.trade_date, e.close AS entry, e.vol, least(e.i + 20, max(k.i)) AS last, min(CASE WHEN k.close / e.close - 1 <= -e.vol THEN k.i END) AS d, min(CASE WHEN k.close / e.close - 1 >= e.vol THEN k.i END) AS u, min(k.low) / e.close - 1 AS worst FROM ce e JOIN k0 k ON k.symbol = e.symbol AND k.i BETWEEN e.i + 1 AND e.i + 20 WHERE e.vol >= 0.005 GROUP BY e.symbol, e.trade_date, e.close, e.vol, e.i), --- SELECT k1.symbol, k1.trade_date, CASE WHEN d IS NULL AND u IS NULL THEN 'vertical' WHEN u IS NULL OR d < u THEN 'down_first' ELSE 'up_first' END AS barrier_outcome, c1.trade_date AS exit_date, c1.close / entry - 1 AS barrier_return, worst AS barrier_max_drawdown FROM k1 JOIN c1 ON c1.symbol = k1.symbol AND c1.i = coalesce(least(d, u), last)", "barrier_return barrier_max_drawdown", "symbol trade_date barrier_outcome exit_date", True)
def event_barrier(spark, sf_dir):
    """Barriers of a deviation after CUSUM events."""
    bars = src.bars_of(spark, sf_dir)
    return lab.event_barrier(bars, lab.cusum_events(bars)).select("symbol", "trade_date", "barrier_outcome", "exit_date", "barrier_return", "barrier_max_drawdown")


_CANDLES = {"KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / nullif(high - low, 0)", "KUP": "(high - greatest(open, close)) / open", "KUP2": "(high - greatest(open, close)) / nullif(high - low, 0)", "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / nullif(high - low, 0)", "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / nullif(high - low, 0)", "OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close", "VWAP0": "amount / volume / close"}


@query(f"--- SELECT symbol, trade_date, {', '.join(f'{v} AS {k}' for k, v in _CANDLES.items())} FROM bars", " ".join(_CANDLES), "symbol trade_date")
def alpha_candles(spark, sf_dir):
    """All candle features of every bar."""
    return lab.candle_features(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", *_CANDLES)


def _windowed(n: int) -> dict[str, str]:
    """SQL of the rolling features of n bars, over a0."""
    w, e = f"OVER ({_S} ROWS {n - 1} PRECEDING)", "1e-12::DOUBLE"
    fit = lambda f: f"CASE WHEN i >= 2 THEN regr_{f}(close, i) {w} END"
    known = lambda x: f"nullif({x}, 'nan'::DOUBLE)"
    top, low = f"list_position(list(high) {w}, max(high) {w})", f"list_position(list(low) {w}, min(low) {w})"
    share = lambda a, b: f"(sum({a}) {w}) / ((sum({b}) {w}) + {e})"
    return {
        f"ROC{n}": f"lag(close, {n}) OVER ({_S}) / close", f"MA{n}": f"avg(close) {w} / close", f"STD{n}": f"stddev_samp(close) {w} / close", f"MAX{n}": f"max(high) {w} / close", f"MIN{n}": f"min(low) {w} / close", f"QTLU{n}": f"quantile_cont(close, 0.8) {w} / close", f"QTLD{n}": f"quantile_cont(close, 0.2) {w} / close",
        f"RSV{n}": f"(close - min(low) {w}) / (max(high) {w} - min(low) {w} + {e})", f"RANK{n}": f"(len(list_filter(list(close) {w}, lambda x: x < close)) + (len(list_filter(list(close) {w}, lambda x: x = close)) + 1) / 2.0::DOUBLE) / (count(*) {w})",
        f"BETA{n}": f"({fit('slope')}) / close", f"RSQR{n}": known(fit("r2")), f"RESI{n}": f"(close - ({fit('intercept')}) - ({fit('slope')}) * i) / close", f"IMAX{n}": f"{top} / {n}::DOUBLE", f"IMIN{n}": f"{low} / {n}::DOUBLE", f"IMXD{n}": f"({top} - {low}) / {n}::DOUBLE",
        f"CORR{n}": known(f"corr(close, lv) {w}"), f"CORD{n}": known(f"corr(r, vr) {w}"), f"CNTP{n}": f"avg(coalesce(dc > 0, false)::INT) {w}", f"CNTN{n}": f"avg(coalesce(dc < 0, false)::INT) {w}", f"CNTD{n}": f"avg(coalesce(dc > 0, false)::INT) {w} - avg(coalesce(dc < 0, false)::INT) {w}",
        f"SUMP{n}": share("CASE WHEN dc > 0 THEN dc ELSE dc * 0 END", "abs(dc)"), f"SUMN{n}": share("CASE WHEN dc < 0 THEN -dc ELSE dc * 0 END", "abs(dc)"), f"SUMD{n}": share("dc", "abs(dc)"),
        f"VMA{n}": f"avg(volume) {w} / (volume + {e})", f"VSTD{n}": f"stddev_samp(volume) {w} / (volume + {e})", f"WVMA{n}": f"stddev_samp(abs(r - 1) * volume) {w} / (avg(abs(r - 1) * volume) {w} + {e})",
        f"VSUMP{n}": share("CASE WHEN dv > 0 THEN dv ELSE dv * 0 END", "abs(dv)"), f"VSUMN{n}": share("CASE WHEN dv < 0 THEN -dv ELSE dv * 0 END", "abs(dv)"), f"VSUMD{n}": share("dv", "abs(dv)"),
    }


_ALPHA = _CANDLES | {k: v for n in (5, 10, 20, 30, 60) for k, v in _windowed(n).items()}
_A0 = f"a0 AS (SELECT *, row_number() OVER ({_S})::DOUBLE AS i, close / lag(close) OVER ({_S}) AS r, ln(volume / lag(volume) OVER ({_S}) + 1) AS vr, ln(1 + volume) AS lv, close - lag(close) OVER ({_S}) AS dc, volume - lag(volume) OVER ({_S}) AS dv FROM bars),"


@query(f"{_A0} --- SELECT symbol, trade_date, {', '.join(f'{v} AS {k}' for k, v in _windowed(20).items())} FROM a0", " ".join(_windowed(20)), "symbol trade_date")
def alpha_windows(spark, sf_dir):
    """All rolling features of 20 bars of every bar."""
    return lab.window_features(src.bars_of(spark, sf_dir), (20,)).select("symbol", "trade_date", *_windowed(20))


@query(f"{_A0} a1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM a0), a2 AS (SELECT symbol, trade_date, k, {', '.join(f'{v} AS {k}' for k, v in _ALPHA.items())} FROM a1), --- SELECT * FROM a2 WHERE k = 1", " ".join(_ALPHA), "symbol trade_date")
def alpha158(spark, sf_dir):
    """All 158 features of the last bar."""
    return lab.latest_alpha(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", *_ALPHA)


@query(f"x AS (SELECT *, lead(close, 2) OVER ({_S}) / lead(close) OVER ({_S}) - 1 AS label_raw FROM bars), --- SELECT symbol, trade_date, label_raw, (label_raw - avg(label_raw) OVER (PARTITION BY trade_date)) / CASE WHEN stddev_samp(label_raw) OVER (PARTITION BY trade_date) > 1e-12 THEN stddev_samp(label_raw) OVER (PARTITION BY trade_date) END AS label FROM x", "label_raw label", "symbol trade_date")
def return_label(spark, sf_dir):
    """Return label and its z-score."""
    return lab.return_label(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", "label_raw", "label")


_RISE3 = f"greatest(lead(high) OVER ({_S}) / close, lead(high, 2) OVER ({_S}) / lead(close) OVER ({_S}), lead(high, 3) OVER ({_S}) / lead(close, 2) OVER ({_S})) - 1"


@query(f"x AS (SELECT *, high / lag(close) OVER ({_S}) - 1 AS today, {_RISE3} AS rise, lead(close, 3) OVER ({_S}) / close - 1 AS f FROM bars), y AS (SELECT *, (rise > 0.099)::INT AS hit, (f < -0.05)::INT AS down FROM x WHERE f IS NOT NULL AND NOT coalesce(today > 0.099, false)), --- SELECT symbol, trade_date, hit, down, hit * down AS trap, hit - 1.2::DOUBLE * down - 1.5::DOUBLE * hit * down AS target, f AS future_return_3d FROM y", "target future_return_3d", "symbol trade_date hit down trap")
def limit_up(spark, sf_dir):
    """Three-day limit-up labels."""
    return lab.limit_up_3d(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", "hit", "down", "trap", "target", "future_return_3d")


_WEEK = "w0 AS (SELECT symbol, CAST(trade_date + CAST((12 - isodow(trade_date)) % 7 AS INTEGER) AS DATE) AS week_end, arg_max(close, trade_date) AS close FROM bars GROUP BY 1, 2), w1 AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY week_end) - 1 AS weekly_return FROM w0),"


@query(f"{_WEEK} --- SELECT * FROM w1", "close weekly_return", "symbol week_end")
def weekly_returns(spark, sf_dir):
    """Weekly closes and returns."""
    return lab.weekly_returns(src.bars_of(spark, sf_dir))


_CRASH = f"""{_WEEK} f0 AS (SELECT *, avg(weekly_return) OVER (PARTITION BY week_end) AS mk FROM w1 WHERE weekly_return IS NOT NULL), f1 AS (SELECT symbol, regr_slope(weekly_return, mk) AS b, regr_intercept(weekly_return, mk) AS a, count(*) AS n FROM f0 GROUP BY 1),
f2 AS (SELECT symbol, year(week_end)::INT AS year, CASE WHEN n >= 20 THEN coalesce(weekly_return - a - b * mk, weekly_return) ELSE weekly_return END AS x FROM f0 JOIN f1 USING (symbol)),
f3 AS (SELECT *, count(x) OVER y AS n, avg(x) OVER y AS m, stddev_samp(x) OVER y AS sd FROM f2 WINDOW y AS (PARTITION BY symbol, year)),
cm AS (SELECT symbol, year, n, max((x < m - 3.2::DOUBLE * sd)::INT) AS crash, sum((x < m - 3.2::DOUBLE * sd)::INT)::BIGINT AS crash_count, -(n * (n - 1)::DOUBLE ** 1.5 * sum(x * x * x)) / ((n - 1) * (n - 2) * sum(x * x) ** 1.5) AS ncskew, ln((sum(CASE WHEN x < m THEN x * x END) / (sum((x < m)::INT) - 1)) / (sum(CASE WHEN x >= m THEN x * x END) / (sum((x >= m)::INT) - 1))) AS duvol, avg(x) AS ret, any_value(sd) AS sigma, min(x) AS min_ret FROM f3 WHERE n >= 26 GROUP BY symbol, year, n),"""


def _crash(spark, sf_dir):
    return lab.crash_measures(lab.firm_returns(lab.weekly_returns(src.bars_of(spark, sf_dir))))


@query(f"{_CRASH} --- SELECT * FROM cm", "ncskew duvol ret sigma min_ret", "symbol year n crash crash_count")
def crash_measures(spark, sf_dir):
    """Annual crash measures of residual weekly returns."""
    return _crash(spark, sf_dir)


_OUTLIER = f"""{_CRASH} n0 AS (SELECT *, ncskew IS NOT NULL AND duvol IS NOT NULL AND min_ret IS NOT NULL AS whole FROM cm), n1 AS (SELECT year, count(*) AS k, median(ncskew) AS m1, median(duvol) AS m2, median(min_ret) AS m3, stddev_samp(ncskew) AS d1, stddev_samp(duvol) AS d2, stddev_samp(min_ret) AS d3 FROM n0 WHERE whole GROUP BY 1),
n2 AS (SELECT year, median(abs(ncskew - m1)) AS a1, median(abs(duvol - m2)) AS a2, median(abs(min_ret - m3)) AS a3 FROM n0 JOIN n1 USING (year) WHERE whole GROUP BY 1),
no AS (SELECT cm.*, coalesce(whole AND k >= 10 AND ((n0.ncskew - m1) / coalesce(nullif(a1, 0), d1)) ** 2 + ((n0.duvol - m2) / coalesce(nullif(a2, 0), d2)) ** 2 + ((n0.min_ret - m3) / coalesce(nullif(a3, 0), d3)) ** 2 > 9.348403604496145 AND (n0.min_ret < m3 OR n0.ncskew > m1), false)::INT AS negoutlier FROM n0 JOIN cm USING (symbol, year) LEFT JOIN n1 USING (year) LEFT JOIN n2 USING (year)),"""


@query(f"{_OUTLIER} --- SELECT symbol, year, negoutlier FROM no", "", "symbol year negoutlier")
def negative_outliers(spark, sf_dir):
    """Negative outliers of the annual measures."""
    return lab.negative_outliers(_crash(spark, sf_dir)).select("symbol", "year", "negoutlier")


@query(f"{_OUTLIER} --- SELECT CASE WHEN grouping(year) = 1 THEN 'all' ELSE year::VARCHAR END AS year, count(*) AS firm_years, avg(negoutlier) AS negoutlier_rate, avg(crash) AS crash_rate, avg(crash_count) AS crash_count_mean, avg(ncskew) AS ncskew_mean, avg(duvol) AS duvol_mean, avg(ret) AS ret_mean, avg(sigma) AS sigma_mean, avg(min_ret) AS min_ret_mean FROM no GROUP BY ROLLUP (no.year)", "negoutlier_rate crash_rate crash_count_mean ncskew_mean duvol_mean ret_mean sigma_mean min_ret_mean", "year firm_years")
def crash_distribution(spark, sf_dir):
    """Annual measures by year and in all."""
    return lab.crash_distribution(lab.negative_outliers(_crash(spark, sf_dir)))


@query(f"{_OUTLIER} --- " + " UNION ALL ".join(f"SELECT '{a}' AS measure_left, '{b}' AS measure_right, nullif(corr({a}, {b}), 'nan'::DOUBLE) AS correlation FROM no" for a in lab.CRASH_MEASURES for b in lab.CRASH_MEASURES), "correlation", "measure_left measure_right")
def crash_correlation(spark, sf_dir):
    """Correlations of the annual measures."""
    return lab.crash_correlation(lab.negative_outliers(_crash(spark, sf_dir)))


_PANEL = f"p0 AS (SELECT *, close / lag(close) OVER ({_S}) - 1 AS daily_return, lag(amount) OVER ({_S}) AS am, abs(high - low) <= 0.0005 * close AS locked, {_avg('close', 20)} AS m20, {_avg('close', 60)} AS m60 FROM bars), panel AS (SELECT trade_date, symbol, daily_return, am AS amount, coalesce(close > m20, false)::INT AS above_ma20, coalesce(close > m60, false)::INT AS above_ma60, (locked AND daily_return >= 0.095)::INT AS up, (locked AND daily_return <= -0.095)::INT AS dn FROM p0 WHERE daily_return BETWEEN -0.5 AND 1), mkt AS (SELECT trade_date, count(DISTINCT symbol) AS stock_count, avg(daily_return) AS equal_return, quantile_cont(daily_return, 0.5) AS median_return, coalesce(sum(daily_return * amount) / nullif(sum(amount), 0), avg(daily_return)) AS amount_return, avg((daily_return > 0)::INT) AS breadth_up, avg(above_ma20) AS breadth_ma20, sum(up)::BIGINT AS limit_up, sum(dn)::BIGINT AS limit_down FROM panel GROUP BY trade_date),"


@query(f"{_PANEL} --- SELECT * FROM mkt", "equal_return median_return amount_return breadth_up breadth_ma20", "trade_date stock_count limit_up limit_down")
def market_daily(spark, sf_dir):
    """Daily market (M1, M2)."""
    return mk.daily_market(mk.symbol_panel(src.bars_of(spark, sf_dir))).drop("breadth_ma60")


@query(f"{_PANEL} --- SELECT trade_date, exp(sum(ln(1 + equal_return)) OVER (ORDER BY trade_date)) AS equal_index FROM mkt", "equal_index", "trade_date")
def market_index(spark, sf_dir):
    """Compounded market index (M3, M4)."""
    return mk.market_index(mk.daily_market(mk.symbol_panel(src.bars_of(spark, sf_dir)))).select("trade_date", "equal_index")


@query(f"{_PANEL} ix AS (SELECT trade_date, exp(sum(ln(1 + equal_return)) OVER (ORDER BY trade_date)) AS v FROM mkt), x AS (SELECT trade_date, min(v) OVER (ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / v - 1 AS future_drawdown, lead(v, 5) OVER (ORDER BY trade_date) / v - 1 AS future_return FROM ix), --- SELECT *, (future_drawdown <= -0.03 OR future_return <= -0.02)::INT AS bad_buy_day FROM x WHERE future_return IS NOT NULL", "future_drawdown future_return", "trade_date bad_buy_day")
def bad_buy_days(spark, sf_dir):
    """Days not to buy on, with the outcomes behind them (M8)."""
    df = mk.bad_buy_days(mk.market_index(mk.daily_market(mk.symbol_panel(src.bars_of(spark, sf_dir)))))
    return df.select("trade_date", "future_drawdown", "future_return", "bad_buy_day")


def _top(c: str, n: int, f: str = "max") -> str:
    return f"CASE WHEN count({c}) OVER ({_S} ROWS {n - 1} PRECEDING) >= {n} THEN {f}({c}) OVER ({_S} ROWS {n - 1} PRECEDING) END"


_SHARES = {"breadth_above_ma20": f"close > {_avg('close', 20)}", "breadth_above_ma60": f"close > {_avg('close', 60)}", "breadth_above_ma120": f"close > {_avg('close', 120)}", "new_high_20d_ratio": f"close >= {_top('high', 20)}", "new_low_20d_ratio": f"close <= {_top('low', 20, 'min')}", "new_high_60d_ratio": f"close >= {_top('high', 60)}", "new_low_60d_ratio": f"close <= {_top('low', 60, 'min')}", "limit_up_ratio": "locked AND r >= 0.095", "limit_down_ratio": "locked AND r <= -0.095", "breadth_positive_return_5d": f"close / lag(close, 5) OVER ({_S}) - 1 > 0", "breadth_positive_return_20d": f"close / lag(close, 20) OVER ({_S}) - 1 > 0", "advancing_ratio_1d": "r > 0", "declining_ratio_1d": "r < 0"}
_DAY = f"""u0 AS (SELECT *, close / lag(close) OVER ({_S}) - 1 AS r, abs(high - low) <= 0.0005 * close AS locked FROM bars), u1 AS (SELECT *, ln(1 + r) AS lr, {', '.join(f'coalesce({c}, false)::INT AS {k}' for k, c in _SHARES.items())}, close / ({_top('close', 20)}) - 1 AS dd FROM u0),
u2 AS (SELECT *, {_top('lr', 20, 'stddev_samp')} AS vol FROM u1), u3 AS (SELECT trade_date, count(DISTINCT symbol) AS stock_count, avg(r) AS equal_return_1d, median(r) AS return_median_1d, stddev_pop(r) AS return_dispersion_1d, coalesce(sum(r * amount) / nullif(sum(amount), 0), avg(r)) AS amount_weight_return_1d, sum(amount) AS total_amount, {', '.join(f'avg({k}) AS {k}' for k in _SHARES)}, median(vol) AS volatility_median_20d, median(dd) AS max_drawdown_median_20d FROM u2 WHERE r BETWEEN -0.5 AND 1 GROUP BY 1 HAVING count(DISTINCT symbol) >= 5),
u4 AS (SELECT *, CASE WHEN count(*) OVER d >= 5 THEN avg(total_amount) OVER (ORDER BY trade_date ROWS 4 PRECEDING) END AS a5, CASE WHEN count(*) OVER d >= 20 THEN avg(total_amount) OVER (ORDER BY trade_date ROWS 19 PRECEDING) END AS a20, CASE WHEN count(*) OVER d >= 60 THEN avg(total_amount) OVER (ORDER BY trade_date ROWS 59 PRECEDING) END AS a60 FROM u3 WINDOW d AS (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),"""
_DAY_COLUMNS = "equal_return_1d return_median_1d return_dispersion_1d amount_weight_return_1d total_amount volatility_median_20d max_drawdown_median_20d amount_ratio_5d_20d amount_ratio_20d_60d " + " ".join(_SHARES)


@query(f"{_DAY} --- SELECT *, a5 / a20 AS amount_ratio_5d_20d, a20 / a60 AS amount_ratio_20d_60d FROM u4", _DAY_COLUMNS, "trade_date stock_count")
def trade_day_features(spark, sf_dir):
    """Trade-day cross-section (M5, M6)."""
    return mk.trade_day_features(src.bars_of(spark, sf_dir))


def _day(c: str, n: int, f: str = "avg") -> str:
    return f"CASE WHEN count({c}) OVER (ORDER BY trade_date ROWS {n - 1} PRECEDING) >= {n} THEN {f}({c}) OVER (ORDER BY trade_date ROWS {n - 1} PRECEDING) END"


@query(f"""{_PANEL} i0 AS (SELECT trade_date, exp(sum(ln(1 + equal_return)) OVER (ORDER BY trade_date)) AS v FROM mkt), i1 AS (SELECT *, ln(v / lag(v) OVER (ORDER BY trade_date)) AS lr, {', '.join(f'{_day("v", n)} AS m{n}' for n in (20, 60, 120))}, {', '.join(f'{_day("v", n, "max")} AS t{n}' for n in (20, 60))} FROM i0),
--- SELECT trade_date, {', '.join(f'v / lag(v, {n}) OVER (ORDER BY trade_date) - 1 AS equal_return_{n}d' for n in (5, 20, 60))}, {', '.join(f'coalesce(v > m{n}, false)::INT AS equal_above_ma{n}' for n in (20, 60, 120))}, m20 / lag(m20, 5) OVER (ORDER BY trade_date) - 1 AS equal_ma20_slope_5d, m60 / lag(m60, 10) OVER (ORDER BY trade_date) - 1 AS equal_ma60_slope_10d, {', '.join(f'v / t{n} - 1 AS equal_drawdown_{n}d, {_day("lr", n, "stddev_samp")} AS equal_volatility_{n}d' for n in (20, 60))} FROM i1""", "equal_return_5d equal_return_20d equal_return_60d equal_ma20_slope_5d equal_ma60_slope_10d equal_drawdown_20d equal_drawdown_60d equal_volatility_20d equal_volatility_60d", "trade_date equal_above_ma20 equal_above_ma60 equal_above_ma120")
def index_features(spark, sf_dir):
    """Features of the market index (M7)."""
    df = mk.index_features(mk.market_index(mk.daily_market(mk.symbol_panel(src.bars_of(spark, sf_dir)))), "equal_index", "equal")
    return df.select("trade_date", *[c for c in df.columns if c.startswith("equal_") and c not in ("equal_index", "equal_return")])


@query("--- SELECT sector_type, sector_label, trade_date, count(pct_change) AS valid_count, avg(pct_change) AS avg_pct_change, sum(pct_change * amount) / nullif(sum(amount), 0) AS amount_weighted_pct_change, avg((pct_change > 0)::INT) AS up_ratio FROM bars JOIN members USING (symbol) GROUP BY 1, 2, 3", "avg_pct_change amount_weighted_pct_change up_ratio", "sector_type sector_label trade_date valid_count")
def sector_performance(spark, sf_dir):
    """Sector days (K4, K6)."""
    return se.sector_days(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir)).drop("amount")


_SECTOR = "sd AS (SELECT sector_label, trade_date, avg(pct_change) AS a FROM bars JOIN members USING (symbol) GROUP BY 1, 2), grid AS (SELECT * FROM (SELECT DISTINCT trade_date FROM sd) CROSS JOIN (SELECT DISTINCT sector_label FROM sd)), si AS (SELECT sector_label, trade_date, coalesce(a / 100, 0) AS ret FROM grid LEFT JOIN sd USING (sector_label, trade_date)),"


@query(f"{_SECTOR} --- SELECT sector_label, trade_date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY sector_label ORDER BY trade_date)) AS sector_index FROM si", "ret sector_index", "sector_label trade_date")
def sector_index(spark, sf_dir):
    """Sector indices on the market calendar (K7)."""
    return se.sector_index(se.sector_days(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir))).drop("sector_type")


@query(f"{_SECTOR} n AS (SELECT *, row_number() OVER (PARTITION BY sector_label ORDER BY trade_date) AS i FROM si), u AS (SELECT sector_label, i - row_number() OVER (PARTITION BY sector_label ORDER BY i) AS g FROM n WHERE ret > 0), c AS (SELECT sector_label, g, count(*) AS k FROM u GROUP BY 1, 2), --- SELECT sector_label, max(k) AS longest_up_run FROM c GROUP BY 1", "", "sector_label longest_up_run")
def sector_up_runs(spark, sf_dir):
    """Longest runs of rising days."""
    return se.longest_up_run(se.sector_index(se.sector_days(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir))))


_LEAD = f"""hr AS (SELECT *, coalesce(pct_change, 100 * (close / lag(close) OVER ({_S}) - 1)) AS rp FROM bars WHERE symbol IN (SELECT symbol FROM members)), hd AS (SELECT DISTINCT trade_date FROM hr ORDER BY trade_date DESC LIMIT 504), h0 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS nb FROM hr WHERE trade_date >= (SELECT min(trade_date) FROM hd)), h1 AS (SELECT h0.*, sector_type, sector_label FROM h0 JOIN members USING (symbol) WHERE nb >= 180),
h2 AS (SELECT sector_type, sector_label, trade_date, avg(rp) AS sr, sum(amount) AS sa FROM h1 GROUP BY 1, 2, 3 HAVING count(rp) >= 5),
h3 AS (SELECT *, row_number() OVER w - 1 AS pos, 100 * exp(sum(ln(1 + sr / 100)) OVER w) AS v, count(*) OVER (PARTITION BY sector_label) AS nd FROM h2 WINDOW w AS (PARTITION BY sector_label ORDER BY trade_date)), h4 AS (SELECT * FROM h3 WHERE nd >= 180),"""


@query(f"""{_LEAD} q0 AS (SELECT sector_label, (arg_max(v, pos) / arg_min(v, pos) - 1) * 100 AS sector_return_pct, sum(sa) AS total FROM h4 GROUP BY 1),
q1 AS (SELECT h1.*, sr, close / max(close) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd, (count(*) OVER (w ROWS 119 PRECEDING) = 120 AND close >= max(close) OVER (w ROWS 119 PRECEDING))::INT AS fresh FROM h1 JOIN h4 USING (sector_type, sector_label, trade_date) WHERE rp IS NOT NULL WINDOW w AS (PARTITION BY sector_label, symbol ORDER BY trade_date)),
q2 AS (SELECT sector_type, sector_label, symbol, (arg_max(close, trade_date) / arg_min(close, trade_date) - 1) * 100 AS return_pct, avg((rp > sr)::INT) AS outperform_ratio, sum(fresh)::BIGINT AS new_high_count_120d, (arg_max(close, trade_date) / max(close) - 1) * 100 AS distance_to_high_pct, min(dd) * 100 AS max_drawdown_pct, (arg_max(close, trade_date) / arg_min(close, (dd, trade_date)) - 1) * 100 AS recovery_pct, sum(amount) AS am FROM q1 GROUP BY 1, 2, 3 HAVING count(*) >= 180),
q3 AS (SELECT *, return_pct - sector_return_pct AS excess_pct, am / total * 100 AS amount_share_pct, count(*) OVER (PARTITION BY sector_label) AS n FROM q2 JOIN q0 USING (sector_label)), q4 AS (SELECT *, least(greatest(amount_share_pct, quantile_cont(amount_share_pct, 0.01) OVER s), quantile_cont(amount_share_pct, 0.99) OVER s) AS share FROM q3 WHERE n >= 5 WINDOW s AS (PARTITION BY sector_label)),
q5 AS (SELECT *, {', '.join(f"(rank() OVER (PARTITION BY sector_label ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY sector_label, {c}) - 1) / 2.0::DOUBLE) / (n - 1) * 100 AS p_{c}" for c in ("return_pct", "excess_pct", "outperform_ratio", "new_high_count_120d", "distance_to_high_pct", "share", "max_drawdown_pct", "recovery_pct"))} FROM q4),
--- SELECT *, 0.25::DOUBLE * p_return_pct + 0.25::DOUBLE * p_excess_pct + 0.15::DOUBLE * p_outperform_ratio + 0.1::DOUBLE * (0.6::DOUBLE * p_new_high_count_120d + 0.4::DOUBLE * p_distance_to_high_pct) + 0.15::DOUBLE * p_share + 0.1::DOUBLE * (0.7::DOUBLE * p_max_drawdown_pct + 0.3::DOUBLE * p_recovery_pct) AS long_score FROM q5""", "return_pct excess_pct outperform_ratio distance_to_high_pct max_drawdown_pct recovery_pct amount_share_pct long_score", "sector_type sector_label symbol new_high_count_120d")
def sector_long_scores(spark, sf_dir):
    """Long-term metrics and scores of sector members."""
    df = ld.long_scores(*ld.sector_history(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir)))
    return df.select("sector_type", "sector_label", "symbol", "new_high_count_120d", "return_pct", "excess_pct", "outperform_ratio", "distance_to_high_pct", "max_drawdown_pct", "recovery_pct", "amount_share_pct", "long_score")


@query(f"""{_LEAD} g0 AS (SELECT a.sector_label, a.pos AS start_pos, arg_max(b.pos, (b.v, -b.pos)) AS end_pos, (max(b.v) / a.v - 1) * 100 AS return_pct, 0 AS kind FROM h4 a JOIN h4 b ON a.sector_label = b.sector_label AND b.pos BETWEEN a.pos + 5 AND a.pos + 60 GROUP BY a.sector_label, a.pos, a.v UNION ALL SELECT a.sector_label, a.pos, b.pos, (b.v / a.v - 1) * 100, 1 FROM h4 a JOIN h4 b ON a.sector_label = b.sector_label AND b.pos = a.pos + 20), --- SELECT * FROM g0 WHERE return_pct >= CASE kind WHEN 0 THEN 8 ELSE 5 END""", "return_pct", "sector_label start_pos end_pos kind")
def sector_swings(spark, sf_dir):
    """Candidate swings of sector indices."""
    _, index = ld.sector_history(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir))
    return ld.swing_candidates(index).select("sector_label", "start_pos", "end_pos", "kind", "return_pct")


@query()
def sector_leaders(spark, sf_dir):
    """Leaders of each sector by both scores."""
    return ld.leader_table(ld.leader_scores(src.held_bars(spark, sf_dir), src.membership_of(spark, sf_dir), src.held))


@query()
def leader_summary(spark, sf_dir):
    """Best members and dual leaders of each sector."""
    return ld.leader_summary(ld.leader_scores(src.held_bars(spark, sf_dir), src.membership_of(spark, sf_dir), src.held))


_SCORED = f"s0 AS (SELECT symbol, trade_date, -(close / lag(close, 5) OVER ({_S}) - 1) AS score, lead(close, 5) OVER ({_S}) / close - 1 AS outcome FROM bars), s1 AS (SELECT * FROM s0 WHERE score IS NOT NULL AND outcome IS NOT NULL),"


def _scored(spark, sf_dir):
    df = lab.base_features(src.bars_of(spark, sf_dir)).select("symbol", "trade_date", (-F.col("return_5d")).alias("score"), F.col("future_return_5d").alias("outcome"))
    return df.where("score is not null and outcome is not null")


@query(f"{_SCORED} --- SELECT symbol, trade_date, CASE WHEN count(*) OVER (PARTITION BY trade_date) = 1 THEN 100 ELSE round((count(*) OVER (PARTITION BY trade_date ORDER BY score RANGE UNBOUNDED PRECEDING) - 1)::DOUBLE / (count(*) OVER (PARTITION BY trade_date) - 1) * 100, 2) END AS score_100 FROM s1", "score_100", "symbol trade_date")
def cross_section_scores(spark, sf_dir):
    """0-100 rank scores by day."""
    return _scored(spark, sf_dir).select("symbol", "trade_date", sc.score_100("score", ["trade_date"]).alias("score_100"))


@query(f"{_SCORED} r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score, symbol) AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM s1), e AS (SELECT *, CAST(least(greatest(ceil(CAST(k AS DOUBLE) * 10 / n) - 1, 0), 9) AS INT) AS decile FROM r), --- SELECT decile, count(*) AS n_rows, avg(outcome) AS mean_outcome, quantile_cont(outcome, 0.5) AS median_outcome, avg((outcome > 0)::INT) AS hit_rate FROM e GROUP BY decile", "mean_outcome median_outcome hit_rate", "decile n_rows")
def decile_report(spark, sf_dir):
    """Outcomes by score decile."""
    return sc.decile_report(_scored(spark, sf_dir), "score", "outcome", ["trade_date"])


def _rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0::DOUBLE"


@query(f"{_SCORED} r AS (SELECT *, {_rank('score')} AS rs, {_rank('outcome')} AS ro FROM s1), --- SELECT trade_date, count(*) AS n, nullif(corr(score, outcome), 'nan'::DOUBLE) AS ic, nullif(corr(rs, ro), 'nan'::DOUBLE) AS rank_ic FROM r GROUP BY 1 HAVING count(*) >= 3", "ic rank_ic", "trade_date n")
def daily_ic(spark, sf_dir):
    """Daily IC and rank IC."""
    return sc.daily_ic(_scored(spark, sf_dir), "score", "outcome")


@query(f"{_SCORED} b AS (SELECT score, (outcome > 0)::INT AS y FROM s1), g AS (SELECT score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM b GROUP BY score), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g), --- SELECT sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS roc_auc, sum(p * tp / (tp + fp)) / sum(p) AS average_precision FROM c", "roc_auc average_precision")
def roc_auc(spark, sf_dir):
    """AUC and average precision of the score."""
    return sc.auc(_scored(spark, sf_dir).withColumn("y", (F.col("outcome") > 0).cast("int")), "score", "y")


_TOPK = f"""{_SCORED} k0 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS k FROM s1), k1 AS (SELECT trade_date, list(symbol) AS held, avg(outcome) AS gross FROM k0 WHERE k <= 5 GROUP BY 1), k2 AS (SELECT *, coalesce(lag(held) OVER (ORDER BY trade_date), []) AS old FROM k1),
k3 AS (SELECT trade_date, gross - (0.0005::DOUBLE * len(list_filter(held, lambda x: NOT list_contains(old, x))) + 0.0015::DOUBLE * len(list_filter(old, lambda x: NOT list_contains(held, x)))) / 5 AS net FROM k2), k4 AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY trade_date)) AS v FROM k3), k5 AS (SELECT *, v / greatest(1, max(v) OVER (ORDER BY trade_date)) - 1 AS dd FROM k4),"""


@query(f"{_TOPK} --- SELECT count(*) AS n_days, arg_max(v, trade_date) - 1 AS total_return, arg_max(v, trade_date) ** (252.0::DOUBLE / count(*)) - 1 AS annual_return, avg(net) / stddev_samp(net) * sqrt(252) AS information_ratio, min(dd) AS max_drawdown, avg((net > 0)::INT) AS hit_rate FROM k5", "total_return annual_return information_ratio max_drawdown hit_rate", "n_days")
def top_k_portfolio(spark, sf_dir):
    """Top-5 portfolio and its summary."""
    return bt.portfolio(sc.top_k_turnover(_scored(spark, sf_dir), "score", "outcome"))


@query(f"x AS (SELECT *, lead(open) OVER ({_S}) AS entry FROM bars), --- SELECT symbol, trade_date, CASE WHEN count(close) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) = 10 THEN lead(close, 10) OVER ({_S}) / entry - 1 END AS return_10d, CASE WHEN count(close) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) = 10 THEN max(high) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) / entry - 1 END AS max_profit_10d FROM x", "return_10d max_profit_10d", "symbol trade_date")
def forward_outcomes(spark, sf_dir):
    """Forward outcomes of every bar."""
    return bt.forward_outcomes(src.bars_of(spark, sf_dir), (10,)).select("symbol", "trade_date", "return_10d", "max_profit_10d")


def _trades(spark, sf_dir):
    bars = src.bars_of(spark, sf_dir)
    signals = ind.add_moving(bars).where("is_20d_high and volume_ratio_20 > 2").select("symbol", F.col("trade_date").alias("signal_date"))
    return bt.apply_exit_rules(bt.forward_paths(bars, signals, 10), bt.exit_rules(), 10)


def _values(rules: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rules)


_EXITS = f"""{_MOVING} z0 AS (SELECT *, row_number() OVER ({_S}) AS i, CASE WHEN count(close) OVER ({_S} ROWS 19 PRECEDING) >= 20 THEN max(close) OVER ({_S} ROWS 19 PRECEDING) END AS top20 FROM m1), z1 AS (SELECT symbol, trade_date AS signal_date, i FROM z0 WHERE close >= top20 AND volume / volume_ma_20 > 2),
z2 AS (SELECT z1.symbol, signal_date, z0.i - z1.i AS k, z0.open, z0.high, z0.low, z0.close, count(*) OVER (PARTITION BY z1.symbol, signal_date) AS n, first_value(z0.open) OVER (PARTITION BY z1.symbol, signal_date ORDER BY z0.i) AS entry, max(z0.high) OVER (PARTITION BY z1.symbol, signal_date ORDER BY z0.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph, max(z0.high) OVER (PARTITION BY z1.symbol, signal_date ORDER BY z0.i) AS mh, min(z0.low) OVER (PARTITION BY z1.symbol, signal_date ORDER BY z0.i) AS ml FROM z1 JOIN z0 ON z0.symbol = z1.symbol AND z0.i BETWEEN z1.i + 1 AND z1.i + 10),
ru AS (SELECT rule_id, family, stop::DOUBLE AS stop, take::DOUBLE AS take, be::DOUBLE AS be, ts::DOUBLE AS ts, tr::DOUBLE AS tr, td::INT AS td, tm::DOUBLE AS tm, ns FROM (VALUES {_values(bt.exit_rules())}) v(rule_id, family, stop, take, be, ts, tr, td, tm, ns)),
z3 AS (SELECT *, greatest(entry, coalesce(ph, entry)) AS peak, CASE WHEN ns THEN NULL ELSE entry * (1 - stop) END AS l0 FROM z2 CROSS JOIN ru WHERE n = 10), z4 AS (SELECT *, coalesce(peak / entry - 1 >= be AND entry > l0, false) AS raised FROM z3), z5 AS (SELECT *, CASE WHEN raised THEN entry ELSE l0 END AS l1 FROM z4),
z6 AS (SELECT *, coalesce(peak / entry - 1 >= ts AND peak * (1 - tr) > l1, false) AS trailed FROM z5), z7 AS (SELECT *, CASE WHEN trailed THEN peak * (1 - tr) ELSE l1 END AS lv, CASE WHEN trailed THEN 'trailing' WHEN raised THEN 'breakeven' ELSE 'stop' END AS kd, entry * (1 + take) AS goal FROM z6),
z8 AS (SELECT *, CASE WHEN open <= lv THEN kd WHEN open >= goal THEN 'take' WHEN low <= lv THEN kd WHEN high >= goal THEN 'take' WHEN k = td AND close / entry - 1 < tm THEN 'time' WHEN k = 10 THEN 'timeout' END AS why, CASE WHEN open <= lv OR open >= goal THEN open WHEN low <= lv THEN lv WHEN high >= goal THEN goal ELSE close END AS price FROM z7),
z9 AS (SELECT *, price / entry - 1 AS r, row_number() OVER (PARTITION BY symbol, signal_date, rule_id ORDER BY k) AS f FROM z8 WHERE why IS NOT NULL), za AS (SELECT rule_id, count(*) AS trade_count, avg(r) AS avg_return, avg(r / k) AS avg_daily_return, avg((r > 0)::INT) AS win_rate, avg(r / stop) AS avg_r, avg(CASE WHEN r > 0 THEN r END) AS avg_gain, avg(CASE WHEN r < 0 THEN r END) AS avg_loss, avg(mh / entry - 1) AS avg_max_profit, avg(ml / entry - 1) AS avg_max_drawdown, avg(k) AS avg_holding_days, avg((why = 'stop')::INT) AS stop_loss_rate, avg((why = 'take')::INT) AS take_profit_rate, avg((why = 'trailing')::INT) AS trailing_stop_rate, avg((why = 'breakeven')::INT) AS breakeven_stop_rate, avg((why = 'time')::INT) AS time_stop_rate FROM z9 WHERE f = 1 GROUP BY 1),"""


@query(f"{_EXITS} --- SELECT *, avg_gain / abs(avg_loss) AS payoff_ratio, avg_r + 0.3::DOUBLE * win_rate + 0.2::DOUBLE * least(coalesce(avg_gain / abs(avg_loss), 0), 5) - 0.5::DOUBLE * abs(avg_max_drawdown) - 0.3::DOUBLE * stop_loss_rate - 0.05::DOUBLE * avg_holding_days / 10 AS balanced_score FROM za", "avg_return avg_daily_return win_rate avg_r avg_gain avg_loss avg_max_profit avg_max_drawdown avg_holding_days stop_loss_rate take_profit_rate trailing_stop_rate breakeven_stop_rate time_stop_rate payoff_ratio balanced_score", "rule_id trade_count")
def exit_rule_grid(spark, sf_dir):
    """Trades by exit rule of the whole grid."""
    return bt.exit_summary(_trades(spark, sf_dir), ["rule_id"])


@query()
def rule_selection(spark, sf_dir):
    """Rules chosen on signals up to 1995 and their figures after."""
    trades = _trades(spark, sf_dir).withColumn("split", bt.split_label(F.col("signal_date"), "1995-12-31", "1996-01-01"))
    return bt.select_rules(bt.exit_summary(trades, ["split", "horizon", "rule_id"]), ["horizon"])


@query(f"{_WEEK} --- SELECT b.symbol, b.trade_date, w.week_end, w.weekly_return FROM bars b ASOF LEFT JOIN w1 w ON b.symbol = w.symbol AND b.trade_date >= w.week_end", "weekly_return", "symbol trade_date week_end")
def as_of_weekly(spark, sf_dir):
    """Each bar with the newest finished week."""
    bars = src.bars_of(spark, sf_dir)
    weeks = lab.weekly_returns(bars).select("symbol", "week_end", "weekly_return").withColumn("since", F.col("week_end"))
    return bt.as_of_join(bars.select("symbol", "trade_date"), weeks, ["symbol"], "trade_date", "since").select("symbol", "trade_date", "week_end", "weekly_return")


@query("q0 AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, ts, value, event_id FROM events), --- SELECT symbol, CAST(ts AS DATE) AS trade_date, arg_max(value, (ts, event_id)) AS close FROM q0 GROUP BY 1, 2", "close", "symbol trade_date")
def latest_quotes(spark, sf_dir):
    """Latest quote by symbol and day (T1), the batch form of the stream."""
    return qs.latest_quotes(qs.quotes_of(src.table(spark, sf_dir, "events"))).select("symbol", "trade_date", "close")


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
