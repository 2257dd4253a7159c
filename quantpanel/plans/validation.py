"""Registered queries of model validation: filters, windows, targets, grids and strict strategies; registered on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantpanel.operators import backtest as bt
from quantpanel.operators import gates as gt
from quantpanel.operators import labels as lab
from quantpanel.operators import market as mk
from quantpanel.operators import models as md
from quantpanel.operators import phase9 as p9
from quantpanel.operators import strict as st
from quantpanel.operators import walkforward as wf
from quantpanel.sources import bars as src

from .catalog import _S, _SCORED, _avg, _scored, query

_FEATURES = ["log_return", "return_5d", "return_20d", "vol_20", "downside_vol_20", "drawdown_60", "ma20_distance", "volume_ratio_20", "range_pct"]
TRAIN, VALID, STEP = 1000, 250, 250


# -- filters -----------------------------------------------------------------------------------------------------------

_FILTER = f"""{_SCORED} v0 AS (SELECT *, year(trade_date)::VARCHAR AS window_id, row_number() OVER (PARTITION BY year(trade_date) ORDER BY score DESC, symbol, trade_date) AS k, count(*) OVER (PARTITION BY year(trade_date)) AS n FROM s1),
v1 AS (SELECT *, k > greatest(1, ceil(rate * n)) AS kept, (outcome < 0)::INT AS y FROM v0 CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(rate)),
v2 AS (SELECT window_id, rate AS filter_rate, count(*) AS rows, count(*) FILTER (NOT kept) AS removed_rows, avg(y) AS baseline_risk_label_rate, avg(y) FILTER (kept) AS kept_risk_label_rate, avg(outcome) AS baseline_return, avg(outcome) FILTER (kept) AS kept_return, avg(least(outcome, 0)) AS baseline_drawdown, avg(least(outcome, 0)) FILTER (kept) AS kept_drawdown FROM v1 GROUP BY 1, 2),
v3 AS (SELECT *, kept_risk_label_rate - baseline_risk_label_rate AS risk_label_rate_delta, kept_return - baseline_return AS return_delta, kept_drawdown - baseline_drawdown AS drawdown_delta, coalesce(kept_drawdown - baseline_drawdown > 0, false) AS drawdown_improved, coalesce(kept_return - baseline_return >= -0.001, false) AS no_worse FROM v2),"""


def _impact(spark, sf_dir):
    df = _scored(spark, sf_dir).withColumns({"window_id": F.year("trade_date").cast("string"), "risk_score": F.col("score"), "risk_label": (F.col("outcome") < 0).cast("int"), "low": F.least("outcome", F.lit(0.0))})
    return wf.filter_impact(df, ["window_id"], (0.1, 0.2, 0.3), outcome="outcome", drawdown="low")


@query(f"{_FILTER} --- SELECT *, drawdown_improved AND no_worse AS filter_pass FROM v3", "filter_rate baseline_risk_label_rate kept_risk_label_rate baseline_return kept_return baseline_drawdown kept_drawdown risk_label_rate_delta return_delta drawdown_delta", "window_id rows removed_rows drawdown_improved filter_pass")
def filter_impact(spark, sf_dir):
    """Effect of removing the riskiest share of each year's rows."""
    keep = "window_id filter_rate rows removed_rows baseline_risk_label_rate kept_risk_label_rate baseline_return kept_return baseline_drawdown kept_drawdown risk_label_rate_delta return_delta drawdown_delta drawdown_improved filter_pass"
    return _impact(spark, sf_dir).select(*keep.split())


@query(f"{_FILTER} --- SELECT filter_rate, count(*) AS windows, avg(return_delta) AS avg_return_delta, avg(drawdown_delta) AS avg_drawdown_delta, avg(drawdown_improved::INT) AS drawdown_improved_rate, avg((drawdown_improved AND no_worse)::INT) AS filter_pass_rate, avg((drawdown_improved AND no_worse)::INT) >= 0.7 AS filter_passed FROM v3 GROUP BY 1", "filter_rate avg_return_delta avg_drawdown_delta drawdown_improved_rate filter_pass_rate", "windows filter_passed")
def filter_summary(spark, sf_dir):
    """Shares of years in which a filter passes, with the 70 % rule."""
    return wf.filter_summary(_impact(spark, sf_dir), []).select("filter_rate", "windows", "avg_return_delta", "avg_drawdown_delta", "drawdown_improved_rate", "filter_pass_rate", "filter_passed")


_WALK = f"""{_SCORED} m0 AS (SELECT *, year(trade_date)::VARCHAR AS window_id, (outcome < 0)::INT AS y, least(outcome, 0) AS low, row_number() OVER (PARTITION BY year(trade_date) ORDER BY score, symbol, trade_date) AS k, count(*) OVER (PARTITION BY year(trade_date)) AS n FROM s1),
m1 AS (SELECT window_id, score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM m0 GROUP BY 1, 2), m2 AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM m1 WINDOW w AS (PARTITION BY window_id ORDER BY score DESC)),
m3 AS (SELECT window_id, sum(p) / sum(p + q) AS base, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * tp / (tp + fp)) / sum(p) END AS pr, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(q * (tp - p / 2)) / (sum(p) * sum(q)) END AS roc FROM m2 GROUP BY 1),
m4 AS (SELECT window_id, coalesce(greatest(ceil((k - 1) * 10.0::DOUBLE / nullif(n - 1, 0)) - 1, 0), 0)::INT AS d, avg(y) AS lr, avg(low) AS dd FROM m0 GROUP BY 1, 2), m5 AS (SELECT window_id, arg_max(lr, d) > arg_min(lr, d) AS r, arg_max(dd, d) < arg_min(dd, d) AS w FROM m4 GROUP BY 1),"""


@query(f"{_WALK} --- SELECT *, a >= 0.7 AND top_decile_higher_risk_rate >= 0.7 AND top_decile_worse_drawdown_rate >= 0.7 AS passed FROM (SELECT count(*) AS windows, avg(pr) AS avg_pr_auc, avg(base) AS avg_pr_auc_baseline, avg(roc) AS avg_roc_auc, avg(coalesce(pr > base, false)::INT) AS a, avg(r::INT) AS top_decile_higher_risk_rate, avg(w::INT) AS top_decile_worse_drawdown_rate FROM m3 JOIN m5 USING (window_id)) z", "avg_pr_auc avg_pr_auc_baseline avg_roc_auc top_decile_higher_risk_rate top_decile_worse_drawdown_rate", "windows passed")
def walk_summary(spark, sf_dir):
    """Checks of the stored scores of each year and the 70 % rules."""
    df = _scored(spark, sf_dir).withColumns({"window_id": F.year("trade_date").cast("string"), "risk_score": F.col("score"), "risk_label": (F.col("outcome") < 0).cast("int"), "low": F.least("outcome", F.lit(0.0)), "model_name": F.lit("stored")})
    by = ["model_name", "window_id"]
    out = wf.walk_summary(wf.window_metrics(df, by), wf.risk_deciles(df, by, outcome="outcome", drawdown="low"), ["model_name"])
    return out.select("windows", "avg_pr_auc", "avg_pr_auc_baseline", "avg_roc_auc", "top_decile_higher_risk_rate", "top_decile_worse_drawdown_rate", "passed")


@query(f"""{_SCORED} n0 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS k, row_number() OVER (PARTITION BY trade_date ORDER BY md5(strftime(trade_date, '%Y-%m-%d') || ':' || symbol), symbol) AS j FROM s1), n1 AS (SELECT 'all' AS selection, trade_date, outcome FROM n0 UNION ALL SELECT 'top5', trade_date, outcome FROM n0 WHERE k <= 5 UNION ALL SELECT 'random5', trade_date, outcome FROM n0 WHERE j <= 5), --- SELECT selection, count(*) AS rows, count(DISTINCT trade_date) AS days, avg(outcome) AS mean_outcome, avg((outcome > 0)::INT) AS hit_rate, avg(outcome) - (SELECT avg(outcome) FROM n1 WHERE selection = 'all') AS excess FROM n1 GROUP BY 1""", "mean_outcome hit_rate excess", "selection rows days")
def selection_summary(spark, sf_dir):
    """The five best rows of each day beside five random ones and all."""
    return wf.selection_summary(_scored(spark, sf_dir), 5, "score", "outcome").drop("median_outcome")


# -- fitted windows ----------------------------------------------------------------------------------------------------


def _features(spark, sf_dir):
    bars = src.bars_of(spark, sf_dir)
    return bars, lab.base_features(bars).select("symbol", "trade_date", *_FEATURES, "future_return_5d", "future_min_return_5d")


def _tails(bars, features):
    """Rows with the label of tail risk, stored as every pass of a fit reads them, until the next query is declared."""
    return src.held(lab.risk_panel(features, lab.tail_risk(bars).select("symbol", "trade_date", "risk_label"), ["risk_label"]))


def _tail_panel(spark, sf_dir):
    return _tails(*_features(spark, sf_dir))


def _judged(scored, by, rates=(0.1, 0.2)):
    return wf.judged(wf.risk_cells(scored, [*by, "window_id"], rates), by, rates)


@query()
def walk_forward_report(spark, sf_dir):
    """Each window of three models of tail risk out of sample, fitted together."""
    panel = _tail_panel(spark, sf_dir)
    scored = wf.walk_forward(panel, gt.walk_forward(panel, TRAIN, VALID, STEP, 1), _FEATURES, "risk_label", ("prior", "logistic", "gaussian"))
    return wf.window_metrics(scored, ["model_name", "window_id"])


@query()
def target_comparison(spark, sf_dir):
    """Tail and barrier risk out of sample: checks, filters and verdicts of each model."""
    bars, features = _features(spark, sf_dir)
    barrier = lab.event_barrier(bars, lab.cusum_events(bars), 10, 1.0, 1.0, 0.005).select("symbol", "trade_date", F.col("risk_label").alias("barrier"))
    tail = lab.tail_risk(bars).select("symbol", "trade_date", F.col("risk_label").alias("tail"))
    both = src.held(features.join(tail, ["symbol", "trade_date"], "left").join(barrier, ["symbol", "trade_date"], "left"))  # a row once for both targets
    out = None
    for name, embargo in (("tail", 1), ("barrier", 10)):
        panel = both.where(F.col(name).isNotNull()).withColumn("risk_label", F.col(name))
        scored = wf.walk_forward(panel, gt.walk_forward(panel, TRAIN, VALID, STEP, embargo), _FEATURES, "risk_label", ("prior", "logistic", "gaussian"))
        part = _judged(scored, ["model_name"]).withColumn("risk_target", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def barrier_grid(spark, sf_dir):
    """Horizon, width and least deviation of the barriers by window: all cells fitted together, the best first."""
    bars, features = _features(spark, sf_dir)
    events = lab.cusum_events(bars)
    cells = [(f"mlfin_h{h}_pt{w:g}_sl{w:g}_minret{m:g}", h, w, w, m) for h in (5, 10) for w in (1.0, 2.0) for m in (0.003, 0.005)]
    whole = src.held(features.join(lab.event_grid(bars, events, cells), ["symbol", "trade_date"]))  # an event once, with the labels of its cells
    panel = whole.select("*", F.inline("cells")).drop("cells")
    scored = wf.walk_forward(panel, gt.walk_forward(whole, TRAIN, VALID, STEP, 10), _FEATURES, "risk_label", ("logistic", "gaussian"), by=("config_id",))
    rates = panel.groupBy("config_id").agg(F.count(F.lit(1)).alias("label_rows"), F.avg("risk_label").alias("risk_label_rate"))
    return wf.best_cells(_judged(scored, ["config_id", "model_name"]).join(rates, "config_id"), ["config_id"])


def _day_panel(bars):
    """Market days with their features and whether they were bad to buy on; a row a day, as one symbol."""
    index = mk.market_index(mk.daily_market(mk.symbol_panel(bars)))
    features = mk.index_features(index, "equal_index", "equal")
    names = [c for c, t in features.dtypes if c.startswith("equal_") and t in ("double", "int") and c not in ("equal_index", "equal_return")]
    labels = mk.bad_buy_days(index).select("trade_date", "bad_buy_day", "future_return", "future_drawdown")
    df = features.select("trade_date", *names).join(labels, "trade_date").withColumn("symbol", F.lit("market"))
    return df, [c for c in names if not c.endswith("_120d")]


@query()
def window_targets(spark, sf_dir):
    """A row a window and target: return by regression, bad days, limit-ups and sectors to buy by classification."""
    bars, features = _features(spark, sf_dir)
    day_panel, day_names = _day_panel(bars)
    returns = features.join(lab.return_label(bars).select("symbol", "trade_date", "label"), ["symbol", "trade_date"])
    limits = features.join(lab.limit_up_3d(bars).select("symbol", "trade_date", (F.col("target") > 0).cast("int").alias("hit_label")), ["symbol", "trade_date"])
    sectors = p9.sector_panel(bars, src.membership_of(spark, sf_dir)).withColumnRenamed("sector_label", "symbol")
    sector_names = ["return_5d", "return_20d", "return_60d", "excess_return_20d", "ma20_slope_pct", "volatility_ratio_5d_20d", "drawdown_from_peak_120d_pct"]
    plan = (("phase4", returns, _FEATURES, "label", "ridge", 2), ("phase7", day_panel, day_names, "bad_buy_day", "gaussian", 5), ("phase8", limits, _FEATURES, "hit_label", "logistic", 3), ("phase9", sectors, sector_names, "phase9_label", "logistic", 20))
    out = None
    for name, panel, names, label, kind, embargo in plan:
        panel = panel.select(*{c: None for c in ("symbol", "trade_date", *names, label)}).localCheckpoint()
        scored = wf.walk_forward(panel, gt.walk_forward(panel, TRAIN, VALID, STEP, embargo), names, label, (kind,))
        scored = scored.withColumn("y", (F.col(label) > 0).cast("int") if kind == "ridge" else F.col(label))
        trained = wf.label_correlation(scored, ["window_id"], label)
        part = wf.window_metrics(scored, ["window_id"], "y").join(trained, "window_id").withColumn("target", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def fitted_zoo(spark, sf_dir):
    """Boosted, tree, forest and logistic models of one split of tail risk, scored on later days (V1, V6)."""
    panel = _tail_panel(spark, sf_dir).withColumn("risk_label", F.col("risk_label").cast("double"))
    cut = panel.agg(F.expr("percentile_approx(datediff(trade_date, date '1990-01-01'), 0.7)")).first()[0]
    day = F.datediff("trade_date", F.lit("1990-01-01").cast("date"))
    train, valid, out = panel.where(day <= cut), panel.where(day > cut + 5), None
    for name in ("logistic", "tree", "forest", "boosting"):
        part = md.score(md.fit(train, _FEATURES, "risk_label", name), valid, _FEATURES, "risk_score").withColumn("model_name", F.lit(name))
        part = wf.window_metrics(part, ["model_name"])
        out = part if out is None else out.unionByName(part)
    return out


# -- strict strategies -------------------------------------------------------------------------------------------------


def _stored(spark, sf_dir):
    """Stand-in scores of every bar, with the day's permission and a score that stands in for crash risk."""
    df = lab.base_features(src.bars_of(spark, sf_dir)).dropna(subset=["vol_20", "drawdown_60", "return_5d"])
    allow = F.when(F.dayofmonth("trade_date") % 4 == 0, "no_trade").otherwise("allow")
    df = df.select("symbol", "trade_date", F.col("vol_20").alias("phase1_risk"), (-F.col("drawdown_60")).alias("phase2_risk"), (-F.col("return_5d")).alias("phase4_return"), allow.alias("phase7_trade_permission"), (F.col("range_pct") * 1000).alias("phase5_score_100"))
    return st.day_scores(df, src.bar_parts(spark, sf_dir))


def _outcomes(spark, sf_dir, picks):
    """Trades of picks over the horizons, from the bars."""
    return st.strict_trades(picks, bt.forward_outcomes(src.bars_of(spark, sf_dir)), (5, 10, 20), src.bar_parts(spark, sf_dir))


def _r100(v: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY trade_date) = 1 THEN 100 ELSE round((count(*) OVER (PARTITION BY trade_date ORDER BY {v} RANGE UNBOUNDED PRECEDING) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY trade_date) - 1, 0) * 100, 2) END"


_STORED = f"""t0 AS (SELECT *, ln(close / lag(close) OVER ({_S})) AS lr, {_avg('close', 60).replace('avg(', 'max(')} AS t60, close / lag(close, 5) OVER ({_S}) - 1 AS r5 FROM bars), t1 AS (SELECT *, {_avg('lr', 20).replace('avg(', 'stddev_samp(')} AS a, 1 - close / t60 AS b, -r5 AS c, (high - low) / close * 1000 AS p5 FROM t0),
t2 AS (SELECT symbol, trade_date, p5, day(trade_date) % 4 <> 0 AS allow, {_r100('-a')} AS s1, {_r100('-b')} AS s2, {_r100('c')} AS s4 FROM t1 WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
t3 AS (SELECT *, greatest(0, 100 - 2 * abs(s1 - 80)) AS c1, greatest(0, 100 - 2 * abs(s2 - 80)) AS c2, round(s4 + 0.2::DOUBLE * s1 + 0.2::DOUBLE * s2, 4) AS mx, round(s4 + 0.1::DOUBLE * s1 + 0.1::DOUBLE * s2, 4) AS m1 FROM t2), t4 AS (SELECT *, round(s4 + 0.08::DOUBLE * c1 + 0.12::DOUBLE * c2, 4) AS cr, s1 >= 90 AND s2 >= 90 AND s4 >= 90 AS al FROM t3),"""
_PICK = [
    ("random_top20", "true", "md5(strftime(trade_date, '%Y-%m-%d') || ':' || symbol) DESC", True), ("phase4_top20", "true", "s4 DESC", True), ("phase4_top20_p12_ge30", "s1 >= 30 AND s2 >= 30", "s4 DESC", True), ("phase4_top20_p12_ge40", "s1 >= 40 AND s2 >= 40", "s4 DESC", True),
    ("mixed_010_top20", "s1 >= 40 AND s2 >= 40", "m1 DESC, s4 DESC, s1 DESC, s2 DESC", True), ("mixed_top20", "s1 >= 40 AND s2 >= 40", "mx DESC, s4 DESC, s1 DESC, s2 DESC", True), ("centered_risk_top20", "s1 >= 40 AND s2 >= 50 AND s4 >= 70", "cr DESC, s4 DESC, c1 DESC, c2 DESC", True), ("all90", "al", "mx DESC, s4 DESC, s1 DESC, s2 DESC", False),
    ("mixed_top20_phase7_allow", "s1 >= 40 AND s2 >= 40 AND allow", "mx DESC, s4 DESC, s1 DESC, s2 DESC", True), ("mixed_top20_phase5_safe", "s1 >= 40 AND s2 >= 40 AND p5 >= 40", "mx DESC, s4 DESC, s1 DESC, s2 DESC", True),
]
_PICKS = _STORED + "pk AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, trade_date, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY {o}, symbol) AS selected_rank FROM t4 WHERE {w}{' QUALIFY selected_rank <= 20' if cut else ''}" for n, w, o, cut in _PICK) + "),"
_TRADES = f"""{_PICKS} fo AS (SELECT *, lead(open) OVER ({_S}) AS entry FROM bars), fp AS (SELECT symbol, trade_date, {', '.join(f"CASE WHEN count(close) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN lead(close, {h}) OVER ({_S}) / entry - 1 END AS r{h}, max(high) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / entry - 1 AS u{h}, min(low) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / entry - 1 AS d{h}" for h in (5, 10, 20))} FROM fo),
tr AS ({' UNION ALL '.join(f"SELECT strategy, trade_date, symbol, selected_rank, {h} AS horizon, r{h} AS raw_return, u{h} AS max_profit, d{h} AS max_drawdown FROM pk JOIN fp USING (symbol, trade_date) WHERE r{h} IS NOT NULL" for h in (5, 10, 20))}),"""


@query(f"{_STORED} --- SELECT symbol, trade_date, s1 AS phase1_score_100, s2 AS phase2_score_100, s4 AS phase4_score_100, mx AS mixed_score, m1 AS mixed_010_score, cr AS centered_risk_score, al AS all90_flag FROM t4", "phase1_score_100 phase2_score_100 phase4_score_100 mixed_score mixed_010_score centered_risk_score", "symbol trade_date all90_flag")
def strict_scores(spark, sf_dir):
    """Scores of every day from stored model scores."""
    return _stored(spark, sf_dir).select("symbol", "trade_date", "all90_flag", "phase1_score_100", "phase2_score_100", "phase4_score_100", "mixed_score", "mixed_010_score", "centered_risk_score")


@query(f"{_TRADES} --- SELECT * FROM tr", "raw_return max_profit max_drawdown", "strategy trade_date symbol selected_rank horizon")
def strict_trades(spark, sf_dir):
    """Trades of the strict strategies over three horizons."""
    return _outcomes(spark, sf_dir, st.strict_picks(_stored(spark, sf_dir)))


@query(f"{_TRADES} cc AS (SELECT strategy, avg((n = 0)::INT) AS no_candidate_day_rate, count(*) AS signal_days FROM (SELECT g.strategy, g.trade_date, count(symbol) AS n FROM (SELECT * FROM (SELECT DISTINCT strategy FROM pk UNION SELECT unnest([{', '.join(repr(x[0]) for x in _PICK)}])), (SELECT DISTINCT trade_date FROM t4)) g LEFT JOIN pk USING (strategy, trade_date) GROUP BY 1, 2) GROUP BY 1), sm AS (SELECT strategy, horizon, count(*) AS trade_count, count(DISTINCT trade_date) AS signal_days_with_trades, avg(raw_return) AS avg_raw_return, avg((raw_return > 0)::INT) AS raw_win_rate, avg(max_profit) AS avg_max_profit, avg(max_drawdown) AS avg_max_drawdown, avg(raw_return) FILTER (raw_return > 0) AS g, avg(raw_return) FILTER (raw_return < 0) AS l FROM tr GROUP BY 1, 2), --- SELECT *, g / abs(l) AS payoff_ratio, raw_win_rate * coalesce(g, 0) + (1 - raw_win_rate) * coalesce(l, 0) AS expectancy FROM sm JOIN cc USING (strategy)", "avg_raw_return raw_win_rate avg_max_profit avg_max_drawdown payoff_ratio expectancy no_candidate_day_rate", "strategy horizon trade_count signal_days_with_trades signal_days")
def strict_summary(spark, sf_dir):
    """Payoff, expectancy and days without candidates of the strict strategies."""
    picks = st.strict_picks(_stored(spark, sf_dir)).localCheckpoint()  # a few rows a day and strategy
    days = picks.where("strategy = 'random_top20'")  # which picks on every day that has a row
    out = st.strict_summary(_outcomes(spark, sf_dir, picks), st.candidate_counts(picks, days))
    return out.drop("avg_gain", "avg_loss")


@query()
def strict_validation(spark, sf_dir):
    """Three models and the gate fitted to the same windows, scored out of sample, strategies and their summary."""
    bars, features = _features(spark, sf_dir)
    keys = ["symbol", "trade_date"]
    events = lab.cusum_state(bars).select("symbol", F.col("trade_date").alias("event_date"), "vol", "threshold")
    # a row once for the three labels, stored as every pass of a fit reads it
    panel = features.join(lab.tail_risk(bars).select(*keys, F.col("risk_label").alias("tail")), keys, "left").join(lab.event_barrier(bars, events, 10).select(*keys, F.col("risk_label").alias("barrier")), keys, "left")
    panel = src.held(panel.join(lab.return_label(bars).select(*keys, "label"), keys, "left"))
    tail = panel.where("tail is not null")
    windows = gt.walk_forward(tail, 900, 60, 60, 60, anchored=True).collect()
    models = [(name, wf.fit_groups(p, ["window_id"], _FEATURES, y, (k,), keep=False, windows=windows)) for name, p, y, k in (("phase1_risk", tail, "tail", "logistic"), ("phase2_risk", panel, "barrier", "gaussian"), ("phase4_return", panel, "label", "ridge"))]
    rows = wf.score_models(wf.valid_rows(tail, windows), models, ["window_id"], _FEATURES)
    days, names = _day_panel(bars)
    dealt = gt.slice_windows(days, spark.createDataFrame(windows)).localCheckpoint()  # a row a market day and window
    model = wf.fit_groups(dealt.where("split = 'train'"), ["window_id"], names, "bad_buy_day", ("gaussian",))
    of = lambda split: wf.score_groups(dealt.where(F.col("split") == split).select("window_id", "trade_date", *names), model, ["window_id"], names)
    gate = st.gate_permissions(of("train"), of("valid")).select("window_id", "trade_date", "phase7_trade_permission")
    rows = rows.join(F.broadcast(gate), ["window_id", "trade_date"], "left")  # a row a day
    scores = st.day_scores(rows.withColumn("phase5_score_100", F.lit(None).cast("double")), src.bar_parts(spark, sf_dir))
    picks = st.strict_picks(scores).localCheckpoint()  # a few rows a day and strategy
    trades = st.met_trades(picks, bt.forward_outcomes(bars), (5, 10, 20))
    return st.strict_summary(trades, st.candidate_counts(picks, picks.where("strategy = 'random_top20'")))


_ROLL = "OVER (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING)"
_ROLLED = _STORED + "y0 AS (SELECT *, " + ", ".join(f"CASE WHEN count(s{k}) {_ROLL} = 5 THEN avg(s{k}) {_ROLL} END AS a{k}, CASE WHEN count(s{k}) {_ROLL} = 5 THEN stddev_pop(s{k}) {_ROLL} END AS v{k}" for k in (1, 2, 4)) + " FROM t4), y1 AS (SELECT *, round(greatest(0, 100 - 2 * abs(a1 - 80)), 4) AS ac1, round(greatest(0, 100 - 2 * abs(a2 - 80)), 4) AS ac2 FROM y0), y2 AS (SELECT *, CASE WHEN a4 IS NOT NULL THEN round(a4 + 0.08::DOUBLE * ac1 + 0.12::DOUBLE * ac2, 4) END AS rm FROM y1), y3 AS (SELECT *, round(rm - 0.05::DOUBLE * v1 - 0.05::DOUBLE * v2 - 0.1::DOUBLE * v4, 4) AS rs FROM y2),"


def _rolled(spark, sf_dir, more=()):
    """Picks of the rolling strategies from stored scores."""
    parts = src.bar_parts(spark, sf_dir)
    return st.rolling_picks(st.rolling_features(_stored(spark, sf_dir), parts=parts), more=more, parts=parts)


_ROLL_PICK = [("random_top20", "true", "md5(strftime(trade_date, '%Y-%m-%d') || ':' || symbol) DESC"), ("centered_risk_top20", "s1 >= 40 AND s2 >= 50 AND s4 >= 70", "cr DESC, s4 DESC, c1 DESC, c2 DESC"), ("rolling5_phase4_mean_top20", "a1 >= 40 AND a2 >= 50 AND a4 >= 70", "a4 DESC, s4 DESC"), ("rolling5_mean_top20", "a1 >= 40 AND a2 >= 50 AND a4 >= 70", "rm DESC, a4 DESC, s4 DESC"), ("rolling5_stable_top20", "a1 >= 40 AND a2 >= 50 AND a4 >= 70", "rs DESC, rm DESC, a4 DESC")]


@query(f"{_ROLLED} --- SELECT symbol, trade_date, a1 AS phase1_5d_mean, v1 AS phase1_5d_std, s1 - a1 AS phase1_5d_delta, a4 AS phase4_5d_mean, rm AS rolling5_mean_score, rs AS rolling5_stable_score FROM y3", "phase1_5d_mean phase1_5d_std phase1_5d_delta phase4_5d_mean rolling5_mean_score rolling5_stable_score", "symbol trade_date")
def rolling_features(spark, sf_dir):
    """Five-day figures of stored scores and the rolling scores."""
    return st.rolling_features(_stored(spark, sf_dir)).select("symbol", "trade_date", "phase1_5d_mean", "phase1_5d_std", "phase1_5d_delta", "phase4_5d_mean", "rolling5_mean_score", "rolling5_stable_score")


@query(_ROLLED + " --- " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, trade_date, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY {o}, symbol) AS selected_rank FROM y3 WHERE {w} QUALIFY selected_rank <= 20" for n, w, o in _ROLL_PICK), "", "strategy trade_date symbol selected_rank")
def rolling_picks(spark, sf_dir):
    """Picks of the rolling strategies of every day."""
    return _rolled(spark, sf_dir)


@query()
def rolling_summary(spark, sf_dir):
    """Trades of the rolling strategies over three horizons, summed up."""
    picks = _rolled(spark, sf_dir, st.FIGURES).localCheckpoint()  # a few rows a day and strategy
    days = picks.where("strategy = 'random_top20'")  # which picks on every day that has a row
    trades = _outcomes(spark, sf_dir, picks.drop(*st.FIGURES)).localCheckpoint()
    return st.rolling_summary(trades, st.candidate_counts(picks, days, st.ROLLING), picks.dropDuplicates(["symbol", "trade_date"]))
