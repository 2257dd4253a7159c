"""Work that grows with the rows: long histories, many windows and many settings."""

import math
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quantpanel.operators import indicators as ind
from quantpanel.operators import labels as lab
from quantpanel.operators import market as mk
from quantpanel.operators import patterns as pt
from quantpanel.operators import quality as ql
from quantpanel.operators import strict as st
from quantpanel.sources import bars as src

SCHEMA = "symbol string, trade_date date, open double, close double, high double, low double, volume double, amount double, pct_change double"


def walk(spark, symbols=2, days=80):
    rows = []
    for s in range(symbols):
        c = 10.0
        for d in range(days):
            o, c = c, 10 + 3 * math.sin(d / (5 + s)) + 0.3 * math.cos(7 * d + s)
            v = 100.0 + 10 * ((d * 7 + s) % 11)
            rows.append((f"{s:06d}", date(2000, 1, 1) + timedelta(d), o, c, max(o, c) + 0.1, min(o, c) - 0.1, v, v * c, 100 * (c / o - 1)))
    return spark.createDataFrame(rows, SCHEMA)


def test_recurrences_of_a_long_history_take_linear_work(spark):
    began = time.monotonic()
    bars = walk(spark, 1, 12_000)
    last = ind.last_rows(ind.add_recurrences(bars)).first()
    state = ind.technicals(ind.recurrence_state(bars)).first()
    assert time.monotonic() - began < 60
    for c in ("macd_dif", "macd_dea", "macd_hist", "atr_14"):
        assert last[c] == pytest.approx(state[c], abs=1e-9)


def test_recurrences_pass_over_nulls(spark):
    bars = walk(spark, 1, 60).withColumn("close", F.when(F.dayofmonth("trade_date") % 10 != 3, F.col("close")))
    last, state = ind.last_rows(ind.add_recurrences(bars)).first(), ind.technicals(ind.recurrence_state(bars)).first()
    for c in ("macd_dif", "macd_dea", "atr_14"):
        assert last[c] == pytest.approx(state[c], abs=1e-9)


@pytest.mark.parametrize("days", [1, 20, 61, 80])
def test_last_alpha_takes_the_tail_alone(spark, days):
    bars = walk(spark, 2, days)
    whole = {r.symbol: r for r in ind.last_rows(lab.window_features(lab.candle_features(bars))).collect()}
    tail = lab.latest_alpha(bars).collect()
    assert len(tail) == 2
    for r in tail:
        for c, v in r.asDict().items():
            assert v == (pytest.approx(whole[r.symbol][c], abs=1e-8) if isinstance(v, float) else whole[r.symbol][c]), c


def test_grid_of_barriers_is_its_cells(spark):
    bars = walk(spark, 3, 200)
    events = lab.cusum_state(bars, span=10).select("symbol", F.col("trade_date").alias("event_date"), "vol", "threshold")
    cells = [(f"{h}-{w}-{m}", h, w, w, m) for h in (5, 10) for w in (0.5, 2.0) for m in (0.003, 0.05)]
    got = {(r.config_id, r.symbol, r.trade_date): r.risk_label for r in lab.event_grid(bars, events, cells).select("symbol", "trade_date", F.inline("cells")).collect()}
    want = {(n, r.symbol, r.trade_date): r.risk_label for n, h, u, d, m in cells for r in lab.event_barrier(bars, events, h, u, d, m).collect()}
    assert got == want and len(set(got.values())) == 2


def test_tail_risk_model_works_its_panel_out_once(spark):
    from quantpanel.operators import gates as gt

    seen = spark.sparkContext.accumulator(0)

    def passed(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    raw = spark.range(400).selectExpr("lpad(cast(id % 7 as string), 6, '0') as symbol", "date_add(date '2000-01-01', cast(id as int)) as trade_date", "cast(id % 13 as double) as x", "cast(id % 13 > 6 and id % 3 > 0 as int) as y")
    gt.tail_risk_model(raw.mapInPandas(passed, raw.schema), ["x"], "y")
    assert seen.value == 400


def test_tail_risk_model_is_fitted_to_all_rows(spark):
    """No setting bounds the rows that are read."""
    import inspect

    from quantpanel.operators import gates as gt

    assert list(inspect.signature(gt.tail_risk_model).parameters) == ["panel", "features", "label"]
    raw = spark.range(3000).selectExpr("lpad(cast(id % 7 as string), 6, '0') as symbol", "date_add(date '2000-01-01', cast(id as int)) as trade_date", "cast(id % 13 as double) as x", "cast((id % 13 > 6) = (id > 1000) and id % 5 > 0 as int) as y")
    model = gt.tail_risk_model(raw, ["x"], "y")
    assert model.stages[-1].coefficients[0] > 0 and model.stages[-1].summary.predictions.count() == 3000


def test_bars_of_eligible_symbols_are_told_in_one_pass(spark):
    from quantpanel.operators import patterns as pt

    bars = walk(spark, 6, 230).where("symbol <> '000002' or trade_date < '2020-06-01'").withColumn("amount", F.when(F.col("symbol") == "000001", 1.0).otherwise(F.col("amount")))
    bars = bars.withColumn("close", F.when(F.col("symbol") == "000003", 10.0).otherwise(F.col("close")))
    out = pt.eligible_bars(bars, least_amount=100.0)
    some = pt.eligible(bars, least_amount=100.0)
    assert 0 < some.count() < 6 and sorted(out.collect()) == sorted(bars.join(some, "symbol", "left_semi").select(*bars.columns).collect()) and out.columns == bars.columns
    assert not nodes(out, "Join") and len(nodes(src.derive_bars(lines(spark)).transform(pt.eligible_bars), "Exchange")) == 1
    kept = []
    pt.pattern_report(bars, least_amount=100.0, keep=lambda df: kept.append(df) or df).collect()
    assert len(kept) == 1


def test_thresholds_of_tail_events_are_percentiles_of_the_frame(spark):
    """The same doubles as F.percentile over the frame, at places between values and on one, without a map a frame."""
    from quantpanel.operators.indicators import by_symbol

    bars = walk(spark, 3, 150).withColumn("close", F.when(F.dayofyear("trade_date") != 20, F.col("close")))
    for lookback, q in ((100, 0.05), (21, 0.05), (10, 0.5), (5, 1.0)):
        out = lab.tail_risk(bars, lookback, q)
        w = by_symbol().rowsBetween(-lookback, -1)
        want = out.withColumn("want", F.when(F.count("log_return").over(w) >= lookback, F.percentile("log_return", q).over(w)))
        assert want.where("not (threshold <=> want)").select("threshold", "want").collect() == [] and want.where("want is not null").count() > 0
    assert "percentile" not in lab.tail_risk(bars)._jdf.queryExecution().executedPlan().toString()


def lines(spark, n=3000):
    return spark.range(n).selectExpr("id % 20 as l_suppkey", "cast(date_add(date '2000-01-01', cast(id div 25 as int)) as timestamp) as l_shipdate", "100D + id * 37 % 91 as l_extendedprice", "id % 7 / 100D as l_tax", "id % 5 / 100D as l_discount", "1D + id % 9 as l_quantity")


def nodes(df, word):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [x for x in plan.splitlines() if x.strip(" :+-*()0123456789").startswith(word)]


def test_bars_are_dealt_by_symbol_once_over_the_given_parts(spark):
    want = {(r.symbol, r.trade_date): r for r in src.derive_bars(lines(spark)).collect()}
    bars = src.derive_bars(lines(spark), parts=5)
    assert bars.rdd.getNumPartitions() == 5 and len(nodes(bars, "Exchange")) == 1 and len(nodes(bars, "Sort ")) == 1
    assert {(r.symbol, r.trade_date): r for r in bars.collect()} == want
    assert src.parts_of(lines(spark), rows=100) == 30 and src.parts_of(lines(spark), rows=1000) is None


def test_days_are_counted_where_the_bars_lie(spark):
    bars = walk(spark, 3, 40)
    twice = bars.unionByName(bars.where("day(trade_date) = 3"))
    got = {r.symbol: r for r in ql.audit(twice).collect()}
    assert [(r.trading_days, r.duplicates) for r in got.values()] == [(40, 2)] * 3
    panel = bars.selectExpr("trade_date", "symbol", "0.01D as daily_return", "1D as amount", "1 as above_ma20", "1 as above_ma60", "0 as limit_up_like", "0 as limit_down_like")
    panel = panel.unionByName(panel.where("day(trade_date) = 3"))
    assert {r.stock_count for r in mk.daily_market(panel).collect()} == {3}
    parted = src.derive_bars(lines(spark), parts=5)
    assert len(nodes(ql.audit(parted), "Exchange")) == 1
    assert len(nodes(mk.daily_market(mk.symbol_panel(parted)), "Exchange")) == 2


def test_rules_of_one_order_share_its_sort(spark):
    rows = spark.range(600).selectExpr("lpad(cast(id % 60 as string), 6, '0') as symbol", "date_add(date '2000-01-01', cast(id div 60 as int)) as trade_date", "id * 7 % 61 / 61D as phase1_risk", "id * 11 % 59 / 59D as phase2_risk", "id * 13 % 53 / 53D as phase4_return", "'allow' as phase7_trade_permission", "50D as phase5_score_100")
    scores = st.day_scores(rows, parts=4)
    picks = st.strict_picks(scores)
    assert len(nodes(picks, "Sort ")) <= 9 and picks.rdd.getNumPartitions() == 4
    all_rows, got = scores.toPandas(), {(r.strategy, r.trade_date, r.symbol): r.selected_rank for r in picks.collect()}
    want = {}
    for day, pdf in all_rows.groupby("trade_date"):
        for name, least in (("phase4_top20", 0), ("phase4_top20_p12_ge30", 30), ("phase4_top20_p12_ge40", 40)):
            kept = pdf[(pdf["phase1_score_100"] >= least) & (pdf["phase2_score_100"] >= least)].sort_values(["phase4_score_100", "symbol"], ascending=[False, True])
            want |= {(name, day, s): k + 1 for k, s in enumerate(kept["symbol"][:20])}
    assert {k: v for k, v in got.items() if k[0].startswith("phase4_")} == want


def test_rolling_features_of_long_histories_take_linear_work(spark):
    """A flat stretch, nulls and the shrinking frames by hand, on a history that one aggregate a frame and row would be slow for."""
    bars = walk(spark, 1, 30_000).withColumn("close", F.when(F.dayofmonth("trade_date") % 10 != 3, F.when(F.year("trade_date") == 2001, 10.0).otherwise(F.col("close"))))
    began = time.monotonic()
    got = lab.window_features(bars, (5, 60)).orderBy("trade_date").toPandas()
    assert time.monotonic() - began < 20
    c, high, v = got["close"], got["high"], got["volume"]
    for n in (5, 60):
        w = c.rolling(n, min_periods=1)
        want = {"MA": w.mean() / c, "STD": c.rolling(n, min_periods=2).std() / c, "QTLU": w.quantile(0.8) / c, "MAX": high.rolling(n, min_periods=1).max() / c, "VMA": v.rolling(n, min_periods=1).mean() / (v + 1e-12), "IMAX": (high.rolling(n, min_periods=1).apply(lambda x: x.argmax(), raw=True) + 1) / n}
        for k, x in want.items():
            assert got[f"{k}{n}"].isna().tolist() == x.isna().tolist() and (got[f"{k}{n}"] - x).abs().max() < 1e-7, k
    flat = got[(got["trade_date"] > date(2001, 3, 10)) & (got["trade_date"] < date(2001, 12, 1)) & got["close"].notna()]
    assert (flat["RSQR60"] == 1).all() and (flat["BETA60"] == 0).all() and flat["CORR60"].isna().all() and (flat["RANK5"] > 0.5).all()


@pytest.mark.parametrize("report", [pt.volume_top, pt.duck_nostril, pt.double_volume])
def test_patterns_look_ahead_in_frames_that_grow(spark, report):
    plan = report(walk(spark, 2, 200))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing$())" in plan and "specifiedwindowframe(RowFrame, 1, unboundedfollowing" not in plan and "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing" not in plan


@pytest.mark.parametrize("name", ["mainline_strength", "intraday_pool", "leader_pool", "watchlist_payloads", "component_comparison"])
def test_a_query_works_its_bars_out_once(spark, monkeypatch, name):
    from __spark_entry__ import queries

    seen, whole = spark.sparkContext.accumulator(0), src.bars_of

    def passed(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    def counted(spark, sf_dir):
        bars = whole(spark, sf_dir)
        return bars.mapInPandas(passed, bars.schema)

    monkeypatch.setattr(src, "bars_of", counted)
    queries()[name](spark, "/root/testdata/sf0.001").collect()
    src.release()
    assert seen.value == whole(spark, "/root/testdata/sf0.001").count()


def test_phases_of_one_frame_are_those_of_joined_ones(spark):
    """Ties, nulls, a value that is no number, rows of one phase alone and days of one row."""
    from quantpanel.operators import routes as rt
    from quantpanel.operators import watchlist as wl

    rows = []
    for day in range(4):
        for s in range(1 if day == 3 else 23):
            x = (s * 7 + day * 5) % 11
            p1 = None if x == 4 else float("nan") if (s, day) == (6, 1) else x / 10
            rows.append((date(2024, 1, 1 + day), f"{s:06d}", p1, None if x == 7 else (s * 3 + day) % 5 / 4, None if s == 9 else (s * 5 % 13) / 13, None if s == 8 else (s * 11 % 7) / 7, None if s == 2 else s % 6 == 0, (s - 3) / 100, ["5"] * (x > 5) + ["4"] * (s % 4 == 0)))
    df = spark.createDataFrame(rows, "trade_date date, symbol string, p1 double, p2 double, p4 double, p8 double, limit boolean, daily_return double, ids array<string>")
    days, keys = wl.evaluated_days(df).cache(), ["trade_date", "symbol"]
    patterns = df.select(*keys, F.explode("ids").alias("pattern_id"))
    extras = df.select(*keys, "daily_return").join(rt.phase_opportunity(df, "p8", "limit"), keys)
    want = wl.evaluated(rt.phase_risk(df, "p1", "phase1"), rt.phase_risk(df, "p2", "phase2"), rt.phase_return(df, "p4"), extras, patterns)
    columns = [*keys, "phase1_excluded", "phase2_excluded", "phase1_score_100", "phase2_score_100", "pattern_match", "daily_return", *wl.POOL_SCORES, "pattern_priority"]
    text = lambda rows: sorted(map(str, rows.select(*columns).collect()))
    assert text(days.where("phased")) == text(want) and days.count() == len(rows)
    for sizes in ((2, 4, 8), (0, 3, 5), (30, 30, 3)):
        pool = wl.pool_of_days(days, *sizes)
        assert sorted(map(str, pool.collect())) == sorted(map(str, wl.intraday_pool(want, patterns, *sizes).collect()))
    days.unpersist()


def test_a_quote_of_zero_has_no_infinite_figures(spark):
    """A ratio to a price of zero is empty, as in the reference, and so is the deviation of its return."""
    from quantpanel.streaming import candidates as ca

    bars = walk(spark, 2, 80)
    latest = spark.createDataFrame([("000000", date(2001, 1, 1), 0.0), ("000001", date(2001, 1, 1), 9.0)], "symbol string, trade_date date, close double")
    latest = latest.withColumn("quote_datetime", F.col("trade_date").cast("timestamp"))
    got = {r.symbol: r for r in ca.analysis(latest, ind.recurrence_state(bars), ca.history_tail(bars)).collect()}
    assert got["000000"].atr_14 > 0 and got["000000"].atr_pct_14 is None and got["000000"].vol_20 is None
    assert got["000000"].intraday_pct_change == -100 and got["000001"].atr_pct_14 > 0 and got["000001"].vol_20 > 0
