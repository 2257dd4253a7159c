import math
from datetime import date, datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantpanel.operators import backtest as bt
from quantpanel.operators import gates as gt
from quantpanel.operators import indicators as ind
from quantpanel.operators import labels as lab
from quantpanel.operators import leaders as ld
from quantpanel.operators import patterns as pt
from quantpanel.operators import pullback as pb
from quantpanel.operators import routes as rt
from quantpanel.operators import scores as sc
from quantpanel.plans import catalog
from quantpanel.sources import bars as src
from quantpanel.streaming import quotes as qs

SF = "/root/testdata/sf0.001"


def ramp(spark, closes, spread=1.0):
    d = date(2024, 1, 1)
    rows = [("600000", d + timedelta(days=i), float(c), float(c), c + spread, c - spread, 100.0, 1e6, 0.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, src.BARS)


def test_indicators_by_hand(spark):
    closes = [20.0] * 30 + [21, 19, 22, 18, 23]
    last = ind.last_rows(ind.add_moving(ramp(spark, closes))).first()
    assert last.ma_5 == 20.6 and last.close_max_20 == 23 and last.is_20d_high
    # ranges are 2 while closes stand still, then 2, 3, 4, 5 and 6 from the close before
    first = ind.last_rows(ind.add_recurrences(ramp(spark, closes[:31]))).first()
    assert abs(first.atr_14 - 2) < 1e-9
    atr = 2.0
    for tr in (3, 4, 5, 6):
        atr = (atr * 13 + tr) / 14
    assert abs(ind.last_rows(ind.add_recurrences(ramp(spark, closes))).first().atr_14 - atr) < 1e-9


def test_macd_is_the_recurrence(spark):
    closes = [10 + math.sin(i) + i / 20 for i in range(80)]
    got = [r.macd_dea for r in ind.add_recurrences(ramp(spark, closes)).orderBy("trade_date").collect()]
    s = pd.Series(closes)
    dif = s.ewm(span=12, adjust=False, min_periods=12).mean() - s.ewm(span=26, adjust=False, min_periods=26).mean()
    want = dif.ewm(span=9, adjust=False, min_periods=9).mean()
    assert all((g is None and math.isnan(w)) or abs(g - w) < 1e-9 for g, w in zip(got, want))


def test_tail_event(spark):
    # returns of 1 % but for one fall on the seventh day: only it is below the quantile of the four before it
    closes = [50.0]
    for k in range(1, 10):
        closes.append(closes[-1] * (0.95 if k == 6 else 1.01 + k / 10000))
    df = lab.tail_risk(ramp(spark, closes), lookback=4, quantile=0.1).orderBy("trade_date").collect()
    assert [r.tail_event for r in df] == [0, 0, 0, 0, 0, 0, 1, 0, 0, 0] and df[5].risk_label == 1 and df[9].risk_label is None


def test_return_label(spark):
    df = lab.return_label(ramp(spark, [8, 16, 4, 5])).orderBy("trade_date").collect()
    assert [r.label_raw for r in df] == [-0.75, 0.25, None, None]


def bars(spark, rows):
    """rows: (open, high, low, close[, volume])."""
    d = date(2024, 1, 1)
    out = [("600000", d + timedelta(days=i), float(r[0]), float(r[3]), float(r[1]), float(r[2]), float(r[4] if len(r) > 4 else 100), 1e9, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, src.BARS)


def trade(spark, days, rule):
    paths = bars(spark, days).select("symbol", F.lit(date(2023, 12, 31)).alias("signal_date"), (F.datediff("trade_date", F.lit(date(2024, 1, 1))) + 1).alias("day_offset"), "trade_date", "open", "high", "low", "close")
    rules = [r for r in bt.exit_rules() if r[0] == rule]
    return bt.apply_exit_rules(paths, rules, len(days)).first()


def test_exits_by_hand(spark):
    flat = (10, 10.2, 9.9, 10)
    # a day that meets both leaves at the stop
    out = trade(spark, [flat, (10, 11.5, 9, 10)], "fixed_sl080_tp100")
    assert (out.exit_reason, round(out.exit_price, 6), out.holding_days) == ("stop_loss_first", 9.2, 2)
    # an open above the take leaves there before low and high are looked at
    out = trade(spark, [flat, (11.5, 11.6, 9, 9.5)], "fixed_sl080_tp100")
    assert (out.exit_reason, round(out.trade_return, 6)) == ("take_profit_open_gap", 0.15)
    # a gap below the stop leaves at the open
    out = trade(spark, [flat, (8, 8.5, 7.5, 8)], "fixed_sl080_tp100")
    assert (out.exit_reason, round(out.trade_return, 6)) == ("stop_loss_open_gap", -0.2)
    # a high of 8 % raises the stop to the entry from the next day on
    out = trade(spark, [(10, 10.85, 9.9, 10.5), (10.4, 10.5, 9.95, 10), flat], "breakeven_sl080_be080_tp100")
    assert (out.exit_reason, out.exit_price, out.holding_days) == ("breakeven_stop", 10.0, 2)
    # the trail starts only after its trigger, 6 % below the highest high before the day
    out = trade(spark, [(10, 10.5, 9.9, 10.4), (10.4, 10.5, 9.8, 10.2), (10.2, 12, 10.2, 11.9), (11.9, 11.95, 11.2, 11.5)], "trailing_sl080_start080_trail060")
    assert (out.exit_reason, round(out.exit_price, 6), out.holding_days) == ("trailing_stop", 11.28, 4)
    # too little after five days leaves at that close
    out = trade(spark, [flat] * 4 + [(10, 10.2, 9.9, 10.1), flat], "time_sl060_tp080_d5_min020")
    assert (out.exit_reason, out.exit_price, out.holding_days) == ("time_stop", 10.1, 5)
    out = trade(spark, [flat, (10, 10, 1, 7)], "fixed_horizon")
    assert (out.exit_reason, round(out.trade_return, 6)) == ("timeout", -0.3)
    assert len(bt.exit_rules()) == 124


def test_barriers_by_hand(spark):
    # 15 days of range 2 give an ATR of 2; entry 100, barriers 98 and 104
    quiet = [(100, 101, 99, 100)] * 15
    out = lab.triple_barrier(bars(spark, quiet + [(100, 101, 99, 100), (100, 104.5, 97, 100)]), horizon=5).orderBy("trade_date").collect()
    row = out[14 - 13]
    assert (row.barrier_outcome, row.exit_price, row.risk_label) == ("down_first", 98.0, 1) and abs(row.barrier_max_drawdown + 0.03) < 1e-12
    up = lab.triple_barrier(bars(spark, quiet + [(100, 105, 99, 103), (103, 103, 90, 95)]), horizon=2).orderBy("trade_date").collect()[1]
    assert (up.barrier_outcome, up.exit_price, up.risk_label) == ("up_first", 104.0, 0)
    late = lab.triple_barrier(bars(spark, quiet + [(100, 105, 99, 103), (103, 103, 90, 95)]), horizon=2, variant="max_drawdown_exceed").orderBy("trade_date").collect()[1]
    assert late.risk_label == 1
    still = lab.triple_barrier(bars(spark, quiet), horizon=5).orderBy("trade_date").collect()[0]
    assert (still.barrier_outcome, still.exit_price) == ("timeout", 100.0)
    pct = lab.triple_barrier(bars(spark, quiet + [(100, 101, 96.5, 100)]), horizon=1, down_pct=0.03, up_pct=0.05).orderBy("trade_date").collect()[-1]
    assert (pct.barrier_outcome, pct.exit_price) == ("down_first", 97.0)


def test_limit_up_by_hand(spark):
    # day 1: its own high 10 % up, so it goes; day 2: the third day after closes 6 % lower, and a high before hits
    rows = [(10, 10, 10, 10), (10, 11, 10, 10), (10, 10.1, 9.9, 10), (10, 11.2, 10, 10.5), (10.5, 10.6, 9.5, 9.6), (9.6, 9.7, 9.3, 9.4)]
    got = {r.trade_date.day: (r.hit, r.down, r.trap, round(r.target, 6)) for r in lab.limit_up_3d(bars(spark, rows)).collect()}
    assert got == {1: (1, 0, 0, 1.0), 3: (1, 1, 1, -1.7)}


def test_cusum_resets_one_side(spark):
    closes = [100.0]
    for k in range(140):
        closes.append(closes[-1] * (1.02 if k % 4 in (0, 1) else 0.985))
    state = lab.cusum_state(ramp(spark, closes)).orderBy("trade_date").collect()
    r = [math.log(b / a) for a, b in zip(closes, closes[1:])]
    h, up, down, want = state[0].threshold, 0.0, 0.0, []
    for k, x in enumerate(r):
        up, down = max(0.0, up + x), min(0.0, down + x)
        if down < -h:
            down = 0.0
            want.append(k + 1)
        elif up > h:
            up = 0.0
            want.append(k + 1)
    assert want and [k for k, s in enumerate(state) if s.is_event] == want


def duck(broken=False):
    """60 quiet days, a steep rise to a peak, 22 days of quiet pullback with a turn at its end."""
    rows = [(10, 10.05, 9.95, 10, 100)] * 60
    rows += [(10 + 0.15 * k, 10.2 + 0.15 * k, 9.95 + 0.15 * k, 10.15 + 0.15 * k, 200) for k in range(28)]
    top = 10 + 0.15 * 28
    fall = [top - 0.11 * (k + 1) for k in range(14)]
    volume = [160] * 2 + [90] * 9 + [60] * 11
    back = [fall[-1] + 0.02 * k for k in range(1, 4)] + [fall[-1] + 0.06 + 0.10 * k for k in range(1, 6)]
    closes = fall + back
    rows += [(c + 0.03 if k < 14 else c - 0.03, c + 0.08, c - 0.08, c, v) for k, (c, v) in enumerate(zip(closes, volume))]
    if broken:
        rows[-10] = (rows[-10][0] * 1.06, rows[-10][0] * 1.07, rows[-10][2], rows[-10][3], 500)
    return rows


def test_duck_nostril(spark):
    out = pt.duck_nostril(bars(spark, duck())).collect()
    assert len(out) == 1 and out[0].days_since_duck_peak == 22 and out[0].large_bearish_count == 0
    assert out[0].pullback_low_date == date(2024, 1, 1) + timedelta(days=60 + 28 + 13) and out[0].nostril_cross_date > out[0].pullback_low_date
    assert abs(out[0].duck_peak_price - (10.2 + 0.15 * 27)) < 1e-9 and abs(out[0].peak_to_pullback_drawdown_pct - (1 - (10 + 0.15 * 28 - 0.11 * 14 - 0.08) / (10.2 + 0.15 * 27))) < 1e-9
    assert not pt.duck_nostril(bars(spark, duck(broken=True))).collect()


def double(last):
    rows = [(10, 10.05, 9.95, 10, 100)] * 60
    rows += [(10, 10.6, 10, 10.5, 300), (10.6, 11.6, 10.6, 11.6, 320), (11.7, 12.8, 11.7, 12.8, 330), (12.9, 13.2, 12.5, 13, 340)]
    fall = [(12.4, 240), (11.8, 220), (11.2, 200), (10.8, 120), (10.6, 100), (10.5, 90)]
    return rows + [(c + 0.1, c + 0.2, c - 0.1, c, v) for c, v in fall] + last


def test_double_volume(spark):
    out = pt.double_volume(bars(spark, double([(10.5, 10.7, 10.4, 10.6, 90)]))).collect()
    assert len(out) == 1 and out[0].pattern6_branch == "support_hold" and out[0].support_price == 10.5 and out[0].limit_up_like_count == 2
    assert out[0].anchor_date == date(2024, 3, 1) and out[0].support_touch_date == date(2024, 3, 11)
    broke = pt.double_volume(bars(spark, double([(10.4, 10.5, 10.2, 10.3, 80), (10.3, 10.7, 10.3, 10.6, 95)]))).first()
    assert broke.pattern6_branch == "break_reclaim" and broke.days_to_reclaim == 1 and broke.breakdown_date == date(2024, 3, 11) and broke.post_reclaim_days == 0
    assert not pt.double_volume(bars(spark, double([(10.4, 10.5, 9.5, 9.6, 90)]))).collect()


def test_multi_patterns(spark):
    d = date(2024, 1, 1)
    rows = spark.createDataFrame([(d, "a", 4), (d, "a", 1), (d, "b", 2)], "trade_date date, symbol string, pattern_id int")
    assert [(r.symbol, r.pattern_ids) for r in pt.multi_patterns(rows).collect()] == [("a", [1, 4])]


def test_swings_do_not_overlap(spark):
    c = [("t", "s", 0, 10, 9.0, 0), ("t", "s", 5, 20, 12.0, 0), ("t", "s", 21, 30, 8.0, 0), ("t", "s", 0, 20, 12.0, 1), ("t", "u", 3, 8, 10.0, 0)]
    rows = [(a, b, x, y, date(2024, 1, 1) + timedelta(days=x), date(2024, 1, 1) + timedelta(days=y), r, k) for a, b, x, y, r, k in c]
    df = spark.createDataFrame(rows, "sector_type string, sector_label string, start_pos long, end_pos long, start_date date, end_date date, return_pct double, kind int")
    got = [(r.sector_label, r.start_pos, r.end_pos, r.event_index) for r in ld.select_swings(df).orderBy("sector_label", "start_pos").collect()]
    assert got == [("s", 5, 20, 1), ("s", 21, 30, 2), ("u", 3, 8, 1)]


def test_leaders_of_made_sectors(spark):
    d, rows = date(2020, 1, 1), []
    for k in range(6):
        price = 10.0
        for i in range(200):
            price *= 1 + (0.001 * k + (0.01 if i % 40 < 20 else -0.008))
            rows.append((f"00000{k}", d + timedelta(days=i), price, price, price, price, 100.0, 100.0 * (k + 1), None))
    members = spark.createDataFrame([(f"00000{k}", "industry", "S") for k in range(6)], "symbol string, sector_type string, sector_label string")
    got = ld.leader_scores(spark.createDataFrame(rows, src.BARS), members).orderBy("combined_rank").collect()
    assert [r.symbol for r in got] == [f"00000{k}" for k in (5, 4, 3, 2, 1, 0)] and got[0].long_rank == got[0].swing_rank == 1
    assert got[0].long_score > 90 and got[0].swing_count == 3 and got[0].is_dual_leader and not got[5].is_dual_leader and got[0].leader_tags.startswith("双重龙头")


def test_scores_of_pullbacks(spark):
    one = spark.range(1)
    value = lambda table, x: one.select(F.expr(pb.pieces(f"cast({x} as double)", table))).first()[0]
    assert [value(pb.SLOPE_SCORE, x) for x in (-3, -1.5, -0.75, -0.25, 0, "null")] == [20, 45, 70, 90, 100, 50]
    assert [value(pb.REBOUND_SCORE, x) for x in (-4, -1.5, 2.5, 7.5, 11)] == [20, 55, 90, 70, 45]
    assert [value(pb.TIMING_SCORE, x) for x in (0, 3, 45, 68, 91)] == [20, 50, 100, 60, 35]
    assert [value(pb.depth_score(5, 15, 30), x) for x in (0, 2.5, 10, 22.5, 31)] == [20, 57.5, 100, 52.5, 25]


def test_pool_and_lists(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "symbol string, order int")
    b = spark.createDataFrame([("y", 1), ("z", 2), ("w", 3)], "symbol string, order int")
    assert {r.symbol: r.tags for r in rt.fill_pool(3, ("p", a), ("q", b)).collect()} == {"x": "p", "y": "p/q", "z": "q"}
    days = spark.createDataFrame([(date(2024, 1, k), "s") for k in (1, 2, 5)], "trade_date date, symbol string")
    assert [r.trade_date.day for r in rt.prior_list(days, "2024-01-05").collect()] == [2] and [r.trade_date.day for r in rt.prior_list(days, "2024-01-05", strict=False).collect()] == [5]


def test_constant_series_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "a double, b double")
    assert df.select(ind.corr("a", "b")).first()[0] is None


def test_written_bars_and_reports(spark, tmp_path):
    df = ramp(spark, range(1, 41))
    src.write_bars(df, str(tmp_path / "bars"))
    assert src.read_bars(spark, str(tmp_path / "bars"), ["600000"]).count() == 40 and src.read_bars(spark, str(tmp_path / "bars"), ["1"]).count() == 0
    src.write_report(df.select(F.col("symbol").alias("code"), "close"), str(tmp_path / "report"))
    got = src.read_report(spark, str(tmp_path / "report"), "symbol string, close double", {"code": "symbol"}).collect()
    assert [(r.symbol, r.close) for r in got] == [("600000", 1.0)]


def test_scores_and_position(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 2.0), ("d", "c", 2.0), ("d", "e", None)], "trade_date string, symbol string, v double")
    got = {r.symbol: r.s for r in df.select("symbol", sc.score_100("v", ["trade_date"]).alias("s")).collect()}
    assert got == {"a": 0.0, "b": 100.0, "c": 100.0, "e": None}
    one = spark.range(1).select(ind.position_percent(F.lit(0.05)).alias("p"), src.normalise_symbol(F.lit('="SH600000.0"')).alias("s")).first()
    assert one.p == 23.53 and one.s == "600000"


def test_codes_and_windows(spark):
    one = spark.range(1).select(gt.index_code(F.lit("sh.000001")).alias("a"), gt.index_code(F.lit("399001")).alias("b"), gt.stock_code(F.lit("1")).alias("c"), gt.stock_code(F.lit("688001")).alias("d")).first()
    assert tuple(one) == ("sh000001", "sz399001", "sz000001", "sh688001")
    df = ramp(spark, range(1, 11))
    windows = gt.walk_forward(df, 4, 2, 2, 1)
    assert sorted((r.window_id, r.train_start.day, r.train_end.day, r.valid_start.day, r.valid_end.day) for r in windows.collect()) == [("wf_01", 1, 4, 6, 7), ("wf_02", 3, 6, 8, 9)]
    rows = gt.slice_windows(df, gt.walk_forward(df, 4, 2, 2, 1, anchored=True)).where("window_id = 'wf_02'").collect()
    assert sorted(r.trade_date.day for r in rows if r.split == "train") == [1, 2, 3, 4, 5, 6] and sorted(r.trade_date.day for r in rows if r.split == "valid") == [8, 9]


def test_upsert_and_gaps(spark):
    old, new = ramp(spark, [1, 2, 3]), ramp(spark, [1, 5]).where("close = 5")
    assert [r.close for r in src.upsert(old, new).orderBy("trade_date").collect()] == [1, 5, 3]
    gaps = src.missing_ranges(old, "2023-12-30", "2024-01-05").orderBy("start_date").collect()
    assert [(str(g.start_date), str(g.end_date)) for g in gaps] == [("2023-12-30", "2023-12-31"), ("2024-01-04", "2024-01-05")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    qs.run_latest(stream, lambda b, _: seen.extend(b.collect()), str(tmp_path / "cp")).awaitTermination(120)
    want = {(r.symbol, r.trade_date): r.close for r in qs.latest_quotes(qs.quotes_of(events)).collect()}
    assert {(r.symbol, r.trade_date): r.close for r in seen} == want


def test_analysis_of_a_stream_is_that_of_the_whole_bars(spark, tmp_path):
    """A state advanced by the provisional bar is the recurrence over history and that bar; a batch run twice changes nothing."""
    from quantpanel.streaming import candidates as ca

    d = date(2024, 1, 1)
    rows = [(s, d + timedelta(days=i), p, p, p * 1.02, p * 0.99, 5.0, 50.0, None) for s, k in (("000001", 3), ("000002", 7)) for i in range(90) for p in (20 + (i * k) % 11 + 0.1 * i,)]
    history = spark.createDataFrame(rows, src.BARS)
    quotes = [(s, datetime(2024, 4, 1, h, 0), 30.0 + h, h) for s in ("000001", "000002") for h in (10, 11)]
    kind = "symbol string, quote_datetime timestamp, close double, event_id long"
    for k in (0, 1):
        spark.createDataFrame(quotes[k::2], kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    state, tail = ind.recurrence_state(history), ca.history_tail(history)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    ca.run_analysis(stream, state, tail, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    got = {r.symbol: r for r in ca.refreshed(spark, str(tmp_path / "out")).collect()}
    bar = qs.provisional_bars(qs.latest_quotes(spark.createDataFrame(quotes, kind)))
    whole = {r.symbol: r for r in ind.last_rows(ind.add_recurrences(qs.overlay(history, bar))).collect()}
    crossed = {r.symbol: r.macd_state for r in ind.cross_state(ind.add_recurrences(qs.overlay(history, bar))).collect()}
    features = {r.symbol: r for r in ind.last_rows(lab.base_features(qs.overlay(history, bar))).collect()}
    assert got.keys() == {"000001", "000002"} and all(r.close == 41 for r in got.values())
    for s, r in got.items():
        assert [r.macd_dif, r.macd_dea, r.macd_hist, r.atr_14] == pytest.approx([whole[s].macd_dif, whole[s].macd_dea, whole[s].macd_hist, whole[s].atr_14]) and r.macd_state == crossed[s]
        assert [r.vol_60, r.drawdown_60, r.return_60d] == pytest.approx([features[s].vol_60, features[s].drawdown_60, features[s].return_60d])
    again = ca.analysis(qs.latest_quotes(spark.createDataFrame(quotes, kind)), state, tail).withColumn("batch", F.lit(1).cast("long"))
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(str(tmp_path / "out"))
    assert {r.symbol: r.macd_dif for r in ca.refreshed(spark, str(tmp_path / "out")).collect()} == pytest.approx({s: r.macd_dif for s, r in got.items()})
    short = ind.technicals(ind.advanced(ind.recurrence_state(history.limit(0)), bar)).first()
    assert short.macd_dif is None and short.atr_14 is None


def test_routes_take_ten_sectors_whatever_ties(spark):
    sectors = [("industry", f"S{k:02d}", 2.0 if k < 12 else 1.0 - k, 50.0 + (k == 13)) for k in range(14)] + [("industry", "none", None, None)]
    strength = spark.createDataFrame(sectors, "sector_type string, sector_label string, leader_pct_change double, phase9_score_100 double")
    got = qs.route_sectors(strength).orderBy("route", "place").collect()
    assert [r.sector_label for r in got if r.route == "recent"] == [f"S{k:02d}" for k in range(10)]
    assert [r.sector_label for r in got if r.route == "rotation"] == ["S13"] + [f"S{k:02d}" for k in range(9)]
    rows = [("a", "S00", 50.0, 50.0, 60.0, 50.0, 1.0), ("b", "S00", 30.0, 50.0, 70.0, 50.0, 1.0), ("c", "S01", 50.0, 50.0, 80.0, 50.0, None), ("d", "S11", 90.0, 90.0, 90.0, 50.0, 1.0), ("e", "S13", 60.0, 60.0, 10.0, 51.0, 9.95)]
    pool = spark.createDataFrame(rows, "symbol string, sector_label string, phase1_score_100 double, phase2_score_100 double, phase4_score_100 double, phase9_score_100 double, intraday_pct_change double")
    got = qs.intraday_routes(pool, strength).orderBy("display_rank").collect()
    assert [(r.route, r.route_rank, r.symbol, r.pool_score) for r in got] == [("recent", 1, "b", 74.8), ("recent", 2, "a", 68.0), ("rotation", 1, "a", 68.0)]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region", "events", "part", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT * FROM ({catalog.oracle_sql()[name]}) q").df()
    got = catalog.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got) == len(want)
    key = [c for c in columns if got[c].dtype != float]
    got, want = (x[columns].assign(**{c: x[c].astype(str).str.replace(" 00:00:00", "", regex=False).replace("NaT", "None") for c in key}).sort_values([*key, *[c for c in columns if c not in key]]).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if c in key:
            assert list(got[c]) == list(want[c]), c
        else:
            a, b = got[c].astype(float), want[c].astype(float)
            assert (((a - b).abs() < 3e-6) | (a.isna() & b.isna())).all(), c
