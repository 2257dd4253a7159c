"""Stored bars, reports, exports and panels: written, written again and read back."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quantpanel.operators import backtest as bt
from quantpanel.sources import bars as src
from quantpanel.sources import exports as ex
from quantpanel.sources import panels


def bar(s, day, close):
    return (s, day, close, close, close, close, 1.0, 1.0, 0.0)


def test_a_month_written_again_keeps_its_other_symbols(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = [bar(s, d, 1.0) for s in ("a", "b") for d in (date(2024, 1, 3), date(2024, 1, 4), date(2024, 2, 1))]
    src.write_bars(spark.createDataFrame(first, src.BARS), path)
    src.write_bars(spark.createDataFrame([bar("a", date(2024, 1, 4), 2.0), bar("c", date(2024, 1, 5), 3.0)], src.BARS), path)
    got = {(r.symbol, r.trade_date): r.close for r in src.read_bars(spark, path).collect()}
    assert got == {(s, d): 1.0 for s, d, *_ in first} | {("a", date(2024, 1, 4)): 2.0, ("c", date(2024, 1, 5)): 3.0}
    assert [p.name for p in tmp_path.iterdir()] == ["bars"]


def test_the_first_row_of_a_report_is_the_first_of_its_file(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text("代码,分\nx,9\ny,1\nx,2\n")
    (tmp_path / "r" / "b.csv").write_text("代码,分\nx,1\nz,5\n")
    got = src.read_report(spark, str(tmp_path / "r"), "symbol string, score double", {"代码": "symbol", "分": "score"}).collect()
    assert {(r.symbol, r.score) for r in got} == {("x", 9.0), ("y", 1.0), ("z", 5.0)}


def test_exports_read_back_equal(spark, tmp_path):
    rows = [("000001", "甲,\"乙\"", date(2024, 1, 2), 10.123456, 0.5, 0.0493876, 9.6, 9.1, 11.1, 11.6, "medium"), ("000002", None, date(2024, 1, 2), 5.0, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, name string, trade_date date, close double, atr_14 double, atr_pct_14 double, atr_stop_1 double, atr_stop_2 double, atr_take_2 double, atr_take_3 double, atr_regime string")
    out = ex.atr_export(df)
    assert out.columns == list(ex.ATR_LABELS.values())
    path = str(tmp_path / "atr")
    ex.write_csv(out, path)
    raw = next((tmp_path / "atr").glob("*.csv")).read_bytes()
    assert raw.startswith("﻿代码".encode())
    (r,) = ex.read_csv(spark, path, ex.ATR_LABELS).collect()
    assert (r.symbol, r["name"], r.trade_date, r.close, r.atr_14, r.atr_stop_loss_1x, r.atr_volatility_regime) == ("000001", "甲,\"乙\"", "2024-01-02", "10.1235", "0.5", "9.6", "medium") and r.atr_pct_14 == pytest.approx(0.049388)


def test_watchlists_are_flat_and_keep_codes(spark, tmp_path):
    df = spark.createDataFrame([(2, "7", 55.55555, ["1", "5"]), (1, "000009", None, [])], "list_rank int, symbol string, centered_risk_score double, pattern_ids array<string>")
    path = str(tmp_path / "list")
    ex.write_csv(ex.watchlist_export(df), path)
    got = ex.read_csv(spark, path, ex.LIST_LABELS)
    assert [(r.symbol, r.centered_risk_score, r.pattern_ids) for r in got.collect()] == [("000009", None, "[]"), ("000007", "55.5556", '["1","5"]')]


def test_panels_join_without_an_exchange(spark):
    spark.sql("DROP TABLE IF EXISTS made_features")
    spark.sql("DROP TABLE IF EXISTS made_labels")
    days = [date(2024, 1, 30) + timedelta(days=k) for k in range(5)]
    rows = [(f"{s:06d}", d, float(s), float(d.day)) for s in range(20) for d in days]
    features = spark.createDataFrame(rows, "symbol string, trade_date date, a double, b double")
    labels = features.where("a < 15 and b <> 31").select("symbol", "trade_date", (F.col("a") > 7).cast("int").alias("risk_label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panels.save_panel(features, "made_features", 4)
        panels.save_panel(labels, "made_labels", 4)
        joined = panels.joined_panel(spark, "made_features", "made_labels", ["a", "risk_label"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == labels.count() and joined.where("risk_label <> cast(a > 7 as int)").count() == 0
        fresh = features.where("b <= 3").withColumn("a", F.lit(-1.0)).where("symbol < '000003'")
        panels.refresh_months(fresh, "made_features")
        seen = {(r.symbol, r.trade_date): r.a for r in spark.table("made_features").collect()}
        assert len(seen) == 20 * 2 + 3 * 3 and seen["000001", date(2024, 2, 1)] == -1 and seen["000019", date(2024, 1, 30)] == 19
        assert [r.symbol for r in panels.skipped_symbols(features, labels).orderBy("symbol").collect()] == [f"{s:06d}" for s in range(15, 20)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.sql("DROP TABLE IF EXISTS made_features")
        spark.sql("DROP TABLE IF EXISTS made_labels")


def test_mixed_picks_need_both_risk_scores(spark):
    d = date(2024, 1, 2)
    rows = [(d, f"{k:06d}", p1, p2, p4, p4 + 0.2 * (p1 + p2), True, True, False, p4, "s", None, None) for k, (p1, p2, p4) in enumerate([(50.0, 50.0, 60.0), (39.0, 99.0, 99.0), (60.0, 40.0, 61.0), (50.0, 50.0, 60.0)])]
    base = spark.createDataFrame(rows, "trade_date date, symbol string, phase1_score_100 double, phase2_score_100 double, phase4_score_100 double, mixed_score double, phase1_pass boolean, phase2_pass boolean, pattern_match boolean, phase4_return double, seed string, pattern_priority double, phase5_score_100 double")
    picks = {}
    for r in bt.component_strategies(base, n=2, phase4_n=2).orderBy("strategy", "selected_rank").collect():
        picks.setdefault(r.strategy, []).append(int(r.symbol))
    assert picks["phase1_phase2_phase4_mixed_top20"] == [2, 0] and picks["current_watchlist_without_phase7"] == [2, 0] and picks["phase4_top"] == [1, 2]
