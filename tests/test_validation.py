"""Fits of many windows at once, their embargo and reports, strict strategies, membership, watchlists and crash moments."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantpanel.operators import gates as gt
from quantpanel.operators import membership as mb
from quantpanel.operators import strict as st
from quantpanel.operators import walkforward as wf
from quantpanel.operators import watchlist as wl

X = ["a", "b", "c"]


def made_panel(spark, days=160, per_day=12, seed=1):
    rng = np.random.default_rng(seed)
    n = days * per_day
    pdf = pd.DataFrame({"trade_date": [date(2020, 1, 1) + timedelta(days=int(k // per_day)) for k in range(n)], "symbol": [f"{k % per_day:06d}" for k in range(n)]})
    pdf[X] = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 1.0]
    eta = 0.8 * pdf["a"] - 0.2 * (pdf["b"] - 2) + 3 * (pdf["c"] - 1)
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    pdf["r"] = eta + rng.normal(size=n) * 0.1
    pdf["future_return_5d"], pdf["future_min_return_5d"] = -pdf["r"] / 10, -np.maximum(pdf["r"], 0) / 10
    return pdf, spark.createDataFrame(pdf)


def test_groups_are_fitted_as_each_alone(spark):
    """Logistic fits are where the penalised gradient is none, regressions solve their equations, Bayes is its densities."""
    pdf, df = made_panel(spark)
    pdf["g"] = pdf["symbol"].astype(int) % 2
    got = {(r.g, r.model_name): r for r in wf.fit_groups(df.withColumn("g", F.col("symbol").cast("int") % 2), ["g"], X, "y", ("prior", "logistic", "gaussian")).collect()}
    reg = {r.g: r for r in wf.fit_groups(df.withColumn("g", F.col("symbol").cast("int") % 2), ["g"], X, "r", ("ridge",)).collect()}
    assert len(got) == 6 and len(reg) == 2
    for g in (0, 1):
        part = pdf[pdf["g"] == g]
        x, y = part[X].to_numpy(), part["y"].to_numpy()
        mean, sd = x.mean(axis=0), x.std(axis=0)
        r = got[g, "logistic"]
        e = y - 1 / (1 + np.exp(-(r.bias + x @ np.array(r.lin))))
        assert abs(e.sum()) < 1e-5 and np.abs(((x - mean) / sd).T @ e - np.array(r.lin) * sd).max() < 1e-5
        z = (x - mean) / sd
        beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (part["r"] - part["r"].mean()))
        assert reg[g].lin == pytest.approx(list(beta / sd)) and got[g, "prior"].bias == pytest.approx(y.mean()) and r.train_rows == len(part)
        r = got[g, "gaussian"]
        dens = [sum(-((x[:, j] - x[y == c, j].mean()) ** 2) / 2 / x[y == c, j].var() - 0.5 * np.log(x[y == c, j].var()) for j in range(3)) + np.log((y == c).mean()) for c in (0, 1)]
        assert np.allclose(r.bias + x @ np.array(r.lin) + x**2 @ np.array(r.quad), dens[1] - dens[0], atol=1e-5)


def test_groups_of_one_label_or_few_rows(spark):
    _, df = made_panel(spark, days=40)
    one = df.withColumn("y", F.lit(1)).withColumn("g", F.lit("x")).unionByName(df.limit(50).withColumn("g", F.lit("few")))
    got = wf.fit_groups(one, ["g"], X, "y", ("logistic", "gaussian")).collect()
    assert {(r.g, r.model_name, r.link, r.bias) for r in got} == {("x", "logistic", "identity", 1.0), ("x", "gaussian", "identity", 1.0)}
    assert wf.fit_groups(df.limit(0).withColumn("g", F.lit("x")), ["g"], X, "y", ("ridge", "logistic")).collect() == []


def test_embargo_keeps_leaked_labels_out(spark):
    """A label that is known ten days on: no row is trained on whose label reaches into the valid days."""
    _, df = made_panel(spark)
    windows = gt.walk_forward(df, 60, 30, 30, 10)
    rows = gt.slice_windows(df, windows).groupBy("window_id", "split").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")).collect()
    at = {(r.window_id, r.split): r for r in rows}
    assert len(at) == 6 and all((at[w, "valid"].lo - at[w, "train"].hi).days > 10 for w, _ in at)
    scored = wf.walk_forward(df, windows, X, "y", ("logistic", "prior"))
    assert scored.groupBy("window_id", "model_name").count().orderBy("window_id").count() == 6
    report = {(r.model_name): r for r in wf.walk_summary(wf.window_metrics(scored.withColumn("risk_label", F.col("y")), ["model_name", "window_id"]), wf.risk_deciles(scored.withColumn("risk_label", F.col("y")), ["model_name", "window_id"]), ["model_name"]).collect()}
    assert report["logistic"].passed and report["logistic"].windows == 3 and not report["prior"].passed
    impact = wf.filter_impact(scored.withColumn("risk_label", F.col("y")), ["model_name", "window_id"], (0.2, 0.5))
    both = wf.comparison(wf.walk_summary(wf.window_metrics(scored.withColumn("risk_label", F.col("y")), ["model_name", "window_id"]), wf.risk_deciles(scored.withColumn("risk_label", F.col("y")), ["model_name", "window_id"]), ["model_name"]), wf.filter_summary(impact, ["model_name"]), ["model_name"])
    assert {r.model_name: (r.filter_rate, r.phase_pass) for r in both.collect()}["logistic"][0] == 0.2


def test_settings_have_models_of_their_own(spark):
    _, df = made_panel(spark)
    both = df.withColumn("config_id", F.lit("p")).unionByName(df.withColumn("y", 1 - F.col("y")).withColumn("config_id", F.lit("q")))
    scored = wf.walk_forward(both, gt.walk_forward(df, 60, 30, 30, 10), X, "y", ("logistic",), by=("config_id",))
    sums = {r.config_id: r.s for r in scored.groupBy("config_id").agg(F.corr("risk_score", "r").alias("s")).collect()}
    assert sums["p"] > 0.9 and sums["q"] < -0.9


def test_scores_of_a_window_with_one_label_have_no_correlation(spark):
    rows = [("a", k / 10, k % 2, 7) for k in range(6)] + [("b", k / 10, 0, 8) for k in range(6)] + [("c", 0.3, k % 2, 9) for k in range(6)]
    df = spark.createDataFrame(rows, "window_id string, risk_score double, y int, train_rows long")
    got = {r.window_id: (r.train_rows, r.score_label_corr) for r in wf.label_correlation(df, ["window_id"], "y").collect()}
    assert got["b"] == (8, None) and got["c"] == (9, None) and got["a"] == (7, pytest.approx(np.corrcoef(np.arange(6), np.arange(6) % 2)[0, 1]))


def test_filter_removes_of_the_whole_group(spark):
    """Five rows over two days, 40 %: the two of the highest score go, wherever they lie; ties go by symbol."""
    rows = [("w", date(2024, 1, d), s, x, y, r, m) for d, s, x, y, r, m in ((1, "a", 0.9, 1, -0.1, -0.2), (1, "b", 0.8, 1, -0.2, -0.4), (1, "c", 0.8, 0, 0.1, -0.1), (2, "d", 0.1, 0, 0.2, 0.0), (2, "e", 0.2, 0, 0.0, 0.0), (2, "f", 0.99, 1, None, 0.0))]
    df = spark.createDataFrame(rows, "window_id string, trade_date date, symbol string, risk_score double, risk_label int, future_return_5d double, future_min_return_5d double")
    r = wf.filter_impact(df, ["window_id"], (0.4,)).first()
    assert (r.rows, r.removed_rows, r.kept_rows) == (5, 2, 3) and r.kept_return == pytest.approx(0.1) and r.removed_drawdown == pytest.approx(-0.3) and r.filter_pass
    assert r.kept_risk_label_rate == 0 and r.risk_label_rate_delta == pytest.approx(-0.4)


def test_strict_strategies_by_hand(spark):
    rows = [("s", date(2024, 1, 2), f"{k:06d}", p1, p2, p4, allow, safe) for k, (p1, p2, p4, allow, safe) in enumerate([(95.0, 95.0, 91.0, "allow", None), (80.0, 80.0, 75.0, "no_trade", 90.0), (35.0, 60.0, 99.0, "allow", 50.0), (45.0, 45.0, 80.0, "allow", 50.0)])]
    df = spark.createDataFrame(rows, "w string, trade_date date, symbol string, phase1_score_100 double, phase2_score_100 double, phase4_score_100 double, phase7_trade_permission string, phase5_score_100 double")
    p1, p2, p4 = (F.col(f"phase{k}_score_100") for k in (1, 2, 4))
    from quantpanel.operators.scores import centred, mixed_scores

    df = mixed_scores(df).withColumns({"mixed_010_score": p4 + 0.1 * p1 + 0.1 * p2, "phase1_center_score": centred(p1), "phase2_center_score": centred(p2)})
    got = {}
    for r in st.strict_picks(df, n=2).orderBy("strategy", "selected_rank").collect():
        got.setdefault(r.strategy, []).append(int(r.symbol))
    assert got["phase4_top20"] == [2, 0] and got["phase4_top20_p12_ge40"] == [0, 3] and got["phase4_top20_p12_ge30"] == [2, 0]
    assert got["mixed_top20"] == [0, 1] and got["mixed_010_top20"] == [0, 1] and got["mixed_top20_phase7_allow"] == [0, 3] and got["mixed_top20_phase5_safe"] == [1, 3]
    assert got["centered_risk_top20"] == [0, 1] and got["all90"] == [0] and len(got["random_top20"]) == 2
    picks = st.strict_picks(df, n=2)
    counts = {(r.strategy): r.candidate_count for r in st.candidate_counts(picks.where("strategy <> 'all90'"), df).collect()}
    assert counts["all90"] == 0 and counts["mixed_top20"] == 2
    out = spark.createDataFrame([("000000", date(2024, 1, 2), 0.1, 0.2, -0.1), ("000001", date(2024, 1, 2), -0.05, 0.0, -0.2)], "symbol string, trade_date date, return_5d double, max_profit_5d double, max_drawdown_5d double")
    one = st.strict_summary(st.strict_trades(picks, out, (5,)), st.candidate_counts(picks, df)).where("strategy = 'mixed_top20'").first()
    assert one.trade_count == 2 and one.payoff_ratio == pytest.approx(2.0) and one.expectancy == pytest.approx(0.025) and one.no_candidate_day_rate == 0


def test_membership_versions_by_hand(spark):
    d = lambda k: date(2024, 1, k)
    rows = [(d(1), "x", "industry", "A"), (d(1), "x", "concept", "C"), (d(1), "y", "industry", "A"), (d(5), "x", "industry", "ignored"), (d(10), "x", "industry", "B"), (d(10), "y", "industry", "A"), (d(20), "x", "industry", "A"), (d(20), "x", "concept", "D"), (d(20), "x", "concept", "D"), (None, "z", "industry", "A")]
    df = spark.createDataFrame(rows, "batch_date date, symbol string, sector_type string, sector_label string")
    assert [r.batch_date.day for r in mb.refresh_dates(df).orderBy("batch_date").collect()] == [1, 10, 20]
    v = mb.versions(df)
    got = {(r.symbol, r.sector_type, r.sector_label, r.valid_from.day, r.valid_to and r.valid_to.day) for r in v.collect()}
    assert got == {("x", "industry", "A", 1, 10), ("x", "industry", "B", 10, 20), ("x", "industry", "A", 20, None), ("y", "industry", "A", 1, 20), ("x", "concept", "C", 1, 20), ("x", "concept", "D", 20, None)}
    assert {(r.symbol, r.sector_label) for r in mb.as_of(v, "2024-01-15").collect()} == {("x", "B"), ("y", "A"), ("x", "C")}
    days = spark.createDataFrame([("x", d(9)), ("x", d(10)), ("y", d(20))], "symbol string, trade_date date")
    assert {(r.symbol, r.trade_date.day, r.sector_label) for r in mb.as_of_days(days, v).collect()} == {("x", 9, "A"), ("x", 9, "C"), ("x", 10, "B"), ("x", 10, "C")}
    assert mb.versions(df.limit(0)).collect() == []


def test_names_and_cleaning(spark):
    rows = [("x", "industry", "B", 2), ("x", "industry", "A", 1), ("x", "concept", " C ", 3), ("x", "industry", "B", 0), ("x", "concept", None, 1), ("y", "concept", "", 1)]
    df = spark.createDataFrame(rows, "symbol string, sector_type string, sector_label string, no int")
    assert {(r.symbol, r.industry_names, r.concept_names) for r in mb.sector_names(df, "no").collect()} == {("x", "B/A", "C"), ("y", "", "")}
    names = ["银行", "摘帽", "业绩预增概念", "公司主营产品研发与生产销售业务并专注行业体系建设等内容", "甲" * 30, None]
    got = mb.clean_membership(spark.createDataFrame([("x", "concept", n) for n in names], "symbol string, sector_type string, sector_label string"))
    assert {r.sector_label for r in got.collect()} == {"银行", "甲" * 30, None}


def test_pool_fills_and_tags(spark):
    d = date(2024, 1, 2)
    kinds = "trade_date date, symbol string, centered_risk_score double, phase4_score_100 double, phase1_center_score double, phase2_center_score double, phase8_score_100 double, phase8_rank int, limit_up boolean, today_limit_up_excluded boolean, pattern_priority double"
    rows = [(d, s, c, c, 0.0, 0.0, p8, k, up, False, pp) for k, (s, c, p8, up, pp) in enumerate([("a", 90.0, 10.0, False, None), ("b", 80.0, 99.0, False, None), ("c", 70.0, 98.0, False, None), ("d", None, 97.0, False, None), ("e", 60.0, 96.0, True, 5.0), ("f", 10.0, 95.0, False, None)])]
    patterns = spark.createDataFrame([(d, "e", "1"), (d, "q", "4")], "trade_date date, symbol string, pattern_id string")
    got = wl.intraday_pool(spark.createDataFrame(rows, kinds), patterns, pattern_limit=2, top=1, size=5).orderBy("pool_rank").collect()
    assert [(r.symbol, r.source, r.tags) for r in got] == [("e", "pattern_pool", "pattern_pool"), ("q", "pattern_pool", "pattern_pool"), ("a", "p124_top1", "p124_top1"), ("b", "p8_fill", "p8_fill"), ("c", "p8_fill", "p8_fill")]
    more = wl.intraday_pool(spark.createDataFrame(rows, kinds), patterns, pattern_limit=0, top=2, size=4).orderBy("pool_rank").collect()
    assert [(r.symbol, r.tags) for r in more] == [("a", "p124_top2"), ("b", "p124_top2/p8_fill"), ("c", "p8_fill"), ("d", "p8_fill")]


def test_tiers_of_patterns(spark):
    kinds = "trade_date date, symbol string, name string, pattern_id string, risk_score double, atr_pct_14 double, macd_cross_state string, macd_divergence_state string, volume_price_divergence_state string, macd_top_divergence_15d boolean, macd_bottom_divergence_15d boolean, bullish_volume_price_divergence_flag boolean, bearish_volume_price_divergence_flag boolean"
    d = date(2024, 1, 2)
    rows = [(d, "a", "x", "5", 0.4, 3.0, "Golden_Cross", None, None, None, True, None, None), (d, "b", "沪深 300", "5", 0.1, None, None, None, None, None, None, None, None), (d, "c", "y", "6", 2.0, 0.5, None, "bottom_divergence", "bullish", None, None, True, None), (d, "e", "z", "1", None, None, "dead_cross", None, None, None, None, None, None), (d, "f", "w", "2", float("nan"), None, None, None, None, None, None, None, None)]
    got = wl.pattern_watchlist(spark.createDataFrame(rows, kinds)).orderBy("list_rank").collect()
    assert [(r.symbol, r.base_tier, r.stable_score) for r in got] == [("a", "第一梯队", 7.57), ("f", "第三梯队", 2.0), ("c", "第二梯队", 5.0)]


def test_reports_of_dealt_scores_are_those_of_whole_groups(spark, monkeypatch):
    """Groups cut into parts, with ties within and across models: the same reports as from plain sorts, and no row leaves its task to be fitted."""
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame({"model_name": rng.choice(["m", "k", "prior"], n), "window_id": rng.choice(["wf_01", "wf_02"], n), "symbol": [f"{k:06d}" for k in range(n)], "trade_date": [date(2020, 1, 1) + timedelta(days=int(k)) for k in rng.integers(0, 50, n)], "risk_score": rng.integers(0, 60, n) / 60, "risk_label": rng.integers(0, 2, n), "future_return_5d": rng.normal(size=n), "future_min_return_5d": -rng.random(n)})
    pdf.loc[pdf["model_name"] == "prior", "risk_score"] = 0.25
    pdf.loc[::17, "future_return_5d"] = None
    df = spark.createDataFrame(pdf).withColumn("future_return_5d", F.nanvl("future_return_5d", F.lit(None).cast("double")))
    by, rates = ["model_name"], (0.1, 0.2)
    group = [*by, "window_id"]
    monkeypatch.setattr(wf, "PART_ROWS", 20)
    got = {r.model_name: r for r in wf.judged(wf.risk_cells(df, group, rates), by, rates).collect()}
    metrics = {(r.model_name, r.window_id): r for r in wf.window_metrics(df, group).collect()}
    parts = wf._dealt(df.withColumn("p", F.lit(1)), group, ["risk_score"], {"p": F.col("p")})[1].values()
    assert len(parts) > 20 and {g for g, *_ in parts if sum(g == x[0] for x in parts) == 1} == {("prior", "wf_01"), ("prior", "wf_02")}
    filters = wf.filter_summary(wf.filter_impact(df, group, rates), by)
    want = {r.model_name: r for r in wf.comparison(wf.walk_summary(wf.window_metrics(df, group), wf.risk_deciles(df, group), by), filters, by).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].asDict() == pytest.approx(r.asDict()), k
    for (m, w), r in metrics.items():
        part = pdf[(pdf["model_name"] == m) & (pdf["window_id"] == w)]
        s, y = part["risk_score"].to_numpy(), part["risk_label"].to_numpy()
        above = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
        assert r.roc_auc == pytest.approx(above) and r.rows == len(part) and r.pr_auc == pytest.approx(np.mean([y[s >= v].mean() for v in s[y == 1]]))


def test_rows_stay_where_they_lie_in_fits_of_windows(spark):
    """A row of several windows is told to them in its batch: the fits are those of the windows' own rows, and nothing but sums is shuffled."""
    _, df = made_panel(spark)
    windows = gt.walk_forward(df, 60, 30, 30, 10, anchored=True)
    got = {(r.window_id, r.model_name): r for r in wf.fit_groups(df, ["window_id"], X, "y", ("logistic", "gaussian", "prior"), windows=windows.collect()).collect()}
    dealt = gt.slice_windows(df, windows).where("split = 'train'")
    want = {(r.window_id, r.model_name): r for r in wf.fit_groups(dealt, ["window_id"], X, "y", ("logistic", "gaussian", "prior")).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    for k, r in want.items():
        assert (got[k].bias, got[k].train_rows) == (pytest.approx(r.bias), r.train_rows) and got[k].lin == pytest.approx(r.lin) and got[k].quad == pytest.approx(r.quad)


def test_models_of_one_panel_score_rows_without_a_join(spark):
    """The same rows and scores as from scored frames that are joined; outcomes are met where they lie."""
    _, df = made_panel(spark)
    at = gt.walk_forward(df, 60, 30, 30, 10).collect()
    fits = [(c, wf.fit_groups(df, ["window_id"], X, y, (k,), windows=at)) for c, y, k in (("phase1_risk", "y", "logistic"), ("phase2_risk", "y", "gaussian"), ("phase4_return", "r", "ridge"))]
    valid = wf.valid_rows(df, at)
    one = wf.score_models(valid, fits, ["window_id"], X)
    parts = [wf.score_groups(valid, p, ["window_id"], X) for _, p in fits]
    want = {(r.window_id, r.trade_date, r.symbol): r for r in st.joined(*parts).collect()}
    got = {(r.window_id, r.trade_date, r.symbol): r for r in one.collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 30 * 12
    assert all(got[k][c] == pytest.approx(want[k][c]) for k in want for c, _ in fits)
    assert "SortMergeJoin" not in one._jdf.queryExecution().executedPlan().toString()
    outcomes = df.select("symbol", "trade_date", *[F.col("r").alias(f"{c}_5d") for c in ("return", "max_profit", "max_drawdown")]).where("trade_date > '2020-02-01'")
    picks = df.where("symbol < '000003'").select(F.lit("s").alias("strategy"), "trade_date", "symbol", F.lit(1).alias("selected_rank"))
    assert sorted(st.met_trades(picks, outcomes, (5,)).collect()) == sorted(st.strict_trades(picks, outcomes, (5,)).collect())
