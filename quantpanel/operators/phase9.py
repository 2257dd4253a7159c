"""Sector panel of the buy model: features of each sector and day, its label and the long mainline score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import full
from .pullback import KEY, MEMBERS, PARTS, benchmark, buy_parts, pieces, prepared_members
from .scores import linear_score

# Spans of the features, pieces and weights of the long score, label.
RETURNS, MEANS = (1, 3, 5, 10, 20, 60, 120, 252, 504), (5, 10, 20, 60, 120, 240)
DRAWDOWN_SCORE = [("x < -35", None, None, 15, 15), ("x < -20", -35, -20, 25, 60), ("x < -8", -20, -8, 60, 100), (None, None, None, 100, 100)]
CALM_SCORE = [("x <= 0.9", None, None, 100, 100), ("x <= 1.3", 0.9, 1.3, 100, 55), ("x <= 1.8", 1.3, 1.8, 55, 25), (None, None, None, 15, 15)]
#: Difference of two daily returns that is rounding.
TIE = 1e-9
HORIZON, RISE, KEPT_SCORE, KEPT_SHARE = 20, 0.05, 70.0, 0.20


def sector_panel(bars: DataFrame, members: DataFrame, least: int = MEMBERS) -> DataFrame:
    """Features, long score and label of each sector and day of the market calendar."""
    members = prepared_members(members, least)
    day = bars.join(members, "symbol").groupBy(*KEY, "trade_date").agg(F.avg("pct_change").alias("ret"), F.count("pct_change").alias("valid_count"), F.sum("amount").alias("amount"))
    grid = benchmark(bars).crossJoin(F.broadcast(members.select(*KEY, "member_count").distinct()))  # days by sectors, dimensions
    df = grid.join(day, [*KEY, "trade_date"], "left").fillna(0.0, ["ret", "amount", "bench_ret"]).fillna(0, ["valid_count"])
    w = Window.partitionBy(*KEY).orderBy("trade_date")
    f = lambda n: w.rowsBetween(1 - n, 0)
    total = lambda c: 100 * F.exp(F.sum(F.log1p(F.col(c) / 100)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"v": total("ret"), "b": total("bench_ret"), "pos": F.row_number().over(w)})
    df = df.withColumns({f"m{n}": full(F.avg, "v", n, f(n)) for n in MEANS} | {f"a{n}": full(F.avg, "amount", n, f(n)) for n in (5, 10, 20, 60)} | {f"low{n}": full(F.min, "v", n, f(n)) for n in (20, 60)} | {"bench_1d": (F.try_divide("b", F.lag("b").over(w)) - 1) * 100})
    back = lambda c, n: (F.try_divide(F.col(c), F.lag(c, n).over(w)) - 1) * 100
    seen = lambda c, n, least: F.when(F.count("v").over(f(n)) >= least, c)
    at_low = lambda n: F.coalesce(F.col("v") <= F.col(f"low{n}") * 1.002, F.lit(False))
    calm = lambda low, days: F.when(F.col("pos") >= max(low, days), (~F.bool_or(at_low(low)).over(f(days))).cast("double"))
    share = lambda c, n, least: seen(F.avg(F.coalesce(c, F.lit(False)).cast("double")).over(f(n)), n, least)
    up, better = F.col("ret") > 0, F.col("ret") > F.col("bench_1d") + TIE
    peak = lambda n, least: seen((F.try_divide(F.col("v"), F.max("v").over(f(n))) - 1) * 100, n, least)
    since = lambda n, least: seen(F.col("pos") + F.max(F.struct(F.round("v", 9).alias("v"), (-F.col("pos")).alias("p"))).over(f(n))["p"], n, least)
    cols = {f"return_{n}d": back("v", n) for n in RETURNS} | {f"benchmark_return_{n}d": back("b", n) for n in RETURNS} | {f"excess_return_{n}d": back("v", n) - back("b", n) for n in RETURNS}
    cols |= {f"close_above_ma{n}": F.coalesce(F.col("v") > F.col(f"m{n}"), F.lit(False)).cast("double") for n in MEANS} | {f"ma{n}_slope_pct": back(f"m{n}", 5) for n in MEANS} | {f"distance_to_ma{n}_pct": (F.try_divide("v", f"m{n}") - 1) * 100 for n in MEANS}
    cols |= {"drawdown_from_peak_120d_pct": peak(120, 20), "drawdown_from_peak_252d_pct": peak(252, 60), "days_since_peak_120d": since(120, 20).cast("double"), "days_since_peak_252d": since(252, 60).cast("double")} | {f"distance_to_recent_low_{n}d_pct": (F.try_divide("v", f"low{n}") - 1) * 100 for n in (20, 60)}
    cols |= {"no_new_20d_low_in_5d": calm(20, 5), "no_new_60d_low_in_5d": calm(60, 5), "no_new_20d_low_in_10d": calm(20, 10), "volatility_5d": full(F.stddev_samp, "ret", 5, f(5)), "volatility_20d": full(F.stddev_samp, "ret", 20, f(20))} | {f"up_ratio_{n}d": share(up, n, n) for n in (3, 5, 20)}
    cols |= {"outperform_ratio_20d": share(better, 20, 20), "outperform_ratio_60d": share(better, 60, 60), "outperform_ratio_252d": share(better, 252, 120), "amount_ratio_5d_20d": F.try_divide("a5", "a20"), "amount_ratio_5d_60d": F.try_divide("a5", "a60"), "valid_ratio": F.least(F.lit(1.0), F.try_divide("valid_count", "member_count"))}
    cols |= {"down_amount_ratio_10d": seen(F.try_divide(F.avg(F.when(F.col("ret") < 0, F.col("amount")).otherwise(0.0)).over(f(10)), F.col("a10")), 10, 10), "sector_type_code": (F.col("sector_type") == "concept").cast("double")}
    ahead = w.rowsBetween(1, HORIZON)
    cols |= {"future_return_20d_close": F.try_divide(F.lead("v", HORIZON).over(w), F.col("v")) - 1, "future_max_return_20d": F.try_divide(F.max("v").over(ahead), F.col("v")) - 1, "future_min_return_20d": F.try_divide(F.min("v").over(ahead), F.col("v")) - 1}
    df = df.withColumns(cols).withColumns({"volatility_ratio_5d_20d": F.try_divide("volatility_5d", "volatility_20d"), "recent_down_speed_5d": F.col("return_5d"), "phase9_label": F.when(F.col("future_return_20d_close").isNotNull(), (F.col("future_return_20d_close") >= RISE).cast("int"))})
    return long_mainline(df).drop("b", "bench_ret", "bench_1d", *[f"m{n}" for n in MEANS], "a5", "a10", "a20", "a60", "low20", "low60").withColumnRenamed("v", "latest_index")


def long_mainline(df: DataFrame) -> DataFrame:
    """Excess, outperformance, trend and resilience of a sector as one score (K29); a missing part counts 50."""
    x = lambda c, lo, hi: linear_score(F.col(c), lo, hi)
    trend = 0.35 * x("ma60_slope_pct", -2.0, 2.0) + 0.35 * x("ma120_slope_pct", -3.0, 3.0) + 0.15 * x("distance_to_ma60_pct", -8.0, 8.0) + 0.15 * x("distance_to_ma120_pct", -12.0, 12.0)
    hold = 0.70 * F.expr(pieces("drawdown_from_peak_252d_pct", DRAWDOWN_SCORE)) + 0.30 * F.expr(pieces("volatility_ratio_5d_20d", CALM_SCORE))
    score = 0.25 * x("excess_return_504d", -10.0, 60.0) + 0.20 * x("excess_return_252d", -5.0, 40.0) + 0.20 * x("outperform_ratio_252d", 0.45, 0.60) + 0.20 * trend + 0.15 * hold
    return df.withColumns({"long_mainline_trend_score": trend, "long_mainline_resilience_score": hold, "long_mainline_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))})


def keep_mainline(panel: DataFrame) -> DataFrame:
    """Rows of a score of 70 or more, or of the first fifth of their day."""
    w = Window.partitionBy("trade_date")
    rank = F.row_number().over(w.orderBy(F.desc("long_mainline_score"), *KEY))
    return panel.withColumn("_p", rank / F.count(F.lit(1)).over(w)).where((F.col("long_mainline_score") >= KEPT_SCORE) | (F.col("_p") <= KEPT_SHARE)).drop("_p")


def rule_buy_scores(panel: DataFrame) -> DataFrame:
    """panel with the rule buy score and its five parts for every sector and day.

    The rules of the last day's scores, on the panel's own columns: the peak is the highest value of the last 120 days. A
    missing age of the peak counts as none; other missing values as the rules say.
    """
    true = lambda c: F.when(F.col(c).isNotNull(), F.col(c) >= 0.5)
    as_is = ["sector_type", "return_3d", "return_5d", "excess_return_3d", "up_ratio_3d"]
    df = panel.select(
        F.struct("*").alias("_row"), *as_is, F.col("drawdown_from_peak_120d_pct").alias("drawdown_from_peak_pct"), F.coalesce("days_since_peak_120d", F.lit(0.0)).alias("days_since_peak"), F.col("volatility_ratio_5d_20d").alias("volatility_ratio"),
        F.col("distance_to_recent_low_20d_pct").alias("distance_to_recent_low"), F.col("down_amount_ratio_10d").alias("down_amount_ratio"), *[F.col(f"ma{n}_slope_pct").alias(f"slope_{n}") for n in (5, 10, 20, 60)],
        *[true(c).alias(c) for c in ("no_new_20d_low_in_5d", "no_new_60d_low_in_5d", "no_new_20d_low_in_10d", "close_above_ma5", "close_above_ma10", "close_above_ma20")],
    )
    return buy_parts(df).select("_row.*", F.col("buy_score").alias("rule_buy_score"), *[F.col(c).alias(f"rule_{c}") for c in PARTS])
