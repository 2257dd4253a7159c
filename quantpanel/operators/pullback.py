"""Pullbacks of sectors from their last peak: peaks, technical metrics, piecewise scores, caps and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_symbol, full
from .sectors import newest_days

KEY = ["sector_type", "sector_label"]
# Half the width of a peak, days of a slope, days of the run counts, market days looked at, least members.
PEAK, SLOPE, YEAR, HISTORY, MEMBERS = 60, 5, 252, 420, 5

# Pieces of the scores, each (upper end or null, lower x, upper x, score there, score here); a null lower x is a constant.
SLOPE_SCORE = [("x < -2", None, None, 20, 20), ("x < -1", -2, -1, 30, 60), ("x < -0.5", -1, -0.5, 60, 80), ("x < 0", -0.5, 0, 80, 100), (None, None, None, 100, 100)]
VOLATILITY_SCORE = [("x <= 0.7", None, None, 100, 100), ("x <= 1", 0.7, 1, 100, 70), ("x <= 1.3", 1, 1.3, 70, 40), (None, None, None, 25, 25)]
REBOUND_SCORE = [("x < -3", None, None, 20, 20), ("x < 0", -3, 0, 40, 70), ("x <= 5", 0, 5, 80, 100), ("x <= 10", 5, 10, 80, 60), (None, None, None, 45, 45)]
EXCESS_SCORE = [("x < -3", None, None, 25, 25), ("x < 0", -3, 0, 45, 70), ("x <= 5", 0, 5, 80, 100), (None, None, None, 70, 70)]
DISTANCE_SCORE = [("x < 3", 0, 3, 45, 90), ("x <= 10", None, None, 100, 100), ("x <= 20", 10, 20, 80, 50), (None, None, None, 35, 35)]
SPEED_SCORE = [("x < -8", None, None, 15, 15), ("x < -5", -8, -5, 20, 40), ("x < -1", -5, -1, 40, 80), (None, None, None, 100, 100)]
AMOUNT_SCORE = [("x <= 0.8", None, None, 100, 100), ("x <= 1.2", 0.8, 1.2, 80, 50), ("x <= 1.5", 1.2, 1.5, 50, 25), (None, None, None, 20, 20)]
TIMING_SCORE = [("x <= 3", 0, 3, 20, 50), ("x <= 45", None, None, 100, 100), ("x <= 90", 46, 90, 75, 45), (None, None, None, 35, 35)]
DEPTH = {"industry": (5, 15, 30), "other": (8, 25, 45)}


def depth_score(low: float, high: float, deep: float) -> list[tuple]:
    return [("x <= 0", None, None, 20, 20), (f"x < {low}", 0, low, 30, 85), (f"x <= {high}", None, None, 100, 100), (f"x <= {deep}", high, deep, 70, 35), (None, None, None, 25, 25)]


def pieces(x: str, table: list[tuple]) -> str:
    """SQL of a piecewise-linear score of x; 50 where x is null."""
    out = f"case when {x} is null then 50.0D"
    for when, x0, x1, y0, y1 in table:
        value = f"{float(y0)}D" if x0 is None else f"{float(y0)}D + {float(y1 - y0)}D * greatest(0D, least(1D, ({x} - ({float(x0)}D)) / {float(x1 - x0)}D))"
        out += f" else {value}" if when is None else f" when {when.replace('x', x, 1)} then {value}"
    return out + " end"


def weighted(parts: list[tuple[str, float]]) -> str:
    return "(" + " + ".join(f"{w}D * ({c})" for c, w in parts) + ")"


def truth(c: str, score: float) -> str:
    return f"if(coalesce({c}, false), {float(score)}D, 0D)"


# Weights of the composite scores of the columns of `metrics`.
STABLE = weighted([(f"{truth('no_new_20d_low_in_5d', 45)} + {truth('no_new_60d_low_in_5d', 35)} + {truth('no_new_20d_low_in_10d', 20)}", 0.25), (weighted([(pieces(f"slope_{n}", SLOPE_SCORE), w) for n, w in ((5, 0.30), (10, 0.30), (20, 0.25), (60, 0.15))]), 0.35), (f"{truth('close_above_ma5', 40)} + {truth('close_above_ma10', 30)} + {truth('close_above_ma20', 30)}", 0.20), (pieces("volatility_ratio", VOLATILITY_SCORE), 0.20)])
REBOUND = weighted([(pieces("return_3d", REBOUND_SCORE), 0.30), (pieces("return_5d", REBOUND_SCORE), 0.25), (pieces("excess_return_3d", EXCESS_SCORE), 0.25), ("greatest(0D, least(100D, coalesce(up_ratio_3d * 100, 50D)))", 0.20)])
RISK = weighted([(pieces("if(distance_to_recent_low is null, null, greatest(0D, distance_to_recent_low))", DISTANCE_SCORE), 0.35), (pieces("return_5d", SPEED_SCORE), 0.25), (pieces("down_amount_ratio", AMOUNT_SCORE), 0.20), (pieces("slope_20", SLOPE_SCORE), 0.20)])
# What caps the score, at how much, and its flag.
CAPS = [
    ("not no_new_20d_low_in_5d", 55, "近5日创20日新低"), ("not no_new_60d_low_in_5d", 50, "近5日创60日新低"), ("slope_5 < -0.5 and slope_10 < -0.5 and slope_20 < -0.5", 50, "短中均线明显下行"), ("return_3d > 10", 70, "反抽偏高"),
    ("drawdown_from_peak_pct > -5 and return_5d > 5", 60, "回调过浅且短涨"), ("volatility_ratio > 1.3 and down_amount_ratio > 1.1", 55, "放量下跌波动放大"),
]
PARTS = {"pullback_depth_score": 0.15, "pullback_timing_score": 0.10, "stabilization_score": 0.40, "rebound_confirmation_score": 0.20, "risk_control_score": 0.15}
LEVELS = [(80, "重点观察/布局"), (65, "可以试仓"), (50, "观察等确认"), (35, "有回调未企稳"), (None, "暂不适合买")]


def prepared_members(members: DataFrame, least: int = MEMBERS) -> DataFrame:
    """Members of sectors with at least `least` symbols, pairs once (K5)."""
    m = members.select("symbol", *KEY).distinct()
    n = m.groupBy(*KEY).agg(F.countDistinct("symbol").alias("member_count")).where(F.col("member_count") >= least)
    return m.join(n, KEY)


def benchmark(bars: DataFrame) -> DataFrame:
    """(trade_date, bench_ret): mean return of all symbols by day, percent."""
    return bars.groupBy("trade_date").agg(F.avg("pct_change").alias("bench_ret"))


def metrics(bars: DataFrame, members: DataFrame, least: int = MEMBERS, history: int = HISTORY) -> DataFrame:
    """Technical metrics of the last day of each sector (K8-K10): windows of a sector, one row a sector and day.

    Only the last `history` market dates count: index, peaks, runs and the highest value where no peak is confirmed.
    """
    members = prepared_members(members, least)
    bars = bars.withColumn("pct_change", F.coalesce("pct_change", (F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1) * 100)).where("pct_change is not null")
    bars = newest_days(bars, history)
    day = bars.join(members, "symbol").groupBy(*KEY, "trade_date").agg(F.avg("pct_change").alias("ret"), F.count("pct_change").alias("valid_count"), F.sum("amount").alias("amount"), F.max("member_count").alias("member_count"))
    # calendar and sectors are dimensions
    grid = benchmark(bars).crossJoin(F.broadcast(members.select(*KEY, "member_count").distinct()))
    df = grid.join(day.drop("member_count"), [*KEY, "trade_date"], "left").fillna(0.0, ["ret", "amount", "bench_ret"]).fillna(0, ["valid_count"])
    w, every = Window.partitionBy(*KEY).orderBy("trade_date"), Window.partitionBy(*KEY)
    f = lambda n: w.rowsBetween(1 - n, 0)
    total = lambda c: 100 * F.exp(F.sum(F.log1p(F.col(c) / 100)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"v": total("ret"), "b": total("bench_ret"), "pos": F.row_number().over(w), "n": F.count(F.lit(1)).over(every)})
    around = w.rowsBetween(-PEAK, PEAK)
    df = df.withColumns({f"m{k}": full(F.avg, "v", k, f(k)) for k in (5, 10, 20, 60)} | {f"low{k}": full(F.min, "v", k, f(k)) for k in (20, 60)} | {"latest": F.last("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "peak": (F.count("v").over(around) == 2 * PEAK + 1) & (F.col("v") >= F.max("v").over(around))})
    back = lambda c, k: (F.try_divide(F.col(c), F.lag(c, k).over(w)) - 1) * 100
    at_low = lambda k: F.coalesce(F.col("v") <= F.col(f"low{k}") * 1.002, F.lit(False))
    calm = lambda low, days: F.when(F.col("n") >= max(low, days), ~F.bool_or(at_low(low)).over(f(days)))
    up, year = F.col("ret") > 0, F.col("pos") > F.col("n") - YEAR
    df = df.withColumns(
        {f"return_{k}d": back("v", k) for k in (1, 3, 5)} | {f"slope_{k}": back(f"m{k}", SLOPE) for k in (5, 10, 20, 60)} | {f"close_above_ma{k}": F.col("v") > F.col(f"m{k}") for k in (5, 10, 20)}
        | {"no_new_20d_low_in_5d": calm(20, 5), "no_new_60d_low_in_5d": calm(60, 5), "no_new_20d_low_in_10d": calm(20, 10), "excess_return_3d": back("v", 3) - back("b", 3), "up_ratio_3d": F.avg(up.cast("double")).over(f(3)),
           "volatility_ratio": F.when(F.col("n") >= 20, F.try_divide(F.stddev_samp("ret").over(f(5)), F.stddev_samp("ret").over(f(20)))), "distance_to_recent_low": (F.try_divide(F.col("v"), F.min("v").over(f(20))) - 1) * 100,
           "down_amount_ratio": F.when(F.avg("amount").over(f(10)) != 0, F.coalesce(F.avg(F.when(F.col("ret") < 0, F.col("amount"))).over(f(10)) / F.avg("amount").over(f(10)), F.lit(0.0))),
           "_u": F.when(year & up, F.col("pos") - F.sum((year & up).cast("int")).over(w)), "_o": F.when(year & (F.col("ret") > F.col("bench_ret")), F.col("pos") - F.sum((year & (F.col("ret") > F.col("bench_ret"))).cast("int")).over(w))}
    )
    # runs of days: rows of a run share the place less the count of such days, and are counted where the days lie
    runs = {"_u": "max_consecutive_up_days_1y", "_o": "max_consecutive_outperform_days_1y"}
    df = df.withColumns({name: F.when(F.col(c).isNotNull(), F.count(c).over(Window.partitionBy(*KEY, c))) for c, name in runs.items()})
    kept = ["member_count", "valid_count", "v", "return_1d", "return_3d", "return_5d", "excess_return_3d", "no_new_20d_low_in_5d", "no_new_60d_low_in_5d", "no_new_20d_low_in_10d", "close_above_ma5", "close_above_ma10", "close_above_ma20", "volatility_ratio", "distance_to_recent_low", "down_amount_ratio", "up_ratio_3d", "slope_5", "slope_10", "slope_20", "slope_60"]
    usable = F.when(F.col("peak") & (F.col("v") >= F.col("latest")), F.struct("pos", "trade_date", "v"))
    one = df.groupBy(*KEY).agg(
        F.max("trade_date").alias("trade_date"), *[F.max_by(c, "pos").alias(c) for c in kept], F.max(usable).alias("confirmed"), F.max(F.struct("v", (-F.col("pos")).alias("pos"), "trade_date")).alias("top"), F.max("n").alias("n"),
        F.avg(F.when(year, (F.col("ret") > F.col("bench_ret")).cast("double"))).alias("outperform_day_ratio_1y"), *[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in runs.values()],
    )
    peak_pos = F.coalesce("confirmed.pos", -F.col("top.pos"))
    one = one.withColumns({"days_since_peak": F.col("n") - peak_pos, "previous_peak_date": F.coalesce("confirmed.trade_date", "top.trade_date"), "previous_peak_index": F.coalesce("confirmed.v", "top.v"), "peak_confirmed": F.col("confirmed").isNotNull()})
    one = one.withColumns({"drawdown_from_peak_pct": (F.try_divide("v", "previous_peak_index") - 1) * 100, "recent_high": F.col("days_since_peak") < PEAK, "peak_method": F.when(F.col("peak_confirmed"), "confirmed_local_high").otherwise("fallback_window_high")})
    return one.drop("confirmed", "top", "n")


def buy_parts(m: DataFrame) -> DataFrame:
    """Pullback, timing, stabilisation, rebound and risk scores, and their sum under the caps, of the columns of `metrics`."""
    depth = "if(drawdown_from_peak_pct is null, null, greatest(0D, -drawdown_from_peak_pct))"
    kinds = f"if(sector_type = 'industry', {pieces(depth, depth_score(*DEPTH['industry']))}, {pieces(depth, depth_score(*DEPTH['other']))})"
    df = m.withColumns({"pullback_depth_score": F.expr(kinds), "pullback_timing_score": F.expr(pieces("days_since_peak", TIMING_SCORE)), "stabilization_score": F.expr(STABLE), "rebound_confirmation_score": F.expr(REBOUND), "risk_control_score": F.expr(RISK)})
    caps = ", ".join(f"if(coalesce({c}, false), {float(at)}D, 100D)" for c, at, _ in CAPS)
    return df.withColumn("buy_score", F.expr(f"least({weighted(list(PARTS.items()))}, {caps})"))


def buy_scores(m: DataFrame) -> DataFrame:
    """Scores of the last day with flags of the caps, level and reason."""
    flags = F.array_compact(F.array(*[F.when(F.expr(c), flag) for c, _, flag in CAPS]))
    df = buy_parts(m).withColumn("buy_flags", F.array_join(flags, "/"))
    level = "case " + " ".join(f"when buy_score >= {at} then '{name}'" if at is not None else f"else '{name}'" for at, name in LEVELS) + " end"
    df = df.withColumn("buy_level", F.expr(level))
    df = df.withColumn("buy_reason", F.when(F.col("buy_flags") != "", F.concat("buy_level", F.lit("；风险："), "buy_flags")).otherwise(F.col("buy_level")))
    digits = {c: 2 for c in ("buy_score", "pullback_depth_score", "pullback_timing_score", "stabilization_score", "rebound_confirmation_score", "risk_control_score")} | {c: 4 for c in ("v", "return_1d", "return_3d", "return_5d", "excess_return_3d", "volatility_ratio", "distance_to_recent_low", "down_amount_ratio", "previous_peak_index", "drawdown_from_peak_pct", "slope_5", "slope_10", "slope_20", "slope_60")}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()}).withColumnRenamed("v", "latest_index")
