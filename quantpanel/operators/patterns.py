"""Chart patterns: candidate rows by windows of a symbol, joined within the symbol to what follows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import add_moving, by_symbol, full

# Settings of the patterns.
PEAK, GAP, DRAWDOWN, BASELINE = 40, 60, 0.10, 90
CLOSE_POSITION, UPPER_SHADOW, BODY = 0.60, 0.35, 0.25
NEAR, QUIET, DAYS, EXTENSION, FLOOR = 0.05, 1.5, 10, 0.10, 0.98


def _numbered(bars: DataFrame) -> DataFrame:
    """Indicators with the place of each bar (from 1) and the number of bars of its symbol."""
    return add_moving(bars).withColumns({"idx": F.row_number().over(by_symbol()), "n_bars": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})


def _backwards():
    """Bars of a symbol from the newest: what follows a bar is then a frame that grows, and takes linear work."""
    return Window.partitionBy("symbol").orderBy(F.desc("trade_date"))


def volume_top(bars: DataFrame) -> DataFrame:
    """The newest valid old high of each symbol and its first breakout, null if there is none yet (PT1a-PT1c).

    Old highs are few (at most one in 41 bars but for ties), so each meets the later bars of its symbol once.
    """
    around, after = by_symbol().rowsBetween(-PEAK, PEAK), _backwards().rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("high") - F.col("low")
    body = F.abs(F.col("close") - F.col("open"))
    good = (F.col("close") > F.col("open")) & (F.try_divide(F.col("close") - F.col("low"), size) >= CLOSE_POSITION) & (F.try_divide(F.col("high") - F.greatest("open", "close"), size) <= UPPER_SHADOW) & (F.try_divide(body, size) >= BODY)
    before = full(F.max, "volume", BASELINE, by_symbol().rowsBetween(-BASELINE, -1))
    df = _numbered(bars).withColumns({
        "peak": (F.count("high").over(around) == 2 * PEAK + 1) & (F.col("high") >= F.max("high").over(around)), "low_after": F.min("low").over(after),
        "broke": F.bool_or(F.col("low") < F.col("ma_60")).over(after), "launch": F.coalesce(good & (before > 0) & (F.col("volume") > before), F.lit(False)),
    })
    fall = F.try_divide(F.col("high") - F.col("low_after"), F.col("high"))
    old = df.where(f"peak and broke and high > 0 and n_bars > {BASELINE} and idx <= n_bars - {GAP}").withColumn("max_drawdown", fall).where(F.col("max_drawdown") >= DRAWDOWN)
    old = old.select("symbol", F.col("idx").alias("i0"), F.col("trade_date").alias("old_high_date"), F.col("high").alias("old_high"), "max_drawdown", (F.col("n_bars") - F.col("idx")).alias("days_since_old_high"))
    later = df.select("symbol", "idx", "high", "launch", "trade_date")
    met = old.join(later, "symbol").where("idx > i0 and high > old_high")
    first = met.groupBy("symbol", "i0").agg(F.min("idx").alias("higher"), F.min(F.when(F.col("launch"), F.col("idx"))).alias("breakout"), F.min_by("trade_date", F.when(F.col("launch"), F.col("idx"))).alias("breakout_date"))
    df = old.join(first, ["symbol", "i0"], "left").where("higher is null or higher = breakout")
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i0")))
    return df.withColumn("_n", newest).where("_n = 1").drop("_n", "higher")


def volume_top_states(bars: DataFrame) -> DataFrame:
    """Before the breakout, after it, or pulled back below the old high (PT1, PT2, PT3) at the last bar; null if none."""
    event = volume_top(bars)
    since = _numbered(bars).select("symbol", "idx", "n_bars", "trade_date", "close", "high", "volume", "ma_20", "volume_ma_5", "volume_ratio_20").join(event, "symbol").where("idx >= coalesce(breakout, n_bars)")
    last = lambda c: F.max_by(c, "idx").alias(c)
    keys = ["symbol", "old_high_date", "old_high", "max_drawdown", "days_since_old_high", "breakout_date"]
    df = since.groupBy(*keys).agg(*map(last, ("trade_date", "close", "volume", "ma_20", "volume_ma_5", "volume_ratio_20")), (F.max("idx") - F.min("idx")).alias("days"), F.max("high").alias("top"), F.min_by("close", "idx").alias("c0"), F.bool_and(F.col("close") >= F.col("ma_20") * FLOOR).alias("held"))
    distance = F.try_divide(F.col("old_high") - F.col("close"), F.col("old_high"))
    out = F.col("breakout_date").isNotNull() & F.col("days").between(1, DAYS) & (F.try_divide("top", "c0") - 1 <= EXTENSION) & F.col("held")
    state = F.when(F.col("breakout_date").isNull() & distance.between(0, NEAR) & (F.col("volume_ratio_20") <= QUIET), "pre_breakout").when(out & (F.col("close") > F.col("old_high")), "breakout")
    state = state.when(out & (F.col("close") < F.col("old_high")) & (F.col("close") >= F.col("ma_20") * FLOOR) & (F.col("volume") < F.col("volume_ma_5")), "follow_through")
    return df.select(*keys, "trade_date", "close", state.alias("state"))


def trend_pullback(bars: DataFrame) -> DataFrame:
    """Both means rising, a high within ten bars, a touch of the 20-bar mean within two: each condition and all (PT5a-PT5c, PT5)."""
    lag = lambda c, n: F.lag(c, n).over(by_symbol())
    rising = lambda c: (lag(c, 1) > 0) & (lag(c, 10) > 0) & (F.col(c) > lag(c, 1)) & (F.col(c) > lag(c, 10))
    around, before = by_symbol().rowsBetween(-5, 5), by_symbol().rowsBetween(-20, -1)
    flag = lambda c: F.coalesce(c, F.lit(False))
    top = (F.count("high").over(around) == 11) & (F.count("high").over(before) == 20) & (F.col("high") >= F.max("high").over(around)) & (F.col("high") >= F.max("high").over(before))
    near = (F.abs(F.col("low") - F.col("ma_20")) <= F.least(F.lit(0.5), F.col("ma_20") * 0.01)) | (F.col("low") < F.col("ma_20"))
    touch = (F.col("close") >= F.col("ma_20") * 1.01) & near & (F.try_divide("volume_ma_5", "volume_ma_20") <= 0.95)
    trend = (F.col("ma_20") > F.col("ma_60")) & (F.col("close") > F.col("ma_60")) & (F.col("close") > F.col("ma_20")) & rising("ma_20") & rising("ma_60")
    df = _numbered(bars).withColumns({"trend": flag(trend), "top": flag(top), "touch": flag(touch)}).where("n_bars >= 70 and idx > n_bars - 10")
    agg = df.groupBy("symbol").agg(
        F.max("trade_date").alias("trade_date"), F.max_by("trend", "idx").alias("trend_up"), F.max(F.when(F.col("top"), F.col("trade_date"))).alias("recent_high_date"),
        F.max(F.when(F.col("touch") & (F.col("idx") > F.col("n_bars") - 2), F.col("trade_date"))).alias("ma20_touch_date"),
    )
    return agg.withColumn("matched", F.col("trend_up") & F.col("recent_high_date").isNotNull() & F.col("ma20_touch_date").isNotNull())


def _settled(df: DataFrame, condition: str) -> DataFrame:
    """df where the condition holds, kept from being moved below the columns it reads, which are costly and read often."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(f"_row >= 0 and {condition}").drop("_row")


def _last(bars: DataFrame) -> DataFrame:
    """Numbered bars with the indicators that patterns 4 and 6 look at."""
    lag = lambda c, n=1: F.lag(c, n).over(by_symbol())
    above = F.coalesce(F.col("ma_5") > F.col("ma_10"), F.lit(False))
    df = _numbered(bars).withColumns({"gap": F.when(F.col("ma_10") > 0, F.col("ma_5") / F.col("ma_10") - 1), "before": lag("close"), "volume_before": lag("volume")})
    cross = (lag("ma_5") <= lag("ma_10")) & above & (lag("ma_5") < lag("ma_10")) & (lag("ma_5", 2) < lag("ma_10", 2)) & F.bool_and(above).over(_backwards().rowsBetween(Window.unboundedPreceding, 0))
    quiet = F.col("gap").between(0.0, CROSS_GAP) & (F.try_divide("volume", "volume_ma_20") <= CROSS_VOLUME)
    return df.withColumn("crossed", F.coalesce(cross & quiet, F.lit(False)))


# Settings of pattern 4.
AGE, SIDE, NECK, NECK_RISE, NECK_LOW_RISE, PULLBACK, FLOOR_60 = (20, 25), 20, 30, 0.18, 0.20, 0.05, 0.95
TAIL_VOLUME, HALVES, TAIL_MOST, CROSS_DAYS, CROSS_GAP, CROSS_VOLUME = 0.75, 0.85, 1.20, 8, 0.035, 0.90
PAST_PEAK, ABOVE_20, ABOVE_60, TODAY, BEARISH_BODY, BEARISH_VOLUME = 0.03, 0.98, 0.95, 0.07, 0.04, 1.5


def duck_nostril(bars: DataFrame) -> DataFrame:
    """A peak 20 to 25 bars ago after a steep neck, a quiet pullback above the 60-bar mean, and a fresh cross of the
    5-bar over the 10-bar mean (PT4a-PT4d, PT4): the newest peak that fits, one row a symbol.

    A symbol has at most six peaks of that age, and each meets at most 25 bars.
    """
    around, neck, tail = by_symbol().rowsBetween(-SIDE, SIDE), by_symbol().rowsBetween(1 - NECK, 0), by_symbol().rowsBetween(-2, 0)
    df = _last(bars).withColumns({"peak": (F.count("high").over(around) == 2 * SIDE + 1) & (F.col("high") >= F.max("high").over(around)), "neck_close": F.first("close").over(neck), "neck_low": F.min("low").over(neck), "neck_date": F.first("trade_date").over(neck), "tail_volume": F.avg("volume").over(tail), "age": F.col("n_bars") - F.col("idx")})
    last = df.where("age = 0 and n_bars >= 60 and ma_5 is not null and ma_10 is not null and ma_60 is not null and close > 0")
    last = last.where(f"close >= ma_20 * {ABOVE_20} and close >= ma_60 * {ABOVE_60} and coalesce(return_1d <= {TODAY}, true) and gap >= 0 and close >= ma_10 * 0.99")
    last = last.select("symbol", "trade_date", F.col("close").alias("last_close"), F.col("gap").alias("latest_ma5_ma10_gap_pct"))
    rise, low_rise = F.try_divide("high", "neck_close") - 1, F.try_divide("high", "neck_low") - 1
    peaks = df.where(F.col("age").between(*AGE) & F.col("peak") & (F.col("high") > 0) & (F.col("close") >= F.col("ma_60")) & (F.col("close") >= F.col("ma_20")) & (rise >= NECK_RISE) & (low_rise >= NECK_LOW_RISE))
    peaks = peaks.select("symbol", F.col("idx").alias("i0"), F.col("age").alias("days_since_duck_peak"), F.col("trade_date").alias("duck_peak_date"), F.col("high").alias("duck_peak_price"), "tail_volume", F.col("neck_date").alias("neck_start_date"), rise.alias("neck_return_pct"), low_rise.alias("neck_low_to_peak_return_pct"))
    after = df.where(F.col("age") < AGE[1]).select("symbol", F.struct("idx", "trade_date", "age", "open", "close", "low", "volume", "ma_60", "gap", "crossed", F.try_divide("volume", "volume_ma_20").alias("v20")).alias("x"))
    keys = [c for c in peaks.columns]
    df = peaks.join(last, "symbol").join(after, "symbol").where("x.idx > i0").groupBy(*keys, "trade_date", "last_close", "latest_ma5_ma10_gap_pct").agg(F.sort_array(F.collect_list("x")).alias("p"))
    mean = lambda a: f"aggregate({a}, 0D, (s, x) -> s + x.volume) / size({a})"
    df = df.withColumns({"low": F.expr("array_min(transform(p, x -> struct(x.low as v, x.idx as i, x.trade_date as d)))"), "avg_volume": F.expr(mean("p")), "most": F.expr("array_max(transform(p, x -> x.volume))"), "front": F.expr(mean("slice(p, 1, size(p) div 2)")), "back": F.expr(mean("slice(p, 1 + size(p) div 2, size(p))"))})
    df = df.withColumns({
        "peak_to_pullback_drawdown_pct": 1 - F.col("low.v") / F.col("duck_peak_price"), "pullback_volume_peak_tail_ratio": F.try_divide("avg_volume", "tail_volume"), "pullback_max_single_day_peak_tail_ratio": F.try_divide("most", "tail_volume"), "pullback_back_half_volume_ratio": F.try_divide("back", "front"),
        "large_bearish_count": F.expr(f"size(filter(p, x -> x.close < x.open and (x.open - x.close) / x.open >= {BEARISH_BODY} and x.volume / avg_volume >= {BEARISH_VOLUME}))"), "held": F.expr(f"forall(filter(p, x -> x.ma_60 is not null), x -> x.low >= x.ma_60 * {FLOOR_60})"),
        "cross": F.expr(f"array_max(transform(filter(p, x -> x.crossed and x.age < {CROSS_DAYS} and x.idx >= greatest(i0 + 5, low.i)), x -> struct(x.idx as i, x.trade_date as d, x.age as age, x.gap as gap, x.v20 as v20)))"), "distance_to_duck_peak_pct": F.col("last_close") / F.col("duck_peak_price") - 1,
    })
    df = _settled(df, f"peak_to_pullback_drawdown_pct >= {PULLBACK} and held and pullback_volume_peak_tail_ratio <= {TAIL_VOLUME} and pullback_max_single_day_peak_tail_ratio <= {TAIL_MOST} and pullback_back_half_volume_ratio <= {HALVES} and large_bearish_count = 0 and cross is not null and distance_to_duck_peak_pct <= {PAST_PEAK}")
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i0")))).where("_n = 1")
    return df.select(
        "symbol", "trade_date", "duck_peak_date", "duck_peak_price", "days_since_duck_peak", "neck_start_date", "neck_return_pct", "neck_low_to_peak_return_pct", F.col("low.d").alias("pullback_low_date"), F.col("low.v").alias("pullback_low_price"), "peak_to_pullback_drawdown_pct", "pullback_volume_peak_tail_ratio",
        "pullback_max_single_day_peak_tail_ratio", "pullback_back_half_volume_ratio", "large_bearish_count", F.col("cross.d").alias("nostril_cross_date"), F.col("cross.age").alias("days_since_nostril_cross"), F.col("cross.gap").alias("nostril_cross_ma5_ma10_gap_pct"), F.col("cross.v20").alias("nostril_volume_ma20_ratio"),
        (F.col("cross.i") - F.col("low.i")).alias("cross_after_pullback_low_days"), "distance_to_duck_peak_pct", "latest_ma5_ma10_gap_pct",
    )


# Settings of pattern 6.
SCAN, ANCHOR_AGE, ANCHOR_RISE, ANCHOR_PREV, ANCHOR_MEAN, LAUNCH, LAUNCH_RISE, LIMIT_RISE, LIMIT_DAYS = 80, 6, 0.03, 1.8, 1.6, 15, 0.18, 0.095, 2
FALL, FALL_DAYS, FALL_VOLUME, FALL_LEAST, FALL_HALVES, FALL_MOST, SUPPORT, CLOSE_RANGE, TOUCH_DAYS, HOLD = 0.08, 20, 0.9, 4, 0.8, 1.2, 0.025, 0.05, 10, 0.015
BREAK_DAYS, BREAK, BREAK_VOLUME, RECLAIM_DAYS, SIDEWAYS, RECLAIM_RANGE = 8, 0.01, 0.6, 3, 5, 0.12


def double_volume(bars: DataFrame) -> DataFrame:
    """An anchor bar of doubled volume, a launch with limit days, a quiet pullback to the anchor's close, and there a break
    that is reclaimed or a support that holds (PT6a-PT6d, PT6): the newest anchor that fits, one row a symbol.

    Anchors are few; the bars from one on, at most 80, are one array.
    """
    df = _last(bars).withColumns({"age": F.col("n_bars") - F.col("idx"), "r": F.try_divide(F.col("close"), F.col("before")) - 1})
    doubled = (F.try_divide("volume", F.when(F.col("volume_before") > 0, F.col("volume_before"))) >= ANCHOR_PREV) | (F.try_divide("volume", F.when(F.col("volume_ma_20") > 0, F.col("volume_ma_20"))) >= ANCHOR_MEAN)
    anchor = (F.col("age").between(ANCHOR_AGE, SCAN - 1)) & (F.col("close") > F.col("open")) & (F.col("r") >= ANCHOR_RISE) & doubled & (F.col("volume") > 0) & (F.col("n_bars") >= 60)
    row = F.struct("idx", "trade_date", "age", "open", "close", "high", "low", "volume", "r", "before")
    path = F.collect_list(row).over(by_symbol().rowsBetween(0, SCAN))
    tail = F.avg("volume").over(by_symbol().rowsBetween(-2, 0))
    df = df.withColumn("tail_volume", tail).where(F.col("age") < SCAN)  # an anchor and all bars after it
    df = df.withColumn("path", path).withColumn("tails", F.collect_list(F.struct("idx", "tail_volume")).over(by_symbol().rowsBetween(0, SCAN)))
    df = df.where(F.coalesce(anchor, F.lit(False))).select("symbol", F.col("idx").alias("i0"), F.col("trade_date").alias("anchor_date"), F.col("close").alias("support_price"), F.col("volume").alias("anchor_volume"), F.try_divide("volume", "volume_before").alias("anchor_volume_ratio_prev"), F.try_divide("volume", "volume_ma_20").alias("anchor_volume_ratio_ma20"), F.col("path").alias("p"), "tails")
    top = lambda a: f"array_max(transform({a}, x -> struct(x.high as v, -x.idx as i, x.trade_date as d)))"
    df = df.withColumns({"launch": F.expr(top(f"slice(p, 1, {LAUNCH})")), "peak": F.expr(top("p"))})
    mean = lambda a: f"aggregate({a}, 0D, (s, x) -> s + x.volume) / size({a})"
    df = df.withColumns({"launch_confirm_return_pct": F.col("launch.v") / F.col("support_price") - 1, "limit_up_like_count": F.expr(f"size(filter(p, x -> x.idx <= -launch.i and x.r >= {LIMIT_RISE}))"), "q": F.expr("filter(p, x -> x.idx > -peak.i)"), "rise_tail_avg_volume": F.expr("filter(tails, x -> x.idx = -peak.i)[0].tail_volume")})
    df = _settled(df, f"launch_confirm_return_pct >= {LAUNCH_RISE} and limit_up_like_count >= {LIMIT_DAYS} and -peak.i > i0 and size(q) >= {FALL_LEAST}")
    df = df.withColumns({"low": F.expr("array_min(transform(q, x -> struct(x.low as v, x.idx as i, x.trade_date as d)))"), "pullback_volume_ratio_to_anchor": F.expr(f"({mean('q')}) / anchor_volume"), "pullback_back_half_volume_ratio": F.expr(f"({mean('slice(q, 1 + size(q) div 2, size(q))')}) / nullif({mean('slice(q, 1, size(q) div 2)')}, 0)"), "pullback_max_rise_tail_volume_ratio": F.expr("array_max(transform(q, x -> x.volume)) / nullif(rise_tail_avg_volume, 0)")})
    df = df.withColumn("peak_to_pullback_drawdown_pct", 1 - F.col("low.v") / F.col("peak.v"))
    df = _settled(df, f"peak_to_pullback_drawdown_pct >= {FALL} and low.v <= support_price * {1 + SUPPORT} and low.i + peak.i <= {FALL_DAYS} and pullback_volume_ratio_to_anchor <= {FALL_VOLUME} and pullback_back_half_volume_ratio <= {FALL_HALVES} and pullback_max_rise_tail_volume_ratio <= {FALL_MOST}")
    df = _settled(df, f"forall(filter(q, x -> x.idx >= low.i), x -> x.close between support_price * {1 - CLOSE_RANGE} and support_price * {1 + CLOSE_RANGE})")
    sound = f"array_min(transform(filter(q, y -> y.idx >= x.idx), y -> y.close)) >= support_price * {1 - BREAK} and array_min(transform(filter(q, y -> y.idx >= x.idx), y -> y.low)) > 0 and array_max(transform(filter(q, y -> y.idx >= x.idx), y -> y.high)) / array_min(transform(filter(q, y -> y.idx >= x.idx), y -> y.low)) - 1 <= {RECLAIM_RANGE}"
    df = df.withColumn("reclaims", F.expr(f"filter(q, x -> x.close >= support_price and (x.close > x.open or x.close > x.before) and x.age <= {SIDEWAYS} and {sound})"))
    df = df.withColumn("breaks", F.expr(f"filter(q, b -> b.age < {BREAK_DAYS} and b.close < support_price * {1 - BREAK} and b.volume / anchor_volume <= {BREAK_VOLUME} and exists(reclaims, x -> x.idx > b.idx and x.idx <= b.idx + {RECLAIM_DAYS}))"))
    df = df.withColumn("broke", F.expr("try_element_at(breaks, -1)"))
    df = df.withColumn("reclaim", F.expr("try_element_at(filter(reclaims, x -> x.idx > broke.idx), 1)"))
    touched = f"filter(q, x -> x.age < {TOUCH_DAYS} and x.low <= support_price * {1 + SUPPORT})"
    df = df.withColumn("touch", F.expr(f"if(array_min(transform(filter(q, x -> x.age < {TOUCH_DAYS}), x -> x.close)) >= support_price * {1 - HOLD}, try_element_at({touched}, -1), null)"))
    df = _settled(df, "(broke is not null or touch is not null)")
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i0")))).where("_n = 1")
    held = F.col("broke").isNull()
    return df.select(
        "symbol", F.expr("element_at(p, -1).trade_date").alias("trade_date"), "anchor_date", "support_price", "anchor_volume_ratio_prev", "anchor_volume_ratio_ma20", F.col("launch.d").alias("launch_confirm_high_date"), F.col("launch.v").alias("launch_confirm_high_price"), "launch_confirm_return_pct", "limit_up_like_count", F.col("peak.d").alias("peak_date"), F.col("peak.v").alias("peak_price"),
        (F.col("peak.v") / F.col("support_price") - 1).alias("anchor_to_peak_return_pct"), F.col("low.d").alias("pullback_low_date"), F.col("low.v").alias("pullback_low_price"), "peak_to_pullback_drawdown_pct", "pullback_volume_ratio_to_anchor", "pullback_back_half_volume_ratio", "pullback_max_rise_tail_volume_ratio", F.when(held, "support_hold").otherwise("break_reclaim").alias("pattern6_branch"),
        F.col("broke.trade_date").alias("breakdown_date"), (F.col("broke.volume") / F.col("anchor_volume")).alias("breakdown_volume_ratio_to_anchor"), F.col("reclaim.trade_date").alias("reclaim_date"), (F.col("reclaim.idx") - F.col("broke.idx")).alias("days_to_reclaim"), F.col("reclaim.age").alias("post_reclaim_days"), F.when(held, F.col("touch.trade_date")).alias("support_touch_date"),
    )


# Names of the patterns by their number, history that a selection needs, the momentum filter.
PATTERNS = {1: "volume_top_pre_breakout", 2: "volume_top_breakout", 3: "volume_top_follow_through", 4: "duck_nostril_cross", 5: "trend_pullback", 6: "double_volume_support_rebound"}
MOMENTUM_DAYS, MOMENTUM_WINDOW, MOMENTUM_RISE, LEAST_AMOUNT = 200, 5, 0.10, 100_000_000.0
HISTORY = {1: 141, 2: 141, 3: 141, 4: 86, 5: 70, 6: 80}


def required_history(selected: tuple[int, ...]) -> int:
    """Bars that the selected patterns need (PT0b)."""
    return max(MOMENTUM_DAYS, *(HISTORY[k] for k in selected))


def _momentum(bars: DataFrame) -> DataFrame:
    """Numbered bars with their 5-bar rise, null before the last 200 bars."""
    rise = F.try_divide("close", F.lag("close", MOMENTUM_WINDOW - 1).over(by_symbol())) - 1
    return _numbered(bars).withColumn("rise", F.when(F.col("idx") > F.col("n_bars") - MOMENTUM_DAYS + MOMENTUM_WINDOW - 1, rise))


def _fits(selected: tuple[int, ...], least_amount: float) -> F.Column:
    return (F.col("n") >= required_history(selected)) & (F.col("amount") >= least_amount) & (F.col("rise") >= MOMENTUM_RISE)


def eligible(bars: DataFrame, selected: tuple[int, ...] = tuple(PATTERNS), least_amount: float = LEAST_AMOUNT) -> DataFrame:
    """(symbol) of enough history, mean amount and a 5-bar rise within the last 200 bars (PT0, PT0b, PT0c)."""
    agg = _momentum(bars).groupBy("symbol").agg(F.max("n_bars").alias("n"), F.max_by("amount_ma_20", "idx").alias("amount"), F.max("rise").alias("rise"))
    return agg.where(_fits(selected, least_amount)).select("symbol")


def eligible_bars(bars: DataFrame, selected: tuple[int, ...] = tuple(PATTERNS), least_amount: float = LEAST_AMOUNT) -> DataFrame:
    """Bars of the symbols of `eligible`, told by windows of the symbol in the same sort, so bars are read once and nothing is joined."""
    whole = by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = _momentum(bars).select(F.struct(*bars.columns).alias("_bar"), "symbol", "trade_date", F.col("n_bars").alias("n"), "amount_ma_20", F.col("rise").alias("_r"))
    df = df.withColumns({"amount": F.last("amount_ma_20").over(whole), "rise": F.max("_r").over(whole)})
    return df.where(_fits(selected, least_amount)).select("_bar.*")


def pattern_report(bars: DataFrame, as_of=None, selected: tuple[int, ...] = tuple(PATTERNS), least_amount: float = LEAST_AMOUNT, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A row for each symbol and pattern that fits its last bar up to a date, with the columns common to all (PT0, PT7, PT8).

    keep stores the bars of the symbols that the patterns look at, as each pattern reads them.
    """
    bars = bars if as_of is None else bars.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    bars = keep(eligible_bars(bars, selected, least_amount))
    found = []
    if set(selected) & {1, 2, 3}:
        states = F.create_map(*[F.lit(x) for kv in (("pre_breakout", 1), ("breakout", 2), ("follow_through", 3)) for x in kv])
        hits = volume_top_states(bars).withColumn("pattern_id", states[F.col("state")])
        found.append(hits.where(F.col("pattern_id").isin(*selected)).select("symbol", "pattern_id"))
    for k, f in ((4, duck_nostril), (5, lambda b: trend_pullback(b).where("matched")), (6, double_volume)):
        if k in selected:
            found.append(f(bars).select("symbol", F.lit(k).alias("pattern_id")))
    hits = found[0]
    for df in found[1:]:
        hits = hits.unionByName(df)
    names = F.create_map(*[F.lit(x) for kv in PATTERNS.items() for x in kv])
    last = _numbered(bars).where("idx = n_bars").select("symbol", "trade_date", *[F.round(c, 4).alias(c) for c in ("close", "ma_10", "ma_20", "ma_60", "return_15d", "volume_ratio_20")])
    return hits.dropDuplicates(["symbol", "pattern_id"]).join(last, "symbol").withColumn("strategy_name", names[F.col("pattern_id")])


def multi_patterns(report: DataFrame) -> DataFrame:
    """Symbols that more than one pattern fits, with their numbers (PT9)."""
    agg = report.groupBy("trade_date", "symbol").agg(F.sort_array(F.collect_set("pattern_id")).alias("pattern_ids"))
    return agg.where("size(pattern_ids) > 1").withColumn("n_patterns", F.size("pattern_ids"))
