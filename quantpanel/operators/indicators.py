"""Indicators over bars: windows of one symbol, in one pass of one exchange and sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_symbol():
    return Window.partitionBy("symbol").orderBy("trade_date")


def last(n: int):
    return by_symbol().rowsBetween(1 - n, 0)


def new_day() -> F.Column:
    """Whether a row is the first of its symbol and date; true once for each, so days are counted where the bars lie."""
    day = F.struct("trade_date")
    return ~F.lag(day).over(by_symbol()).eqNullSafe(day)


def full(f, c: str, n: int, w=None) -> F.Column:
    """f of c over the last n rows, null until there are n values."""
    w = last(n) if w is None else w
    return F.when(F.count(c).over(w) >= n, f(c).over(w))


def corr(a: str, b: str, w=None) -> F.Column:
    """Correlation of two columns over rows that have both, null where one does not vary."""
    over = (lambda c: c) if w is None else (lambda c: c.over(w))
    x, y = F.when(F.col(b).isNotNull(), F.col(a)).cast("double"), F.when(F.col(a).isNotNull(), F.col(b)).cast("double")
    return F.try_divide(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))


def newest_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol, counted in the order in which its windows read them."""
    df = bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")) - F.row_number().over(by_symbol()))
    return df.where(F.col("_n") < n).drop("_n")


def add_moving(bars: DataFrame) -> DataFrame:
    """Means, highs, returns, drawdown, volatility, ratios."""
    df = bars.withColumns({f"ma_{n}": full(F.avg, "close", n) for n in (5, 10, 20, 60)} | {f"volume_ma_{n}": full(F.avg, "volume", n) for n in (5, 20)} | {
        "amount_ma_20": full(F.avg, "amount", 20), "close_max_20": full(F.max, "close", 20), "return_1d": F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1,
        "return_15d": F.try_divide(F.col("close"), F.lag("close", 15).over(by_symbol())) - 1, "drawdown_10d": F.try_divide(F.col("close"), full(F.max, "close", 10)) - 1,
        "_h3": full(F.max, "high", 3), "_l3": full(F.min, "low", 3), "_v3": full(F.avg, "volume", 3),
    })
    return df.withColumns({
        "is_20d_high": F.coalesce(F.col("close") >= F.col("close_max_20"), F.lit(False)), "volatility_10d": full(F.stddev_samp, "return_1d", 10) * F.sqrt(F.lit(10.0)),
        "distance_to_ma20": F.try_divide(F.col("close"), F.col("ma_20")) - 1, "volume_ratio_20": F.try_divide("volume", "volume_ma_20"),
        "volume_ratio_3d": F.try_divide("_v3", "volume_ma_20"), "consolidation_range_3d": F.try_divide("_h3", "_l3") - 1,
    }).drop("_h3", "_l3", "_v3")


def true_range() -> F.Column:
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def add_recurrences(bars: DataFrame) -> DataFrame:
    """MACD (dif, dea, hist) and Wilder ATR14 with levels and regime.

    A symbol's bars are one group by construction; its recurrences take one pass over them, whatever their number. A null
    value leaves a mean as it was.
    """
    import numpy as np
    import pandas as pd

    def ema(x: pd.Series, span: int) -> pd.Series:
        return x.ewm(span=span, min_periods=span, adjust=False, ignore_na=True).mean()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date", kind="stable").reset_index(drop=True)
        close, moved = pdf["close"].astype("float64"), pdf["true_range"].astype("float64")
        dif = ema(close, 12) - ema(close, 26)
        dea, known = ema(dif, 9), moved.dropna()
        atr = pd.Series(np.nan, index=pdf.index)
        if len(known) >= 14:
            later = known.iloc[13:].copy()
            later.iloc[0] = known.iloc[:14].mean()
            atr[later.index] = later.ewm(alpha=1 / 14, adjust=False).mean()
        out = {"macd_dif": dif, "macd_dea": dea, "macd_hist": (dif - dea) * 2, "atr_14": atr.ffill()}
        return pdf.assign(**{c: x.astype(object).where(x.notna(), None) for c, x in out.items()})

    df = bars.withColumn("true_range", true_range())
    df = df.select("symbol", *[c for c in df.columns if c != "symbol"])
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    out = df.groupBy("symbol").applyInPandas(run, f"{kinds}, macd_dif double, macd_dea double, macd_hist double, atr_14 double")
    pct = F.try_divide("atr_14", "close")
    levels = {f"atr_{side}_{k}": F.col("close") + (k if side == "take" else -k) * F.col("atr_14") for k in (1, 2, 3) for side in ("stop", "take")}
    regime = F.when(pct < 0.03, "low").when(pct < 0.06, "medium").when(pct.isNotNull(), "high")
    return out.withColumns({"atr_pct_14": pct, "atr_regime": regime, **levels})


def _advanced(a: str, close: str, tr: str) -> dict[str, str]:
    """SQL of each part of a symbol's state after one more bar, from the state `a`, the bar's close and its true range."""
    ema = lambda part, x, span: f"case when {x} is null then {a}.{part} when {a}.{part} is null then {x} else {2 / (span + 1)}D * {x} + {1 - 2 / (span + 1)}D * {a}.{part} end"
    fast, slow, n = ema("fast", close, 12), ema("slow", close, 26), f"{a}.n + if({close} is null, 0, 1)"
    dif = f"if({n} >= 26, ({fast}) - ({slow}), null)"
    dea, n_dif = ema("dea", f"({dif})", 9), f"{a}.n_dif + if({n} >= 26, 1, 0)"
    atr = f"case when {tr} is null then {a}.atr when {a}.n_tr < 13 then {a}.atr + {tr} when {a}.n_tr = 13 then ({a}.atr + {tr}) / 14 else ({a}.atr * 13 + {tr}) / 14 end"
    gap = f"if({n_dif} >= 9, ({dif}) - ({dea}), null)"
    return {"fast": fast, "slow": slow, "n": n, "dea": dea, "n_dif": n_dif, "atr": atr, "n_tr": f"{a}.n_tr + if({tr} is null, 0, 1)", "close": f"coalesce({close}, {a}.close)", "gaps": f"slice(concat({a}.gaps, array({gap})), -4, 4)"}


_START = {"fast": "cast(null as double)", "slow": "cast(null as double)", "n": "0", "dea": "cast(null as double)", "n_dif": "0", "atr": "0D", "n_tr": "0", "close": "cast(null as double)", "gaps": "cast(array(null, null, null, null) as array<double>)"}


def _state(parts: dict[str, str]) -> str:
    return "struct(" + ", ".join(f"{v} as {k}" for k, v in parts.items()) + ")"


def recurrence_state(bars: DataFrame) -> DataFrame:
    """(symbol, last_date, state): all that MACD, ATR14 and their crossings of the next bar need, a fixed size a symbol."""
    df = bars.withColumn("tr", true_range())
    rows = df.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("trade_date", "close", "tr"))).alias("r"))  # three numbers a trading day
    return rows.select("symbol", F.element_at("r", -1)["trade_date"].alias("last_date"), F.expr(f"aggregate(r, {_state(_START)}, (a, x) -> {_state(_advanced('a', 'x.close', 'x.tr'))})").alias("state"))


def advanced(state: DataFrame, bars: DataFrame) -> DataFrame:
    """bars (symbol, high, low, close, ...), one new bar a symbol, with the state after it; work a bar is constant.

    A symbol without a state begins with this bar.
    """
    df = bars.join(state.select("symbol", "last_date", "state"), "symbol", "left").withColumn("state", F.coalesce("state", F.expr(_state(_START))))
    df = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("state.close")), F.abs(F.col("low") - F.col("state.close"))))
    return df.withColumn("state", F.expr(_state(_advanced("state", "close", "_tr")))).drop("_tr")


def technicals(df: DataFrame) -> DataFrame:
    """Columns of a state: DIF, DEA, histogram, ATR14, its share of the close and the crossing of the last three bars."""
    s = "state"
    dif, dea = F.expr(f"if({s}.n >= 26, {s}.fast - {s}.slow, null)"), F.expr(f"if({s}.n_dif >= 9, {s}.dea, null)")
    met = lambda a, b: F.expr(f"exists(sequence(0, 2), k -> coalesce({s}.gaps[k] {a} 0 and {s}.gaps[k + 1] {b} 0, false))")
    last = F.element_at("state.gaps", -1)
    cross = F.when(met("<=", ">"), "golden_cross").when(met(">=", "<"), "dead_cross").when(last > 0, "above_signal").when(last <= 0, "below_signal")
    atr = F.expr(f"if({s}.n_tr >= 14, {s}.atr, null)")
    return df.withColumns({"macd_dif": dif, "macd_dea": dea, "macd_hist": (dif - dea) * 2, "atr_14": atr, "atr_pct_14": F.try_divide(atr, F.col("state.close")), "macd_state": cross}).drop("state")


def last_rows(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """The last row of each symbol up to a date."""
    df = df if as_of is None else df.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pivots(df: DataFrame, price: str, side: int = 2) -> DataFrame:
    """Strict extrema (high: largest, low: smallest) over `side` bars on both sides, with the confirming date."""
    sign = 1 if price == "high" else -1
    v = F.col(price) * sign
    before, after = by_symbol().rowsBetween(-side, -1), by_symbol().rowsBetween(1, side)
    ok = (F.count(price).over(before) == side) & (F.count(price).over(after) == side) & (v > F.max(v).over(before)) & (v > F.max(v).over(after))
    df = df.withColumns({"bar": F.row_number().over(by_symbol()), "bars": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "confirm_date": F.lead("trade_date", side).over(by_symbol()), "pivot": ok})
    return df.where("pivot").drop("pivot")


def divergences(df: DataFrame, recent: int = 15) -> DataFrame:
    """Consecutive pivots whose price and DIF part: top (price up, DIF down), bottom (price down, DIF up)."""
    out = None
    for price, kind, sign in (("high", "top", 1), ("low", "bottom", -1)):
        p = pivots(df, price)
        part = p.withColumns({"p0": F.lag(price).over(by_symbol()), "d0": F.lag("macd_dif").over(by_symbol())})
        part = part.where((sign * (F.col(price) - F.col("p0")) > 0) & (sign * (F.col("macd_dif") - F.col("d0")) < 0) & (F.col("bar") + 2 > F.col("bars") - recent))
        part = part.groupBy("symbol").agg(F.max("confirm_date").alias("signal_date")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def cross_state(df: DataFrame) -> DataFrame:
    """Golden or dead cross within the last 3 bars (golden wins), else above or below the signal."""
    d = F.col("macd_dif") - F.col("macd_dea")
    before = F.lag(d).over(by_symbol())
    df = df.withColumns({"_g": F.coalesce((before <= 0) & (d > 0), F.lit(False)), "_d": F.coalesce((before >= 0) & (d < 0), F.lit(False)), "_u": d})
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    agg = df.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy("symbol").agg(F.bool_or("_g").alias("g"), F.bool_or("_d").alias("d"), F.max_by("_u", "trade_date").alias("u"))
    return agg.select("symbol", F.when(F.col("g"), "golden_cross").when(F.col("d"), "dead_cross").when(F.col("u") > 0, "above_signal").when(F.col("u") <= 0, "below_signal").alias("macd_state"))


def volume_price_divergence(bars: DataFrame) -> DataFrame:
    """Price against 5-bar mean volume, both against 5 bars before."""
    df = bars.withColumns({"c0": F.lag("close", 5).over(by_symbol()), "v": full(F.avg, "volume", 5)}).withColumn("v0", F.lag("v", 5).over(by_symbol()))
    state = F.when((F.col("close") > F.col("c0")) & (F.col("v") < 0.9 * F.col("v0")), "price_up_volume_down").when((F.col("close") < F.col("c0")) & (F.col("v") > 1.1 * F.col("v0")), "price_down_volume_up").otherwise("none")
    return last_rows(df.withColumn("divergence", state)).select("symbol", "trade_date", "divergence")


def position_percent(atr_ratio: F.Column) -> F.Column:
    """Percent of capital: 2 % at risk over 0.85 x 2 ATR, 40 % at most; ratios above 1.5 are percents."""
    ratio = F.when(atr_ratio > 1.5, atr_ratio / 100).otherwise(atr_ratio)
    return F.when(ratio > 0, F.round(100 * F.least(F.lit(0.4), F.try_divide(F.lit(0.02), 0.85 * 2 * ratio)), 2))
