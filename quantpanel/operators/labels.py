"""Labels and feature panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .indicators import by_symbol, corr, full, last, true_range


def ret(n: int) -> F.Column:
    return F.try_divide(F.col("close"), F.lag("close", n).over(by_symbol())) - 1


def base_features(bars: DataFrame) -> DataFrame:
    """Returns, volatilities, drawdown, distances and the 5-day outcome (L1)."""
    df = bars.withColumn("log_return", F.log(F.try_divide(F.col("close"), F.lag("close").over(by_symbol()))))
    ahead = by_symbol().rowsBetween(1, 5)
    df = df.withColumn("_down", F.least("log_return", F.lit(0.0)))
    return df.withColumns({
        "return_5d": ret(5), "return_20d": ret(20), "return_60d": ret(60), "vol_20": full(F.stddev_samp, "log_return", 20), "vol_60": full(F.stddev_samp, "log_return", 60),
        "downside_vol_20": full(F.stddev_samp, "_down", 20), "drawdown_60": F.try_divide(F.col("close"), full(F.max, "close", 60)) - 1,
        "ma20_distance": F.try_divide(F.col("close"), full(F.avg, "close", 20)) - 1, "ma60_distance": F.try_divide(F.col("close"), full(F.avg, "close", 60)) - 1,
        "volume_ratio_20": F.try_divide(F.col("volume"), full(F.avg, "volume", 20)), "log_amount": F.log1p("amount"), "range_pct": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "future_return_5d": F.try_divide(F.lead("close", 5).over(by_symbol()), F.col("close")) - 1, "future_min_return_5d": F.try_divide(F.min("close").over(ahead), F.col("close")) - 1,
    }).drop("_down")


def latest_features(bars: DataFrame, lookback: int = 61) -> DataFrame:
    """Base features of each symbol's last bar from its last `lookback` bars (L3); the outcomes ahead are left out."""
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    tail = bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= lookback)
    return base_features(tail).where("_n = 1").drop("_n", "future_return_5d", "future_min_return_5d")


def tail_risk(bars: DataFrame, lookback: int = 100, quantile: float = 0.05, horizon: int = 1) -> DataFrame:
    """Tail event: return under the quantile of the prior returns; the label is the event `horizon` bars on (L2)."""
    df = bars.withColumn("log_return", F.log(F.try_divide(F.col("close"), F.lag("close").over(by_symbol()))))
    w = by_symbol().rowsBetween(-lookback, -1)
    # the quantile between two places of the sorted frame, as F.percentile has it, which would count the values of each frame in a map
    place = (lookback - 1) * quantile
    low, high = int(place // 1), int(-(-place // 1))
    df = df.withColumn("_before", F.when(F.count("log_return").over(w) >= lookback, F.collect_list("log_return").over(w))).withColumn("_before", F.slice(F.sort_array("_before"), low + 1, high - low + 1))
    a, b = F.try_element_at("_before", F.lit(1)), F.try_element_at("_before", F.lit(high - low + 1))
    df = df.withColumn("threshold", F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)).drop("_before")
    df = df.withColumn("tail_event", F.coalesce(F.col("log_return") < F.col("threshold"), F.lit(False)).cast("int"))
    return df.withColumn("risk_label", F.lead("tail_event", horizon).over(by_symbol()))


def triple_barrier(bars: DataFrame, horizon: int = 20, down: float = 1.0, up: float | None = 2.0, down_pct: float | None = None, up_pct: float | None = None, variant: str = "barrier_down_first") -> DataFrame:
    """Next-open entry, barriers by ATR or percent, first touch within the horizon, the lower one on a tie (L4).

    Late rows look as far as there are bars. barrier_outcome is down_first, up_first or timeout; the label is a first touch
    of the lower barrier or, with max_drawdown_exceed, a low at it at any time. The path of a row is a frame of its own
    window, of at most `horizon` bars, so nothing is joined.
    """
    df = bars.withColumns({"tr": true_range()}).withColumns({"atr": full(F.avg, "tr", 14), "entry": F.lead("open").over(by_symbol()), "entry_date": F.lead("trade_date").over(by_symbol())})
    df = df.withColumn("path", F.collect_list(F.struct("trade_date", "low", "high", "close")).over(by_symbol().rowsBetween(1, horizon)))
    df = df.where("entry > 0 and atr > 0").drop("tr")
    below = F.col("entry") * down_pct if down_pct is not None else F.col("atr") * down
    above = F.col("entry") * up_pct if up_pct is not None else F.col("atr") * up if up is not None else F.lit(None).cast("double")
    df = df.withColumns({"below": below, "stop": F.col("entry") - below, "take": F.col("entry") + above})
    first = F.expr("array_position(transform(path, b -> coalesce(b.low <= stop, false) or coalesce(b.high >= take, false)), true)").cast("int")
    df = df.withColumn("hit", first).withColumn("bar", F.when(F.col("hit") > 0, F.expr("path[hit - 1]")).otherwise(F.expr("path[size(path) - 1]")))
    outcome = F.when(F.col("hit") == 0, "timeout").when(F.col("bar.low") <= F.col("stop"), "down_first").otherwise("up_first")
    df = df.withColumn("barrier_outcome", outcome).withColumn("barrier_max_drawdown", F.try_divide(F.array_min("path.low"), F.col("entry")) - 1)
    price = F.when(F.col("barrier_outcome") == "down_first", F.col("stop")).when(F.col("barrier_outcome") == "up_first", F.col("take")).otherwise(F.col("bar.close"))
    label = F.col("barrier_outcome") == "down_first" if variant == "barrier_down_first" else F.coalesce(F.col("barrier_max_drawdown") <= -F.col("below") / F.col("entry"), F.lit(False))
    df = df.withColumns({"risk_label": label.cast("int"), "exit_date": F.col("bar.trade_date"), "exit_price": price, "barrier_return": F.try_divide(price, F.col("entry")) - 1, "forward_log_return": F.log(F.try_divide(F.when(price > 0, price), F.col("entry")))})
    return df.drop("path", "hit", "bar", "below")


def event_paths(bars: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """Events with their close and the `horizon` bars after them: events meet narrow bars, so no path is shuffled."""
    at = bars.select("symbol", "trade_date", "close", "low").join(events.withColumnRenamed("event_date", "trade_date"), ["symbol", "trade_date"], "left")
    path = F.collect_list(F.struct("trade_date", "close", "low")).over(by_symbol().rowsBetween(1, horizon))
    return at.withColumn("path", path).where("vol is not null and size(path) > 0 and close > 0")


def event_grid(bars: DataFrame, events: DataFrame, cells: list[tuple]) -> DataFrame:
    """(symbol, trade_date, cells): the risk label of each event under each cell (config_id, horizon, up, down, min_target) that takes it.

    One pass makes the labels of all cells, as event_barrier makes those of one.
    """
    def cell(name: str, horizon: int, up: float, down: float, least: float) -> str:
        met = f"filter(slice(path, 1, {horizon}), b -> b.close > 0 and (b.close / close - 1 <= {-float(down)}D * vol or b.close / close - 1 >= {float(up)}D * vol))"
        return f"if(vol >= {least}, struct('{name}' as config_id, cast(coalesce(try_element_at({met}, 1).close / close - 1 <= {-float(down)}D * vol, false) as int) as risk_label), null)"

    df = event_paths(bars, events, max(c[1] for c in cells))
    return df.select("symbol", "trade_date", F.expr(f"array_compact(array({', '.join(cell(*c) for c in cells)}))").alias("cells")).where("size(cells) > 0")


def event_barrier(bars: DataFrame, events: DataFrame, horizon: int = 20, up: float = 1.0, down: float = 1.0, min_target: float = 0.005) -> DataFrame:
    """Barriers of a multiple of the deviation on closes after each event.

    events: (symbol, event_date, vol, threshold) as cusum_state gives them. bins: -1 down first, 1 up first, 0 neither.
    """
    df = event_paths(bars, events, horizon).where(f"vol >= {min_target}").withColumns({"top": F.lit(up) * F.col("vol"), "bottom": F.lit(-down) * F.col("vol")})
    df = df.withColumn("hit", F.expr("array_position(transform(path, b -> b.close > 0 and (b.close / close - 1 <= bottom or b.close / close - 1 >= top)), true)").cast("int"))
    df = df.withColumn("bar", F.when(F.col("hit") > 0, F.expr("path[hit - 1]")).otherwise(F.expr("path[size(path) - 1]")))
    r = F.try_divide("bar.close", "close") - 1
    bins = F.when(F.col("hit") == 0, 0).when(r <= F.col("bottom"), -1).otherwise(1)
    return df.select(
        "symbol", "trade_date", F.col("close").alias("entry_price"), F.col("bar.trade_date").alias("exit_date"), F.col("bar.close").alias("exit_price"), F.element_at(F.array(F.lit("down_first"), F.lit("vertical"), F.lit("up_first")), bins + 2).alias("barrier_outcome"),
        bins.alias("barrier_bin"), (bins == -1).cast("int").alias("risk_label"), r.alias("barrier_return"), (F.try_divide(F.array_min("path.low"), F.col("close")) - 1).alias("barrier_max_drawdown"), F.log(r + 1).alias("forward_log_return"), F.col("vol").alias("target"), "threshold",
    )


def label_distribution(labelled: DataFrame) -> DataFrame:
    """Rows and label rate by outcome and for ALL."""
    return labelled.rollup("barrier_outcome").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("risk_label").alias("label_rate"), F.grouping("barrier_outcome").alias("g")).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("barrier_outcome")).alias("barrier_outcome"), "n_rows", "label_rate")


def cusum_state(bars: DataFrame, span: int = 100, mult: float = 1.0) -> DataFrame:
    """(symbol, trade_date, vol, threshold, is_event) of each bar: exponentially weighted deviation, its mean, and symmetric
    CUSUM events with reset (L5, L6, L8).

    A symbol's bars are one group by construction; its recurrences run over them in arrays of their own.
    """
    import numpy as np
    import pandas as pd

    keep = 1 - 2 / (span + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date", kind="stable")
        r = np.log(pdf["close"].where(pdf["close"] > 0)).diff()
        vol = r.ewm(alpha=1 - keep, min_periods=span).std()
        threshold = float(vol.mean() * mult) if vol.notna().any() else float("nan")
        events, up, down = np.zeros(len(pdf), dtype=bool), 0.0, 0.0
        if threshold > 0:
            for k, x in enumerate(r.to_numpy()):
                if x == x:
                    up, down = max(0.0, up + x), min(0.0, down + x)
                    if down < -threshold:  # the side that fires starts again, the other goes on
                        events[k], down = True, 0.0
                    elif up > threshold:
                        events[k], up = True, 0.0
        at = threshold if threshold > 0 else None
        return pd.DataFrame({"symbol": pdf["symbol"], "trade_date": pdf["trade_date"], "vol": vol.astype(object).where(vol.notna(), None), "threshold": at, "is_event": events})

    return bars.select("symbol", "trade_date", "close").groupBy("symbol").applyInPandas(run, "symbol string, trade_date date, vol double, threshold double, is_event boolean")


def cusum_events(bars: DataFrame, span: int = 100, mult: float = 1.0) -> DataFrame:
    """(symbol, event_date, vol, threshold) of the events."""
    return cusum_state(bars, span, mult).where("is_event").select("symbol", F.col("trade_date").alias("event_date"), "vol", "threshold")


def candle_features(bars: DataFrame) -> DataFrame:
    """The candle block of the 158 features."""
    rng, top, bottom = F.col("high") - F.col("low"), F.greatest("open", "close"), F.least("open", "close")
    d = F.try_divide
    return bars.withColumns({
        "KMID": d(F.col("close") - F.col("open"), F.col("open")), "KLEN": d(rng, F.col("open")), "KMID2": d(F.col("close") - F.col("open"), rng), "KUP": d(F.col("high") - top, F.col("open")), "KUP2": d(F.col("high") - top, rng),
        "KLOW": d(bottom - F.col("low"), F.col("open")), "KLOW2": d(bottom - F.col("low"), rng), "KSFT": d(2 * F.col("close") - F.col("high") - F.col("low"), F.col("open")), "KSFT2": d(2 * F.col("close") - F.col("high") - F.col("low"), rng),
        "OPEN0": d("open", "close"), "HIGH0": d("high", "close"), "LOW0": d("low", "close"), "VWAP0": d(d("amount", "volume"), F.col("close")),
    })


# Fixed value: what is added to denominators.
GUARD = 1e-12


#: Names of the rolling features, before the number of bars.
ROLLING = "ROC MA STD MAX MIN QTLU QTLD RSV RANK BETA RSQR RESI IMAX IMIN IMXD CORR CORD CNTP CNTN CNTD SUMP SUMN SUMD VMA VSTD WVMA VSUMP VSUMN VSUMD".split()


def window_features(bars: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 30, 60)) -> DataFrame:
    """The rolling blocks of the 158 features, frames that shrink at the start.

    Ranges and sums in a denominator have GUARD added, so a flat window gives 0. The first bar has no change: it counts as
    neither rise nor fall, and sums over it alone are null. Nulls are passed over. A symbol's bars are one group by
    construction; its frames are views of one array a column, and a feature is one step over all of them.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [f"{k}{n}" for n in windows for k in ROLLING]

    def divided(a, b):
        return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b != 0)

    def framed(x, n):
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)

    def before(x, n=1):
        return np.concatenate([np.full(min(n, len(x)), np.nan), x[:-n]])

    def total(x):
        return np.where(np.isnan(x).all(axis=1), np.nan, np.nansum(x, axis=1))

    def mean(x):
        return divided(np.nansum(x, axis=1), (~np.isnan(x)).sum(axis=1).astype("float64"))

    def top(x):
        return np.fmax.reduce(x, axis=1)

    def least(x):
        return np.fmin.reduce(x, axis=1)

    def off(x):
        """Distances from the frame's mean, exactly none in a frame of equal values."""
        return np.where((top(x) == least(x))[:, None], x * 0, x - mean(x)[:, None])

    def deviation(x):
        return np.sqrt(divided(np.nansum(off(x) ** 2, axis=1), (~np.isnan(x)).sum(axis=1) - 1.0))

    def sums(x, y):
        """Sums of squares and products of the distances of rows that have both."""
        x, y = np.where(np.isnan(y), np.nan, x), np.where(np.isnan(x), np.nan, y)
        a, b = off(x), off(y)
        return x, y, np.nansum(a * a, axis=1), np.nansum(b * b, axis=1), np.nansum(a * b, axis=1)

    def correlation(x, y):
        _, _, xx, yy, xy = sums(x, y)
        return divided(xy, np.sqrt(xx) * np.sqrt(yy))

    def quantile(ordered, known, q):
        at = q * np.maximum(known - 1, 0)
        low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
        rows = np.arange(len(ordered))
        a, b = ordered[rows, low], ordered[rows, high]
        return np.where(low == high, a, (high - at) * a + (at - low) * b)

    def place(x, best):
        """Place of the first value that is the best, among the known ones of the frame."""
        hit = x == best[:, None]
        at = np.cumsum(~np.isnan(x), axis=1)[np.arange(len(x)), hit.argmax(axis=1)]
        return np.where(hit.any(axis=1), at, np.nan)

    def rolling(c, high, low, v, n):
        i, p, v0 = np.arange(1.0, len(c) + 1), before(c), before(v)
        r, d, dv = divided(c, p), c - p, v - v0
        ratio = divided(v, v0) + 1
        vr = np.log(ratio, out=np.full(len(c), np.nan), where=ratio > 0)
        lv = np.log1p(v, out=np.full(len(c), np.nan), where=v > -1)
        f = lambda x: framed(x, n)
        cs, hs, ls, vs, ws = f(c), f(high), f(low), f(v), f(np.abs(r - 1) * v)
        inside, known, ordered = ~np.isnan(f(i)), (~np.isnan(cs)).sum(axis=1), np.sort(cs, axis=1)
        hi, lo = top(hs), least(ls)
        at, y, xx, yy, xy = sums(f(i), cs)
        slope = divided(xy, xx)
        fit = mean(y) - slope * mean(at) + slope * i
        r2 = np.where(xx == 0, np.nan, np.where(yy == 0, 1.0, divided(divided(xy * xy, xx), yy)))
        imax, imin = place(hs, hi), place(ls, lo)
        pos, neg = (divided(((f(x) > 0) & inside).sum(axis=1).astype("float64"), inside.sum(axis=1).astype("float64")) for x in (d, -d))
        up, down, moved, vup, vdown, vmoved = (total(f(x)) for x in (np.maximum(d, 0), np.maximum(-d, 0), np.abs(d), np.maximum(dv, 0), np.maximum(-dv, 0), np.abs(dv)))
        moved, vmoved = moved + GUARD, vmoved + GUARD
        rank = divided((cs < c[:, None]).sum(axis=1) + ((cs == c[:, None]).sum(axis=1) + 1) / 2, known.astype("float64"))
        return [
            divided(before(c, n), c), divided(mean(cs), c), divided(deviation(cs), c), divided(hi, c), divided(lo, c), divided(quantile(ordered, known, 0.8), c), divided(quantile(ordered, known, 0.2), c), divided(c - lo, hi - lo + GUARD), rank,
            divided(slope, c), r2, divided(c - fit, c), imax / n, imin / n, (imax - imin) / n, correlation(cs, f(lv)), correlation(f(r), f(vr)), pos, neg, pos - neg, divided(up, moved), divided(down, moved), divided(up - down, moved),
            divided(mean(vs), v + GUARD), divided(deviation(vs), v + GUARD), divided(deviation(ws), mean(ws) + GUARD), divided(vup, vmoved), divided(vdown, vmoved), divided(vup - vdown, vmoved),
        ]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["trade_date"].combine_chunks(), null_placement="at_start"))
        own = [pc.fill_null(rows[x].cast("float64"), float("nan")).to_numpy() for x in ("close", "high", "low", "volume")]
        with np.errstate(all="ignore"):
            out = [x for n in windows for x in rolling(*own, n)]
        for name, x in zip(names, out, strict=True):
            rows = rows.append_column(pa.field(name, pa.float64()), pa.array(x, mask=np.isnan(x)))
        return rows

    schema = T.StructType([*bars.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names]])
    return bars.groupBy("symbol").applyInArrow(run, schema)


def latest_alpha(bars: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 30, 60)) -> DataFrame:
    """The 158 features of each symbol's last bar (L18), from the bars that they take: the longest window and one before it."""
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    tail = bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(windows) + 1)
    return window_features(candle_features(tail), windows).where("_n = 1").drop("_n")


def return_label(bars: DataFrame) -> DataFrame:
    """Return from t+1 to t+2 and its z-score across the day."""
    df = bars.withColumn("label_raw", F.try_divide(F.lead("close", 2).over(by_symbol()), F.lead("close", 1).over(by_symbol())) - 1)
    day = Window.partitionBy("trade_date")
    sd = F.stddev_samp("label_raw").over(day)
    return df.withColumn("label", F.try_divide(F.col("label_raw") - F.avg("label_raw").over(day), F.when(sd > 1e-12, sd)))


# Thresholds and weights of the three-day target.
LIMIT_UP, DOWN_3D, HIT, DOWN, TRAP = 0.099, -0.05, 1.0, 1.2, 1.5


def limit_up_3d(bars: DataFrame) -> DataFrame:
    """Hit, down and trap over the next 3 bars and their weighted target.

    A hit is a high of a later day above the close before it; down is the close of the third day. Days whose own high
    passes the limit go, and so do the last three of a symbol.
    """
    lead = lambda c, k: F.lead(c, k).over(by_symbol()) if k else F.col(c)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rise = [F.try_divide(lead("high", k), lead("close", k - 1)) - 1 for k in (1, 2, 3)]
    today = F.try_divide(F.col("high"), F.lag("close").over(by_symbol())) - 1
    df = bars.withColumns({"today": today, "future_max_high_return_3d": F.greatest(*rise), "future_return_3d": F.try_divide(lead("close", 3), F.col("close")) - 1, "future_max_drawdown_3d": F.try_divide(F.least(*[lead("low", k) for k in (1, 2, 3)]), F.col("close")) - 1})
    df = df.where("future_return_3d is not null").where(~F.coalesce(F.col("today") > LIMIT_UP, F.lit(False)))
    df = df.withColumns({"hit": flag(F.col("future_max_high_return_3d") > LIMIT_UP), "down": flag(F.col("future_return_3d") < DOWN_3D)}).withColumn("trap", F.col("hit") * F.col("down"))
    return df.withColumn("target", HIT * F.col("hit") - DOWN * F.col("down") - TRAP * F.col("trap")).drop("today")


def weekly_returns(bars: DataFrame) -> DataFrame:
    """Last close of each week to Friday and its return."""
    week = F.next_day(F.date_sub("trade_date", 1), "FRI")
    df = bars.groupBy("symbol", week.alias("week_end")).agg(F.max_by("close", "trade_date").alias("close"))
    w = Window.partitionBy("symbol").orderBy("week_end")
    return df.withColumn("weekly_return", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)


def firm_returns(weekly: DataFrame) -> DataFrame:
    """Residual of each symbol's weekly returns on the market mean; the raw return under 20 weeks."""
    df = weekly.where("weekly_return is not null").withColumn("market", F.avg("weekly_return").over(Window.partitionBy("week_end")))
    s = Window.partitionBy("symbol")
    fit = F.regr_intercept("weekly_return", "market").over(s) + F.regr_slope("weekly_return", "market").over(s) * F.col("market")
    return df.withColumn("firm_return", F.when(F.count(F.lit(1)).over(s) >= 20, F.coalesce(F.col("weekly_return") - fit, F.col("weekly_return"))).otherwise(F.col("weekly_return")))


def crash_measures(weekly: DataFrame, least: int = 26) -> DataFrame:
    """Annual crash count, NCSKEW on raw returns, DUVOL, mean, deviation and smallest return."""
    df = weekly.withColumn("year", F.year("week_end"))
    y = Window.partitionBy("symbol", "year")
    df = df.withColumns({"n": F.count("firm_return").over(y), "m": F.avg("firm_return").over(y), "sd": F.stddev_samp("firm_return").over(y)}).where(F.col("n") >= least)
    x = F.col("firm_return")
    up, dn = x >= F.col("m"), x < F.col("m")
    agg = df.groupBy("symbol", "year").agg(F.first("n").alias("n"), F.sum((x < F.col("m") - 3.2 * F.col("sd")).cast("int")).alias("crash_count"), F.sum(x * x * x).alias("s3"), F.sum(x * x).alias("s2"), F.sum(F.when(dn, x * x)).alias("d2"), F.sum(F.when(up, x * x)).alias("u2"), F.sum(dn.cast("int")).alias("nd"), F.sum(up.cast("int")).alias("nu"), F.avg(x).alias("ret"), F.first("sd").alias("sigma"), F.min(x).alias("min_ret"))
    n = F.col("n").cast("double")
    ncskew = F.try_divide(-(n * F.pow(n - 1, 1.5) * F.col("s3")), (n - 1) * (n - 2) * F.pow("s2", 1.5))
    duvol = F.log(F.try_divide((F.col("nu") - 1) * F.col("d2"), (F.col("nd") - 1) * F.col("u2")))
    return agg.select("symbol", "year", "n", (F.col("crash_count") > 0).cast("int").alias("crash"), "crash_count", ncskew.alias("ncskew"), duvol.alias("duvol"), "ret", "sigma", "min_ret")


# 0.975 quantiles of chi-square with one to three degrees of freedom.
CHI_SQUARE = {1: 5.0238861873148845, 2: 7.377758908227871, 3: 9.348403604496145}
CRASH_MEASURES = ("negoutlier", "crash", "ncskew", "duvol", "ret", "sigma", "min_ret")


def negative_outliers(measures: DataFrame) -> DataFrame:
    """Outliers of a year on the negative side, by distance in medians and median deviations of three measures.

    Years of fewer than ten complete rows have none. A median deviation of 0 gives way to the standard deviation.
    """
    names, year = ("ncskew", "duvol", "min_ret"), Window.partitionBy("year")
    whole = F.col("ncskew").isNotNull() & F.col("duvol").isNotNull() & F.col("min_ret").isNotNull()
    value = {c: F.when(whole, F.col(c)) for c in names}
    df = measures.withColumns({f"_m_{c}": F.percentile(v, 0.5).over(year) for c, v in value.items()}).withColumn("_n", F.count(F.when(whole, 1)).over(year))
    df = df.withColumns({f"_s_{c}": F.coalesce(F.nullif(F.percentile(F.abs(v - F.col(f"_m_{c}")), 0.5).over(year), F.lit(0.0)), F.nullif(F.stddev_samp(v).over(year), F.lit(0.0))) for c, v in value.items()})
    apart = sum((F.coalesce(F.pow(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), 2), F.lit(0.0)) for c in names), F.lit(0.0))
    side = (F.col("min_ret") < F.col("_m_min_ret")) | (F.col("ncskew") > F.col("_m_ncskew"))
    out = F.coalesce(whole & (F.col("_n") >= 10) & (apart > CHI_SQUARE[3]) & side, F.lit(False)).cast("int")
    return df.withColumn("negoutlier", out).drop("_n", *[f"_{k}_{c}" for k in "ms" for c in names])


def crash_distribution(measures: DataFrame) -> DataFrame:
    """Counts and means of the annual measures by year and for all."""
    means = {"negoutlier": "negoutlier_rate", "crash": "crash_rate", "crash_count": "crash_count_mean", "ncskew": "ncskew_mean", "duvol": "duvol_mean", "ret": "ret_mean", "sigma": "sigma_mean", "min_ret": "min_ret_mean"}
    agg = measures.rollup("year").agg(F.grouping("year").alias("_g"), F.count(F.lit(1)).alias("firm_years"), *[F.avg(c).alias(k) for c, k in means.items()])
    return agg.withColumn("year", F.when(F.col("_g") == 1, "all").otherwise(F.col("year").cast("string"))).drop("_g")


def crash_correlation(measures: DataFrame) -> DataFrame:
    """Correlation of each pair of annual measures over the rows that have both."""
    pairs = [(a, b) for a in CRASH_MEASURES for b in CRASH_MEASURES]
    one = measures.agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("measure_left"), F.lit(b).alias("measure_right"), F.col(f"{a}|{b}").alias("correlation")) for a, b in pairs])).alias("x"))
    return long.select("x.*")


def drop_empty_features(df: DataFrame, features: list[str]) -> DataFrame:
    """df without the features that are null in every row (Q5)."""
    counts = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return df.drop(*[c for c in features if not counts[c]])


def risk_panel(features: DataFrame, labelled: DataFrame, needed: list[str]) -> DataFrame:
    """Features with the labels of the same symbol and date, complete in the needed columns."""
    extra = [c for c in labelled.columns if c in ("symbol", "trade_date") or c not in features.columns]
    return features.join(labelled.select(*extra), ["symbol", "trade_date"]).dropna(subset=needed)
