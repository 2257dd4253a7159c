"""Market aggregates by day. Day-level frames have one row a trading day, so windows over all of them are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_symbol, full, new_day


def by_date():
    return Window.orderBy("trade_date")


# A locked bar, a day at the limit, the returns that count.
LOCKED, LIMIT, LEAST_RETURN, MOST_RETURN = 0.0005, 0.095, -0.5, 1.0


def flag(c: F.Column) -> F.Column:
    """1 or 0, where a comparison with a missing value is 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


def daily_return() -> F.Column:
    """Return of a bar; null unless both closes are positive."""
    before = F.lag("close").over(by_symbol())
    return F.when((F.col("close") > 0) & (before > 0), F.try_divide(F.col("close"), before) - 1)


def limit_flags(r: str = "daily_return") -> dict[str, F.Column]:
    """Bars that stand still at a day's limit, up and down."""
    locked = F.abs(F.col("high") - F.col("low")) <= LOCKED * F.abs("close")
    return {"limit_up_like": flag(locked & (F.col(r) >= LIMIT)), "limit_down_like": flag(locked & (F.col(r) <= -LIMIT))}


def symbol_panel(bars: DataFrame) -> DataFrame:
    """Valid return, lagged amount, above-mean and limit flags of each bar; a missing mean is not above (M1)."""
    df = bars.withColumns({"daily_return": daily_return(), "lagged": F.lag("amount").over(by_symbol()), "above_ma20": flag(F.col("close") > full(F.avg, "close", 20)), "above_ma60": flag(F.col("close") > full(F.avg, "close", 60))})
    df = df.where(F.col("daily_return").between(LEAST_RETURN, MOST_RETURN)).withColumns(limit_flags())
    return df.select("trade_date", "symbol", "daily_return", F.col("lagged").alias("amount"), "above_ma20", "above_ma60", "limit_up_like", "limit_down_like")


def daily_market(panel: DataFrame, least: int = 1) -> DataFrame:
    """Equal, median and amount-weighted returns, breadth and limit counts (M2)."""
    weight = F.when(F.col("amount") > 0, F.col("amount"))
    df = panel.withColumn("_day", new_day()).groupBy("trade_date").agg(
        F.count_if(F.col("_day") & F.col("symbol").isNotNull()).alias("stock_count"), F.avg("daily_return").alias("equal_return"), F.percentile("daily_return", 0.5).alias("median_return"),
        F.coalesce(F.try_divide(F.sum(F.col("daily_return") * weight), F.sum(F.when(F.col("daily_return").isNotNull(), weight))), F.avg("daily_return")).alias("amount_return"),
        F.avg(flag(F.col("daily_return") > 0)).alias("breadth_up"), F.avg("above_ma20").alias("breadth_ma20"), F.avg("above_ma60").alias("breadth_ma60"), F.sum("limit_up_like").alias("limit_up"), F.sum("limit_down_like").alias("limit_down"),
    )
    return df.where(F.col("stock_count") >= least)


def market_index(market: DataFrame) -> DataFrame:
    """Compounded index of each return (M3)."""
    w = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return market.withColumns({f"{k}_index": F.exp(F.sum(F.log1p(f"{k}_return")).over(w)) for k in ("equal", "median", "amount")})


def trade_day_panel(bars: DataFrame) -> DataFrame:
    """Means, new highs and lows of 20 and 60 bars, limit flags, volatility and drawdown of each bar (M5)."""
    close = F.col("close")
    df = bars.where("close > 0").withColumn("daily_return", daily_return()).withColumn("log_return", F.log1p("daily_return"))
    marks = {f"above_ma{n}": flag(close > full(F.avg, "close", n)) for n in (20, 60, 120)}
    marks |= {f"new_high_{n}d": flag(close >= full(F.max, "high", n)) for n in (20, 60)} | {f"new_low_{n}d": flag(close <= full(F.min, "low", n)) for n in (20, 60)}
    back = lambda n: F.try_divide(close, F.lag("close", n).over(by_symbol())) - 1
    df = df.withColumns(marks | limit_flags() | {"return_5d": back(5), "return_20d": back(20), "volatility_20d": full(F.stddev_samp, "log_return", 20), "max_drawdown_20d": F.try_divide(close, full(F.max, "close", 20)) - 1})
    return df.where("daily_return is not null").select("trade_date", "symbol", "daily_return", "return_5d", "return_20d", "amount", *marks, "limit_up_like", "limit_down_like", "volatility_20d", "max_drawdown_20d")


def trade_day_features(bars: DataFrame, least: int = 5) -> DataFrame:
    """Breadth, dispersion, medians and amount across each day (M6); one row a day, so its own windows are small."""
    df = trade_day_panel(bars).where(F.col("daily_return").between(LEAST_RETURN, MOST_RETURN))
    r, amount = F.col("daily_return"), F.coalesce("amount", F.lit(0.0))
    shares = {"breadth_above_ma20": "above_ma20", "breadth_above_ma60": "above_ma60", "breadth_above_ma120": "above_ma120", "new_high_20d_ratio": "new_high_20d", "new_low_20d_ratio": "new_low_20d", "new_high_60d_ratio": "new_high_60d", "new_low_60d_ratio": "new_low_60d", "limit_up_ratio": "limit_up_like", "limit_down_ratio": "limit_down_like"}
    day = df.withColumn("_day", new_day()).groupBy("trade_date").agg(
        F.count_if(F.col("_day") & F.col("symbol").isNotNull()).alias("stock_count"), F.avg(r).alias("equal_return_1d"), F.percentile(r, 0.5).alias("return_median_1d"), F.stddev_pop(r).alias("return_dispersion_1d"),
        F.coalesce(F.try_divide(F.sum(r * amount), F.when(F.sum(amount) > 0, F.sum(amount))), F.avg(r)).alias("amount_weight_return_1d"), F.sum(amount).alias("total_amount"),
        *[F.avg(c).alias(k) for k, c in shares.items()], F.avg(flag(F.col("return_5d") > 0)).alias("breadth_positive_return_5d"), F.avg(flag(F.col("return_20d") > 0)).alias("breadth_positive_return_20d"),
        F.avg(flag(r > 0)).alias("advancing_ratio_1d"), F.avg(flag(r < 0)).alias("declining_ratio_1d"), F.percentile("volatility_20d", 0.5).alias("volatility_median_20d"), F.percentile("max_drawdown_20d", 0.5).alias("max_drawdown_median_20d"),
    ).where(F.col("stock_count") >= least)
    mean = lambda n: full(F.avg, "total_amount", n, by_date().rowsBetween(1 - n, 0))
    return day.withColumns({"amount_ratio_5d_20d": F.try_divide(mean(5), mean(20)), "amount_ratio_20d_60d": F.try_divide(mean(20), mean(60))})


def index_features(index: DataFrame, column: str, prefix: str) -> DataFrame:
    """Returns, above-mean flags, mean slopes, drawdowns and volatilities of an index of one row a day (M7)."""
    v, w = F.col(column), by_date()
    frame = lambda n: w.rowsBetween(1 - n, 0)
    lag = lambda c, n: F.try_divide(F.col(c), F.lag(c, n).over(w)) - 1
    df = index.withColumns({"_lr": F.log(F.try_divide(v, F.lag(column).over(w))), **{f"_m{n}": full(F.avg, column, n, frame(n)) for n in (20, 60, 120)}})
    df = df.withColumns(
        {f"{prefix}_return_{n}d": lag(column, n) for n in (5, 20, 60)} | {f"{prefix}_above_ma{n}": flag(v > F.col(f"_m{n}")) for n in (20, 60, 120)} | {f"{prefix}_ma20_slope_5d": lag("_m20", 5), f"{prefix}_ma60_slope_10d": lag("_m60", 10)}
        | {f"{prefix}_drawdown_{n}d": F.try_divide(v, full(F.max, column, n, frame(n))) - 1 for n in (20, 60)} | {f"{prefix}_volatility_{n}d": full(F.stddev_samp, "_lr", n, frame(n)) for n in (20, 60)}
    )
    return df.drop("_lr", "_m20", "_m60", "_m120")


def bad_buy_days(index: DataFrame, column: str = "equal_index", horizon: int = 5, drawdown: float = -0.03, loss: float = -0.02) -> DataFrame:
    """Label 1 where the index falls far enough within the horizon; days without a whole horizon go (M8)."""
    ahead = by_date().rowsBetween(1, horizon)
    low = F.try_divide(F.min(column).over(ahead), F.col(column)) - 1
    end = F.try_divide(F.lead(column, horizon).over(by_date()), F.col(column)) - 1
    df = index.withColumns({"future_drawdown": low, "future_return": end}).where("future_return is not null and future_drawdown is not null")
    return df.withColumn("bad_buy_day", flag((F.col("future_drawdown") <= drawdown) | (F.col("future_return") <= loss)))


def gate_decision(scored: DataFrame, score: str, split: str = "train", quantile: float = 0.8) -> DataFrame:
    """allow below the quantile of the training scores, else no_trade (M10). Rows are days, the threshold is one row."""
    threshold = scored.where(F.col("split") == split).agg(F.percentile(score, quantile).alias("threshold"))
    df = scored.where(F.col("split") != split).crossJoin(F.broadcast(threshold))  # one row
    return df.withColumn("permission", F.when(F.col(score) < F.col("threshold"), "allow").otherwise("no_trade"))


def longest_block(days: DataFrame, blocked: str = "blocked") -> DataFrame:
    """Longest run of blocked days."""
    df = days.withColumn("_n", F.row_number().over(by_date())).where(blocked).withColumn("_g", F.col("_n") - F.row_number().over(by_date()))
    return df.groupBy("_g").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest_block"))
