"""Market gate, walk-forward windows, risk exclusion, seeded order, benchmark excess, sector states and the risk model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_symbol, full, last_rows
from .market import by_date
from .scores import linear_score
from .sectors import by_sector


def market_gate(index: DataFrame) -> DataFrame:
    """0 (trade) above a rising 20-day mean with breadth of 0.45 and few limit-down rows, else 1 (M9). One row a day."""
    # Least breadth and largest share of limit-down rows.
    mean = full(F.avg, "equal_index", 20, by_date().rowsBetween(-19, 0))
    df = index.withColumn("m", mean).withColumn("slope", F.try_divide("m", F.lag("m", 5).over(by_date())) - 1)
    allow = (F.col("equal_index") > F.col("m")) & (F.col("slope") > 0) & (F.col("breadth_ma20") >= 0.45) & (F.try_divide("limit_down", "stock_count") <= 0.03)
    return df.select("trade_date", "equal_index", F.col("slope").alias("ma20_slope"), F.when(F.coalesce(allow, F.lit(False)), 0).otherwise(1).alias("gate"))


def index_tail_events(index: DataFrame, lookback: int = 100, q: float = 0.05) -> DataFrame:
    """Days whose index return is below the quantile of those before it (M11). One row a day."""
    before = by_date().rowsBetween(-lookback, -1)
    df = index.withColumn("lr", F.log(F.try_divide("equal_index", F.lag("equal_index").over(by_date()))))
    df = df.withColumn("threshold", F.when(F.count("lr").over(before) >= lookback, F.percentile("lr", q).over(before)))
    return df.select("trade_date", "threshold", F.when(F.col("threshold").isNotNull(), (F.col("lr") < F.col("threshold")).cast("int")).alias("tail_event"))


def walk_forward(panel: DataFrame, train: int, valid: int, step: int, embargo: int = 1, anchored: bool = False) -> DataFrame:
    """Windows over the distinct dates: train, embargo, valid; anchored ones keep the first start (V7, V8)."""
    days = panel.select("trade_date").distinct().withColumn("i", F.row_number().over(by_date()) - 1)
    span = days.agg(F.count(F.lit(1)).alias("n")).where(f"n >= {train + embargo + valid}")
    at = span.select(F.explode(F.sequence(F.lit(0), F.col("n") - (train + embargo + valid), F.lit(step))).alias("s"))
    places = {"train_start": F.lit(0) if anchored else F.col("s"), "train_end": F.col("s") + train - 1, "valid_start": F.col("s") + train + embargo, "valid_end": F.col("s") + train + embargo + valid - 1}
    out = at.select(F.format_string("wf_%02d", (F.col("s") / step).cast("int") + 1).alias("window_id"), *[c.cast("int").alias(k) for k, c in places.items()])
    for k in places:
        out = out.join(days.select(F.col("i").alias(k), F.col("trade_date").alias(f"{k}_date")), k).drop(k).withColumnRenamed(f"{k}_date", k)
    return out


def slice_windows(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each window with their split (V9): windows meet the distinct days, and those the rows by date."""
    days = panel.select("trade_date").distinct()
    at = (F.col("trade_date") >= F.col("train_start")) & (F.col("trade_date") <= F.col("valid_end"))
    split = F.when(F.col("trade_date") <= F.col("train_end"), "train").when(F.col("trade_date") >= F.col("valid_start"), "valid")
    dealt = days.join(F.broadcast(windows), at).withColumn("split", split).where("split is not null")  # dozens of windows
    return panel.join(dealt, "trade_date")


def exclude_risk(df: DataFrame, score: str, rate: float = 0.2) -> DataFrame:
    """Rank of each day by falling risk, its percentile and whether the top ceil(rate n) exclude it (R2)."""
    w = Window.partitionBy("trade_date")
    df = df.where(F.col(score).isNotNull()).withColumns({"risk_rank": F.row_number().over(w.orderBy(F.desc(score), "symbol")), "n": F.count(F.lit(1)).over(w)})
    return df.withColumns({"risk_percentile": F.col("risk_rank") / F.col("n"), "excluded": F.col("risk_rank") <= F.greatest(F.lit(1), F.ceil(F.col("n") * rate))}).drop("n")


def seeded_top(df: DataFrame, n: int) -> DataFrame:
    """n rows of each day in an order that a hash of day and symbol fixes."""
    key = F.md5(F.concat(F.date_format("trade_date", "yyyy-MM-dd"), F.lit(":"), F.col("symbol")).cast("binary"))
    w = Window.partitionBy("trade_date").orderBy(key, "symbol")
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def benchmark_excess(daily: DataFrame, index: DataFrame, horizon: int = 5) -> DataFrame:
    """Outcome of the market over the horizon beside the mean outcome of a day's selection."""
    ahead = F.try_divide(F.lead("equal_index", horizon).over(by_date()), F.col("equal_index")) - 1
    return daily.join(index.select("trade_date", ahead.alias("benchmark")), "trade_date").withColumn("excess", F.col("outcome") - F.col("benchmark"))


def sector_technicals(index: DataFrame, days: DataFrame) -> DataFrame:
    """Returns, mean slopes, contraction and new-low flags of the last day of each sector (K9), with its short score.

    days holds the amount-weighted move and the share of gainers; a missing value scores 50.
    """
    w = by_sector()
    frame = lambda n: w.rowsBetween(1 - n, 0)
    v = F.col("sector_index")
    back = lambda n: 100 * (F.try_divide(v, F.lag("sector_index", n).over(w)) - 1)
    df = index.withColumns({"return_5d": back(5), "return_20d": back(20), "m5": full(F.avg, "sector_index", 5, frame(5)), "m20": full(F.avg, "sector_index", 20, frame(20)), "low20": full(F.min, "sector_index", 20, frame(20))})
    df = df.withColumns({"ma5_slope_pct": 100 * (F.try_divide("m5", F.lag("m5", 5).over(w)) - 1), "ma20_slope_pct": 100 * (F.try_divide("m20", F.lag("m20", 5).over(w)) - 1), "at_low": F.coalesce(v <= F.col("low20") * 1.002, F.lit(False))})
    df = df.withColumns({
        "new_low_in_5d": F.bool_or("at_low").over(frame(5)), "above_ma20": v > F.col("m20"), "volatility_ratio": F.try_divide(full(F.stddev_samp, "ret", 5, frame(5)), full(F.stddev_samp, "ret", 20, frame(20))),
        "up_ratio_3d": F.avg((F.col("ret") > 0).cast("double")).over(frame(3)), "_n": F.row_number().over(Window.partitionBy("sector_label").orderBy(F.desc("trade_date"))),
    }).where("_n = 1")
    df = df.join(days.select("sector_label", "trade_date", "amount_weighted_pct_change", "up_ratio"), ["sector_label", "trade_date"], "left")
    # Bounds of the linear scores and their weights.
    parts = ((0.25, "return_5d", -3.0, 8.0), (0.25, "return_20d", -8.0, 18.0), (0.15, "ma5_slope_pct", -0.8, 1.2), (0.20, "amount_weighted_pct_change", -2.0, 5.0), (0.15, "up_ratio", 0.35, 0.80))
    score = sum((k * linear_score(F.col(c), lo, hi) for k, c, lo, hi in parts), F.lit(0.0))
    return df.select("sector_label", "trade_date", "return_5d", "return_20d", "ma5_slope_pct", "ma20_slope_pct", "new_low_in_5d", "above_ma20", "volatility_ratio", "up_ratio_3d", F.round(score, 2).alias("short_score"))


def index_code(c: F.Column) -> F.Column:
    """Six digits of an index with its exchange, kept if given, else sz for 399xxx and sh for the rest (F2)."""
    text = F.regexp_replace(F.lower(F.trim(c)), "[.]", "")
    given = text.rlike("^s[hz]")
    code = F.lpad(F.when(given, F.substring(text, 3, 6)).otherwise(text), 6, "0")
    return F.concat(F.when(given, F.substring(text, 1, 2)).when(code.startswith("399"), "sz").otherwise("sh"), code)


def stock_code(c: F.Column) -> F.Column:
    """Six digits of a stock with its exchange: sh for the leading digits below, else sz."""
    code = F.lpad(c, 6, "0")
    # Leading digits of the first exchange.
    return F.concat(F.when(code.rlike("^(600|601|603|605|688|689|900)"), "sh").otherwise("sz"), code)


def tail_risk_model(panel: DataFrame, features: list[str], label: str):
    """Standardised logistic regression on all complete rows (V1); training is distributed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    known = panel.dropna(subset=[*features, label]).localCheckpoint()  # read by each stage
    stages = [VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, maxIter=50)]
    return Pipeline(stages=stages).fit(known)


def score_last(model, panel: DataFrame, features: list[str]) -> DataFrame:
    """Risk of the last complete row of each symbol, highest first (V5)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(last_rows(panel.dropna(subset=features)))
    return out.select("symbol", "trade_date", vector_to_array("probability")[1].alias("risk_score")).orderBy(F.desc("risk_score"), "symbol")


def limit_days(bars: DataFrame) -> DataFrame:
    """Daily return of each last bar, from the vendor's or the closes."""
    r = F.coalesce(F.col("pct_change") / 100, F.try_divide("close", F.lag("close").over(by_symbol())) - 1)
    return last_rows(bars.withColumn("daily_return", F.round(r, 6))).select("symbol", "trade_date", "daily_return")
