"""Analysis of candidates while quotes come in: indicators advanced by the provisional bar, features, and the day's pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantpanel.operators import indicators as ind
from quantpanel.operators import labels as lab

from .quotes import latest_quotes, overlay, provisional_bars, snapshot

#: Bars of history that the features of one day need, the day itself apart.
TAIL = 60


def before_today(history: DataFrame, today: DataFrame) -> DataFrame:
    """History before each symbol's provisional day."""
    day = today.groupBy("symbol").agg(F.min("trade_date").alias("_day"))
    return history.join(day, "symbol", "left").where("_day is null or trade_date < _day").drop("_day")


def history_tail(history: DataFrame, bars: int = TAIL) -> DataFrame:
    """The last bars of each symbol; a small table beside the states, made once a day."""
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return history.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= bars).drop("_n")


def analysis(latest: DataFrame, state: DataFrame, tail: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Features, MACD, ATR, their state, position and change of the day for each symbol with a quote.

    latest: the newest quote of each symbol of a day; state and tail: `recurrence_state` and `history_tail` of the bars before
    that day. candidates (symbol, ...) restricts the symbols and gives its columns; without it the full market is analysed
    (T9). The provisional bar advances a state in constant time; the long history is not read.
    """
    latest = latest if candidates is None else latest.join(candidates.select("symbol").distinct(), "symbol", "left_semi")
    bar = provisional_bars(latest)
    known = tail.join(bar.select("symbol"), "symbol", "left_semi")
    features = lab.latest_features(overlay(known, bar))
    technical = ind.technicals(ind.advanced(state, bar)).select("symbol", "macd_dif", "macd_dea", "macd_hist", "atr_14", "atr_pct_14", "macd_state")
    close = state.select("symbol", F.col("state.close").alias("pre_close"))
    change = snapshot(latest.select("symbol", "close", "quote_datetime").join(close, "symbol", "left")).select("symbol", "quote_datetime", "pre_close", "intraday_pct_change")
    out = features.join(technical, "symbol").join(change, "symbol").withColumn("position_percent", ind.position_percent(F.col("atr_pct_14")))
    return out if candidates is None else out.join(candidates, "symbol")


def run_analysis(quotes: DataFrame, state: DataFrame, tail: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Start the stream of analyses; each batch of changed symbols replaces its own part of `path`.

    A batch that is run again after a failure writes the same part once more, so nothing is doubled. score adds the columns
    of fitted models to the rows of a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = score(analysis(batch, state, tail)).withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return latest_quotes(quotes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def refreshed(spark: SparkSession, path: str) -> DataFrame:
    """The newest analysis of each symbol and day."""
    df = spark.read.parquet(path)
    w = Window.partitionBy("symbol", "trade_date").orderBy(F.desc("batch"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")
