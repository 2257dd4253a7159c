"""Small column functions and the trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def safe_return(value: F.Column, base: F.Column) -> F.Column:
    """value / base - 1; null unless base is above 0."""
    return F.when(base > 0, F.try_divide(value, base) - 1)


def rate(condition: F.Column) -> F.Column:
    """Share of rows where a condition holds, a missing one being false; null without rows."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def median(c: str) -> F.Column:
    """Median of what is there."""
    return F.percentile(c, 0.5)


def weighted_mean(values: list[F.Column], weights: list[float]) -> F.Column:
    """Mean by weight over the values that are there."""
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    bottom = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    return F.try_divide(top, F.when(bottom > 0, bottom))


def trading_days(spans: DataFrame, calendar: DataFrame) -> DataFrame:
    """spans (start_date, end_date, ...) with the number of the calendar's days from start to end.

    A span that reaches beyond the calendar counts weekdays there. Every date of the calendar's span has a number, so each
    end meets it by an equality; those are some thousand rows.
    """
    days = calendar.select("trade_date").distinct()
    ends = days.agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    dates = ends.select(F.explode(F.sequence(F.date_sub("first", 1), F.col("last"))).alias("day"))
    numbered = dates.join(days.withColumn("open", F.lit(1)), F.col("day") == F.col("trade_date"), "left").select("day", F.sum(F.coalesce("open", F.lit(0))).over(Window.orderBy("day")).alias("n"))
    df = spans.crossJoin(F.broadcast(ends))  # one row
    clip = lambda c: F.greatest(F.date_sub("first", 1), F.least(c, F.col("last")))
    df = df.withColumns({"_end": clip(F.col("end_date")), "_before": clip(F.date_sub("start_date", 1))})
    df = df.join(F.broadcast(numbered.toDF("_end", "n1")), "_end").join(F.broadcast(numbered.toDF("_before", "n0")), "_before")
    weekdays = lambda a, b: F.when(a <= b, F.size(F.filter(F.sequence(a, b), lambda d: F.weekday(d) < 5))).otherwise(0)
    beyond = weekdays(F.greatest(F.col("start_date"), F.date_add("last", 1)), F.col("end_date")) + weekdays(F.col("start_date"), F.least(F.col("end_date"), F.date_sub("first", 1)))
    return df.select(*spans.columns, (F.greatest(F.lit(0), F.col("n1") - F.col("n0")) + beyond).alias("trading_days"))
