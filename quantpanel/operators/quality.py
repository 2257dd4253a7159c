"""Audit of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indicators import by_symbol, new_day


def audit(bars: DataFrame, lookback: int = 100, horizon: int = 20) -> DataFrame:
    """Span, days, repeats, missing values, zero volume, locked limits and eligibility of each symbol (Q1, Q2)."""
    r = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    locked = F.abs(F.col("high") - F.col("low")) <= 0.0005 * F.col("close")
    df = bars.withColumns({"up": F.coalesce(locked & (r >= 0.095), F.lit(False)).cast("int"), "dn": F.coalesce(locked & (r <= -0.095), F.lit(False)).cast("int"), "_day": new_day()})
    days = F.count_if(F.col("_day") & F.col("trade_date").isNotNull())
    agg = df.groupBy("symbol").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), days.alias("trading_days"), (F.count(F.lit(1)) - days).alias("duplicates"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("open", "high", "low", "close", "volume")], F.count_if(F.col("volume") == 0).alias("zero_volume_days"), F.sum("up").alias("locked_up"), F.sum("dn").alias("locked_down"))
    return agg.withColumn("eligible", F.col("trading_days") >= lookback + horizon)


def audit_summary(detail: DataFrame) -> DataFrame:
    """Totals over the audit (Q3)."""
    d = F.col("trading_days")
    return detail.agg(F.count(F.lit(1)).alias("symbols"), F.sum(d).alias("rows"), F.min(d).alias("min_days"), F.percentile(d, 0.5).alias("median_days"), F.max(d).alias("max_days"), F.sum(F.col("eligible").cast("int")).alias("eligible"))


def feature_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing rate, mean, deviation and range of each feature (Q4)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    return long.groupBy("feature").agg(F.avg(F.col("v").isNull().cast("double")).alias("missing_rate"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
