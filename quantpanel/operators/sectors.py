"""Sector aggregates, indices and leader metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_sector():
    return Window.partitionBy("sector_label").orderBy("trade_date")


def newest_days(bars: DataFrame, days: int) -> DataFrame:
    """Bars of the last `days` market dates that bars holds; the first of them is one row."""
    first = bars.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(days).agg(F.min("trade_date").alias("_first"))
    return bars.join(F.broadcast(first), F.col("trade_date") >= F.col("_first")).drop("_first")


def sector_days(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Count, mean and amount-weighted move, share of gainers and amount by sector and day (K4, K6)."""
    df = bars.join(members, "symbol")
    up = (F.col("pct_change") > 0).cast("double")
    return df.groupBy("sector_type", "sector_label", "trade_date").agg(F.count("pct_change").alias("valid_count"), F.avg("pct_change").alias("avg_pct_change"), F.try_divide(F.sum(F.col("pct_change") * F.col("amount")), F.sum("amount")).alias("amount_weighted_pct_change"), F.avg(up).alias("up_ratio"), F.sum("amount").alias("amount"))


def sector_index(days: DataFrame) -> DataFrame:
    """Index of each sector on the market calendar; a missing day moves nothing (K7). Calendar and sectors are dimensions."""
    grid = days.select("trade_date").distinct().join(days.select("sector_type", "sector_label").distinct())
    df = grid.join(days, ["trade_date", "sector_type", "sector_label"], "left").withColumn("ret", F.coalesce(F.col("avg_pct_change") / 100, F.lit(0.0)))
    return df.withColumn("sector_index", F.exp(F.sum(F.log1p("ret")).over(by_sector().rowsBetween(Window.unboundedPreceding, 0)))).select("sector_type", "sector_label", "trade_date", "ret", "sector_index")


def longest_up_run(index: DataFrame) -> DataFrame:
    """Most days in a row that a sector rose."""
    df = index.withColumn("n", F.row_number().over(by_sector())).where("ret > 0").withColumn("g", F.col("n") - F.row_number().over(by_sector()))
    return df.groupBy("sector_label", "g").count().groupBy("sector_label").agg(F.max("count").alias("longest_up_run"))
