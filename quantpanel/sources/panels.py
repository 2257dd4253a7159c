"""Feature and label panels as tables by month and bucket of symbols, so that panels of one date and symbol join where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def save_panel(df: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Write rows (symbol, trade_date, ...) as a table by month, dealt over buckets of symbols and sorted in them."""
    dealt = df.withColumn("month", F.date_format("trade_date", "yyyy-MM")).repartition(buckets, "symbol")
    dealt.write.mode("overwrite").partitionBy("month").bucketBy(buckets, "symbol").sortBy("symbol", "trade_date").saveAsTable(table)


def refresh_months(df: DataFrame, table: str) -> None:
    """Replace the months that df has rows of, whole; others stay."""
    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        columns = spark.table(table).columns
        df.withColumn("month", F.date_format("trade_date", "yyyy-MM")).select(*columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", kept)


def joined_panel(spark: SparkSession, features: str, labels: str, needed: list[str]) -> DataFrame:
    """Features with the labels of the same symbol, day and month, complete in `needed` (L20): buckets meet without an exchange.

    For that the session lets a join by symbol and day use a distribution by symbol alone.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    left, right = spark.table(features), spark.table(labels)
    extra = [c for c in right.columns if c in ("symbol", "trade_date", "month") or c not in left.columns]
    return left.join(right.select(*extra).hint("merge"), ["symbol", "trade_date", "month"]).dropna(subset=needed)


def skipped_symbols(universe: DataFrame, panel: DataFrame) -> DataFrame:
    """Symbols of the universe without a row in the panel, and why."""
    return universe.select("symbol").distinct().join(panel.select("symbol").distinct(), "symbol", "left_anti").withColumn("reason", F.lit("no_complete_rows"))
