"""Reports for people: labelled columns, percents, rounding and a byte order mark, and how they are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"
# Labels of the exported columns, those that are percents, and their digits.
ATR_LABELS = {
    "symbol": "代码", "name": "名称", "trade_date": "交易日期", "close": "收盘价", "atr_14": "ATR14", "atr_pct_14": "ATR%", "atr_stop_loss_1x": "1ATR止损参考", "atr_stop_loss_2x": "2ATR止损参考",
    "atr_take_profit_2x": "2ATR止盈参考", "atr_take_profit_3x": "3ATR止盈参考", "atr_volatility_regime": "波动分层",
}
LIST_LABELS = {
    "symbol": "代码", "name": "名称", "concept_names": "概念", "pattern_match": "Pattern命中", "pattern_ids": "Pattern编号", "pattern_id": "Pattern主编号", "phase1_score_100": "P1风险质量分", "phase2_score_100": "P2交易风险分", "phase4_score_100": "P4上涨质量分",
    "phase1_center_score": "P1接近80分", "phase2_center_score": "P2接近80分", "centered_risk_score": "P1/P2/P4综合分", "composite_rank": "综合排名", "macd_cross_state": "macd交叉", "macd_divergence_state": "macd背离", "volume_price_divergence_state": "量价背离", "reason": "Pattern理由", "daily_return": "当日涨幅小数",
}
PERCENTS, DIGITS = ("atr_pct_14",), 4


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The labelled columns in their order, a missing one null; percents times 100, doubles to four digits."""
    kinds = dict(df.dtypes)
    out = []
    for c, label in labels.items():
        x = F.col(c) if c in kinds else F.lit(None).cast("string")
        if kinds.get(c) in ("double", "float"):
            x = F.round(x * 100 if c in PERCENTS else x, DIGITS)
        elif kinds.get(c) == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        elif kinds.get(c, "").startswith(("array", "struct", "map")):
            x = F.to_json(x)
        out.append(x.alias(label))
    return df.select(*out)


def spreadsheet_code(c: F.Column) -> F.Column:
    """A code that spreadsheets keep as text."""
    return F.concat(F.lit('="'), F.lpad(c, 6, "0"), F.lit('"'))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header behind a byte order mark (S3, S18, S19). A report is a row a symbol."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, labels: dict[str, str] | None = None) -> DataFrame:
    """What write_csv wrote, as text under its own names; labelled percents are fractions again, codes plain."""
    raw = spark.read.option("header", "true").option("escape", '"').csv(path)
    raw = raw.toDF(*[c.removeprefix(BOM) for c in raw.columns])
    if labels is None:
        return raw
    names = {label: c for c, label in labels.items()}
    df = raw.withColumnsRenamed({c: names[c] for c in raw.columns if c in names})
    for c in PERCENTS:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("double") / 100)
    return df.withColumn("symbol", F.regexp_replace("symbol", '^="(.*)"$', "$1")) if "symbol" in df.columns else df


def atr_export(snapshot: DataFrame) -> DataFrame:
    """The ATR snapshot under its labels (S18): rows without ATR go. snapshot: as the indicators' last rows, with name."""
    names = {"atr_stop_1": "atr_stop_loss_1x", "atr_stop_2": "atr_stop_loss_2x", "atr_take_2": "atr_take_profit_2x", "atr_take_3": "atr_take_profit_3x", "atr_regime": "atr_volatility_regime"}
    return labelled(snapshot.where("atr_14 is not null and atr_pct_14 is not null").withColumnsRenamed(names), ATR_LABELS)


def watchlist_export(rows: DataFrame) -> DataFrame:
    """A watchlist as flat labelled rows, the columns that it has, codes as text, in the order of list_rank."""
    kept = {c: label for c, label in LIST_LABELS.items() if c in rows.columns}
    return labelled(rows.orderBy("list_rank").withColumn("symbol", spreadsheet_code(F.col("symbol"))), kept)
