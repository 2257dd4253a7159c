"""Membership of symbols in sectors: what is left out, versions by refresh, names in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["symbol", "sector_type", "sector_label"]
# Names and parts of names that are no sectors, words of descriptions, days that a stored membership serves.
IGNORED = ("2025年报预增", "2026一季报预增", "摘帽", "国家大基金持股", "新股与次新股", "注册制次新股")
IGNORED_PARTS = ("同花顺", "预增", "年报", "一季报", "中报", "半年报", "三季报", "摘帽")
DESCRIPTIVE = ("公司", "主营", "研发", "生产", "销售", "产品", "业务", "专注", "行业", "体系", "设立以来", "主要包括", "发展成为", "报告披露")
REFRESH_DAYS = 7


def clean_membership(members: DataFrame, name: str = "sector_label") -> DataFrame:
    """Rows whose name is on no list, holds no ignored part and is no description; each pair once (K1).

    A description has 24 characters or more and, of the words above, "公司" and one more, or three from 36 characters on, or
    a year's report that is disclosed. A null name stays, as it is on no list.
    """
    text = F.trim(F.coalesce(name, F.lit("")))
    hits = sum((text.contains(w).cast("int") for w in DESCRIPTIVE), F.lit(0))
    long = F.length(text)
    described = (long >= 24) & ((text.contains("公司") & (hits >= 2)) | ((long >= 36) & (hits >= 3)) | text.rlike("[0-9]{4}年.*报告.*披露"))
    ignored = text.isin(*IGNORED) | text.rlike("|".join(IGNORED_PARTS)) | described
    return members.where(~ignored).dropDuplicates(KEY)


def refresh_dates(batches: DataFrame, days: int = REFRESH_DAYS) -> DataFrame:
    """(batch_date) of the batches that are taken: the first, and each that comes more than `days` after the last taken one.

    The dates of batches are a calendar, folded as one array.
    """
    dates = batches.where("batch_date is not null").groupBy().agg(F.sort_array(F.collect_set("batch_date")).alias("d"))
    taken = f"aggregate(d, slice(d, 1, 1), (kept, x) -> if(datediff(x, element_at(kept, -1)) > {int(days)}, concat(kept, array(x)), kept))"
    return dates.where("size(d) > 0").select(F.explode(F.expr(taken)).alias("batch_date"))


def versions(batches: DataFrame, days: int = REFRESH_DAYS) -> DataFrame:
    """(symbol, sector_type, sector_label, valid_from, valid_to) of batches (batch_date, and the same key) (K2).

    Batches within `days` of the last taken one are left alone, as a stored membership still serves. A batch replaces the
    types it has rows of; a type it lacks stays as it is. Consecutive batches of a type that hold a row make one version;
    valid_to is the date of the batch that ended it, null while it holds. Null keys name nothing; repeated rows count once.
    """
    rows = batches.select("batch_date", *KEY).dropna().distinct().join(F.broadcast(refresh_dates(batches, days)), "batch_date", "left_semi")
    at = Window.partitionBy("sector_type").orderBy("batch_date")
    order = rows.select("sector_type", "batch_date").distinct().withColumns({"no": F.row_number().over(at), "next_date": F.lead("batch_date").over(at)})
    rows = rows.join(F.broadcast(order), ["sector_type", "batch_date"])  # a row a type and batch
    run = F.col("no") - F.row_number().over(Window.partitionBy(*KEY).orderBy("no"))
    return rows.withColumn("run", run).groupBy(*KEY, "run").agg(F.min("batch_date").alias("valid_from"), F.max_by("next_date", "no").alias("valid_to")).drop("run")


def as_of(history: DataFrame, on) -> DataFrame:
    """Members on a date (K2)."""
    day = F.lit(on).cast("date")
    return history.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))).select(*KEY)


def as_of_days(rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows (symbol, trade_date, ...) with the sectors the symbol was in on that day (K2).

    Versions are cut at their bounds by an equality join on the symbol, whose versions are few.
    """
    mine = history.select("symbol", F.col("sector_type"), F.col("sector_label"), "valid_from", "valid_to")
    met = rows.join(mine, "symbol").where("trade_date >= valid_from and (valid_to is null or trade_date < valid_to)")
    return met.drop("valid_from", "valid_to")


def sector_names(members: DataFrame, order: str, name: str = "sector_label") -> DataFrame:
    """(symbol, industry_names, concept_names): names of each type, "/" between them, each once where first seen (K3).

    order: a column that tells which row came first. Blank and null names are none; a symbol without names has "".
    """
    text = F.trim(name)
    first = members.where("symbol is not null").withColumn("_t", F.when(text != "", text)).groupBy("symbol", "sector_type", "_t").agg(F.min(order).alias("_at"))
    of = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("sector_type") == kind) & F.col("_t").isNotNull(), F.struct("_at", "_t")))), lambda x: x["_t"]), "/")
    return first.groupBy("symbol").agg(of("industry").alias("industry_names"), of("concept").alias("concept_names"))
