"""Cross-section scores, deciles and validation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import corr


def score_100(value: str, by: list[str], higher_is_better: bool = True) -> F.Column:
    """Largest rank of ties from 0 to 100, 2 digits; 100 for a single value, null stays null."""
    v = F.col(value) if higher_is_better else -F.col(value)
    w = Window.partitionBy(*by)
    upto, n = F.count(v).over(w.orderBy(v).rangeBetween(Window.unboundedPreceding, 0)), F.count(v).over(w)
    return F.when(F.col(value).isNotNull(), F.when(n == 1, 100.0).otherwise(F.round(F.try_divide(upto - 1, n - 1) * 100, 2)))


def percentile_score(value: str, by: list[str], higher_is_better: bool = True) -> F.Column:
    """Average rank to 0-100; 50 for null, 100 for a single value."""
    v = F.col(value) if higher_is_better else -F.col(value)
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    rank = F.rank().over(w.orderBy(v.asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2
    return F.when(F.col(value).isNull(), 50.0).when(n == 1, 100.0).otherwise((rank - 1) * 100.0 / (n - 1))


def winsorised(value: str, by: list[str], low: float = 0.01, high: float = 0.99) -> F.Column:
    """The value within its quantiles across the group."""
    w = Window.partitionBy(*by)
    return F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.percentile(value, low).over(w)), F.percentile(value, high).over(w)))


def linear_score(c: F.Column, low: float, high: float) -> F.Column:
    """0 at low to 100 at high, clipped; 50 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (c - low) / (high - low) * 100)), F.lit(50.0))


def centred(c: F.Column) -> F.Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 2 * F.abs(c - 80)))


def mixed_scores(df: DataFrame) -> DataFrame:
    """Centred risk and mixed scores of phase1/2/4_score_100."""
    p1, p2, p4 = (F.col(f"phase{k}_score_100") for k in (1, 2, 4))
    return df.withColumns({"centered_risk_score": F.round(p4 + 0.08 * centred(p1) + 0.12 * centred(p2), 4), "mixed_score": F.round(p4 + 0.2 * p1 + 0.2 * p2, 4)})


def decile(value: str, by: list[str], rule: str = "a") -> F.Column:
    """Deciles 0-9 by rank with a symbol tie-break: rule a cuts (r-1)/(n-1), b cuts r/n, c is a but floor under 10 rows."""
    w = Window.partitionBy(*by)
    r, n = F.row_number().over(w.orderBy(value, "symbol")).cast("double"), F.count(F.lit(1)).over(w)
    a = F.greatest(F.ceil(F.try_divide((r - 1) * 10, n - 1)) - 1, F.lit(0))
    b = F.least(F.greatest(F.ceil(r * 10 / n) - 1, F.lit(0)), F.lit(9))
    out = {"a": F.coalesce(a, F.lit(0)), "b": b, "c": F.when(n < 10, F.floor((r - 1) * 10 / n)).otherwise(F.coalesce(a, F.lit(0)))}[rule]
    return out.cast("int")


def average_rank(value: str, by: list[str]) -> F.Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def daily_ic(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Correlation and rank correlation of score and label by day."""
    df = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    df = df.withColumns({"_s": average_rank(score, ["trade_date"]), "_l": average_rank(label, ["trade_date"])})
    agg = df.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), corr(score, label).alias("ic"), corr("_s", "_l").alias("rank_ic"))
    return agg.where("n >= 3")


def signal_metrics(ic: DataFrame) -> DataFrame:
    """Mean IC, ICIR with the population deviation, share of positive days."""
    return ic.agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_pop("ic")).alias("icir"), F.avg("rank_ic").alias("mean_rank_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"))


def classification_metrics(df: DataFrame, score: str, label: str, at: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy, Brier score."""
    p, y = F.col(score) >= at, F.col(label) == 1
    s = lambda c: F.sum(c.cast("long"))
    agg = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(s(p & y).alias("tp"), s(p & ~y).alias("fp"), s(~p & y).alias("fn"), s(~p & ~y).alias("tn"), F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"))
    agg = agg.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.expr("tp + fp + fn + tn"))})
    return agg.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def running_totals(df: DataFrame, order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """Running sums of columns by falling order over distinct values: ranges of the order, sums of ranges, then within each.

    Only the `parts` sums of ranges come together in one task.
    """
    cuts = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10000).alias("c"))
    df = df.crossJoin(F.broadcast(cuts)).withColumn("_part", F.expr(f"size(filter(c, x -> x < {order}))")).drop("c")  # one row of cuts
    before = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    base = base.select("_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    w = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(base), "_part")  # a row a range
    return out.withColumns({f"run_{c}": F.col(f"_b_{c}") + F.sum(c).over(w) for c in columns}).drop("_part", *[f"_b_{c}" for c in columns])


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by counts at each distinct score, average precision; null with one class (V11). Partial sums by score first."""
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    by = running_totals(by, score, ["p", "n"]).withColumnsRenamed({"run_p": "tp", "run_n": "fp"})
    agg = by.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(F.when(both, F.col("area") / (F.col("P") * F.col("N"))).alias("roc_auc"), F.when(both, F.col("ap") / F.col("P")).alias("average_precision"))


def decile_report(df: DataFrame, score: str, outcome: str, by: list[str], rule: str = "b") -> DataFrame:
    d = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("decile", decile(score, by, rule))
    return d.groupBy("decile").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(outcome).alias("mean_outcome"), F.percentile(outcome, 0.5).alias("median_outcome"), F.avg((F.col(outcome) > 0).cast("double")).alias("hit_rate"))


def rolling_score(df: DataFrame, value: str, n: int = 5, least: int = 3) -> DataFrame:
    """Rolling mean, population deviation and distance from the mean of a score."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    f = w.rowsBetween(1 - n, 0)
    ok = F.count(value).over(f) >= least
    return df.withColumns({f"{value}_mean": F.when(ok, F.avg(value).over(f)), f"{value}_std": F.when(ok, F.stddev_pop(value).over(f)), f"{value}_delta": F.when(ok, F.col(value) - F.avg(value).over(f))})


def streaks(lists: DataFrame) -> DataFrame:
    """Days in a row that a symbol has been on the list, by list dates."""
    days = lists.select("trade_date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("trade_date")))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    df = lists.join(days, "trade_date").withColumn("_g", F.col("_d") - F.row_number().over(w))
    return df.withColumn("streak", F.row_number().over(Window.partitionBy("symbol", "_g").orderBy("trade_date"))).drop("_d", "_g")


def top_k_turnover(df: DataFrame, score: str, outcome: str, k: int = 5, open_cost: float = 0.0005, close_cost: float = 0.0015) -> DataFrame:
    """The k best of each day, what is bought and sold against the day before, cost and net return."""
    w = Window.partitionBy("trade_date").orderBy(F.desc(score), "symbol")
    top = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    day = top.groupBy("trade_date").agg(F.collect_set("symbol").alias("held"), F.avg(outcome).alias("gross"))  # k symbols a day
    before = F.coalesce(F.lag("held").over(Window.orderBy("trade_date")), F.array().cast("array<string>"))
    day = day.withColumns({"bought": F.size(F.array_except("held", before)), "sold": F.size(F.array_except(before, "held"))})
    return day.select("trade_date", "gross", "bought", "sold", (F.col("gross") - (F.col("bought") * open_cost + F.col("sold") * close_cost) / k).alias("net"))
