"""Leaders of sectors: long-term metrics of members, swings of the sector, scores of both and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_symbol
from .scores import percentile_score, winsorised
from .sectors import newest_days

KEY = ["sector_type", "sector_label"]
# Market days looked at, least history and members, weights of the scores.
LOOKBACK, DAYS, MEMBERS, TOP, EVENT_TOP = 504, 180, 5, 10, 10
LONG = {"return": 0.25, "excess": 0.25, "outperform": 0.15, "new_high": 0.10, "liquidity": 0.15, "drawdown_quality": 0.10}
EVENT = {"early_return": 0.25, "early_excess": 0.20, "total_return": 0.25, "total_excess": 0.20, "volume_expansion": 0.10}


def _sum(weights: dict[str, float]) -> F.Column:
    return sum((w * F.col(f"{c}_score") for c, w in weights.items()), F.lit(0.0))


def _clip(c: F.Column) -> F.Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def sector_history(bars: DataFrame, members: DataFrame, days: int = DAYS, least: int = MEMBERS, lookback: int = LOOKBACK, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(rows, index): bars of members with enough history, and the index of each sector over days of enough members.

    Only the last `lookback` market dates of members count. index has ret (percent), total_amount, sector_index from 100, and pos from 0.
    """
    r = F.coalesce(F.col("pct_change"), (F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1) * 100)
    df = bars.select("symbol", "trade_date", "close", "amount", r.alias("return_pct")).join(members.select("symbol").distinct(), "symbol", "left_semi")
    df = newest_days(df, lookback).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    rows = keep(df.where(F.col("_n") >= days).drop("_n").join(members.select("symbol", *KEY).distinct(), "symbol"))
    day = rows.groupBy(*KEY, "trade_date").agg(F.avg("return_pct").alias("ret"), F.count("return_pct").alias("valid_count"), F.sum("amount").alias("total_amount")).where(F.col("valid_count") >= least)
    w = Window.partitionBy(*KEY).orderBy("trade_date")
    index = day.withColumns({"pos": F.row_number().over(w) - 1, "sector_index": 100 * F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)) / 100)).over(w.rowsBetween(Window.unboundedPreceding, 0))), "_n": F.count(F.lit(1)).over(Window.partitionBy(*KEY))})
    return rows, keep(index.where(F.col("_n") >= days).drop("_n", "valid_count"))


def long_scores(rows: DataFrame, index: DataFrame, days: int = DAYS, least: int = MEMBERS) -> DataFrame:
    """Return, excess, outperformance, new highs, drawdown, recovery and share of amount of each member (K15), scored."""
    total = index.groupBy(*KEY).agg(((F.try_divide(F.max_by("sector_index", "pos"), F.min_by("sector_index", "pos")) - 1) * 100).alias("sector_return_pct"), F.sum("total_amount").alias("sector_amount"))
    df = rows.join(F.broadcast(index.select(*KEY, "trade_date", "ret")), [*KEY, "trade_date"]).where("close is not null and return_pct is not null")  # a row a sector and day of `lookback` days
    w = Window.partitionBy(*KEY, "symbol").orderBy("trade_date")
    top = F.max("close").over(w.rowsBetween(-119, 0))
    df = df.withColumns({"dd": F.try_divide(F.col("close"), F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1, "fresh": F.coalesce((F.count("close").over(w.rowsBetween(-119, 0)) == 120) & (F.col("close") >= top), F.lit(False)).cast("int")})
    last, first = F.max_by("close", "trade_date"), F.min_by("close", "trade_date")
    agg = df.groupBy(*KEY, "symbol").agg(
        F.count(F.lit(1)).alias("days"), first.alias("first_close"), ((F.try_divide(last, first) - 1) * 100).alias("return_pct"), F.avg((F.col("return_pct") > F.col("ret")).cast("double")).alias("outperform_ratio"), F.sum("fresh").alias("new_high_count_120d"),
        ((F.try_divide(last, F.max("close")) - 1) * 100).alias("distance_to_high_pct"), (F.min("dd") * 100).alias("max_drawdown_pct"), ((F.try_divide(last, F.min_by("close", F.struct("dd", "trade_date"))) - 1) * 100).alias("recovery_pct"), F.sum(F.greatest("amount", F.lit(0.0))).alias("amount"),
    ).where(F.col("days") >= days).where("first_close > 0")
    df = agg.join(total, KEY).withColumns({"excess_pct": F.col("return_pct") - F.col("sector_return_pct"), "amount_share_pct": F.try_divide("amount", "sector_amount") * 100})
    df = df.withColumn("valid_members", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).where(F.col("valid_members") >= least)
    df = df.withColumn("_share", winsorised("amount_share_pct", KEY))
    score = lambda c: percentile_score(c, KEY)
    df = df.withColumns({"return_score": score("return_pct"), "excess_score": score("excess_pct"), "outperform_score": score("outperform_ratio"), "new_high_score": 0.6 * score("new_high_count_120d") + 0.4 * score("distance_to_high_pct"), "liquidity_score": score("_share"), "drawdown_quality_score": 0.7 * score("max_drawdown_pct") + 0.3 * score("recovery_pct")})
    return df.withColumn("long_score", _clip(_sum(LONG))).drop("_share", "first_close", "days", "amount", "sector_amount")


def swing_candidates(index: DataFrame, shortest: int = 5, longest: int = 60, rise: float = 0.08, rolling: int = 20, rolling_rise: float = 0.05) -> DataFrame:
    """(start_pos, end_pos, start_date, end_date, return_pct, kind): the best end of each start, and 20-day rises."""
    w = Window.partitionBy(*KEY).orderBy("pos")
    path = F.collect_list(F.struct("sector_index", (-F.col("pos")).alias("p"), "trade_date")).over(w.rowsBetween(shortest, longest))
    at = F.lead(F.struct("sector_index", (-F.col("pos")).alias("p"), "trade_date"), rolling).over(w)
    df = index.select(*KEY, "pos", "trade_date", "sector_index", F.array_max(path).alias("best"), at.alias("later"))
    both = df.select("*", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("best").alias("e"), F.lit(rise).alias("least")), F.struct(F.lit(1).alias("kind"), F.col("later").alias("e"), F.lit(rolling_rise).alias("least")))).alias("c"))
    r = F.try_divide("c.e.sector_index", "sector_index") - 1
    return both.where((r >= F.col("c.least")) & (F.col("sector_index") > 0)).select(*KEY, F.col("pos").alias("start_pos"), (-F.col("c.e.p")).alias("end_pos"), F.col("trade_date").alias("start_date"), F.col("c.e.trade_date").alias("end_date"), (r * 100).alias("return_pct"), "c.kind")


def select_swings(candidates: DataFrame) -> DataFrame:
    """Swings that do not overlap, the largest first; the first candidate on ties to nine digits (K19). event_index counts by start.

    A sector's candidates are two for each day at most, so they are one sorted array folded into the few that stay.
    """
    row = F.struct((-F.round("return_pct", 9)).alias("r"), "kind", "start_pos", "end_pos", "start_date", "end_date")
    one = candidates.groupBy(*KEY).agg(F.sort_array(F.collect_list(row)).alias("all"))
    keep = "aggregate(all, slice(all, 1, 0), (kept, c) -> if(exists(kept, k -> c.start_pos <= k.end_pos and k.start_pos <= c.end_pos), kept, concat(kept, array(c))))"
    df = one.select(*KEY, F.explode(F.expr(keep)).alias("s")).select(*KEY, "s.start_pos", "s.end_pos", "s.start_date", "s.end_date", (-F.col("s.r")).alias("return_pct"))
    return df.withColumn("event_index", F.row_number().over(Window.partitionBy(*KEY).orderBy("start_pos")))


def event_scores(rows: DataFrame, index: DataFrame, swings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Early and whole return and excess and the rise of amount of each member in each swing, scored and ranked.

    A swing meets the days from 20 before its start to its end: an equality join on positions.
    """
    at = swings.withColumn("early_pos", F.least("end_pos", F.col("start_pos") + 5)).withColumn("pos", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start_pos") - 20), F.col("end_pos"))))
    at = at.join(index.select(*KEY, "pos", "trade_date", "sector_index"), [*KEY, "pos"])
    on = lambda p, c: F.max(F.when(F.col("pos") == F.col(p), F.col(c)))
    frame = at.groupBy(*KEY, "event_index").agg(*[on(p, "sector_index").alias(f"s_{p}") for p in ("start_pos", "early_pos", "end_pos")])
    mine = rows.join(symbols.select(*KEY, "symbol").distinct(), [*KEY, "symbol"])
    met = mine.join(F.broadcast(at), [*KEY, "trade_date"])  # days of the swings of each sector
    inside, before = F.col("pos") >= F.col("start_pos"), F.col("pos") < F.col("start_pos")
    agg = met.groupBy(*KEY, "event_index", "symbol").agg(*[on(p, "close").alias(f"c_{p}") for p in ("start_pos", "early_pos", "end_pos")], F.avg(F.when(inside, F.col("amount"))).alias("a1"), F.avg(F.when(before, F.col("amount"))).alias("a0"))
    df = agg.join(frame, [*KEY, "event_index"]).where("c_start_pos > 0 and c_early_pos is not null and c_end_pos is not null")
    gain = lambda x, p: (F.try_divide(f"{x}_{p}", f"{x}_start_pos") - 1) * 100
    df = df.withColumns({"early_return": gain("c", "early_pos"), "early_excess": gain("c", "early_pos") - gain("s", "early_pos"), "total_return": gain("c", "end_pos"), "total_excess": gain("c", "end_pos") - gain("s", "end_pos"), "_v": F.when(F.col("a0") > 0, F.try_divide("a1", "a0"))})
    by = [*KEY, "event_index"]
    df = df.withColumn("volume_expansion", winsorised("_v", by))
    df = df.withColumns({f"{c}_score": percentile_score(c, by) for c in EVENT}).withColumn("event_score", _sum(EVENT))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("event_score"), "symbol"))
    return df.withColumn("event_rank", rank).select(*by, "symbol", "early_return", "early_excess", "total_return", "total_excess", F.col("_v").alias("volume_expansion"), "event_score", "event_rank")


def swing_scores(long: DataFrame, events: DataFrame, swings: DataFrame) -> DataFrame:
    """long with lead count and ratio, the three best scores, excess, best rank, newest score and the swing score."""
    n = swings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("swing_count"))
    best = "aggregate(slice(sort_array(collect_list(event_score), false), 1, 3), struct(0D as s, 0 as n), (a, x) -> struct(a.s + x as s, a.n + 1 as n), a -> a.s / a.n)"  # scores of one member's swings
    agg = events.groupBy(*KEY, "symbol").agg(F.sum((F.col("event_rank") <= EVENT_TOP).cast("int")).alias("swing_lead_count"), F.expr(best).alias("avg_event_score"), F.avg("total_excess").alias("_excess"), F.min("event_rank").alias("best_swing_rank"), F.max_by("event_score", "event_index").alias("recent_event_score"))
    any_ = events.select(*KEY).distinct().withColumn("scored", F.lit(True))
    df = long.join(n, KEY, "left").join(any_, KEY, "left").join(agg, [*KEY, "symbol"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = df.withColumns({"scored": F.coalesce("scored", F.lit(False)), "swing_count": F.when(F.col("scored"), F.col("swing_count")).otherwise(0), "swing_lead_count": F.coalesce("swing_lead_count", F.lit(0)), "avg_swing_excess_pct": zero("_excess"), "avg_event_score": zero("avg_event_score"), "recent_event_score": zero("recent_event_score")})
    df = df.withColumn("swing_lead_ratio", F.col("swing_lead_count") / F.greatest("swing_count", F.lit(1)))
    rank = F.when(F.col("best_swing_rank").isNull(), 0.0).otherwise(percentile_score("best_swing_rank", KEY, False))
    score = 0.35 * F.col("avg_event_score") + 0.25 * _clip(F.col("swing_lead_ratio") * 100) + 0.20 * percentile_score("avg_swing_excess_pct", KEY) + 0.10 * rank + 0.10 * F.col("recent_event_score")
    return df.withColumn("swing_score", F.when(F.col("scored"), _clip(F.coalesce(score, F.lit(0.0)))).otherwise(0.0)).drop("_excess", "scored")


def ranked(scores: DataFrame) -> DataFrame:
    """Combined score, three ranks, dual leaders and tags."""
    df = scores.withColumn("combined_score", _clip(0.55 * F.col("long_score") + 0.45 * F.col("swing_score")))
    rank = lambda a, b: F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(a), F.desc(b), "symbol"))
    df = df.withColumns({"long_rank": rank("long_score", "combined_score"), "swing_rank": rank("swing_score", "combined_score"), "combined_rank": rank("combined_score", "long_score")})
    long, swing = F.col("long_rank") <= 5, F.col("swing_rank") <= 5
    first = F.when(long & swing, "双重龙头").when(long, "长期核心").when(swing, "波段先锋")
    tags = F.array_join(F.array_compact(F.array(first, F.when(F.col("long_score") >= 70, "长期核心候选"), F.when(F.col("swing_score") >= 70, "波段活跃候选"))), "/")
    return df.withColumns({"is_dual_leader": long & swing, "leader_tags": tags})


def leader_scores(bars: DataFrame, members: DataFrame, keep=lambda df: df) -> DataFrame:
    """All scores of all members of sectors with enough history (K15-K22). keep stores the frames that several steps read."""
    rows, index = sector_history(bars, members, keep=keep)
    long = keep(long_scores(rows, index))
    swings = keep(select_swings(swing_candidates(index)))
    return ranked(swing_scores(long, keep(event_scores(rows, index, swings, long)), swings))


def leader_table(scores: DataFrame, n: int = TOP) -> DataFrame:
    """The n best of each sector by long-term and by swing score."""
    kinds = F.explode(F.array(F.struct(F.lit("long_term").alias("leader_type"), F.col("long_rank").alias("leader_rank"), F.col("long_score").alias("leader_score")), F.struct(F.lit("swing").alias("leader_type"), F.col("swing_rank").alias("leader_rank"), F.col("swing_score").alias("leader_score"))))
    df = scores.select("*", kinds.alias("k")).where(F.col("k.leader_rank") <= n)
    return df.select(*KEY, "symbol", "k.leader_type", "k.leader_rank", F.round("k.leader_score", 4).alias("leader_score"), "leader_tags", F.round("combined_score", 4).alias("combined_score"), "is_dual_leader", "valid_members", "swing_count")


def leader_summary(scores: DataFrame) -> DataFrame:
    """A row a sector: its five best by each score, and the dual leaders."""
    def top(rank, score, keep):
        rows = F.collect_list(F.when(keep, F.struct(F.col(rank).alias("r"), F.format_string("%s (%.1f)", "symbol", score).alias("t"))))
        return F.array_join(F.transform(F.slice(F.sort_array(rows), 1, 5), lambda x: x.t), " / ")

    return scores.groupBy(*KEY).agg(F.max("valid_members").alias("valid_members"), F.max("swing_count").alias("swing_count"), top("long_rank", "long_score", F.col("long_rank") <= 5).alias("long_term_top5"), top("swing_rank", "swing_score", F.col("swing_rank") <= 5).alias("swing_top5"), top("combined_rank", "combined_score", F.col("is_dual_leader")).alias("dual_leaders"))


def skipped_sectors(bars: DataFrame, members: DataFrame, scores: DataFrame) -> DataFrame:
    """(sector, reason) of sectors without scores."""
    rows, index = sector_history(bars, members)
    n = rows.groupBy(*KEY).agg(F.countDistinct("symbol").alias("n"))
    done, dated = scores.select(*KEY).distinct(), index.select(*KEY).distinct().withColumn("dated", F.lit(True))
    df = members.select(*KEY).distinct().join(done, KEY, "left_anti").join(n, KEY, "left").join(dated, KEY, "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < MEMBERS, "insufficient_valid_members").when(F.col("dated").isNull(), "insufficient_sector_history").otherwise("insufficient_stock_metrics")
    return df.select(*KEY, reason.alias("reason"))
