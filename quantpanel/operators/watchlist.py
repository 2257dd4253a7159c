"""Watchlists of a day: patterns by tier, patterns with the best return scores, and the pool of the next day.

All rows of a list carry trade_date, so one call makes the lists of all days; windows run over the symbols of a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .routes import EXCLUDED
from .scores import centred, mixed_scores

# Priority of patterns, tiers, marks of index names, floors of the scores, the return that excludes, sizes.
PRIORITY = {"5": 6.0, "1": 5.0, "6": 4.0, "3": 3.0, "2": 2.0, "4": 1.0}
TIERS = {"5": "第一梯队", "1": "第一梯队", "6": "第二梯队", "3": "第二梯队"}
LAST_TIER = "第三梯队"
INDEX_NAMES = ("指数", "上证综指", "深证成指", "创业板指", "沪深300", "中证500", "中证1000", "科创50")
FLOORS = {"phase1_score_100": 40.0, "phase2_score_100": 50.0, "phase4_score_100": 70.0}
LIMIT_UP = 0.099
PATTERNS, RETURNS, POOL_PATTERNS, POOL_RETURNS, POOL = 30, 20, 0, 200, 200


def _looked_up(c: F.Column, table: dict, default) -> F.Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def pattern_scores(rows: DataFrame) -> DataFrame:
    """rows with pattern_priority, base_tier, stable_score and risk_excluded.

    rows: pattern_id, risk_score, atr_pct_14 (above 1: percent), macd_cross_state, macd_divergence_state,
    volume_price_divergence_state, macd_top_divergence_15d, macd_bottom_divergence_15d, bullish_ and
    bearish_volume_price_divergence_flag. Missing values add nothing and exclude nothing.
    """
    id_ = F.col("pattern_id").cast("string")
    state = lambda c, value: F.coalesce(F.lower(F.trim(c)) == value, F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    plus = lambda c, value: F.when(c, value).otherwise(0.0)
    atr = F.when(F.col("atr_pct_14") > 1, F.col("atr_pct_14") / 100).otherwise(F.col("atr_pct_14"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    score = (
        _looked_up(id_, PRIORITY, 0.0) + plus(finite("risk_score"), F.greatest(F.lit(0.0), 1 - F.col("risk_score"))) + plus(flag("macd_bottom_divergence_15d"), 0.6) + plus(state("macd_cross_state", "golden_cross"), 0.4)
        + plus(state("macd_divergence_state", "bottom_divergence"), 0.4) + plus(state("volume_price_divergence_state", "bullish"), 0.4) + plus(flag("bullish_volume_price_divergence_flag"), 0.4)
        - plus(finite("atr_pct_14"), F.least(F.greatest(atr, F.lit(0.0)), F.lit(0.2)))
    )
    excluded = state("macd_cross_state", "dead_cross") | state("macd_divergence_state", "top_divergence") | state("volume_price_divergence_state", "bearish") | flag("macd_top_divergence_15d") | flag("bearish_volume_price_divergence_flag")
    return rows.withColumns({"pattern_priority": _looked_up(id_, PRIORITY, 0.0), "base_tier": _looked_up(id_, TIERS, LAST_TIER), "stable_score": F.round(score, 4), "risk_excluded": excluded})


def is_index(name: str = "name") -> F.Column:
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), " ", "")
    found = F.lit(False)
    for mark in INDEX_NAMES:
        found = found | plain.contains(mark)
    return found


def pattern_watchlist(rows: DataFrame, limit: int | None = PATTERNS) -> DataFrame:
    """The first `limit` pattern rows of each day by tier, score, priority and symbol; indices and risks are out.

    Tiers go in the order of their names. list_rank counts from 1.
    """
    df = pattern_scores(rows).where(~is_index() & ~F.col("risk_excluded"))
    order = ["base_tier", F.desc("stable_score"), F.desc("pattern_priority"), "symbol", "pattern_id"]
    df = df.withColumn("list_rank", F.row_number().over(Window.partitionBy("trade_date").orderBy(*order)))
    return df if limit is None else df.where(F.col("list_rank") <= limit)


def evaluated(phase1: DataFrame, phase2: DataFrame, phase4: DataFrame, extras: DataFrame, patterns: DataFrame) -> DataFrame:
    """Symbols of both risk phases with the return phase, the centred score, their patterns and whether the day excludes them.

    extras: trade_date, symbol, daily_return (fraction) and what else is to be carried; patterns: trade_date, symbol,
    pattern_id. A missing return excludes nothing, a missing return phase leaves no centred score.
    """
    keys = ["trade_date", "symbol"]
    hits = patterns.groupBy(*keys).agg(F.max(_looked_up(F.col("pattern_id").cast("string"), PRIORITY, 0.0)).alias("pattern_priority"))
    df = mixed_scores(phase1.join(phase2, keys).join(phase4, keys, "left")).join(extras, keys, "left").join(hits, keys, "left")
    return _marked(df)


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumns({"limit_up": F.coalesce(F.col("daily_return") > LIMIT_UP, F.lit(False)), "pattern_match": F.col("pattern_priority").isNotNull(), "phase1_center_score": centred(F.col("phase1_score_100")), "phase2_center_score": centred(F.col("phase2_score_100"))})


def evaluated_days(df: DataFrame) -> DataFrame:
    """What `evaluated` gives of rows that hold all phases themselves: a sort of the day for each score, and nothing joined.

    df: trade_date and symbol (a row of both once), p1, p2 (risks), p4 (return), p8 with limit (excluded from it), daily_return,
    ids (patterns). All rows stay; `phased` tells those that `evaluated` would have, the others have risks of one phase or none.
    """
    day = Window.partitionBy("trade_date")
    df = df.withColumn("p8", F.when(~F.coalesce("limit", F.lit(False)), F.col("p8")))
    n = {c: F.count(c).over(day) for c in ("p1", "p2", "p4", "p8")}
    place = lambda n, upto: F.when(n == 1, 100.0).otherwise(F.round(F.try_divide(upto - 1, n - 1) * 100, 2))
    for k in (1, 2):
        c = f"p{k}"
        df = df.withColumn("_r", F.row_number().over(day.orderBy(F.desc(c), "symbol")))
        df = df.withColumns({"_u": F.count(c).over(day.orderBy(F.desc(c)).rangeBetween(Window.unboundedPreceding, 0)), "_n": n[c], "_x": F.count_if(F.isnan(c)).over(day)})
        upto = F.when(F.isnan(c), F.col("_n")).otherwise(F.col("_u") - F.col("_x"))  # the least risk is 100, and so is one that is no number
        df = df.withColumns({f"phase{k}_excluded": F.when(F.col(c).isNotNull(), F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * EXCLUDED))), f"phase{k}_score_100": F.when(F.col(c).isNotNull(), place(F.col("_n"), upto))})
    for k in (8, 4):
        c = f"p{k}"
        df = df.withColumn("_r", F.row_number().over(day.orderBy(F.desc(c), "symbol"))) if k == 8 else df
        df = df.withColumns({"_u": F.rank().over(day.orderBy(F.desc(c))), "_n": n[c]})
        df = df.withColumn(f"phase{k}_score_100", F.when(F.col(c).isNotNull(), place(F.col("_n"), F.col("_n") - F.col("_u") + 1)))
        df = df.withColumn("phase8_rank", F.when(F.col(c).isNotNull(), F.col("_r"))) if k == 8 else df
    priority = F.array_max(F.transform("ids", lambda x: _looked_up(x, PRIORITY, 0.0)))
    df = mixed_scores(df).withColumns({"phased": F.col("p1").isNotNull() & F.col("p2").isNotNull(), "pattern_priority": priority, "today_limit_up_excluded": F.col("limit")})
    return _marked(df).drop("_r", "_u", "_n", "_x", "p1", "p2", "p4", "p8", "limit", "ids")


def _best() -> list[F.Column]:
    return [F.col(c).desc_nulls_last() for c in ("centered_risk_score", "phase4_score_100", "phase1_center_score", "phase2_center_score")] + [F.col("symbol").asc()]


def _within(keep: F.Column, order: list[F.Column]) -> F.Column:
    """Rank among the rows of a day that keep; null of the others."""
    return F.when(keep, F.row_number().over(Window.partitionBy("trade_date", keep).orderBy(*order)))


def _states(rows: DataFrame) -> DataFrame:
    """rows with what the policies of the daily list say of each."""
    hard = ~F.coalesce("phase1_excluded", F.lit(True)) & ~F.coalesce("phase2_excluded", F.lit(True))
    floors = F.col("centered_risk_score").isNotNull()
    for c, least in FLOORS.items():
        floors = floors & (F.col(c) >= least)
    df = rows.withColumns({"hard_pass": hard, "by_pattern": F.col("pattern_match") & ~F.col("limit_up")})
    df = df.withColumn("by_return", F.coalesce(F.col("hard_pass") & ~F.col("limit_up") & floors, F.lit(False)))
    return df.withColumn("composite_rank", _within(F.col("by_return"), _best()))


def daily_watchlist(rows: DataFrame, top: int = RETURNS) -> DataFrame:
    """All patterns of a day and the `top` rows above the floors; patterns first, then the centred score.

    rows come from `evaluated`. source tells which policy let a row in, patterns going before the scores.
    """
    df = _states(rows).where(F.col("by_pattern") | (F.col("composite_rank") <= top))
    df = df.withColumn("source", F.when(F.col("by_pattern"), "pattern").otherwise("phase4_top"))
    order = [F.desc("pattern_match"), F.coalesce("centered_risk_score", "phase4_score_100").desc_nulls_last(), F.col("symbol").asc()]
    return df.withColumn("list_rank", F.row_number().over(Window.partitionBy("trade_date").orderBy(*order)))


def daily_counts(rows: DataFrame, phase1: DataFrame, phase2: DataFrame, top: int = RETURNS) -> DataFrame:
    """A row a day: how many symbols each policy of the daily list let in or out (R19), in one aggregate of each input."""
    of = lambda df, k: df.groupBy("trade_date").agg(F.count(F.lit(1)).alias(f"phase{k}_rows"), F.count_if(F.coalesce(f"phase{k}_excluded", F.lit(False))).alias(f"phase{k}_excluded_top20"))
    df = _states(rows)
    n = df.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("phase1_phase2_intersection"), F.count_if("hard_pass").alias("hard_filter_pass_count_before_limit_up_filter"), F.count_if((F.col("hard_pass") | F.col("pattern_match")) & F.col("limit_up")).alias("limit_up_excluded_gt_9_9pct"),
        F.count_if(F.col("hard_pass") & ~F.col("limit_up")).alias("hard_filter_pass_count"), F.count_if("by_pattern").alias("pattern_symbols_direct"), F.count_if("by_return").alias("phase4_top_candidates_after_score_floor"),
        F.count_if((F.col("composite_rank") <= top) & ~F.col("by_pattern")).alias("phase4_top_n_added_count"), F.count_if(F.col("by_pattern") | (F.col("composite_rank") <= top)).alias("candidate_count"),
    )
    return n.join(of(phase1, 1), "trade_date").join(of(phase2, 2), "trade_date")


def intraday_pool(rows: DataFrame, patterns: DataFrame, pattern_limit: int = POOL_PATTERNS, top: int = POOL_RETURNS, size: int = POOL) -> DataFrame:
    """The pool of the next day: patterns up to a limit, the `top` centred scores, and phase 8 scores until it has `size`.

    rows come from `evaluated` and have phase8_score_100, phase8_rank and today_limit_up_excluded (all may be null);
    patterns that none of rows has come in without scores. The first two parts are whole even where they pass `size`.
    tags names the parts that met a symbol: a symbol of the pool that the filling passes before the pool is full is tagged
    as well. Returns trade_date, symbol, source, tags, pool_rank, phase8_pool_rank.
    """
    keys = ["trade_date", "symbol"]
    lone = patterns.groupBy(*keys).agg(F.max(_looked_up(F.col("pattern_id").cast("string"), PRIORITY, 0.0)).alias("pattern_priority")).join(rows.select(*keys), keys, "left_anti")
    return pool_of(rows.select(*keys, *POOL_SCORES, "pattern_priority").unionByName(lone, allowMissingColumns=True), pattern_limit, top, size)


POOL_SCORES = ["centered_risk_score", "phase4_score_100", "phase1_center_score", "phase2_center_score", "phase8_score_100", "phase8_rank", "limit_up", "today_limit_up_excluded"]


def pool_of_days(days: DataFrame, pattern_limit: int = POOL_PATTERNS, top: int = POOL_RETURNS, size: int = POOL) -> DataFrame:
    """intraday_pool of rows of `evaluated_days`: those with patterns alone are in, without scores."""
    rows = days.where(F.col("phased") | F.col("pattern_match"))
    return pool_of(rows.select("trade_date", "symbol", *[F.when(F.col("phased"), F.col(c)).alias(c) for c in POOL_SCORES], "pattern_priority"), pattern_limit, top, size)


def pool_of(df: DataFrame, pattern_limit: int, top: int, size: int) -> DataFrame:
    """The pool of each day from its scored rows and those of patterns alone."""
    keys = ["trade_date", "symbol"]
    fit = ~F.coalesce("limit_up", F.lit(False))
    returns, fills = fit & F.col("centered_risk_score").isNotNull(), fit & F.col("phase8_score_100").isNotNull() & ~F.coalesce("today_limit_up_excluded", F.lit(False))
    p4 = F.col("phase4_score_100").desc_nulls_last()
    df = df.withColumns({"r0": _within(F.col("pattern_priority").isNotNull(), [p4, F.desc("pattern_priority"), F.col("symbol").asc()]), "r1": _within(returns, _best()), "r2": _within(fills, [F.desc("phase8_score_100"), p4, F.col("symbol").asc()])})
    # the pool has no place behind these ranks: patterns and returns take `pattern_limit` and `top` at most, and the filling stops at `size`
    df = df.where(F.coalesce(F.col("r0") <= pattern_limit, F.lit(False)) | F.coalesce(F.col("r1") <= top, F.lit(False)) | F.coalesce(F.col("r2") <= size + pattern_limit + top, F.lit(False)))
    df = df.withColumns({"r0": F.when(F.col("r0") <= pattern_limit, F.col("r0")), "r1": F.when(F.col("r1") <= top, F.col("r1"))})
    fixed, day = F.col("r0").isNotNull() | F.col("r1").isNotNull(), Window.partitionBy("trade_date")
    before = F.sum((F.col("r2").isNotNull() & ~fixed).cast("int")).over(day.orderBy(F.col("r2").asc_nulls_last(), "symbol").rowsBetween(Window.unboundedPreceding, -1))
    room = F.lit(size) - F.sum(fixed.cast("int")).over(day)
    df = df.withColumn("r2", F.when(F.coalesce(before, F.lit(0)) < room, F.col("r2")))
    names = ["pattern_pool", f"p124_top{top}", "p8_fill"]
    tags = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"r{k}").isNotNull(), n) for k, n in enumerate(names)])), "/")
    source = F.coalesce(*[F.when(F.col(f"r{k}").isNotNull(), F.lit(k)) for k in range(3)])
    df = df.withColumns({"tags": tags, "_s": source}).where(F.col("_s").isNotNull())
    rank = F.row_number().over(day.orderBy("_s", F.element_at(F.array("r0", "r1", "r2"), F.col("_s") + 1)))
    return df.select(*keys, F.element_at(F.array(*map(F.lit, names)), F.col("_s") + 1).alias("source"), "tags", rank.alias("pool_rank"), F.when(F.col("_s") == 2, F.col("phase8_rank")).alias("phase8_pool_rank"))
