"""From scores to watchlists: display table, stock scores, sector selection, routes, leader pool and concern tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import position_percent
from .scores import linear_score, mixed_scores, score_100

KEY = ["sector_type", "sector_label"]
# Filters of the routes, sizes of pools, least leader score of a concern.
PUBLIC, ROUTE, LIMIT_PCT, SECTORS, POOL, LONG, SHORT, BUY, LEADERS, CONCERN, EXCLUDED = 20.0, 40.0, 9.9, 20, 5, 100, 10, 10, 3, 60.0, 0.2
# Crash measures and whether more of one is better.
CRASH_SCORES = {"negoutlier": False, "crash": False, "crash_count": False, "ncskew": False, "duvol": False, "ret": True, "sigma": False, "min_ret": True}


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def phase_risk(scores: DataFrame, score: str, prefix: str) -> DataFrame:
    """Rank by falling risk, exclusion of the first fifth, 0-100 score (R2, R10). One row a symbol of a day."""
    df = _first(scores.where(F.col(score).isNotNull()), ["trade_date", "symbol"], F.desc(score))
    w = Window.partitionBy("trade_date")
    rank, n = F.row_number().over(w.orderBy(F.desc(score), "symbol")), F.count(F.lit(1)).over(w)
    return df.select("trade_date", "symbol", F.col(score).alias(f"{prefix}_risk"), rank.alias(f"{prefix}_risk_rank"), (rank / n).alias(f"{prefix}_risk_percentile"), (rank <= F.greatest(F.lit(1), F.ceil(n * EXCLUDED))).alias(f"{prefix}_excluded"), score_100(score, ["trade_date"], False).alias(f"{prefix}_score_100"))


def phase_return(scores: DataFrame, score: str, prefix: str = "phase4") -> DataFrame:
    """Rank by falling return score, percentile, 0-100 score."""
    df = _first(scores.where(F.col(score).isNotNull()), ["trade_date", "symbol"], F.desc(score))
    w = Window.partitionBy("trade_date")
    rank = F.row_number().over(w.orderBy(F.desc(score), "symbol"))
    return df.select("trade_date", "symbol", F.col(score).alias(f"{prefix}_return"), rank.alias(f"{prefix}_rank"), (rank / F.count(F.lit(1)).over(w)).alias(f"{prefix}_percentile"), score_100(score, ["trade_date"]).alias(f"{prefix}_score_100"))


def phase_opportunity(scores: DataFrame, raw: str, excluded: str) -> DataFrame:
    """0-100 score and rank among tradable rows; the excluded have neither."""
    df = scores.withColumn("_v", F.when(~F.coalesce(F.col(excluded), F.lit(False)), F.col(raw)))
    rank = F.when(F.col("_v").isNotNull(), F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col("_v").desc_nulls_last(), "symbol")))
    return df.select("trade_date", "symbol", F.col(raw).alias("phase8_raw_score"), F.col(excluded).alias("today_limit_up_excluded"), score_100("_v", ["trade_date"]).alias("phase8_score_100"), rank.alias("phase8_rank"))


def crash_score(measures: DataFrame, year: int) -> DataFrame:
    """The newest measures of each symbol up to a year, and the mean of their 0-100 scores."""
    df = _first(measures.where(F.col("year") <= year), ["symbol"], F.desc("year")).withColumn("_all", F.lit(1))
    df = df.withColumns({f"_s_{c}": score_100(c, ["_all"], better) for c, better in CRASH_SCORES.items()})  # a row a symbol
    parts = F.array_compact(F.array(*[F.col(f"_s_{c}") for c in CRASH_SCORES]))
    mean = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
    return df.select("symbol", F.col("year").alias("phase5_year"), F.round(mean, 2).alias("phase5_score_100"), *[F.col(c).alias(f"phase5_{c}") for c in CRASH_SCORES])


def daily_return(log_return: str = "log_return", other: str = "pct_change") -> F.Column:
    """Return of the day from its logarithm, else from the percent."""
    return F.coalesce(F.expm1(F.col(log_return)), F.col(other) / 100)


def phase_display(*phases: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """All symbols of any phase with the columns of each, and the gate of the day as constants."""
    out = phases[0]
    for df in phases[1:]:
        keys = [c for c in ("trade_date", "symbol") if c in df.columns and c in out.columns]
        out = out.join(df, keys, "full")
    if gate is None:
        return out
    score = F.when(F.lower("trade_permission") == "allow", 100.0).when(F.lower("trade_permission") == "no_trade", 0.0)
    return out.crossJoin(F.broadcast(gate.select(F.col("trade_permission").alias("phase7_trade_permission"), score.alias("phase7_score_100")).limit(1)))  # one row


def stock_scores(phase1: DataFrame, phase2: DataFrame, phase4: DataFrame, extras: DataFrame, patterns: DataFrame) -> DataFrame:
    """Symbols of both risk phases with return scores, extras (daily_return_pct, atr_pct_14), patterns and the mixed scores.

    public: both risk scores above 20 and no day above 9.9 percent (R12).
    """
    ids = patterns.groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set(F.col("pattern_id").cast("string"))), "/").alias("pattern_ids"))
    df = phase1.join(phase2, ["trade_date", "symbol"]).join(phase4, ["trade_date", "symbol"], "left").join(extras, "symbol", "left").join(ids, "symbol", "left")
    df = mixed_scores(df).withColumns({"pattern_match": F.col("pattern_ids").isNotNull(), "pattern_ids": F.coalesce("pattern_ids", F.lit("")), "limit_up_excluded": F.coalesce(F.col("daily_return_pct") > LIMIT_PCT, F.lit(False)), "position_percent": position_percent(F.col("atr_pct_14"))})
    public = (F.col("phase1_score_100") > PUBLIC) & (F.col("phase2_score_100") > PUBLIC) & ~F.col("limit_up_excluded")
    return _first(df.withColumn("public", F.coalesce(public, F.lit(False))), ["symbol"], F.desc("trade_date"))


def short_score() -> F.Column:
    """Short-term strength of a sector; missing parts count 50."""
    # Weights and bounds.
    parts = ((0.25, "return_5d", -3.0, 8.0), (0.25, "return_20d", -8.0, 18.0), (0.20, "amount_weighted_pct_change", -2.0, 5.0), (0.15, "up_ratio", 0.35, 0.80), (0.15, "ma5_slope_pct", -0.8, 1.2))
    return F.round(sum((w * linear_score(F.col(c), lo, hi) for w, c, lo, hi in parts), F.lit(0.0)), 2)


def sector_scores(performance: DataFrame, mainline: DataFrame, buy: DataFrame) -> DataFrame:
    """Sectors of any of the three tables with their columns, and the short score."""
    df = performance
    for other in (mainline, buy):
        shared = [c for c in other.columns if c in df.columns and c not in KEY]
        df = df.join(other.withColumnsRenamed({c: f"_x_{c}" for c in shared}), KEY, "full")
        df = df.withColumns({c: F.coalesce(c, f"_x_{c}") for c in shared}).drop(*[f"_x_{c}" for c in shared]) if shared else df
    return select_sectors(df.withColumn("short_mainline_score_100", short_score()))


def select_sectors(df: DataFrame) -> DataFrame:
    """The 100 best by long score, and of those the ten best by short and by buy score, with their ranks (K35). A row a sector."""
    long, short, buy = "long_mainline_score_100", "short_mainline_score_100", "phase9_score_100"

    def best(score, n, inside, *order):
        w = Window.partitionBy(inside & F.col(score).isNotNull()).orderBy(F.desc(score), *order, *KEY)
        rank = F.when(inside & F.col(score).isNotNull(), F.row_number().over(w))
        return F.when(rank <= n, rank)

    df = df.withColumn("long_mainline_rank", best(long, LONG, F.lit(True)))
    pool = F.col("long_mainline_rank").isNotNull()
    df = df.withColumns({"short_mainline_rank": best(short, SHORT, pool, F.desc(long)), "phase9_rank_in_pool": best(buy, BUY, pool, F.desc(long))})
    return df.withColumns({"selected_as_long_mainline": pool, "selected_as_short_mainline": F.col("short_mainline_rank").isNotNull(), "selected_as_phase9_buy": F.col("phase9_rank_in_pool").isNotNull()})


def mainline_strength(sectors: DataFrame) -> DataFrame:
    """State of the market's main lines by the scores of the selected sectors."""
    score, rank = F.col("long_mainline_score_100"), F.col("long_mainline_rank")
    agg = sectors.where("selected_as_long_mainline").agg(F.count(F.lit(1)).alias("selected_count"), F.max(score).alias("top1_score"), F.avg(F.when(rank <= 10, score)).alias("top10_avg_score"), F.avg(F.when(rank <= 30, score)).alias("top30_avg_score"), F.min(score).alias("pool_min_score"), F.count_if(score >= 90).alias("count_ge_90"), F.count_if(score >= 80).alias("count_ge_80"))
    # Bounds of the states.
    state = F.when(F.col("selected_count") == 0, "weak").when((F.col("top10_avg_score") >= 90) & (F.col("count_ge_90") >= 10), "strong").when((F.col("top10_avg_score") >= 82) & (F.col("count_ge_80") >= 30), "mixed").otherwise("chaotic")
    return agg.select(state.alias("state"), "selected_count", *[F.round(c, 2).alias(c) for c in ("top1_score", "top10_avg_score", "top30_avg_score", "pool_min_score")], "count_ge_90", "count_ge_80")


def top_leaders(leaders: DataFrame, n: int = LEADERS) -> DataFrame:
    """The n leaders of each sector, dual ones first, a symbol once, as an array of structs."""
    order = (F.desc("is_dual_leader"), F.col("combined_score").desc_nulls_last(), F.col("leader_score").desc_nulls_last(), F.asc("symbol"))
    once = _first(leaders, [*KEY, "symbol"], *order)
    df = once.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where(F.col("_r") <= n)
    return df.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("_r", "symbol", "leader_score", "combined_score", "leader_tags"))).alias("leaders"))


def sector_watchlist(sectors: DataFrame, leaders: DataFrame) -> DataFrame:
    """Selected sectors with their leaders."""
    return sectors.where("selected_as_long_mainline").join(top_leaders(leaders), KEY, "left").withColumn("leader_symbols", F.coalesce(F.array_join("leaders.symbol", "/"), F.lit("")))


def concern_relations(scores: DataFrame, least: float = CONCERN) -> DataFrame:
    """Pairs of symbol and sector whose combined leader score is high enough, once."""
    df = scores.where(F.col("combined_score") >= least)
    return _first(df, ["symbol", *KEY], F.desc("combined_score")).select("symbol", *KEY, F.col("combined_score").alias("leader_score"), "long_score", "swing_score", F.col("combined_rank").alias("leader_rank"), "leader_tags")


def stock_base(*sources: DataFrame) -> DataFrame:
    """Symbols of all sources, once."""
    out = sources[0].select("symbol")
    for df in sources[1:]:
        out = out.union(df.select("symbol"))
    return out.where("symbol is not null").distinct()


def concern_table(base: DataFrame, relations: DataFrame) -> DataFrame:
    """The sectors of each stock by falling leader score, as text, count and JSON; weak without any."""
    item = F.struct((-F.col("leader_score")).alias("r"), F.col("sector_label"), "sector_type", F.round("leader_score", 2).alias("leader_score"), F.round("long_score", 2).alias("long_score"), F.round("swing_score", 2).alias("swing_score"), "leader_tags")
    agg = relations.groupBy("symbol").agg(F.sort_array(F.collect_list(item)).alias("l"))  # the sectors of one stock
    detail = F.transform("l", lambda x: F.struct(x.sector_type.alias("sector_type"), x.sector_label.alias("sector_label"), x.leader_score.alias("leader_score"), x.long_score.alias("long_score"), x.swing_score.alias("swing_score"), x.leader_tags.alias("leader_tags")))
    df = base.join(agg, "symbol", "left")
    return df.select("symbol", F.col("l").isNull().alias("weak_stock"), F.coalesce(F.array_join("l.sector_label", "/"), F.lit("")).alias("concern_sectors"), F.array_max("l.leader_score").alias("top_leader_score"), F.coalesce(F.size("l"), F.lit(0)).alias("concern_sector_count"), F.coalesce(F.to_json(detail), F.lit("[]")).alias("concern_details"))


def member_rows(sectors: DataFrame, members: DataFrame, stocks: DataFrame) -> DataFrame:
    """Sectors, their members and the scores of those (R13). members: (symbol, sector, leader_score)."""
    keep = sectors.select(*KEY, "long_mainline_score_100", "short_mainline_score_100", "phase9_score_100")
    return members.select("symbol", *KEY, "leader_score").join(keep, KEY).join(stocks, "symbol")


def route_sectors(sectors: DataFrame, score: str, n: int = SECTORS) -> DataFrame:
    """The n best sectors of the long pool by a score. A row a sector."""
    order = (F.col(score).desc_nulls_last(), F.col("long_mainline_score_100").desc_nulls_last(), *KEY)
    return sectors.where("selected_as_long_mainline").orderBy(*order).limit(n)


def a_route(route: str, sectors: DataFrame, members: DataFrame, stocks: DataFrame) -> DataFrame:
    """A1: public members of the sectors by short score; A2: also with both risk scores above 40, by buy score.

    Each symbol has its best row; ranks follow sector score, leader score, centred risk.
    """
    rows = member_rows(sectors, members, stocks).where("public")
    score = "short_mainline_score_100"
    if route == "A2":
        rows, score = rows.where((F.col("phase1_score_100") > ROUTE) & (F.col("phase2_score_100") > ROUTE)), "phase9_score_100"
    order = [F.col(c).desc_nulls_last() for c in (score, "leader_score", "centered_risk_score")]
    best = _first(rows, ["symbol"], *order, *KEY)
    return best.withColumns({"route": F.lit(route), "route_rank": F.row_number().over(Window.partitionBy(F.lit(route)).orderBy(*order, "symbol"))})  # a list of a day


def b_route(sectors: DataFrame, members: DataFrame, stocks: DataFrame) -> DataFrame:
    """Public symbols that a pattern fits, with the sector they lead most."""
    rows = stocks.where("public and pattern_match")
    met = member_rows(sectors, members, rows.select("symbol"))
    best = _first(met, ["symbol"], *[F.col(c).desc_nulls_last() for c in ("leader_score", "phase9_score_100", "short_mainline_score_100")], *KEY)
    df = rows.join(best, "symbol", "left")
    order = [F.col(c).desc_nulls_last() for c in ("centered_risk_score", "phase4_score_100", "leader_score")]
    return df.withColumns({"route": F.lit("B"), "route_rank": F.row_number().over(Window.partitionBy(F.lit("B")).orderBy(*order, "symbol"))})  # a list of a day


def leader_pool(short: DataFrame, buy: DataFrame, members: DataFrame, n: int = POOL) -> DataFrame:
    """The n first members of the sectors of either list; a symbol once at its best score, with all its sectors."""
    both = short.select(*KEY, F.lit(0).alias("o")).unionByName(buy.select(*KEY, F.lit(1).alias("o"))).groupBy(*KEY).agg(F.min("o").alias("o"))
    w = Window.partitionBy(*KEY).orderBy(F.col("leader_score").desc_nulls_last(), "symbol")
    rows = members.join(both, KEY).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return rows.groupBy("symbol").agg(F.max("leader_score").alias("leader_score"), F.array_join(F.sort_array(F.collect_set("sector_label")), "/").alias("source_sectors"), F.count(F.lit(1)).alias("n_sectors"))


def all_routes(sectors: DataFrame, members: DataFrame, stocks: DataFrame) -> DataFrame:
    """Candidates of the routes A1, A2 and B in one table."""
    short, buy = route_sectors(sectors, "short_mainline_score_100"), route_sectors(sectors, "phase9_score_100")
    columns = ["route", "route_rank", "symbol", *KEY, "leader_score", "phase1_score_100", "phase2_score_100", "phase4_score_100", "centered_risk_score", "pattern_ids", "position_percent"]
    out = a_route("A1", short, members, stocks).select(*columns)
    return out.unionByName(a_route("A2", buy, members, stocks).select(*columns)).unionByName(b_route(short.unionByName(buy).dropDuplicates(KEY), members, stocks).select(*columns))


def candidate_structs(routes: DataFrame) -> DataFrame:
    """One row a route with its candidates in order as an array of structs, and as JSON."""
    item = F.struct("route_rank", "symbol", "sector_label", "leader_score", "centered_risk_score", F.split("pattern_ids", "/").alias("patterns"))
    df = routes.groupBy("route").agg(F.count(F.lit(1)).alias("candidate_count"), F.sort_array(F.collect_list(item)).alias("candidates"))  # a watchlist
    return df.withColumn("payload", F.to_json("candidates"))


def listed_symbols(payloads: DataFrame) -> DataFrame:
    """Symbols of stored payloads in order, once."""
    kind = "array<struct<route_rank: int, symbol: string>>"
    rows = payloads.select("route", F.posexplode(F.from_json("payload", kind)).alias("pos", "c")).select("route", "pos", "c.symbol")
    return rows.groupBy("route", "symbol").agg(F.min("pos").alias("pos"))


def prior_list(lists: DataFrame, day, strict: bool = True) -> DataFrame:
    """Rows of the newest list before (or up to) a date."""
    at = F.lit(day).cast("date")
    before = lists.where(F.col("trade_date") < at if strict else F.col("trade_date") <= at)
    newest = before.agg(F.max("trade_date").alias("trade_date"))
    return before.join(F.broadcast(newest), "trade_date", "left_semi")  # one row


def fill_pool(size: int, *sources: tuple[str, DataFrame]) -> DataFrame:
    """Symbols of the sources in their order until the pool is full, with the tags of all sources that hold them.

    A source is (tag, rows with symbol and order).
    """
    both = None
    for k, (tag, df) in enumerate(sources):
        part = df.select("symbol", "order", F.lit(k).alias("source"), F.lit(tag).alias("tag"))
        both = part if both is None else both.unionByName(part)
    one = both.groupBy("symbol").agg(F.min(F.struct("source", "order")).alias("at"), F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("source", "tag"))), lambda x: x.tag), "/").alias("tags"))
    return one.orderBy("at.source", "at.order", "symbol").limit(size).select("symbol", F.col("at.source").alias("source"), F.col("at.order").alias("order"), "tags")  # a pool of a fixed size


