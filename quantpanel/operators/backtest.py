"""Forward outcomes, exit rules and portfolio summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_symbol


def forward_outcomes(bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Return, best and worst from the next open over each horizon; null if a bar is missing."""
    df = bars.withColumn("entry", F.lead("open").over(by_symbol()))
    cols = {}
    for h in horizons:
        w = by_symbol().rowsBetween(1, h)
        ok = F.count("close").over(w) == h
        gain = lambda c: F.when(ok, F.try_divide(c, F.col("entry")) - 1)  # noqa: E731, B023
        cols |= {f"return_{h}d": gain(F.lead("close", h).over(by_symbol())), f"max_profit_{h}d": gain(F.max("high").over(w)), f"max_drawdown_{h}d": gain(F.min("low").over(w))}
    return df.withColumns(cols)


def forward_paths(bars: DataFrame, signals: DataFrame, horizon: int) -> DataFrame:
    """The bars 1..horizon after each signal (symbol, signal_date) with the entry at the first open."""
    idx = bars.withColumn("idx", F.row_number().over(by_symbol()))
    at = signals.join(idx.select("symbol", F.col("trade_date").alias("signal_date"), F.col("idx").alias("i0")), ["symbol", "signal_date"])
    at = at.select("symbol", "signal_date", "i0", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day_offset")).withColumn("idx", F.col("i0") + F.col("day_offset"))  # an equality, not a range
    df = at.join(idx, ["symbol", "idx"]).drop("i0", "idx")
    w = Window.partitionBy("symbol", "signal_date")
    return df.withColumns({"entry_open": F.min_by("open", "day_offset").over(w), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") == horizon).drop("_n")


# The grids of the exit rules.
STOPS, TAKES, TRAILS, TRIGGERS, TIME_DAYS, TIME_RETURNS = (0.06, 0.08, 0.10), (0.08, 0.10, 0.12, 0.15, 0.20), (0.06, 0.08, 0.10), (0.08, 0.10), (5, 10), (0.02, 0.03)
_RULE = "rule_id string, family string, stop double, take double, breakeven double, trail_start double, trail double, time_days int, time_return double, no_stop boolean"


def exit_rules(stops=STOPS, takes=TAKES, trails=TRAILS, triggers=TRIGGERS, days=TIME_DAYS, returns=TIME_RETURNS) -> list[tuple]:
    """The grid of exit rules, in the columns of _RULE: fixed horizon, fixed, breakeven, trailing and time stops."""
    pct = lambda x: f"{round(x * 1000):03d}"
    out = [("fixed_horizon", "fixed_horizon", stops[0], None, None, None, None, None, None, True)]
    out += [(f"fixed_sl{pct(s)}_tp{pct(t)}", "fixed", s, t, None, None, None, None, None, False) for s in stops for t in takes]
    out += [(f"breakeven_sl{pct(s)}_be{pct(g)}_tp{pct(t)}", "breakeven", s, t, g, None, None, None, None, False) for s in stops for g in triggers for t in takes]
    out += [(f"trailing_sl{pct(s)}_start{pct(g)}_trail{pct(x)}", "trailing", s, None, None, g, x, None, None, False) for s in stops for g in triggers for x in trails]
    return out + [(f"time_sl{pct(s)}_tp{pct(t)}_d{d}_min{pct(m)}", "time_stop", s, t, None, None, None, d, m, False) for s in stops for t in takes for d in days for m in returns]


def apply_exit_rules(paths: DataFrame, rules: list[tuple], horizon: int, keys: tuple[str, ...] = ("symbol", "signal_date")) -> DataFrame:
    """One trade for each path and rule: the first day on which the rule leaves, else the close of the horizon.

    A day is judged in this order: an open at the stop, an open at the take, low and high both met (the stop wins), the
    low, the high, the time stop by its close. The stop is raised by what the days before it have reached: to the entry
    once a high has met the breakeven trigger, and below the highest high once one has met the trail's start.

    The rules share few levels. One aggregate of a path's days finds the first day that meets each; a rule leaves on the
    least of its levels' days, and only that day is looked at. The rules are a table of some hundred rows.
    """
    rules = [r for r in rules if r[7] is None or r[7] <= horizon]
    of = lambda *k: sorted({tuple(r[i] for i in k) for r in rules if all(r[i] is not None for i in k)})
    stops, takes, rises, trails = of(2), of(3), of(4), of(5, 6)
    place = lambda known, *x: known.index(x) + 1 if all(v is not None for v in x) else None
    rows = [(*r, None if r[9] else place(stops, r[2]), place(takes, r[3]), place(rises, r[4]), place(trails, r[5], r[6])) for r in rules]
    table = paths.sparkSession.createDataFrame(rows, f"{_RULE}, stop_at int, take_at int, rise_at int, trail_at int")
    w = Window.partitionBy(*keys).orderBy("day_offset")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    df = paths.where(F.col("day_offset") <= horizon).withColumns({"entry": F.first("open").over(upto), "hi": F.max("high").over(upto), "lo": F.min("low").over(upto), "top": F.max("high").over(before)})
    df = df.withColumns({"top": F.greatest("entry", "top"), "_l": F.least("low", "open"), "_h": F.greatest("high", "open")})
    entry, up = F.col("entry"), F.col("top") / F.col("entry") - 1
    met = lambda conditions: F.array(*[F.min(F.when(c, F.col("day_offset"))) for c in conditions] or [F.lit(None).cast("int")])
    one = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("day_offset", "trade_date", "open", "high", "low", "close", "hi", "lo", "top"))).alias("path"), F.max("entry").alias("entry"), met([F.col("_l") <= entry * (1 - s) for (s,) in stops]).alias("stop_days"), met([F.col("_h") >= entry * (1 + t) for (t,) in takes]).alias("take_days"),
        met([(up >= g) & (F.col("_l") <= entry) for (g,) in rises]).alias("rise_days"), met([(up >= g) & (F.col("_l") <= F.col("top") * (1 - x)) for g, x in trails]).alias("trail_days"),
    )
    df = one.where(f"size(path) = {horizon} and entry > 0").crossJoin(F.broadcast(table))  # the grid
    late = F.when(F.expr("get(path, time_days - 1).close / entry - 1 < time_return"), F.col("time_days"))
    day = F.least(*[F.try_element_at(f"{k}_days", F.col(f"{k}_at")) for k in ("stop", "take", "rise", "trail")], late)
    df = df.withColumn("day", day).withColumn("x", F.expr(f"get(path, coalesce(day, {horizon}) - 1)")).withColumn("up", F.expr("x.top / entry - 1"))
    df = df.withColumns({"level": F.expr("if(no_stop, cast(null as double), entry * (1 - stop))"), "kind": F.lit("stop_loss"), "goal": F.expr("entry * (1 + take)")})
    raised = F.expr("coalesce(up >= breakeven and entry > level, false)")
    df = df.withColumns({"kind": F.when(raised, "breakeven_stop").otherwise(F.col("kind")), "level": F.when(raised, F.col("entry")).otherwise(F.col("level"))})
    trailed = F.expr("coalesce(up >= trail_start and x.top * (1 - trail) > level, false)")
    df = df.withColumns({"kind": F.when(trailed, "trailing_stop").otherwise(F.col("kind")), "level": F.when(trailed, F.expr("x.top * (1 - trail)")).otherwise(F.col("level"))})
    reason = "case when day is null then 'timeout' when x.open <= level then concat(kind, '_open_gap') when x.open >= goal then 'take_profit_open_gap' when x.low <= level and x.high >= goal then concat(kind, '_first') when x.low <= level then kind when x.high >= goal then 'take_profit' else 'time_stop' end"
    price = "case when day is null then x.close when x.open <= level or x.open >= goal then x.open when x.low <= level then level when x.high >= goal then goal else x.close end"
    df = df.withColumns({"exit_reason": F.expr(reason), "exit_price": F.expr(price)}).where("exit_price is not null")
    return df.select(
        *keys, "rule_id", "family", F.lit(horizon).alias("horizon"), F.col("entry").alias("entry_open"), F.col("x.trade_date").alias("exit_date"), "exit_price", "exit_reason", F.col("x.day_offset").alias("holding_days"),
        (F.col("exit_price") / entry - 1).alias("trade_return"), ((F.col("exit_price") / entry - 1) / F.col("stop")).alias("trade_r"), (F.col("x.hi") / entry - 1).alias("max_profit"), (F.col("x.lo") / entry - 1).alias("max_drawdown"),
    )


def exit_summary(trades: DataFrame, by: list[str]) -> DataFrame:
    """Means, win and exit rates, payoff and the balanced score of the trades of each rule."""
    r, days = F.col("trade_return"), F.greatest("holding_days", F.lit(1))
    share = lambda p: F.avg(F.col("exit_reason").startswith(p).cast("double"))
    agg = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg(r).alias("avg_return"), F.avg(r / days).alias("avg_daily_return"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg("trade_r").alias("avg_r"), F.avg(F.when(r > 0, r)).alias("avg_gain"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
        F.avg("max_profit").alias("avg_max_profit"), F.avg("max_drawdown").alias("avg_max_drawdown"), F.avg(days).alias("avg_holding_days"), share("stop_loss").alias("stop_loss_rate"), share("take_profit").alias("take_profit_rate"), share("trailing_stop").alias("trailing_stop_rate"),
        share("breakeven_stop").alias("breakeven_stop_rate"), share("time_stop").alias("time_stop_rate"), F.max("horizon").alias("_h"),
    )
    agg = agg.withColumn("payoff_ratio", F.try_divide("avg_gain", F.abs("avg_loss")))
    # Weights of the balanced score.
    score = F.col("avg_r") + 0.3 * F.col("win_rate") + 0.2 * F.least(F.coalesce("payoff_ratio", F.lit(0.0)), F.lit(5.0)) - 0.5 * F.abs("avg_max_drawdown") - 0.3 * F.col("stop_loss_rate") - 0.05 * F.col("avg_holding_days") / F.greatest("_h", F.lit(1))
    return agg.withColumn("balanced_score", score).drop("_h")


def split_label(day: F.Column, tune_end: str = "2023-12-29", test_start: str = "2024-01-01") -> F.Column:
    """tune up to one date, test from another, gap between (F8)."""
    return F.when(day <= F.lit(tune_end).cast("date"), "tune").when(day >= F.lit(test_start).cast("date"), "test").otherwise("gap")


def select_rules(by_split: DataFrame, keys: list[str], rule: str = "rule_id", score: str = "balanced_score") -> DataFrame:
    """The rule of the best tuning score of each key beside its test figures (B20); ties go to the first rule by name."""
    numbers = [c for c in by_split.columns if c not in (*keys, rule, "split")]
    w = Window.partitionBy(*keys).orderBy(F.desc(score), rule)
    tune = by_split.where("split = 'tune'").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, rule, *[F.col(c).alias(f"tune_{c}") for c in numbers])
    test = by_split.where("split = 'test'").select(*keys, rule, *[F.col(c).alias(f"test_{c}") for c in numbers])
    return tune.join(test, [*keys, rule], "left")


def signal_dates(bars: DataFrame, horizon: int, n: int | None = None) -> DataFrame:
    """Market days with at least `horizon` days after them, the newest n (B1). Days are few."""
    days = bars.select("trade_date").distinct().withColumn("_k", F.row_number().over(Window.orderBy(F.desc("trade_date"))))
    days = days.where(F.col("_k") > horizon)
    return (days if n is None else days.where(F.col("_k") <= horizon + n)).select("trade_date")


def trade_summary(trades: DataFrame, by: list[str]) -> DataFrame:
    """Win rate, payoff, expectancy, medians and tails."""
    r = F.col("trade_return")
    agg = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), F.avg(r).alias("mean_return"), F.percentile(r, 0.5).alias("median_return"), F.percentile(r, 0.05).alias("q05"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(F.when(r > 0, r)).alias("_w"), F.avg(F.when(r <= 0, -r)).alias("_l"), F.avg("holding_days").alias("mean_days"))
    return agg.withColumn("payoff", F.try_divide("_w", "_l")).drop("_w", "_l")


def portfolio(daily: DataFrame, column: str = "net") -> DataFrame:
    """Compound and annual return, information ratio, largest drawdown and hit rate of one row a day."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("v", F.exp(F.sum(F.log1p(column)).over(w))).withColumn("dd", F.col("v") / F.greatest(F.max("v").over(w), F.lit(1.0)) - 1)
    agg = df.agg(F.count(F.lit(1)).alias("n_days"), F.max_by("v", "trade_date").alias("v"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.min("dd").alias("max_drawdown"), F.avg((F.col(column) > 0).cast("double")).alias("hit_rate"))
    return agg.select("n_days", (F.col("v") - 1).alias("total_return"), (F.pow("v", 252 / F.col("n_days")) - 1).alias("annual_return"), (F.try_divide("m", "s") * F.sqrt(F.lit(252.0))).alias("information_ratio"), "max_drawdown", "hit_rate")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, strict: bool = False) -> DataFrame:
    """The newest right row not after (strict: before) each left row: one sort of both sides, no range join."""
    value = [c for c in right.columns if c not in (*keys, since)]
    a = left.select("*", F.col(at).alias("_t"), F.lit(1 if not strict else 0).alias("_o"), F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("_v"))
    nulls = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys]
    b = right.select(*keys, *nulls, F.col(since).alias("_t"), F.lit(0 if not strict else 1).alias("_o"), F.struct(*value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.withColumn("_left", F.lit(True)).unionByName(b.withColumn("_left", F.lit(False)))
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left")
    return both.select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in value])


def barrier_trades(paths: DataFrame, horizon: int, stop: float = 0.08, take: float = 0.15, keys: tuple[str, ...] = ("symbol", "signal_date")) -> DataFrame:
    """Trades that leave at the first low at the stop or high at the take, the stop on both, else at the last close.

    Unlike the exit rules, an open beyond a level still leaves at the level.
    """
    day = F.struct("day_offset", "trade_date", "low", "high", "close")
    one = paths.where(F.col("day_offset") <= horizon).groupBy(*keys).agg(F.sort_array(F.collect_list(day)).alias("p"), F.min_by("open", "day_offset").alias("entry_price"))
    df = one.where(f"size(p) = {horizon} and entry_price > 0").withColumns({"s": F.col("entry_price") * (1 - stop), "t": F.col("entry_price") * (1 + take)})
    df = df.withColumn("hit", F.expr("try_element_at(filter(p, x -> x.low <= s or x.high >= t), 1)")).withColumn("last", F.expr("element_at(p, -1)"))
    reason = F.when(F.col("hit").isNull(), "timeout").when((F.col("hit.low") <= F.col("s")) & (F.col("hit.high") >= F.col("t")), "stop_loss_first").when(F.col("hit.low") <= F.col("s"), "stop_loss").otherwise("take_profit")
    price = F.when(reason == "timeout", F.col("last.close")).when(reason == "take_profit", F.col("t")).otherwise(F.col("s"))
    gain = lambda c: F.try_divide(c, F.col("entry_price")) - 1
    return df.select(*keys, F.lit(horizon).alias("horizon"), "entry_price", F.coalesce("hit.trade_date", "last.trade_date").alias("exit_date"), reason.alias("exit_reason"), price.alias("exit_price"), F.coalesce("hit.day_offset", F.lit(horizon)).alias("holding_days"), gain(F.col("last.close")).alias("raw_return"), gain(price).alias("barrier_return"), gain(F.array_min("p.low")).alias("max_drawdown"), gain(F.array_max("p.high")).alias("max_profit"))


def daily_portfolio(trades: DataFrame, by: list[str]) -> DataFrame:
    """Means of the trades of each signal date."""
    hit = lambda p: F.avg(F.col("exit_reason").startswith(p).cast("double"))
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("trade_count"), *[F.avg(c).alias(c) for c in ("raw_return", "barrier_return", "max_drawdown")], hit("stop_loss").alias("stop_loss_rate"), hit("take_profit").alias("take_profit_rate"))


# Order of the patterns by their number, least risk scores of the mixed picks.
FLOOR = 40.0
PRIORITY = {1: 5.0, 2: 2.0, 3: 3.0, 4: 1.0, 5: 6.0, 6: 4.0}


def base_frame(universe: DataFrame, scores: DataFrame, patterns: DataFrame) -> DataFrame:
    """Universe of a day with scores, patterns, their priority and the seeded order.

    scores: one row a symbol and date with phase1_excluded, phase2_excluded, the 0-100 scores and phase4_return.
    """
    weight = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    hits = patterns.groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set(F.col("pattern_id").cast("string"))), ",").alias("pattern_ids"), F.max(weight[F.col("pattern_id")]).alias("pattern_priority"))
    df = universe.join(scores, "symbol", "left").join(hits, "symbol", "left")
    seed = F.md5(F.concat(F.date_format("trade_date", "yyyy-MM-dd"), F.lit(":"), F.col("symbol")).cast("binary"))
    mixed = F.round(F.col("phase4_score_100") + 0.2 * F.col("phase1_score_100") + 0.2 * F.col("phase2_score_100"), 4)
    return df.withColumns({"pattern_match": F.col("pattern_ids").isNotNull(), "mixed_score": mixed, "seed": seed, "phase1_pass": ~F.coalesce("phase1_excluded", F.lit(True)), "phase2_pass": ~F.coalesce("phase2_excluded", F.lit(True))})


def component_strategies(base: DataFrame, n: int = 20, phase4_n: int = 20, permission: str = "allow") -> DataFrame:
    """The picks of each component strategy: a filter, an order and the first n (B4). All are ranked in one pass each.

    phase1_phase2_phase4_all90 keeps all that pass. The gate closes its strategies on a day without permission.
    """
    one, two, hit, open_ = F.col("phase1_pass"), F.col("phase2_pass"), F.col("pattern_match"), F.lit(permission == "allow")
    seed, p4, mixed, pattern = [F.asc("seed")], [F.col("phase4_return").desc_nulls_last()], [F.col(c).desc_nulls_last() for c in ("mixed_score", "phase4_score_100", "phase1_score_100", "phase2_score_100")], [F.col("pattern_priority").desc_nulls_last()]
    floor = (F.col("phase1_score_100") >= FLOOR) & (F.col("phase2_score_100") >= FLOOR)
    high = (F.col("phase1_score_100") >= 90) & (F.col("phase2_score_100") >= 90) & (F.col("phase4_score_100") >= 90)
    inside = one & two
    mixes = F.coalesce(inside & floor & F.col("mixed_score").isNotNull(), F.lit(False))
    base = base.withColumn("_m", F.when(mixes, F.row_number().over(Window.partitionBy("trade_date", mixes).orderBy(*mixed, "symbol"))))
    now = inside & (hit | (F.col("_m") <= phase4_n))
    listed = [F.when(hit, 0).otherwise(1).asc(), *mixed[:2]]
    rules = [
        ("full_market_random", F.lit(True), seed), ("phase1_filter_only", one, seed), ("phase2_filter_only", two, seed), ("phase4_top", F.lit(True), p4), ("phase1_phase2_phase4_mixed_top20", floor & F.col("mixed_score").isNotNull(), mixed), ("phase1_phase2_phase4_all90", high, mixed),
        ("phase5_group_only", F.col("phase5_score_100").isNotNull(), [F.desc("phase5_score_100")]), ("phase7_gate_only", open_, seed), ("phase1_filter_phase4_top", one, p4), ("phase2_filter_phase4_top", two, p4), ("phase1_phase2_filter_phase4_top", inside, p4), ("patterns_only", hit, pattern),
        ("patterns_phase1_phase2_filter", hit & inside, pattern), ("patterns_phase4_sort", hit, [*p4, *pattern]), ("current_watchlist_without_phase7", now, listed), ("current_watchlist_with_phase7", now & open_, listed),
    ]
    ranks = {}
    for name, keep, order in rules:
        kept = F.coalesce(keep, F.lit(False))
        rank = F.when(kept, F.row_number().over(Window.partitionBy("trade_date", kept).orderBy(*order, "symbol")))
        ranks[name] = rank if name.endswith("all90") else F.when(rank <= n, rank)
    df = base.withColumns({f"_{k}": c for k, c in ranks.items()})
    long = df.select(F.col("trade_date").alias("signal_date"), "symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(f"_{k}").alias("selected_rank")) for k in ranks])).alias("x"))
    return long.where("x.selected_rank is not null").select("x.strategy", "signal_date", "symbol", "x.selected_rank")


def compare_strategies(daily: DataFrame, base: str = "full_market_random", column: str = "barrier_return") -> DataFrame:
    """Means, win rate and tail of each strategy beside those of the random one."""
    agg = daily.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_days"), F.avg(column).alias("mean_return"), F.avg((F.col(column) > 0).cast("double")).alias("win_rate"), F.percentile(column, 0.05).alias("q05"))
    other = agg.where(F.col("strategy") == base).select(F.col("mean_return").alias("base_return"))
    return agg.join(F.broadcast(other), how="left").withColumn("excess", F.col("mean_return") - F.col("base_return"))  # one row


# Risk of the account, largest position, weights of the entries, multiples of the range and of R.
RISK, POSITION, ENTRIES, RANGE, TAKES_R = 0.02, 0.40, (0.30, 0.30, 0.20, 0.20), 2.0, (1.5, 2.5)


def staged_levels(paths: DataFrame, ranges: DataFrame, horizon: int) -> DataFrame:
    """Entries, takes and stop of a staged position and the first day that meets each.

    paths as forward_paths gives them; ranges: (symbol, signal_date, atr_pct). R is twice the range, at most the share of
    the position that the account's risk allows.
    """
    cap = RISK / (POSITION * (ENTRIES[0] + ENTRIES[1] / 2))
    df = paths.where(F.col("day_offset") <= horizon).join(ranges.where("atr_pct > 0"), ["symbol", "signal_date"]).withColumn("r_pct", F.least(RANGE * F.col("atr_pct"), F.lit(cap)))
    e = F.col("entry_open")
    levels = {"stop": e * (1 - F.col("r_pct")), "add2": e * (1 - F.col("r_pct") / 2), "add3": e * (1 + F.col("r_pct")), "add4": e * (1 + 2 * F.col("r_pct")), "take1": e * (1 + TAKES_R[0] * F.col("r_pct")), "take2": e * (1 + TAKES_R[1] * F.col("r_pct"))}
    df = df.withColumns(levels)
    met = lambda c: F.min(F.when((F.col("low") <= F.col(c)) if c in ("stop", "add2") else (F.col("high") >= F.col(c)), F.col("day_offset"))).alias(f"{c}_day")
    return df.groupBy("symbol", "signal_date").agg(F.max("entry_open").alias("entry_open"), F.max("r_pct").alias("r_pct"), *[F.max(c).alias(c) for c in levels], *[met(c) for c in levels])


def stability(df: DataFrame, value: str) -> DataFrame:
    """Rolling mean less half the rolling deviation, and its decile of the day (B15, B16). df as rolling_score gives it."""
    from .scores import decile

    df = df.withColumn("stability_score", F.col(f"{value}_mean") - 0.5 * F.col(f"{value}_std")).where("stability_score is not null")
    return df.withColumn("stability_decile", decile("stability_score", ["trade_date"], "c"))
