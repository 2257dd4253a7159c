"""Strict validation of mixed scores: models of one window joined, scores of a day, strategies and their trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scores import centred, mixed_scores, score_100

# Names of the strategies, picks, least scores.
STRATEGIES = ("random_top20", "phase4_top20", "phase4_top20_p12_ge30", "phase4_top20_p12_ge40", "mixed_010_top20", "mixed_top20", "centered_risk_top20", "all90", "mixed_top20_phase7_allow", "mixed_top20_phase5_safe")
TOP, PHASE1_LEAST, PHASE2_LEAST, ALL90, SAFE, CENTRED_2, CENTRED_4 = 20, 40.0, 40.0, 90.0, 40.0, 50.0, 70.0


def joined(phase1: DataFrame, phase2: DataFrame, phase4: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Rows that all three models of a window score (V24): (window_id, trade_date, symbol) with phase1_risk, phase2_risk, phase4_return.

    gate: (window_id, trade_date, phase7_trade_permission), a row a day; without one the permission is unknown.
    """
    keys = ["window_id", "trade_date", "symbol"]
    of = lambda df, name: df.select(*keys, F.col("risk_score").alias(name))
    df = of(phase4, "phase4_return").join(of(phase1, "phase1_risk"), keys).join(of(phase2, "phase2_risk"), keys)
    if gate is None:
        return df.withColumn("phase7_trade_permission", F.lit("unknown"))
    return df.join(gate.select("window_id", "trade_date", "phase7_trade_permission"), ["window_id", "trade_date"], "left")


def gate_permissions(train: DataFrame, valid: DataFrame, quantile: float = 0.8) -> DataFrame:
    """(window_id, trade_date, phase7_trade_permission): allow below the quantile of the window's training scores.

    Both hold (window_id, trade_date, risk_score), a row a market day.
    """
    threshold = train.groupBy("window_id").agg(F.percentile("risk_score", quantile).alias("threshold"))
    df = valid.join(F.broadcast(threshold), "window_id")  # a row a window
    return df.select("window_id", "trade_date", "risk_score", "threshold", F.when(F.col("risk_score") < F.col("threshold"), "allow").otherwise("no_trade").alias("phase7_trade_permission"))


def day_scores(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Scores of each day from 0 to 100, mixed, centred and all-90 flag (V25); days are dealt over `parts` partitions."""
    day = ["trade_date"]
    df = (rows if parts is None else rows.repartition(parts, *day)).withColumns({"phase1_score_100": score_100("phase1_risk", day, False), "phase2_score_100": score_100("phase2_risk", day, False), "phase4_score_100": score_100("phase4_return", day)})
    p1, p2, p4 = (F.col(f"phase{k}_score_100") for k in (1, 2, 4))
    all90 = F.coalesce((p1 >= ALL90) & (p2 >= ALL90) & (p4 >= ALL90), F.lit(False))
    return mixed_scores(df).withColumns({"mixed_010_score": F.round(p4 + 0.1 * p1 + 0.1 * p2, 4), "phase1_center_score": F.round(centred(p1), 4), "phase2_center_score": F.round(centred(p2), 4), "all90_flag": all90})


def _rules(strategies: tuple[str, ...]) -> list[tuple[str, F.Column, tuple[str, ...], bool]]:
    """(strategy, rows that may be picked, the columns of their order, largest first, whether the first TOP alone are picked)."""
    p1, p2, p4 = (F.col(f"phase{k}_score_100") for k in (1, 2, 4))
    floor, allow, safe = (p1 >= PHASE1_LEAST) & (p2 >= PHASE2_LEAST), F.lower("phase7_trade_permission") == "allow", F.col("phase5_score_100") >= SAFE
    best = ("phase4_score_100", "phase1_score_100", "phase2_score_100")
    out = []
    for name in strategies:
        extra = reduce(lambda a, b: a & b, [c for word, c in (("phase7_allow", allow), ("phase5_safe", safe)) if word in name], F.lit(True))
        if name == "random_top20":
            out.append((name, F.lit(True), ("_seed",), True))
        elif name == "phase4_top20":
            out.append((name, p4.isNotNull(), ("phase4_score_100",), True))
        elif name.startswith("phase4_top20_p12_ge"):
            at = float(name.rsplit("ge", 1)[-1])
            out.append((name, p4.isNotNull() & (p1 >= at) & (p2 >= at), ("phase4_score_100",), True))
        elif name.startswith("mixed_010_top20"):
            out.append((name, floor & F.col("mixed_010_score").isNotNull() & extra, ("mixed_010_score", *best), True))
        elif name.startswith("mixed_top20"):
            out.append((name, floor & F.col("mixed_score").isNotNull() & extra, ("mixed_score", *best), True))
        elif name == "centered_risk_top20":
            keep = (p1 >= PHASE1_LEAST) & (p2 >= max(PHASE2_LEAST, CENTRED_2)) & (p4 >= CENTRED_4) & F.col("centered_risk_score").isNotNull()
            out.append((name, keep, ("centered_risk_score", "phase4_score_100", "phase1_center_score", "phase2_center_score"), True))
        elif name.startswith("all90"):
            out.append((name, (p1 >= ALL90) & (p2 >= ALL90) & (p4 >= ALL90) & extra, ("mixed_score", *best), False))
        else:
            raise ValueError(f"no such strategy: {name}")
    return out


def strict_picks(scores: DataFrame, strategies: tuple[str, ...] = STRATEGIES, n: int = TOP) -> DataFrame:
    """(strategy, trade_date, symbol, selected_rank) of each strategy and day (B10); ties go by symbol.

    scores as day_scores gives them, with phase7_trade_permission and phase5_score_100 (null where unknown).
    """
    return _picked(scores, _rules(strategies), n)


def _picked(scores: DataFrame, rules: list, n: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Picks of the rules, with the columns `more`. A rank is the count of kept rows so far, so rules of one order share its sort."""
    df = scores
    if any(order == ("_seed",) for _, _, order, _ in rules):
        df = df.withColumn("_seed", F.md5(F.concat(F.date_format("trade_date", "yyyy-MM-dd"), F.lit(":"), F.col("symbol")).cast("binary")))
    ranks = {}
    for name, keep, order, cut in rules:
        kept = F.coalesce(keep, F.lit(False))
        w = Window.partitionBy("trade_date").orderBy(*[F.col(c).desc_nulls_last() for c in order], "symbol")
        rank = F.when(kept, F.sum(kept.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        ranks[name] = F.when(rank <= n, rank) if cut else rank
    df = df.withColumns({f"_{k}": c for k, c in ranks.items()}).where(F.coalesce(*[F.col(f"_{k}") for k in ranks]).isNotNull())
    long = df.select("trade_date", "symbol", *more, F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(f"_{k}").alias("selected_rank")) for k in ranks])).alias("x"))
    return long.where("x.selected_rank is not null").select("x.strategy", "trade_date", "symbol", "x.selected_rank", *more)


# Days of the rolling figures, what a deviation costs, least means, names of the strategies.
DAYS, COST, MEANS = 5, {"phase1": 0.05, "phase2": 0.05, "phase4": 0.10}, {"phase1": 40.0, "phase2": 50.0, "phase4": 70.0}
FIGURES = tuple(f"{k}_5d_{c}" for c in ("mean", "std") for k in COST)
ROLLING = ("random_top20", "centered_risk_top20", "rolling5_phase4_mean_top20", "rolling5_mean_top20", "rolling5_stable_top20")


def rolling_features(scores: DataFrame, days: int = DAYS, least: int | None = None, parts: int | None = None) -> DataFrame:
    """scores with mean, population deviation and distance from the mean of each phase over a symbol's last rows, and the
    rolling mean and stable scores (B15).

    Fewer than `least` known scores in the window (all of it by default) leave the figures null. Symbols are dealt over `parts` partitions.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(1 - days, 0)
    df = scores if parts is None else scores.repartition(parts, "symbol")
    for k in COST:
        c = f"{k}_score_100"
        ok = F.count(c).over(w) >= (days if least is None else least)
        df = df.withColumns({f"{k}_5d_mean": F.when(ok, F.avg(c).over(w)), f"{k}_5d_std": F.when(ok, F.stddev_pop(c).over(w))})
        df = df.withColumn(f"{k}_5d_delta", F.col(c) - F.col(f"{k}_5d_mean"))
    df = df.withColumns({f"{k}_5d_center_score": F.round(centred(F.col(f"{k}_5d_mean")), 4) for k in ("phase1", "phase2")})
    df = df.withColumn("rolling5_mean_score", F.round(F.col("phase4_5d_mean") + 0.08 * F.col("phase1_5d_center_score") + 0.12 * F.col("phase2_5d_center_score"), 4))
    cost = sum((v * F.col(f"{k}_5d_std") for k, v in COST.items()), F.lit(0.0))
    return df.withColumn("rolling5_stable_score", F.round(F.col("rolling5_mean_score") - cost, 4))


def rolling_picks(scores: DataFrame, n: int = TOP, more: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(strategy, trade_date, symbol, selected_rank) of the rolling strategies (B16), with the columns `more`. scores as rolling_features gives them.

    Days are dealt over `parts` partitions.
    """
    scores = scores if parts is None else scores.repartition(parts, "trade_date")
    floor = F.col("rolling5_mean_score").isNotNull()
    for k, at in MEANS.items():
        floor = floor & (F.col(f"{k}_5d_mean") >= at)
    own = {"rolling5_phase4_mean_top20": ("phase4_5d_mean", "phase4_score_100"), "rolling5_mean_top20": ("rolling5_mean_score", "phase4_5d_mean", "phase4_score_100"), "rolling5_stable_top20": ("rolling5_stable_score", "rolling5_mean_score", "phase4_5d_mean")}
    return _picked(scores, [*_rules(ROLLING[:2]), *[(name, floor, order, True) for name, order in own.items()]], n, more)


def rolling_summary(trades: DataFrame, counts: DataFrame, features: DataFrame) -> DataFrame:
    """strict_summary with medians and the means of the rolling figures of the trades."""
    rows = trades.join(features.select("symbol", "trade_date", *FIGURES), ["symbol", "trade_date"])
    more = rows.groupBy("strategy", "horizon").agg(*[F.percentile(c, 0.5).alias(f"median_{c}") for c in ("raw_return", "max_profit", "max_drawdown")], *[F.avg(c).alias(f"avg_{c}") for c in FIGURES])
    return strict_summary(trades, counts).drop("expectancy").join(more, ["strategy", "horizon"])


def candidate_counts(picks: DataFrame, days: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(strategy, trade_date, candidate_count) of every strategy and day, 0 included."""
    grid = days.select("trade_date").distinct().withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    n = picks.groupBy("strategy", "trade_date").agg(F.count(F.lit(1)).alias("candidate_count"))
    return grid.join(n, ["strategy", "trade_date"], "left").fillna(0, ["candidate_count"])


def strict_trades(picks: DataFrame, outcomes: DataFrame, horizons: tuple[int, ...], parts: int | None = None) -> DataFrame:
    """Picks with their outcome at each horizon, a row each; those without a return at a horizon have none.

    outcomes: (symbol, trade_date) with return_<h>d, max_profit_<h>d and max_drawdown_<h>d; they meet the picks over `parts` partitions.
    """
    outcomes = _outcomes_at(outcomes, horizons)
    return _exploded(picks.join(outcomes if parts is None else outcomes.repartition(parts, "symbol", "trade_date"), ["symbol", "trade_date"]), horizons)


def met_trades(picks: DataFrame, outcomes: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """strict_trades of outcomes dealt by symbol: the picks, a few rows a day, come to where they lie, so no outcome is shuffled."""
    picks = picks.withColumnRenamed("trade_date", "_day")
    met = picks.join(_outcomes_at(outcomes, horizons), "symbol").where(F.datediff("_day", "trade_date") == 0)  # dates are no key of the join
    return _exploded(met, horizons)


def _outcomes_at(outcomes: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    return outcomes.select("symbol", "trade_date", *[f"{c}_{h}d" for h in horizons for c in ("return", "max_profit", "max_drawdown")])


def _exploded(met: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    at = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{c}_{h}d").alias(o) for c, o in (("return", "raw_return"), ("max_profit", "max_profit"), ("max_drawdown", "max_drawdown"))]) for h in horizons])).alias("x")
    return met.select("strategy", "trade_date", "symbol", "selected_rank", at).where("x.raw_return is not null").select("strategy", "trade_date", "symbol", "selected_rank", "x.*")


def strict_summary(trades: DataFrame, counts: DataFrame) -> DataFrame:
    """Means, win rate, payoff, expectancy and the share of days without a candidate, by strategy and horizon."""
    r = F.col("raw_return")
    agg = trades.groupBy("strategy", "horizon").agg(F.count("symbol").alias("trade_count"), F.countDistinct("trade_date").alias("signal_days_with_trades"), F.avg(r).alias("avg_raw_return"), F.avg((r > 0).cast("double")).alias("raw_win_rate"), F.avg("max_profit").alias("avg_max_profit"), F.avg("max_drawdown").alias("avg_max_drawdown"), F.avg(F.when(r > 0, r)).alias("avg_gain"), F.avg(F.when(r < 0, r)).alias("avg_loss"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    agg = agg.withColumns({"payoff_ratio": F.try_divide("avg_gain", F.abs("avg_loss")), "expectancy": F.col("raw_win_rate") * zero("avg_gain") + (1 - F.col("raw_win_rate")) * zero("avg_loss")})
    none = counts.groupBy("strategy").agg(F.avg((F.col("candidate_count") == 0).cast("double")).alias("no_candidate_day_rate"), F.countDistinct("trade_date").alias("signal_days"))
    return agg.join(none, "strategy", "left")
