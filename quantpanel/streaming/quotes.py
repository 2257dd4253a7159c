"""Quotes as a stream: latest by symbol and day, bars by event time, overlay on history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantpanel.operators.scores import centred, mixed_scores


def quotes_of(events: DataFrame) -> DataFrame:
    """(symbol, quote_datetime, close, event_id) of events, batch or stream."""
    return events.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), F.col("ts").cast("timestamp").alias("quote_datetime"), F.col("value").alias("close"), "event_id")


def latest_quotes(quotes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The last quote of each symbol and day; quotes behind the watermark are dropped (T1). Update mode on streams."""
    if quotes.isStreaming:
        quotes = quotes.withWatermark("quote_datetime", late)
    agg = quotes.groupBy("symbol", F.window("quote_datetime", "1 day").alias("w")).agg(F.max(F.struct("quote_datetime", "event_id", "close")).alias("q"))
    return agg.select("symbol", F.to_date("w.start").alias("trade_date"), "q.quote_datetime", "q.close")


def quote_bars(quotes: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count by event-time window."""
    if quotes.isStreaming:
        quotes = quotes.withWatermark("quote_datetime", late)
    at = F.struct("quote_datetime", "event_id", "close")
    agg = quotes.groupBy("symbol", F.window("quote_datetime", every).alias("w")).agg(F.min(at).alias("a"), F.max("close").alias("high"), F.min("close").alias("low"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n"))
    return agg.select("symbol", F.col("w.start").alias("start"), F.col("a.close").alias("open"), "high", "low", F.col("b.close").alias("close"), "n")


def provisional_bars(latest: DataFrame) -> DataFrame:
    """Today's latest quote as a daily bar."""
    return latest.select("symbol", "trade_date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"), F.lit(0.0).alias("amount"), F.lit(None).cast("double").alias("pct_change"))


def overlay(history: DataFrame, provisional: DataFrame) -> DataFrame:
    """History before each symbol's provisional day, and that day's bar (T4); for use in foreachBatch."""
    day = provisional.groupBy("symbol").agg(F.min("trade_date").alias("_day"))
    old = history.join(day, "symbol", "left").where("_day is null or trade_date < _day").drop("_day")
    return old.unionByName(provisional, allowMissingColumns=True)


def run_latest(events: DataFrame, sink, checkpoint: str):
    """Start the stream of latest quotes; sink(batch, id) gets what changed."""
    return latest_quotes(quotes_of(events)).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def snapshot(latest: DataFrame) -> DataFrame:
    """Latest quotes with the percent change of the feed, else from the close before."""
    have = lambda c: F.col(c) if c in latest.columns else F.lit(None).cast("double")
    return latest.withColumn("intraday_pct_change", F.coalesce(have("pct_change"), (F.try_divide(F.col("close"), have("pre_close")) - 1) * 100))


def sector_strength(snapshots: DataFrame, pool: DataFrame, sectors: DataFrame) -> DataFrame:
    """Mean change of each sector's leaders, how many have a quote, and ranks of ties at the smallest.

    snapshots: (symbol, intraday_pct_change), a batch of the stream or its latest table; pool: (sector_type, sector_label,
    symbol), static. A row a sector.
    """
    key = ["sector_type", "sector_label"]
    agg = pool.join(snapshots, "symbol", "left").groupBy(*key).agg(F.round(F.avg("intraday_pct_change"), 4).alias("leader_pct_change"), F.count("intraday_pct_change").alias("valid_leaders"), F.array_join(F.sort_array(F.collect_set("symbol")), "/").alias("leader_symbols"))
    df = agg.join(sectors, key, "left").withColumn("_all", F.lit(1))
    rank = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy("_all").orderBy(F.col(c).desc_nulls_last())))
    return df.withColumns({"strength_rank": rank("leader_pct_change"), "phase9_rank": rank("phase9_score_100")}).drop("_all")


def route_sectors(strength: DataFrame, n: int = 10) -> DataFrame:
    """The first n sectors by the leaders' change, and by the buy score, each then by the other, nulls last.

    (route, sector_label, place): exactly n a route where there are as many; rows that tie in both go by name.
    """
    change, buy = F.col("leader_pct_change").desc_nulls_last(), F.col("phase9_score_100").desc_nulls_last()
    both = strength.select("sector_label", "leader_pct_change", "phase9_score_100", F.explode(F.array(F.lit("recent"), F.lit("rotation"))).alias("route"))
    of = lambda *order: F.row_number().over(Window.partitionBy("route").orderBy(*order, "sector_label"))
    df = both.withColumn("place", F.when(F.col("route") == "recent", of(change, buy)).otherwise(of(buy, change)))  # sectors of a day
    return df.where(F.col("place") <= n).select("route", "sector_label", "place")


def intraday_routes(candidates: DataFrame, strength: DataFrame, n: int = 10) -> DataFrame:
    """Candidates of the first n sectors of either order, by the filters of the routes.

    candidates: (symbol, sector_label, phase1_score_100, phase2_score_100, phase4_score_100, phase9_score_100,
    intraday_pct_change), a row for each sector of a symbol. A null score or change passes no filter. route_rank orders a
    route by its leading score, then the centred score and its parts; display_rank counts both routes, "recent" first.
    """
    # Least risk scores of both routes and of the second, largest change of the day.
    least, more, most = 20.0, 40.0, 9.9
    fit = (F.col("phase1_score_100") > least) & (F.col("phase2_score_100") > least) & (F.col("intraday_pct_change") <= most)
    calm = (F.col("phase1_score_100") > more) & (F.col("phase2_score_100") > more)
    df = mixed_scores(candidates).where(fit).join(F.broadcast(route_sectors(strength, n)), "sector_label").where((F.col("route") == "recent") | calm)
    df = df.withColumn("pool_score", F.col("centered_risk_score"))
    lead = F.when(F.col("route") == "recent", F.col("phase9_score_100")).otherwise(F.col("pool_score"))
    order = [c.desc_nulls_last() for c in (lead, F.col("pool_score"), F.col("phase4_score_100"), centred(F.col("phase1_score_100")), centred(F.col("phase2_score_100")))] + [F.col("symbol").asc()]
    best = df.withColumn("_n", F.row_number().over(Window.partitionBy("route", "symbol").orderBy("place"))).where("_n = 1").drop("_n", "place")
    best = best.withColumn("route_rank", F.row_number().over(Window.partitionBy("route").orderBy(*order)))  # a pool of a day
    return best.withColumn("display_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("route", "route_rank")))


def pool_source(today: DataFrame, earlier: DataFrame) -> DataFrame:
    """Today's full-market pool, else the newest earlier one."""
    if not today.isEmpty():
        return today
    newest = earlier.agg(F.max("trade_date").alias("trade_date"))
    return earlier.join(F.broadcast(newest), "trade_date", "left_semi")  # one row
