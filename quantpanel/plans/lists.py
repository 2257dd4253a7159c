"""Registered queries of sources, sector pullbacks, scores of stocks and the lists made of them; registered on import."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantpanel.functions import scalars as fn
from quantpanel.operators import backtest as bt
from quantpanel.operators import gates as gt
from quantpanel.operators import indicators as ind
from quantpanel.operators import labels as lab
from quantpanel.operators import leaders as ld
from quantpanel.operators import market as mk
from quantpanel.operators import membership as mb
from quantpanel.operators import phase9 as p9
from quantpanel.operators import pullback as pb
from quantpanel.operators import quality as ql
from quantpanel.operators import routes as rt
from quantpanel.operators import scores as sc
from quantpanel.operators import sectors as se
from quantpanel.sources import bars as src
from quantpanel.streaming import candidates as ca
from quantpanel.streaming import quotes as qs

from .catalog import _EMA, _PANEL, _S, _SCORED, _avg, _scored, query

# -- membership -------------------------------------------------------------------------------------------------------

_BATCH = """mo AS (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS m, l_suppkey, l_partkey FROM lineitem),
ba AS (SELECT DISTINCT m AS batch_date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, 'industry' AS sector_type, r_name AS sector_label FROM mo JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE (year(m) * 12 + month(m) + l_suppkey) % 5 > 0
UNION SELECT DISTINCT m, lpad(CAST(l_suppkey AS VARCHAR), 6, '0'), 'concept', p_brand FROM mo JOIN part ON p_partkey = l_partkey WHERE month(m) % 3 > 0 AND length(p_brand) > 0),"""
_VERSIONS = """nb AS (SELECT *, row_number() OVER (PARTITION BY sector_type ORDER BY batch_date) AS no, lead(batch_date) OVER (PARTITION BY sector_type ORDER BY batch_date) AS nd FROM (SELECT DISTINCT sector_type, batch_date FROM ba)),
nr AS (SELECT symbol, ba.sector_type, sector_label, batch_date, no, nd, no - row_number() OVER (PARTITION BY symbol, ba.sector_type, sector_label ORDER BY no) AS run FROM ba JOIN nb USING (sector_type, batch_date)),
vs AS (SELECT symbol, sector_type, sector_label, min(batch_date) AS valid_from, arg_max(nd, no) FILTER (nd IS NOT NULL) AS x, max_by(coalesce(nd, DATE '9999-01-01'), no) AS y FROM nr GROUP BY symbol, sector_type, sector_label, run),"""


def _batches(spark, sf_dir):
    """Monthly batches: symbols of the month by region, most of them, and by the brands they sold; every third has no brands."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    month = t("lineitem").select(F.trunc("l_shipdate", "month").cast("date").alias("batch_date"), "l_suppkey", "l_partkey").distinct()
    symbol = F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol")
    region = t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    kept = (F.year("batch_date") * 12 + F.month("batch_date") + F.col("l_suppkey")) % 5 > 0
    a = month.join(region, "l_suppkey").where(kept).select("batch_date", symbol, F.lit("industry").alias("sector_type"), F.col("r_name").alias("sector_label"))
    b = month.join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").where(F.month("batch_date") % 3 > 0).select("batch_date", symbol, F.lit("concept").alias("sector_type"), F.col("p_brand").alias("sector_label"))
    return a.union(b).distinct()


@query(f"{_BATCH} {_VERSIONS} --- SELECT symbol, sector_type, sector_label, valid_from, nullif(y, DATE '9999-01-01') AS valid_to FROM vs", "", "symbol sector_type sector_label valid_from valid_to")
def membership_versions(spark, sf_dir):
    """Versions of membership over monthly batches, some without a type (K2)."""
    return mb.versions(_batches(spark, sf_dir))


@query(f"{_BATCH} {_VERSIONS} --- SELECT symbol, trade_date, sector_type, sector_label FROM bars JOIN vs USING (symbol) WHERE trade_date >= valid_from AND trade_date < y AND trade_date >= DATE '1998-06-01'", "", "symbol trade_date sector_type sector_label")
def membership_as_of(spark, sf_dir):
    """Sectors of each bar from 1998-06 on, on its own day (K2)."""
    days = src.bars_of(spark, sf_dir).where("trade_date >= date '1998-06-01'").select("symbol", "trade_date")
    return mb.as_of_days(days, mb.versions(_batches(spark, sf_dir)))


@query(f"{_BATCH} fs AS (SELECT symbol, sector_type, sector_label, min(batch_date) AS seen FROM ba GROUP BY 1, 2, 3), --- SELECT symbol, coalesce(string_agg(sector_label, '/' ORDER BY seen, sector_label) FILTER (sector_type = 'industry'), '') AS industry_names, coalesce(string_agg(sector_label, '/' ORDER BY seen, sector_label) FILTER (sector_type = 'concept'), '') AS concept_names FROM fs GROUP BY 1", "", "symbol industry_names concept_names")
def sector_names(spark, sf_dir):
    """Names of a symbol's sectors in the order of the batches that brought them (K3)."""
    return mb.sector_names(mb.clean_membership(_batches(spark, sf_dir).groupBy("symbol", "sector_type", "sector_label").agg(F.min("batch_date").alias("batch_date"))), "batch_date")


# -- sources ----------------------------------------------------------------------------------------------------------


@query("u AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol FROM supplier UNION SELECT '999999'), --- SELECT symbol, count(trade_date) AS n_bars, CASE WHEN count(trade_date) > 0 THEN 'stored' ELSE 'missing' END AS state FROM u LEFT JOIN bars USING (symbol) GROUP BY 1", "", "symbol n_bars state")
def scan_state(spark, sf_dir):
    """Which symbols have stored bars."""
    universe = src.membership_of(spark, sf_dir).select("symbol").union(spark.range(1).select(F.lit("999999").alias("symbol")))
    return src.scan_state(universe, src.bars_of(spark, sf_dir))


@query(f"h AS (SELECT symbol, trade_date, coalesce(pct_change, (close / lag(close) OVER ({_S}) - 1) * 100) AS return_pct, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM bars WHERE trade_date <= DATE '1997-06-30'), --- SELECT * FROM h WHERE k <= 25", "return_pct", "symbol trade_date")
def history_tail(spark, sf_dir):
    """The last 25 bars up to a date."""
    return src.history(src.bars_of(spark, sf_dir), "1997-06-30", 25).select("symbol", "trade_date", "return_pct")


@query(f"v AS (SELECT *, lag(close) OVER ({_S}) AS pc FROM bars), --- SELECT symbol, trade_date, close - pc AS change, (close / pc - 1) * 100 AS pct, (high - low) / close * 100 AS amplitude FROM v", "change pct amplitude", "symbol trade_date")
def vendor_bars(spark, sf_dir):
    """Bars as a vendor sends them, as text and dotted codes, made whole."""
    bars = src.bars_of(spark, sf_dir)
    raw = bars.select(F.concat(F.lit("sh."), "symbol").alias("code"), F.col("trade_date").cast("string").alias("trade_date"), *[F.col(c).cast("string").alias(c) for c in ("open", "close", "high", "low", "volume", "amount")])
    return src.normalise_vendor_bars(raw, "code").select("symbol", "trade_date", "change", F.col("pct_change").alias("pct"), "amplitude")


@query("s AS (SELECT symbol, min(trade_date) AS lo, max(trade_date) AS hi FROM bars GROUP BY 1), --- SELECT symbol, DATE '1990-01-01' AS start_date, CAST(lo - 1 AS DATE) AS end_date FROM s WHERE lo > DATE '1990-01-01' UNION ALL SELECT symbol, CAST(hi + 1 AS DATE), DATE '2030-01-01' FROM s WHERE hi < DATE '2030-01-01'", "", "symbol start_date end_date")
def missing_ranges(spark, sf_dir):
    """Spans before and after the cached ones."""
    return src.missing_ranges(src.bars_of(spark, sf_dir), "1990-01-01", "2030-01-01")


@query("--- SELECT symbol, trade_date, CASE WHEN trade_date >= DATE '1998-01-01' THEN close * 2 ELSE close END AS close FROM bars", "close", "symbol trade_date")
def upsert(spark, sf_dir):
    """Bars with those from 1998 on replaced."""
    bars = src.bars_of(spark, sf_dir).select("symbol", "trade_date", "close")
    return src.upsert(bars, bars.where("trade_date >= '1998-01-01'").withColumn("close", F.col("close") * 2))


@query("u AS (SELECT lpad(CAST(600000 + s_suppkey % 7 * 500 + s_suppkey AS VARCHAR), 6, '0') AS symbol, CASE WHEN s_suppkey % 5 = 0 THEN '*ST' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN '0' ELSE '1' END AS trade_status FROM supplier), --- SELECT symbol, 'sse_main' AS board, 'SSE' AS exchange, trade_status <> '1' AS is_suspended FROM u WHERE substr(symbol, 1, 3) IN ('600', '601', '603', '605') AND NOT contains(upper(name), 'ST')", "", "symbol board exchange is_suspended")
def boards(spark, sf_dir):
    """Main-board instruments without ST."""
    s = src.table(spark, sf_dir, "supplier")
    code = F.lpad((F.lit(600000) + F.col("s_suppkey") % 7 * 500 + F.col("s_suppkey")).cast("string"), 6, "0")
    name = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("*ST"), "s_name")).otherwise(F.col("s_name"))
    return src.classify_board(s.select(code.alias("symbol"), name.alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "0").otherwise("1").alias("trade_status"))).select("symbol", "board", "exchange", "is_suspended")


@query("n AS (SELECT trade_date FROM bars GROUP BY 1 HAVING trade_date <= DATE '1996-12-31' ORDER BY 1 DESC LIMIT 5), --- SELECT symbol, trade_date FROM bars JOIN n USING (trade_date)", "", "symbol trade_date")
def newest_reports(spark, sf_dir):
    """Rows of the five newest report dates up to a date."""
    return src.newest_reports(src.bars_of(spark, sf_dir).select("symbol", "trade_date"), "1996-12-31", 5)


@query("--- SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'n' || s_suppkey END AS name FROM supplier", "", "symbol name")
def first_names(spark, sf_dir):
    """Names of symbols by the first source that has one."""
    s = src.table(spark, sf_dir, "supplier")
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol")
    return src.first_names(s.where("s_suppkey % 2 = 0").select(code, F.col("s_name").alias("name")), s.select(code, F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("name")))


@query("--- SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, value AS close, CAST(ts AS DATE) AS trade_date, CAST(event_id AS VARCHAR) AS name FROM events", "close", "symbol trade_date name")
def quote_lines(spark, sf_dir):
    """Feed lines parsed into quotes and normalised."""
    e = src.table(spark, sf_dir, "events")
    blank = ",".join("0" for _ in range(22))
    line = F.concat(F.lit('var hq_str_sh'), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit('="'), F.col("event_id").cast("string"), F.lit(",1,1,"), F.col("value").cast("string"), F.lit(",2,0.5,1,1,"), F.lit(blank), F.lit(","), F.date_format("ts", "yyyy-MM-dd"), F.lit(","), F.date_format("ts", "HH:mm:ss"), F.lit('";'))
    return src.normalise_quotes(src.parse_quote_lines(e.select(line.alias("value")))).select("symbol", "close", "trade_date", "name")


_AUDITED = ("return_5d", "return_60d", "vol_20")


@query(f"x AS (SELECT *, ln(close / lag(close) OVER ({_S})) AS lr, close / lag(close, 5) OVER ({_S}) - 1 AS return_5d, close / lag(close, 60) OVER ({_S}) - 1 AS return_60d FROM bars), y AS (SELECT *, {_avg('lr', 20).replace('avg(', 'stddev_samp(')} AS vol_20 FROM x), --- " + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(({c} IS NULL)::INT) AS missing_rate, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM y" for c in _AUDITED), "missing_rate mean std min max", "feature")
def feature_audit(spark, sf_dir):
    """Audit of features, those that are always null dropped (Q4, Q5)."""
    df = lab.base_features(src.bars_of(spark, sf_dir)).withColumn("never", F.lit(None).cast("double"))
    kept = lab.drop_empty_features(df, [*_AUDITED, "never"])
    return ql.feature_audit(kept, [c for c in (*_AUDITED, "never") if c in kept.columns])


# -- market and windows ----------------------------------------------------------------------------------------------


@query(f"{_PANEL} lb0 AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n, breadth_ma20 < 0.5 AS x FROM mkt), lb1 AS (SELECT n - row_number() OVER (ORDER BY n) AS g FROM lb0 WHERE x), lb2 AS (SELECT count(*) AS k FROM lb1 GROUP BY g), --- SELECT coalesce(max(k), 0) AS longest_block FROM lb2", "", "longest_block")
def longest_block(spark, sf_dir):
    """Longest run of days of little breadth."""
    return mk.longest_block(mk.daily_market(mk.symbol_panel(src.bars_of(spark, sf_dir))).withColumn("blocked", F.col("breadth_ma20") < 0.5))


@query(f"{_PANEL} s AS (SELECT trade_date, 1 - breadth_ma20 AS score FROM mkt), t AS (SELECT quantile_cont(score, 0.8) AS threshold FROM s WHERE trade_date < DATE '1996-01-01'), --- SELECT trade_date, score, threshold, CASE WHEN score < threshold THEN 'allow' ELSE 'no_trade' END AS permission FROM s CROSS JOIN t WHERE trade_date >= DATE '1996-01-01'", "score threshold", "trade_date permission")
def gate_decision(spark, sf_dir):
    """Permission of each day by the quantile of training scores."""
    day = mk.daily_market(mk.symbol_panel(src.bars_of(spark, sf_dir))).select("trade_date", (1 - F.col("breadth_ma20")).alias("score"))
    return mk.gate_decision(day.withColumn("split", F.when(F.col("trade_date") < "1996-01-01", "train").otherwise("test")), "score").select("trade_date", "score", "threshold", "permission")


@query("d0 AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM bars)), s0 AS (SELECT unnest(range(0, (SELECT count(*) FROM d0) - 1261 + 1, 250)) AS s), w0 AS (SELECT s // 250 + 1 AS k, s + 999 AS te, s + 1011 AS vs, s + 1260 AS ve FROM s0), --- SELECT 'wf_' || lpad(CAST(k AS VARCHAR), 2, '0') AS window_id, CASE WHEN i <= te THEN 'train' ELSE 'valid' END AS split, count(*) AS n_rows FROM bars JOIN d0 USING (trade_date) JOIN w0 ON i <= te OR i BETWEEN vs AND ve GROUP BY 1, 2", "", "window_id split n_rows")
def anchored_slices(spark, sf_dir):
    """Rows of anchored windows by split (V8, V9)."""
    bars = src.bars_of(spark, sf_dir).select("symbol", "trade_date")
    return gt.slice_windows(bars, gt.walk_forward(bars, 1000, 250, 250, 11, anchored=True)).groupBy("window_id", "split").agg(F.count(F.lit(1)).alias("n_rows"))


# -- scores ----------------------------------------------------------------------------------------------------------


@query(f"{_SCORED} b AS (SELECT score > 0 AS p, outcome > 0 AS y, (score - (outcome > 0)::INT) ** 2 AS e FROM s1), c AS (SELECT sum((p AND y)::INT)::BIGINT AS tp, sum((p AND NOT y)::INT)::BIGINT AS fp, sum((NOT p AND y)::INT)::BIGINT AS fn, sum((NOT p AND NOT y)::INT)::BIGINT AS tn, avg(e) AS brier FROM b), --- SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c", "brier precision recall accuracy f1", "tp fp fn tn")
def classification(spark, sf_dir):
    """Confusion counts and their rates."""
    df = _scored(spark, sf_dir).withColumn("y", (F.col("outcome") > 0).cast("int"))
    return sc.classification_metrics(df, "score", "y", 1e-300)  # above 0


@query(f"{_SCORED} r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score, symbol)::DOUBLE AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM s1), e AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(ceil((k - 1) * 10 / (n - 1)) - 1, 0) END::INT AS a, CASE WHEN n < 10 THEN floor((k - 1) / n * 10) ELSE greatest(ceil((k - 1) * 10 / (n - 1)) - 1, 0) END::INT AS c FROM r), --- SELECT a AS decile, c AS strict_decile, count(*) AS n_rows, avg(outcome) AS mean_outcome FROM e GROUP BY 1, 2", "mean_outcome", "decile strict_decile n_rows")
def decile_rules(spark, sf_dir):
    """Deciles by two rules."""
    df = _scored(spark, sf_dir).withColumns({"decile": sc.decile("score", ["trade_date"], "a"), "strict_decile": sc.decile("score", ["trade_date"], "c")})
    return df.groupBy("decile", "strict_decile").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("outcome").alias("mean_outcome"))


@query(f"{_SCORED} i0 AS (SELECT trade_date, nullif(corr(score, outcome), 'nan'::DOUBLE) AS ic FROM s1 GROUP BY 1 HAVING count(*) >= 3), --- SELECT avg(ic) AS mean_ic, avg(ic) / stddev_pop(ic) AS icir, avg((ic > 0)::INT) AS positive_rate FROM i0", "mean_ic icir positive_rate")
def signal_metrics(spark, sf_dir):
    """Mean and stability of the daily IC."""
    return sc.signal_metrics(sc.daily_ic(_scored(spark, sf_dir), "score", "outcome")).select("mean_ic", "icir", "positive_rate")


@query(f"{_SCORED} --- SELECT symbol, trade_date, CASE WHEN count(score) OVER ({_S} ROWS 4 PRECEDING) >= 3 THEN avg(score) OVER ({_S} ROWS 4 PRECEDING) END AS score_mean, CASE WHEN count(score) OVER ({_S} ROWS 4 PRECEDING) >= 3 THEN stddev_pop(score) OVER ({_S} ROWS 4 PRECEDING) END AS score_std, CASE WHEN count(score) OVER ({_S} ROWS 4 PRECEDING) >= 3 THEN score - avg(score) OVER ({_S} ROWS 4 PRECEDING) END AS score_delta FROM s1", "score_mean score_std score_delta", "symbol trade_date")
def rolling_scores(spark, sf_dir):
    """Rolling mean, deviation and distance from the mean of a score."""
    return sc.rolling_score(_scored(spark, sf_dir), "score").select("symbol", "trade_date", "score_mean", "score_std", "score_delta")


@query(f"{_SCORED} t0 AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS k FROM s1), t1 AS (SELECT symbol, trade_date FROM t0 WHERE k <= 3), d0 AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS d FROM (SELECT DISTINCT trade_date FROM t1)), t2 AS (SELECT *, d - row_number() OVER ({_S}) AS g FROM t1 JOIN d0 USING (trade_date)), --- SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol, g ORDER BY trade_date) AS streak FROM t2", "", "symbol trade_date streak")
def list_streaks(spark, sf_dir):
    """Days in a row on the list of the three best."""
    return sc.streaks(_best(_scored(spark, sf_dir), 3)).select("symbol", "trade_date", "streak")


def _best(df, n):
    w = Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol")
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).select("symbol", "trade_date")


@query("dd AS (SELECT DISTINCT trade_date FROM bars), --- SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS k FROM dd) WHERE k > 20 AND k <= 120", "", "trade_date")
def signal_dates(spark, sf_dir):
    """The 100 newest days with 20 days after them (B1)."""
    return bt.signal_dates(src.bars_of(spark, sf_dir), 20, 100)


# -- quotes ----------------------------------------------------------------------------------------------------------


@query("q0 AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, CAST(ts AS DATE) AS trade_date, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2), q1 AS (SELECT symbol, min(trade_date) AS d FROM q0 GROUP BY 1), --- SELECT symbol, trade_date, close, false AS provisional FROM bars LEFT JOIN q1 USING (symbol) WHERE d IS NULL OR trade_date < d UNION ALL SELECT symbol, trade_date, close, true FROM q0", "close", "symbol trade_date provisional")
def overlaid_bars(spark, sf_dir):
    """History with the provisional bars of the quotes."""
    quotes = qs.provisional_bars(qs.latest_quotes(qs.quotes_of(src.table(spark, sf_dir, "events")))).withColumn("provisional", F.lit(True))
    return qs.overlay(src.bars_of(spark, sf_dir).withColumn("provisional", F.lit(False)), quotes).select("symbol", "trade_date", "close", "provisional")


# -- sectors ---------------------------------------------------------------------------------------------------------

_P = "PARTITION BY sector_label ORDER BY trade_date"


def _pm(c: str, n: int, f: str = "avg") -> str:
    return f"CASE WHEN count({c}) OVER ({_P} ROWS {n - 1} PRECEDING) >= {n} THEN {f}({c}) OVER ({_P} ROWS {n - 1} PRECEDING) END"


_RETURNS = f"wr AS (SELECT * REPLACE (coalesce(pct_change, (close / lag(close) OVER ({_S}) - 1) * 100) AS pct_change) FROM bars), wd AS (SELECT DISTINCT trade_date FROM wr WHERE pct_change IS NOT NULL ORDER BY trade_date DESC LIMIT 420), cb AS (SELECT * FROM wr WHERE pct_change IS NOT NULL AND trade_date >= (SELECT min(trade_date) FROM wd)),"
_BACK = f"""@fm AS (SELECT * FROM members WHERE sector_label IN (SELECT sector_label FROM members GROUP BY 1 HAVING count(DISTINCT symbol) >= 5)), bm AS (SELECT trade_date, avg(pct_change) AS bench FROM cb GROUP BY 1), sd0 AS (SELECT sector_label, trade_date, avg(pct_change) AS ret, sum(amount) AS amount FROM cb JOIN fm USING (symbol) GROUP BY 1, 2), g0 AS (SELECT sector_label, trade_date, coalesce(ret, 0) AS ret, coalesce(amount, 0) AS amount, bench FROM (SELECT DISTINCT sector_label FROM fm) CROSS JOIN bm LEFT JOIN sd0 USING (sector_label, trade_date)),
g1 AS (SELECT *, 100 * exp(sum(ln(1 + ret / 100)) OVER ({_P})) AS v, 100 * exp(sum(ln(1 + bench / 100)) OVER ({_P})) AS b, row_number() OVER ({_P}) AS pos, count(*) OVER (PARTITION BY sector_label) AS n FROM g0),
g2 AS (SELECT *, {', '.join(f'{_pm("v", k)} AS m{k}' for k in (5, 10, 20, 60))}, v <= ({_pm('v', 20, 'min')}) * 1.002 AS al20, v <= ({_pm('v', 60, 'min')}) * 1.002 AS al60, last_value(v) OVER (PARTITION BY sector_label ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest, count(*) OVER ({_P} ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING) = 121 AND v >= max(v) OVER ({_P} ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS peak FROM g1),
g3 AS (SELECT *, {', '.join(f'(v / lag(v, {k}) OVER ({_P}) - 1) * 100 AS return_{k}d' for k in (1, 3, 5))}, (v / lag(v, 3) OVER ({_P}) - b / lag(b, 3) OVER ({_P})) * 100 AS excess_return_3d, {', '.join(f'(m{k} / lag(m{k}, 5) OVER ({_P}) - 1) * 100 AS slope_{k}' for k in (5, 10, 20, 60))}, NOT bool_or(coalesce(al20, false)) OVER ({_P} ROWS 4 PRECEDING) AS no_new_20d_low_in_5d, NOT bool_or(coalesce(al60, false)) OVER ({_P} ROWS 4 PRECEDING) AS no_new_60d_low_in_5d, NOT bool_or(coalesce(al20, false)) OVER ({_P} ROWS 9 PRECEDING) AS no_new_20d_low_in_10d, avg((ret > 0)::INT) OVER ({_P} ROWS 2 PRECEDING) AS up_ratio_3d,
stddev_samp(ret) OVER ({_P} ROWS 4 PRECEDING) / stddev_samp(ret) OVER ({_P} ROWS 19 PRECEDING) AS volatility_ratio, (v / min(v) OVER ({_P} ROWS 19 PRECEDING) - 1) * 100 AS distance_to_recent_low, coalesce(avg(CASE WHEN ret < 0 THEN amount END) OVER ({_P} ROWS 9 PRECEDING) / nullif(avg(amount) OVER ({_P} ROWS 9 PRECEDING), 0), 0) AS down_amount_ratio FROM g2),
pk AS (SELECT sector_label, max(CASE WHEN peak AND v >= latest THEN pos END) AS p1, arg_min(pos, (-v, pos)) AS p0, max(n) AS n FROM g2 GROUP BY 1), pq AS (SELECT sector_label, n - coalesce(p1, p0) AS days_since_peak, p1 IS NOT NULL AS peak_confirmed, g2.trade_date AS previous_peak_date, g2.v AS peak_v FROM pk JOIN g2 USING (sector_label, n) WHERE g2.pos = coalesce(p1, p0)),"""
_ALL = _BACK.replace("@", "cb AS (SELECT * FROM bars), ")
_BACK = _BACK.replace("@", _RETURNS)
_BACK_COLUMNS = "return_1d return_3d return_5d excess_return_3d slope_5 slope_10 slope_20 slope_60 volatility_ratio distance_to_recent_low down_amount_ratio drawdown_from_peak_pct"


@query(f"{_BACK} --- SELECT g3.*, days_since_peak, peak_confirmed, previous_peak_date, (v / peak_v - 1) * 100 AS drawdown_from_peak_pct FROM g3 JOIN pq USING (sector_label) WHERE pos = n", _BACK_COLUMNS, "sector_label trade_date no_new_20d_low_in_5d no_new_60d_low_in_5d days_since_peak peak_confirmed previous_peak_date")
def sector_pullback(spark, sf_dir):
    """Peaks and technical metrics of sectors."""
    return pb.metrics(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir)).select("sector_label", "trade_date", "no_new_20d_low_in_5d", "no_new_60d_low_in_5d", "days_since_peak", "peak_confirmed", "previous_peak_date", *_BACK_COLUMNS.split())



def _ramp(x: str, lo: float, hi: float, a: float, b: float) -> str:
    return f"{a} + ({b - a}) * greatest(0, least(1, ({x} - ({lo})) / ({hi - lo})::DOUBLE))"


def _steps(x: str, *rows) -> str:
    """CASE of (condition, score) pairs and a last score; 50 for a null."""
    return f"CASE WHEN ({x}) IS NULL THEN 50 " + " ".join(f"WHEN {x} {c} THEN {v}" for c, v in rows[:-1]) + f" ELSE {rows[-1]} END"


def _slope_sql(x: str) -> str:
    return _steps(x, ("< -2", 20), ("< -1", _ramp(x, -2, -1, 30, 60)), ("< -0.5", _ramp(x, -1, -0.5, 60, 80)), ("< 0", _ramp(x, -0.5, 0, 80, 100)), 100)


def _rebound_sql(x: str) -> str:
    return _steps(x, ("< -3", 20), ("< 0", _ramp(x, -3, 0, 40, 70)), ("<= 5", _ramp(x, 0, 5, 80, 100)), ("<= 10", _ramp(x, 5, 10, 80, 60)), 45)


def _buy_sql(age: str, depth: str) -> dict[str, str]:
    """The five parts and the capped sum, from the columns of g3 (industry sectors), the age of the peak and the depth below it."""
    no = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0 END"
    x, d, r5, da = "volatility_ratio", "greatest(distance_to_recent_low, 0)", "return_5d", "down_amount_ratio"
    e = "excess_return_3d"
    parts = {
        "depth": _steps(f"({depth})", ("<= 0", 20), ("< 5", _ramp(f"({depth})", 0, 5, 30, 85)), ("<= 15", 100), ("<= 30", _ramp(f"({depth})", 15, 30, 70, 35)), 25),
        "timing": _steps(age, ("<= 3", _ramp(age, 0, 3, 20, 50)), ("<= 45", 100), ("<= 90", _ramp(age, 46, 90, 75, 45)), 35),
        "stable": f"0.25 * ({no('no_new_20d_low_in_5d', 45)} + {no('no_new_60d_low_in_5d', 35)} + {no('no_new_20d_low_in_10d', 20)}) + 0.35 * (0.3 * ({_slope_sql('slope_5')}) + 0.3 * ({_slope_sql('slope_10')}) + 0.25 * ({_slope_sql('slope_20')}) + 0.15 * ({_slope_sql('slope_60')})) + 0.2 * ({no('v > m5', 40)} + {no('v > m10', 30)} + {no('v > m20', 30)}) + 0.2 * ({_steps(x, ('<= 0.7', 100), ('<= 1', _ramp(x, 0.7, 1, 100, 70)), ('<= 1.3', _ramp(x, 1, 1.3, 70, 40)), 25)})",
        "rebound": f"0.3 * ({_rebound_sql('return_3d')}) + 0.25 * ({_rebound_sql(r5)}) + 0.25 * ({_steps(e, ('< -3', 25), ('< 0', _ramp(e, -3, 0, 45, 70)), ('<= 5', _ramp(e, 0, 5, 80, 100)), 70)}) + 0.2 * greatest(0, least(100, coalesce(up_ratio_3d * 100, 50)))",
        "risk": f"0.35 * ({_steps(d, ('< 3', _ramp(d, 0, 3, 45, 90)), ('<= 10', 100), ('<= 20', _ramp(d, 10, 20, 80, 50)), 35)}) + 0.25 * ({_steps(r5, ('< -8', 15), ('< -5', _ramp(r5, -8, -5, 20, 40)), ('< -1', _ramp(r5, -5, -1, 40, 80)), 100)}) + 0.2 * ({_steps(da, ('<= 0.8', 100), ('<= 1.2', _ramp(da, 0.8, 1.2, 80, 50)), ('<= 1.5', _ramp(da, 1.2, 1.5, 50, 25)), 20)}) + 0.2 * ({_slope_sql('slope_20')})",
    }
    caps = [("NOT no_new_20d_low_in_5d", 55), ("NOT no_new_60d_low_in_5d", 50), ("slope_5 < -0.5 AND slope_10 < -0.5 AND slope_20 < -0.5", 50), ("return_3d > 10", 70), (f"-({depth}) > -5 AND return_5d > 5", 60), ("volatility_ratio > 1.3 AND down_amount_ratio > 1.1", 55)]
    total = f"0.15 * ({parts['depth']}) + 0.1 * ({parts['timing']}) + 0.4 * ({parts['stable']}) + 0.2 * ({parts['rebound']}) + 0.15 * ({parts['risk']})"
    return parts | {"score": f"least({total}, {', '.join(f'CASE WHEN {c} THEN {v} ELSE 100 END' for c, v in caps)})"}


_BUY = {k: f"({v})::DOUBLE" for k, v in _buy_sql("days_since_peak", "CASE WHEN peak_v > 0 THEN greatest(0, (1 - v / peak_v) * 100) END").items()}
_LEVEL = "CASE WHEN s >= 80 THEN '重点观察/布局' WHEN s >= 65 THEN '可以试仓' WHEN s >= 50 THEN '观察等确认' WHEN s >= 35 THEN '有回调未企稳' ELSE '暂不适合买' END"


@query(f"{_BACK} bs AS (SELECT sector_label, trade_date, {_BUY['depth']} AS d, {_BUY['timing']} AS t, {_BUY['stable']} AS st, {_BUY['rebound']} AS rb, {_BUY['risk']} AS rk, {_BUY['score']} AS s FROM g3 JOIN pq USING (sector_label) WHERE pos = n), --- SELECT sector_label, trade_date, round(d, 2) AS pullback_depth_score, round(t, 2) AS pullback_timing_score, round(st, 2) AS stabilization_score, round(rb, 2) AS rebound_confirmation_score, round(rk, 2) AS risk_control_score, round(s, 2) AS buy_score, {_LEVEL} AS buy_level FROM bs", "pullback_depth_score pullback_timing_score stabilization_score rebound_confirmation_score risk_control_score buy_score", "sector_label trade_date buy_level")
def sector_buy_scores(spark, sf_dir):
    """Buy scores of sectors with caps and level."""
    df = pb.buy_scores(pb.metrics(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir)))
    return df.select("sector_label", "trade_date", "buy_level", *pb.PARTS, "buy_score")



def _last_scores(bars, day):
    """The last bar of each symbol, dated `day`, with its stand-in scores: a row a symbol, stored as each phase reads it."""
    rows = lab.base_features(ind.newest_bars(bars, 61)).withColumn("ma_20", ind.full(F.avg, "close", 20))
    return src.held(ind.last_rows(rows).select("symbol", F.lit(day).cast("date").alias("trade_date"), F.col("vol_20").alias("p1"), (-F.col("drawdown_60")).alias("p2"), (-F.col("return_5d")).alias("p4"), "close", "ma_20", "pct_change", "range_pct", "return_20d", "log_return"))


def _stocks(spark, sf_dir):
    """Scores of the last bar of each symbol, standing in for the fitted ones: volatility, drawdown and reversal."""
    df = _last_scores(src.held_bars(spark, sf_dir), "1998-12-31").withColumns({"daily_return_pct": F.col("pct_change"), "atr_pct_14": F.col("range_pct")})
    hits = df.where("close > ma_20").select("symbol", F.lit(5).alias("pattern_id"))
    p1, p2, p4 = rt.phase_risk(df, "p1", "phase1"), rt.phase_risk(df, "p2", "phase2"), rt.phase_return(df, "p4")
    return df, p1, p2, p4, rt.stock_scores(p1, p2, p4, df.select("symbol", "daily_return_pct", "atr_pct_14"), hits)


_R100 = "CASE WHEN count(*) OVER () = 1 THEN 100 ELSE round((count(*) OVER (ORDER BY {0} RANGE UNBOUNDED PRECEDING) - 1)::DOUBLE / (count(*) OVER () - 1) * 100, 2) END"
_STOCK = f"""b1 AS (SELECT *, ln(close / lag(close) OVER ({_S})) AS lr, {_avg('close', 60).replace('avg(', 'max(')} AS t60, {_avg('close', 20)} AS m20, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k, close / lag(close, 5) OVER ({_S}) - 1 AS r5 FROM bars), b2 AS (SELECT *, {_avg('lr', 20).replace('avg(', 'stddev_samp(')} AS p1, 1 - close / t60 AS p2, -r5 AS p4, (high - low) / close AS a FROM b1), b3 AS (SELECT * FROM b2 WHERE k = 1),
f1 AS (SELECT symbol, row_number() OVER (ORDER BY p1 DESC, symbol) AS phase1_risk_rank, {_R100.format('-p1')} AS s1 FROM b3 WHERE p1 IS NOT NULL), f2 AS (SELECT symbol, {_R100.format('-p2')} AS s2 FROM b3 WHERE p2 IS NOT NULL), f4 AS (SELECT symbol, row_number() OVER (ORDER BY p4 DESC, symbol) AS phase4_rank, {_R100.format('p4')} AS s4 FROM b3 WHERE p4 IS NOT NULL),
st AS (SELECT f1.symbol, phase1_risk_rank, phase4_rank, s1 AS phase1_score_100, s2 AS phase2_score_100, s4 AS phase4_score_100, round(s4 + 0.08::DOUBLE * greatest(0, least(100, 100 - 2 * abs(s1 - 80))) + 0.12::DOUBLE * greatest(0, least(100, 100 - 2 * abs(s2 - 80))), 4) AS centered_risk_score, round(s4 + 0.2::DOUBLE * s1 + 0.2::DOUBLE * s2, 4) AS mixed_score, coalesce(close > m20, false) AS pattern_match, s1 > 20 AND s2 > 20 AND NOT coalesce(pct_change > 9.9, false) AS public FROM f1 JOIN f2 USING (symbol) LEFT JOIN f4 USING (symbol) JOIN b3 USING (symbol)),"""


@query(f"{_STOCK} --- SELECT * FROM st", "phase1_score_100 phase2_score_100 phase4_score_100 centered_risk_score mixed_score", "symbol phase1_risk_rank phase4_rank pattern_match public")
def stock_scores(spark, sf_dir):
    """Ranks, 0-100 and mixed scores and the public filter of each symbol."""
    return _stocks(spark, sf_dir)[-1].select("symbol", "phase1_risk_rank", "phase4_rank", "pattern_match", "public", "phase1_score_100", "phase2_score_100", "phase4_score_100", "centered_risk_score", "mixed_score")


@query()
def phase_display(spark, sf_dir):
    """The display table of all phases with crash scores and the gate."""
    df, p1, p2, p4, _ = _stocks(spark, sf_dir)
    crash = rt.crash_score(lab.negative_outliers(lab.crash_measures(lab.firm_returns(lab.weekly_returns(src.held_bars(spark, sf_dir))))), 1998)
    p8 = rt.phase_opportunity(df.withColumns({"raw": F.col("return_20d"), "limit": F.col("daily_return_pct") > 9.9}), "raw", "limit")
    gate = spark.range(1).select(F.lit("allow").alias("trade_permission"))
    returns = df.select("symbol", rt.daily_return().alias("daily_return"))
    return rt.phase_display(p1, p2, p4, p8, crash, returns, gate=gate)


def _sectors(spark, sf_dir):
    """Scores of sectors of the last day: technical state, and stand-ins for the long and buy scores."""
    bars = src.held_bars(spark, sf_dir)
    days = src.held(se.sector_days(bars, src.membership_of(spark, sf_dir)))  # a row a sector and day
    tech = gt.sector_technicals(se.sector_index(days), days).withColumn("sector_type", F.lit("industry"))
    last = days.groupBy(*rt.KEY).agg(*[F.max_by(c, "trade_date").alias(c) for c in ("amount_weighted_pct_change", "up_ratio")])
    long = tech.select(*rt.KEY, "return_5d", "return_20d", "ma5_slope_pct", F.round(sc.linear_score(F.col("return_20d"), -20.0, 20.0), 2).alias("long_mainline_score_100"))
    buy = pb.buy_scores(pb.metrics(bars, src.membership_of(spark, sf_dir))).select(*rt.KEY, F.col("buy_score").alias("phase9_score_100"))
    return rt.sector_scores(last, long, buy)


@query()
def sector_selection(spark, sf_dir):
    """Scores and selection of sectors."""
    return _sectors(spark, sf_dir)


@query()
def mainline_strength(spark, sf_dir):
    """State of the main lines."""
    return rt.mainline_strength(_sectors(spark, sf_dir))


def _leader_scores(spark, sf_dir):
    return ld.leader_scores(src.held_bars(spark, sf_dir), src.membership_of(spark, sf_dir), src.held)


@query()
def sector_watchlist(spark, sf_dir):
    """Selected sectors with their leaders."""
    out = rt.sector_watchlist(_sectors(spark, sf_dir), ld.leader_table(_leader_scores(spark, sf_dir)))
    return out.select(*rt.KEY, "long_mainline_rank", "short_mainline_rank", "phase9_rank_in_pool", "leader_symbols")


@query()
def concern_table(spark, sf_dir):
    """Sectors that each stock leads."""
    bars = src.held_bars(spark, sf_dir)
    return rt.concern_table(rt.stock_base(bars, src.membership_of(spark, sf_dir)), rt.concern_relations(_leader_scores(spark, sf_dir)))


def _routes(spark, sf_dir):
    members = _leader_scores(spark, sf_dir).select("symbol", *rt.KEY, F.col("combined_score").alias("leader_score"))
    return tuple(src.held(df) for df in (_sectors(spark, sf_dir), members, _stocks(spark, sf_dir)[-1]))  # a row a sector or symbol, read several times


@query()
def routes(spark, sf_dir):
    """Candidates of the routes A1, A2 and B."""
    return rt.all_routes(*_routes(spark, sf_dir))


@query()
def leader_pool(spark, sf_dir):
    """Leaders of the strongest sectors."""
    sectors, members, _ = _routes(spark, sf_dir)
    return rt.leader_pool(rt.route_sectors(sectors, "short_mainline_score_100"), rt.route_sectors(sectors, "phase9_score_100"), members)


@query(f"{_STOCK} a0 AS (SELECT symbol, 0 AS source, row_number() OVER (ORDER BY centered_risk_score DESC, symbol) AS ord, 'pattern' AS tag FROM st WHERE public AND pattern_match), a1 AS (SELECT symbol, 1 AS source, phase4_rank AS ord, 'p4' AS tag FROM st WHERE public AND phase4_rank <= 20), a2 AS (SELECT * FROM a0 UNION ALL SELECT * FROM a1), a3 AS (SELECT symbol, min(struct_pack(s := source, o := ord)) AS first_at, string_agg(tag, '/' ORDER BY source) AS tags FROM a2 GROUP BY 1), --- SELECT symbol, tags FROM a3 ORDER BY first_at, symbol LIMIT 30", "", "symbol tags")
def filled_pool(spark, sf_dir):
    """The pool of patterns, filled up by return rank to 30 symbols."""
    stocks = _stocks(spark, sf_dir)[-1].where("public")
    order = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("centered_risk_score"), "symbol"))
    return rt.fill_pool(30, ("pattern", stocks.where("pattern_match").withColumn("order", order)), ("p4", stocks.where("phase4_rank <= 20").withColumn("order", F.col("phase4_rank")))).select("symbol", "tags")


@query()
def watchlist_payloads(spark, sf_dir):
    """Routes as nested lists and JSON, read back in order."""
    return rt.listed_symbols(rt.candidate_structs(rt.all_routes(*_routes(spark, sf_dir))))


# -- buy model of sectors ----------------------------------------------------------------------------------------------

_P9 = f"""{_ALL} q0 AS (SELECT *, {', '.join(f'(v / lag(v, {n}) OVER ({_P}) - 1) * 100 AS r{n}, (v / lag(v, {n}) OVER ({_P}) - b / lag(b, {n}) OVER ({_P})) * 100 AS e{n}' for n in (5, 20, 252, 504))}, {_pm('v', 120)} AS m120, CASE WHEN pos >= 60 THEN (v / max(v) OVER ({_P} ROWS 251 PRECEDING) - 1) * 100 END AS dd252, CASE WHEN pos >= 60 THEN pos - (arg_max(pos, (round(v, 9), -pos)) OVER ({_P} ROWS 251 PRECEDING)) END AS since252, ({_pm('ret', 5, 'stddev_samp')}) / nullif({_pm('ret', 20, 'stddev_samp')}, 0) AS vr, (b / lag(b) OVER ({_P}) - 1) * 100 AS b1, lead(v, 20) OVER ({_P}) / v - 1 AS fr, max(v) OVER ({_P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / v - 1 AS fx FROM g2),
q1 AS (SELECT *, CASE WHEN pos >= 120 THEN avg(coalesce(ret > b1 + 0.000000001::DOUBLE, false)::INT) OVER ({_P} ROWS 251 PRECEDING) END AS op252, (m60 / lag(m60, 5) OVER ({_P}) - 1) * 100 AS s60, (m120 / lag(m120, 5) OVER ({_P}) - 1) * 100 AS s120, (v / m60 - 1) * 100 AS d60, (v / m120 - 1) * 100 AS d120 FROM q0),"""


def _lin(c: str, lo: float, hi: float) -> str:
    return f"coalesce(greatest(0, least(100, ({c} - ({lo})) / ({hi - lo})::DOUBLE * 100)), 50)"


_LONG9 = f"""0.25::DOUBLE * {_lin('e504', -10, 60)} + 0.2::DOUBLE * {_lin('e252', -5, 40)} + 0.2::DOUBLE * {_lin('op252', 0.45, 0.6)} + 0.2::DOUBLE * (0.35::DOUBLE * {_lin('s60', -2, 2)} + 0.35::DOUBLE * {_lin('s120', -3, 3)} + 0.15::DOUBLE * {_lin('d60', -8, 8)} + 0.15::DOUBLE * {_lin('d120', -12, 12)})
+ 0.15::DOUBLE * (0.7::DOUBLE * CASE WHEN dd252 IS NULL THEN 50 WHEN dd252 >= -8 THEN 100 WHEN dd252 >= -20 THEN 60 + (dd252 + 20) / 12 * 40 WHEN dd252 >= -35 THEN 25 + (dd252 + 35) / 15 * 35 ELSE 15 END + 0.3::DOUBLE * CASE WHEN vr IS NULL THEN 50 WHEN vr <= 0.9 THEN 100 WHEN vr <= 1.3 THEN 100 - (vr - 0.9) / 0.4 * 45 WHEN vr <= 1.8 THEN 55 - (vr - 1.3) / 0.5 * 30 ELSE 15 END)"""


@query(f"{_P9} --- SELECT sector_label, trade_date, r5 AS return_5d, e20 AS excess_return_20d, dd252 AS drawdown_from_peak_252d_pct, since252 AS days_since_peak_252d, op252 AS outperform_ratio_252d, fr AS future_return_20d_close, fx AS future_max_return_20d, CASE WHEN fr IS NOT NULL THEN (fr >= 0.05)::INT END AS phase9_label, {_LONG9} AS long_mainline_score FROM q1", "return_5d excess_return_20d drawdown_from_peak_252d_pct days_since_peak_252d outperform_ratio_252d future_return_20d_close future_max_return_20d long_mainline_score", "sector_label trade_date phase9_label")
def sector_panel(spark, sf_dir):
    """Features, label and long score of each sector and day."""
    df = p9.sector_panel(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir))
    return df.select("sector_label", "trade_date", "phase9_label", "return_5d", "excess_return_20d", "drawdown_from_peak_252d_pct", "days_since_peak_252d", "outperform_ratio_252d", "future_return_20d_close", "future_max_return_20d", "long_mainline_score")


_RULE = {k: f"({v})::DOUBLE" for k, v in _buy_sql("since120", "greatest(0, -dd120)").items()}


@query(f"{_ALL} k0 AS (SELECT *, CASE WHEN pos >= 20 THEN (v / max(v) OVER ({_P} ROWS 119 PRECEDING) - 1) * 100 END AS dd120, coalesce(CASE WHEN pos >= 20 THEN pos - (arg_max(pos, (round(v, 9), -pos)) OVER ({_P} ROWS 119 PRECEDING)) END, 0) AS since120 FROM g3), k1 AS (SELECT * REPLACE (CASE WHEN pos >= 20 THEN no_new_20d_low_in_5d END AS no_new_20d_low_in_5d, CASE WHEN pos >= 60 THEN no_new_60d_low_in_5d END AS no_new_60d_low_in_5d, CASE WHEN pos >= 20 THEN no_new_20d_low_in_10d END AS no_new_20d_low_in_10d, CASE WHEN pos >= 3 THEN up_ratio_3d END AS up_ratio_3d, CASE WHEN pos >= 20 THEN volatility_ratio END AS volatility_ratio, CASE WHEN pos >= 20 THEN distance_to_recent_low END AS distance_to_recent_low, CASE WHEN pos >= 10 THEN avg(CASE WHEN ret < 0 THEN amount ELSE 0 END) OVER ({_P} ROWS 9 PRECEDING) / nullif(avg(amount) OVER ({_P} ROWS 9 PRECEDING), 0) END AS down_amount_ratio) FROM k0), --- SELECT sector_label, trade_date, {_RULE['depth']} AS rule_pullback_depth_score, {_RULE['timing']} AS rule_pullback_timing_score, {_RULE['stable']} AS rule_stabilization_score, {_RULE['rebound']} AS rule_rebound_confirmation_score, {_RULE['risk']} AS rule_risk_control_score, {_RULE['score']} AS rule_buy_score FROM k1", "rule_pullback_depth_score rule_pullback_timing_score rule_stabilization_score rule_rebound_confirmation_score rule_risk_control_score rule_buy_score", "sector_label trade_date")
def sector_rule_scores(spark, sf_dir):
    """Rule buy score and its parts for every sector and day."""
    df = p9.rule_buy_scores(p9.sector_panel(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir)))
    return df.select("sector_label", "trade_date", *[f"rule_{c}" for c in pb.PARTS], "rule_buy_score")


@query(f"{_P9} kk AS (SELECT sector_label, trade_date, {_LONG9} AS s FROM q1), kl AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, sector_label)::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS p FROM kk), --- SELECT sector_label, trade_date, s AS long_mainline_score FROM kl WHERE s >= 70 OR p <= 0.2", "long_mainline_score", "sector_label trade_date")
def mainline_rows(spark, sf_dir):
    """Rows of sectors in a long main line."""
    return p9.keep_mainline(p9.sector_panel(src.bars_of(spark, sf_dir), src.membership_of(spark, sf_dir))).select("sector_label", "trade_date", "long_mainline_score")


# -- strategies --------------------------------------------------------------------------------------------------------

_ALL = "1998-06-30"


def _base(spark, sf_dir):
    """The base frame of one day, with the stand-in scores of the last bars up to it."""
    bars = src.held_bars(spark, sf_dir)
    df = _last_scores(bars.where(F.col("trade_date") <= _ALL), _ALL)
    scores = rt.phase_risk(df, "p1", "phase1").join(rt.phase_risk(df, "p2", "phase2"), ["trade_date", "symbol"], "full").join(rt.phase_return(df, "p4"), ["trade_date", "symbol"], "full")
    crash = rt.crash_score(lab.negative_outliers(lab.crash_measures(lab.firm_returns(lab.weekly_returns(bars)))), 1998)
    hits = df.where("close > ma_20").select("symbol", (F.length("symbol") % 6 + 1).alias("pattern_id"))
    return bt.base_frame(rt.stock_base(bars), scores.join(crash, "symbol", "left"), hits)


@query()
def component_picks(spark, sf_dir):
    """Picks of the component strategies of a day."""
    return bt.component_strategies(_base(spark, sf_dir))


@query()
def component_comparison(spark, sf_dir):
    """The strategies' trades over ten days, by day and compared."""
    bars = src.held_bars(spark, sf_dir)
    picks = src.held(bt.component_strategies(_base(spark, sf_dir)))  # read by the paths and by the trades
    at = bars.where(F.col("trade_date") <= _ALL).groupBy("symbol").agg(F.max("trade_date").alias("at"))
    signals = picks.join(at, "symbol").select("strategy", "symbol", F.col("at").alias("signal_date"))
    paths = bt.forward_paths(bars, signals.select("symbol", "signal_date").distinct(), 10)
    trades = signals.join(bt.barrier_trades(paths, 10), ["symbol", "signal_date"])
    return bt.compare_strategies(bt.daily_portfolio(trades, ["strategy", "signal_date"]))


_SIGNALS = f"y0 AS (SELECT *, row_number() OVER ({_S}) AS i, {_avg('volume', 20)} AS v20, CASE WHEN count(close) OVER ({_S} ROWS 19 PRECEDING) >= 20 THEN max(close) OVER ({_S} ROWS 19 PRECEDING) END AS t20 FROM bars), y1 AS (SELECT symbol, trade_date AS signal_date, i, (high - low) / close AS a FROM y0 WHERE close >= t20 AND volume / v20 > 2), y2 AS (SELECT y1.symbol, signal_date, a, y0.i - y1.i AS k, y0.*  EXCLUDE (symbol, i), first_value(y0.open) OVER (PARTITION BY y1.symbol, signal_date ORDER BY y0.i) AS entry, count(*) OVER (PARTITION BY y1.symbol, signal_date) AS n FROM y1 JOIN y0 ON y0.symbol = y1.symbol AND y0.i BETWEEN y1.i + 1 AND y1.i + 10),"


def _signals(spark, sf_dir):
    bars = src.bars_of(spark, sf_dir)
    signals = ind.add_moving(bars).where("is_20d_high and volume_ratio_20 > 2").select("symbol", F.col("trade_date").alias("signal_date"), F.try_divide(F.col("high") - F.col("low"), F.col("close")).alias("atr_pct"))
    return bt.forward_paths(bars, signals.drop("atr_pct"), 10), signals


@query(f"{_SIGNALS} y3 AS (SELECT symbol, signal_date, any_value(entry) AS entry, min(CASE WHEN low <= entry * 0.92::DOUBLE THEN k END) AS d, min(CASE WHEN high >= entry * 1.15::DOUBLE THEN k END) AS u, arg_max(close, k) AS last, min(low) AS lo, max(high) AS hi FROM y2 WHERE n = 10 GROUP BY 1, 2), --- SELECT symbol, signal_date, CASE WHEN d IS NULL AND u IS NULL THEN 'timeout' WHEN u IS NULL OR d < u THEN 'stop_loss' WHEN d = u THEN 'stop_loss_first' ELSE 'take_profit' END AS exit_reason, coalesce(least(d, u), 10) AS holding_days, last / entry - 1 AS raw_return, CASE WHEN d IS NULL AND u IS NULL THEN last / entry - 1 WHEN u IS NULL OR d <= u THEN -0.08 ELSE 0.15 END AS barrier_return, lo / entry - 1 AS max_drawdown, hi / entry - 1 AS max_profit FROM y3", "raw_return barrier_return max_drawdown max_profit", "symbol signal_date exit_reason holding_days")
def barrier_trades(spark, sf_dir):
    """Trades by stop and take over ten days."""
    paths, _ = _signals(spark, sf_dir)
    return bt.barrier_trades(paths, 10).select("symbol", "signal_date", "exit_reason", "holding_days", "raw_return", "barrier_return", "max_drawdown", "max_profit")


@query(f"{_SIGNALS} y3 AS (SELECT *, least(2 * a, 0.02::DOUBLE / (0.4::DOUBLE * 0.45::DOUBLE)) AS r FROM y2 WHERE n = 10 AND a > 0), --- SELECT symbol, signal_date, any_value(r) AS r_pct, any_value(entry * (1 - r)) AS stop, any_value(entry * (1 + 2.5::DOUBLE * r)) AS take2, min(CASE WHEN low <= entry * (1 - r) THEN k END) AS stop_day, min(CASE WHEN low <= entry * (1 - r / 2) THEN k END) AS add2_day, min(CASE WHEN high >= entry * (1 + r) THEN k END) AS add3_day, min(CASE WHEN high >= entry * (1 + 1.5::DOUBLE * r) THEN k END) AS take1_day FROM y3 GROUP BY 1, 2", "r_pct stop take2", "symbol signal_date stop_day add2_day add3_day take1_day")
def staged_levels(spark, sf_dir):
    """Levels of staged positions and when they are met."""
    paths, signals = _signals(spark, sf_dir)
    return bt.staged_levels(paths, signals, 10).select("symbol", "signal_date", "r_pct", "stop", "take2", "stop_day", "add2_day", "add3_day", "take1_day")


@query(f"{_SCORED} ss AS (SELECT symbol, trade_date, outcome, CASE WHEN count(score) OVER ({_S} ROWS 4 PRECEDING) >= 3 THEN avg(score) OVER ({_S} ROWS 4 PRECEDING) - 0.5::DOUBLE * stddev_pop(score) OVER ({_S} ROWS 4 PRECEDING) END AS st FROM s1), su AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY round(st, 12), symbol)::DOUBLE AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM ss WHERE st IS NOT NULL), --- SELECT CASE WHEN n < 10 THEN floor((k - 1) / n * 10) ELSE greatest(ceil((k - 1) * 10 / (n - 1)) - 1, 0) END::INT AS stability_decile, count(*) AS n_rows FROM su GROUP BY 1", "", "stability_decile n_rows")
def stability_deciles(spark, sf_dir):
    """Deciles of steady scores."""
    df = bt.stability(sc.rolling_score(_scored(spark, sf_dir), "score"), "score")
    return df.groupBy("stability_decile").agg(F.count(F.lit(1)).alias("n_rows"))


@query("cd AS (SELECT DISTINCT trade_date FROM bars), sp AS (SELECT symbol, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1), --- SELECT symbol, count(*) AS trading_days FROM sp JOIN cd ON trade_date BETWEEN a AND b GROUP BY 1", "", "symbol trading_days")
def trading_days(spark, sf_dir):
    """Market days within each symbol's span."""
    bars = src.bars_of(spark, sf_dir)
    spans = bars.groupBy("symbol").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))
    return fn.trading_days(spans, bars).select("symbol", "trading_days")


@query(f"hp AS (SELECT symbol, close / lag(close, 10) OVER ({_S}) - 1 AS r, volume, lag(volume) OVER ({_S}) AS v1 FROM bars), --- SELECT symbol, avg(coalesce(r > 0, false)::INT) AS up_rate, quantile_cont(r, 0.5) AS median_return, avg((volume * 2 + coalesce(v1, 0)) / (2 + CASE WHEN v1 IS NULL THEN 0 ELSE 1 END)) AS mean_volume FROM hp GROUP BY 1", "up_rate median_return mean_volume", "symbol")
def scalar_helpers(spark, sf_dir):
    """Rates, medians, lookback returns and weighted means."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    df = src.bars_of(spark, sf_dir).withColumns({"r": fn.safe_return(F.col("close"), F.lag("close", 10).over(w)), "m": fn.weighted_mean([F.col("volume"), F.lag("volume").over(w)], [2.0, 1.0])})
    return df.groupBy("symbol").agg(fn.rate(F.col("r") > 0).alias("up_rate"), fn.median("r").alias("median_return"), F.avg("m").alias("mean_volume"))


# -- the day's quotes over sectors ------------------------------------------------------------------------------------------


@query("qz AS (SELECT lpad(CAST(user_id % 100 + 1 AS VARCHAR), 6, '0') AS symbol, arg_max(value, (ts, event_id)) % 7 - 3 AS pct FROM events GROUP BY 1), qy AS (SELECT sector_type, sector_label, round(avg(pct), 4) AS leader_pct_change, count(pct) AS valid_leaders FROM members LEFT JOIN qz USING (symbol) GROUP BY 1, 2), --- SELECT *, CASE WHEN leader_pct_change IS NOT NULL THEN rank() OVER (ORDER BY leader_pct_change DESC NULLS LAST) END AS strength_rank FROM qy", "leader_pct_change", "sector_type sector_label valid_leaders strength_rank")
def intraday_strength(spark, sf_dir):
    """Strength of sectors by the quotes of their members."""
    e = src.table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id") % 100 + 1)
    latest = qs.quotes_of(e).groupBy("symbol").agg(F.max_by("close", F.struct("quote_datetime", "event_id")).alias("close"))
    snapshots = qs.snapshot(latest.withColumn("pct_change", F.col("close") % 7 - 3)).select("symbol", "intraday_pct_change")
    members = src.membership_of(spark, sf_dir)
    sectors = members.select("sector_type", "sector_label").distinct().withColumn("phase9_score_100", F.lit(50.0))
    return qs.sector_strength(snapshots, members, sectors).select("sector_type", "sector_label", "leader_pct_change", "valid_leaders", "strength_rank")


_OVER = """fq AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, CAST(ts AS DATE) AS trade_date, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2), f1 AS (SELECT * FROM fq QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date) = 1),
ob AS (SELECT bars.symbol, bars.trade_date, bars.open, bars.close, bars.high, bars.low, bars.volume, bars.amount FROM bars JOIN f1 USING (symbol) WHERE bars.trade_date < f1.trade_date UNION ALL SELECT symbol, trade_date, close, close, close, close, 0, 0 FROM f1), """


def _quoted(spark, sf_dir):
    """The last quote of each symbol on its first day, and states and tails of the bars before it."""
    latest = qs.latest_quotes(qs.quotes_of(src.table(spark, sf_dir, "events")))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    latest = latest.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    history = ca.before_today(src.bars_of(spark, sf_dir), latest)
    return latest, ind.recurrence_state(history), ca.history_tail(history)


@query(f"{_OVER} {_EMA.replace('FROM bars', 'FROM ob')} z0 AS (SELECT *, dif - dea AS u, lag(dif - dea) OVER ({_S}) AS u0, lag(close) OVER ({_S}) AS pre, ln(close / lag(close) OVER ({_S})) AS lr, close / lag(close, 5) OVER ({_S}) - 1 AS r5, {_avg('close', 20)} AS m20 FROM ind), z1 AS (SELECT *, {_avg('lr', 20).replace('avg(', 'stddev_samp(')} AS v20 FROM z0), z2 AS (SELECT symbol, bool_or(u0 <= 0 AND u > 0) AS g, bool_or(u0 >= 0 AND u < 0) AS d FROM z1 WHERE i > n - 3 GROUP BY 1), --- SELECT symbol, trade_date, close, dif AS macd_dif, dea AS macd_dea, 2 * (dif - dea) AS macd_hist, atr AS atr_14, atr / close AS atr_pct_14, CASE WHEN g THEN 'golden_cross' WHEN d THEN 'dead_cross' WHEN u > 0 THEN 'above_signal' WHEN u <= 0 THEN 'below_signal' END AS macd_state, (close / pre - 1) * 100 AS intraday_pct_change, r5 AS return_5d, v20 AS vol_20, close / m20 - 1 AS ma20_distance FROM z1 LEFT JOIN z2 USING (symbol) WHERE i = n", "close macd_dif macd_dea macd_hist atr_14 atr_pct_14 intraday_pct_change return_5d vol_20 ma20_distance", "symbol trade_date macd_state", True)
def intraday_analysis(spark, sf_dir):
    """Indicators and features of the first quoted day of each symbol, from states advanced by its provisional bar."""
    latest, state, tail = _quoted(spark, sf_dir)
    df = ca.analysis(latest, state, tail)
    return df.select("symbol", "trade_date", "close", "macd_dif", "macd_dea", "macd_hist", "atr_14", "atr_pct_14", "macd_state", "intraday_pct_change", "return_5d", "vol_20", "ma20_distance")


@query()
def intraday_routes(spark, sf_dir):
    """Routes of the day by the strength of sectors."""
    scored = _stocks(spark, sf_dir)[-1].join(src.membership_of(spark, sf_dir), "symbol")
    latest, state, tail = _quoted(spark, sf_dir)
    change = ca.analysis(latest, state, tail).select("symbol", "intraday_pct_change")
    stocks = scored.join(change, "symbol")
    pool = qs.pool_source(stocks.where("public"), stocks)
    sectors = _sectors(spark, sf_dir).select("sector_type", "sector_label", "phase9_score_100")
    strength = qs.sector_strength(pool.select("symbol", "intraday_pct_change"), pool.select("sector_type", "sector_label", "symbol"), sectors)
    pool = pool.join(sectors.select("sector_label", "phase9_score_100"), "sector_label", "left")
    return qs.intraday_routes(pool, strength).select("route", "route_rank", "display_rank", "symbol", "sector_label", "pool_score")
